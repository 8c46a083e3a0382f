"""Registered queries that run a stream over the provided tables to its end and return what it stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureframe.plans import adapter as A
from lureframe.plans import oracle as O
from lureframe.plans.oracle import sql, ts
from lureframe.plans.q_ingest import BAD, ODD_LINE, _raw
from lureframe.plans.q_sessions import EXTRACTED
from lureframe.plans.registry import query
from lureframe.session import shared_folder, write_once
from lureframe.streaming import jobs

FILES_PER_BATCH = 4


def _stream(stored: DataFrame) -> DataFrame:
    """A stored relation as a stream of a few files per micro-batch."""
    folder = stored.inputFiles()[0].rpartition("/")[0]
    return stored.sparkSession.readStream.schema(stored.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lureframe-stream-{uuid.uuid4().hex}"


def _finished(query_) -> None:
    query_.awaitTermination()
    if query_.exception() is not None:
        raise query_.exception()


#: Days at which the event log is cut into deliveries, in order.
CUTS = ("2024-01-08", "2024-01-16", "2024-01-24")
#: One event in fifty of the first delivery comes with the last one.
HELD_BACK = "ts < TIMESTAMP '2024-01-08' AND k % 50 = 7"


def _deliveries(spark: SparkSession, d: str, held_back: bool = False, flush: bool = True) -> DataFrame:
    """The event log as a stream of one delivery per micro-batch; two events of a later year close what is open."""
    ev = A.events(spark, d)
    folder = _place(spark)
    edges = [None, *CUTS, None]
    held = F.expr(HELD_BACK) if held_back else F.lit(False)
    for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        part = F.lit(True)
        part = part & (F.col("ts") >= F.lit(lo).cast("timestamp")) if lo else part
        part = part & (F.col("ts") < F.lit(hi).cast("timestamp")) if hi else part
        rows = ev.filter((part & ~held) | held if n == len(edges) - 2 else part & ~held)
        rows.repartition(FILES_PER_BATCH).write.mode("append").parquet(folder)
    for year in ("2030", "2031") if flush else ():
        end = spark.range(0, FILES_PER_BATCH, 1, FILES_PER_BATCH).select(
            *[(F.lit(f"{year}-01-01").cast("timestamp") if f.name == "ts" else F.lit("~end").cast(f.dataType) if f.name in ("session_id", "source_ip") else F.lit(None).cast(f.dataType)).alias(f.name) for f in ev.schema.fields])
        end.write.mode("append").parquet(folder)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)


def _table(spark: SparkSession, rows: DataFrame) -> DataFrame:
    at = _place(spark)
    _finished(jobs.table_stream(rows, f"{at}/rows", f"{at}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


@query(
    "stream_ingest",
    sql(f"""SELECT DISTINCT session_id, {ts('ts')}, action, category, source_ip, source_port, protocol, username, command_line, sha256, honeypot_id
      FROM (SELECT session_id, CASE WHEN NOT odd THEN ts END AS ts, CASE WHEN odd THEN '5' ELSE action END AS action, CASE WHEN odd THEN 'other' ELSE category END AS category, source_ip,
        CASE WHEN NOT odd THEN source_port END AS source_port, CASE WHEN odd THEN 'ssh' ELSE protocol END AS protocol, CASE WHEN NOT odd THEN username END AS username,
        CASE WHEN NOT odd THEN command_line END AS command_line, CASE WHEN NOT odd THEN sha256 END AS sha256, honeypot_id FROM (SELECT *, {ODD_LINE} AS odd FROM ev WHERE {BAD} IS NULL))"""),
)
def _ingest(spark, d):
    """Every line is delivered twice; equal lines are one event, and nothing else hides a line stored twice."""
    at, raw = _place(spark), write_once(_raw(spark, d))
    raw.write.mode("append").parquet(raw.inputFiles()[0].rpartition("/")[0])
    _finished(jobs.ingest_stream(_stream(raw), f"{at}/events", f"{at}/dead", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/events").select("session_id", "ts", "action", "category", "source_ip", "source_port", "protocol", "username", "command_line", "sha256", "honeypot_id")


@query("stream_indicators", sql(f"SELECT type, value, session_count, source, {ts('first_seen')}, {ts('last_seen')} FROM ind", O.RUNS, EXTRACTED))
def _indicators(spark, d):
    at, ev = _place(spark), A.events(spark, d)
    _finished(jobs.indicator_stream(_stream(ev), f"{at}/links", f"{at}/checkpoint"))
    found = jobs.current_indicators(jobs.stored_links(spark, f"{at}/links", ev.schema["event_id"].dataType.simpleString()))
    return found.select("type", "value", "session_count", "source", "first_seen", "last_seen")


@query(
    "stream_activity",
    sql(f"""SELECT {ts('bucket')}, events, high_risk FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS events,
      count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk FROM ev GROUP BY 1)"""),
)
def _activity(spark, d):
    return _table(spark, jobs.activity_counts(_deliveries(spark, d))).filter("bucket < TIMESTAMP '2030-01-01'")


@query(
    "stream_address_sessions",
    sql(f"""SELECT source_ip AS ip, {ts('min(ts)', '"start"')}, {ts('max(ts)', '"end"')}, count(*) AS requests FROM (
      SELECT source_ip, ts, sum(nw) OVER (PARTITION BY source_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
        SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_ip ORDER BY ts, event_id)) >= 1800000000 THEN 1 ELSE 0 END AS nw FROM ev)) GROUP BY source_ip, n"""),
)
def _address_sessions(spark, d):
    return _table(spark, jobs.inactivity_sessions(_deliveries(spark, d))).filter("ip <> '~end'")


@query(
    "stream_sessions",
    sql(f"""SELECT session_id, {ts('min(ts)', 'started_at')}, {ts('max(ts)', 'last_at')}, count(*) AS events, count(*) FILTER (action = 'cowrie.command.input') AS commands,
      bool_or(action = 'cowrie.login.success') AS logged_in, CASE WHEN bool_or(action = 'cowrie.session.closed') THEN 'closed' ELSE 'timeout' END AS ended FROM ev GROUP BY 1"""),
)
def _stream_sessions(spark, d):
    return _table(spark, jobs.session_states(_deliveries(spark, d))).filter("session_id <> '~end'")


@query(
    "stream_kpis",
    sql(f"SELECT {ts('a.start', '\"start\"')}, a.events, coalesce(b.events, 0) AS previous FROM w a LEFT JOIN w b ON b.start = a.start - INTERVAL 1 HOUR",
        "w AS (SELECT start, count(*) AS events FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 5 MINUTE AS start FROM ev, range(12) r(i)) GROUP BY 1)"),
)
def _kpis(spark, d):
    windows = _table(spark, jobs.sliding_kpis(_deliveries(spark, d)))
    return jobs.against_previous(windows.filter("start < TIMESTAMP '2029-01-01'")).select("start", "events", "previous")


@query(
    "stream_sightings",
    sql(f"SELECT technique_id, {ts('min(ts)', 'ts')}, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(session_id, (ts, event_id)) AS session_id FROM ev JOIN cmd_tech USING (command_line) WHERE action = 'cowrie.command.input' GROUP BY 1", O.CMD_TECH),
)
def _sightings(spark, d):
    at = _place(spark)
    _finished(jobs.snapshot_stream(jobs.first_sightings(_deliveries(spark, d)), f"{at}/rows", f"{at}/checkpoint"))
    return jobs.newest_snapshot(spark, f"{at}/rows")


@query(
    "stream_late_rows",
    sql(f"""SELECT event_id, {ts('e.ts', 'ts')}, session_id, {ts("m - INTERVAL 10 MINUTE", 'watermark')} FROM ev e,
      (SELECT max(ts) AS m FROM ev WHERE ts < TIMESTAMP '2024-01-24') WHERE {HELD_BACK} AND e.ts < m - INTERVAL 10 MINUTE"""),
)
def _late(spark, d):
    at = _place(spark)
    _finished(jobs.late_rows_stream(_deliveries(spark, d, held_back=True, flush=False), f"{at}/events", f"{at}/late", f"{at}/marks", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/late").select("event_id", "ts", "session_id", "watermark")
