"""Structured Streaming forms of the batch answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lureframe.functions import text
from lureframe.functions.bind import bind
from lureframe.operators import indicators, ingest
from lureframe.operators.fleet import trend
from lureframe.operators.rules import techniques_of
from lureframe.operators.sessions import CLOSED, COMMAND
from lureframe.session import discard, write_once
from lureframe.sources import sinks


def _start(stream: DataFrame, checkpoint: str, each_batch, mode: str = "append", once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _stored(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What earlier batches stored below path; None before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        return None
    rows = spark.read.parquet(path)
    return rows.filter(F.col("batch_id") != batch_id) if "batch_id" in rows.columns else None


def ingest_stream(raw: DataFrame, events_path: str, dead_path: str, checkpoint: str, cidr: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Raw lines to the event log and the dead letters.

    No clock decides what is kept: a line of any age is stored, whenever it comes. A redelivered line is known by
    its id (sensor and content) and left out if its batch or an earlier one holds it; a line's day is part of its
    content, so only stored days that the batch touches are read; refused lines, whose day can't be trusted, are
    shelved by their id, and only the shelves that the batch touches are read. Lines are parsed once, into a staged relation.
    Each micro-batch overwrites its own partition, so a batch replayed after a lost executor or driver leaves one
    copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines = ingest.judged_lines(batch, cidr).dropDuplicates(["event_id"]).withColumn("event_date", F.to_date("ts"))
        staged = write_once(lines)
        old_events, old_dead = _stored(spark, events_path, batch_id), _stored(spark, dead_path, batch_id)
        good, bad = staged.filter(F.col("_reason").isNull()), staged.filter(F.col("_reason").isNotNull())
        if old_events is not None:
            days = [r["event_date"] for r in good.select("event_date").distinct().collect()]  # the days of one micro-batch
            touched = F.col("event_date").isin([d for d in days if d is not None]) | (F.col("event_date").isNull() & F.lit(None in days))
            good = good.join(old_events.filter(touched).select("event_id"), "event_id", "left_anti")
        bad = bad.withColumn("shelf", F.substring("event_id", 1, 2))
        if old_dead is not None:
            shelves = [r["shelf"] for r in bad.select("shelf").distinct().collect()]  # of 256
            bad = bad.join(old_dead.filter(F.col("shelf").isin(shelves)).select("event_id"), "event_id", "left_anti")
        sinks.write_events(good.drop("_raw", "_unknown", "_reason", "event_date"), f"{events_path}/batch_id={batch_id}", mode="overwrite")
        refused = bad.select("event_id", F.col("_raw").alias("raw"), F.col("_unknown").alias("unknown_keys"), F.col("_reason").alias("reason"), "honeypot_id", "shelf")
        refused.write.mode("overwrite").partitionBy("shelf").parquet(f"{dead_path}/batch_id={batch_id}")
        discard(staged)

    return _start(raw, checkpoint, write, once=once)


def activity_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts, final once the watermark passes."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk"))
        .select(F.col("window.start").alias("bucket"), "events", "high_risk")
    )


def inactivity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per stretch of requests of an address without more than the gap of silence."""
    return (
        events.withWatermark("ts", late).groupBy("source_ip", F.session_window("ts", gap))
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("requests"))
        .select(F.col("source_ip").alias("ip"), "start", "end", "requests")
    )


STATE_DDL = "sessions binary, due bigint"
FACTS = pa.schema([("session_id", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("events", pa.int64()), ("commands", pa.int64()), ("logged_in", pa.int8()), ("closed", pa.int8()), ("due", pa.int64())])
#: How two rows of a session become one; `fresh` tells sessions with rows in this batch.
FOLD = {"first": "min", "last": "max", "events": "sum", "commands": "sum", "logged_in": "max", "closed": "max", "due": "max", "fresh": "max"}
FOLD_ROWS = 50_000
OUT_DDL = "session_id string, first bigint, last bigint, events bigint, commands bigint, logged_in boolean, ended string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _session_rows(f: pd.DataFrame) -> pa.Table:
    """Each event as a session of its own."""
    us, kind = pa.array(f["us"], pa.int64(), from_pandas=True), f["kind"].to_numpy()
    one = pa.array(np.ones(len(f), "int64"))
    return pa.table({
        "session_id": pa.array(f["session_id"], pa.string(), from_pandas=True), "first": us, "last": us, "events": one, "commands": (kind == 1).astype("int64"),
        "logged_in": (kind == 2).astype("int8"), "closed": (kind == 3).astype("int8"), "due": np.zeros(len(f), "int64"), "fresh": np.ones(len(f), "int8")})


def _folded(parts: list[pa.Table]) -> pa.Table:
    """One row per session, the one without an id among them."""
    found = pa.concat_tables(parts).group_by("session_id", use_threads=False).aggregate(list(FOLD.items()))
    return found.select(["session_id", *(f"{c}_{how}" for c, how in FOLD.items())]).rename_columns(["session_id", *FOLD])


class SessionFold(StatefulProcessor):
    """Six values and a due time per open session, kept together per shard, with one timer per shard at the earliest due time.

    A shard's sessions are read, folded and written as one Arrow table, so that calls to the state store from Python are
    counted by shards and not by sessions. A batch of a hot session arrives as frames and is folded, never held. Times are microseconds of UTC.
    """

    def __init__(self, idle_minutes: int) -> None:
        self.idle_ms = idle_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", STATE_DDL)

    def _load(self) -> tuple[pa.Table, int | None]:
        stored = self.state.get()
        if stored is None:
            return FACTS.empty_table(), None
        return pa.ipc.open_stream(pa.py_buffer(bytes(stored[0]))).read_all(), stored[1]

    def _store(self, facts: pa.Table, old_due: int | None) -> None:
        """The open sessions of the shard, and its timer."""
        due = pc.min(facts["due"]).as_py()
        if due is None:
            self.state.clear()
        else:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, FACTS) as out:
                out.write_table(facts.combine_chunks())
            self.state.update((sink.getvalue().to_pybytes(), due))
        if due != old_due:
            if old_due is not None:
                self.handle.deleteTimer(old_due)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        facts, old_due = self._load()
        parts, more = [facts.append_column("fresh", pa.array(np.zeros(len(facts), "int8")))], 0
        for f in rows:
            parts.append(_session_rows(f))
            more += len(f)
            if more > max(FOLD_ROWS, len(parts[0])):
                parts, more = [_folded(parts)], 0
        facts = _folded(parts)
        mark = timerValues.getCurrentWatermarkInMs()
        seen = pc.fill_null(pc.divide(facts["last"], 1000), mark)  # a session without any time is silent since the watermark
        due = pc.max_element_wise(pc.add(seen, pc.if_else(pc.equal(facts["closed"], 1), 1, self.idle_ms)), mark + 1)
        due = pc.if_else(pc.equal(facts["fresh"], 1), due, facts["due"])
        self._store(facts.select(FACTS.names[:-1]).append_column("due", due), old_due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts, old_due = self._load()
        over = pc.less_equal(facts["due"], timerValues.getCurrentWatermarkInMs())  # a timer fires at its time, too
        self._store(facts.filter(pc.invert(over)), old_due)
        out = facts.filter(over)
        ended = pc.if_else(pc.equal(out["closed"], 1), "closed", "timeout")
        yield out.select(["session_id", "first", "last", "events", "commands"]).append_column("logged_in", pc.equal(out["logged_in"], 1)).append_column("ended", ended).to_pandas()

    def close(self) -> None:
        pass


SESSION_SHARDS = 512


def session_states(events: DataFrame, idle_minutes: int = 60, late: str = "10 minutes", shards: int = SESSION_SHARDS) -> DataFrame:
    """T4: a session's facts, once: when it has closed and the watermark has passed its last event, or when it has
    been silent for too long. Events that come after the close but in time are part of it.

    Sessions are dealt to shards by their id; a task holds the open sessions of one shard at a time, so `shards` grows with how
    many are open at once. A checkpoint belongs to one number of shards. The facts of a session go from the state when it is
    given out. The state store of the events' session is RocksDB from here on, and a batch commits its changes, not all of the state.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    kind = F.when(F.col("action") == COMMAND, 1).when(F.col("action") == "cowrie.login.success", 2).when(F.col("action") == CLOSED, 3).otherwise(0)
    slim = events.select(
        F.pmod(F.xxhash64("session_id"), F.lit(shards)).cast("int").alias("shard"), "session_id", "ts", F.unix_micros("ts").alias("us"), kind.alias("kind"),
    ).withWatermark("ts", late)
    facts = slim.groupBy("shard").transformWithStateInPandas(SessionFold(idle_minutes), OUT_DDL, "append", "EventTime")
    return facts.select("session_id", F.timestamp_micros("first").alias("started_at"), F.timestamp_micros("last").alias("last_at"), "events", "commands", "logged_in", "ended")


BUCKETS = 64


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below path; none where it doesn't exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def _bucket_files(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Which generation holds each bucket, by the newest list of a batch before `before`."""
    lists = sorted(int(n.partition("=")[2]) for n in _folders(spark, f"{path}/lists") if n.startswith("batch="))
    lists = [n for n in lists if before is None or n < before]
    if not lists:
        return {}
    return {r["bucket"]: r["generation"] for r in spark.read.schema("bucket int, generation long").parquet(f"{path}/lists/batch={lists[-1]}").collect()}


LINK_DDL = "type string, value string, session_id string, first_seen timestamp, last_seen timestamp, head struct<ts:timestamp,event_id:{id},source_ip:string>, user struct<ts:timestamp,event_id:{id},username:string>"


def _read_buckets(spark: SparkSession, path: str, where: dict[int, int], kind: str) -> DataFrame:
    ddl = LINK_DDL.format(id=kind)
    if not where:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(*[f"{path}/generation={g}/bucket={b}" for b, g in sorted(where.items())])


def _merged(rows: DataFrame) -> DataFrame:
    """One row per link and one per session."""
    links = rows.filter("type IS NOT NULL").select("type", "value", "session_id").distinct()
    heads = rows.filter("type IS NULL").groupBy("session_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("head").alias("head"), F.min("user").alias("user"))
    return links.unionByName(heads, allowMissingColumns=True)


def indicator_stream(events: DataFrame, links_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """T5: one row per indicator link, and one per session with its times, earliest address and user name so far.

    A micro-batch merges its rows into the buckets (by key) that it touches, writes those as a new generation, and then a list
    of which generation holds each bucket. A reader takes the newest list, so it meets every key once and never a half-
    written bucket; a replayed batch starts from the list before it and writes the same again. Generations that
    neither the new list nor the one before names are deleted.
    """
    kind = events.schema["event_id"].dataType.simpleString()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = F.col("username").isNotNull() & (F.col("username") != "")
        heads = batch.groupBy("session_id").agg(
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min(F.struct("ts", "event_id", "source_ip")).alias("head"),
            F.min(F.when(named, F.struct("ts", "event_id", "username"))).alias("user"),
        )
        found = indicators.extract(batch, with_heads=False).select("type", "value", "session_id").distinct()
        bucket = F.pmod(F.xxhash64(F.coalesce("type", F.lit("")), F.coalesce("value", "session_id")), F.lit(BUCKETS)).cast("int")
        new = write_once(found.unionByName(heads, allowMissingColumns=True).withColumn("bucket", bucket))
        where = _bucket_files(spark, links_path, before=batch_id)
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # BUCKETS at most
        old = _read_buckets(spark, links_path, {b: g for b, g in where.items() if b in touched}, kind)
        _merged(new.drop("bucket").unionByName(old, allowMissingColumns=True)).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{links_path}/generation={batch_id}")
        now = where | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(now.items()), "bucket int, generation long").coalesce(1).write.mode("overwrite").parquet(f"{links_path}/lists/batch={batch_id}")
        discard(new)
        for name in _folders(spark, links_path):
            if name.startswith("generation=") and int(name.partition("=")[2]) not in {batch_id, *now.values(), *where.values()}:
                old_place = spark._jvm.org.apache.hadoop.fs.Path(f"{links_path}/{name}")
                old_place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old_place, True)

    return _start(events, checkpoint, write, once=once)


def stored_links(spark: SparkSession, links_path: str, event_id: str = "string") -> DataFrame:
    """T5: the newest generation of every bucket, each key once."""
    return _read_buckets(spark, links_path, _bucket_files(spark, links_path), event_id)


def current_indicators(links: DataFrame) -> DataFrame:
    """T5: the indicator table over the stored links, equal to the batch answer: a link is as old as its session's last event."""
    heads = links.filter("type IS NULL").select("session_id", "last_seen", "head", "user")
    item = lambda kind, value: F.when(value.isNotNull() & (value != ""), F.struct(F.lit(kind).alias("type"), value.alias("value")))
    own = heads.select("session_id", F.inline(F.array_compact(F.array(item("ip", F.col("head.source_ip")), item("username", F.col("user.username"))))))
    every = links.filter("type IS NOT NULL").select("session_id", "type", "value").unionByName(own).distinct()
    return indicators.correlate(every.join(heads.select("session_id", F.col("last_seen").alias("first_seen"), "last_seen"), "session_id"))


def first_sightings(events: DataFrame) -> DataFrame:
    """The earliest hit of each technique so far (update mode; the state is catalog-sized)."""
    cmds = events.filter((F.col("action") == COMMAND) & F.col("command_line").isNotNull())
    hits = bind(text.executed_text("command_line"), lambda x: techniques_of(F.col("command_line"), x))
    rows = cmds.select("session_id", "event_id", "ts", F.explode_outer(hits).alias("technique_id")).filter("technique_id IS NOT NULL")
    return rows.groupBy("technique_id").agg(F.min(F.struct("ts", "event_id", "session_id")).alias("_f")).select(
        "technique_id", F.col("_f.ts").alias("ts"), F.col("_f.event_id").alias("event_id"), F.col("_f.session_id").alias("session_id")
    )


def sliding_kpis(events: DataFrame, width: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Overlapping window sums; `against_previous` compares each with the one a width before."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width, slide))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "high_risk")
    )


def against_previous(windows: DataFrame) -> DataFrame:
    """Each window beside the window that ended where it starts."""
    before = windows.select(F.col("end").alias("start"), F.col("events").alias("previous"))
    joined = windows.join(before, "start", "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    pct, direction = trend(F.col("events"), F.col("previous"))
    return joined.select("start", "end", "events", "previous", pct.alias("trend_pct"), direction.alias("direction"))


def late_rows_stream(events: DataFrame, on_time_path: str, late_path: str, marks_path: str, checkpoint: str, late_seconds: int = 600, once: bool = True) -> StreamingQuery:
    """Rows that come after the watermark go to a table of their own, with their batch, instead of being lost.

    The watermark of a batch is the latest time of all earlier batches, less the allowance; each batch stores its own latest
    time. So the split and its count survive a restart, and a replayed batch splits the same way. Rows without a
    time are on time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _folders(spark, marks_path) if n.startswith("batch_id=") and int(n.partition("=")[2]) < batch_id]
        marks = spark.read.schema("latest timestamp").parquet(*[f"{marks_path}/{n}" for n in earlier]).agg(F.max("latest")).first()[0] if earlier else None
        staged = write_once(batch)
        mark = F.lit(None).cast("timestamp") if marks is None else F.lit(marks) - F.make_dt_interval(secs=F.lit(late_seconds))
        is_late = F.coalesce(F.col("ts") < mark, F.lit(False))
        staged.filter(~is_late).write.mode("overwrite").parquet(f"{on_time_path}/batch_id={batch_id}")
        staged.filter(is_late).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        staged.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{marks_path}/batch_id={batch_id}")
        discard(staged)

    return _start(events, checkpoint, write, once=once)


def table_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows of an append-mode answer (T2, T3, T4, T7) to Parquet, each final row once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The whole answer so far (T6), replaced with each micro-batch: a new folder per batch, of which the newest counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(rows, checkpoint, write, mode="complete", once=once)


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    newest = max(int(n.partition("=")[2]) for n in _folders(spark, path) if n.startswith("batch_id="))
    return spark.read.parquet(f"{path}/batch_id={newest}")


class LateRows(StreamingQueryListener):
    """Rows that arrived past a watermark, by query id, from every batch of the session's queries while it listens
    (`spark.streams.addListener(LateRows())`). They are counted here and stay in the batch log."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        late = sum(int(op["numRowsDroppedByWatermark"]) for op in progress["stateOperators"])
        self.rows[progress["id"]] = self.rows.get(progress["id"], 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
