"""Dashboard and fleet aggregates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.functions.ordered import modal, top_per_group
from lureframe.operators.sessions import latest_analyses
from lureframe.sources.reference import RISK_LEVELS

# --- fixed values -------------------------------------------------------------------------------
WINDOWS = {
    "15m": timedelta(minutes=15), "1h": timedelta(hours=1), "24h": timedelta(hours=24),
    "7d": timedelta(days=7), "30d": timedelta(days=30),
}
BUCKETS = {"15m": "1 minute", "1h": "5 minutes", "24h": "1 hour", "7d": "12 hours", "30d": "1 day"}
HIGH = ("critical", "high")
TOP, MAX_TOP = 10, 1000
PROTOCOL_NAMES = {"ssh": "SSH", "telnet": "Telnet", "http": "HTTP"}
# --- end of fixed values ------------------------------------------------------------------------


def lit_ts(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def bounds(as_of: datetime, range_: str) -> tuple[datetime, datetime, datetime]:
    """A1: (previous start, start, end); an unknown range reads as 24h."""
    span = WINDOWS.get(range_, WINDOWS["24h"])
    return as_of - 2 * span, as_of - span, as_of


def in_window(as_of: datetime, range_: str) -> Column:
    _, start, end = bounds(as_of, range_)
    return F.col("ts").between(lit_ts(start), lit_ts(end))


def trend(current: Column, previous: Column) -> tuple[Column, Column]:
    """A3: percentage change to one place; a zero baseline is flat, never a jump."""
    raw = F.bround((current - previous) / previous * 100, 1)
    pct = F.when(previous == 0, 0.0).otherwise(raw)
    return pct, F.when(pct > 0, "up").when(pct < 0, "down").otherwise("flat")


def kpis(ev: DataFrame, as_of: datetime, range_: str = "24h", exact: bool = True) -> DataFrame:
    """A2: four measures in the window and the one before it.

    Counts need one conditional scan. Exact distinct counts are taken as two-phase distinct
    aggregates; `exact=False` uses one sketch pass instead.
    """
    before, start, end = bounds(as_of, range_)
    rows = ev.filter(F.col("ts").between(lit_ts(before), lit_ts(end))).withColumn(
        "_w", F.when(F.col("ts") >= lit_ts(start), "cur").otherwise("prev")
    )
    high = F.col("risk_level").isin(*HIGH)
    if exact:
        counts = rows.groupBy("_w").agg(F.count(F.lit(1)).alias("total_events"), F.count_if(high).alias("high_risk"))
        # One row per distinct (window, measure, value), then a count: no wide expand, no hot group.
        pairs = rows.select(
            "_w",
            F.explode(
                F.array(
                    F.struct(F.lit("active_sessions").alias("id"), F.col("session_id").alias("v")),
                    F.struct(F.lit("techniques").alias("id"), F.col("mitre_technique_id").alias("v")),
                )
            ).alias("_p"),
        ).select("_w", "_p.id", "_p.v").filter(F.col("v").isNotNull()).distinct()
        distinct = pairs.groupBy("_w", "id").agg(F.count(F.lit(1)).alias("n"))
        long = counts.select(
            "_w", F.expr("stack(2, 'total_events', total_events, 'high_risk', high_risk) AS (id, n)")
        ).unionByName(distinct)
    else:
        sketch = rows.groupBy("_w").agg(
            F.count(F.lit(1)).alias("total_events"),
            F.approx_count_distinct("session_id", 0.01).alias("active_sessions"),
            F.count_if(high).alias("high_risk"),
            F.approx_count_distinct("mitre_technique_id", 0.01).alias("techniques"),
        )
        long = sketch.select(
            "_w",
            F.expr(
                "stack(4, 'total_events', total_events, 'active_sessions', active_sessions,"
                " 'high_risk', high_risk, 'techniques', techniques) AS (id, n)"
            ),
        )
    ids = ev.sparkSession.createDataFrame(
        [("total_events",), ("active_sessions",), ("high_risk",), ("techniques",)], "id string"
    )
    both = long.groupBy("id").agg(
        F.coalesce(F.sum(F.when(F.col("_w") == "cur", F.col("n"))), F.lit(0)).alias("value"),
        F.coalesce(F.sum(F.when(F.col("_w") == "prev", F.col("n"))), F.lit(0)).alias("previous"),
    )
    filled = ids.join(both, "id", "left").fillna(0, ["value", "previous"])
    pct, direction = trend(F.col("value"), F.col("previous"))
    return filled.select("id", "value", "previous", pct.alias("trend_pct"), direction.alias("direction"))


def activity(ev: DataFrame, as_of: datetime, range_: str = "24h") -> DataFrame:
    """A4: events and high-risk events per epoch-aligned bucket, zero-filled over the window."""
    _, start, end = bounds(as_of, range_)
    width = BUCKETS.get(range_, BUCKETS["24h"])
    counted = (
        ev.filter(in_window(as_of, range_))
        .groupBy(F.window("ts", width).getField("start").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("risk_level").isin(*HIGH)).alias("high_risk"))
    )
    seconds = int({"1 minute": 60, "5 minutes": 300, "1 hour": 3600, "12 hours": 43200, "1 day": 86400}[width])
    align = lambda t: F.timestamp_seconds(F.floor(F.unix_seconds(lit_ts(t)) / seconds) * seconds)
    axis = ev.sparkSession.range(1).select(
        F.explode(F.sequence(align(start), align(end), F.expr(f"INTERVAL {width}"))).alias("bucket")
    )
    return axis.join(counted, "bucket", "left").select(
        "bucket", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("high_risk", F.lit(0)).alias("high_risk")
    )


def risk_levels(ev: DataFrame, as_of: datetime, range_: str = "24h") -> DataFrame:
    """A5: the five levels, absent ones as 0."""
    levels = ev.sparkSession.createDataFrame(list(enumerate(RISK_LEVELS)), "position int, level string")
    counted = ev.filter(in_window(as_of, range_)).groupBy(F.col("risk_level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counted, "level", "left").select("position", "level", F.coalesce("n", F.lit(0)).alias("n"))


def classifications(ev: DataFrame, as_of: datetime, range_: str = "24h", shown: int = 6) -> DataFrame:
    """The ten most frequent labels; those past `shown` are folded into "Other"."""
    counted = (
        ev.filter(in_window(as_of, range_) & F.col("ai_classification").isNotNull())
        .groupBy(F.col("ai_classification").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("label")).limit(TOP)
    )
    # At most ten rows from here on.
    ranked = top_per_group(counted.withColumn("_g", F.lit(1)), ["_g"], [F.desc("n"), F.asc("label")], TOP, rank="r")
    name = F.when(F.col("r") > shown, "Other").otherwise(F.col("label"))
    return ranked.groupBy(name.alias("label")).agg(F.sum("n").alias("n"))


def assessed_risk(ev: DataFrame, an: DataFrame, ips: DataFrame | None = None) -> DataFrame:
    """Per address, the risk of its highest-scored analysed session; others are absent."""
    best = an.groupBy("session_id").agg(F.max(F.struct("risk_score", "risk")).alias("_b"))
    pairs = ev.select("source_ip", "session_id")
    if ips is not None:
        pairs = pairs.join(ips.select("source_ip").distinct(), "source_ip", "left_semi")
    return (
        pairs.distinct().join(best, "session_id")
        .groupBy("source_ip").agg(F.max("_b").alias("_b"))
        .select("source_ip", F.col("_b.risk").alias("risk"))
    )


def _check(k: int) -> None:
    """A top-k is broadcast below, so k has a bound."""
    if not 1 <= k <= MAX_TOP:
        raise ValueError(f"k must be 1..{MAX_TOP}")


def top_attackers(ev: DataFrame, an: DataFrame | None, as_of: datetime, range_: str = "24h", k: int = TOP) -> DataFrame:
    """The busiest addresses. Top-k first; only those rows get distinct counts and modes."""
    _check(k)
    window = ev.filter(in_window(as_of, range_) & F.col("source_ip").isNotNull())
    top = F.broadcast(  # k rows
        window.groupBy("source_ip").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen"))
        .orderBy(F.desc("events"), F.asc("source_ip")).limit(k)
    )
    mine = window.join(top.select("source_ip"), "source_ip", "left_semi")
    sessions = mine.select("source_ip", "session_id").distinct().groupBy("source_ip").agg(F.count(F.lit(1)).alias("sessions"))
    out = top.join(sessions, "source_ip").join(modal(mine, ["source_ip"], "source_country", "country"), "source_ip", "left")
    out = out.withColumn("country", F.coalesce("country", F.lit("Unknown")))
    if an is None:
        out = out.withColumn("risk", F.lit(None).cast("string"))
    else:
        out = out.join(assessed_risk(ev, an, top), "source_ip", "left")
    return out.select(F.col("source_ip").alias("ip"), "country", "events", "sessions", "last_seen", "risk")


def top_commands(ev: DataFrame, as_of: datetime, range_: str = "24h", k: int = TOP, max_length: int | None = None) -> DataFrame:
    """The most frequent command lines over all events carrying one, with the modal technique."""
    _check(k)
    window = ev.filter(
        in_window(as_of, range_) & F.col("command_line").isNotNull() & text.up_to("command_line", max_length)
    )
    top = F.broadcast(  # k rows
        window.groupBy("command_line").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("command_line")).limit(k)
    )
    mine = window.join(top.select("command_line"), "command_line", "left_semi")
    technique = modal(mine, ["command_line"], "mitre_technique_id", "technique_id")
    return top.join(technique, "command_line", "left").select(F.col("command_line").alias("command"), "n", "technique_id")


def describe_type(counts: Column) -> Column:
    """Names of the protocols in an array of (n, protocol), most frequent first."""
    ordered = F.array_sort(F.transform(counts, lambda x: F.struct((-x["n"]).alias("n"), x["protocol"].alias("protocol"))))
    names = F.create_map(*[F.lit(v) for kv in PROTOCOL_NAMES.items() for v in kv])
    label = lambda p: F.coalesce(F.try_element_at(names, p), F.upper(p))
    return F.when(F.size(ordered) == 0, "unknown").otherwise(
        F.array_join(F.transform(ordered, lambda x: label(x["protocol"])), ", ")
    )


def protocol_counts(ev: DataFrame, keys: list[str]) -> DataFrame:
    """Protocol counts per key, all of them, as an array (protocols are a vocabulary)."""
    counted = ev.filter(F.col("protocol").isNotNull()).groupBy(*keys, "protocol").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.collect_list(F.struct("n", "protocol")).alias("protocol_counts"))


def sensors(ev: DataFrame, as_of: datetime) -> DataFrame:
    """A10: the inventory the events imply. A sensor silent for more than a day is degraded."""
    key = ["honeypot_id"]
    base = ev.groupBy(*key).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_activity"))
    sessions = ev.select(*key, "session_id").distinct().groupBy(*key).agg(F.count("session_id").alias("sessions"))
    stale = F.unix_micros(lit_ts(as_of)) - F.unix_micros("last_activity") > 86_400_000_000
    return (
        base.join(sessions, key).join(modal(ev, key, "honeypot_name", "_name"), key, "left")
        .join(modal(ev, key, "destination_ip", "_ip"), key, "left").join(protocol_counts(ev, key), key, "left")
        .select(
            *key, F.coalesce("_name", "honeypot_id").alias("name"), F.coalesce("_ip", F.lit("unknown")).alias("ip"),
            F.coalesce(describe_type(F.col("protocol_counts")), F.lit("unknown")).alias("type"),
            F.when(stale, "degraded").otherwise("online").alias("status"), "sessions", "events", "last_activity",
        )
    )


def indicator_counts(ind: DataFrame) -> DataFrame:
    """A11."""
    return ind.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def ingest_status(ev: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rejected and seeded counts."""
    counted = ev.agg(F.count_if("labels_seeded").alias("seeded"), F.count(F.lit(1)).alias("events"))
    return counted.withColumn("rejected", rejected.agg(F.count(F.lit(1))).scalar())
