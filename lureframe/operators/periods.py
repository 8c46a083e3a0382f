"""Deployments, periods and per-period traffic."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.functions.ordered import as_of, interval_join, modal, top_per_group
from lureframe.operators import fleet
from lureframe.operators.fleet import lit_ts
from lureframe.operators.rules import command_hits
from lureframe.operators.sessions import COMMAND

PRE_PERSONA = "pre-persona"
STOCK = "stock"


def active_deployment(points: DataFrame, dp: DataFrame, t: str = "t") -> DataFrame:
    """The deployment in force at each (honeypot_id, t)."""
    return as_of(points, dp, ["honeypot_id"], t, "deployed_at", ["deployment_id"], ["persona", "deployed_at"])


def periods(dp: DataFrame, ch: DataFrame | None, spans: DataFrame) -> DataFrame:
    """Each sensor's [start, end) window cut at the deployments and changes strictly inside.

    `spans` holds (honeypot_id, start, end). The inputs are a sensor's hand-made history, so the
    windows here run over a few rows per sensor.
    """
    spans = spans.filter(F.col("end") > F.col("start")).select("honeypot_id", "start", "end")
    dep = dp.join(spans, "honeypot_id")
    at_start = dep.groupBy("honeypot_id").agg(
        F.max(F.when(F.col("deployed_at") <= F.col("start"), F.struct("deployed_at", "deployment_id", "persona"))).alias("_p"),
        F.bool_or(F.col("deployed_at") > F.col("start")).alias("_later"),
    )
    opening = spans.join(at_start, "honeypot_id", "left").select(
        "honeypot_id", F.col("start").alias("at"), "end",
        F.coalesce(F.col("_p.persona"), F.when(F.col("_later"), PRE_PERSONA)).alias("persona"),
        F.array().cast("array<string>").alias("opened_by"),
    )
    inside = lambda c: (F.col(c) > F.col("start")) & (F.col(c) < F.col("end"))
    cuts = dep.filter(inside("deployed_at")).select(
        "honeypot_id", F.col("deployed_at").alias("at"), "end", F.lit(0).alias("src"), F.col("deployment_id").alias("ord"),
        F.concat(F.lit("persona:"), "persona").alias("label"), "persona",
    )
    if ch is not None:
        cuts = cuts.unionByName(
            ch.join(spans, "honeypot_id").filter(inside("at")).select(
                "honeypot_id", "at", "end", F.lit(1).alias("src"), F.col("change_id").alias("ord"),
                F.col("kind").alias("label"), F.lit(None).cast("string").alias("persona"),
            )
        )
    merged = cuts.groupBy("honeypot_id", "at", "end").agg(
        F.max_by("persona", F.when(F.col("src") == 0, F.col("ord"))).alias("persona"),
        F.array_sort(F.collect_list(F.struct("src", "ord", "label"))).alias("_l"),
    ).select("honeypot_id", "at", "end", "persona", F.col("_l.label").alias("opened_by"))
    w = Window.partitionBy("honeypot_id").orderBy("at")
    force = F.last("persona", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return opening.unionByName(merged).select(
        "honeypot_id", F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("end")).alias("end"),
        force.alias("persona"), "opened_by",
    )


def windows_from_first_event(ev: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Each sensor's window, starting no earlier than its first event."""
    first = ev.groupBy("honeypot_id").agg(F.min("ts").alias("_first"))
    return first.select("honeypot_id", F.greatest("_first", lit_ts(start)).alias("start"), lit_ts(end).alias("end"))


def sensor_profile(ev: DataFrame) -> DataFrame:
    """Protocols served, modal name and address, first and last event."""
    key = ["honeypot_id"]
    base = ev.groupBy(*key).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return (
        base.join(modal(ev, key, "honeypot_name", "_n"), key, "left").join(modal(ev, key, "destination_ip", "_a"), key, "left")
        .join(fleet.protocol_counts(ev, key), key, "left")
        .select(
            *key, F.coalesce("_n", "honeypot_id").alias("name"), F.coalesce("_a", F.lit("unknown")).alias("address"),
            F.coalesce(fleet.describe_type(F.col("protocol_counts")), F.lit("unknown")).alias("type"),
            F.map_from_entries(F.transform("protocol_counts", lambda x: F.struct(x["protocol"], x["n"]))).alias("protocols"),
            "first_seen", "last_seen",
        )
    )


def describe_os(sensors: DataFrame, dp: DataFrame, distros: DataFrame, runs: DataFrame, claims: DataFrame) -> DataFrame:
    """Active persona's distribution, else the first readable `os.identity` claim of the latest
    completed run since the setup in force, else unknown. `claims` is V3's output."""
    active = dp.groupBy("honeypot_id").agg(F.max(F.struct("deployed_at", "deployment_id", "persona")).alias("_d"))
    base = sensors.select("honeypot_id").distinct().join(active, "honeypot_id", "left").join(
        distros.select(F.col("persona").alias("_persona"), "pretty_name"), F.col("_d.persona") == F.col("_persona"), "left"
    )
    done = runs.filter("status = 'completed'").join(active, "honeypot_id", "left").filter(
        F.col("_d").isNull() | (F.col("started_at") >= F.col("_d.deployed_at"))
    )
    latest = done.groupBy("honeypot_id").agg(F.max(F.struct("started_at", "run_id")).alias("_r"))
    claim = (
        claims.filter("establishes = 'os.identity' AND fact_status = 'observed' AND claim IS NOT NULL AND claim <> ''")
        .join(latest.select("honeypot_id", F.col("_r.run_id").alias("run_id")), "run_id")
        .groupBy("honeypot_id").agg(F.min_by("claim", "probe_id").alias("_claim"))
    )
    set_up = F.col("_d.persona").isNotNull() & (F.col("_d.persona") != PRE_PERSONA)
    value = F.col("_claim")
    capital = F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.expr("substring(_claim, 2)")))
    return base.join(claim, "honeypot_id", "left").select(
        "honeypot_id",
        F.when(set_up, F.coalesce("pretty_name", F.col("_d.persona"))).when(value.isNotNull(), capital).otherwise("unknown").alias("os"),
        F.when(set_up, "persona").when(value.isNotNull(), "evaluation").otherwise("unknown").alias("os_source"),
    )


def _traffic(rows: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Events, distinct sessions and distinct sources per key. Events are first combined to (key, session, source),
    map-side and to about one row per session; only those rows are counted apart."""
    if not exact:
        distinct = lambda c: F.approx_count_distinct(c, 0.01)
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), distinct("session_id").alias("sessions"), distinct("source_ip").alias("sources"))
    met = rows.groupBy(*keys, "session_id", "source_ip").agg(F.count(F.lit(1)).alias("_n"))
    return met.groupBy(*keys).agg(F.sum("_n").alias("events"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("source_ip").alias("sources"))


def traffic_by_day(ev: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """P5: UTC days of the whole window per sensor, zero-filled."""
    rows = ev.filter(F.col("ts").between(lit_ts(start), lit_ts(end)))
    counted = _traffic(rows.withColumn("day", F.date_trunc("day", "ts")), ["honeypot_id", "day"])
    days = F.sequence(F.date_trunc("day", lit_ts(start)), F.date_trunc("day", lit_ts(end)), F.expr("INTERVAL 1 DAY"))
    axis = ev.select("honeypot_id").distinct().select("honeypot_id", F.explode(days).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return axis.join(counted, ["honeypot_id", "day"], "left").select("honeypot_id", "day", zero("events"), zero("sessions"), zero("sources"))


def top_sources(ev: DataFrame, start: datetime, end: datetime, k: int = 10) -> DataFrame:
    """The busiest addresses of each sensor, with their modal country."""
    rows = ev.filter(F.col("ts").between(lit_ts(start), lit_ts(end)) & F.col("source_ip").isNotNull())
    key = ["honeypot_id", "source_ip"]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("events"))
    top = top_per_group(counted, ["honeypot_id"], [F.desc("events"), F.asc("source_ip")], k, rank="rank")
    countries = modal(rows.join(top.select(*key), key, "left_semi"), key, "source_country", "country")
    return top.join(countries, key, "left").select("honeypot_id", "rank", F.col("source_ip").alias("ip"), "country", "events")


def protocol_split(ev: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Protocol counts of each sensor as a map."""
    rows = ev.filter(F.col("ts").between(lit_ts(start), lit_ts(end)))
    return fleet.protocol_counts(rows, ["honeypot_id"]).select(
        "honeypot_id", F.map_from_entries(F.transform("protocol_counts", lambda x: F.struct(x["protocol"], x["n"]))).alias("protocols")
    )


def traffic_by_period(ev: DataFrame, spans: DataFrame, exact: bool = True) -> DataFrame:
    """Events, distinct sessions and sources per period, and their rates per day."""
    rows = ev.select("honeypot_id", "ts", "session_id", "source_ip")
    key = ["honeypot_id", "start", "end"]
    counted = _traffic(interval_join(rows, spans.select(*key), ["honeypot_id"], "ts"), key, exact)
    days = F.greatest((F.unix_micros("end") - F.unix_micros("start")) / F.lit(86_400_000_000), F.lit(1 / 24))
    out = spans.join(counted, key, "left")
    for c in ("events", "sessions", "sources"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0))).withColumn(f"{c}_per_day", F.col(c) / days)
    return out


def sensor_techniques(ev: DataFrame, spans: DataFrame, rules: DataFrame, start: datetime, end: datetime, max_length: int | None = None) -> DataFrame:
    """Techniques of each sensor's commands, counted over events and per period.

    Commands are first counted per (sensor, command, period); the rulebook then runs once per
    distinct command text and its hits join the counts, never the events.
    """
    rows = ev.filter(
        (F.col("action") == COMMAND) & F.col("command_line").isNotNull() & text.up_to("command_line", max_length)
        & F.col("ts").between(lit_ts(start), lit_ts(end))
    ).select("honeypot_id", "ts", "session_id", "command_line")
    hits = command_hits(rows)
    key = ["honeypot_id", "technique_id"]
    totals = (
        rows.groupBy("honeypot_id", "command_line").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
        .join(hits, "command_line").groupBy(*key)
        .agg(F.sum("n").alias("events"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    )
    sess = (
        rows.select("honeypot_id", "command_line", "session_id").distinct().join(hits, "command_line")
        .select(*key, "session_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("sessions"))
    )
    in_period = (
        interval_join(rows.select("honeypot_id", "ts", "command_line"), spans.select("honeypot_id", "start", "end"), ["honeypot_id"], "ts")
        .groupBy("honeypot_id", "command_line", "start").agg(F.count(F.lit(1)).alias("n"))
        .join(hits, "command_line").groupBy(*key, "start").agg(F.sum("n").alias("n"))
    )
    # A sensor's periods are few: one short array per technique.
    grid = totals.select(*key).join(spans.select("honeypot_id", "start"), "honeypot_id").join(in_period, [*key, "start"], "left")
    arrays = grid.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("start", F.coalesce("n", F.lit(0)).alias("n")))).alias("_p")
    )
    return (
        totals.join(sess, key).join(arrays, key, "left").join(rules.select("technique_id", "name", "tactic"), "technique_id")
        .select(*key, "name", "tactic", "events", "sessions", "first_seen", "last_seen", F.col("_p.n").alias("per_period"))
    )


def schedule_slots(spark: SparkSession, sensor: str, start: datetime, block_days: int, arms: list[str]) -> DataFrame:
    """The slots of a rotation schedule."""
    if block_days < 1 or not arms:
        raise ValueError("a schedule needs at least one arm and one day per block")
    rows = [(sensor, i, arm, start + timedelta(days=i * block_days), start + timedelta(days=(i + 1) * block_days)) for i, arm in enumerate(arms)]
    return spark.createDataFrame(
        [(s, i, a, b.isoformat(sep=" "), e.isoformat(sep=" ")) for s, i, a, b, e in rows],
        "honeypot_id string, slot int, arm string, start string, end string",
    ).withColumn("start", F.col("start").cast("timestamp")).withColumn("end", F.col("end").cast("timestamp"))


def due(slots: DataFrame, points: DataFrame, t: str = "t") -> DataFrame:
    """The slot scheduled at each point; null before the start and from the end on."""
    return interval_join(points, slots, ["honeypot_id"], t, how="left")


def persona_of(arm: Column) -> Column:
    return F.when(arm == STOCK, PRE_PERSONA).otherwise(arm)


def in_place(due_points: DataFrame, dp: DataFrame, t: str = "t") -> DataFrame:
    """Whether the deployment in force was made inside the slot and runs its arm."""
    placed = active_deployment(due_points, dp, t)
    ok = F.col("deployed_at").isNotNull() & (F.col("deployed_at") >= F.col("start")) & (F.col("persona") == persona_of(F.col("arm")))
    return placed.withColumn("in_place", F.when(F.col("slot").isNotNull(), F.coalesce(ok, F.lit(False))))
