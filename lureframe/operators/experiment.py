"""Rotation experiment: session facts, block metrics, permutation tests, report."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.functions.ordered import exact_median, interval_join
from lureframe.operators.campaigns import fingerprints
from lureframe.operators.fleet import lit_ts
from lureframe.operators.periods import PRE_PERSONA, STOCK, periods
from lureframe.operators.rules import command_hits
from lureframe.operators.sessions import COMMAND

# --- fixed values -------------------------------------------------------------------------------
LOGIN = "cowrie.login.success"
DOWNLOADS = ("cowrie.session.file_download", "cowrie.session.file_download.failed")
ACTIONS = ("cowrie.session.connect", LOGIN, COMMAND, *DOWNLOADS, "cowrie.session.closed")
PRIMARY = ("ran_any_share", "commands_mean", "download_share")
SCRIPT_PRIMARY = ("commands_mean", "download_share")
CUT_MARGIN_SECONDS = 120
EXHAUSTIVE_LIMIT, SAMPLES = 500_000, 100_000
MIN_HOURS = 24
# --- end of fixed values ------------------------------------------------------------------------


def _in(ev: DataFrame, start: datetime, end: datetime, sensor: str | None) -> DataFrame:
    rows = ev.filter((F.col("ts") >= lit_ts(start)) & (F.col("ts") < lit_ts(end)))
    return rows if sensor is None else rows.filter(F.col("honeypot_id") == sensor)


def session_stats(ev: DataFrame, start: datetime, end: datetime, sensor: str | None = None) -> DataFrame:
    """Per sensor and session its span, login, command and download counts and script.

    The ordered commands themselves are folded into the script fingerprint; they are never held as
    one list.
    """
    rows = _in(ev, start, end, sensor).filter(F.col("action").isin(*ACTIONS))
    ran = (F.col("action") == COMMAND) & F.col("command_line").isNotNull() & (F.col("command_line") != "")
    facts = rows.groupBy("session_id").agg(
        F.min(F.struct("ts", "event_id", "honeypot_id")).alias("_f"), F.max("ts").alias("last"),
        F.bool_or(F.col("action") == LOGIN).alias("logged_in"), F.count_if(ran).alias("commands"),
        F.count_if(F.col("action").isin(*DOWNLOADS)).alias("downloads"),
    )
    cmds = rows.filter(ran).select("session_id", "event_id", "ts", "source_ip", "honeypot_id", "command_line")
    scripts = fingerprints(cmds).select("session_id", F.col("fingerprint").alias("script"))
    return facts.join(scripts, "session_id", "left").select(
        F.col("_f.honeypot_id").alias("honeypot_id"), "session_id", F.col("_f.ts").alias("first"), "last", "logged_in", "commands",
        "downloads", ((F.unix_micros("last") - F.unix_micros("_f.ts")) / 1e6).alias("duration_s"), "script",
    )


def blocks_as_run(dp: DataFrame, spans: DataFrame) -> DataFrame:
    """The window cut at deployments, each block labelled with its arm."""
    opened = dp.select("honeypot_id", F.col("deployed_at").alias("start"), F.lit(True).alias("opened_by_deployment")).distinct()
    cut = periods(dp, None, spans).select("honeypot_id", "start", "end", "persona")
    arm = F.when(F.col("persona") == PRE_PERSONA, STOCK).otherwise(F.col("persona"))
    w = Window.partitionBy("honeypot_id").orderBy("start")  # a schedule's blocks
    return cut.join(opened, ["honeypot_id", "start"], "left").select(
        "honeypot_id", (F.row_number().over(w) - 1).alias("block"), "start", "end", arm.alias("arm"),
        F.coalesce("opened_by_deployment", F.lit(False)).alias("opened_by_deployment"),
    )


def hour_coverage(ev: DataFrame, blocks: DataFrame) -> DataFrame:
    """UTC hours with an event against the hours each block overlaps."""
    key = ["honeypot_id", "start", "end"]
    hours = interval_join(ev.select("honeypot_id", "ts"), blocks.select(*key), ["honeypot_id"], "ts").select(
        *key, F.date_trunc("hour", "ts").alias("h")
    ).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("covered"))
    total = F.ceil((F.unix_micros("end") - F.unix_micros(F.date_trunc("hour", "start"))) / F.lit(3_600_000_000)).cast("long")
    return blocks.join(hours, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn("total", total)


def assign_to_blocks(stats: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each session in the block of its first event: analysed, cut by the switch, or never
    logged in. Sessions outside every block are dropped."""
    placed = interval_join(stats, blocks, ["honeypot_id"], "first")
    late = F.unix_micros("last") >= F.unix_micros("end") - CUT_MARGIN_SECONDS * 1_000_000
    return placed.withColumn(
        "fate", F.when(~F.col("logged_in"), "not_logged_in").when(late, "cut").otherwise("analysed")
    )


def tallies(assigned: DataFrame, blocks: DataFrame) -> DataFrame:
    key = ["honeypot_id", "block"]
    n = lambda f: F.count_if(F.col("fate") == f).alias(f)
    counted = assigned.groupBy(*key).agg(n("analysed"), n("cut"), n("not_logged_in"))
    return blocks.join(counted, key, "left").fillna(0, ["analysed", "cut", "not_logged_in"])


def _long(df: DataFrame, keys: list[str], view: str, metrics: list[str]) -> DataFrame:
    stack = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    return df.select(*keys, F.lit(view).alias("view"), F.expr(f"stack({len(metrics)}, {stack}) AS (metric, value)"))


def block_metrics(assigned: DataFrame) -> DataFrame:
    """(honeypot_id, block, view, metric, value), one vote per session and one per script."""
    key = ["honeypot_id", "block"]
    rows = assigned.filter("fate = 'analysed'").select(
        *key, "script", "duration_s", F.col("commands").cast("double").alias("commands"),
        (F.col("commands") > 0).cast("double").alias("ran"), (F.col("downloads") > 0).cast("double").alias("loaded"),
    )
    per_session = rows.groupBy(*key).agg(
        F.avg("ran").alias("ran_any_share"), F.avg("commands").alias("commands_mean"), F.avg("loaded").alias("download_share")
    ).join(exact_median(rows, key, "duration_s", "duration_median_s"), key)
    # Sessions without commands share the null script and are one group.
    scripts = rows.groupBy(*key, "script").agg(
        F.avg("commands").alias("c"), F.avg("loaded").alias("l"), F.avg("duration_s").alias("duration_s")
    )
    per_script = scripts.groupBy(*key).agg(
        F.avg("c").alias("commands_mean"), F.avg("l").alias("download_share"), F.count("script").alias("scripts")
    ).join(exact_median(scripts, key, "duration_s", "duration_median_s"), key)
    return _long(per_session, key, "session", [*PRIMARY, "duration_median_s"]).unionByName(
        _long(per_script, key, "script", [*SCRIPT_PRIMARY, "duration_median_s", "scripts"])
    )


def technique_mix(assigned: DataFrame, ev: DataFrame, by: list[str]) -> DataFrame:
    """Share of analysed sessions that showed each technique."""
    mine = assigned.filter("fate = 'analysed'").select("session_id", *by)
    totals = mine.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    cmds = ev.filter((F.col("action") == COMMAND) & F.col("command_line").isNotNull()).select("session_id", "command_line").distinct()
    hits = command_hits(cmds)
    seen = cmds.join(hits, "command_line").select("session_id", "technique_id").distinct().join(mine, "session_id")
    return seen.groupBy(*by, "technique_id").agg(F.count(F.lit(1)).alias("_k")).join(totals, by).select(
        *by, "technique_id", (F.col("_k") / F.col("_n")).alias("share")
    )


def arch_mix(assigned: DataFrame, ev: DataFrame, by: list[str]) -> DataFrame:
    """Share of download attempts per architecture named in the URL."""
    mine = assigned.filter("fate = 'analysed'").select("session_id", *by)
    arch = F.when(F.coalesce("file_url", F.lit("")) == "", "none").otherwise(text.url_arch("file_url"))
    loads = ev.filter(F.col("action").isin(*DOWNLOADS)).select("session_id", arch.alias("arch")).join(mine, "session_id")
    counted = loads.groupBy(*by, "arch").agg(F.count(F.lit(1)).alias("_k"))
    totals = counted.groupBy(*by).agg(F.sum("_k").alias("_n"))
    return counted.join(totals, by).select(*by, "arch", (F.col("_k") / F.col("_n")).alias("share"))


def block_exclusion(tallied: DataFrame, arms: list[str]) -> DataFrame:
    """The first reason that leaves a block out, or null."""
    hours = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(3_600_000_000)
    reason = (
        F.when(~F.col("opened_by_deployment"), "no_deployment").when(F.col("arm").isNull() | ~F.col("arm").isin(*arms), "unknown_arm")
        .when(hours < MIN_HOURS, "too_short").when(F.col("covered") * 2 < F.col("total"), "low_coverage")
        .when(F.col("analysed") == 0, "no_session")
    )
    return tallied.withColumn("excluded", reason)


# --- X9: the only numpy here. Spark partitions the relabellings; a task scores one range of them. ---
def _spread(values: np.ndarray, labels: np.ndarray, arms: int) -> np.ndarray:
    """Between-arm sum of squares of every row of labels."""
    overall = values.mean()
    out = np.zeros(labels.shape[0])
    for a in range(arms):
        mine = labels == a
        n = mine.sum(axis=1)
        out += n * (np.where(mine, values, 0.0).sum(axis=1) / n - overall) ** 2
    return out


def _relabelings(sizes: list[int]) -> int:
    total = math.factorial(sum(sizes))
    for n in sizes:
        total //= math.factorial(n)
    return total


def _unrank(start: int, stop: int, sizes: list[int]) -> np.ndarray:
    """Labellings number start..stop-1 in lexicographic order."""
    index = np.arange(start, stop, dtype=np.int64)
    left = np.tile(np.array(sizes, dtype=np.int64), (len(index), 1))
    ways = np.full(len(index), _relabelings(sizes), dtype=np.int64)
    labels = np.empty((len(index), sum(sizes)), dtype=np.int8)
    for place in range(sum(sizes)):
        with_label = ways[:, None] * left // (sum(sizes) - place)
        upto = np.cumsum(with_label, axis=1)
        chosen = (index[:, None] >= upto).sum(axis=1)
        row = np.arange(len(index))
        index = index - (upto[row, chosen] - with_label[row, chosen])
        ways = with_label[row, chosen]
        left[row, chosen] -= 1
        labels[:, place] = chosen
    return labels


def _shuffled(start: int, stop: int, places: int, seed: int) -> np.ndarray:
    """Shuffles number start..stop-1: places in the order of the MD5 of seed, shuffle and place, so any engine can repeat them."""
    order = np.empty((stop - start, places), np.int64)
    for n in range(start, stop):
        order[n - start] = sorted(range(places), key=lambda at: hashlib.md5(f"{seed}:{n}:{at}".encode()).hexdigest())
    return order


def permutation(block_values: DataFrame, keys: list[str], limit: int = EXHAUSTIVE_LIMIT, samples: int = SAMPLES, seed: int = 0, step: int = 20_000) -> DataFrame:
    """P-value of the between-arm spread for each group of (block, arm, value) rows.

    Every relabelling is tried when there are at most `limit`; otherwise shuffles that a counter decides. A group
    becomes ranges of relabellings, the ranges are spread over the cluster, and hits are summed. Where all arms
    are of one size, their names can be swapped freely, so only relabellings that give the first block the first arm are scored.
    """
    groups = block_values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "arm", "value"))).alias("rows"))
    kinds = {f.name: f.dataType.simpleString() for f in block_values.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    plan_ddl = f"{head}, labels array<int>, values array<double>, start bigint, stop bigint, total bigint, scored bigint, exhaustive boolean, smallest_p double, sizes string"

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                rows = row.rows
                arms = sorted({r["arm"] for r in rows})
                labels = [arms.index(r["arm"]) for r in rows]
                sizes = [labels.count(a) for a in range(len(arms))]
                ways = _relabelings(sizes)
                ties = math.prod(math.factorial(n) for n in Counter(sizes).values())
                full = ways <= limit
                total = ways if full else samples
                # In lexicographic order, those with the first arm first come first.
                scored = ways * sizes[0] // len(labels) if full and len(set(sizes)) == 1 else total
                for at in range(0, scored, step):
                    out.append([getattr(row, k) for k in keys] + [labels, [float(r["value"]) for r in rows], at, min(at + step, scored), total, scored, full, ties / ways, str(sizes)])
            yield pd.DataFrame(out, columns=[*keys, "labels", "values", "start", "stop", "total", "scored", "exhaustive", "smallest_p", "sizes"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits, made, known = [], None, None
            batch = batch.sort_values(["sizes", "exhaustive", "start"], kind="stable")
            for row in batch.itertuples(index=False):
                labels, vals = np.asarray(row.labels), np.asarray(row.values, dtype=float)
                arms = int(labels.max()) + 1
                observed = float(_spread(vals, labels[None, :], arms)[0])
                floor = observed - 1e-12 * max(1.0, abs(observed))
                if not row.exhaustive:
                    if known != (len(labels), row.start, row.stop):
                        made, known = _shuffled(row.start, row.stop, len(labels), seed), (len(labels), row.start, row.stop)
                    tried = np.empty_like(made)
                    np.put_along_axis(tried, made, np.broadcast_to(labels, made.shape), axis=1)
                    hits.append(int((_spread(vals, tried, arms) >= floor).sum()))
                    continue
                # Tests with the same arm sizes share their relabellings: unranked once, then one product each.
                if known != (row.sizes, row.start, row.stop):
                    tried = _unrank(row.start, row.stop, [int((labels == a).sum()) for a in range(arms)])
                    made, known = [(tried == a).astype(float) for a in range(arms)], (row.sizes, row.start, row.stop)
                found = sum(n * (mine @ vals / n - vals.mean()) ** 2 for mine, n in ((m, m[0].sum()) for m in made))
                hits.append(int((found >= floor).sum()))
            yield batch[[*keys, "total", "scored", "exhaustive", "smallest_p"]].assign(hits=hits)

    chunks = groups.mapInPandas(plan, plan_ddl)
    # An explicit count keeps AQE from folding these few, heavy rows into one task.
    width = max(block_values.sparkSession.sparkContext.defaultParallelism * 2, 16)
    spread = chunks.repartition(width, "sizes", "start")
    scored = spread.mapInPandas(score, f"{head}, total bigint, scored bigint, exhaustive boolean, smallest_p double, hits bigint")
    p = F.when(F.col("exhaustive"), F.col("_h") / F.col("scored")).otherwise((F.col("_h") + 1) / (F.col("total") + 1))
    return scored.groupBy(*keys, "total", "scored", "exhaustive", "smallest_p").agg(F.sum("hits").alias("_h")).select(
        *keys, p.alias("p"), "exhaustive", "smallest_p", F.col("total").alias("relabelings")
    )


def holm(tests: DataFrame, family: list[str], p: str = "p", tie: str = "metric") -> DataFrame:
    """Step-down adjusted p-values, monotone, at most 1. A family is a handful of metrics."""
    w = Window.partitionBy(*family).orderBy(p, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("_a", raw).withColumn(
        "holm", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).drop("_a")


def tested_values(metrics: DataFrame, judged: DataFrame) -> DataFrame:
    """The block values that enter the tests: included blocks, tested metrics, and only where at
    least two arms have at least two blocks."""
    kept = judged.filter("excluded IS NULL").select("honeypot_id", "block", "arm")
    arms = kept.groupBy("honeypot_id", "arm").agg(F.count(F.lit(1)).alias("n")).groupBy("honeypot_id").agg(F.count_if(F.col("n") >= 2).alias("_ok"))
    able = arms.filter("_ok >= 2").select("honeypot_id")
    tested = (
        ((F.col("view") == "session") & F.col("metric").isin(*PRIMARY)) | ((F.col("view") == "script") & F.col("metric").isin(*SCRIPT_PRIMARY))
    )
    return metrics.filter(tested).join(kept, ["honeypot_id", "block"]).join(able, "honeypot_id", "left_semi")


def arm_summary(metrics: DataFrame, judged: DataFrame) -> DataFrame:
    """X11: each arm's mean [min, max] over its included blocks and its difference to stock."""
    kept = judged.filter("excluded IS NULL").select("honeypot_id", "block", "arm")
    per = metrics.join(kept, ["honeypot_id", "block"]).groupBy("honeypot_id", "view", "metric", "arm").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("blocks")
    )
    stock = per.filter(F.col("arm") == STOCK).select("honeypot_id", "view", "metric", F.col("mean").alias("_s"))
    return per.join(stock, ["honeypot_id", "view", "metric"], "left").withColumn("vs_stock", F.col("mean") - F.col("_s")).drop("_s")


def confounders(ch: DataFrame, spans: DataFrame) -> DataFrame:
    """X11: the recorded changes inside the experiment window."""
    return ch.join(spans.select("honeypot_id", "start", "end"), "honeypot_id").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).drop("start", "end")
