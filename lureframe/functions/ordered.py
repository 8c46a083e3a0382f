"""Ordered and interval primitives that stay parallel when one key holds most of the rows.

A window over a hot key sorts that key in one task. The helpers here first cut the order into intervals
at sampled ranks, do the ordered work inside (key, interval), and stitch the intervals together through a
summary that holds one row per (key, interval). A key that holds a third of all rows is spread over a third
of the intervals, even if all its rows carry one time or none. Joins on time use fixed buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
_NULL_BUCKET = -(2**62)
#: Intervals that an order is cut into: no (key, interval) holds much more than one part in PARTS of all rows.
PARTS = 511
#: Sampled rows per interval.
SAMPLED = 8


def bucket(ts: str | Column, grain_us: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.floor(F.unix_micros(ts) / F.lit(grain_us)), F.lit(_NULL_BUCKET)).cast("long")


def intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int = PARTS) -> DataFrame:
    """df with `_b`, the number of the interval of `order` that a row lies in, from 0 to parts at most.

    The intervals are cut at sampled ranks of the whole table, so each holds about one part in `parts` of
    its rows, whatever their times are and whether they have any. The sample is the rows of smallest hash,
    taken by a bounded top-k, so every reader of the plan sees the same cuts. Text is cut for the sample only.
    """
    kinds = dict(df.dtypes)
    at = lambda c: F.substring(c, 1, 64).alias(c) if kinds[c] == "string" else F.col(c)
    sample = (
        df.select(F.struct(*[at(c) for c in order]).alias("o"), F.xxhash64(*keys, *order).alias("h"))
        .orderBy("h", "o").limit(parts * SAMPLED).agg(F.array_sort(F.collect_list("o")).alias("o"))
    )
    cuts = sample.select(F.filter("o", lambda _, i: i % SAMPLED == SAMPLED - 1)).scalar()
    df = df.withColumn("_cuts", cuts).withColumn("_o", F.struct(*[F.col(c) for c in order])).withColumn("_b", F.lit(0))
    # Binary search for the number of cuts at or before the row; one column per step keeps it in generated code.
    for step in (2**k for k in reversed(range(parts.bit_length()))):
        df = df.withColumn("_b", F.col("_b") + F.when(F.get("_cuts", F.col("_b") + (step - 1)) <= F.col("_o"), step).otherwise(0))
    return df.drop("_cuts", "_o")


def number_rows(df: DataFrame, keys: Sequence[str], ts: str, tie: str | Sequence[str], out: str = "pos", parts: int = PARTS) -> DataFrame:
    """0-based position of every row in its key's (ts, tie) order; nulls come first. A key must not be null."""
    keys, order = list(keys), [ts, *([tie] if isinstance(tie, str) else tie)]
    df = intervals(df, keys, order, parts)
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return (
        df.withColumn("_p", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_b"])
        .withColumn(out, (F.col("_p") + F.col("_off")).cast("long"))
        .drop("_b", "_p", "_off")
    )


def number_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    carry: Sequence[str],
    starts: Callable[[Column, Column], Column],
    out: str = "run",
    parts: int = PARTS,
) -> DataFrame:
    """Gaps and islands: number the runs of each key from 0 in (ts, tie) order.

    `starts(current, previous)` says whether a row opens a new run; both arguments are structs of
    the `carry` columns. A key must not be null.
    """
    keys = list(keys)
    row = F.struct(*carry)
    df = intervals(df, keys, [ts, tie], parts)
    local = Window.partitionBy(*keys, "_b").orderBy(ts, tie)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        df.withColumn("_prev", F.lag(row).over(local))
        .withColumn(
            "_new",
            F.when(F.col("_prev").isNotNull() & starts(row, F.col("_prev")), 1).otherwise(0),
        )
        .withColumn("_local", F.sum("_new").over(running))
        .drop("_prev", "_new")
    )
    order = F.struct(ts, tie)
    edges = numbered.groupBy(*keys, "_b").agg(
        F.min_by(row, order).alias("_first"),
        F.max_by(row, order).alias("_last"),
        F.max("_local").alias("_n"),
    )
    by_key = Window.partitionBy(*keys).orderBy("_b")
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        edges.withColumn("_prev", F.lag("_last").over(by_key))
        .withColumn(
            "_open",
            F.when(F.col("_prev").isNotNull() & starts(F.col("_first"), F.col("_prev")), 1).otherwise(0),
        )
        .select(
            *keys,
            "_b",
            (F.sum("_open").over(upto) + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_off"),
        )
    )
    return (
        numbered.join(offsets, [*keys, "_b"])
        .withColumn(out, (F.col("_local") + F.col("_off")).cast("long"))
        .drop("_b", "_local", "_off")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First `n` rows of each group. The rank filter is pushed below the shuffle by Spark's
    window group limit, so a hot group ships at most `n` rows per input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def modal(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent non-null value per group; ties go to the smaller value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = top_per_group(counts, keys, [F.desc("_n"), F.asc(value)], 1)
    return best.select(*keys, F.col(value).alias(out))


def interval_join(
    rows: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str = "start",
    end: str = "end",
    how: str = "inner",
    grain_us: int = DAY_US,
) -> DataFrame:
    """Rows with every span of the same key that holds `ts` in [start, end).

    Spans are spread over the time buckets they touch, so the join is an equi-join on
    (keys, bucket) and a row meets only the spans of its own bucket.
    """
    spread = spans.filter(F.col(end) > F.col(start)).withColumn(
        "_b",
        F.explode(
            F.sequence(
                bucket(start, grain_us),
                F.floor((F.unix_micros(end) - 1) / F.lit(grain_us)).cast("long"),
            )
        ),
    )
    left = rows.withColumn("_b", bucket(ts, grain_us)).alias("r")
    right = spread.alias("s")
    on = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in [*keys, "_b"]]
    on += [F.col(f"r.{ts}") >= F.col(f"s.{start}"), F.col(f"r.{ts}") < F.col(f"s.{end}")]
    extra = [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    return left.join(right, on, how).select(*[F.col(f"r.{c}") for c in rows.columns], *extra)


def as_of(
    points: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    t: str,
    at: str,
    tie: Sequence[str],
    columns: Sequence[str],
    grain_us: int = DAY_US,
) -> DataFrame:
    """Each point with the latest history row at or before it (null columns when there is none).

    The history becomes validity intervals. Closed intervals meet the points through
    `interval_join`; the one open interval of each key through a plain equi-join.
    """
    # Rows of one instant: only the last in tie order was ever in force.
    latest = Window.partitionBy(*keys, at).orderBy(*[F.desc(c) for c in tie])
    distinct = history.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    until = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    valid = distinct.select(*keys, F.col(at).alias("_from"), until.alias("_until"), F.struct(*columns).alias("_h"))
    closed = valid.filter(F.col("_until").isNotNull()).withColumnRenamed("_h", "_closed")
    open_ = valid.filter(F.col("_until").isNull()).select(
        *keys, F.col("_from").alias("_open_from"), F.col("_h").alias("_open")
    )
    joined = interval_join(points, closed, keys, t, "_from", "_until", how="left", grain_us=grain_us)
    joined = joined.join(open_, list(keys), "left")
    chosen = F.when(F.col(t) >= F.col("_open_from"), F.col("_open")).otherwise(F.col("_closed"))
    return joined.withColumn("_h", chosen).select(*points.columns, *[F.col(f"_h.{c}").alias(c) for c in columns])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group without holding a group in memory.

    Values are counted per unit bin; the bins that hold the middle ranks are found on the bin
    counts, and only the rows of those bins are ordered.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.floor(value).alias("_bin"), F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    by_bin = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_n").over(by_bin), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_lo", F.expr("(_total - 1) div 2"))
        .withColumn("_hi", F.expr("_total div 2"))
        .filter("_below <= _hi AND _below + _n > _lo")
    )
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(bins, [*keys, "_bin"]).withColumn(
        "_at", F.col("_below") + F.coalesce(F.sum("_c").over(in_bin), F.lit(0))
    )
    holds = lambda rank: (F.col("_at") <= F.col(rank)) & (F.col("_at") + F.col("_c") > F.col(rank))
    return placed.groupBy(*keys).agg(
        ((F.sum(F.when(holds("_lo"), F.col("_v"))) + F.sum(F.when(holds("_hi"), F.col("_v")))) / 2).alias(out)
    )
