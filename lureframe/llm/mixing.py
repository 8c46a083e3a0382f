"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are uniform, so equal ranges of the key are equal shares of a
source: (source, range) is sorted on its own, totals of the ranges give each range its offset, and no task ever
holds a whole source. The cut falls inside one document of each source, so the words taken equal the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureframe.llm.store import save

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
RANGE_ROWS = 2_000
SEED = 20


def words(text: Column) -> Column:
    """Runs of anything but space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n) with each source's target in words; one row per source.

    Sources in code-point order, null last, take the weights in turn. The budget is `share` of all sizes; a
    target stops at `most` times its source's size, and the rest is shared again by weight. Filling in order of
    cap over weight gives the same end state in one pass: a source is capped if its cap is at most what its
    weight earns after all lower caps are served.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.get(turn, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(most))
    below = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    s = s.withColumn("_all", F.sum("source_size").over(whole) * F.lit(share)).withColumn("_allw", F.sum("_w").over(whole))
    s = s.withColumn("_rate", (F.col("_all") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / (F.col("_allw") - F.coalesce(F.sum("_w").over(below), F.lit(0.0))))
    s = s.withColumn("_capped", F.col("_cap") <= F.col("_rate") * F.col("_w"))
    served = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(whole)
    served_w = F.sum(F.when(F.col("_capped"), F.col("_w")).otherwise(0.0)).over(whole)
    rest = (F.col("_all") - served) / F.nullif(F.col("_allw") - served_w, F.lit(0.0))  # null where all are capped
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * rest)
    return s.select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, text_key, size, source_size, target, taken (words the mix takes, repeats counted).

    A source takes every document target // source_size times and, of one more epoch in key order, words up to
    the target's whole number. Documents without words take nothing. Ties of the key (repeated doc_ids) are cut
    by size and text hash; rows that agree in all of these are alike, so reruns agree. A null source is a source
    of its own. Empty tables give no rows.
    """
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"), key.alias("_key"))
    rows = save(rows, "sizes")  # texts are read and counted once
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sources, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target", "n")
    # A source has ranges of range_rows, or of the root of its rows if that is more: neither the rows of a range nor
    # the ranges of a source then outgrow a task.
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
    ranges = F.ceil(F.col("n") / F.greatest(F.lit(float(range_rows)), F.sqrt("n")))
    unit = F.shiftrightunsigned("_key", 33).cast("double") / F.lit(float(2**31))
    rows = rows.withColumn("_range", F.floor(unit * ranges).cast("long"))
    totals = rows.groupBy(F.col("source").alias("_s"), F.col("_range").alias("_r")).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_s", "_r", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(offsets, rows["source"].eqNullSafe(offsets["_s"]) & (rows["_range"] == offsets["_r"]))
    goal = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = goal - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_in") - F.col("_offset")))
    taken = (epochs * F.col("size") + last).cast("long")
    return rows.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: whole words only are counted, a part of a document's words
    brings the whole document once more. Documents that the mix doesn't take (none of their words) are left out;
    so are documents without words. All columns stay."""
    taken = mix(docs, **options)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    plan = taken.where("taken > 0").groupBy(F.col("doc_id").alias("_llm_id"), F.col("text_key").alias("_llm_text"), F.col("source").alias("_llm_source")).agg(F.sum(copies).alias("_llm_copies"), F.count(F.lit(1)).alias("_llm_rows"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_llm_id")) & docs["source"].eqNullSafe(F.col("_llm_source")) & (F.xxhash64(docs["text"]) == F.col("_llm_text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Rows that repeat id, source and text share their copies: each brings its part, rounded up.
    times = F.sequence(F.lit(1), F.ceil(F.col("_llm_copies") / F.col("_llm_rows")).cast("int"))
    return docs.join(plan, same).withColumn("_llm_time", F.explode(times)).select(*columns)
