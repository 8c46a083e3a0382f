"""Links inside families of similar sets, block against block.

A family is cut into blocks of bounded size. A block pair is one unit of work: its members are tested against each other
by a cheap bound on vectors, those that pass on their full sets, and only links that join two parts are given back, so
a pair of blocks of k members yields k - 1 rows at most, however many pairs of members it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.functions.ordered import number_rows

#: A block holds 2^BITS elements of sets, or one set if that is larger, and 2^(BITS - LEAST) sets at most.
BITS, LEAST = 16, 8
#: Blocks of a node.
FANOUT = 64
#: (vector, vectors, size, sizes) -> which of the vectors' sets may be linked with the vector's.
Test = Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]


def cut(members: DataFrame, order: list[str]) -> DataFrame:
    """members (family, label, id, k1, n, ...) with `block`: members of one family, of like size, near each other by label and
    `order`; and `node`: FANOUT such blocks in a row."""
    sized = members.withColumn("_size", F.greatest(F.lit(LEAST), F.least(F.lit(BITS), F.floor(F.log2("n")))).cast("int"))
    placed = number_rows(sized, ["family"], "label", ["_size", *order, "id", "k1"])
    part = lambda blocks: F.expr(f"pos div ({blocks} * shiftleft(1L, {BITS} - _size))")
    return placed.withColumn("block", F.xxhash64("family", "_size", part(1))).withColumn("node", F.xxhash64("family", "_size", part(FANOUT))).drop("_size", "pos")


def descend(blocks: DataFrame, nodes: DataFrame, may_meet: Column) -> DataFrame:
    """(a, b): block pairs of a family that may hold links, found by descending from node pairs. may_meet tells it of two
    rows, aliased a and b, of blocks as of nodes; both relations carry family and node."""
    met = nodes.alias("a").join(nodes.alias("b"), "family").where("a.node <= b.node").where(may_meet)
    met = met.select(F.col("a.node").alias("na"), F.col("b.node").alias("nb"))
    below = blocks.alias("a").join(met, F.col("a.node") == F.col("na")).join(blocks.alias("b"), F.col("b.node") == F.col("nb"))
    ordered = (F.col("na") != F.col("nb")) | (F.col("a.block") <= F.col("b.block"))
    return below.where(ordered & may_meet).select(F.least("a.block", "b.block").alias("a"), F.greatest("a.block", "b.block").alias("b")).distinct()


def fits(percent: int) -> Column:
    """Whether sizes of boxes a and b allow a link that joins two labels."""
    sizes = (F.col("a.n_hi") * 100 >= F.col("b.n_lo") * percent) & (F.col("b.n_hi") * 100 >= F.col("a.n_lo") * percent)
    return sizes & (F.least("a.l_lo", "b.l_lo") != F.greatest("a.l_hi", "b.l_hi"))


def ranges(rows: DataFrame, by: str, *more: Column) -> DataFrame:
    """(family, `by`, smallest and largest size and label, ...) of each block or node."""
    edges = (F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"), F.min("l_lo").alias("l_lo"), F.max("l_hi").alias("l_hi"))
    return rows.groupBy("family", by).agg(*edges, *more)


def single(members: DataFrame, *more: str) -> DataFrame:
    """Members as ranges of one."""
    return members.select("family", "block", "node", F.col("n").alias("n_lo"), F.col("n").alias("n_hi"), F.col("label").alias("l_lo"), F.col("label").alias("l_hi"), *more)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted arrays of distinct numbers share."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _linked(side, ids, sizes, labels, vectors, sets, test: Test, percent: int) -> list[tuple[int, int]]:
    """Links between parts: members of one block with each other, or of the first side with the second."""
    at = list(range(len(ids)))

    def root(i: int) -> int:
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    first: dict[int, int] = {}
    for i, label in enumerate(labels):
        at[i] = root(first.setdefault(label, i))
    out, two = [], 1 in side
    start = side.index(1) if two else 0
    for i in range(start if two else len(ids)):
        others = np.arange(start if two else i + 1, len(ids))
        if not len(others):
            continue
        n, m = sizes[i], sizes[others]
        fit = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & test(vectors[i], vectors[others], n, m)
        for j in others[fit]:
            if root(i) != root(j):
                both = common(sets[i], sets[j])
                if both * 100 >= (n + sizes[j] - both) * percent:
                    at[root(j)] = root(i)
                    out.append((ids[i], ids[j]))
    return out


def block_links(pairs: DataFrame, placed: DataFrame, full: DataFrame, test: Test, percent: int) -> DataFrame:
    """(u, v): links that join parts, from block pairs (a, b), members (block, id, k1, label), and (id, k1, n, vec, s)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: list) -> pd.DataFrame:
            side, ids, sizes, labels, vectors, sets = (list(c) for c in zip(*rows, strict=True))
            made = _linked(side, ids, np.array(sizes, np.int64), labels, np.stack(vectors), sets, test, percent)
            return pd.DataFrame(made, columns=["u", "v"])

        key, rows = None, []
        for pdf in batches:
            for a, b, *row in pdf.itertuples(index=False, name=None):
                if rows and (a, b) != key:
                    yield done(rows)
                    rows = []
                key = (a, b)
                rows.append(row)
        if rows:
            yield done(rows)

    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block"))))
    sides = pairs.select("a", "b", F.inline(both))
    rows = sides.join(placed.select("block", "id", "k1", "label"), "block").join(full.select("id", "k1", "n", "vec", "s"), ["id", "k1"])
    sent = rows.select("a", "b", "side", "id", "n", "label", "vec", "s").repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return sent.mapInPandas(run, "u long, v long")
