"""Nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is indexed under its leaf. A query walks the tree with a
priority queue, always opening the most promising branch, and so orders the leaves. How many leaves a query
visits is not guessed: on sampled queries the visits are widened until recall against brute force reaches the
goal. Rows and visits meet by slice: slices are bounded in rows, and a leaf that a hot vector fills is cut into
many. Each slice scores a block of queries at once and keeps their best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureframe.llm.store import save

SAMPLE = 20_000  # rows the tree is fitted on, at most
BRANCH = 8
LEAF_ROWS = 100  # sampled rows of a leaf, about
PROBES = 256  # queries and
PROBE_ROWS = 20_000  # rows that calibration compares, at most
RECALL = 0.97
SLICE_ROWS = 4_000
BLOCK = 512  # queries scored at once
NEAREST = 20


@dataclass
class Tree:
    """Inner nodes list their children; centre and radius bound what a node holds."""

    centre: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray  # leaf number of a node, -1 for inner ones

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every node the child with the nearest centre."""
        out = np.full(len(x), -1, np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centre[kids]
            pick = np.argmin((c * c).sum(1) - 2 * x[at] @ c.T, axis=1)
            stack += [(int(kid), at[pick == i]) for i, kid in enumerate(kids)]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves of a best-bin-first walk: the branch with the largest product is opened next."""
        products = self.centre @ q
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                kids = self.children[node]
                best = max(kids, key=lambda k: products[k])
                for k in kids:
                    if k != best:
                        heapq.heappush(queue, (-products[k], k))
                node = best
            found.append(int(self.leaf[node]))
        return found


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for i in range(k):
            if (own == i).any():
                c[i] = x[own == i].mean(0)
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def fit_tree(x: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS) -> Tree:
    rng = np.random.default_rng(20)
    centre, children, leaf, leaves = [x.mean(0)], [[]], [-1], 0
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        own = _kmeans(x[at], branch, rng) if len(at) > max(leaf_rows, branch) else None
        if own is None or len(np.unique(own)) < 2:  # small, or all alike
            leaf[node], leaves = leaves, leaves + 1
            continue
        for i in np.unique(own):
            kid = len(centre)
            centre.append(x[at[own == i]].mean(0)), children.append([]), leaf.append(-1)
            children[node].append(kid)
            stack.append((kid, at[own == i]))
    return Tree(np.array(centre), children, np.array(leaf))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id, v (array<double>). Null, zero and not finite vectors don't, nor rows without id."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def calibrate(tree: Tree, rows: np.ndarray, probes: np.ndarray, ids: np.ndarray, nearest: int, recall: float) -> int:
    """Leaves to visit: the least number by which the probes find `recall` of their true nearest among rows."""
    leaf = tree.assign(rows)
    leaves = int(tree.leaf.max()) + 1
    hits = np.zeros(leaves)
    total = 0
    for q, own in zip(probes, ids, strict=True):
        score = rows @ q
        score[own] = -np.inf
        k = min(nearest, len(rows) - 1)
        if k < 1:
            continue
        turn = np.empty(leaves, np.int64)
        turn[tree.visit(q, leaves)] = np.arange(leaves)
        np.add.at(hits, turn[leaf[np.argpartition(-score, k - 1)[:k]]], 1)
        total += k
    if not total:
        return leaves
    return min(leaves, int(np.searchsorted(np.cumsum(hits) / total, recall)) + 1)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its nearest other rows of `vectors`.

    Both have vec_id and embedding. Score is the inner product in double precision; ties go to the smaller
    vec_id; a query's own vec_id is left out. Fewer candidates give fewer rows, none give none. Vectors of
    another length than the sample's most common one take no part. Repeated rows of a vec_id count once.
    """
    spark = vectors.sparkSession
    rows = save(usable(vectors), "vectors")
    # A bounded sample, spread by hash: at most `sample` vectors reach the driver.
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(drawn):
        return empty
    size = int(drawn["v"].map(len).mode().iloc[0])
    drawn = drawn[drawn["v"].map(len) == size]
    x, ids = _matrix(drawn["v"]), drawn["id"].to_numpy()
    tree = fit_tree(x)
    asked = usable(queries).where(F.size("v") == size).dropDuplicates(["id"])
    probes = asked.orderBy(F.xxhash64("id"), "id").limit(PROBES).toPandas()
    if not len(probes):
        return empty
    place = {int(i): n for n, i in enumerate(ids[:PROBE_ROWS])}
    own = [np.array([place[int(i)]] if int(i) in place else [], np.int64) for i in probes["id"]]
    visits = calibrate(tree, x[:PROBE_ROWS], _matrix(probes["v"]), own, nearest, recall)
    known = spark.sparkContext.broadcast(tree)  # at most 2 * sample centres

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=known.value.assign(_matrix(pdf["v"]))) if len(pdf) else pdf.assign(leaf=np.zeros(0, np.int32))

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=[np.array(known.value.visit(q, visits), np.int32) for q in _matrix(pdf["v"])])

    indexed = save(rows.where(F.size("v") == size).dropDuplicates(["id"]).mapInPandas(to_leaf, "id long, v array<double>, leaf int"), "indexed")
    # Slices: neighbouring leaves share one until it is full; a full leaf is cut by hash.
    counts = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).orderBy("leaf").collect()  # one row per leaf: bounded by the sample
    first, cuts, at, filled = {}, {}, 0, 0
    for r in counts:
        if filled and filled + r["n"] > SLICE_ROWS:
            at, filled = at + 1, 0
        first[r["leaf"]], cuts[r["leaf"]] = at, max(1, -(-r["n"] // SLICE_ROWS))
        at, filled = (at + cuts[r["leaf"]], 0) if cuts[r["leaf"]] > 1 else (at, filled + r["n"])
    layout = spark.createDataFrame([(k, first[k], cuts[k]) for k in first], "leaf int, first int, cuts int")
    held = indexed.join(F.broadcast(layout), "leaf").withColumn("slice", F.col("first") + F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    held = held.select("slice", "leaf", "id", "v")
    seen = asked.mapInPandas(to_visits, "id long, v array<double>, leaf array<int>").withColumn("leaf", F.explode("leaf"))
    seen = seen.join(F.broadcast(layout), "leaf").withColumn("slice", F.explode(F.sequence("first", F.col("first") + F.col("cuts") - 1)))
    seen = seen.groupBy("slice", "id").agg(F.first("v").alias("v"), F.collect_set("leaf").alias("leaves"))
    # A block of queries meets a slice in one task; hot slices have many blocks and meet them in many tasks.
    blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // (8 * BLOCK))))).cast("int")
    n_blocks = max(1, -(-asked.count() // (8 * BLOCK)))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    seen = seen.withColumn("block", blocks)

    def score(key, some: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(asks):
            some = some.sort_values("id", kind="stable")
            m, mid, mleaf = _matrix(some["v"]), some["id"].to_numpy(), some["leaf"].to_numpy()
            for at in range(0, len(asks), BLOCK):
                part = asks.iloc[at : at + BLOCK]
                q = _matrix(part["v"])
                s = q @ m.T
                for i, (qid, leaves) in enumerate(zip(part["id"], part["leaves"], strict=True)):
                    cand = np.flatnonzero(np.isin(mleaf, leaves) & (mid != qid))
                    if not len(cand):
                        continue
                    if len(cand) > 2 * nearest:
                        edge = np.partition(s[i, cand], -nearest)[-nearest]
                        sure = cand[s[i, cand] > edge + 1e-9 * max(1.0, abs(edge))]
                        tied = cand[np.abs(s[i, cand] - edge) <= 1e-9 * max(1.0, abs(edge))]
                        cand = np.concatenate([sure, tied[:nearest]]) if len(tied) > nearest else np.concatenate([sure, tied])
                    exact = (m[cand] * q[i]).sum(axis=1)  # row by row, so that equal vectors score alike everywhere
                    best = np.lexsort((mid[cand], -exact))[:nearest]
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": mid[cand][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = held.groupBy("slice", "block").cogroup(seen.groupBy("slice", "block")).applyInPandas(score, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
