import numpy as np
import pytest
from pyspark.sql import functions as F

from lureframe.llm import neighbours as N


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4)


def brute(rows, asked, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in asked:
        if q in good:
            found = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def nested(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_exact_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).astype(float).tolist(), 1) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.0, 1.0, 0.5], 1) for i in range(40)]
    rows += [(200, None, 1), (201, [0.0] * 5, 1), (202, [1.0, None, 1.0, 1.0, 1.0], 1), (203, [float("nan")] * 5, 1), (204, [float("inf")] * 5, 1), (None, [1.0] * 5, 1), (205, [], 1), (100, [1.0, 2.0, 0.0, 1.0, 0.5], 1)]
    df = table(spark, rows)
    got = nested(N.nearest_neighbours(df, df.where("vec_id % 20 = 0 OR vec_id > 199"), nearest=7, recall=1.0))
    want = brute(dict.fromkeys(map(lambda r: (r[0], tuple(r[1] or ()), 1), rows)), [0, 20, 40, 100, 120], 7)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in got:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_recall_on_clusters_and_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 5000)] + 0.3 * rng.normal(size=(5000, 16)), np.tile(centres[:1] * 2, (2500, 1))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))]
    df = table(spark, rows)
    got = nested(N.nearest_neighbours(df, df.where("vec_id % 50 = 0"), nearest=10))
    want = brute(rows, range(0, 7500, 50), 10)
    assert all(len(v) == 10 for v in got.values()) and got.keys() == want.keys()
    # Tied hot vectors count by score.
    hits = sum(s >= want[q][-1][1] - 1e-9 for q, v in got.items() for _, s in v)
    assert hits / (10 * len(want)) >= 0.9


def test_few_rows(spark):
    df = table(spark, [(1, [1.0, 0.0], 1)])
    assert N.nearest_neighbours(df, df).count() == 0
    none = df.limit(0)
    assert N.nearest_neighbours(none, none).count() == 0 and N.nearest_neighbours(df, none).count() == 0
    two = table(spark, [(1, [1.0, 0.0], 1), (2, [0.5, 1.0], 1)])
    assert nested(N.nearest_neighbours(two, two.where(F.col("vec_id") == 1))) == {1: [(2, 0.5)]}


def test_best_bin_first_orders_all_leaves():
    tree = N.fit_tree(np.random.default_rng(0).normal(size=(3000, 8)))
    leaves = int(tree.leaf.max()) + 1
    walk = tree.visit(np.ones(8), leaves)
    assert sorted(walk) == list(range(leaves)) and tree.visit(np.ones(8), 3) == walk[:3]
