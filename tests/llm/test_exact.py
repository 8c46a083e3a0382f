import numpy as np
from pyspark.sql import functions as F

from lureframe.llm import exact_dedup as X


def test_filter_inserts_finds_deletes_and_overflows():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 2**64, 3500, np.uint64), rng.integers(0, 2**64, 20_000, np.uint64)
    f = X.CuckooFilter(1024)
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(others).mean() < 0.01
    for k in keys[:500]:
        f.delete(int(k))
    assert f.contains(keys[500:]).all() and f.contains(keys[:500]).mean() < 0.02
    assert X.CuckooFilter.load(f.dump()).contains(keys[500:]).all()
    assert not X.CuckooFilter(64).insert(keys)


def test_index_updates_in_batches(spark):
    def entries(pairs):
        df = spark.createDataFrame(pairs, "doc_id long, text string")
        return X.combine(X.digests(df), 4)

    first = X.update(None, entries([(5, "a"), (2, "a"), (3, "b"), (9, "c")]))
    more = X.update(first, entries([(1, "b"), (7, "d")]))
    less = X.update(more, entries([(3, "b"), (1, "b"), (9, "c")]), delete=True)
    sha = {t: r[0] for t, r in ((t, spark.sql(f"select sha2('{t}', 256)").first()) for t in "abcd")}
    kept = {r["sha"]: (r["keep_id"], r["rows"]) for r in X.keys(more).collect()}
    assert kept == {sha["a"]: (2, 2), sha["b"]: (1, 2), sha["c"]: (9, 1), sha["d"]: (7, 1)}
    assert {r["sha"] for r in X.keys(less).collect()} == {sha["a"], sha["d"]}
    again = X.update(less, entries([(4, "c")]))
    assert sha["c"] in {r["sha"] for r in X.keys(again).collect()}


def test_a_shard_grows_past_its_filter(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 8000).cast("string").alias("text"))
    got = X.exact_groups(df, shard_rows=10**6)
    assert got.count() == 9000 and got.where("rows = 2").count() == 2000 and got.where("doc_id = keep_id").count() == 8000


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["keep_id"], r["rows"]) for r in X.exact_groups(odd).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 3), (5, 4, 3), (None, None, 1), (6, 6, 1), (7, 7, 1)}
    out = X.drop_copies(odd)
    assert out.columns == odd.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 4, 6, 7]
    assert X.exact_groups(none).count() == 0 and X.drop_copies(none).count() == 0


def test_a_repeated_smallest_row_stays_once(docs):
    assert [r["doc_id"] for r in X.drop_copies(docs([(1, "a b"), (1, "a b"), (2, "a  b")])).collect()] == [1]
