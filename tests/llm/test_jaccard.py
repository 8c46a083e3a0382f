import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureframe.llm import blocks as B
from lureframe.llm import jaccard_join as J

from .test_near import brute, family


def check(docs, rows, n, percent):
    want, sizes = brute(rows, n, percent)
    got = {r["doc_id"]: r for r in J.jaccard_groups(docs(rows), n, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n"] for i, r in got.items()} == sizes


def mixed(rng, words=120):
    texts = [t for size, edits in ((1, 0), (2, 1), (25, 2), (40, 3), (12, 4), (6, 9), (30, 0)) for t in family(rng, size, edits, words)]
    rng.shuffle(texts)
    return [(7 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [9, 25, 120, 600])
def test_groups_equal_brute_force(docs, words):
    check(docs, mixed(random.Random(words), words), 4, 85)


def test_leaves_and_nodes_of_a_large_family(docs, monkeypatch):
    """Many small leaves: copies near the threshold, of which only some are linked, and chains across leaves."""
    monkeypatch.setattr(B, "BITS", 10)
    monkeypatch.setattr(B, "FANOUT", 4)
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate([*family(rng, 120, 3), *family(rng, 60, 5), *family(rng, 10, 1)])]
    chain = [f"v{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(chain[3 * i : 3 * i + 100])) for i in range(60)]
    check(docs, rows, 4, 85)


def test_shared_passages_chain_strangers_only_by_short_keys(docs, monkeypatch):
    monkeypatch.setattr(J, "LEVELS", ((2, 20), (4, 30)))
    monkeypatch.setattr(B, "BITS", 10)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join([*(word() for _ in range(rng.randrange(30))), *passage, *(word() for _ in range(rng.randrange(30)))]) for _ in range(150)]
    rows = list(enumerate([*texts, *family(rng, 40, 2)]))
    sizes = []
    original = J.refined
    monkeypatch.setattr(J, "refined", lambda *a: sizes.append(original(*a)) or sizes[-1])
    check(docs, rows, 4, 85)
    first, last = (x.where("id < 150").groupBy("family").count().agg(F.max("count")).first()[0] or 0 for x in sizes)
    assert last <= first < 150


def test_small_sets(docs):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    check(docs, list(enumerate(texts)), 4, 85)


def test_linked_sets_share_a_key():
    """Sets at the threshold meet: all with few parts, and all but a chance of 1e-7 with many."""
    rng = np.random.default_rng(3)
    for n in (2, 6, 7, 8, 13, 20, 33, 60, 150, 400, 3000):
        for _ in range(25):
            drop, add = sorted(rng.integers(0, max(1, n * 15 // 100) + 1, 2))
            s = rng.integers(0, 2**63, n + add).astype(np.uint64)
            a, b = np.unique(s[:n]), np.unique(s[drop:])
            both = len(s[drop:n])
            if 100 * both >= 85 * (len(a) + len(b) - both) and (drop or add):
                for level in (J.FIRST, 2, 4) if n < 500 else (J.FIRST, 2):
                    assert set(J.keys_of(a, 85, level)) & set(J.keys_of(b, 85, level))


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(5)
    test = J.bound_test(85)
    for _ in range(300):
        s = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        a, b = s[: 200 - rng.integers(0, 20)], s[rng.integers(0, 20) :]
        vec = [np.bincount(((x >> np.uint64(40)) % np.uint64(J.GROUPS)).astype(np.int64), minlength=J.GROUPS) for x in (a, b)]
        both = len(np.intersect1d(a, b))
        assert B.common(np.sort(a.view(np.int64)), np.sort(b.view(np.int64))) == both
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert test(vec[0], vec[1][None], len(a), np.array([len(b)]))[0]


@pytest.mark.parametrize("most", [1 << 27, 1 << 15])
def test_only_texts_that_are_likely_wanted_are_shuffled(spark, monkeypatch, most):
    """Every row of a wanted id passes, its repeats as well; of the others a small part, or more if the bitmaps are full."""
    monkeypatch.setattr(J, "MOST_BITS", most)
    rows = spark.range(40_000).selectExpr("id - 20000 AS id", "'t' AS text").unionAll(spark.sql("SELECT -7L AS id, 'u' AS text UNION ALL SELECT NULL, 'v'"))
    wanted = spark.range(8_000).selectExpr("5 * id - 20002 AS id", "id AS k1")
    got = J.likely(rows, wanted, "id").alias("got")
    assert got.columns == ["id", "text"]
    n, missing = got.count(), wanted.where("id >= -20000").join(got, "id", "left_anti").count()
    assert missing == 0 and got.where("id = -7").count() == 2
    assert 8_000 <= n < (11_000 if most > 1 << 15 else 18_000)
    assert J.likely(rows, wanted.limit(0), "id").count() == 0


def test_points_shuffle_no_texts_of_strangers(docs, spark, monkeypatch):
    """Of 4,000 texts 200 may have links: the join that makes their points gets hardly more than those."""
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate([*(" ".join(f"w{rng.randrange(10**9)}" for _ in range(20)) for _ in range(3_800)), *family(rng, 200, 1)])]
    got = []
    original = J.likely
    monkeypatch.setattr(J, "likely", lambda *a: got.append(original(*a)) or got[-1])
    J.jaccard_groups(docs(rows)).count()
    assert len(got) == 1 and 100 <= got[0].count() < 800


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["n"], r["component_id"]) for r in J.jaccard_groups(odd, 4, 85).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (5, 3, 4), (None, 1, None), (6, 1, 6), (7, 1, 7)}
    assert J.jaccard_groups(none).count() == 0
    with pytest.raises(ValueError):
        J.jaccard_groups(none, percent=50)


def test_one_id_with_several_texts_joins_their_groups(docs):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "k l m n o p q z"
    rows = [(9, a), (9, b), (9, c), (4, a), (2, b), (6, c), (7, "i j k l m n")]
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_groups(docs(rows)).collect()}
    assert got == {9: 2, 4: 2, 2: 2, 6: 2, 7: 7}


def test_a_block_pair_lists_no_more_links_than_members(docs, spark):
    rows = [(i, t) for i, t in enumerate(family(random.Random(2), 300, 1))]
    seen = []
    original = J.block_links
    J.block_links = lambda *a: seen.append(original(*a).count()) or original(*a)
    try:
        groups = J.jaccard_groups(docs(rows)).agg(F.count_distinct("component_id")).first()[0]
    finally:
        J.block_links = original
    assert groups == 1 and sum(seen) < 3 * len(rows)
