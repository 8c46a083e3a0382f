import random

from lureframe.llm import near_dedup as N
from lureframe.llm.components import components


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    at[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def family(rng, size, edits, words=120):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        text = list(base)
        for _ in range(edits):
            text[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        yield " ".join(text)


def check(docs, rows, n, percent, **kw):
    want, sizes = brute(rows, n, percent)
    got = {r["doc_id"]: r for r in N.near_groups(docs(rows), n, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n"] for i, r in got.items()} == sizes


def test_groups_equal_brute_force(docs):
    rng = random.Random(3)
    texts = [t for size, edits in ((1, 0), (2, 1), (25, 2), (25, 3), (12, 5), (6, 9), (30, 0)) for t in family(rng, size, edits)]
    rng.shuffle(texts)
    check(docs, [(7 * i + 1, t) for i, t in enumerate(texts)], 3, 85)
    check(docs, [(7 * i + 1, t) for i, t in enumerate(texts)], 5, 80)


def test_chains_are_followed(docs):
    words = [f"v{i}" for i in range(300)]
    check(docs, [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)], 3, 85)


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["n"], r["component_id"]) for r in N.near_groups(odd, 3, 85).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 4, 4), (5, 4, 4), (None, 1, None), (6, 1, 6), (7, 1, 7)}
    out = N.drop_near_copies(odd)
    assert out.columns == odd.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert N.near_groups(none).count() == 0


def test_one_id_with_two_texts_joins_their_groups(docs):
    a, b = "a b c d e f g h", "q r s t u v w x"
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(docs([(9, a), (9, b), (4, a), (2, b)]), 3, 85).collect()}
    assert got == {9: 2, 4: 2, 2: 2}


def test_one_id_with_three_texts_joins_all_their_groups(docs):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "k l m n o p q z"
    rows = [(9, a), (9, b), (9, c), (4, a), (2, b), (6, c), (7, "i j k l m n")]
    assert {r["doc_id"]: r["component_id"] for r in N.near_groups(docs(rows), 3, 85).collect()} == {9: 2, 4: 2, 2: 2, 6: 2, 7: 7}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(1, 1), (None, 3)]
    at = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            at[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
