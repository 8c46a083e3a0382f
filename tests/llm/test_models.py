import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lureframe.llm import language_model as L
from lureframe.llm import quality as Q
from lureframe.llm import toxicity as T

WORDS = [a + b for a in ("ba", "ko", "ti", "lu", "me") for b in ("rin", "sol", "tag", "wen", "dor", "ul")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(docs, labels):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(700):
        bad = i % 6 == 0
        text = prose(rng, rng.randint(5, 60)).split()
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "NASTY!", "wretchling", "wretched"]))
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(bad)))
    got = T.toxicity(docs(rows), labels(marks + [(99999, 1, 1), (None, 1, 1), (3, 1, None)])).collect()
    assert len(got) == 700 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    wrong = sum(r["predicted"] != (r["doc_id"] % 6 == 0) for r in got if r["held_out"])
    assert wrong / sum(r["held_out"] for r in got) < 0.03 and all(0 <= r["score"] <= 1 for r in got)


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(0)
    sets = [np.unique(np.append(rng.integers(10, 4000, 60), 7) if i % 2 else rng.integers(10, 4000, 60)) for i in range(600)]
    at, w, _ = T.learn(sets, np.array([i % 2 for i in range(600)], float), bits=12)
    assert 7 in at and w[list(at).index(7)] == max(w) and len(at) < 400


def test_toxicity_of_odd_rows(odd, none, labels):
    assert T.toxicity(odd, labels([])).count() == 9
    assert T.toxicity(odd, labels([(1, 1, 1), (4, 1, 0)])).count() == 9
    assert T.toxicity(none, labels([(1, 1, 1)])).count() == 0


def test_language_model(docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 80)).title()) for i in range(400)] + [(1000, None), (1001, ""), (1001, "")]
    got = L.score_corpus(docs(rows), chunk_tokens=1500, shard_keys=300).collect()
    words = [(i, (t or "").encode().lower().split() + [b"</>"]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, ws in words if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held[i], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in words)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_probabilities_of_short_texts_stay_below_one(docs):
    """Over the whole vocabulary and one unknown word."""
    rng = random.Random(3)
    train = [(i, prose(rng, 30)) for i in range(60) if zlib.crc32(str(i).encode()) % 10]
    fresh = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    vocabulary = sorted({w for _, t in train for w in t.split()}) + ["unheard"]
    probes = list(zip(fresh, [f"{WORDS[3]} {w}" for w in vocabulary], strict=False))
    alone = [(fresh[-1], WORDS[3]), (fresh[-2], "")]
    got = {r["doc_id"]: r for r in L.score_corpus(docs(train + probes + alone)).collect()}
    # P(first) P(w | first) P(end | w), against P(first) P(end | first) and each P(end | w) from its own document.
    ends = list(zip(fresh[200:], vocabulary, strict=False))
    more = {r["doc_id"]: r["score"] for r in L.score_corpus(docs(train + ends)).collect()}
    assert all(got[i]["score"] < 0 for i, _ in probes) and all(more[i] < 0 for i, _ in ends)
    # Each document with one word w: P(w | start) P(end | w) sums to less than one over w, and the empty one adds its own.
    assert sum(10 ** more[i] for i, _ in ends) + 10 ** got[fresh[-2]]["score"] <= 1 + 1e-9


def test_weights_follow_the_held_out_counts():
    rows = np.array([[3, 20, 4, 900], [3, -1000, 6, 100], [5, -1000, 8, 500]])
    w = L.fit_weights(rows)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[5, 0] < 0.01 and np.allclose(w[6], w[5]) and w[0, 0] == 0


def test_language_model_of_odd_rows(odd, none):
    assert L.score_corpus(odd).count() == 9 and L.score_corpus(none).count() == 0


def junk(rng, i):
    return [" | ".join(rng.choice(WORDS) for _ in range(40)), "BUY!! NOW!! " * 30, ("spam " * 50).strip(), "@@## %% " * 30][i % 4]


def test_quality_on_held_out_rows(docs, labels):
    rng = random.Random(4)
    rows = [(i, junk(rng, i // 5) if i % 5 == 0 else "\n".join(prose(rng, rng.randint(3, 30)).capitalize() for _ in range(4)), f"s{i % 3}") for i in range(900)]
    marks = [(i, int(i % 5 != 0), 0) for i in range(0, 900) if i % 2 or i % 4 == 0] + [(5, None, 0), (None, 0, 0), (10**6, 1, 0)]
    got = Q.quality(docs(rows), labels(marks)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and sum(r["kept"] == (r["doc_id"] % 5 != 0) for r in held) / len(held) > 0.95
    kept = Q.drop_poor(docs(rows), labels(marks))
    assert kept.columns == docs(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def test_quality_of_odd_rows(odd, none, labels):
    assert all(r["kept"] for r in Q.quality(odd, labels([])).collect())
    assert Q.quality(odd, labels([(1, 0, 0), (4, 1, 0)])).count() == 9 and Q.drop_poor(none, labels([])).count() == 0
    assert Q.drop_poor(odd.select("doc_id", "text"), labels([])).count() == 9
