import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lureframe.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    forms = {}
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [forms[w], None, n, len(close), counts[best] if forms[w] else None]
    for w in counts:
        last = w
        while forms[last]:
            last = forms[last]
        out[w][1] = last
    return {w: tuple(v) for w, v in out.items()}


def runs(rows):
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            yield run[:at] + run[at + 1 :] if h % 97 == 0 else run


def words(rng, n):
    letters = "abcdeéñÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(n)]
    for w in base:
        yield w, rng.randrange(3, 60)
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            made = w[:at] + (rng.choice(letters) if kind else "") + w[at + (kind != 1) :]
            if len(made) >= 5:
                yield made, rng.randrange(3, 20)


@pytest.mark.parametrize("frequent", [2, 30, 10**6])
def test_variants_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(S, "FREQUENT", frequent)
    rng = random.Random(frequent)
    counts = dict(words(rng, 250)) | {"aaaaa": 9, "aaaaaa": 40, "aaaaaaa": 80, "ababa": 5, "babab": 7, "x" * 3000: 4, "x" * 3001: 9}
    rows = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n int").repartition(5)
    each = rows.select("word", F.explode(F.expr("sequence(1, n)")).alias("doc_id"))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in S.variants(each).collect()}
    assert got == brute(counts)


def test_an_edit_touches_no_more_grams_than_bound():
    rng = random.Random(2)
    frequent = frozenset("".join(rng.choice("abc") for _ in range(rng.randrange(2, 4))) for _ in range(25))
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 12)))
        grams = Counter(S.decompose(w, frequent))
        for i in range(len(w) + 1):
            for v in (w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1 :]):
                shared = sum((grams & Counter(S.decompose(v, frequent))).values())
                assert shared >= len(w) + 1 - S.affected(S.decompose(w, frequent))


def test_damaged_runs(docs, odd):
    rows = [(i, "Straße naïve CAFÉ ÀÉ the-end x2y " * 20) for i in range(60)] + [(None, "alone here"), (8, None), (9, ""), (10, "1 2 3")]
    assert Counter(r["word"] for r in S.damaged_runs(docs(rows)).collect()) == Counter(runs(rows))
    got = {r["word"]: r["n"] for r in S.variants(S.damaged_runs(odd)).collect()}
    assert got == {w: n for w, n in Counter(runs([tuple(r)[:2] for r in odd.collect()])).items() if n >= 3 and len(w) >= 5}


def test_empty_table_and_nulls(spark, none):
    assert S.variants(S.damaged_runs(none)).count() == 0
    rows = spark.createDataFrame([(None,)] * 5 + [("words",)] * 3, "word string")
    assert [tuple(r) for r in S.variants(rows).collect()] == [("words", None, "words", 3, 0, None)]
    with pytest.raises(ValueError):
        S.variants(rows, shortest=3)
