"""Document quality by co-training: one classifier sees the text's content, the other the page's metadata and layout.

Both start from a bounded sample of labelled rows. In each round either classifier labels the unlabelled sample
rows that it is surest of, at the labelled rate of good and bad, for the other one. In the end each view's logit is
calibrated on labelled rows that neither has seen, and the calibrated views are combined. Scoring reads each text
once, in place, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED = 12_000  # labelled rows the fit may see
UNLABELLED = 6_000  # unlabelled rows the rounds may draw from
ROUNDS = 4
GROWTH = 0.05  # share of the unlabelled rows that a view labels in a round
SURE = 0.95
THRESHOLD = 0.5
BINS = 8
HASHED = 32  # columns for the hashed source and language

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 small, 2 capital, 3 digit, 4 space, 5 plain punctuation, 6 symbol, 7 beyond ASCII
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t\n\v\f\r" else 5 if _c in ".,;:'\"-()?" else 6
_CLASS[128:] = 7


def content(text: bytes) -> list[float]:
    """Shares that don't depend on a text's length: repetition, kinds of characters, word shapes, sentences."""
    chars = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    words = text.split()
    n, letters = max(1, len(words)), max(1, chars[1] + chars[2] + chars[7])
    pairs = max(1, len(words) - 1)
    return [
        chars[2] / letters, chars[3] / max(1, len(text)), chars[5] / max(1, len(text)), chars[6] / max(1, len(text)),
        1 - len(set(words)) / n, 1 - len(set(zip(words, words[1:], strict=False))) / pairs, sum(map(eq, words, words[1:])) / pairs,
        sum(map(len, words)) / n, sum(len(w) == 1 for w in words) / n, sum(w[-1] in b".?!" for w in words) / n,
        sum(w[-1] in b"!#$%&*|" for w in words) / n, max(map(len, words), default=0),
    ]


def metadata(text: bytes, n_chars: float, lang: str | None, source: str | None) -> tuple[list[float], list[int]]:
    """Length, line layout, and hashed columns for language and source."""
    lines = [len(x) for x in text.split(b"\n")]
    size = n_chars if n_chars == n_chars and n_chars >= 0 else len(text)
    values = [np.log1p(size), np.log1p(len(lines)), np.log1p(max(lines)), np.log1p(sum(lines) / len(lines)), sum(x < 20 for x in lines) / len(lines), np.log1p(abs(size - len(text)))]
    return values, [xxhash.xxh32_intdigest(f"{k}={v}") % HASHED for k, v in (("lang", lang), ("source", source))]


def both_views(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the two views for columns text (bytes), n_chars, lang, source; null text counts as empty."""
    one, two = [], []
    for text, n_chars, lang, source in zip(pdf["text"], pdf["n_chars"].astype(float), pdf["lang"], pdf["source"], strict=True):
        text = text if isinstance(text, bytes) else b""
        one.append(content(text))
        values, at = metadata(text, n_chars, lang, source)
        hot = np.zeros(HASHED)
        hot[at] = 1
        two.append([*values, *hot])
    return np.array(one, float).reshape(len(one), 12), np.array(two, float).reshape(len(two), 6 + HASHED)


@dataclass
class Logistic:
    """Logistic regression on quantile bins of each column (so any monotone scale will do), by Newton steps."""

    edges: list[np.ndarray]
    weights: np.ndarray

    @staticmethod
    def spread(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        columns = [np.ones((len(x), 1))]
        for j, e in enumerate(edges):
            place = np.searchsorted(e, x[:, j], side="right")
            columns.append((place[:, None] == np.arange(1, len(e) + 1)).astype(float))
        return np.concatenate(columns, axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 12) -> Logistic:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(x[:, j])) > 2 else np.array([0.5]) for j in range(x.shape[1])]
        edges = [np.unique(np.append(e, np.quantile(x[:, j], [0.98, 0.995]))) if len(e) > 1 else e for j, e in enumerate(edges)]
        d = cls.spread(x, edges)
        w = np.zeros(d.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(turns):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            h = (d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty)
            w = w + np.linalg.solve(h, d.T @ (y - p) - penalty * w)
        return cls(edges, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x, self.edges) @ self.weights


def _platt(logits: np.ndarray, y: np.ndarray, turns: int = 25) -> np.ndarray:
    """Weights of the calibrated logits and the intercept, by Newton steps with a small ridge towards equal trust."""
    d = np.concatenate([logits, np.ones((len(logits), 1))], axis=1)
    start = np.append(np.full(logits.shape[1], 1 / logits.shape[1]), 0.0)
    w = start.copy()
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, d.T @ (y - p) - 0.1 * (w - start))
    return w


@dataclass
class Model:
    views: list[Logistic]
    calibration: list[np.ndarray]  # of each view: slope and intercept
    combine: np.ndarray  # weights of the calibrated views and the intercept
    rate: float

    def score(self, pdf: pd.DataFrame) -> np.ndarray:
        if not self.views:
            return np.full(len(pdf), self.rate)
        logits = np.stack([v.logit(x) * c[0] + c[1] for v, x, c in zip(self.views, both_views(pdf), self.calibration, strict=True)], axis=1)
        return 1 / (1 + np.exp(-np.clip(logits @ self.combine[:-1] + self.combine[-1], -30, 30)))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model:
    """y: 1 good, 0 bad, of the rows of views; pool: the same views of unlabelled rows."""
    rate = float(y.mean()) if len(y) else 1.0
    if len(y) < 20 or not 0 < rate < 1:
        return Model([], [], np.zeros(3), rate)
    check = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[check])) < 2 or len(np.unique(y[~check])) < 2:
        check[:] = False
    learn = ~check
    own = [[x[learn]] for x in views], [[y[learn]], [y[learn]]]
    free = np.ones(len(pool[0]), bool)
    models: list[Logistic] = []
    for turn in range(rounds + 1):
        models = [Logistic.fit(np.concatenate(own[0][v]), np.concatenate(own[1][v])) for v in (0, 1)]
        if turn == rounds or not free.any():
            break
        for v in (0, 1):
            at = np.flatnonzero(free)
            p = 1 / (1 + np.exp(-np.clip(models[v].logit(pool[v][at]), -30, 30)))
            most = max(1, int(GROWTH * len(free)))
            good = at[np.argsort(-p, kind="stable")[: max(1, round(most * rate))]]
            bad = at[np.argsort(p, kind="stable")[: max(1, round(most * (1 - rate)))]]
            surest = dict(zip(at, p, strict=True))
            for label, chosen in ((1.0, [i for i in good if surest[i] >= SURE]), (0.0, [i for i in bad if surest[i] <= 1 - SURE])):
                own[0][1 - v].append(pool[1 - v][chosen]), own[1][1 - v].append(np.full(len(chosen), label))
                free[chosen] = False
    seen = check if check.any() else learn
    raw = [m.logit(x[seen]) for m, x in zip(models, views, strict=True)]
    calibration = [_platt(r[:, None], y[seen]) for r in raw]
    combine = _platt(np.stack([r * c[0] + c[1] for r, c in zip(raw, calibration, strict=True)], axis=1), y[seen])
    return Model(models, calibration, combine, rate)


def _inputs(docs: DataFrame) -> list[Column]:
    have = set(docs.columns)
    one = lambda c, kind: (F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c)
    return [one("text", "binary"), one("n_chars", "double"), one("lang", "string"), one("source", "string")]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on at most `labelled` and `unlabelled` rows, both spread by a hash of doc_id; held-out labels are not used."""
    schema = "id long, label double, one array<double>, two array<double>"

    def run(batches):
        for pdf in batches:
            one, two = both_views(pdf)
            yield pd.DataFrame({"id": pdf["_llm_id"], "label": pdf["label"], "one": list(one), "two": list(two)})

    key = F.xxhash64("doc_id", F.lit(9))
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    some = marks.where(~held_out(F.col("doc_id"))).orderBy(key, "doc_id").limit(labelled)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").join(marks, "doc_id", "left_anti")
    rest = ids.orderBy(key, "doc_id").limit(unlabelled).withColumn("label", F.lit(-1.0))
    wanted = some.unionByName(rest).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("_llm_id"), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("_llm_id"), *_inputs(docs))
    # Sample rows are bounded by the parameters, so their ids may be broadcast and no text is shuffled.
    drawn = texts.join(F.broadcast(wanted), "_llm_id")
    # Repeated rows of an id count once (the smallest), so the fit sees as many rows as the parameters say at most.
    once = drawn.groupBy("_llm_id", "label").agg(F.min(F.struct("text", "n_chars", "lang", "source")).alias("_llm_row"))
    rows = once.select("_llm_id", "label", "_llm_row.*").mapInPandas(run, schema).toPandas()
    if not len(rows):
        return Model([], [], np.zeros(3), 1.0)
    # One order whatever the partitions were, so that reruns agree.
    rows = rows.sort_values("id", key=lambda c: c.map(lambda i: xxhash.xxh3_64_intdigest(str(i))), kind="stable")
    views = [np.array(rows[c].tolist(), float) for c in ("one", "two")]
    label = rows["label"].to_numpy()
    known = label >= 0
    return co_train(tuple(v[known] for v in views), label[known], tuple(v[~known] for v in views), rounds)


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with the quality score (0 to 1) as column `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    @F.pandas_udf("double")
    def score(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(pdf))

    return docs.withColumn(name, score(F.struct(*_inputs(docs))))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, kept; one row for every row.

    Null text counts as empty; null or missing metadata is a value of its own; without labels of both kinds every
    document scores the labelled rate (1 without any label). An empty table gives no rows.
    """
    out = scored(docs.select("doc_id", *_inputs(docs)), fit(docs, labels, **options), "score")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).alias("kept"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without those the classifier rejects; all columns of the others stay."""
    return scored(docs, fit(docs, labels, **options), "_llm_quality").where(F.col("_llm_quality") >= threshold).drop("_llm_quality")
