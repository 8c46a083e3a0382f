"""Toxicity: logistic regression fitted by FTRL-proximal over hashed word n-grams and skip-grams.

Features are words with their beginnings (which stand for inflected forms), word pairs and pairs with a gap; they
are computed where the text is. The fit sees a bounded sample of labelled rows; per-coordinate rates and
L1 leave few weights, which go out as one small sorted table. A text's features are sets, so a long text doesn't
outweigh a short one by repeating itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureframe.llm.store import back_id, sent_id
from lureframe.llm.words import CACHE, WordHashes, grams, hashed

BITS = 22
SAMPLE = 5_000  # labelled rows the fit may see
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
THRESHOLD = 0.7
#: Lengths (bytes) of the word beginnings that stand for a word's inflected forms.
STEMS = (4, 5, 6)
#: ASCII punctuation parts words.
PARTS = bytes(32 if 32 < i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 127 else i for i in range(256))


def split(text: bytes | None) -> list[bytes]:
    return text.lower().translate(PARTS).split() if text else []


def single(word: bytes, bits: int) -> tuple[int, ...]:
    """Features of a word by itself: the word and its beginnings."""
    stems = {word[:n] + b"*" for n in STEMS if len(word) > n}
    return tuple(xxhash.xxh3_64_intdigest(w) >> (64 - bits) for w in (word, *stems))


def pairs(h: np.ndarray, bits: int) -> np.ndarray:
    """Neighbouring words, and pairs with one or two words between."""
    return (np.concatenate([grams(h, 2), grams(h, 2, gap=1), grams(h, 2, gap=2)]) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: bytes | None, known: WordHashes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed features of a whole text."""
    words = split(text)
    ones = [f for w in set(words) for f in single(w, bits)]
    return np.unique(np.concatenate([np.array(ones, np.int64), pairs(hashed(words, known), bits)]))


class Weighted(dict):
    """Word to those of its own features that have a weight; the first words are remembered."""

    def __init__(self, some: np.ndarray, bits: int):
        super().__init__()
        self.some, self.bits = some, bits

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        value = tuple(f for f in single(word, self.bits) if self.some[f])
        if len(self) < CACHE:
            self[word] = value
        return value


class Ftrl:
    """FTRL-proximal with per-coordinate learning rates; the last coordinate is the intercept, without L1."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(labelled: DataFrame, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature numbers, their weights, intercept) from rows (doc_id, text, label).

    The caller bounds the rows; they are featurised on the executors, and the driver sees sets of feature numbers. Without rows of both labels there are no weights and the intercept is the base rate's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "f": [features(t, known, bits).astype(np.int32).tobytes() for t in pdf["text"]]})

    rows = labelled.where("label IS NOT NULL").select("doc_id", F.col("label").cast("double").alias("label"), F.col("text").cast("binary").alias("text"))
    drawn = rows.mapInPandas(run, "doc_id long, label double, f binary").toPandas()
    # One order whatever the partitions were, so that reruns agree.
    drawn = drawn.iloc[np.lexsort((drawn["f"].map(len), drawn["doc_id"]))]
    rate = float(np.clip(drawn["label"].mean() if len(drawn) else 0.0, 1e-3, 1 - 1e-3))
    if not len(drawn) or drawn["label"].nunique() < 2:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate)))
    return learn([np.frombuffer(f, np.int32) for f in drawn["f"]], drawn["label"].to_numpy(), epochs, bits)


def learn(sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    # Features of one text can't pass the L1 bound and only slow the fit down.
    spread = np.zeros(2**bits, np.int32)
    for f in sets:
        spread[f] += 1
    sets = [f[spread[f] > 1] for f in sets]
    model = Ftrl(2**bits)
    rng = np.random.default_rng(20)
    for _ in range(epochs):
        for i in rng.permutation(len(sets)):
            model.learn(sets[i], labels[i])
    at = np.flatnonzero(np.abs(model.z[:-1]) > model.l1)
    return at, model.weights(at), float(model.weights(np.array([2**bits]))[0])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """(doc_id, score) for every row; a null or empty text scores by the intercept alone."""
    table = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the sample; a few thousand numbers after L1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, w, bias = table.value
        some = np.zeros(2**bits, bool)
        some[at] = True
        known, own = WordHashes(), Weighted(some, bits)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = split(text)
                two = pairs(hashed(words, known), bits)
                f = np.array(sorted({*chain.from_iterable(map(own.__getitem__, set(words))), *two[some[two]].tolist()}), np.int64)
                out.append(1 / (1 + np.exp(-np.clip(bias + w[np.searchsorted(at, f)].sum(), -35, 35))))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.array(out, float)})

    return back_id(docs.select(sent_id("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, "doc_id long, score double"), "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; one row for every row of docs.

    Learns from labelled rows whose crc32(doc_id as text) mod 3 is not 1. Labels of documents that don't exist,
    null labels and repeated labels (the largest counts) are fine; text alone is scored.
    """
    held = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(3)) == 1
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The sample is drawn from ids first; at most `sample` of them are broadcast, and no text moves.
    drawn = marks.where(~held(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(sample)
    # Repeated rows of an id count once (the smallest text), so the fit sees `sample` rows at most.
    weights = fit(texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    out = score(docs, weights)
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
