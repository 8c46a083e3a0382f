"""Spelling variants: words one edit apart, found through a variable-length gram index.

Grams are extended while they are frequent: a dictionary holds the grams of 2 to LONGEST - 1 code points that occur
more than a threshold, and at every position of a padded word the gram is the shortest one that isn't in it, at most
LONGEST code points. An edit touches only grams that cover its place, so a word keeps all but as many grams as cover
one place, its affected-gram bound. Words one edit apart therefore share a gram, at places at most one apart, among
the (bound + 1) grams of each word whose lists are shortest; only those short lists are merged, as an equi-join on
gram, length and place, and every pair that meets is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureframe.llm.store import observed, save

#: Longest gram. Words are as long at least, so some gram always survives an edit.
LONGEST = 4
#: A gram is extended if it occurs more often; and more often than one in NODES of all grams, which bounds the dictionary.
FREQUENT = 100
NODES = 20_000
#: Hashed counters of list lengths; they only choose which lists are merged.
COUNTERS = 1 << 18
LETTERS = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEGIN, FINISH = "\x02", "\x03"


def damaged_runs(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """(word): every run of letters of the whole texts, A-Z in lower case; where one_in divides the crc32 of
    `doc_id:run`, less the code point at that number modulo the run's length. A null doc_id is an empty one."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), 0))
    named = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_id"), runs.alias("_run"))
    h = F.crc32(F.concat("_id", "_run").cast("binary"))
    less = F.expr("concat(substring(_run, 1, CAST(_h % length(_run) AS INT)), substring(_run, CAST(_h % length(_run) AS INT) + 2))")
    return named.withColumn("_h", h).select(F.when(F.col("_h") % one_in == 0, less).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """(word, n): words of at least `shortest` code points that occur at least `rarest` times, from (word)."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)


def decompose(word: str, frequent: frozenset[str]) -> list[str]:
    """The gram at each position of the padded word."""
    word = BEGIN + word + FINISH
    out = []
    for at in range(len(word) - 1):
        gram = word[at : at + 2]
        while gram in frequent and at + len(gram) < len(word):
            gram = word[at : at + len(gram) + 1]
        out.append(gram)
    return out


def affected(grams: list[str]) -> int:
    """The most grams that one edit can touch: those that cover one place behind the padding in front."""
    cover = [0] * (len(grams) + 2)
    for at, gram in enumerate(grams):
        cover[at] += 1
        cover[at + len(gram)] -= 1
    most = now = 0
    for place, change in enumerate(cover):
        now += change
        most = max(most, now) if place else most
    return most


def _frequent(vocab: DataFrame, positions: int) -> frozenset[str]:
    """The gram dictionary: at most NODES grams of each length, whatever the vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for pdf in batches:
            for word in pdf["word"]:
                word = BEGIN + word + FINISH
                for size in range(2, LONGEST):
                    seen.update(word[at : at + size] for at in range(len(word) - size + 1))
                if len(seen) > COUNTERS:
                    yield pd.DataFrame(seen.items(), columns=["gram", "n"])
                    seen.clear()
        yield pd.DataFrame(seen.items(), columns=["gram", "n"])

    counts = vocab.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return frozenset(r["gram"] for r in counts.where(F.col("n") > max(FREQUENT, positions // NODES)).select("gram").collect())


def _slot(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram) % COUNTERS


def _list_lengths(vocab: DataFrame, frequent: frozenset[str]) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            slots = [_slot(g) for word in pdf["word"] for g in decompose(word, frequent)]
            total += np.bincount(slots, minlength=COUNTERS) if slots else 0
        used = np.flatnonzero(total)
        yield pd.DataFrame({"slot": used, "n": total[used]})

    lengths = np.zeros(COUNTERS, np.int64)
    for slot, n in vocab.select("word").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        lengths[slot] = n
    return lengths


def _entries(vocab: DataFrame, frequent: frozenset[str], lengths: np.ndarray) -> DataFrame:
    """(key, up, id, word): the short lists of each word. The key is that of gram, length and place; rows with `up` look
    for words that are one code point longer, where the gram stands at the same place or one further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, word in zip(pdf["id"], pdf["word"], strict=True):
                grams = decompose(word, frequent)
                order = sorted(range(len(grams)), key=lambda at: (lengths[_slot(grams[at])], grams[at], at))
                for at in order[: affected(grams) + 1]:
                    for up, place in ((0, at), (1, at), (1, at + 1)):
                        key = xxhash.xxh3_64_intdigest(f"{grams[at]}:{len(word) + up}:{place}")
                        out.append((key - (1 << 63), up, i, word))
            yield pd.DataFrame(out, columns=["key", "up", "id", "word"])

    return vocab.select("id", "word").mapInPandas(run, "key long, up int, id long, word string")


def near_words(vocab: DataFrame, positions: int, shortest: int) -> DataFrame:
    """(a, b): ids of words one inserted, deleted or replaced code point apart, each pair once, from (id, word)."""
    if shortest < LONGEST:
        raise ValueError(f"words need {LONGEST} code points at least, so that an edit leaves a gram")
    frequent = _frequent(vocab, positions)
    entries = save(_entries(vocab, frequent, _list_lengths(vocab, frequent)), "grams")
    x = entries.select("key", "up", F.col("id").alias("a"), F.col("word").alias("wa"))
    y = entries.where("up = 0").select("key", F.col("id").alias("b"), F.col("word").alias("wb"))
    met = x.join(y, "key").where((F.col("up") == 1) | (F.col("a") < F.col("b"))).where(F.levenshtein("wa", "wb", 1) == 1)
    return met.select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last word that forms lead to, from (id, form). Every round doubles the steps taken."""
    current = save(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        moved = current.join(ahead, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        current, seen = observed(moved, "roots", F.count_if("moved").alias("n"))
        if not seen["n"]:
            return current.select("id", "root")


def variants(words: DataFrame, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """Per word: form (its near word of largest n, ties to the smallest, if that n is twice its own), root, n, n_near, form_n.

    words holds (word), one row per occurrence; a null is no word. A word without a form is its own root. An empty
    table gives no rows; other columns don't matter. Near words differ by exactly one inserted, deleted or replaced
    code point; all of them count, however many there are.
    """
    counted = vocabulary(words, shortest, rarest).withColumn("id", F.monotonically_increasing_id())
    vocab, seen = observed(counted, "words", F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("positions"))
    pairs = save(near_words(vocab, seen["positions"], shortest), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = vocab.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("n"), "word", "id").alias("best"))
    near = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    known = vocab.join(near, "id", "left")
    formed = known.withColumn("best", F.when(-F.col("best.n") >= 2 * F.col("n"), F.col("best")))
    formed = save(formed.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best"), "forms")
    roots = _roots(formed.where("best IS NOT NULL").select("id", F.col("best.id").alias("form")))
    last = roots.join(vocab.select(F.col("id").alias("root"), F.col("word").alias("_last")), "root").select("id", "_last")
    out = formed.join(last, "id", "left")
    return out.select("word", F.col("best.word").alias("form"), F.coalesce("_last", "word").alias("root"), "n", "n_near", (-F.col("best.n")).alias("form_n"))
