"""Near-duplicates: many universal hash minima, banding, signature check, full-set check, star components.

Equal shingle sets are one class from the start, so copies never meet each other as pairs. Classes that share a
band form a bucket. A bucket doesn't list its pairs: every member is compared with one centre, the member that
shares the most with all others; links make components, and buckets whose members are all in one
component are done; others get another centre. What is still open when centres no longer pay meets block by block
inside tasks, which give back only links that join two parts. A pair is tested by its signatures first and confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureframe.llm.blocks import block_links, cut, descend, fits, ranges, single
from lureframe.llm.components import components
from lureframe.llm.store import back_id, discard, observed, save, sent_id
from lureframe.llm.words import MIX, WordHashes, grams, hashed, lowered, scramble

WORDS = 5
PERCENT = 80
#: Chance that a pair just at the threshold shares no band.
MISS = 1e-7
#: Standard deviations that a pair's signature estimate may lie under the threshold.
SLACK = 5.0
#: Rounds of centres at most, before what is open meets block by block.
CENTRES = 3
SETS = "doc_id long, n long, k1 long, k2 long, bands array<long>"
FULL = "id long, k1 long, sig array<tinyint>, s array<long>"


def banding(percent: int) -> tuple[int, int]:
    """(rows of a band, bands) so that a pair at the threshold is missed with a chance of MISS at most."""
    rows = 6 if percent >= 85 else 5 if percent >= 80 else 4
    return rows, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and shifts of n hash functions x -> a x + b modulo 2^32."""
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def shingles(text: bytes | None, known: WordHashes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; a shorter text is one shingle, a text without words none."""
    h = hashed(lowered(text), known)
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), block):
        np.minimum(out, (a[:, None] * x[None, at : at + block] + b[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per document: size and key of its shingle set, and one key for each band of its minima."""
    rows, bands = banding(percent)
    a, b = universal(rows * bands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            made: dict[tuple[int, int], int] = {}
            sizes, k1, k2, at, sig = [], [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, known, n)
                key = (xxhash.xxh3_64_intdigest(s.tobytes()), xxhash.xxh3_64_intdigest(s.tobytes(), 1))
                if len(s) and key not in made:
                    made[key] = len(sig)
                    sig.append(minima(s, a, b))
                sizes.append(len(s)), k1.append(key[0]), k2.append(key[1]), at.append(made[key] if len(s) else -1)
            matrix = np.array(sig, np.uint64).reshape(len(sig), bands, rows)
            keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
            for j in range(rows):
                keys = scramble(keys * MIX + matrix[:, :, j])
            keys = keys.view(np.int64)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n": sizes, "k1": np.array(k1, np.uint64).view(np.int64), "k2": np.array(k2, np.uint64).view(np.int64),
                "bands": [keys[i] if i >= 0 else None for i in at],
            })

    return back_id(docs.select(sent_id("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, SETS), "doc_id")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, k1, sig, s): signature (the low bytes of the minima) and shingle hashes of the wanted documents, computed
    anew from their whole texts."""
    rows, bands = banding(percent)
    a, b = universal(rows * bands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            out = []
            for i, k1, text in zip(pdf["id"], pdf["k1"], pdf["text"], strict=True):
                s = shingles(text, known, n)
                if np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) == k1:  # not another text of the same id
                    out.append((i, k1, minima(s, a, b).astype(np.uint8).view(np.int8), np.sort(s.view(np.int64))))
            yield pd.DataFrame(out, columns=["id", "k1", "sig", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return texts.join(wanted.select("id", "k1").distinct(), "id").mapInPandas(run, FULL).dropDuplicates(["id", "k1"])


def _least(percent: int) -> float:
    """Places of a signature in which a linked pair agrees, up to SLACK deviations."""
    rows, bands = banding(percent)
    n, t = rows * bands, percent / 100
    return n * (t - SLACK * math.sqrt(t * (1 - t) / n))


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(u, v) for the pairs that pass both tests: signatures agree in enough places for the threshold, less SLACK
    deviations, and the full sets reach the threshold, in whole numbers."""
    least = _least(percent)
    side = lambda x: full.select(F.col("id").alias(x), F.col("k1").alias(f"k{x}"), F.col("sig").alias(f"sig{x}"), F.col("s").alias(f"s{x}"))
    agree = F.size(F.filter(F.zip_with("siga", "sigb", lambda x, y: x == y), lambda same: same))
    both = F.size(F.array_intersect("sa", "sb"))
    # Dealt by (a, ka) once: that serves for telling pairs apart and for the first join.
    once = pairs.select("a", "ka", "b", "kb").repartition("a", "ka").distinct()
    joined = once.join(side("a"), ["a", "ka"]).join(side("b"), ["b", "kb"])
    return joined.where((agree >= least) & (both * 100 >= (F.size("sa") + F.size("sb") - both) * percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _near(x: str, y: str, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _star(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each member with its bucket's centre: the member that shares most with others, later any other."""
    by = F.col("mass") if turn == 0 else F.xxhash64("id", F.lit(turn))
    centre = members.groupBy("key").agg(F.max(F.struct(by.alias("by"), F.col("id").alias("b"), F.col("k1").alias("kb"), F.col("n").alias("nb"))).alias("c"))
    centres = centre.select("key", "c.b", "c.kb", "c.nb")
    own = (F.col("id") == F.col("b")) & (F.col("k1") == F.col("kb"))
    return members.join(centres, "key").where(~own & _near("n", "nb", percent)).select(F.col("id").alias("a"), F.col("k1").alias("ka"), "b", "kb")


def _agree(percent: int):
    """Signatures against signatures: as many equal minima as the threshold needs, less SLACK deviations."""
    least = _least(percent)

    def test(sig: np.ndarray, others: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        return (others == sig).sum(axis=1) >= least

    return test


def _open_links(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between open members in different components. Members that share bands, directly or through others, are a family; a
    family is cut into blocks by component and size, and blocks meet block by block, unless both are of one component."""
    lead = members.groupBy("key").agg(F.min("id").alias("lead"))
    families = components(members.join(lead, "key").select(F.col("id").alias("u"), F.col("lead").alias("v")).distinct())
    each = members.groupBy("id", "k1").agg(F.min("n").alias("n"), F.min("label").alias("label"), F.min("key").alias("key"))
    placed = save(cut(each.join(families.select(F.col("node").alias("id"), F.col("component").alias("family")), "id"), ["key"]), "blocks")
    blocks = save(ranges(single(placed), "block", F.first("node").alias("node")), "ranges")
    pairs = save(descend(blocks, ranges(blocks, "node"), fits(percent)), "pairs")
    return block_links(pairs, placed, full.select("id", "k1", F.size("s").cast("long").alias("n"), F.col("sig").alias("vec"), "s"), _agree(percent), percent)


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n (distinct shingles), component_id (smallest doc_id reachable over links).

    Two documents are linked when their shingle sets' similarity is at least percent / 100. Documents without
    words link with nothing. A row without doc_id has no component but keeps its row. Rows that repeat a doc_id
    are one document: it is linked with whatever one of its texts is linked with. Empty tables give no rows.
    """
    sets = save(signatures(docs, words, percent), "sets")
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min_by(F.struct("n", "bands"), "doc_id").alias("first")
    classes, seen = observed(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), first).select("id", "k1", "k2", "first.*"), "classes", F.count(F.lit(1)).alias("n"))
    total = seen["n"]
    placed = save(sets.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "id"), ["k1", "k2"], "left").select("doc_id", "n", "id"), "placed")
    discard(sets)

    # Buckets with more than one class. Most keys are alone and end at the first aggregate. A class shares mass
    # members over its buckets (as many as there are bands).
    keyed = classes.select(F.explode("bands").alias("key"), "id", "k1", "n")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mass = F.sum("m").over(Window.partitionBy("id", "k1"))
    members, seen = observed(keyed.join(shared, "key").withColumn("mass", mass).withColumn("label", F.col("id")), "members", F.coalesce(F.sum(F.col("m") / 2), F.lit(0.0)).alias("work"))
    work = seen["work"]
    full = save(full_sets(docs, members, words, percent), "full")

    # A doc_id that comes with several texts joins their classes.
    several = placed.where("id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v").select("doc_id")
    links = placed.where("id IS NOT NULL").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    labels, earlier = None, float("inf")
    for turn in range(CENTRES + 1):
        # Few pairs are left, or centres no longer help: the members of these buckets are similar, but not linked.
        last = turn > 0 and (work <= total or turn == CENTRES or 2 * work > earlier)
        earlier = work
        found = _open_links(members, full, percent) if last else confirmed(_star(members, turn, percent), full, percent)
        # What is known so far goes on as edges to the components, so later rounds start from stars.
        links = save(links.unionByName(found), "links")
        labels = save(components(links), "labels")
        if last:
            break
        links = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        labelled = members.drop("label", "m").join(labels, members["id"] == labels["node"], "left").withColumn("label", F.coalesce("component", "id"))
        state = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
        members, seen = observed(labelled.join(state.select("key", "m"), "key").select("key", "id", "k1", "n", "mass", "label", "m"), "open", F.coalesce(F.sum(F.col("m") / 2), F.lit(0.0)).alias("work"))
        work = seen["work"]
        if not work:
            break

    out = placed.join(labels, placed["id"] == labels["node"], "left")
    return out.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the smallest doc_id; all columns stay.
    Rows without doc_id stay, and so do all rows of a kept doc_id."""
    gone = near_groups(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_llm_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_llm_gone"], "left_anti")
