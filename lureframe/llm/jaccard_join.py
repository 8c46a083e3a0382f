"""N-gram Jaccard join with an R-tree over count vectors.

Shingles are hashed into GROUPS groups; a document is the point of its group counts, and the summed coordinate minima of two
points, or of the upper corners of two boxes, bound the overlap of the sets below them.

* Which points can meet: the shingles are also dealt to as many parts as a linked pair of that size may differ in, plus one,
  so a linked pair agrees in a part (pigeonhole). A part's content is a key; points that share keys make a family. Larger
  sets take fewer, fuller parts, and as many from several deals as make a miss a chance of 1e-7.
  Passages that many documents share chain strangers into large families; what is open there meets again by keys of two
  and four times the content, which strangers rarely share, so that only what is alike stays together.
* Each family is an R-tree: points in label, size and key order fill leaves, leaves fill nodes, every one with its box.
  First each leaf is joined with itself and the family's first leaf; what that links gets one label, and the tree of what is
  open is built again by label, so leaves of one label never meet each other. Then node pairs, and in them leaf pairs, meet only if their
  boxes' bound allows a link. In a leaf pair points are bounded the same way, and survivors are verified on full sets.
* Links end in components, so copies are never listed as pairs.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.llm.blocks import block_links, cut, descend, fits, ranges, single
from lureframe.llm.components import components
from lureframe.llm.store import back_id, observed, save, sent_id, split_count
from lureframe.llm.words import MIX, WordHashes, grams, hashed, lowered, scramble

WORDS = 4
PERCENT = 85
GROUPS = 64
#: Chance that a linked pair shares no key, at most; sets that may differ in EXACT shingles at most (up to about 60) never miss.
MISS, EXACT = 1e-7, 11
#: Content of a key of larger sets, against that of as many parts as the sets may differ in.
FIRST = 1.4
#: Open families of more members than the second number meet again by keys of the level that is the first. Below, blocks are
#: cheaper than the many keys of a level.
LEVELS = ((2, 4_096), (4, 32_768))
#: Bits of the bitmaps of wanted ids: for each id, at most (16 MB), and in one row of bitmap_construct_agg.
SPARSE, MOST_BITS, PART_BITS = 16, 1 << 27, 1 << 15
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
SETS = "doc_id long, n long, k1 long, k2 long, keys array<long>"
FULL = "id long, k1 long, n long, vec array<int>, s array<long>"

#: Size bands, each 1.6 times as wide as the one before.
EDGES = [1, 2, 3, 4]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 8 // 5))


def differ(band: int, percent: int) -> int:
    """The most shingles that only one of two linked sets has, if the larger one lies in the band."""
    return (100 - percent) * 2 * (EDGES[band + 1] - 1) // (100 + percent)


def _parts(s: np.ndarray, salt: np.uint64, n_parts: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, count) of the first `used` of n_parts parts."""
    x = scramble(s + salt)
    at = (x >> np.uint64(20)) % np.uint64(n_parts)
    if used < n_parts:
        x, at = x[at < used], at[at < used]
    content = np.zeros(used, np.uint64)
    np.add.at(content, at, scramble(x))
    return content, np.bincount(at.astype(np.int64), minlength=used)


def _plain_keys(s: np.ndarray, band: int, apart: int) -> list[np.ndarray]:
    """Contents of apart + 1 parts, of which a linked pair shares one. An empty part is no key by itself but together with
    each part of a second deal."""
    parts, salt = apart + 1, np.uint64((band + 1) * int(MIX) % 2**64)
    content, count = _parts(s, salt, parts, parts)
    name = salt + np.arange(parts, dtype=np.uint64)
    out = [scramble(content * MIX + name)[count > 0]]
    if not count.all():
        second, _ = _parts(s, salt ^ SECOND, parts, parts)
        out += [scramble(scramble(second * MIX + name) + np.uint64((int(j) + 1) * int(SECOND) % 2**64)) for j in np.flatnonzero(count == 0)]
    return out


def _long_keys(s: np.ndarray, band: int, apart: int, level: float) -> list[np.ndarray]:
    """Fewer parts, which hold `level` times as much, and as many of them, from several deals, as a chance of MISS needs."""
    parts = max(2, round(apart / level))
    wanted = math.ceil(math.log(MISS) / math.log1p(-0.95 * (1 - 1 / parts) ** apart))
    out = []
    for deal in range(-(-wanted // parts)):
        salt = np.uint64(((band + 1) * int(MIX) + (round(1000 * level) + deal + 1) * int(SECOND)) % 2**64)
        used = min(parts, wanted - deal * parts)
        content, count = _parts(s, salt, parts, used)
        out.append(scramble(content * MIX + salt + np.arange(used, dtype=np.uint64))[count > 0])
    return out


def keys_of(s: np.ndarray, percent: int, level: float = FIRST) -> np.ndarray:
    """The keys of a set: contents of its parts, for its own size band and, near the edge, for the next one."""
    n, out = len(s), []
    own = bisect.bisect_right(EDGES, n) - 1
    for band in (own, own + 1) if n * 100 // percent >= EDGES[own + 1] else (own,):
        if apart := differ(band, percent):  # otherwise only equal sets can be linked
            out += _plain_keys(s, band, apart) if level == FIRST and apart <= EXACT else _long_keys(s, band, apart, level)
    return np.unique(np.concatenate(out)) if out else s[:0]


def shingles(text: bytes | None, known: WordHashes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; a shorter text is one shingle, a text without words none."""
    h = hashed(lowered(text), known)
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: size and key of its set, and the keys it may meet others by (null where the batch had the set before)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            seen, out = set(), []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingles(text, known, words)
                name = xxhash.xxh3_128_intdigest(s.tobytes())
                keys = keys_of(s, percent).view(np.int64) if len(s) and name not in seen else None
                seen.add(name)
                out.append((i, len(s), (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63), keys))
            yield pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "keys"])

    return back_id(docs.select(sent_id("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, SETS), "doc_id")


def likely(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose `name` is wanted, and a few others, so that a join with wanted doesn't shuffle the texts of all rows.

    A bit of each wanted id is set in bitmaps that every task gets; they hold SPARSE bits an id, up to MOST_BITS. With more
    ids more other rows pass, but no wanted one is lost.
    """
    part, bit = F.expr(f"_slot div {PART_BITS}"), F.col("_slot") % PART_BITS
    slot = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(min(MOST_BITS, split_count(SPARSE * wanted.count(), 1, PART_BITS))))
    filled = wanted.select(slot.alias("_slot")).select(part.alias("_part"), bit.alias("_bit")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    sent = rows.withColumn("_slot", slot).withColumn("_part", part).join(F.broadcast(filled), "_part")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_slot % {PART_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return sent.where(F.getbit(byte, (F.col("_slot") % 8).cast("int")) == 1).select(*rows.columns)


def points(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, k1, n, vec, s): group counts and shingles of the wanted sets, made anew from whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            out = []
            for i, k1, text in zip(pdf["id"], pdf["k1"], pdf["text"], strict=True):
                s = shingles(text, known, words)
                if (xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63) == k1:  # not another text of the same id
                    groups = np.bincount(((s >> np.uint64(40)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
                    out.append((i, k1, len(s), groups.astype(np.int32), np.sort(s.view(np.int64))))
            yield pd.DataFrame(out, columns=["id", "k1", "n", "vec", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return likely(texts, wanted, "id").join(wanted.select("id", "k1").distinct(), "id").mapInPandas(run, FULL).dropDuplicates(["id", "k1"])


def _families(met: DataFrame, name: str) -> DataFrame:
    """(`name`, family) from (`name`, lead): who shares a key with whom, also through others."""
    found = components(met.select(F.col(name).alias("u"), F.col("lead").alias("v")).distinct())
    return save(found.select(F.col("node").alias(name), F.col("component").alias("family")), "families")


def _met(keyed: DataFrame, name: str) -> DataFrame:
    """(key, `name`, lead) of the keys that several share; lead is the smallest of them."""
    shared = keyed.groupBy("key").agg(F.min(name).alias("lead"), F.max(name).alias("_last")).where("lead <> _last").select("key", "lead")
    return keyed.join(shared, "key").distinct()


def refined(inside: DataFrame, full: DataFrame, percent: int, level: int, larger: int) -> DataFrame:
    """inside (family, id, k1, label, ...) with large families split by keys of this level; who shares none has no link and goes.
    Members of one label are linked already and share their keys, so copies add no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [keys_of(np.asarray(s, np.int64).view(np.uint64), percent, level).view(np.int64) for s in pdf["s"]]
            yield pd.DataFrame({"label": pdf["label"], "family": pdf["family"], "keys": keys})

    sizes = inside.groupBy("family").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > larger).select("family")
    large, seen = observed(inside.join(sizes, "family", "left_semi"), "large", F.count(F.lit(1)).alias("n"))
    if not seen["n"]:
        return inside
    sent = large.select("id", "k1", "family", "label").join(full.select("id", "k1", "s"), ["id", "k1"]).select("label", "family", "s")
    keyed = sent.mapInPandas(run, "label long, family long, keys array<long>").select("label", "family", F.explode("keys").alias("_key"))
    keyed = save(keyed.select("label", F.xxhash64("family", "_key").alias("key")).distinct(), "keys")
    split = large.drop("family").join(_families(_met(keyed, "label"), "label"), "label").select(*inside.columns)
    return save(inside.join(sizes, "family", "left_anti").unionByName(split), "inside")


def overlap_needed(n, m, percent: int):
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def bound_test(percent: int):
    """Points against points: summed coordinate minima reach the overlap that a link needs."""

    def test(v: np.ndarray, others: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        return np.minimum(v, others).sum(axis=1) >= overlap_needed(n, m, percent)

    return test


def boxes(rows: DataFrame, by: str, corner: list[Column], *more: Column) -> DataFrame:
    """Sizes, labels and upper corner of each leaf or node."""
    return ranges(rows, by, F.array(*[F.max(c) for c in corner]).alias("hi"), *more)


def may_link(percent: int) -> Column:
    """Whether boxes a and b allow a link: the summed minima of their upper corners reach what their smallest sizes need."""
    minima = F.aggregate(F.zip_with("a.hi", "b.hi", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda total, x: total + x)
    return fits(percent) & (minima * (100 + percent) >= (F.col("a.n_lo") + F.col("b.n_lo")) * percent)


def tree_pairs(placed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of leaves that may hold links, by descending from pairs of nodes."""
    each = single(placed.join(full.select("id", "k1", "vec"), ["id", "k1"]), "vec")
    leaves = save(boxes(each, "block", [F.get("vec", i) for i in range(GROUPS)], F.first("node").alias("node")), "boxes")
    return descend(leaves, boxes(leaves, "node", [F.get("hi", i) for i in range(GROUPS)]), may_link(percent))


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n (distinct shingles), component_id (smallest doc_id reachable over links).

    Two documents are linked when 100 * common >= percent * all of their shingles. Documents without words link with
    nothing. A row without doc_id keeps its row and has no component. Rows that repeat a doc_id are one document, linked with
    whatever one of its texts is linked with. Empty tables give no rows; other columns don't matter.
    """
    if percent < 70:
        raise ValueError("size bands are cut for a similarity of 0.7 or more")
    sets = save(signatures(docs, words, percent), "sets")
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = save(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n")), "classes")
    placed = save(sets.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "id"), ["k1", "k2"], "left").select("doc_id", "n", "id"), "placed")

    entries = sets.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "k1")
    met = save(_met(entries, "k1"), "met")
    members = save(met.select("key", "k1").join(classes.select("k1", "id", "n"), "k1"), "members")
    place = members.groupBy("id", "k1").agg(F.min("n").alias("n"), F.min("key").alias("key"))
    inside = save(place.join(_families(met, "k1"), "k1").withColumn("label", F.col("id")), "inside")
    full = save(points(docs, inside, words), "points")

    several = placed.where("id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v").select("doc_id")
    known = placed.where("id IS NOT NULL").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    test = bound_test(percent)
    leaves = save(cut(inside, ["key"]), "leaves")
    per_family = leaves.groupBy("family", "block").agg(F.count(F.lit(1)).alias("m"))
    heads = per_family.groupBy("family").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("blocks"))
    start = per_family.join(heads, "family").select("family", "blocks", F.explode(F.array_distinct(F.array("block", "first"))).alias("a"), F.col("block").alias("b"))
    links = save(known.unionByName(block_links(start.select("a", "b"), leaves, full, test, percent)), "links")
    labels = save(components(links), "labels")

    large = heads.where("blocks > 1").select("family")
    rest = inside.drop("label").join(large, "family", "left_semi").join(labels, inside["id"] == labels["node"], "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")
    mixed = rest.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("family")
    rest, seen = observed(rest.join(mixed, "family", "left_semi"), "rest", F.count(F.lit(1)).alias("n"))
    if seen["n"]:
        for level, larger in LEVELS:
            rest = refined(rest, full, percent, level, larger)
        leaves = save(cut(rest, ["key"]), "leaves")
        pairs = save(tree_pairs(leaves, full, percent), "pairs")
        links = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(block_links(pairs, leaves, full, test, percent))
        labels = save(components(save(links, "links")), "labels")
    out = placed.join(labels, placed["id"] == labels["node"], "left")
    return out.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
