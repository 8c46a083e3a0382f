"""Exact duplicates through a sharded cuckoo-filter index of live digests.

Digests are spread over shards by their hash; a shard is one row set of keys (the bucketed content) and one
cuckoo filter. A batch is first combined inside its input tasks, so a digest that a third of the rows share
reaches its shard as one row per input batch. In the shard the filter answers first: a miss is a new key, a hit
is verified against the keys of its bucket, and only equal digests merge. When a filter overflows it is rebuilt
with twice the buckets from the shard's stored keys. Digests can be deleted; a digest leaves the filter when its
last row is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureframe.llm.store import back_id, save, sent_id, split_count

SLOTS = 4
MAX_ROUNDS = 64
SHARD_ROWS = 200_000
LAST_ID = 2**63 - 1  # rows without an id come after all others
STATE = "shard int, sha string, h long, keep_id long, rows long, filter binary"
ENTRY = "shard int, sha string, h long, first_id long, rows long"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each has two possible buckets, either found from the other."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = h & self.mask
        return fp, first, self._other(fp, first)

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.uint64) * np.uint64(0x5BD1E995) + np.uint64(0x9E37)) & self.mask)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(h)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)

    def insert(self, h: np.ndarray) -> bool:
        """Add all; False on overflow, and then the filter must be rebuilt from the stored keys."""
        fp, at, other = self._places(h)
        rng = np.random.default_rng(len(h))
        for turn in range(MAX_ROUNDS):
            order = np.argsort(at, kind="stable")
            fp, at, other = fp[order], at[order], other[order]
            start = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            free = self.table[at] == 0
            fits = place < free.sum(axis=1)
            slot = np.argmax(np.cumsum(free, axis=1) == (place + 1)[:, None], axis=1)
            self.table[at[fits], slot[fits]] = fp[fits]
            fp, at, other, place = fp[~fits], at[~fits], other[~fits], place[~fits]
            if not len(fp):
                return True
            if turn == 0:
                at, other = other, at  # try the second bucket before pushing anything out
                continue
            # One newcomer a bucket takes a random slot; what it pushes out goes to its own other bucket.
            first = np.r_[True, at[1:] != at[:-1]]
            full = first & (self.table[at] != 0).all(axis=1)
            where, pick = at[full], rng.integers(0, SLOTS, int(full.sum()))
            out = self.table[where, pick]
            self.table[where, pick] = fp[full]
            fp[full] = out
            at[full] = self._other(out, where)
            at[~full] = self._other(fp[~full], at[~full])
            other = self._other(fp, at)
        return False

    def delete(self, h: int) -> None:
        """Take out one copy; the caller has verified that the digest is live."""
        fp, a, b = self._places(np.array([h], np.uint64))
        for bucket in (int(a[0]), int(b[0])):
            found = np.flatnonzero(self.table[bucket] == fp[0])
            if len(found):
                self.table[bucket, found[0]] = 0
                return


class Shard:
    """Stored keys of a shard, bucketed by hash, behind their filter."""

    def __init__(self, stored: pd.DataFrame):
        keys = stored[stored["sha"].notna()]
        self.sha, self.h = keys["sha"].tolist(), keys["h"].astype("int64").tolist()
        self.keep = keys["keep_id"].astype("int64").tolist()
        self.rows = keys["rows"].astype("int64").tolist()
        self.bucket: dict[int, list[int]] = {}
        for i, h in enumerate(self.h):
            self.bucket.setdefault(h, []).append(i)
        saved = stored.loc[stored["filter"].notna(), "filter"]
        self.filter = CuckooFilter.load(saved.iloc[0]) if len(saved) else CuckooFilter(1024)

    def live(self) -> np.ndarray:
        return np.array([h for h, n in zip(self.h, self.rows, strict=True) if n > 0], np.int64).view(np.uint64)

    def resize(self) -> None:
        self.filter = CuckooFilter(2 * len(self.filter.table))
        while not self.filter.insert(self.live()):
            self.filter = CuckooFilter(2 * len(self.filter.table))

    def find(self, sha: str, h: int) -> int | None:
        return next((i for i in self.bucket.get(h, ()) if self.sha[i] == sha and self.rows[i] > 0), None)

    def add(self, batch: pd.DataFrame) -> None:
        batch = batch.groupby(["sha", "h"], sort=False, as_index=False).agg({"first_id": "min", "rows": "sum"})
        h = batch["h"].to_numpy(np.int64)
        maybe = self.filter.contains(h.view(np.uint64))
        fresh = []
        for sha, hh, first, n, hit in zip(batch["sha"], h.tolist(), batch["first_id"], batch["rows"], maybe, strict=True):
            at = self.find(sha, hh) if hit else None  # a miss is surely new; a hit may be a false one
            if at is None:
                self.bucket.setdefault(hh, []).append(len(self.sha))
                self.sha.append(sha), self.h.append(hh), self.keep.append(int(first)), self.rows.append(int(n))
                fresh.append(hh)
            else:
                self.rows[at] += int(n)
                self.keep[at] = min(self.keep[at], int(first))
        if fresh:
            load = len(self.bucket) / (len(self.filter.table) * SLOTS)
            if load > 0.9 or not self.filter.insert(np.array(fresh, np.int64).view(np.uint64)):
                self.resize()

    def remove(self, batch: pd.DataFrame) -> None:
        h = batch["h"].to_numpy(np.int64)
        maybe = self.filter.contains(h.view(np.uint64))
        for sha, hh, n, hit in zip(batch["sha"], h.tolist(), batch["rows"], maybe, strict=True):
            at = self.find(sha, hh) if hit else None
            if at is not None:
                self.rows[at] = max(0, self.rows[at] - int(n))
                if self.rows[at] == 0:
                    self.filter.delete(hh % 2**64)

    def stored(self, shard: int) -> pd.DataFrame:
        alive = [i for i, n in enumerate(self.rows) if n > 0]
        pick = lambda xs: [xs[i] for i in alive]
        return pd.DataFrame({
            "shard": shard, "sha": [*pick(self.sha), None], "h": [*pick(self.h), 0], "keep_id": [*pick(self.keep), LAST_ID],
            "rows": [*pick(self.rows), 0], "filter": [*[None] * len(alive), self.filter.dump()],
        })


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each text with every run of white space made one space; null counts as empty."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"))


def combine(digest_rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest and input batch: its shard, smallest doc_id and number of rows."""

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grouped = pdf.groupby(["shard", "sha", "h"], sort=False)
            yield pd.DataFrame({"first_id": grouped["doc_id"].agg("min"), "rows": grouped.size().astype("int64")}).reset_index()[["shard", "sha", "h", "first_id", "rows"]]

    h = F.xxhash64("sha")
    keyed = digest_rows.select(F.pmod(F.shiftright(h, 20), F.lit(shards)).cast("int").alias("shard"), "sha", h.alias("h"), sent_id("doc_id", LAST_ID))
    return keyed.mapInPandas(within, ENTRY)


def update(state: DataFrame | None, entries: DataFrame, delete: bool = False) -> DataFrame:
    """The index after inserting (or deleting) combined entries: rows of keys, and one filter row per shard."""
    if state is None:
        state = entries.sparkSession.createDataFrame([], STATE)

    def change(key, stored: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(stored)
        for at in range(0, len(batch), 16_384):
            (shard.remove if delete else shard.add)(batch.iloc[at : at + 16_384])
        return shard.stored(int(key[0]))

    return state.groupBy("shard").cogroup(entries.groupBy("shard")).applyInPandas(change, STATE)


def keys(state: DataFrame) -> DataFrame:
    return back_id(state.where(F.col("sha").isNotNull()).select("sha", "keep_id", "rows"), "keep_id", LAST_ID)


def exact_groups(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per document: doc_id, sha, keep_id (smallest doc_id of its equal texts), rows (of the group).

    Null doc_ids count in their group and come after all others for keep_id. Repeated rows of one doc_id stay
    separate rows with the same values. An empty table gives no rows. Other columns are not read.
    """
    rows = save(digests(docs), "digests")
    shards = split_count(rows.count(), shard_rows, 8)
    index = save(update(None, combine(rows, shards)), "cuckoo")
    return rows.join(keys(index), "sha").select("doc_id", "sha", "keep_id", "rows")


def drop_copies(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs without copies: of equal texts the row with the smallest doc_id stays, with all its columns.

    Rows that repeat both doc_id and text count as one document; the first of them by all columns' hash stays.
    """
    sha, winner = "_llm_sha", "_llm_keep"
    groups = exact_groups(docs, shard_rows)
    owners = groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("doc_id").alias(winner), F.col("sha").alias(sha)).agg(F.count(F.lit(1)).alias("_llm_n"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    marked = docs.withColumn("_llm_own", F.sha2(text.cast("binary"), 256))
    kept = marked.join(owners, marked["doc_id"].cast("long").eqNullSafe(owners[winner]) & (marked["_llm_own"] == owners[sha]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.where("_llm_n = 1").select(*columns)
    again = kept.where("_llm_n > 1").dropDuplicates([winner, sha]).select(*columns)
    return once.unionByName(again)
