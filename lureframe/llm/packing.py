"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Tokens are counted where the text is; only one small row per piece moves. The histogram has at most `width`
lengths, so its packing is a bounded driver computation at any corpus size. Pieces of a length are ranked by
distributed prefix counts (length, salt), and a rank finds its sequence in the sorted slots of its length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureframe.llm.store import back_id, save, sent_id, split_count

WIDTH = 2048
END = 1
RANK_ROWS = 2_000
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


@cache
def _encoder(vocabulary: str):
    """Encodes with the ranks of the vocabulary file: the same ids as its tokenizers file, several times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoded(dict):
    """Ids of ' ' + word as little-endian bytes; the first `most` words are remembered, so memory is bounded."""

    most = 300_000

    def __init__(self, vocabulary: str):
        super().__init__()
        self.encode = _encoder(vocabulary).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        value = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) < self.most:
            self[word] = value
        return value


#: The vocabulary's splitter starts a new unit at every space, but for a space inside or at the end of longer white space.
INNER_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Longer stretches without a space go to the encoder as they are and are not remembered.
LONG_WORD = 64


def token_bytes(text: str, known: Encoded) -> bytes:
    """All ids of a text, four bytes each. Cut at spaces so that repeated words are encoded once."""
    if INNER_SPACE.search(text):
        return np.array(known.encode(text), "<u4").tobytes()
    first, *rest = text.split(" ")
    head = np.array(known.encode(first), "<u4").tobytes()
    return head + b"".join([known[w] if len(w) < LONG_WORD else np.array(known.encode(" " + w), "<u4").tobytes() for w in rest])


def pieces(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece of at most width ids: doc_id, start, length, ids_crc32, doc_tokens.

    A document is its text's ids and one end id; null text counts as empty, so every document has a piece. Cuts
    lie at multiples of width.
    """
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Encoded(vocabulary)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = memoryview((token_bytes(text, known) if text else b"") + end)
                total = len(data) // 4
                for start in range(0, total, width):
                    part = data[4 * start : 4 * (start + width)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return back_id(docs.select(sent_id("doc_id"), "text").mapInPandas(cut, PIECES), "doc_id")


def shortest_pack_first(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in one of them): lengths are placed longest first, each into the packs with
    the most room; a group of equal packs is split where fewer are needed."""
    heap: list[tuple[int, int, int, tuple]] = []  # -(room), age, packs, lengths as a linked list
    age = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, _, packs, parts = heapq.heappop(heap)
                if packs > left:
                    heapq.heappush(heap, (room, age := age + 1, packs - left, parts))
                    packs = left
                heapq.heappush(heap, (room + length, age := age + 1, packs, (length, parts)))
                left -= packs
            else:
                heapq.heappush(heap, (-(width - length), age := age + 1, left, (length, ())))
                left = 0
    out = []
    for _, _, packs, parts in sorted(heap, key=lambda x: x[1]):
        lengths = []
        while parts:
            lengths.append(parts[0])
            parts = parts[1]
        out.append((packs, tuple(reversed(lengths))))
    return out


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence, offset in a sequence, copies of the length in one sequence."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for packs, lengths in patterns:
        offset = 0
        for length in lengths:
            found.setdefault(length, []).append((packs, base, offset))
            offset += length
        base += packs
    out = {}
    for length, runs in found.items():
        packs, bases, offsets = (np.array(x, np.int64) for x in zip(*runs, strict=True))
        out[length] = (np.cumsum(packs) - packs, bases, offsets)
    return out


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """Number the pieces of each length from 0 without gathering a length in one task."""
    order = ("doc_id", "start", "ids_crc32")
    rows = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = rows.groupBy(F.col("length").alias("_l"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_l", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    rows = rows.join(counts, (rows["length"] == counts["_l"]) & (rows["_salt"] == counts["_s"]))
    return rows.withColumn("_rank", F.col("_in") + F.col("_before")).drop("_salt", "_l", "_s", "_in", "_before")


def pack(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most width ids and have no gaps. Repeated rows are packed as often as they occur; null
    text packs its end id only; an empty table gives no rows. Other columns are not read.
    """
    cut = save(pieces(docs, width, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most width rows
    table = cut.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, width)))
    schema = f"{PIECES}, sequence_id long, offset long"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length, at in pdf.groupby("length").indices.items():
                first, base, within = table.value[int(length)]
                rank = pdf["_rank"].to_numpy()[at]
                run = np.searchsorted(first, rank, side="right") - 1
                sequence[at], offset[at] = base[run] + rank - first[run], within[run]
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    most = max(histogram.values(), default=0)
    # Parts of rank_rows, or of the root of a length's pieces if that is more.
    out = ranked(cut, split_count(most, max(rank_rows, int(most**0.5))))
    return back_id(out.select(sent_id("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInPandas(place, schema), "doc_id")
