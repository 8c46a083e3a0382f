"""Ordered folds over groups of any length: rows are sorted by Spark and read once, group after group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _sorted(rows: DataFrame) -> DataFrame:
    """Each session's rows in one partition in position order; the sort spills, the fold holds one batch."""
    return rows.repartition("session_id").sortWithinPartitions("session_id", "pos")


def session_digests(rows: DataFrame) -> DataFrame:
    """(session_id, digest): SHA-256 of the parts of each session joined by newlines, from (session_id, pos, part)."""

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, empty = None, hashlib.sha256(), True
        for pdf in batches:
            out = []
            for session, part in zip(pdf["session_id"], pdf["part"], strict=True):
                if not empty and session != current:
                    out.append((current, state.hexdigest()))
                    state, empty = hashlib.sha256(), True
                if not empty:
                    state.update(b"\n")
                state.update(part.encode())
                current, empty = session, False
            yield pd.DataFrame(out, columns=["session_id", "digest"])
        if not empty:
            yield pd.DataFrame([(current, state.hexdigest())], columns=["session_id", "digest"])

    kind = rows.schema["session_id"].dataType.simpleString()
    return _sorted(rows.select("session_id", "pos", "part")).mapInPandas(feed, f"session_id {kind}, digest string")


def cut_table(costs: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Greedy packing of one block as a function of how full the open chunk is when the block begins.

    (limits, used, cuts, whole): the first cut comes at entry j if the open chunk holds more than limits[j], and no
    earlier entry's limit; the block then ends with used[j] in the open chunk after cuts[j] cuts. Below all
    limits nothing is cut and `whole` is added. Entries that no open chunk can reach are left out.
    """
    ends = np.cumsum(costs)
    begins = ends - costs
    n = len(costs)
    # The entry at which a chunk that starts at entry j is full; it holds one entry at least.
    after = np.maximum(np.searchsorted(ends, begins + room, side="right"), np.arange(n) + 1)
    used, cuts = ends[-1] - begins, np.zeros(n, np.int64)
    for j in range(n - 1, -1, -1):
        if after[j] < n:
            used[j], cuts[j] = used[after[j]], cuts[after[j]] + 1
    near = max(1, int(np.searchsorted(begins, room, side="right")))
    return (room - ends)[:near], used[:near], cuts[:near] + 1, int(ends[-1])


def block_entries(blocks: DataFrame) -> DataFrame:
    """(session_id, block, used, chunk): how full the open chunk is, and its number, where each block of a session begins, from
    (session_id, block, costs, room). Tables are made per block; only they are read in order."""
    kind = blocks.schema["session_id"].dataType.simpleString()

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [cut_table(np.asarray(c, np.int64), int(room)) for c, room in zip(pdf["costs"], pdf["room"], strict=True)]
            yield pd.DataFrame({"session_id": pdf["session_id"], "block": pdf["block"], "limits": [m[0] for m in made], "used": [m[1] for m in made], "cuts": [m[2] for m in made], "whole": [m[3] for m in made]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, chunk = None, 0, 0
        for pdf in batches:
            out = []
            for session, block, limits, after, cuts, whole in pdf.itertuples(index=False, name=None):
                if block == 0:
                    current, used, chunk = session, 0, 0
                out.append((session, block, used, chunk))
                # An empty chunk takes the first entry whatever it costs; that is what a cut there would leave, uncounted.
                j = int(np.searchsorted(-limits, -used, side="right")) if used else 0
                if j < len(limits):
                    used, chunk = int(after[j]), chunk + int(cuts[j]) - (0 if used else 1)
                else:
                    used += int(whole)
            yield pd.DataFrame(out, columns=["session_id", "block", "used", "chunk"])

    summed = blocks.mapInPandas(tables, f"session_id {kind}, block long, limits array<long>, used array<long>, cuts array<long>, whole long")
    return summed.repartition("session_id").sortWithinPartitions("session_id", "block").mapInPandas(fold, f"session_id {kind}, block long, used long, chunk long")
