"""Binary terminal recordings to frames. The only format Spark cannot read itself."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: record header (op, tty, length, direction, seconds, microseconds) ---
HEADER = struct.Struct("<iLiiLL")
OP_OPEN, OP_WRITE = 1, 3
OUTPUT, EXEC_INPUT = 2, 3
# --- end of fixed values ---
FRAME_DDL = "sha256 string, opened double, t double, data string, truncated boolean"


def _frames(raw: bytes) -> tuple[float | None, list[tuple[float, str]]]:
    opened, out, at = None, [], 0
    while at + HEADER.size <= len(raw):
        op, _, size, direction, sec, usec = HEADER.unpack_from(raw, at)
        body = raw[at + HEADER.size : at + HEADER.size + size]
        if size < 0 or len(body) < size:  # a torn tail
            break
        at += HEADER.size + size
        when = sec + usec / 1e6
        if op == OP_OPEN and opened is None:
            opened = when
        elif op == OP_WRITE and direction in (OUTPUT, EXEC_INPUT):
            shown = body.decode("utf-8", "replace")
            out.append((when, f"$ {shown}\r\n" if direction == EXEC_INPUT else shown))
    return opened, out


def _decode(batches: Iterator[pd.DataFrame], max_bytes: int | None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, content, length in zip(batch["sha256"], batch["content"], batch["length"], strict=True):
            opened, frames = _frames(bytes(content))
            # A recording without frames keeps one row, so that it is known to exist.
            rows += [(name, opened, t, d, max_bytes is not None and length > max_bytes) for t, d in frames or [(None, None)]]
        yield pd.DataFrame(rows, columns=["sha256", "opened", "t", "data", "truncated"])


def read_recordings(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One row per frame of every recording below `path`; files are named by their SHA-256.

    A `max_bytes` reads only the head of longer files and marks them truncated; without one files are read whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("sha256", F.regexp_extract("path", r"([^/]+)$", 1)).filter(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"))
    head = named.select("sha256", (F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)).alias("content"), "length")
    return head.mapInPandas(lambda batches: _decode(batches, max_bytes), FRAME_DDL)
