"""Bigram language model by deleted interpolation, counted over the whole corpus.

Texts are read once. A task turns its documents into chunks: each distinct word gets a number inside the chunk,
documents become number sequences. Only distinct words and word pairs of a chunk leave it, as sorted hashes with
counts, dealt to shards by their leading bits; a shard adds up what chunks sent and answers each in the order it
asked. So what moves grows with distinct pairs per chunk, frequent words are summed before they move, and no task
holds more than a chunk or a shard.

Training documents are split again: the deleted part is left out of the estimates under which expectation-
maximisation fits the mixture weights, one set for each bucket of context frequency. The final scores use the
counts of all training documents with those weights.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureframe.llm.store import back_id, save, sent_id, split_count
from lureframe.llm.words import MIX, lowered, scramble

CHUNK_TOKENS = 2_000_000
SHARD_KEYS = 1_000_000
ADD = 0.1
BUCKETS = 34  # context counts 0, 1, 2-3, 4-7, ...
EM_TURNS = 60
START, END = 0, 1  # numbers in a chunk before its words
CHUNK = "chunk string, n_pairs long, n_words long, training long, deleted_tokens long, data binary"
ASK = "chunk string, shard int, keys binary, base binary, deleted binary"
ANSWER = "chunk string, shard int, base binary, deleted binary, total long, kinds long"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any kind in one compressed value; bytes of equal weight stand together, which compresses better."""
    parts = b"".join(b"%s %d\n" % (a.dtype.str.encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"%d\n" % len(arrays) + parts + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head, _, raw = raw.partition(b"\n")
    shapes = []
    for _ in range(int(head)):
        line, _, raw = raw.partition(b"\n")
        kind, n = line.split()
        shapes.append((np.dtype(kind.decode()), int(n)))
    out, at = [], 0
    for kind, n in shapes:
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


class Numbers(dict):
    """Word to its number in the chunk."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) + 2
        return value


def chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Documents as number sequences: part is 0 for held out, 1 for training, 2 for the deleted training part."""

    def close(rows: list, numbers: Numbers) -> pd.DataFrame:
        ids, part, lengths, tokens = zip(*rows, strict=True)
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        hashes = np.concatenate([np.array([xxhash.xxh3_64_intdigest(b" s"), xxhash.xxh3_64_intdigest(b" e")], np.uint64), words])
        sequence = np.concatenate(tokens)
        data = pack(np.array(ids, np.int64), np.array(part, np.uint8), np.array(lengths, np.uint32), sequence, hashes)
        training = sum(p > 0 for p in part)
        deleted = sum(n for p, n in zip(part, lengths, strict=True) if p == 2)
        return pd.DataFrame({"chunk": [uuid.uuid4().hex], "n_pairs": [len(sequence)], "n_words": [len(hashes)], "training": [training], "deleted_tokens": [deleted], "data": [data]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, numbers, size = [], Numbers(), 0
        for pdf in batches:
            for doc_id, part, text in zip(pdf["doc_id"], pdf["part"], pdf["text"], strict=True):
                words = lowered(text)
                sequence = np.empty(len(words) + 1, np.uint32)
                sequence[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                sequence[-1] = END
                rows.append((doc_id, part, len(sequence), sequence))
                size += len(sequence)
                if size >= chunk_tokens:
                    yield close(rows, numbers)
                    rows, numbers, size = [], Numbers(), 0
        if rows:
            yield close(rows, numbers)

    turn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    part = F.when(turn == 0, F.lit(0)).when(turn == 9, F.lit(2)).otherwise(F.lit(1)).cast("int")
    return docs.select(sent_id("doc_id"), part.alias("part"), F.col("text").cast("binary").alias("text")).mapInPandas(run, CHUNK)


class Chunk:
    """A chunk's sequences with, for each token, its document and the number of the word before it."""

    def __init__(self, data: bytes):
        self.ids, self.part, self.lengths, self.token, self.hashes = unpack(data)
        self.first = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.before = np.concatenate([[np.uint32(START)], self.token[:-1]]).astype(np.uint32)
        self.before[self.first] = START
        self.token_part = np.repeat(self.part, self.lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(order of the word numbers by hash, hashes in that order). START counts documents."""
        order = np.argsort(self.hashes)
        return order, self.hashes[order]

    def word_counts(self, part: int) -> np.ndarray:
        out = np.bincount(self.token[self.token_part == part], minlength=len(self.hashes)).astype(np.uint32)
        out[START] = (self.part == part).sum()
        return out

    def pairs(self, inverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(distinct pairs in order of their hash, hashes, place of each token's pair in that order)."""
        pair = self.before.astype(np.uint64) << np.uint64(32) | self.token
        distinct, place = np.unique(pair, return_inverse=True)
        h = scramble(self.hashes[(distinct >> np.uint64(32)).astype(np.int64)] * MIX + self.hashes[(distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        order = np.argsort(h)
        if inverse:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place]
        return distinct[order], h[order], place


def _counts(place: np.ndarray, parts: np.ndarray, part: int, n: int) -> np.ndarray:
    return np.bincount(place[parts == part], minlength=n).astype(np.uint32)


def asks(chunked: DataFrame, pairs: bool, shards: int) -> DataFrame:
    """What chunks ask of shards: sorted hashes as differences, and what they bring: counts by part."""
    bits = np.uint64(64 - (shards.bit_length() - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["chunk"], pdf["data"], strict=True):
                chunk = Chunk(data)
                if pairs:
                    _, keys, place = chunk.pairs(inverse=True)
                    base, deleted = (_counts(place, chunk.token_part, p, len(keys)) for p in (1, 2))
                else:
                    order, keys = chunk.words()
                    base, deleted = chunk.word_counts(1)[order], chunk.word_counts(2)[order]
                edges = np.searchsorted(keys, np.arange(shards, dtype=np.uint64) << bits) if shards > 1 else np.array([0])
                for shard, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
                    if hi > lo:
                        yield pd.DataFrame({"chunk": [name], "shard": [shard], "keys": [pack(np.diff(keys[lo:hi], prepend=np.uint64(0)))], "base": [pack(base[lo:hi])], "deleted": [pack(deleted[lo:hi])]})

    return chunked.select("chunk", "data").mapInPandas(run, ASK)


def answers(asked: DataFrame) -> DataFrame:
    """Corpus counts back to each chunk in the order of its keys; total and kinds (of the shard, in training) stand in
    the first row of a shard."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(k)[0], dtype=np.uint64) for k in pdf["keys"]]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([unpack(x)[0] for x in pdf[name]]), len(distinct)).astype(np.int64) for name in ("base", "deleted")]
        both = sums[0] + sums[1]
        edges = np.cumsum([0, *map(len, keys)])
        out = {"chunk": pdf["chunk"].tolist(), "shard": pdf["shard"].tolist(), "base": [], "deleted": []}
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for name, s in zip(("base", "deleted"), sums, strict=True):
                out[name].append(pack(s[place[lo:hi]].astype(np.uint64 if s.max(initial=0) >= 2**32 else np.uint32)))
        total, kinds = [0] * len(keys), [0] * len(keys)
        total[0], kinds[0] = int(both.sum()), int((both > 0).sum())
        return pd.DataFrame(out | {"total": total, "kinds": kinds})

    return asked.groupBy("shard").applyInPandas(run, ANSWER)


def _joined(answered: pd.DataFrame, order: np.ndarray | None, n: int) -> list[np.ndarray]:
    """Counts (base, deleted) by word number, or by place among the pairs."""
    part = answered.sort_values("shard")
    out = []
    for name in ("base", "deleted"):
        values = np.concatenate([unpack(x)[0].astype(np.int64) for x in part[name]]) if len(part) else np.zeros(0, np.int64)
        if order is not None:
            back = np.empty(n, np.int64)
            back[order] = values
            values = back
        out.append(values)
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each power of two."""
    return np.where(context > 0, np.minimum(np.frexp(np.maximum(context, 1).astype(float))[1], BUCKETS - 1), 0)


def fit_weights(histogram: np.ndarray, turns: int = EM_TURNS) -> np.ndarray:
    """Mixture weights (bucket; pair, word, uniform) from rows (bucket, pair bin, word bin, tokens).

    A bin is twice the log2 of the estimate over the uniform one, -1000 for an estimate of zero. Buckets without
    held-out tokens take the weights of the nearest lower bucket.
    """
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    known = weights[0] * [0, 1, 1] / 0.6
    for b in range(BUCKETS):
        rows = histogram[histogram[:, 0] == b]
        if not len(rows):
            weights[b] = known if b else weights[0] * [0, 1, 1] / 0.6
            continue
        odds = np.stack([np.where(rows[:, i] <= -1000, 0.0, 2.0 ** (rows[:, i] / 2)) for i in (1, 2)] + [np.ones(len(rows))], axis=1)
        w, n = np.array([0.4, 0.5, 0.1]) if b else np.array([0.0, 0.8, 0.2]), rows[:, 3].astype(float)
        for _ in range(turns):
            share = odds * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        w = np.maximum(w, [0, 0, 1e-4])  # a text may hold a word that no held-out text held
        weights[b] = known = w / w.sum()
    return weights


def score_corpus(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Null text counts as empty and scores its end token alone; a row without doc_id is trained on; repeated rows
    count and score as often as they occur; an empty table gives no rows.
    """
    chunked = save(chunks(docs, chunk_tokens), "chunks")
    sizes = chunked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_pairs", "training", "deleted_tokens")]).first()
    word_answers = save(answers(asks(chunked, False, split_count(sizes["n_words"], shard_keys))), "words")
    pair_answers = save(answers(asks(chunked, True, split_count(sizes["n_pairs"], shard_keys))), "pairs")
    whole = word_answers.agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    answered = word_answers.withColumn("pair", F.lit(0)).unionByName(pair_answers.withColumn("pair", F.lit(1))).select("chunk", "shard", "pair", "base", "deleted")
    # START is answered among the words but is no token: its count is that of the training documents.
    tokens, kinds = (whole["n"] or 0) - sizes["training"], max(0, (whole["v"] or 0) - (sizes["training"] > 0))
    base_tokens = max(1, tokens - sizes["deleted_tokens"])

    def ready(mine: pd.DataFrame, theirs: pd.DataFrame):
        chunk = Chunk(mine["data"].iloc[0])
        order, _ = chunk.words()
        words = _joined(theirs[theirs["pair"] == 0], order, len(chunk.hashes))
        _, keys, place = chunk.pairs(inverse=True)
        pairs = _joined(theirs[theirs["pair"] == 1], None, len(keys))
        return chunk, words, pairs, place

    def bins(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        chunk, words, pairs, place = ready(mine, theirs)
        at = chunk.token_part == 2
        word, pair, context = words[0][chunk.token[at]], pairs[0][place[at]], words[0][chunk.before[at]]
        with np.errstate(divide="ignore", invalid="ignore"):
            two = np.where(pair > 0, np.rint(2 * np.log2(pair / np.maximum(context, 1) * (kinds + 1))), -1000)
            one = np.where(word > 0, np.rint(2 * np.log2(word / base_tokens * (kinds + 1))), -1000)
        rows, n = np.unique(np.stack([bucket(context), two, one], axis=1).astype(np.int32), axis=0, return_counts=True)
        return pd.DataFrame({"bucket": rows[:, 0], "two": rows[:, 1], "one": rows[:, 2], "n": n})

    by_chunk = chunked.select("chunk", "data").groupBy("chunk").cogroup(answered.groupBy("chunk"))
    seen = by_chunk.applyInPandas(bins, "bucket int, two int, one int, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    # One row per bucket and pair of half-octave bins: bounded by the number of bins.
    weights = fit_weights(np.array([tuple(r) for r in seen.orderBy("bucket", "two", "one").collect()], np.int64).reshape(-1, 4))

    def scores(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        chunk, words, pairs, place = ready(mine, theirs)
        words, pairs = words[0] + words[1], pairs[0] + pairs[1]
        word, pair, context = words[chunk.token], pairs[place], words[chunk.before]
        w = weights[bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, tokens) + w[:, 2] / (kinds + 1)
        base = np.log10((words + ADD) / (tokens + ADD * (kinds + 1)))[chunk.token]
        add = lambda x: np.add.reduceat(x, chunk.first)
        return pd.DataFrame({
            "doc_id": chunk.ids, "held_out": chunk.part == 0, "n_tokens": chunk.lengths.astype(np.int64), "n_known": add((word > 0).astype(np.int64)),
            "train_tokens": np.full(len(chunk.ids), tokens, np.int64), "base_score": add(base), "score": add(np.log10(p)),
        })

    return back_id(by_chunk.applyInPandas(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "doc_id")

