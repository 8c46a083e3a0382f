"""Conversation structure repair: cheapest edits by Four-Russians block tables.

A conversation is a string over nine symbols (a row that must go; four kinds of role, each whole or truncated). What
the rest of a conversation costs from each of four states of the pattern `(s?(ua)+)?` is a vector; less its smallest
entry it is one of a few dozen normalised vectors. The tables hold, for every normalised vector and every block of
BLOCK symbols, the vector before the block and what the block adds to its smallest entry, so a block is one look-up.

Look-ups run from the end of a conversation to its start, and tracing expands the blocks in the opposite direction:
edits come in reading order, where the ASCII-least of the cheapest audits is a choice of the least letter at each edit.

A conversation of any length is cut into chunks of CHUNK rows. A chunk is a (min, +) matrix of four by four, found
from four unit vectors; a fold over these small matrices gives the vector at each chunk's end; each chunk then traces
itself from all four states, and a second fold picks the traces that fit together. Only digests read rows in order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.functions.ordered import number_rows
from lureframe.llm.store import save

#: Symbols looked up at once.
BLOCK = 4
#: Rows of a conversation that one task row holds.
CHUNK = 4_096
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACE = " \t\n\x0b\x0c\r"
#: Symbol 0 must be deleted; 1 + 2 * kind + truncated for roles that begin with s, u, a or anything else.
KINDS = "sua"
SYMBOLS = 9
#: States: nothing yet, after s, after u, after a. User or assistant, whichever the pattern allows, leads to NEXT.
NEXT = (2, 2, 3, 2)
KEEPS = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
FAR = 1 << 40
#: Costs after the last row: the empty conversation and one that ends with an assistant are whole.
END = (0, 2 * INSERT, INSERT, 0)


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what a row allows, in ASCII order of the letters."""
    out = [("D", DELETE, state)]
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        if state in KEEPS[kind]:
            out.append(("K", TRUNCATED * cut, KEEPS[kind][state]))
        out.append(("R", REROLE + TRUNCATED * cut, NEXT[state]))
    return out


def before(after: tuple[int, ...], symbol: int) -> list[int]:
    """Costs before a row, inserts in front of it included, from the costs after it."""
    cost = [min(c + after[to] for _, c, to in moves(symbol, i)) for i in range(4)]
    for _ in range(3):
        cost = [min(cost[i], INSERT + cost[NEXT[i]]) for i in range(4)]
    return [min(c, FAR) for c in cost]


def normalised(vector) -> tuple[tuple[int, ...], int]:
    least = min(vector)
    return tuple(FAR if v >= FAR else int(v) - least for v in vector), int(least)


class Tables:
    """vectors; step[v, symbol] and block[v, block code] give (vector before, added cost); edits[v][symbol][state] gives
    (letters, next state) of the ASCII-least cheapest edits of one row with vector v after it."""

    def __init__(self) -> None:
        units = [tuple(0 if i == j else FAR for i in range(4)) for j in range(4)]
        self.vectors = [*units, normalised(END)[0]]
        self.ids = {v: k for k, v in enumerate(self.vectors)}
        to, add = [], []
        for v in self.vectors:  # grows while new vectors turn up
            row = [normalised(before(v, s)) for s in range(SYMBOLS)]
            for vector, _ in row:
                if vector not in self.ids:
                    self.ids[vector] = len(self.vectors)
                    self.vectors.append(vector)
            to.append([self.ids[vector] for vector, _ in row]), add.append([least for _, least in row])
        self.step, self.added = np.array(to), np.array(add)
        block, cost = self.step, self.added
        for _ in range(BLOCK - 1):  # one more symbol in front: code = symbol * SYMBOLS^k + code of the rest
            first = [(self.step[block, s], cost + self.added[block, s]) for s in range(SYMBOLS)]
            block, cost = (np.concatenate([x[i] for x in first], axis=1) for i in (0, 1))
        self.block, self.cost = block.tolist(), cost.tolist()
        self.step, self.added = self.step.tolist(), self.added.tolist()
        self.edits = [[[self._edit(v, s, i) for i in range(4)] for s in range(SYMBOLS)] for v in self.vectors]

    def _edit(self, after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
        costs, letters = before(after, symbol), ""
        while costs[state] < FAR:
            ways = [(x, c + after[to], to) for x, c, to in moves(symbol, state)]
            ways.insert(1, ("I", INSERT + costs[NEXT[state]], -1))
            letter, _, to = next(w for w in ways if w[1] == costs[state])
            letters += letter
            if letter != "I":
                return letters, to
            state = NEXT[state]
        return "", state

    def lookups(self, symbols: bytes, v: int) -> tuple[list[int], int]:
        """Vectors behind each block, from the last block to the first, then the one at the start; and the cost added."""
        seen, total, at = [v], 0, len(symbols)
        while at >= BLOCK:
            code = 0
            for s in symbols[at - BLOCK : at]:
                code = code * SYMBOLS + s
            total += self.cost[v][code]
            v = self.block[v][code]
            seen.append(v)
            at -= BLOCK
        for s in symbols[:at][::-1]:  # the rest in front of the first whole block
            total += self.added[v][s]
            v = self.step[v][s]
        return [*seen, v], total

    def matrix(self, symbols: bytes) -> list[int]:
        """Costs from each state at the start (rows) to each state at the end."""
        lanes = [self.lookups(symbols, j) for j in range(4)]
        return [min(self.vectors[seen[-1]][i] + total, FAR) for i in range(4) for seen, total in lanes]

    def trace(self, symbols: bytes, end: tuple[int, ...], state: int) -> tuple[list[str], int]:
        """Letters of each row's edits from `state` on, and the state after the last row."""
        v = self.ids[normalised(end)[0]]
        behind, _ = self.lookups(symbols, v)
        at, out = len(symbols) % BLOCK, []
        spans = [(0, at), *((k, k + BLOCK) for k in range(at, len(symbols), BLOCK))]
        for (lo, hi), v in zip(spans, behind[-2::-1], strict=True):
            inside = [v]
            for s in symbols[lo + 1 : hi][::-1]:
                inside.append(self.step[inside[-1]][s])
            for s, after in zip(symbols[lo:hi], inside[::-1], strict=False):
                letters, state = self.edits[after][s][state]
                out.append(letters)
        return out, state


@functools.cache
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """Inserts that are missing after the last row."""
    return "I" * (END[state] // INSERT)


def damage(rows: DataFrame) -> DataFrame:
    """conversations with the faults of this exercise: by crc32 of `conv_id:turn` modulo 20 a row goes (0), loses its
    text (1) or its full stops (2), comes twice (3) or gets the role user (4). Nulls count as one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    plain = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fate") == 3, 2).otherwise(1)))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy")


def _key(column: str = "conv_id") -> Column:
    """Equal for equal ids, null among them, and never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn, role, text, fault, kind, symbol): position in the conversation by turn (nulls first; ties by role, then text)
    and the first fault of each row: blank, duplicate (role and text came earlier) or truncated."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.instr(F.lit(KINDS), F.substring("role", 1, 1))
    kind = F.when((kind > 0) & (F.col("role") != ""), kind - 1).otherwise(3)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    plain = rows.select(_key().alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    seen = plain.select("*", kind.alias("kind"), end.eqNullSafe("").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), same.alias("same"))
    placed = save(number_rows(seen, ["conv"], "turn", ["role", "text"]), "placed")
    first = placed.groupBy("conv", "same").agg(F.min("pos").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    out = placed.join(first, ["conv", "same"]).withColumn("fault", fault)
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    symbol = F.when(gone, 0).otherwise(1 + 2 * F.col("kind") + F.col("fault").isNotNull().cast("int"))
    return out.select("conv", "pos", "turn", "role", "text", "fault", "kind", symbol.alias("symbol"))


def _chunks(rows: DataFrame) -> DataFrame:
    """(conv, chunk, symbols, kinds, matrix): at most CHUNK rows as strings of digits, and the chunk's matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = tables()
        for pdf in batches:
            pdf["matrix"] = [known.matrix(_digits(s)) for s in pdf["symbols"]]
            yield pdf

    listed = F.array_sort(F.collect_list(F.struct("pos", "symbol", "kind")))
    digits = lambda name: F.array_join(F.transform("rows", lambda r: r[name].cast("string")), "").alias(name + "s")
    made = rows.groupBy("conv", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(listed.alias("rows")).select("conv", "chunk", digits("symbol"), digits("kind"))
    return made.mapInPandas(run, "conv string, chunk long, symbols string, kinds string, matrix array<long>")


def _digits(text: str) -> bytes:
    return text.encode().translate(bytes((c - 48) % 256 for c in range(256)))


def _in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows of one conversation in one partition, in order; the sort spills, a fold holds one batch."""
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _ends(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, symbols, ahead, cost, last): the costs after each chunk; a conversation's cost beside its first chunk."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, ahead = None, END
        for pdf in batches:
            out = []
            for key, chunk, matrix in zip(pdf["conv"], pdf["chunk"], pdf["matrix"], strict=True):
                last = key != conv
                conv, ahead = key, END if last else ahead
                start = [min(min(matrix[4 * i + j] + ahead[j] for j in range(4)), FAR) for i in range(4)]
                out.append((ahead, start[0] if chunk == 0 else -1, last))
                ahead = tuple(int(v) for v in start)
            made = pdf[["conv", "chunk", "symbols"]].copy()
            made[["ahead", "cost", "last"]] = pd.DataFrame(out, columns=["ahead", "cost", "last"], index=made.index)
            yield made

    return _in_order(chunks.select("conv", "chunk", "symbols", "matrix"), F.desc("chunk")).mapInPandas(fold, "conv string, chunk long, symbols string, ahead array<long>, cost long, last boolean")


def _traces(ends: DataFrame) -> DataFrame:
    """(conv, chunk, cost, ways): per state at the chunk's start the state at its end and the edits of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = tables()
        for pdf in batches:
            out = []
            for symbols, chunk, ahead, last in zip(pdf["symbols"], pdf["chunk"], pdf["ahead"], pdf["last"], strict=True):
                ways = []
                for state in range(4 if chunk else 1):
                    edits, to = known.trace(_digits(symbols), tuple(int(v) for v in ahead), state)
                    ways.append(f"{to}," + ",".join([*edits, closing(to)] if last else edits))
                out.append(ways)
            made = pdf[["conv", "chunk", "cost"]].copy()
            made["ways"] = out
            yield made

    return ends.mapInPandas(run, "conv string, chunk long, cost long, ways array<string>")


def _chosen(traces: DataFrame) -> DataFrame:
    """(conv, chunk, cost, edits): the edits of each row of the chunk, from the state that the chunk before ends in."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, 0
        for pdf in batches:
            out = []
            for key, ways in zip(pdf["conv"], pdf["ways"], strict=True):
                conv, state = key, state if key == conv else 0
                to, _, edits = ways[state].partition(",")
                state = int(to)
                out.append(edits)
            made = pdf[["conv", "chunk", "cost"]].copy()
            made["edits"] = out
            yield made

    return _in_order(traces, "chunk").mapInPandas(fold, "conv string, chunk long, cost long, edits string")


def edits(rows: DataFrame) -> DataFrame:
    """(conv, chunk, cost, edits): the ASCII-least cheapest edits, a list of letters per row, from rows of `faults`."""
    return _chosen(_traces(_ends(_chunks(rows))))


def repaired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, pos, edit, role, text): what stays of each row; edit holds the letters of the inserts in front of it, too.
    Inserts at the very end have a row of their own without text."""
    each = chosen.select("conv", F.posexplode(F.split("edits", ",")).alias("at", "edit"), "chunk")
    each = each.select("conv", (F.col("chunk") * CHUNK + F.col("at")).alias("pos"), "edit").where("edit <> 'D' AND edit <> ''")
    return each.join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left")


def _digests(lines: DataFrame) -> DataFrame:
    """(conv, sha): SHA-256 of the repaired lines `role:text`, read once in order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, count, role = None, hashlib.sha256(), 0, 0
        for pdf in batches:
            out = []
            for key, edit, own, text in zip(pdf["conv"], pdf["edit"], pdf["role"], pdf["text"], strict=True):
                if conv is not None and key != conv:
                    out.append((conv, state.hexdigest()))
                    state, count, role = hashlib.sha256(), 0, 0
                conv = key
                for letter in edit:
                    if letter == "D":
                        continue
                    role = KEEPS[KINDS.index(own[0])][role] if letter == "K" else NEXT[role]
                    name = own if letter == "K" else ("user", "assistant")[role - 2]
                    state.update((("\n" if count else "") + name + ":" + ("" if letter == "I" else text)).encode())
                    count += 1
            yield pd.DataFrame(out, columns=["conv", "sha"])
        if conv is not None:
            yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "sha"])

    return _in_order(lines, "pos").mapInPandas(fold, "conv string, sha string")


def _illegal(chunks: DataFrame) -> DataFrame:
    """(conv, illegal): neighbours whose roles don't begin with su, ua or au; neighbours across chunks meet by number."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("kinds") - 1), lambda i: F.substring("kinds", i, 2))
    wrong = F.when(F.length("kinds") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("01", "12", "21")))).otherwise(0)
    inside = chunks.select("conv", wrong.cast("long").alias("n"))
    left = chunks.select("conv", (F.col("chunk") + 1).alias("chunk"), F.substring("kinds", -1, 1).alias("l")).join(chunks.select("conv", "chunk", F.substring("kinds", 1, 1).alias("r")), ["conv", "chunk"])
    across = left.select("conv", (~F.concat("l", "r").isin("01", "12", "21")).cast("long").alias("n"))
    return inside.unionByName(across).groupBy("conv").agg(F.sum("n").alias("illegal"))


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: faults, gaps in the turns, the cheapest edits to `(s?(ua)+)?` and a digest of what they make.

    rows holds conv_id, turn, role, text; `ids` any further conv_id that a row is wanted for. A null conv_id is one
    conversation, a null role or text one space. A conversation without rows has zeros, an empty audit and the digest
    of the empty text; an empty table gives no rows. Rows of one turn go by role, then text. Other columns don't matter.
    """
    placed = save(faults(rows), "faults")
    chunks = save(_chunks(placed), "chunks")
    chosen = save(_chosen(_traces(_ends(chunks))), "edits")
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    facts = placed.groupBy("conv").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.translate("edits", ",", "").alias("audit"))))
    audits = chosen.groupBy("conv").agg(F.max("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    named = rows.select("conv_id") if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))
    out = named.distinct().withColumn("conv", _key())
    for part in (facts, _illegal(chunks), audits, _digests(repaired(placed, chosen))):
        out = out.join(part, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
