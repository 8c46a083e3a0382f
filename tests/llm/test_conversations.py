import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lureframe.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, pos int, kind string, fault boolean"


def damaged(rows):
    """Rows after damage, in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def best(rows):
    """Cheapest edits, ASCII-least, and the lines they make: all ways of editing, kept per state."""
    nxt = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    ways = {"": (0, "", ())}

    def keep(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def inserts(ways):
        for _ in range(4):
            for state, (cost, audit, lines) in list(ways.items()):
                role = nxt[state]
                keep(ways, role[0], (cost + 5, audit + "I", (*lines, role + ":")))
        return ways

    ways = inserts(ways)
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in ways.items():
            keep(after, state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                first = role[:1]
                if (first == "s" and state == "") or (first and first == nxt[state][0]):
                    keep(after, first, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                keep(after, nxt[state][0], (cost + 1 + more, audit + "R", (*lines, f"{nxt[state]}:{text}")))
        ways = inserts(after)
    return min((way[:2], way[2]) for state, way in ways.items() if state in ("", "a"))


def brute(rows):
    want, groups = {}, {conv: [] for conv, *_ in rows}
    for row in damaged(rows):
        groups[row[0]].append(row)
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in found:
            end = text.rstrip(C.SPACE)
            marked.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [r[1] for r in found if r[1] is not None]
        (cost, audit), lines = best(marked)
        count = lambda name: sum(f == name for *_, f in marked)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        want[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in C.repair(C.damage(df), df).collect()]
    assert {r[0]: r[1:] for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


TEXTS = ["Yes.", "No!", "so what?", "cut off", "", " \t\n", " ", None, "a.b", "Ende . \n", "é.", " "]
ROLES = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "u", "aXis", "User"]


def test_tables_find_the_cheapest_edits():
    rng, known = random.Random(4), C.tables()
    assert len(known.vectors) < 200
    for n in [*range(1, 14)] * 25:
        symbols = bytes(rng.randrange(C.SYMBOLS) for _ in range(n))
        rows = [("x", "t", "blank") if not s else (("system", "user", "assistant", "x")[(s - 1) // 2], "t", "truncated" if (s - 1) % 2 else None) for s in symbols]
        (cost, audit), _ = best(rows)
        matrix = known.matrix(symbols)
        edits, state = known.trace(symbols, C.END, 0)
        assert (min(matrix[j] + C.END[j] for j in range(4)), "".join(edits) + C.closing(state)) == (cost, audit)


def test_repair_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(conv if conv else None, rng.choice([None, *range(9)]) if conv % 3 else t, rng.choice(ROLES), rng.choice(TEXTS)) for conv in range(120) for t in range(rng.randrange(1, 12))]
    check(spark, rows + rows[:30])
    check(spark, [(7, None, "user", "x."), (7, None, "user", "x.")])


@pytest.mark.parametrize("chunk", [3, 64])
def test_chunks_of_a_long_conversation_fit_together(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(chunk)
    check(spark, [(1, t, rng.choice(ROLES), rng.choice([*TEXTS, f"text {t}."])) for t in range(400)] + [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(90)])


def test_all_rows_lost_and_empty_table(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "gone.", 1, "x", True)], SCHEMA)
    got = [tuple(r) for r in C.repair(C.damage(df), df).collect()]
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damage(df), df.limit(0)).count() == 0 and C.repair(C.damage(df.limit(0)), df.limit(0)).count() == 0


def test_very_long_texts(spark):
    check(spark, [(1, 0, "user", "x" * 200_000 + "."), (1, 1, "assistant", "y " * 100_000), (1, 2, "user", " " * 100_000)])
