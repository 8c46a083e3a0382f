"""Personal data by weak supervision, with DataFrame functions only.

Strict patterns give the base spans; they and looser patterns give the candidates. Labelers vote on every
candidate: the pattern's own check, gazetteers, words around it, its shape, its edges. The votes of the corpus
form a histogram of at most a few thousand rows (labelers to the power of three votes), on which
expectation-maximisation estimates how far each labeler is to be trusted, and on whose soft labels a logistic
span classifier is trained. The classifier goes back into the plan as one expression; candidates that it
accepts are added to the base spans.

Positions: a pattern cuts a text into gaps and matches, so a running sum of their lengths inside the document
gives every match its place in code points. Texts are read once, and only candidates move.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureframe.llm.store import save

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
AROUND = 40
EM_TURNS = 40

# The base patterns are those of the contract. Runs are entered only at their start (or where the last match ended)
# and repeated without giving back, which finds the same matches in linear time on any text.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of these have no candidate of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_NEEDS = {"email": r"(?:\[at\]|\(at\)|\{at\})", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io co me uk de fr es it nl ch at be pl se no dk fi ie pt eu us ca au nz jp cn in br mx ru".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 354 358".split()
CARDS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|64|65|62|35)"
NEAR = {
    "email": ("e-?mail|mail|contact|write to|reach", "import|decorator|package"),
    "ip": (r"\bip\b|address|host|server|login|from", "version|release|section|chapter|build"),
    "card": ("card|visa|master|amex|credit|debit|payment", "isbn|order|tracking|serial|invoice"),
    "phone": ("phone|tel|call|mobile|cell|fax|dial|whatsapp", "isbn|order|serial|version|account"),
}
LABELERS = ("check", "gazetteer", "context", "shape", "edges")


def _pieces(text: Column, kind: str, pattern: str, needs: str, base: bool) -> Column:
    """Array of (kind, base, i, gap, lead, tail, m): the text before each match and the match; the last has none."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    made = F.transform(zipped, lambda z, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), i.alias("i"), F.length(z["p"]).alias("gap"),
        F.left(z["p"], F.lit(AROUND)).alias("lead"), F.right(z["p"], F.lit(AROUND)).alias("tail"), z["m"].alias("m"),
    ))
    found = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
    return F.when(found, made).otherwise(F.array().cast(_PIECES))


_PIECES = "array<struct<kind:int,base:boolean,i:int,gap:int,lead:string,tail:string,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    step = lambda acc, i: acc + F.when(i % 2 == 0, F.pmod(digit(i) * 2 - 1, F.lit(9)) + 1 - F.when(digit(i) == 0, F.lit(9)).otherwise(F.lit(0))).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    """Whether a base match passes its kind's check."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.length(_digits(m))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, m.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == 2, n.between(13, 19) & F.when(n.between(13, 19), luhn(m)).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, m, base, strict, votes...) for every candidate; a row with null kind for a
    document without any. `row` numbers the input rows within this relation."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    parts = [_pieces(text, k, BASE[k], NEEDS[k], True) for k in KINDS] + [_pieces(text, k, LOOSE[k], LOOSE_NEEDS[k], False) for k in LOOSE]
    cut = rows.select("row", "doc_id", F.explode_outer(F.concat(*parts)).alias("c")).select("row", "doc_id", "c.*")
    # A document's pieces of one pattern in order; documents without pieces pass through alone.
    order = Window.partitionBy("row", "kind", "base").orderBy("i")
    end = F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(order)
    placed = cut.withColumn("end", end.cast("long")).withColumn("after", F.coalesce(F.lead("lead").over(order), F.lit("")))
    placed = placed.where(F.col("kind").isNull() | F.col("m").isNotNull() | (F.col("i") == 0))
    placed = placed.withColumn("kind", F.when(F.col("m").isNotNull(), F.col("kind")))
    placed = placed.withColumn("start", F.col("end") - F.length("m"))
    strict = F.coalesce(F.col("base") & _valid(F.col("kind"), F.col("m")), F.lit(False))
    return placed.select("row", "doc_id", "kind", "start", "end", "m", F.col("base").alias("pattern"), strict.alias("strict"), *_votes())


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _by_kind(*values: Column) -> Column:
    return reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), enumerate(values), F.when(F.lit(False), F.lit(0)))


def _votes() -> list[Column]:
    kind, m, before, after = F.col("kind"), F.col("m"), F.lower("tail"), F.lower("after")
    digits = _digits(m)
    n = F.length(digits)
    good = _valid(kind, m)
    suffix = F.regexp_extract(F.lower(m), "([a-z0-9-]+)$", 1)
    calling = F.substring_index(F.regexp_replace(m, r"^\+([0-9]{1,3}).*$", "$1"), " ", 1)
    gazetteer = _by_kind(
        _vote(suffix.isin(*DOMAINS), ~suffix.rlike("^[a-z]{2,}$")),
        _vote(~m.rlike(r"^(?:0|127|255)\.") & good, m.rlike(r"^0\.|999")),
        _vote(digits.rlike(CARDS), digits.rlike("^0")),
        _vote(F.when(m.startswith("+"), reduce(lambda a, b: a | b, [calling.startswith(c) for c in CALLING])).otherwise(digits.rlike("^[2-9]")), digits.rlike("^0{2}|^[01]{3}")),
    )
    context = _by_kind(*[_vote(before.rlike(NEAR[k][0]) | after.rlike(NEAR[k][0]), before.rlike(NEAR[k][1])) for k in KINDS])
    shape = _by_kind(
        _vote(F.length(m).between(6, 80), F.length(m) > 254),
        _vote(F.length(m).between(7, 15), m.rlike(r"(?:^|\.)0[0-9]")),
        _vote(n.isin(15, 16), ~n.between(13, 19)),
        _vote(n.between(10, 13), ~n.between(9, 15)),
    )
    edges = _vote(~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]"), before.rlike(r"[\p{N}.-]$") | after.rlike(r"^[\p{N}-]"))
    check = _vote(F.col("base") & good, F.col("base") & ~good)
    return [v.cast("int").alias(name) for name, v in zip(LABELERS, (check, gazetteer, context, shape, edges), strict=True)]


def reliabilities(histogram: list[tuple[int, tuple[int, ...], int]], turns: int = EM_TURNS) -> tuple[list[float], list[list[list[float]]], list[float]]:
    """(share of real spans by kind, P(vote | real?) by labeler, soft label of each histogram row).

    Two-class latent model with independent labelers, started from the sum of the votes. What fails its kind's
    check is known not to be real and anchors that class.
    """
    soft = [0.0 if v[0] < 0 else 1 / (1 + math.exp(-2 * sum(v))) for _, v, _ in histogram]
    prior, table = [0.5] * len(KINDS), []
    for _ in range(turns):
        table = [[[1.0] * 3 for _ in range(2)] for _ in LABELERS]
        share = [[1.0, 1.0] for _ in KINDS]
        for (kind, votes, n), p in zip(histogram, soft, strict=True):
            for z, weight in ((1, p * n), (0, (1 - p) * n)):
                share[kind][z] += weight
                for j, v in enumerate(votes):
                    table[j][z][v + 1] += weight
        table = [[[x / sum(row) for x in row] for row in both] for both in table]
        prior = [s[1] / sum(s) for s in share]
        soft = []
        for kind, votes, _ in histogram:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(table[j][1][v + 1] / table[j][0][v + 1]) for j, v in enumerate(votes))
            soft.append(0.0 if votes[0] < 0 else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, table, soft


def train(histogram: list[tuple[int, tuple[int, ...], int]], soft: list[float], turns: int = 300, rate: float = 0.5) -> list[float]:
    """Weights of the span classifier: one per kind, then one per labeler and vote (yes, no)."""
    size = len(KINDS) + 2 * len(LABELERS)
    w = [0.0] * size
    total = sum(n for _, _, n in histogram) or 1
    rows = [([k, *(len(KINDS) + 2 * j + (v < 0) for j, v in enumerate(votes) if v)], n / total, p) for (k, votes, n), p in zip(histogram, soft, strict=True)]
    for _ in range(turns):
        slope = [0.001 * x for x in w]
        for at, n, p in rows:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in at)))))
            for i in at:
                slope[i] += n * (q - p)
        w = [x - rate * s for x, s in zip(w, slope, strict=True)]
    return w


def probability(w: list[float]) -> Column:
    total = _by_kind(*[F.lit(float(x)) for x in w[: len(KINDS)]])
    for j, name in enumerate(LABELERS):
        yes, no = w[len(KINDS) + 2 * j : len(KINDS) + 2 * j + 2]
        total = total + F.when(F.col(name) > 0, F.lit(float(yes))).when(F.col(name) < 0, F.lit(float(no))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def personal_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per input row: row, doc_id, spans: array of (kind, start, end, base, p), by kind as listed, then start.

    Base spans are always in. A candidate of a looser pattern is added if the classifier gives it at least `accept`
    and it touches no base span; what failed its kind's check is never added. Null text counts as empty; repeated rows
    keep a row each; an empty table gives no rows. Positions are code points, the end is exclusive.
    """
    found = save(candidates(docs), "candidates")
    counted = found.where("kind IS NOT NULL").groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *LABELERS)
    histogram = [(r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counted.collect()]  # at most 4 * 3^5 rows
    _, _, soft = reliabilities(histogram)
    scored = found.withColumn("p", F.when(F.col("kind").isNotNull(), probability(train(histogram, soft))))
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max(F.when(F.col("strict"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("strict"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.col("end") <= F.coalesce(following, F.lit(2**62)))
    kept = scored.withColumn("in", F.col("strict") | (free & (F.col("p") >= accept) & (F.col("check") >= 0)))
    span = F.struct("kind", "start", "end", F.col("strict").alias("base"), "p")
    return kept.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("in"), span))).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
