"""Filters, search, facets, paging and scope."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.functions.ordered import top_per_group
from lureframe.operators import sessions as S

EXACT_FILTERS = {
    "honeypot_id": "honeypot_id", "source_ip": "source_ip", "destination_ip": "destination_ip",
    "protocol": "protocol", "event_category": "category", "risk": "risk_level",
    "technique_id": "mitre_technique_id", "session_id": "session_id",
}
MAX_PAGE_SIZE, MAX_DEPTH = 500, 10_000
FACETS = {"protocols": "protocol", "categories": "category", "techniques": "mitre_technique_id", "risks": "risk_level"}


def with_defaults(ev: DataFrame) -> DataFrame:
    """I8: the values a reader sees where an event carries none."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    defaults = {
        "source_ip": "0.0.0.0", "action": "unknown", "category": "other", "protocol": "ssh",
        "honeypot_id": "unknown", "honeypot_name": "unknown", "session_id": "unknown",
        "risk_score": 0, "risk_level": "informational",
    }
    return ev.select(*[d(c, defaults[c]) if c in defaults else F.col(c) for c in ev.columns])


def free_text(q: str, *exact: str) -> Column:
    """any word of `q` in the command text, or `q` as a whole in a keyword column. An address
    column takes part only when `q` is an address."""
    words = text_words(q)
    hit = F.arrays_overlap(text.search_tokens("command_line"), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    hit = F.coalesce(hit, F.lit(False))
    for column in exact:
        hit = hit | F.coalesce(F.col(column) == F.lit(q), F.lit(False))
    return hit


def text_words(q: str) -> list[str]:
    return re.findall(r"[\w.]*\w", q.lower())


def matches(filters: dict | None = None, start=None, end=None, q: str | None = None) -> Column:
    """conjunction of exact filters, an inclusive time range and free text. Exact and range
    parts are plain comparisons, so they reach the Parquet scan."""
    cond = F.lit(True)
    for name, value in (filters or {}).items():
        if value:
            cond = cond & (F.col(EXACT_FILTERS[name]) == F.lit(value))
    if start is not None:
        cond = cond & (F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (F.col("ts") <= F.lit(end).cast("timestamp"))
    if q:
        cond = cond & free_text(q, "action", "username", "source_ip")
    return cond


def search(ev: DataFrame, filters=None, start=None, end=None, q=None, page: int = 1, size: int = 100) -> DataFrame:
    """one page, oldest first (top-k, no full sort), with the exact total on every row."""
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be at least 1 and size 1..{MAX_PAGE_SIZE}")
    if page * size > MAX_DEPTH:
        raise ValueError(f"page * size must not exceed {MAX_DEPTH}")
    found = ev.filter(matches(filters, start, end, q))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    rows = found.orderBy("ts", "event_id").offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total.scalar())


def count_matches(ev: DataFrame, **kw) -> DataFrame:
    return ev.filter(matches(**kw)).agg(F.count(F.lit(1)).alias("total"))


def events_by_id(ev: DataFrame, ids: DataFrame) -> DataFrame:
    """resolve event pointers; an unknown id gives no row."""
    return ev.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def scoped(df: DataFrame, deny: list[str] | DataFrame | None, column: str = "honeypot_id") -> DataFrame:
    """rows of denied sensors removed before anything counts them. A row that cannot be placed
    on a sensor is hidden once a scope applies."""
    if deny is None or (isinstance(deny, list) and not deny):
        return df
    if isinstance(deny, list):
        return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(sorted(deny)))
    denied = deny.select(F.col(deny.columns[0]).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(denied, column, "left_anti")


def scoped_by_session(df: DataFrame, ev: DataFrame, deny) -> DataFrame:
    """F5 for rows that know a session only: placed through the session's modal sensor."""
    if not deny:
        return df
    allowed = scoped(S.session_sensors(ev), deny).select("session_id")
    return df.join(allowed, "session_id", "left_semi")


def facets(ev: DataFrame, deny=None, top: int = 100) -> DataFrame:
    """values and counts of every filterable field, in one grouping-sets pass."""
    cols = list(FACETS.values())
    ev = scoped(ev, deny)
    grouped = ev.groupingSets([[c] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id(*cols).alias("_gid")
    )
    # grouping_id sets the bit of every column that is NOT grouped; the grouped one is the 0 bit.
    n = len(cols)
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, c) in enumerate(FACETS.items()):
        mask = (2**n - 1) - 2 ** (n - 1 - i)
        facet = F.when(F.col("_gid") == mask, name).otherwise(facet)
        value = F.when(F.col("_gid") == mask, F.col(c)).otherwise(value)
    rows = grouped.select(facet.alias("facet"), value.alias("value"), "count").filter(F.col("value").isNotNull())
    return top_per_group(rows, ["facet"], [F.desc("count"), F.asc("value")], top)


def session_page(
    ev: DataFrame, risk=None, honeypot=None, q=None, ip=None, deny=None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """sessions with a matching event, newest first by their first *matching* event.

    Two phases: the page's keys first (aggregate and top-k), then only those sessions are built.
    """
    if not (1 <= limit <= 500 and 0 <= offset <= 10_000):
        raise ValueError("limit must be 1..500 and offset 0..10000")
    hit = scoped(ev, deny)
    for column, value in (("risk_level", risk), ("honeypot_id", honeypot), ("source_ip", ip)):
        if value:
            hit = hit.filter(F.col(column) == value)
    if q:
        hit = hit.filter(free_text(q, "username", "source_ip", "session_id"))
    keys = (
        hit.groupBy("session_id").agg(F.min("ts").alias("first_seen"))
        .orderBy(F.desc("first_seen"), F.asc("session_id")).offset(offset).limit(limit)
    )
    # At most 500 keys: a size-bounded broadcast keeps the event scan free of a shuffle.
    keys = F.broadcast(keys)
    members = ev.join(keys.select("session_id"), "session_id", "left_semi")
    return S.sessions(members).join(keys, "session_id")


def list_indicators(ind: DataFrame, type_=None, q=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """one page of indicators; `q` is matched as literal text, ignoring case."""
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"limit must be 1..{MAX_PAGE_SIZE}")
    if type_:
        ind = ind.filter(F.col("type") == type_)
    if q:
        ind = ind.filter(F.contains(F.lower("value"), F.lower(F.lit(q))))
    return ind.orderBy(F.desc("last_seen"), F.asc("type"), F.asc("value")).offset(offset).limit(limit)


def page_links(page: DataFrame, links: DataFrame) -> DataFrame:
    """the session links of a page's indicators, one row per link."""
    return links.join(F.broadcast(page.select("type", "value")), ["type", "value"], "left_semi")


def list_runs(runs: DataFrame, scores: DataFrame, honeypot=None, limit: int = 50) -> DataFrame:
    """F8: the newest runs, then their scores."""
    if honeypot:
        runs = runs.filter(F.col("honeypot_id") == honeypot)
    page = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
    return page.join(scores, "run_id", "left")


def load_history(an: DataFrame, ev: DataFrame | None = None, deny=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """the newest visible analyses; paging counts visible rows only."""
    visible = scoped_by_session(an, ev, deny) if deny else an
    return visible.orderBy(F.desc("created_at"), F.asc("analysis_id")).offset(offset).limit(limit)


def hydrate(page: DataFrame, claims: DataFrame, citations: DataFrame, rejections: DataFrame, actions: DataFrame) -> DataFrame:
    """the analyses of a page with their claims (each with its evidence), rejections and actions as sorted lists.

    `claims`: claim_id, analysis_id, kind, technique_id, text; `citations`: claim_id, event_id, ts, artifact;
    `rejections`: claim_id, analysis_id, stage, kind, reason, technique_id, text, cited_event_ids; `actions`: analysis_id,
    priority, action, rationale. A page is bounded, so its keys meet each relation as a broadcast, and only the
    page's rows move.
    """
    keys = F.broadcast(page.select("analysis_id"))
    mine = claims.join(keys, "analysis_id", "left_semi")
    cited = citations.select("claim_id", F.struct("ts", "event_id", "artifact").alias("e")).join(mine.select("claim_id"), "claim_id", "left_semi")
    evidence = cited.groupBy("claim_id").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    kept = mine.join(evidence, "claim_id")

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    parts = (
        listed(kept, "claims", "claim_id", "kind", "technique_id", "text", "evidence"),
        listed(rejections.join(keys, "analysis_id", "left_semi"), "rejections", "stage", "claim_id", "kind", "reason", "technique_id", "text", "cited_event_ids"),
        listed(actions.join(keys, "analysis_id", "left_semi"), "actions", "priority", "action", "rationale"),
    )
    out = page
    for part in parts:
        (name,) = (c for c in part.columns if c != "analysis_id")
        out = out.join(part, "analysis_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


# --- fixed values: annotation rules ---
TAG = r"\A[a-z0-9][a-z0-9._:-]{0,39}\z"
NOTE_MAX = 2000
# --- end of fixed values ---


def annotations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused). Tags are normalised and unique per session; notes are kept as
    written. A refused row carries its reason."""
    # Python strip semantics: every Unicode space at the ends.
    body = F.regexp_replace("body", r"(?U)\A\s+|\s+\z", "")
    tag = F.lower(body)
    reason = (
        F.when(F.contains("body", F.lit("\x00")), "nul_character")
        .when(F.col("kind") == "tag", F.when(~tag.rlike(TAG), "malformed_tag"))
        .when(F.col("kind") == "note", F.when(body == "", "empty_note").when(F.length(body) > NOTE_MAX, "note_too_long"))
        .otherwise("unknown_kind")
    )
    checked = raw.withColumn("reason", reason)
    ok = checked.filter(F.col("reason").isNull()).drop("reason").withColumn(
        "body", F.when(F.col("kind") == "tag", tag).otherwise(body)
    )
    tags = top_per_group(ok.filter("kind = 'tag'"), ["session_id", "body"], [F.asc("created_at"), F.asc("annotation_id")], 1)
    return tags.unionByName(ok.filter("kind = 'note'")), checked.filter(F.col("reason").isNotNull())
