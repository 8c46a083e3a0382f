"""Indicator extraction, correlation and exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.functions import ids, net, text
from lureframe.operators.sessions import DOWNLOAD, compact, compact_summary

# --- fixed values -------------------------------------------------------------------------------
EXPORTED = ("ip", "url", "hash")
NAMESPACE = "6f1b8c3e-2d4a-5e9f-8a7b-1c2d3e4f5a6b"
HASH_NAMES = {32: ("MD5", "md5"), 40: ("SHA-1", "sha1"), 64: ("SHA-256", "sha256")}
# --- end of fixed values ------------------------------------------------------------------------


def _found(kind: str, column: str, pattern: str) -> Column:
    values = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def text_indicators(rows: DataFrame, column: str) -> DataFrame:
    """N1 over any text column: urls, addresses and SHA-256 digests, one row per occurrence."""
    found = F.concat(
        _found("url", column, text.URL_LITERAL),
        _found("ip", column, "(?U)" + text.IPV4_LITERAL),
        _found("hash", column, "(?U)" + text.SHA256_LITERAL),
    )
    return rows.withColumn("_i", F.explode_outer(found)).filter("_i IS NOT NULL").select("*", "_i.type", "_i.value").drop("_i")


def extract(ev: DataFrame, with_heads: bool = True) -> DataFrame:
    """Every indicator of every session with the event it was read from.

    `with_heads=False` leaves out a session's own address and user name, which need all of its events. Commands come from the compacted sequence, so a repeated command is cited once.
    """
    cmds = compact(ev)
    whole = F.array(F.struct(F.lit("command").alias("type"), F.col("command").alias("value")))
    found = F.concat(
        whole, _found("url", "command", text.URL_LITERAL), _found("ip", "command", "(?U)" + text.IPV4_LITERAL),
        _found("hash", "command", "(?U)" + text.SHA256_LITERAL),
    )
    from_commands = cmds.select("session_id", "event_id", F.explode_outer(found).alias("_i"), F.col("command").alias("artifact"))
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    label = F.coalesce(F.when(full("file_name"), F.col("file_name")), F.when(full("file_url"), F.col("file_url")), F.lit("downloaded file"))
    item = lambda kind, c: F.when(full(c), F.struct(F.lit(kind).alias("type"), F.col(c).alias("value")))
    from_downloads = ev.filter(F.col("action") == DOWNLOAD).select(
        "session_id", "event_id",
        F.explode(F.array_compact(F.array(item("hash", "sha256"), item("url", "file_url"), item("filename", "file_name")))).alias("_i"),
        F.concat(F.lit("download: "), label).alias("artifact"),
    )
    read = from_commands.unionByName(from_downloads)
    if not with_heads:
        return read.select("session_id", "event_id", "_i.type", "_i.value", "artifact")
    heads = compact_summary(ev)
    from_heads = heads.select(
        "session_id", F.col("first_event_id").alias("event_id"),
        F.explode(F.array_compact(F.array(item("ip", "attacker_ip"), item("username", "username")))).alias("_i"),
        F.concat(F.lit("connection from "), "attacker_ip").alias("artifact"),
    )
    rows = read.unionByName(from_heads)
    return rows.select("session_id", "event_id", "_i.type", "_i.value", "artifact")


def session_links(extracted: DataFrame, seen: str = "seen_at") -> DataFrame:
    """The n:m relation: one row per (type, value, session). Duplicates never add a link."""
    return extracted.groupBy("type", "value", "session_id").agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def correlate(links: DataFrame) -> DataFrame:
    """One row per (type, value). CORRELATED needs more than one distinct session.

    The sessions themselves stay rows in the link relation: an address may appear in a third of
    them, and both aggregates combine map-side.
    """
    return links.groupBy("type", "value").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("session_count"),
    ).withColumn("source", F.when(F.col("session_count") > 1, "CORRELATED").otherwise("OBSERVED"))


def new_values(batch_links: DataFrame, known: DataFrame) -> DataFrame:
    """How many indicator values a batch saw for the first time ever."""
    fresh = batch_links.select("type", "value").distinct().join(known.select("type", "value"), ["type", "value"], "left_anti")
    return fresh.agg(F.count(F.lit(1)).alias("new_values"))


def exclusion_reason(public: Column) -> Column:
    """Why an indicator stays out of every export; null when it goes in."""
    kind, value = F.col("type"), F.col("value")
    return (
        F.when(~kind.isin(*EXPORTED), F.concat(F.lit("type:"), kind))
        .when((kind == "ip") & public.isNull(), "unparseable-ip")
        .when((kind == "ip") & ~public, "non-public-ip")
        .when((kind == "hash") & ~F.length(value).isin(*HASH_NAMES), "unknown-hash-length")
    )


def export_split(ind: DataFrame) -> DataFrame:
    tested = ind.withColumn("_public", F.when(F.col("type") == "ip", net.is_global("value")))
    return tested.withColumn("reason", exclusion_reason(F.col("_public"))).drop("_public")


def exclusions(split: DataFrame, blocklist: bool = False) -> DataFrame:
    """Every exclusion counted by its reason; a blocklist also excludes what is no address."""
    reason = F.col("reason")
    if blocklist:
        reason = F.coalesce(reason, F.when(F.col("type") != "ip", F.concat(F.lit("type:"), "type")))
    return split.withColumn("reason", reason).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _by_length(value: Column, which: int) -> Column:
    names = None
    for n, pair in HASH_NAMES.items():
        cond = F.length(value) == n
        names = F.when(cond, pair[which]) if names is None else names.when(cond, pair[which])
    return names


def _millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _description(producer: str) -> Column:
    n = F.col("session_count")
    return F.concat(
        F.col("source"), F.lit(f" by the {producer} in "), n.cast("string"), F.when(n == 1, " session.").otherwise(" sessions.")
    )


def stix_pattern() -> Column:
    """The pattern, with backslash and quote escaped in that order."""
    kind, value = F.col("type"), F.col("value")
    safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    address = F.when(F.contains(value, F.lit(":")), "ipv6-addr").otherwise("ipv4-addr")
    return (
        F.when(kind == "ip", F.concat(F.lit("["), address, F.lit(":value = '"), safe, F.lit("']")))
        .when(kind == "url", F.concat(F.lit("[url:value = '"), safe, F.lit("']")))
        .otherwise(F.concat(F.lit("[file:hashes.'"), _by_length(value, 0), F.lit("' = '"), safe, F.lit("']")))
    )


def stix_objects(split: DataFrame, producer: str = "decoy sensors", tag: str = "decoy") -> DataFrame:
    """One indicator object per exported row. Ids are deterministic, so a re-import updates."""
    kept = split.filter(F.col("reason").isNull())
    name = F.concat("type", F.lit(":"), "value")
    confidence = F.bround(F.coalesce("confidence", F.lit(1.0)) * 100, 0).cast("int") if "confidence" in split.columns else F.lit(100)
    s = lambda v, a: F.lit(v).alias(a)
    obj = F.struct(
        s("indicator", "type"), s("2.1", "spec_version"),
        F.concat(F.lit("indicator--"), ids.uuid5(NAMESPACE, name)).alias("id"),
        F.concat(F.lit("identity--"), ids.uuid5(NAMESPACE, F.lit(producer))).alias("created_by_ref"),
        _millis(F.col("first_seen")).alias("created"), _millis(F.col("last_seen")).alias("modified"),
        F.concat("type", F.lit(": "), "value").alias("name"), _description(producer).alias("description"),
        F.array(F.lit("malicious-activity")).alias("indicator_types"), stix_pattern().alias("pattern"),
        s("stix", "pattern_type"), _millis(F.col("first_seen")).alias("valid_from"), confidence.alias("confidence"),
        F.array(F.concat(F.lit(f"{tag}:"), F.lower("source"))).alias("labels"),
    )
    return kept.select(F.concat(F.lit("indicator--"), ids.uuid5(NAMESPACE, name)).alias("id"), F.to_json(obj).alias("json"))


def stix_identity(like: DataFrame, as_of: datetime, producer: str = "decoy sensors") -> DataFrame:
    """The identity object the indicators refer to."""
    stamp = F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%S.") + f"{as_of.microsecond // 1000:03d}Z")
    key = F.concat(F.lit("identity--"), ids.uuid5(NAMESPACE, F.lit(producer)))
    obj = F.struct(
        F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), key.alias("id"), stamp.alias("created"),
        stamp.alias("modified"), F.lit(producer).alias("name"), F.lit("system").alias("identity_class"),
    )
    return like.sparkSession.range(1).select(key.alias("id"), F.to_json(obj).alias("json"))


def misp_attributes(split: DataFrame, producer: str = "decoy sensors") -> DataFrame:
    """One attribute per exported row."""
    kept = split.filter(F.col("reason").isNull())
    kind = F.when(F.col("type") == "ip", "ip-src").when(F.col("type") == "url", "url").otherwise(_by_length(F.col("value"), 1))
    category = F.when(F.col("type") == "hash", "Payload delivery").otherwise("Network activity")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    obj = F.struct(
        kind.alias("type"), category.alias("category"), F.col("value"), F.lit(True).alias("to_ids"),
        _description(producer).alias("comment"), iso("first_seen"), iso("last_seen"),
    )
    return kept.select("type", "value", F.to_json(obj).alias("json"))


def blocklist(split: DataFrame) -> DataFrame:
    """Distinct public addresses. Sorted by the sink, as a range-partitioned sort."""
    return split.filter(F.col("reason").isNull() & (F.col("type") == "ip")).select(F.col("value").alias("line")).distinct()


def third_party(ind: DataFrame, verdicts: DataFrame, supported: tuple[str, ...] = ("ip", "url", "hash")) -> DataFrame:
    """An outside verdict beside each indicator, always with a status and never a guess.

    `verdicts` holds (type, value, malicious, suspicious, harmless, undetected); a private address
    is never looked up.
    """
    known = verdicts.withColumn("_hit", F.lit(True))
    public = net.is_global("value")
    joined = ind.join(known, ["type", "value"], "left")
    status = (
        F.when(~F.col("type").isin(*supported), "not_supported")
        .when((F.col("type") == "ip") & ~F.coalesce(public, F.lit(False)), "not_public")
        .when(F.col("_hit").isNull(), "not_found").otherwise("ok")
    )
    stats = ["malicious", "suspicious", "harmless", "undetected"]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in stats), F.lit(0))
    shown = lambda c: F.when(F.col("status") == "ok", c)
    return joined.withColumn("status", status).select(
        *ind.columns, "status", shown(F.col("malicious")).alias("malicious"), shown(total).alias("engines")
    )
