"""Replayed scripts, command-set similarity, attacker profiles, notables, coverage, candidates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureframe.functions import net, text
from lureframe.functions.streamed import session_digests
from lureframe.functions.ordered import HOUR_US, bucket, number_rows, top_per_group
from lureframe.operators import search
from lureframe.operators.sessions import BLOCK_ROWS, COMMAND, DOWNLOAD, latest_analyses, sessions
from lureframe.session import write_once

LIST_CAP = 20
PATTERN_CAP = 12
SIMILAR_SHOWN = 5
MIN_NOTABLE_SESSIONS, MAX_NOTABLES = 3, 50


def command_events(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("action") == COMMAND).select(
        "session_id", "event_id", "ts", "source_ip", "honeypot_id",
        F.coalesce("command_line", F.lit("")).alias("command_line"),
    )


def fingerprints(commands: DataFrame, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """One digest per session over its normalised commands in time order.

    The digest is that of the commands joined by newlines, at every length. Up to `rows_per_block`
    commands it is taken from one text; a longer session is sorted and fed to the digest row by row,
    so no task ever holds it.
    """
    placed = number_rows(commands, ["session_id"], "ts", "event_id").withColumn("_k", F.expr(f"pos div {rows_per_block}"))
    blocks = (
        placed.withColumn("_norm", text.normalize_command("command_line"))
        .groupBy("session_id", "_k")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "_norm"))).alias("_items"),
            F.min(F.struct("ts", "event_id", "source_ip", "honeypot_id")).alias("_first"),
            F.max("ts").alias("_last"),
        )
        .select(
            "session_id", "_k", "_first", "_last",
            F.size("_items").alias("_n"),
            F.sha2(F.array_join("_items._norm", "\n"), 256).alias("_digest"),
            F.when(F.col("_k") == 0, F.slice("_items._norm", 1, LIST_CAP)).alias("_head"),
        )
    )
    whole = blocks.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_blocks"),
        F.min("_digest").alias("_d"),
        F.min("_first").alias("_first"), F.max("_last").alias("last_ts"),
        F.sum("_n").alias("command_count"), F.max("_head").alias("commands"),
    )
    long = whole.filter("_blocks > 1").select("session_id")
    fed = session_digests(placed.join(long, "session_id", "left_semi").select("session_id", "pos", text.normalize_command("command_line").alias("part")))
    digest = F.when(F.col("_blocks") == 1, F.col("_d")).otherwise(F.col("_fed"))
    return whole.join(fed.withColumnRenamed("digest", "_fed"), "session_id", "left").select(
        "session_id", F.substring(digest, 1, 12).alias("fingerprint"), "command_count", "commands",
        F.col("_first.ts").alias("first_ts"), "last_ts",
        F.col("_first.source_ip").alias("source_ip"), F.col("_first.honeypot_id").alias("honeypot_id"),
    )


def _newest_first(members: DataFrame, column: str, cap: int | None, out: str) -> DataFrame:
    """Distinct values of a column per fingerprint in order of their newest session, first `cap`."""
    seen = (
        members.filter(F.col(column).isNotNull()).groupBy("fingerprint", column)
        .agg(F.max(F.struct("first_ts", "session_id")).alias("_o"))
    )
    kept = top_per_group(seen, ["fingerprint"], [F.desc("_o")], cap) if cap else seen
    ordered = F.sort_array(F.collect_list(F.struct("_o", column)), asc=False)
    return kept.groupBy("fingerprint").agg(ordered.alias("_l")).select("fingerprint", F.col(f"_l.{column}").alias(out))


def campaigns(ev: DataFrame, min_sessions: int = 2, deny=None, prints: DataFrame | None = None) -> DataFrame:
    """Sessions that ran the same script. Counts are exact; lists hold the newest twenty.

    One row per session is written once and read by each aggregate below.
    Every list is cut by a window group limit before the shuffle, so a script that a third of all
    sessions ran costs no task more than a rare one.
    """
    members = write_once(fingerprints(command_events(search.scoped(ev, deny)))) if prints is None else prints
    stats = (
        members.groupBy("fingerprint")
        .agg(
            F.count(F.lit(1)).alias("session_count"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen"),
            F.max(F.struct("first_ts", "session_id", "commands", "command_count")).alias("_newest"),
        )
        .filter(F.col("session_count") >= min_sessions)
    )
    ip_counts = members.filter(F.col("source_ip").isNotNull()).select("fingerprint", "source_ip").distinct().groupBy("fingerprint").agg(F.count(F.lit(1)).alias("attacker_ip_count"))
    return (
        stats.join(_newest_first(members, "session_id", LIST_CAP, "session_ids"), "fingerprint")
        .join(_newest_first(members, "source_ip", LIST_CAP, "attacker_ips"), "fingerprint", "left")
        .join(ip_counts, "fingerprint", "left")
        # Sensors are a deployment's inventory, not its traffic: the list is whole.
        .join(_newest_first(members, "honeypot_id", None, "honeypot_ids"), "fingerprint", "left")
        .select(
            "fingerprint", F.col("_newest.commands").alias("commands"), F.col("_newest.command_count").alias("command_count"),
            "session_count", "session_ids", "attacker_ips",
            F.coalesce("attacker_ip_count", F.lit(0)).alias("attacker_ip_count"), "honeypot_ids", "first_seen", "last_seen",
        )
    )


def coverage_flag(commands: DataFrame, max_sessions: int | None = None, max_events: int | None = None) -> DataFrame:
    """How many sessions were considered, and why not all, when optional caps are asked for.

    Without caps everything is examined. With caps sessions are admitted newest first while their
    whole command list fits. Commands are summed per hour of the sessions' starts; only the hour in
    which the limit falls is looked at session by session.
    """
    per_session = commands.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    if max_sessions is None and max_events is None:
        return per_session.agg(F.count(F.lit(1)).alias("sessions_considered")).select(
            "sessions_considered", F.lit(True).alias("complete"), F.lit(None).cast("string").alias("incomplete_reason")
        )
    limit = F.lit(max_events if max_events is not None else 2**62).cast("long")
    slots = per_session.withColumn("_h", bucket("first_ts", HOUR_US))
    newer = Window.orderBy(F.desc("_h")).rowsBetween(Window.unboundedPreceding, -1)  # one row per hour
    hours = slots.groupBy("_h").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_s"))
    hours = hours.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    whole = hours.filter(F.col("_before") + F.col("_n") <= limit).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_s"))
    cut = hours.filter((F.col("_before") <= limit) & (F.col("_before") + F.col("_n") > limit)).select("_h", "_before")
    inside = Window.partitionBy("_h").orderBy(F.desc("first_ts"), F.desc("session_id")).rowsBetween(Window.unboundedPreceding, 0)
    part = slots.join(cut, "_h").withColumn("_used", F.col("_before") + F.sum("n").over(inside))
    fitting = part.agg(F.count_if(F.col("_used") <= limit).alias("_s"))
    total = per_session.agg(F.count(F.lit(1)).alias("total"))
    cap = F.col("total") if max_sessions is None else F.least("total", F.lit(max_sessions).cast("long"))
    counted = total.withColumn("_fit", whole.scalar() + fitting.scalar()).withColumn("_cap", cap)
    reason = F.when(F.col("_fit") < F.col("_cap"), "command_event_limit").when(F.col("total") > F.col("_cap"), "session_limit")
    return counted.select(
        F.least("_fit", "_cap").alias("sessions_considered"), reason.isNull().alias("complete"), reason.alias("incomplete_reason")
    )


def twin_counts(prints: DataFrame) -> DataFrame:
    """C4: how many other sessions ran each session's script. Groups are counted, never paired."""
    sizes = prints.groupBy("fingerprint").agg((F.count(F.lit(1)) - 1).alias("twin_count"))
    return prints.select("session_id", "fingerprint").join(sizes, "fingerprint")


def twins(prints: DataFrame, an: DataFrame) -> DataFrame:
    """C4: for each session the newest analysed twins, at most twenty, each with its own latest
    completed analysis as a pointer.

    The newest 21 analysed members of a fingerprint hold the answer for all its sessions, so a
    session meets at most 21 rows however many twins it has.
    """
    latest = latest_analyses(an, completed_only=True).select("session_id", "analysis_id", "classification", "risk", "created_at")
    analysed = prints.select("session_id", "fingerprint").join(latest, "session_id")
    head = top_per_group(
        analysed, ["fingerprint"], [F.desc("created_at"), F.desc("analysis_id")], LIST_CAP + 1, rank="_r"
    ).withColumnRenamed("session_id", "twin_session_id")
    # A member of the first 21 sees the others; everyone else sees the first 20.
    own = head.select("fingerprint", F.col("twin_session_id").alias("session_id"), F.col("_r").alias("_own"))
    base = prints.select("session_id", "fingerprint").join(own, ["fingerprint", "session_id"], "left")
    place = F.when(F.col("_own").isNotNull() & (F.col("_own") < F.col("_r")), F.col("_r") - 1).otherwise(F.col("_r"))
    return (
        base.join(head, "fingerprint").filter(F.col("session_id") != F.col("twin_session_id"))
        .filter(place <= LIST_CAP)
        .select("session_id", "twin_session_id", "analysis_id", "classification", "risk")
    )


def command_sets(ev: DataFrame, max_length: int | None = None) -> DataFrame:
    """Distinct (address, normalised command) pairs; command lines of any length, or up to `max_length`
    (`unexamined_commands` counts the longer ones)."""
    rows = ev.filter(F.col("source_ip").isNotNull() & F.col("command_line").isNotNull() & text.up_to("command_line", max_length))
    raw = rows.select("source_ip", "command_line").distinct()
    return raw.select("source_ip", text.normalize_command("command_line").alias("command")).distinct()


def command_set_flags(ev: DataFrame, command_limit: int = 10_000, ip_limit: int = 20_000, max_length: int | None = None) -> DataFrame:
    """Whether the reference limits would withhold similarity, as one reported row."""
    raw = (
        ev.filter(F.col("source_ip").isNotNull() & F.col("command_line").isNotNull() & text.up_to("command_line", max_length))
        .select("source_ip", "command_line").distinct()
    )
    per_ip = raw.groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))
    reason = (
        F.when(F.count(F.lit(1)) > ip_limit, "attacker_cardinality_limit")
        .when(F.coalesce(F.max("n"), F.lit(0)) > command_limit, "command_cardinality_limit")
    )
    return per_ip.agg(F.count(F.lit(1)).alias("attackers"), F.max("n").alias("largest"), reason.alias("reason"))


def similarity(sets: DataFrame, subjects: DataFrame) -> DataFrame:
    """Jaccard similarity of each subject address with every other address, above zero.

    `subjects` is the short list a reader asks about. The work is one pass over the command sets:
    each pair (address, command) meets the subjects that have that command, is combined map-side
    into intersection counts, and addresses are never paired with one another.
    """
    # A set may be fanned into its (subject, command) rows; AQE broadcasts them when they are
    # small and splits a hot command's partition when they are not.
    wanted = subjects.select(F.col("source_ip").alias("ip")).distinct()
    sizes = sets.groupBy("source_ip").agg(F.count(F.lit(1)).alias("_size"))
    mine = sets.join(wanted.withColumnRenamed("ip", "source_ip"), "source_ip", "left_semi").select(
        F.col("source_ip").alias("ip"), "command"
    )
    shared = (
        sets.join(mine, "command").filter(F.col("ip") != F.col("source_ip"))
        .groupBy("ip", F.col("source_ip").alias("other_ip")).agg(F.count(F.lit(1)).alias("_shared"))
    )
    a = sizes.select(F.col("source_ip").alias("ip"), F.col("_size").alias("_a"))
    b = sizes.select(F.col("source_ip").alias("other_ip"), F.col("_size").alias("_b"))
    score = F.bround(F.col("_shared") / (F.col("_a") + F.col("_b") - F.col("_shared")), 3)
    return (
        shared.join(a, "ip").join(b, "other_ip").select("ip", "other_ip", score.alias("score")).filter(F.col("score") > 0)
    )


def similarity_top(scores: DataFrame, shown: int = SIMILAR_SHOWN) -> DataFrame:
    """The closest addresses of each subject, with the total that scored at all."""
    totals = scores.groupBy("ip").agg(F.count(F.lit(1)).alias("total"))
    best = top_per_group(scores, ["ip"], [F.desc("score"), F.asc("other_ip")], shown, rank="rank")
    return best.join(totals, "ip").select("ip", "rank", "other_ip", "score", "total")


def profiles(ev: DataFrame, an: DataFrame, tm: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row per attacker address. Lists that could grow without bound are counts here, and
    rows in `profile_pattern`, `profile_downloads` and the indicator links."""
    ss = write_once(sessions(ev))  # read by five aggregates
    base = ss.groupBy(F.col("attacker_ip").alias("ip")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min("started_at").alias("first_seen"),
        F.max(F.struct("started_at", "session_id", F.coalesce("ended_at", "started_at").alias("last"))).alias("_l"),
        F.min(F.when(F.col("country").isNotNull(), F.struct(F.lit(0) - F.unix_micros("started_at"), "session_id", "country"))).alias("_c"),
        F.array_sort(F.collect_set("honeypot_name")).alias("targeted_honeypots"),  # the sensor inventory
    )
    owner = ss.select("session_id", F.col("attacker_ip").alias("ip"))
    has_cmd = F.col("command_line").isNotNull() & (F.col("command_line") != "")
    counts = (
        # Counted per session first: what is joined is sessions, not events.
        ev.filter(has_cmd | (F.col("action") == DOWNLOAD)).groupBy("session_id").agg(F.count_if(has_cmd).alias("c"), F.count_if(~has_cmd).alias("d"))
        .join(owner, "session_id").groupBy("ip").agg(F.sum("c").alias("commands"), F.sum("d").alias("downloads"))
    )
    verdict = an.join(owner, "session_id").groupBy("ip").agg(
        F.max("risk_score").alias("risk_score"),
        F.max(F.struct("risk_score", F.lit(0) - F.unix_micros("created_at"), "risk")).alias("_r"),
        F.min(F.struct("created_at", "analysis_id", "classification")).alias("_b"),
    )
    techniques = (
        tm.select("analysis_id", "technique_id").join(an.select("analysis_id", "session_id"), "analysis_id")
        .join(owner, "session_id").select("ip", "technique_id").distinct()
        .groupBy("ip").agg(F.array_sort(F.collect_list("technique_id")).alias("technique_ids"))  # catalog-sized
    )
    out = base.join(counts, "ip", "left").join(verdict, "ip", "left").join(techniques, "ip", "left")
    indicators = F.lit(None).cast("long")
    if links is not None:
        per_ip = links.join(owner, "session_id").select("ip", "type", "value").distinct().groupBy("ip").agg(F.count(F.lit(1)).alias("_ind"))
        out = out.join(per_ip, "ip", "left")
        indicators = F.coalesce("_ind", F.lit(0))
    return out.select(
        "ip", F.col("_r.risk").alias("risk"), "risk_score",
        F.coalesce(F.col("_b.classification"), F.lit("Not yet analyzed")).alias("behavior_label"),
        "sessions", "first_seen", F.col("_l.last").alias("last_seen"), "targeted_honeypots",
        F.coalesce("commands", F.lit(0)).alias("command_count"), F.coalesce("downloads", F.lit(0)).alias("download_count"),
        F.coalesce("technique_ids", F.array().cast("array<string>")).alias("technique_ids"),
        indicators.alias("indicator_count"), F.col("_c.country").alias("country"),
    )


def profile_pattern(ev: DataFrame, cap: int = PATTERN_CAP) -> DataFrame:
    """The first commands of each attacker's newest sessions (the attack pattern).

    Twelve commands lie in the twelve newest sessions that ran any, so both cuts are group limits.
    """
    ss = sessions(ev).select("session_id", "attacker_ip", "started_at")
    cmds = ev.filter(F.col("command_line").isNotNull() & (F.col("command_line") != "")).select("session_id", "event_id", "ts", "command_line")
    heads = top_per_group(cmds, ["session_id"], [F.asc("ts"), F.asc("event_id")], cap, rank="_at").join(ss, "session_id")
    order = [F.desc("started_at"), F.asc("session_id"), F.asc("_at")]
    return top_per_group(heads, ["attacker_ip"], order, cap, rank="position").select(
        F.col("attacker_ip").alias("ip"), "position", "command_line"
    )


def profile_downloads(ev: DataFrame) -> DataFrame:
    """The files each attacker fetched, one row per (address, name, digest)."""
    owner = sessions(ev).select("session_id", F.col("attacker_ip").alias("ip"))
    no_cmd = F.col("command_line").isNull() | (F.col("command_line") == "")
    files = ev.filter((F.col("action") == DOWNLOAD) & no_cmd).select(
        "session_id", F.coalesce("file_name", F.lit("unknown")).alias("name"), F.coalesce("sha256", F.lit("")).alias("sha256")
    )
    return files.join(owner, "session_id").groupBy("ip", "name", "sha256").agg(F.count(F.lit(1)).alias("n"))


def notables(an: DataFrame, tm: DataFrame, camp: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """High-risk sessions, first technique sightings and campaigns of the window, at most 50;
    the rare kinds keep their places first."""
    since = F.lit((as_of - timedelta(days=days)).isoformat(sep=" ")).cast("timestamp")
    s = lambda c: F.col(c).cast("string")
    recent = an.filter(F.col("risk").isin("high", "critical") & (F.col("created_at") >= since))
    latest = top_per_group(recent, ["session_id"], [F.desc("created_at"), F.desc("analysis_id")], 1)
    high = latest.select(
        F.concat(F.lit("high_risk_session:"), "session_id").alias("id"), F.lit("high_risk_session").alias("kind"),
        F.lit("AI INFERENCE").alias("provenance"),
        F.concat(F.initcap("risk"), F.lit(" risk: "), "classification").alias("title"),
        F.concat(F.lit("Model-rated "), s("risk_score"), F.lit("/100 for session "), "session_id").alias("detail"),
        F.col("created_at").alias("ts"), "session_id", F.lit(None).cast("string").alias("technique_id"),
    )
    first = (
        tm.filter(F.col("source") == "rule").join(an.select("analysis_id", "session_id"), "analysis_id")
        .groupBy("technique_id").agg(F.min(F.struct("ts", "mapping_id", "technique_name", "rule_id", "session_id")).alias("_m"))
        .filter(F.col("_m.ts") >= since)
        .select(
            F.concat(F.lit("technique_first_seen:"), "technique_id").alias("id"), F.lit("technique_first_seen").alias("kind"),
            F.lit("OBSERVED").alias("provenance"),
            F.concat(F.lit("First observation of "), "technique_id", F.lit(" "), F.col("_m.technique_name")).alias("title"),
            F.concat(F.lit("Matched by rule "), F.col("_m.rule_id"), F.lit(" in session "), F.col("_m.session_id")).alias("detail"),
            F.col("_m.ts").alias("ts"), F.col("_m.session_id").alias("session_id"), "technique_id",
        )
    )
    replays = camp.filter((F.col("session_count") >= MIN_NOTABLE_SESSIONS) & (F.col("last_seen") >= since)).select(
        F.concat(F.lit("campaign:"), "fingerprint").alias("id"), F.lit("campaign").alias("kind"), F.lit("CORRELATED").alias("provenance"),
        F.concat(F.lit("Campaign "), "fingerprint", F.lit(": "), s("session_count"), F.lit(" sessions")).alias("title"),
        F.concat(
            F.lit("The same "), s("command_count"), F.lit("-command sequence from "), s("attacker_ip_count"), F.lit(" source address(es)")
        ).alias("detail"),
        F.col("last_seen").alias("ts"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("technique_id"),
    )
    rare = first.unionByName(replays).withColumn("_p", F.lit(0))
    return (
        rare.unionByName(high.withColumn("_p", F.lit(1)))
        .orderBy("_p", F.desc("ts"), F.asc("id")).limit(MAX_NOTABLES).drop("_p")
    )


def coverage(catalog: DataFrame, tm: DataFrame, an: DataFrame) -> DataFrame:
    """Every catalog technique; observed only when a rule produced a mapping."""
    rows = tm.join(an.select("analysis_id", "session_id"), "analysis_id")
    facts = rows.groupBy("technique_id").agg(
        F.bool_or(F.col("source") == "rule").alias("_rule"), F.max("confidence").alias("confidence"), F.max("ts").alias("last_seen")
    )
    sess = rows.select("technique_id", "session_id").distinct().groupBy("technique_id").agg(F.count(F.lit(1)).alias("session_count"))
    return (
        catalog.join(facts, "technique_id", "left").join(sess, "technique_id", "left")
        .select(
            "technique_id", "name", "tactic", F.coalesce("_rule", F.lit(False)).alias("observed"),
            F.coalesce("session_count", F.lit(0)).alias("session_count"), "confidence", "last_seen",
        )
    )


def coverage_evidence(catalog: DataFrame, tm: DataFrame, an: DataFrame) -> DataFrame:
    """The mappings behind each catalog technique of `coverage`, one row each."""
    rows = tm.join(an.select("analysis_id", "session_id"), "analysis_id").join(catalog.select("technique_id"), "technique_id", "left_semi")
    return rows.select("technique_id", "analysis_id", "session_id", "source", "confidence", "ts")


def coverage_totals(covered: DataFrame) -> DataFrame:
    """Observed techniques beside all of the catalog, by tactic."""
    return covered.groupBy("tactic").agg(F.count_if("observed").alias("observed"), F.count(F.lit(1)).alias("total"))


def probe_candidates(ev: DataFrame, probes: DataFrame, agent_passwords: list[str], include_seeded=False, include_private=False, max_length: int | None = None) -> DataFrame:
    """Normalised command segments by distinct sessions, then addresses.

    The evaluation agent's own sessions, seeded rows and non-global addresses stay out. Segments
    are split once per distinct command line.
    """
    agent = ev.filter(F.col("password").isin(*agent_passwords)).select("session_id").distinct()
    rows = ev.filter((F.col("action") == COMMAND) & F.col("command_line").isNotNull() & text.up_to("command_line", max_length))
    if not include_seeded:
        rows = rows.filter(~F.coalesce("labels_seeded", F.lit(False)))
    if not include_private:
        rows = rows.filter(F.coalesce(net.is_global("source_ip"), F.lit(False)))
    rows = rows.join(agent, "session_id", "left_anti").select("session_id", "source_ip", "command_line").distinct()
    parts = (
        rows.select("command_line").distinct()
        .select("command_line", F.explode_outer(text.command_segments("command_line")).alias("_s"))
        .select("command_line", text.normalize_command("_s").alias("command"), F.trim("_s").alias("example"))
        .filter(F.col("command") != "").distinct()
    )
    runs = rows.join(parts, "command_line")
    by_session = runs.groupBy("command", "session_id").agg(F.min(F.struct("session_id", "source_ip", "command_line", "example")).alias("_e"))
    sess = by_session.groupBy("command").agg(F.count(F.lit(1)).alias("sessions"), F.min("_e").alias("_e"))
    ips = runs.select("command", "source_ip").distinct().groupBy("command").agg(F.count(F.lit(1)).alias("source_ips"))
    covered = probes.select(text.normalize_command("command").alias("command"), "probe_id", "position").groupBy("command").agg(
        F.max_by("probe_id", "position").alias("covered_by")
    )
    return sess.join(ips, "command").join(covered, "command", "left").select(
        "command", F.col("_e.example").alias("example"), "sessions", "source_ips", "covered_by"
    )


def unexamined_commands(ev: DataFrame, max_length: int) -> DataFrame:
    """Command events that a `max_length` leaves out, beside all of them."""
    cmds = ev.filter(F.col("action") == COMMAND)
    return cmds.agg(F.count_if(F.length("command_line") > max_length).alias("too_long"), F.count(F.lit(1)).alias("commands"))
