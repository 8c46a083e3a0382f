"""Decoy evaluation: facts, scores, contradictions, chains, findings, lifecycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.functions.bind import bind
from lureframe.functions.ordered import interval_join, number_rows, top_per_group
from lureframe.operators.rules import rule_hits
from lureframe.operators.sessions import COMMAND
from lureframe.session import write_once
from lureframe.sources.reference import CHARACTERISTICS, PROBES

# --- fixed values -------------------------------------------------------------------------------
OPEN_PORT = r"(?m)^(\d+)/tcp[ \t]+open[ \t]+(.*)$"
PACKETS = r"(?m)^\s*(\d+) packets captured"
EXPECTED_SERVICES = {"service.ssh": 2222, "service.telnet": 2223, "service.http": 80}
ITEM_CHARS = text.TOKEN_BUDGET * text.CHARS_PER_TOKEN // 2
PACKAGE_ITEMS, PACKAGE_CHARS, MIN_ITEM_CHARS = 40, 60_000, 400
NOTICE_ID = "package-truncation-notice"
HISTORY_RUNS = 20
STATUS_ORDER = {"regressed": 0, "new": 1, "persisting": 2, "undetermined": 3, "fixed": 4}
# --- end of fixed values ------------------------------------------------------------------------


# The shape of a run's marker; the tag may itself hold underscores.
MARKER = r"(?=(__[A-Za-z0-9](?:[A-Za-z0-9_]*?[A-Za-z0-9])??_?[0-9a-f]{16}__))"


def fact_from_scan(scans: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """V1: expected services from port-scan text. A scan that did not complete establishes nothing."""
    expected = EXPECTED_SERVICES if expected is None else expected
    ports = F.regexp_extract_all("output", F.lit(OPEN_PORT), F.lit(1))
    banners = F.regexp_extract_all("output", F.lit(OPEN_PORT), F.lit(2))
    # A later line for a port replaces an earlier one.
    lines = F.arrays_zip(ports.alias("p"), banners.alias("b"))
    found = scans.select("run_id", "module_status", lines.alias("_l"))
    one_per_service = found.withColumn("_s", F.explode(F.array(*[
        F.struct(F.lit(f).alias("establishes"), F.lit(p).alias("port")) for f, p in expected.items()
    ])))
    matching = F.filter("_l", lambda x: x["p"].cast("int") == F.col("_s.port"))
    banner = F.trim(F.try_element_at(matching, F.lit(-1))["b"])
    value = F.when(F.col("module_status") == "completed", F.when(banner != "", banner))
    return one_per_service.select(
        "run_id", F.lit("nmap").alias("module"), F.col("_s.establishes").alias("probe_id"), F.col("_s.establishes").alias("establishes"),
        value.alias("value"),
        F.when(F.col("module_status") != "completed", "unknown").when(value.isNotNull(), "observed").otherwise("not_observed").alias("fact_status"),
    )


def fact_from_capture(captures: DataFrame) -> DataFrame:
    """V1: whether packets crossed the interface; no count in either stream is unknown."""
    count = lambda c: F.when(F.col(c).rlike(PACKETS), F.regexp_extract(c, PACKETS, 1))
    value = F.when(F.col("module_status") == "completed", F.coalesce(count("stderr"), count("stdout")))
    return captures.select(
        "run_id", F.lit("tcpdump").alias("module"), F.lit("network.activity").alias("probe_id"),
        F.lit("network.activity").alias("establishes"), value.alias("value"),
        F.when(value.isNull(), "unknown").when(value.cast("decimal(38,0)") > 0, "observed").otherwise("not_observed").alias("fact_status"),
    )


def characteristic(module: Column, probe_id: Column) -> Column:
    by_probe = F.create_map(*[F.lit(v) for p in PROBES for v in (p[0], p[1])])
    return (
        F.when(module == "nmap", "services").when(module == "tcpdump", "context")
        .otherwise(F.coalesce(F.try_element_at(by_probe, probe_id), F.lit("context")))
    )


def _facts(pr: DataFrame, st: DataFrame | None) -> DataFrame:
    rows = pr.select("run_id", characteristic(F.col("module"), F.col("probe_id")).alias("characteristic"), "fact_status")
    if st is not None:
        rows = rows.unionByName(st.select("run_id", F.lit("attack_possibilities").alias("characteristic"), "fact_status"))
    return rows


def scores(pr: DataFrame, st: DataFrame | None = None) -> DataFrame:
    """V2: observed over established per run and characteristic; null when nothing was established.
    There is no composite on purpose."""
    established = F.count_if(F.col("fact_status").isin("observed", "not_observed"))
    observed = F.count_if(F.col("fact_status") == "observed")
    return _facts(pr, st).groupBy("run_id", "characteristic").agg(
        F.when(established > 0, F.bround(observed / established, 3)).alias("score")
    )


def fact_claims(pr: DataFrame, probes=PROBES) -> DataFrame:
    """V3: what an observation claims about its fact. One literal pattern per probe family."""
    value, probe_id = F.col("value"), F.col("probe_id")
    ids_where = lambda i, x: [p[0] for p in probes if p[i] == x]
    claim = None
    for pattern in dict.fromkeys(p[4] for p in probes if p[4]):
        flagged = "(?iuUd)" + pattern
        # An array of the first match, empty when there is none: an unread claim is null.
        read = F.lower(text.squeeze(F.try_element_at(F.regexp_extract_all(value, F.lit(flagged), F.lit(1)), F.lit(1))))
        cond = probe_id.isin(*ids_where(4, pattern))
        claim = F.when(cond, read) if claim is None else claim.when(cond, read)
    claim = value if claim is None else claim.otherwise(value)
    tables = [p[5] for n, p in enumerate(probes) if p[5] and p[5] not in [x[5] for x in probes[:n]]]

    def aliased(c: Column) -> Column:
        out = None
        for table in tables:
            mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), c), c)
            cond = probe_id.isin(*ids_where(5, table))
            out = F.when(cond, mapped) if out is None else out.when(cond, mapped)
        return c if out is None else out.otherwise(c)

    return pr.withColumn("claim", bind(claim, aliased))


def contradictions(claims: DataFrame) -> DataFrame:
    """V4: two observations of one run that claim different things about one fact.

    Repeats of one probe with one claim are merged first (the earliest stands), so the self-join
    only ever sees a run's distinct (probe, claim) readings of a fact.
    """
    usable = claims.filter("establishes IS NOT NULL AND value IS NOT NULL AND fact_status = 'observed' AND claim IS NOT NULL")
    distinct = usable.groupBy("run_id", "establishes", "probe_id", "claim").agg(F.min(F.struct("position", "value")).alias("_m"))
    a, b = distinct.alias("a"), distinct.alias("b")
    on = (
        (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.establishes") == F.col("b.establishes"))
        & (F.col("a._m.position") < F.col("b._m.position")) & (F.col("a.claim") != F.col("b.claim"))
    )
    return a.join(b, on).select(
        F.col("a.run_id").alias("run_id"), F.col("a.establishes").alias("fact"), F.col("a.probe_id").alias("probe_a"),
        F.col("b.probe_id").alias("probe_b"), F.col("a._m.value").alias("value_a"), F.col("b._m.value").alias("value_b"),
    )


def verify_chains(commands: DataFrame, complete: DataFrame, steps: DataFrame, expected: DataFrame) -> DataFrame:
    """V5: for each complete (run, chain) and expected technique, the hit latest in the chain's own
    steps. A command outside the steps ranks below all others; of equals the first one counts."""
    place = steps.groupBy("chain_id", F.col("command").alias("command_line")).agg(F.min("step_index").alias("_step"))
    hits = rule_hits(commands).join(place, ["chain_id", "command_line"], "left")
    rank = F.coalesce("_step", F.lit(-1))
    best = hits.groupBy("run_id", "chain_id", "technique_id").agg(
        F.min(F.struct((-rank).alias("r"), "ts", "event_id", "command_line")).alias("_h")
    )
    wanted = complete.select("run_id", "chain_id").distinct().join(expected, "chain_id")
    return wanted.join(best, ["run_id", "chain_id", "technique_id"], "left").select(
        "run_id", "chain_id", "step_index", "technique_id", F.coalesce(F.col("_h.command_line"), F.lit("")).alias("command"),
        F.col("_h.event_id").alias("event_id"), F.when(F.col("_h").isNotNull(), F.col("technique_id")).alias("matched_rule_id"),
        F.when(F.col("_h").isNotNull(), "observed").otherwise("not_observed").alias("fact_status"),
    )


def sessions_by_marker(ev: DataFrame, markers: DataFrame, skew_seconds: int = 300) -> DataFrame:
    """V6: each run's own session, found by the marker its commands carry.

    `markers`: run_id, nonce, honeypot_id, started_at, finished_at. A marker is two underscores, a tag, sixteen hex
    digits and two underscores, anywhere in a command. Command lines are scanned for that shape, so events meet
    runs on (sensor, marker, time bucket) and the candidates are the marked commands, not the log.
    """
    commands = ev.filter((F.col("action") == COMMAND) & F.contains("command_line", F.lit("__")) & ~F.coalesce("labels_seeded", F.lit(False)))
    words = commands.select(
        "session_id", "honeypot_id", "ts",
        # Looking ahead finds markers that share their underscores.
        F.explode(F.array_distinct(F.regexp_extract_all("command_line", F.lit(MARKER), F.lit(1)))).alias("nonce"),
    )
    gap = F.expr(f"INTERVAL {skew_seconds} SECOND")
    spans = markers.select("run_id", "nonce", "honeypot_id", (F.col("started_at") - gap).alias("start"), (F.col("finished_at") + gap + F.expr("INTERVAL 1 MICROSECOND")).alias("end"))
    found = interval_join(words, spans, ["honeypot_id", "nonce"], "ts")
    return found.groupBy("run_id").agg(F.min_by("session_id", F.struct("ts", "session_id")).alias("session_id"))


def probe_key(module: Column, probe_id: Column, establishes: Column) -> Column:
    return F.when(module == "nmap", F.concat(F.lit("service:"), establishes)).otherwise(
        F.concat(F.lit("probe:"), probe_id, F.lit(":"), establishes)
    )


def chain_key(chain_id: Column, technique_id: Column) -> Column:
    return F.concat(F.lit("chain:"), chain_id, F.lit(":"), technique_id)


def severity_band(rating: Column) -> Column:
    """V9: the evaluator's own rating in the severity vocabulary."""
    return F.when(rating < 0.34, "high").when(rating < 0.67, "medium").when(rating.isNotNull(), "low")


def _first_per_key(rows: DataFrame) -> DataFrame:
    cols = ["position", "characteristic", "severity", "finding", "evidence_ids"]
    return rows.groupBy("run_id", "finding_key").agg(F.min(F.struct(*cols)).alias("_f")).select(
        "run_id", "finding_key", *[F.col(f"_f.{c}").alias(c) for c in cols[1:]]
    )


def fact_findings(pr: DataFrame, st: DataFrame) -> DataFrame:
    """V7: every `not_observed` fact as a finding, one per key. `unknown` produces nothing."""
    c = F.col
    service = c("module") == "nmap"
    failed = "fact_status = 'not_observed'"
    probes = pr.filter(failed).select(
        "run_id", probe_key(c("module"), c("probe_id"), c("establishes")).alias("finding_key"), c("position").cast("int").alias("position"),
        characteristic(c("module"), c("probe_id")).alias("characteristic"), F.lit("medium").alias("severity"),
        text.truncate_middle(
            F.when(service, F.concat(F.lit("expected service "), "establishes", F.lit(" was not found")))
            .otherwise(F.concat("probe_id", F.lit(" did not establish "), "establishes")), ITEM_CHARS,
        ).alias("finding"),
        F.array(F.concat(F.lit("probe:"), "result_id")).alias("evidence_ids"),
    )
    chains = st.filter(failed).select(
        "run_id", chain_key(c("chain_id"), c("expected_technique_id")).alias("finding_key"), c("step_index").cast("int").alias("position"),
        F.lit("attack_possibilities").alias("characteristic"), F.lit("high").alias("severity"),
        text.truncate_middle(
            F.concat(F.lit("chain "), "chain_id", F.lit(": expected technique "), "expected_technique_id", F.lit(" was not observed")), ITEM_CHARS
        ).alias("finding"),
        F.array(F.concat(F.lit("chain:"), "step_id")).alias("evidence_ids"),
    )
    return _first_per_key(probes.unionByName(chains))


def _quoted(x: Column) -> Column:
    safe = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        safe = F.replace(safe, F.lit(raw), F.lit(shown))
    single, double = F.contains(safe, F.lit("'")), F.contains(safe, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), safe, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def sanity_findings(con: DataFrame, pr: DataFrame) -> DataFrame:
    """V8: each contradiction as a high finding; its key sorts the two probes."""
    first = pr.groupBy("run_id", "probe_id").agg(F.min(F.struct("position", "result_id")).alias("_p"))
    ids = lambda side: first.select("run_id", F.col("probe_id").alias(f"probe_{side}"), F.concat(F.lit("probe:"), F.col("_p.result_id")).alias(f"_id_{side}"), F.col("_p.position").cast("int").alias(f"_pos_{side}"))
    rows = con.join(ids("a"), ["run_id", "probe_a"], "left").join(ids("b"), ["run_id", "probe_b"], "left")
    pair = F.array_join(F.array_sort(F.array("probe_a", "probe_b")), "+")
    return _first_per_key(rows.select(
        "run_id", F.concat(F.lit("sanity:"), "fact", F.lit(":"), pair).alias("finding_key"), F.col("_pos_a").alias("position"),
        F.lit("sanity").alias("characteristic"), F.lit("high").alias("severity"),
        text.truncate_middle(F.concat(
            "probe_a", F.lit(" and "), "probe_b", F.lit(" disagree about "), "fact", F.lit(": "),
            _quoted(F.col("value_a")), F.lit(" vs "), _quoted(F.col("value_b")),
        ), ITEM_CHARS).alias("finding"),
        F.array("_id_a", "_id_b").alias("evidence_ids"),
    ))


def fact_status_by_key(pr: DataFrame, st: DataFrame) -> DataFrame:
    """Each run's fact per finding key, whatever its status; the latest row of a key stands."""
    c = F.col
    probes = pr.filter("establishes IS NOT NULL").select(
        "run_id", probe_key(c("module"), c("probe_id"), c("establishes")).alias("key"), c("position").cast("int").alias("position"), "fact_status"
    )
    chains = st.select("run_id", chain_key(c("chain_id"), c("expected_technique_id")).alias("key"), c("step_index").cast("int").alias("position"), "fact_status")
    return probes.unionByName(chains).groupBy("run_id", "key").agg(F.max_by("fact_status", F.struct("position", "fact_status")).alias("fact_status"))


def run_states(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """present / absent / undetermined per (run, key). Silence is never absence."""
    named = findings.filter(~F.col("finding_key").rlike(r"\Aevaluator:.")).select("run_id", F.col("finding_key").alias("key"), F.lit(True).alias("_f")).distinct()
    both = named.join(facts.filter(~F.col("key").rlike(r"\Aevaluator:.")), ["run_id", "key"], "full")
    return both.select(
        "run_id", "key",
        F.when(F.col("_f"), "present").when(F.col("fact_status") == "observed", "absent").otherwise("undetermined").alias("state"),
    )


def run_sequence(runs: DataFrame) -> DataFrame:
    """Runs numbered per decoy in start order; skew-safe for a decoy with most of the runs."""
    return number_rows(runs, ["honeypot_id"], "started_at", "run_id", out="seq")


def consecutive(runs: DataFrame) -> DataFrame:
    """Each run (head) with the run before it on the same decoy (base)."""
    seq = run_sequence(runs)
    base = seq.select(
        "honeypot_id", (F.col("seq") + 1).alias("seq"), F.col("run_id").alias("base_run_id"),
        F.col("honeypot_fingerprint").alias("_bh"), F.col("evaluation_config_fingerprint").alias("_bc"),
    )
    differences = F.array_compact(F.array(
        F.when(~F.col("honeypot_fingerprint").eqNullSafe(F.col("_bh")), F.lit("honeypot_fingerprint")),
        F.when(~F.col("evaluation_config_fingerprint").eqNullSafe(F.col("_bc")), F.lit("evaluation_config_fingerprint")),
    ))
    return seq.join(base, ["honeypot_id", "seq"]).select(
        "honeypot_id", "seq", F.col("run_id").alias("head_run_id"), "base_run_id", differences.alias("differences"),
        (~F.array_contains(differences, "evaluation_config_fingerprint")).alias("attributable"),
    )


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Every run with its number on its decoy, the run before it and the run after it, with what changed between them."""
    pairs = consecutive(runs)
    before = pairs.select(F.col("head_run_id").alias("run_id"), "base_run_id", F.struct("differences", "attributable").alias("since"))
    after = pairs.select(F.col("base_run_id").alias("run_id"), F.col("head_run_id").alias("next_run_id"), F.struct("differences", "attributable").alias("until"))
    own = run_sequence(runs).select("run_id", "honeypot_id", "seq", "status")
    return own.join(before, "run_id", "left").join(after, "run_id", "left")


def lifecycle(runs: DataFrame, findings: DataFrame, facts: DataFrame) -> DataFrame:
    """What happened to every defect between a run and the run before it on its decoy.

    One pass over the states, in run order per (decoy, key): range frames over the run number see the state one run
    earlier, one run later, and whether a completed run of the look-back had the defect. A row answers for its own
    run, and, where the next run says nothing about its key, for that one.
    """
    # A key without a row counts as undetermined, so such rows aren't kept.
    states = run_states(findings, facts).filter("state <> 'undetermined'").join(write_once(numbered_runs(runs)), "run_id")
    present = F.col("state") == "present"
    by_run = Window.partitionBy("honeypot_id", "key").orderBy("seq")
    near = (
        states.withColumn("before", F.coalesce(F.max("state").over(by_run.rangeBetween(-1, -1)), F.lit("undetermined")))
        .withColumn("_silent", F.count(F.lit(1)).over(by_run.rangeBetween(1, 1)) == 0)
        .withColumn("_was", F.count(F.when(present & (F.col("status") == "completed"), 1)).over(by_run.rangeBetween(-HISTORY_RUNS - 1, -2)) > 0)
    )
    status = (
        F.when(present & (F.col("before") == "present"), "persisting")
        .when(present, F.when(F.col("_was"), "regressed").otherwise("new")).otherwise("fixed")
    )
    row = lambda head, base, what, source, changes: F.struct(
        F.col(head).alias("head_run_id"), F.col(base).alias("base_run_id"), "key", what.alias("status"), F.col(source).alias("from_run"), F.col(f"{changes}.attributable").alias("attributable"))
    own = F.when(F.col("base_run_id").isNotNull() & (present | (F.col("before") == "present")),
                 F.when(present, row("run_id", "base_run_id", status, "run_id", "since")).otherwise(row("run_id", "base_run_id", status, "base_run_id", "since")))
    silent = F.when(present & F.col("next_run_id").isNotNull() & F.col("_silent"), row("next_run_id", "run_id", F.lit("undetermined"), "run_id", "until"))
    order = F.create_map(*[F.lit(v) for kv in STATUS_ORDER.items() for v in kv])
    return near.select(F.inline(F.array_compact(F.array(own, silent)))).select(
        "head_run_id", "base_run_id", "key", "status", F.try_element_at(order, F.col("status")).alias("severity_rank"), "from_run", "attributable"
    )


def deltas(runs: DataFrame, sc: DataFrame) -> DataFrame:
    """Score change per characteristic between a run and the run before it; null when either side was not established.

    Scores are dealt once, by (decoy, characteristic); a range frame over the run number gives the earlier score.
    """
    by_run = Window.partitionBy("honeypot_id", "characteristic").orderBy("seq")
    near = (
        sc.select("run_id", "characteristic", "score").join(write_once(numbered_runs(runs)), "run_id")
        .withColumn("_base", F.max("score").over(by_run.rangeBetween(-1, -1)))
        .withColumn("_silent", F.count(F.lit(1)).over(by_run.rangeBetween(1, 1)) == 0)
    )
    none = F.lit(None).cast("double")
    row = lambda head, base, before, after, changes: F.struct(
        F.col(head).alias("head_run_id"), F.col(base).alias("base_run_id"), "characteristic", before.cast("double").alias("base"), after.cast("double").alias("head"), F.col(f"{changes}.differences").alias("differences"))
    own = F.when(F.col("base_run_id").isNotNull(), row("run_id", "base_run_id", F.col("_base"), F.col("score"), "since"))
    silent = F.when(F.col("next_run_id").isNotNull() & F.col("_silent"), row("next_run_id", "run_id", F.col("score"), none, "until"))
    return near.select(F.inline(F.array_compact(F.array(own, silent)))).select(
        "head_run_id", "base_run_id", "characteristic", "base", "head", F.bround(F.col("head") - F.col("base"), 3).alias("delta"),
        "differences",
        F.when(F.size("differences") == 0, "same_configuration").otherwise("configuration_changed").alias("classification"),
    )


def reassessments(pairs: DataFrame, ratings: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The evaluator's rating and verdict on both sides with its own status. `ratings`: run_id,
    characteristic, evaluator_rating, evaluator_status; `verdicts`: run_id, characteristic, verdict. A
    characteristic with only a verdict counts too."""
    if verdicts is None:
        ratings = ratings.withColumn("verdict", F.lit(None).cast("string"))
    else:
        ratings = ratings.join(verdicts.select("run_id", "characteristic", "verdict"), ["run_id", "characteristic"], "full")
    head = pairs.select("head_run_id").join(ratings.withColumnRenamed("run_id", "head_run_id"), "head_run_id").select(
        "head_run_id", "characteristic", F.col("evaluator_rating").alias("head_rating"), F.col("evaluator_status").alias("head_status"), F.col("verdict").alias("head_verdict")
    )
    base = pairs.select("head_run_id", "base_run_id").join(ratings.withColumnRenamed("run_id", "base_run_id"), "base_run_id").select(
        "head_run_id", "characteristic", F.col("evaluator_rating").alias("base_rating"), F.col("evaluator_status").alias("base_status"), F.col("verdict").alias("base_verdict")
    )
    both = head.join(base, ["head_run_id", "characteristic"], "full").filter("coalesce(head_rating, base_rating) IS NOT NULL OR coalesce(head_verdict, base_verdict) IS NOT NULL")
    return both.join(pairs.select("head_run_id", "base_run_id"), "head_run_id").select(
        "head_run_id", "base_run_id", "characteristic", "base_rating", "head_rating",
        F.coalesce("base_status", F.lit("not_scored")).alias("base_status"), F.coalesce("head_status", F.lit("not_scored")).alias("head_status"),
        "base_verdict", "head_verdict",
    )


def run_status(pr: DataFrame, st: DataFrame) -> DataFrame:
    """Completed as soon as one fact was established either way."""
    return _facts(pr, st).groupBy("run_id").agg(
        F.when(F.bool_or(F.col("fact_status") != "unknown"), "completed").otherwise("failed").alias("status")
    )


def evaluator_status(ratings: DataFrame) -> DataFrame:
    """The worst status of a run's characteristics."""
    has = lambda s: F.bool_or(F.col("evaluator_status") == s)
    return ratings.groupBy("run_id").agg(
        F.when(has("evaluator_failed"), "evaluator_failed").when(has("completed"), "completed").otherwise("unavailable").alias("evaluator_status")
    )


def stability(runs: DataFrame, sc: DataFrame) -> DataFrame:
    """Spread of each score over an arm's runs; a run that established nothing counts in n only."""
    n = runs.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("evaluation_config_fingerprint") <= 1).alias("shared_config"))
    seen = runs.select("run_id", "arm").join(sc.filter("score IS NOT NULL"), "run_id").groupBy("arm", "characteristic").agg(
        F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.count("score").alias("established")
    )
    axis = n.withColumn("characteristic", F.explode(F.array(*[F.lit(c) for c in CHARACTERISTICS])))
    return axis.join(seen, ["arm", "characteristic"], "left").select(
        "arm", "characteristic", "mean", "min", "max", F.coalesce("established", F.lit(0)).alias("established"), "n", "shared_config"
    )


def contradictions_per_run(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Self-contradictions of every run, zero included."""
    counted = findings.filter(F.col("finding_key").startswith("sanity:")).groupBy("run_id").agg(F.count(F.lit(1)).alias("contradictions"))
    return runs.select("run_id", "arm").join(counted, "run_id", "left").withColumn("contradictions", F.coalesce("contradictions", F.lit(0)))


def retention_plan(ev: DataFrame, session_refs: list[DataFrame], event_refs: list[DataFrame], cutoff: datetime) -> DataFrame:
    """Per day partition why it is kept, or null when it may go. Deletes nothing.

    References are united and made distinct once, then met by two semi-joins.
    """
    day = F.to_date("ts").alias("partition")
    rows = ev.select(day, "ts", "session_id", "event_id")
    states = rows.groupBy("partition").agg(F.max("ts").alias("newest"))

    def united(frames, column):
        out = None
        for f in frames:
            f = f.select(F.col(f.columns[0]).alias(column)).filter(F.col(column).isNotNull())
            out = f if out is None else out.unionByName(f)
        return out.distinct()

    held = []
    if session_refs:
        held.append(rows.join(united(session_refs, "session_id"), "session_id", "left_semi").select("partition", "event_id"))
    if event_refs:
        held.append(rows.join(united(event_refs, "event_id"), "event_id", "left_semi").select("partition", "event_id"))
    if held:
        both = held[0] if len(held) == 1 else held[0].unionByName(held[1]).distinct()
        states = states.join(both.groupBy("partition").agg(F.count(F.lit(1)).alias("referenced")), "partition", "left")
    else:
        states = states.withColumn("referenced", F.lit(0))
    # The newest day is the write target.
    write = rows.agg(F.max("partition")).scalar()
    limit = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp")
    n = F.coalesce("referenced", F.lit(0))
    return states.withColumn("_w", write).select(
        "partition", "newest", n.alias("referenced"),
        F.when(F.col("partition") == F.col("_w"), "write_target").when(F.col("newest") >= limit, "newer_than_cutoff")
        .when(n > 0, "referenced").alias("keep_reason"),
    )


def rotated_logs(files: DataFrame, cutoff: datetime) -> DataFrame:
    """Rotated log files whose day ended before the cutoff; the live file has no date."""
    day = F.regexp_extract("name", r"\.(\d{4}-\d{2}-\d{2})$", 1)
    ended = F.date_add(F.to_date(F.nullif(day, F.lit(""))), 1).cast("timestamp")
    return files.filter(ended <= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp"))


# V15 inputs: reviewed file bodies, and the distribution bodies keyed by the word a probe reads.
TEMPLATES = {
    "passwd_present": ("etc/passwd", "root:x:0:0:root:/root:/bin/bash\nnobody:x:65534:65534:nobody:/nonexistent:/usr/sbin/nologin\n"),
    "proc_cpuinfo": ("proc/cpuinfo", "processor\t: 0\nvendor_id\t: GenuineIntel\nmodel name\t: Intel(R) Xeon(R) CPU\n"),
}
OS_RELEASE_PATH = "usr/lib/os-release"
OS_RELEASE = {
    "debian": 'PRETTY_NAME="Debian GNU/Linux 12 (bookworm)"\nID=debian\nVERSION_ID="12"\n',
    "ubuntu": 'PRETTY_NAME="Ubuntu 22.04.3 LTS"\nID=ubuntu\nVERSION_ID="22.04"\n',
}
HOSTS_BODY = "127.0.0.1\tlocalhost\n127.0.1.1\t{name}\n::1     localhost ip6-localhost ip6-loopback\n"


def remediation(findings: DataFrame, claims: DataFrame, templates=None, os_release=None) -> DataFrame:
    """One patch or one explicit reason per finding and file. Every finding keeps a row.

    The observed values a fix derives from are two per run, joined on the run.
    """
    templates = TEMPLATES if templates is None else templates
    os_release = OS_RELEASE if os_release is None else os_release
    seen = claims.filter("fact_status = 'observed' AND value IS NOT NULL AND value <> ''").groupBy("run_id").agg(
        F.max_by(F.when(F.col("probe_id") == "uname", F.col("claim")), F.when(F.col("probe_id") == "uname", F.col("position"))).alias("_distro"),
        F.max_by(F.when(F.col("probe_id") == "hostname_cmd", F.col("value")), F.when(F.col("probe_id") == "hostname_cmd", F.col("position"))).alias("_host"),
    )
    parts = F.split("finding_key", ":", 3)
    f = findings.select("run_id", "finding_key").join(seen, "run_id", "left").select(
        "*", parts[0].alias("_kind"), F.get(parts, F.lit(1)).alias("_a"), F.get(parts, F.lit(2)).alias("_b")
    )
    patch = lambda path, content, template: F.struct(path.alias("path"), content.alias("content"), F.lit(template).alias("from_template"))
    none = F.array().cast("array<struct<path:string,content:string,from_template:boolean>>")
    bodies = F.create_map(*[F.lit(v) for kv in os_release.items() for v in kv])
    os_body = F.try_element_at(bodies, F.col("_distro"))
    os_fix = F.when(os_body.isNotNull(), F.array(patch(F.lit(OS_RELEASE_PATH), os_body, True))).otherwise(none)
    pair = F.split(F.coalesce("_b", F.lit("")), r"\+")
    host = F.col("_host")
    host_fix = F.array_compact(F.array(
        F.when(F.array_contains(pair, "hostname_file"), patch(F.lit("etc/hostname"), F.concat(host, F.lit("\n")), False)),
        F.when(F.array_contains(pair, "hosts_file"), patch(F.lit("etc/hosts"), F.replace(F.lit(HOSTS_BODY), F.lit("{name}"), host), False)),
    ))
    kind, a = F.col("_kind"), F.col("_a")
    probe_os, sanity_os = (kind == "probe") & (a == "os_release"), (kind == "sanity") & (a == "os.identity")
    host_case = (kind == "sanity") & (a == "host.name")
    fixes = F.when(probe_os | sanity_os, os_fix).when(host_case & host.isNotNull(), host_fix)
    for probe, (path, body) in templates.items():
        fixes = fixes.when((kind == "probe") & (a == probe), F.array(patch(F.lit(path), F.lit(body), True)))
    reason = (
        F.when((probe_os | sanity_os) & os_body.isNull(), "no_agreeing_os_release")
        .when(host_case & host.isNull(), "hostname_not_observed")
        .when((kind == "probe") & ~a.isin("os_release", *templates), "no_lever_for_probe")
        .when((kind == "sanity") & (a == "host.arch"), "architecture_shows_in_file_tree")
        .when((kind == "sanity") & ~a.isin("host.name", "os.identity"), "no_lever_for_fact")
        .when(kind == "service", "service_list_is_evaluation_config").when(kind == "chain", "many_possible_causes")
        .when(kind == "evaluator", "prose_not_a_patch")
        .when(~kind.isin("probe", "sanity"), "unrecognised_key")
    )
    return f.withColumn("unsupported_reason", reason).withColumn("_p", F.explode_outer(F.coalesce(fixes.otherwise(none), none))).select(
        "run_id", "finding_key", "_p.path", "_p.content", F.coalesce("_p.from_template", F.lit(False)).alias("from_template"), "unsupported_reason"
    )


def evidence_packages(pr: DataFrame, st: DataFrame) -> DataFrame:
    """The bounded evidence of each (run, characteristic): at most forty items, each with its
    share of the text, and a notice that counts what was left out."""
    c = F.col
    txt = lambda x, d: F.when(F.coalesce(x, F.lit("")) == "", d).otherwise(x)
    probes = pr.select(
        "run_id", characteristic(c("module"), c("probe_id")).alias("characteristic"), F.lit(0).alias("_s"), c("position").cast("int").alias("_o"),
        F.concat(F.lit("probe:"), "result_id").alias("item_id"),
        F.concat(
            F.lit("probe "), "probe_id", F.lit(" (module "), "module", F.lit(") establishes "), txt(c("establishes"), F.lit("nothing declared")),
            F.lit("; fact_status="), "fact_status", F.lit("; output: "), txt(c("raw_output"), F.lit("(no output)")),
        ).alias("summary"),
    )
    chains = st.select(
        "run_id", F.lit("attack_possibilities").alias("characteristic"), F.lit(1).alias("_s"), c("step_index").cast("int").alias("_o"),
        F.concat(F.lit("chain:"), "step_id").alias("item_id"),
        F.concat(
            F.lit("chain "), "chain_id", F.lit(" step "), c("step_index").cast("string"), F.lit(" expected "), "expected_technique_id",
            F.lit("; fact_status="), "fact_status", F.lit("; matched_rule="), txt(c("matched_rule_id"), F.lit("none")),
            F.lit("; command: "), txt(c("command"), F.lit("(no matching command)")),
        ).alias("summary"),
    )
    key = ["run_id", "characteristic"]
    items = probes.unionByName(chains)
    totals = items.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    kept = top_per_group(items, key, [F.asc("_s"), F.asc("_o"), F.asc("item_id")], PACKAGE_ITEMS).join(totals, key)
    size = F.least(F.col("_n"), F.lit(PACKAGE_ITEMS))
    share = F.least(F.lit(ITEM_CHARS), F.greatest(F.lit(MIN_ITEM_CHARS), F.floor(F.lit(PACKAGE_CHARS) / size))).cast("int")
    kept = kept.withColumn("_share", share)
    rows = kept.select(*key, "item_id", text.truncate_middle("summary", F.col("_share")).alias("summary"))
    over = totals.filter(F.col("_n") > PACKAGE_ITEMS).select(
        *key, F.lit(NOTICE_ID).alias("item_id"),
        F.concat(
            (F.col("_n") - PACKAGE_ITEMS).cast("string"),
            F.lit(" more items exist than this package may hold; this line counts them and is no item"),
        ).alias("summary"),
    )
    return rows.unionByName(over)


def probe_set_check(probes: DataFrame) -> DataFrame:
    """Facts whose probes do not all read them the same way."""
    # Only a declared fact is compared between probes.
    reading = F.concat_ws(
        "|", F.coalesce("extract", F.lit("-")),
        F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("aliases", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","),
    )
    return (
        probes.filter("establishes IS NOT NULL").select(F.col("establishes").alias("fact"), reading.alias("_r")).distinct()
        .groupBy("fact").agg(F.count(F.lit(1)).alias("readings")).filter("readings > 1")
    )
