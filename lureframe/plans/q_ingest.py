"""Registered queries: ingest, exports, reports and the smaller lookups."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.operators import campaigns as C
from lureframe.operators import claims as K
from lureframe.operators import evaluation as V
from lureframe.operators import experiment as X
from lureframe.operators import fleet, indicators, ingest, periods, reports, rules, search
from lureframe.operators import sessions as S
from lureframe.plans import adapter as A
from lureframe.plans import oracle as O
from lureframe.plans.oracle import sql, ts
from lureframe.plans.q_evaluation import ACTIONS, CL, CUTOFF, PR, ROT, RUNS, X_START, _chains
from lureframe.plans.q_sessions import EXTRACTED, SESSIONS, _ind, _links
from lureframe.plans.registry import query
from lureframe.session import shared_folder
from lureframe.sources import history, sinks


def _raw(spark, d):
    """The event log as sensor lines: some with an unknown field, an unplaceable address, or no JSON."""
    ev = A.events(spark, d)
    k = F.col("k")
    line = F.to_json(F.struct(
        F.col("action").alias("eventid"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
        F.col("session_id").alias("session"), F.when(k % 29 == 0, "not-an-ip").otherwise(F.col("source_ip")).alias("src_ip"),
        F.when(k % 23 == 0, "ssh").otherwise(F.col("source_port").cast("string")).alias("src_port"), F.when(F.col("protocol") == "telnet", "telnet").alias("protocol"),
        F.col("command_line").alias("input"), "username", "password", F.col("sha256").alias("shasum"), F.col("file_url").alias("url"),
        F.lit("noise").alias("message"), F.when(k % 17 == 0, "?").alias("mystery"), F.when(k % 3 == 0, 1.5).alias("duration"),
        F.when(k % 13 == 0, True).alias("late"), F.struct(F.when(k % 31 == 0, "x").alias("odd")).alias("network"),
    ))
    more = lambda fields: F.concat(F.regexp_replace(line, r"\}\z", ""), F.lit(fields))
    # Objects where text or an object is declared, at both depths; an action that is a number, with and without later steps.
    line = (
        F.when(k % 37 == 0, more(',"http":{"request":"x"}}')).when(k % 41 == 0, more(',"user_agent":{"original":{"a":1}}}'))
        .when(k % 43 == 0, F.to_json(F.struct(F.lit(5).alias("eventid"), F.col("session_id").alias("session"), F.col("source_ip").alias("src_ip"))))
        .when(k % 43 == 1, F.to_json(F.struct(F.lit(5).alias("eventid"), F.col("session_id").alias("session"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))))
        .when(k % 43 == 2, F.to_json(F.struct(F.lit("ssh").alias("protocol"), F.struct(F.lit("telnet").alias("protocol")).alias("network")))).otherwise(line)
    )
    return ev.select(F.when(k % 19 == 0, F.concat(F.lit("not json "), F.col("event_id").cast("string"))).otherwise(line).alias("raw"), "honeypot_id", "honeypot_name")


#: Lines whose own form decides them, before anything that their other fields say.
ODD_LINE = "k % 19 = 0 OR k % 43 <= 2 AND k % 37 <> 0 AND k % 41 <> 0"
UNKNOWN = f"""CASE WHEN k % 19 = 0 THEN '' WHEN {ODD_LINE} THEN CASE k % 43 WHEN 1 THEN 'timestamp' WHEN 2 THEN 'protocol' ELSE '' END
  ELSE concat_ws(',', CASE WHEN k % 13 = 0 AND action <> 'cowrie.session.file_download' THEN 'late' END, CASE WHEN k % 17 = 0 THEN 'mystery' END, CASE WHEN k % 31 = 0 THEN 'network.odd' END) END"""
BAD = f"""CASE WHEN k % 19 = 0 THEN 'malformed_json' WHEN {UNKNOWN} <> '' THEN 'unknown_field' WHEN {ODD_LINE} THEN NULL
  WHEN k % 29 = 0 THEN 'invalid_address' WHEN k % 23 = 0 OR k % 37 = 0 OR k % 41 = 0 THEN 'invalid_type' END"""


@query(
    "normalized_events",
    sql(f"""SELECT session_id, CASE WHEN NOT odd THEN ts END AS ts, CASE WHEN odd THEN '5' ELSE action END AS action, CASE WHEN odd THEN 'other' ELSE category END AS category,
      CASE WHEN odd THEN NULL ELSE CASE action WHEN 'cowrie.login.success' THEN 'success' WHEN 'cowrie.login.failed' THEN 'failure' WHEN 'cowrie.command.input' THEN 'success' END END AS outcome,
      source_ip, CASE WHEN NOT odd THEN source_port END AS source_port, CASE WHEN odd THEN 'ssh' ELSE protocol END AS protocol, CASE WHEN NOT odd THEN username END AS username,
      CASE WHEN NOT odd THEN command_line END AS command_line, CASE WHEN NOT odd THEN sha256 END AS sha256, honeypot_id
      FROM (SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts), {ODD_LINE} AS odd FROM ev WHERE {BAD} IS NULL)"""),
)
def _normalized(spark, d):
    good, _ = ingest.normalize(_raw(spark, d))
    return good.select("session_id", "ts", "action", "category", "outcome", "source_ip", "source_port", "protocol", "username", "command_line", "sha256", "honeypot_id")


@query(
    "dead_letters",
    sql(f"""SELECT reason, unknown_keys, count(*) AS n FROM (SELECT {BAD} AS reason, {UNKNOWN} AS unknown_keys FROM ev) WHERE reason IS NOT NULL GROUP BY 1, 2"""),
)
def _dead(spark, d):
    _, bad = ingest.normalize(_raw(spark, d))
    return bad.groupBy("reason", F.array_join("unknown_keys", ",").alias("unknown_keys")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_status",
    sql(f"SELECT count(*) FILTER (labels_seeded) AS seeded, count(*) AS events, count(*) FILTER ({BAD} IS NOT NULL) AS rejected FROM ev"),
)
def _ingest_status(spark, d):
    return fleet.ingest_status(A.events(spark, d), ingest.normalize(_raw(spark, d))[1])


@query(
    "url_parts",
    r"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path, CASE WHEN qq <> '' THEN qq END AS query FROM (
      SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^#?]*\?([^#]*)', 1) AS qq FROM pages)""",
)
def _url_parts(spark, d):
    path, qs = ingest.split_target(F.col("url"))
    return A.table(spark, d, "pages").select("page_id", path.alias("path"), qs.alias("query"))


@query(
    "truncated_outputs",
    """SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN len(l) <= 40 THEN text ELSE array_to_string(list_concat(l[1:20], ['... ' || (len(l) - 40) || ' lines omitted ...'], l[-20:]), chr(10)) END AS excerpt
      FROM (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)""",
)
def _outputs(spark, d):
    return A.table(spark, d, "documents").select("doc_id", text.truncate_output("text").alias("excerpt"))


@query(
    "event_defaults",
    sql("""SELECT event_id, coalesce(source_ip, '0.0.0.0') AS source_ip, coalesce(risk_score, 0) AS risk_score, coalesce(risk_level, 'informational') AS risk_level, protocol FROM ev"""),
)
def _defaults(spark, d):
    return search.with_defaults(A.events(spark, d)).select("event_id", "source_ip", "risk_score", "risk_level", "protocol")


@query("events_by_id", sql("SELECT event_id, session_id, action FROM ev WHERE event_id IN (SELECT event_id + 1 FROM ev WHERE action = 'cowrie.login.success')"))
def _by_id(spark, d):
    ev = A.events(spark, d)
    ids = ev.filter("action = 'cowrie.login.success'").select((F.col("event_id") + 1).alias("event_id"))
    return search.events_by_id(ev, ids).select("event_id", "session_id", "action")


@query(
    "list_runs",
    sql("""SELECT r.run_id, r.honeypot_id, r.status, s.characteristic, s.score FROM (SELECT * FROM ru ORDER BY started_at DESC, run_id DESC LIMIT 50) r LEFT JOIN sc s USING (run_id)""", RUNS, PR),
)
def _list_runs(spark, d):
    rows = search.list_runs(A.runs(spark, d), V.scores(A.probe_results(spark, d), A.chain_results(spark, d)))
    return rows.select("run_id", "honeypot_id", "status", "characteristic", "score")


@query(
    "annotations",
    sql("""SELECT session_id, kind, CASE kind WHEN 'tag' THEN lower(trim(body)) ELSE trim(body) END AS body FROM (
        SELECT event_id, session_id, 'tag' AS kind, CASE k % 4 WHEN 0 THEN 'Botnet ' WHEN 1 THEN 'botnet' WHEN 2 THEN 'bad tag' ELSE 'x' || (k % 7) END AS body FROM ev WHERE action = 'cowrie.login.failed'
        QUALIFY body = 'bad tag' OR row_number() OVER (PARTITION BY session_id, lower(trim(body)) ORDER BY ts, event_id) = 1) WHERE body <> 'bad tag'
      UNION ALL SELECT session_id, 'note', trim(command_line) FROM ev WHERE command_line IS NOT NULL"""),
)
def _annotations(spark, d):
    ev = A.events(spark, d)
    k = F.col("k")
    body = F.when(k % 4 == 0, "Botnet ").when(k % 4 == 1, "botnet").when(k % 4 == 2, "bad tag").otherwise(F.concat(F.lit("x"), (k % 7).cast("string")))
    tags = ev.filter("action = 'cowrie.login.failed'").select(F.col("event_id").alias("annotation_id"), "session_id", F.lit("tag").alias("kind"), body.alias("body"), F.col("ts").alias("created_at"))
    notes = ev.filter("command_line IS NOT NULL").select(F.col("event_id").alias("annotation_id"), "session_id", F.lit("note").alias("kind"), F.col("command_line").alias("body"), F.col("ts").alias("created_at"))
    return search.annotations(tags.unionByName(notes))[0].select("session_id", "kind", "body")


@query("campaign_coverage", sql("SELECT count(DISTINCT session_id) AS sessions_considered, true AS complete, NULL::VARCHAR AS incomplete_reason FROM ev WHERE action = 'cowrie.command.input'"))
def _coverage(spark, d):
    return C.coverage_flag(C.command_events(A.events(spark, d)))


@query(
    "command_set_flags",
    sql("""SELECT count(*) AS attackers, max(n) AS largest, NULL::VARCHAR AS reason FROM (SELECT source_ip, count(DISTINCT command_line) AS n FROM ev WHERE command_line IS NOT NULL GROUP BY 1)"""),
)
def _flags(spark, d):
    return C.command_set_flags(A.events(spark, d), ip_limit=10**9)


@query(
    "new_indicator_values",
    sql("""SELECT count(*) AS new_values FROM (SELECT DISTINCT type, value FROM ind_rows JOIN ev USING (event_id) WHERE ev.ts >= TIMESTAMP '2024-01-20'
        EXCEPT SELECT type, value FROM ind_rows JOIN ev USING (event_id) WHERE ev.ts < TIMESTAMP '2024-01-20')""", O.RUNS, EXTRACTED),
)
def _new_values(spark, d):
    ev = A.events(spark, d)
    rows = indicators.extract(ev).join(ev.select("event_id", "ts"), "event_id")
    cut = F.lit("2024-01-20").cast("timestamp")
    return indicators.new_values(rows.filter(F.col("ts") >= cut), rows.filter(F.col("ts") < cut).select("type", "value").distinct())


PUBLIC_IP = "NOT (value LIKE '10.%' OR value LIKE '198.51.100.%' OR value LIKE '203.0.113.%')"


@query(
    "third_party",
    sql(f"""SELECT type, value, status, CASE WHEN status = 'ok' THEN malicious END AS malicious, CASE WHEN status = 'ok' THEN malicious + 60 END AS engines FROM (
      SELECT i.type, i.value, v.malicious, CASE WHEN i.type NOT IN ('ip', 'url', 'hash') THEN 'not_supported' WHEN i.type = 'ip' AND NOT ({PUBLIC_IP.replace('value', 'i.value')}) THEN 'not_public'
        WHEN v.value IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM ind i
      LEFT JOIN (SELECT DISTINCT 'hash' AS type, sha256 AS value, length(file_name) AS malicious FROM ev WHERE k % 3 = 0 AND sha256 IS NOT NULL) v ON v.type = i.type AND v.value = i.value)""", O.RUNS, EXTRACTED),
)
def _third_party(spark, d):
    ev = A.events(spark, d)
    verdicts = ev.filter("k % 3 = 0 AND sha256 IS NOT NULL").select(
        F.lit("hash").alias("type"), F.col("sha256").alias("value"), F.length("file_name").alias("malicious"),
        F.lit(0).alias("suspicious"), F.lit(10).alias("harmless"), F.lit(50).alias("undetected"),
    ).distinct()
    return indicators.third_party(_ind(ev).select("type", "value"), verdicts)


@query(
    "schedule_state",
    sql("""SELECT e.event_id, r.block AS slot, r.arm, CASE WHEN r.block IS NOT NULL THEN true END AS in_place FROM ev e LEFT JOIN rot r ON r.honeypot_id = e.honeypot_id AND e.ts >= b_start AND e.ts < b_end""", ROT),
)
def _schedule(spark, d):
    points = A.events(spark, d).select("event_id", "honeypot_id", F.col("ts").alias("t"))
    slots = None
    for s in range(4):
        one = periods.schedule_slots(spark, f"hp-{s}", X_START, 2, [A.ARMS[(b + s) % 4] for b in range(12)])
        slots = one if slots is None else slots.unionByName(one)
    return periods.in_place(periods.due(slots, points), A.rotation(spark)).select("event_id", "slot", "arm", "in_place")


@query(
    "sensor_os",
    sql("""SELECT r.honeypot_id, coalesce(upper(left(x.c, 1)) || lower(substr(x.c, 2)), 'unknown') AS os, CASE WHEN x.c IS NULL THEN 'unknown' ELSE 'evaluation' END AS os_source
      FROM (SELECT honeypot_id, arg_max(run_id, (started_at, run_id)) FILTER (status = 'completed') AS run_id FROM ru GROUP BY 1) r
      LEFT JOIN (SELECT run_id, arg_min(c, probe_id) AS c FROM pr WHERE establishes = 'os.identity' AND fact_status = 'observed' AND c IS NOT NULL GROUP BY 1) x USING (run_id)""", RUNS, PR),
)
def _os(spark, d):
    runs = A.runs(spark, d)
    distros = spark.createDataFrame([("web-server", "Debian GNU/Linux 12")], "persona string, pretty_name string")
    return periods.describe_os(runs, A.deployments(spark), distros, runs, V.fact_claims(A.probe_results(spark, d)))


@query(
    "session_reports",
    sql("""SELECT s.session_id, a.analysis_id, a.classification || ' — ' || attacker_ip AS title,
        'Session from ' || attacker_ip || coalesce(' (' || country || ')', '') || coalesce(' as user ' || username, '') || ' on ' || honeypot_name || ' (' || protocol || '), started '
        || strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z, lasting ' || duration_seconds || ' second' || CASE WHEN duration_seconds = 1 THEN '' ELSE 's' END
        || '. Recorded: ' || command_count || ' command' || CASE WHEN command_count = 1 THEN '' ELSE 's' END || ', ' || coalesce(dl.n, 0) || ' download' || CASE WHEN dl.n = 1 THEN '' ELSE 's' END
        || ', ' || l.n || ' indicator' || CASE WHEN l.n = 1 THEN '' ELSE 's' END || '. ' || coalesce('Techniques by rule (' || t.n || '): ' || t.ids, 'Techniques by rule: none') || '.' AS summary
      FROM ss s JOIN (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, analysis_id DESC) = 1) a USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS n FROM ev WHERE action = 'cowrie.session.file_download' GROUP BY 1) dl USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS n, string_agg(technique_id, ', ' ORDER BY technique_id) AS ids FROM (SELECT DISTINCT session_id, technique_id FROM ev JOIN cmd_tech USING (command_line)) GROUP BY 1) t USING (session_id)
      JOIN (SELECT session_id, count(*) AS n FROM ind_links GROUP BY 1) l USING (session_id)""", SESSIONS, O.AN, O.CMD_TECH, O.RUNS, EXTRACTED),
)
def _reports(spark, d):
    ev = A.events(spark, d)
    observed = rules.rule_hits(ev.select("session_id", "command_line"))
    facts = reports.session_facts(S.sessions(ev), S.timeline(ev), observed, _links(ev))
    return reports.session_report(facts, S.latest_analyses(A.analyses(ev))).select("session_id", "analysis_id", "title", "summary")


@query(
    "report_bodies",
    sql(f"""SELECT s.session_id, a.analysis_id, a.classification || ' — ' || attacker_ip AS title, true AS summary_observed, attacker_ip, honeypot_name AS target, {ts('s.started_at', 'started_at')}, {ts('s.ended_at', 'ended_at')},
        protocol, a.risk, a.risk_score, coalesce(t.ids, '') AS observed_techniques, command_count, coalesce(dl.n, 0) AS downloads, l.n AS indicators, coalesce(x.l, '') AS actions, '2024-02-01 00:00:00.000000' AS created_at
      FROM ss s JOIN (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, analysis_id DESC) = 1) a USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS n FROM ev WHERE action = 'cowrie.session.file_download' GROUP BY 1) dl USING (session_id)
      LEFT JOIN (SELECT session_id, string_agg(technique_id, ',' ORDER BY technique_id) AS ids FROM (SELECT DISTINCT session_id, technique_id FROM ev JOIN cmd_tech USING (command_line)) GROUP BY 1) t USING (session_id)
      LEFT JOIN (SELECT analysis_id, string_agg(concat_ws('|', priority, action, rationale), ',' ORDER BY priority, action) AS l FROM act WHERE priority <> 'P9' AND rationale IS NOT NULL GROUP BY 1) x USING (analysis_id)
      JOIN (SELECT session_id, count(*) AS n FROM ind_links GROUP BY 1) l USING (session_id)""", SESSIONS, O.AN, ACTIONS, O.CMD_TECH, O.RUNS, EXTRACTED),
)
def _report_bodies(spark, d):
    """The stored reports, read back whole: every field of the body."""
    ev = A.events(spark, d)
    an = A.analyses(ev)
    facts = reports.session_facts(S.sessions(ev), S.timeline(ev), rules.rule_hits(ev.select("session_id", "command_line")), _links(ev))
    rows = reports.session_report(facts, S.latest_analyses(an), K.recommendation_gate(A.recommendations(an))[0])
    at = f"{shared_folder(spark)}/lureframe-reports-{uuid.uuid4().hex}"
    sinks.write_reports(rows, at, datetime(2024, 2, 1))
    ddl = (
        "title string, session_id string, summary string, summary_observed boolean, overview struct<attacker_ip:string,target:string,started_at:timestamp,ended_at:timestamp,protocol:string,risk:string,risk_score:int>,"
        " observed_techniques array<string>, command_count long, downloads long, indicators long, actions array<struct<priority:string,action:string,rationale:string>>"
    )
    body = spark.read.parquet(at).withColumn("b", F.from_json("body", ddl)).filter("b.summary = summary AND b.title = title")
    actions = F.array_join(F.transform("b.actions", lambda x: F.concat_ws("|", x["priority"], x["action"], x["rationale"])), ",").alias("actions")
    return body.select("b.session_id", "analysis_id", "b.title", "b.summary_observed", "b.overview.*", "b.observed_techniques", "b.command_count", "b.downloads", "b.indicators", actions, "created_at")


@query(
    "change_history",
    sql("""SELECT CAST(event_id AS VARCHAR) AS change_id, sensor AS honeypot_id, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS "at", kind,
        CASE WHEN kind = 'gossip' THEN 'unknown_kind' WHEN moment IS NULL THEN 'no_time' WHEN sensor IS NULL THEN 'no_sensor' END AS reason FROM (
      SELECT event_id, CASE WHEN k % 7 <> 0 THEN honeypot_id END AS sensor, CASE WHEN k % 11 <> 0 THEN ts END AS moment, CASE k % 3 WHEN 0 THEN 'rate-limit' WHEN 1 THEN 'note' ELSE 'gossip' END AS kind FROM ev)"""),
)
def _changes(spark, d):
    """Changes appended to the history and read back, and the refused ones with their reason."""
    k = F.col("k")
    rows = A.events(spark, d).select(
        F.col("event_id").cast("string").alias("change_id"), F.when(k % 7 != 0, F.col("honeypot_id")).alias("honeypot_id"), F.when(k % 11 != 0, F.col("ts")).alias("at"),
        F.when(k % 3 == 0, "rate-limit").when(k % 3 == 1, "note").otherwise("gossip").alias("kind"), F.concat(F.lit("d"), k.cast("string")).alias("detail"), F.lit("me").alias("recorded_by"))
    at = f"{shared_folder(spark)}/lureframe-changes-{uuid.uuid4().hex}"
    refused = history.append_changes(rows, at)
    stored = history.read_history(spark, at, "changes").withColumn("reason", F.lit(None).cast("string"))
    return stored.unionByName(refused).select("change_id", "honeypot_id", "at", "kind", "reason")


@query("dead_letter_table", sql(f"SELECT reason, count(*) AS n FROM (SELECT {BAD} AS reason FROM ev) WHERE reason IS NOT NULL GROUP BY 1"))
def _dead_table(spark, d):
    at = f"{shared_folder(spark)}/lureframe-dead-{uuid.uuid4().hex}"
    sinks.write_dead_letters(ingest.normalize(_raw(spark, d))[1], at)
    return sinks.dead_letter_counts(spark.read.parquet(at))


@query("indicator_page_links", sql("SELECT l.type, l.value, l.session_id FROM ind_links l JOIN (SELECT type, value FROM ind WHERE type = 'ip' ORDER BY last_seen DESC, type, value LIMIT 50) p ON p.type = l.type AND p.value = l.value", O.RUNS, EXTRACTED))
def _page_links(spark, d):
    ev = A.events(spark, d)
    return search.page_links(search.list_indicators(_ind(ev), type_="ip", limit=50), _links(ev)).select("type", "value", "session_id")


@query("confounders", sql("SELECT event_id AS change_id, honeypot_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM ev WHERE action = 'cowrie.session.connect' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-27'"))
def _confounders(spark, d):
    ev = A.events(spark, d)
    changes = ev.filter("action = 'cowrie.session.connect'").select(F.col("event_id").alias("change_id"), "honeypot_id", F.col("ts").alias("at"))
    spans = ev.select("honeypot_id").distinct().withColumn("start", F.lit("2024-01-03").cast("timestamp")).withColumn("end", F.lit("2024-01-27").cast("timestamp"))
    return X.confounders(changes, spans)


@query(
    "csv_export",
    sql("""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z,' || honeypot_id || ',' || session_id || ',' || source_ip || ',' || action || ',' || category || ',' || protocol
      || ',' || coalesce(username, '') || ',' || CASE WHEN command_line LIKE '%"%' OR command_line LIKE '%,%' THEN '"' || replace(command_line, '"', '""') || '"' ELSE coalesce(command_line, '') END
      || ',' || coalesce(risk_level, '') || ',' || coalesce(risk_score::VARCHAR, '') || ',' || coalesce(mitre_technique_id, '') AS line FROM ev"""),
)
def _csv(spark, d):
    return sinks.csv_lines(A.events(spark, d))


@query(
    "report_items",
    sql(f"""SELECT session_id, analysis_id, item, name, value, event_id, {ts('i.ts', 'ts')} FROM (
        SELECT session_id, 'technique' AS item, technique_id AS name, command_line AS value, event_id, ts FROM ev JOIN cmd_tech USING (command_line)
        UNION ALL SELECT session_id, 'indicator', type, value, NULL, NULL FROM ind_links) i
      JOIN (SELECT session_id, arg_max(analysis_id, (created_at, analysis_id)) AS analysis_id FROM an GROUP BY 1) l USING (session_id)""",
        O.AN, O.CMD_TECH, O.RUNS, EXTRACTED),
)
def _report_items(spark, d):
    ev = A.events(spark, d)
    hits = rules.rule_hits(ev.select("session_id", "event_id", "ts", "command_line"))
    return reports.report_items(rules.mapping_evidence(hits), _links(ev), S.latest_analyses(A.analyses(ev)))


@query(
    "retention_all",
    sql(f"""SELECT CAST(d AS VARCHAR) AS partition, {ts('newest')}, referenced, CASE WHEN d = max(d) OVER () THEN 'write_target' WHEN newest >= TIMESTAMP '2024-01-21' THEN 'newer_than_cutoff'
        WHEN referenced > 0 THEN 'referenced' END AS keep_reason FROM (
      SELECT CAST(ts AS DATE) AS d, max(ts) AS newest, count(*) FILTER (session_id IN (SELECT session_id FROM an UNION SELECT session_id FROM ind_links UNION SELECT session_id FROM kept
          UNION SELECT session_id FROM ev WHERE action = 'cowrie.login.failed' AND k % 4 <> 2 UNION SELECT session_id FROM ev WHERE command_line IS NOT NULL)
        OR event_id IN (SELECT event_id FROM kept UNION SELECT event_id FROM (
          SELECT session_id, arg_min(event_id, (CASE command_line WHEN 'cd /tmp' THEN 0 ELSE 1 END, ts, event_id)) AS event_id, technique_id,
            ['dropper', 'ssh_persistence', 'miner'][any_value(user_id) % 3 + 1] AS chain_id FROM ev JOIN cmd_tech USING (command_line) GROUP BY 1, 3) JOIN expd USING (chain_id, technique_id))) AS referenced
      FROM ev GROUP BY 1)""", O.AN, CL, O.RUNS, EXTRACTED, O.CMD_TECH, O.values(A.EXPECTED, "expd", "chain_id, step_index, technique_id")),
)
def _retention_all(spark, d):
    """Every source of references: analyses, reports, annotations, indicator links and claims by session; the events of
    claims and of chain steps. Evidence packages cite runs and steps by id and no events of their own."""
    ev = A.events(spark, d)
    an = A.analyses(ev)
    kept, _ = K.barrier(*A.claims(ev, an), ev)
    sessions = [an, _reports(spark, d), _annotations(spark, d), _links(ev), kept]
    plan = V.retention_plan(ev, [s.select("session_id") for s in sessions], [kept.select("event_id"), _chains(spark, d).select("event_id")], CUTOFF)
    return plan.withColumn("partition", F.col("partition").cast("string"))
