"""Registered queries: claims and their gates, decoy evaluation, rotation experiment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.operators import campaigns as C
from lureframe.operators import claims as K
from lureframe.operators import evaluation as V
from lureframe.operators import experiment as X
from lureframe.operators import rules, search
from lureframe.operators import sessions as S
from lureframe.plans import adapter as A
from lureframe.plans import oracle as O
from lureframe.plans.oracle import array, q, sql, ts
from lureframe.plans.registry import query
from lureframe.session import write_once
from lureframe.sources import reference
from lureframe.sources.reference import CHARACTERISTICS, PROBES

# --- claims ---
CL = f"""
cl AS (SELECT event_id AS claim_id, session_id, {array(['classification', 'technique_mapping', 'observed_behavior', 'indicator'])}[k % 4 + 1] AS kind,
  CASE WHEN k % 4 = 1 THEN 'T1082' END AS technique_id, 'claim ' || k AS text, k FROM ev WHERE (user_id + session_no) % 3 <> 0),
ct AS (SELECT claim_id, CASE WHEN k % 5 = 0 THEN claim_id + 1 ELSE claim_id END AS event_id FROM cl
  UNION ALL SELECT claim_id, claim_id + 7 FROM cl WHERE k % 5 = 1),
kept AS (SELECT ct.claim_id, cl.session_id, ct.event_id, 'event ' || ct.event_id AS artifact, e.ts FROM ct JOIN cl USING (claim_id)
  JOIN ev e ON e.event_id = ct.event_id AND e.session_id = cl.session_id)"""


def _barrier(spark, d):
    ev = A.events(spark, d)
    cl, ct = A.claims(ev, A.analyses(ev))
    return K.barrier(cl, ct, ev)


@query("claims_kept", sql(f"SELECT claim_id, session_id, event_id, {ts('ts')}, artifact FROM kept", CL))
def _kept(spark, d):
    return _barrier(spark, d)[0]


@query(
    "claims_rejected",
    sql("""SELECT claim_id, session_id, kind, technique_id, 'evidence_barrier' AS stage, 'citations_unresolved' AS reason, text, l.cited AS cited_event_ids
      FROM cl JOIN (SELECT claim_id, string_agg(event_id, ',' ORDER BY event_id) AS cited FROM (SELECT claim_id, CAST(event_id AS VARCHAR) AS event_id FROM ct) GROUP BY 1) l USING (claim_id)
      WHERE claim_id NOT IN (SELECT claim_id FROM kept)""", CL),
)
def _rejected(spark, d):
    return _barrier(spark, d)[1]


ACTIONS = f"""
act AS (SELECT analysis_id, {array(['P1', 'P2', 'P3', 'P9'])}[(risk_score + i) % 4 + 1] AS priority, 'watch ' || session_id || ' ' || i AS action,
  CASE WHEN (risk_score + i) % 5 <> 0 THEN 'risk ' || risk_score END AS rationale FROM an, range(2) r(i))"""


@query("recommendations", sql("SELECT analysis_id, priority, action, rationale, coalesce(priority <> 'P9' AND rationale IS NOT NULL, false) AS accepted FROM act", O.AN, ACTIONS))
def _recommendations(spark, d):
    good, bad = K.recommendation_gate(A.recommendations(A.analyses(A.events(spark, d))))
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@query(
    "analysis_claims",
    sql("""SELECT pg.analysis_id, pg.session_id, coalesce(c.l, '') AS claims, coalesce(r.l, '') AS rejections, coalesce(a.l, '') AS actions FROM pg
      LEFT JOIN (SELECT session_id || '-a1' AS analysis_id, string_agg(concat_ws('|', claim_id, kind, coalesce(technique_id, ''), text, e), ',' ORDER BY claim_id) AS l
        FROM cl JOIN (SELECT claim_id, string_agg(artifact, ';' ORDER BY ts, event_id) AS e FROM kept GROUP BY 1) USING (claim_id) GROUP BY 1) c USING (analysis_id)
      LEFT JOIN (SELECT session_id || '-a1' AS analysis_id, string_agg(concat_ws('|', 'evidence_barrier', claim_id, kind, 'citations_unresolved', coalesce(technique_id, ''), text, e), ',' ORDER BY claim_id) AS l
        FROM cl JOIN (SELECT claim_id, string_agg(event_id, ';' ORDER BY event_id) AS e FROM ct GROUP BY 1) USING (claim_id) WHERE claim_id NOT IN (SELECT claim_id FROM kept) GROUP BY 1) r USING (analysis_id)
      LEFT JOIN (SELECT analysis_id, string_agg(concat_ws('|', priority, action, rationale), ',' ORDER BY priority, action) AS l FROM act WHERE priority <> 'P9' AND rationale IS NOT NULL GROUP BY 1) a USING (analysis_id)""",
        O.AN, CL, ACTIONS, """
pg AS (SELECT an.analysis_id, an.session_id FROM an JOIN (SELECT session_id, honeypot_id FROM (SELECT session_id, honeypot_id, count(*) n FROM ev GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, honeypot_id) = 1) USING (session_id) WHERE honeypot_id <> 'hp-2' ORDER BY an.created_at DESC, analysis_id LIMIT 100 OFFSET 10)"""),
)
def _analysis_claims(spark, d):
    """A page of analyses, as the history page reads them, each with all that hangs on it."""
    ev = A.events(spark, d)
    an = A.analyses(ev)
    cl, ct = A.claims(ev, an)
    kept, rejected = K.barrier(cl, ct, ev)
    own = F.concat("session_id", F.lit("-a1")).alias("analysis_id")
    page = search.load_history(an, ev, deny=["hp-2"], limit=100, offset=10).select("analysis_id", "session_id")
    good, _ = K.recommendation_gate(A.recommendations(an))
    rows = search.hydrate(page, cl.select("*", own), kept, rejected.select("*", own), good)
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = lambda parts: F.concat_ws("|", *[text_of(p) for p in parts])
    listed = lambda name, parts: F.array_join(F.transform(name, lambda x: line(parts(x))), ",").alias(name)
    return rows.select(
        "analysis_id", "session_id",
        listed("claims", lambda x: [x["claim_id"], x["kind"], x["technique_id"], x["text"], F.array_join(F.transform(x["evidence"], lambda e: e["artifact"]), ";")]),
        listed("rejections", lambda x: [x["stage"], x["claim_id"], x["kind"], x["reason"], x["technique_id"], x["text"], F.array_join(x["cited_event_ids"].cast("array<string>"), ";")]),
        listed("actions", lambda x: [x["priority"], x["action"], x["rationale"]]),
    )


@query(
    "rejection_counts",
    sql("""SELECT 'evidence_barrier' AS stage, kind, 'citations_unresolved' AS reason, count(*) AS n FROM cl
      WHERE claim_id NOT IN (SELECT claim_id FROM kept) GROUP BY kind""", CL),
)
def _rejection_counts(spark, d):
    return K.rejection_counts(_barrier(spark, d)[1])


PROP = f"""
prop AS (SELECT event_id AS proposal_id, session_id, k % 2 AS chunk_no, {array(A.PROPOSED)}[k % 5 + 1] AS technique_id, (k % 101) / 100.0::DOUBLE AS confidence,
  'because ' || (k % 3) AS explanation, CASE WHEN k % 7 <> 0 THEN event_id ELSE event_id + 1 END AS cited FROM ev WHERE command_line IS NOT NULL),
judged AS (SELECT p.*, CASE WHEN technique_id = 'T9999' THEN 'unknown_technique'
    WHEN NOT EXISTS (SELECT 1 FROM ev e WHERE e.event_id = p.cited AND e.session_id = p.session_id AND e.k % 2 = p.chunk_no AND e.command_line IS NOT NULL)
    THEN 'citations_not_offered' END AS reason,
  EXISTS (SELECT 1 FROM ev e JOIN cmd_tech USING (command_line) WHERE e.session_id = p.session_id AND cmd_tech.technique_id = p.technique_id) AS ruled FROM prop p),
acc AS (SELECT * FROM judged WHERE reason IS NULL AND NOT ruled)"""


def _gate(spark, d):
    ev = A.events(spark, d)
    pr, cites, offered = A.proposals(ev)
    ruled = rules.rule_hits(ev.select("session_id", "command_line")).select("session_id", "technique_id")
    return K.technique_gate(pr, cites, offered, reference.catalog(spark), ruled), cites, offered


@query("proposals_accepted", sql("SELECT proposal_id, session_id, chunk_no, technique_id, confidence, explanation, 1 AS weight, cited AS earliest FROM acc", O.CMD_TECH, PROP))
def _accepted(spark, d):
    return _gate(spark, d)[0][0]


@query("proposals_rejected", sql("SELECT proposal_id, session_id, chunk_no, technique_id, confidence, explanation, reason FROM judged WHERE reason IS NOT NULL", O.CMD_TECH, PROP))
def _prop_rejected(spark, d):
    return _gate(spark, d)[0][1]


@query(
    "merged_proposals",
    sql("""SELECT m.session_id, m.technique_id, round_even(m.c, 3) AS confidence, m.n AS proposals, x.explanation, 'llm' AS source, false AS observed FROM (
        SELECT session_id, technique_id, sum(confidence) / count(*) AS c, count(*) AS n FROM acc GROUP BY 1, 2) m
      JOIN (SELECT session_id, technique_id, string_agg(explanation, ' ' ORDER BY e, explanation) AS explanation FROM (
        SELECT session_id, technique_id, explanation, min(cited) AS e FROM acc GROUP BY 1, 2, 3) GROUP BY 1, 2) x
      ON x.session_id = m.session_id AND x.technique_id = m.technique_id""", O.CMD_TECH, PROP),
)
def _merged(spark, d):
    return K.merge_proposals(_gate(spark, d)[0][0])


@query("merged_evidence", sql("SELECT DISTINCT session_id, technique_id, cited AS event_id FROM acc", O.CMD_TECH, PROP))
def _merged_evidence(spark, d):
    (accepted, _, _), cites, offered = _gate(spark, d)
    return K.merged_evidence(accepted, cites, offered)


BODY = f"""
vb AS (SELECT session_id, k // 50 AS chunk_no, min(event_id) AS e, min(k) AS k FROM ev GROUP BY ALL),
vbx AS (SELECT *, k % 9 <> 0 AND k % 120 <= 100 AND k % 11 <> 0 AS ok FROM vb),
cls AS (SELECT v.session_id, chunk_no, CASE WHEN ok THEN {array(A.LABELS)}[k % 9 + 1] ELSE 'Unclassified' END AS classification,
  CASE WHEN ok THEN (k % 120) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN ok THEN k ELSE 0 END AS risk_score,
  CASE WHEN ok THEN {O.band('k')} ELSE 'informational' END AS risk,
  CASE WHEN ok THEN 'summary ' || (k % 4) ELSE 'No valid verdict; the session has ' || coalesce(c.n, 0) || ' commands on record.' END AS behavior_summary,
  CASE WHEN ok THEN e::VARCHAR ELSE coalesce(c.event_id, f.event_id)::VARCHAR END AS cited, NOT ok AS degraded
  FROM vbx v LEFT JOIN (SELECT session_id, count(*) AS n, arg_min(event_id, (ts, event_id)) AS event_id FROM comp GROUP BY 1) c USING (session_id)
  LEFT JOIN (SELECT session_id, arg_min(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY 1) f USING (session_id))"""


def _classified(spark, d):
    ev = A.events(spark, d)
    return K.classification_gate(A.verdict_bodies(ev), S.compact_summary(ev), S.compact(ev))


@query("classification_gate", sql("SELECT session_id, chunk_no, classification, confidence, risk_score, risk, behavior_summary, cited, degraded FROM cls", O.RUNS, BODY))
def _cls_gate(spark, d):
    return _classified(spark, d).withColumn("cited", F.col("evidence")[0]["event_id"]).drop("evidence")


@query(
    "merged_classifications",
    sql("""SELECT w.session_id, w.classification, w.confidence, w.risk_score, w.risk, s.behavior_summary, w.chunks FROM (
        SELECT session_id, arg_max(classification, (risk_score, -chunk_no)) AS classification, round(avg(confidence), 6) AS confidence,
          max(risk_score) AS risk_score, arg_max(risk, (risk_score, -chunk_no)) AS risk, count(*) AS chunks FROM cls GROUP BY 1) w
      JOIN (SELECT session_id, string_agg(behavior_summary, ' ' ORDER BY o, behavior_summary) AS behavior_summary FROM (
        SELECT session_id, behavior_summary, min(chunk_no) AS o FROM cls GROUP BY 1, 2) GROUP BY 1) s USING (session_id)""", O.RUNS, BODY),
)
def _merged_cls(spark, d):
    return K.merge_classifications(_classified(spark, d))


@query(
    "enriched_events",
    sql("""SELECT e.event_id, CASE WHEN a.risk IS NULL THEN e.risk_score ELSE a.risk_score END AS risk_score, coalesce(a.risk, e.risk_level) AS risk_level,
        coalesce(a.classification, e.ai_classification) AS ai_classification,
        CASE WHEN a.risk IS NULL THEN e.mitre_technique_id ELSE t.technique_id END AS mitre_technique_id
      FROM ev e LEFT JOIN (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, analysis_id DESC) = 1) a USING (session_id)
      LEFT JOIN (SELECT command_line, min(technique_id) AS technique_id FROM cmd_tech GROUP BY 1) t ON t.command_line = e.command_line""", O.AN, O.CMD_TECH),
)
def _enriched(spark, d):
    ev = A.events(spark, d)
    verdicts = S.latest_analyses(A.analyses(ev))
    hits = rules.rule_hits(ev.select("session_id", "event_id", "command_line"))
    tactics = reference.catalog(spark).select("technique_id", "tactic")
    evidence = hits.join(tactics, "technique_id").withColumn("position", F.col("technique_id"))
    return K.enrich(ev, verdicts, evidence).select("event_id", "risk_score", "risk_level", "ai_classification", "mitre_technique_id")


@query(
    "mapping_quality",
    sql("""SELECT origin, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM (
      SELECT origin, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e) AS fp, count(*) FILTER (NOT p) AS fn FROM (
        SELECT origin, case_id, technique_id, bool_or(e) AS e, bool_or(p) AS p FROM (
          SELECT honeypot_id AS origin, session_id AS case_id, mitre_technique_id AS technique_id, true AS e, false AS p FROM ev WHERE mitre_technique_id IS NOT NULL
          UNION ALL SELECT honeypot_id, session_id, technique_id, false, true FROM ev JOIN cmd_tech USING (command_line)) GROUP BY ALL) GROUP BY 1)""", O.CMD_TECH),
)
def _quality(spark, d):
    ev = A.events(spark, d)
    expected = ev.filter("mitre_technique_id IS NOT NULL").select(
        F.col("session_id").alias("case_id"), F.col("honeypot_id").alias("origin"), F.col("mitre_technique_id").alias("technique_id")
    )
    got = rules.rule_hits(ev.select("session_id", "honeypot_id", "command_line")).select(
        F.col("session_id").alias("case_id"), F.col("honeypot_id").alias("origin"), "technique_id"
    )
    return rules.mapping_quality(expected, got)


@query(
    "mapping_spread",
    sql("""SELECT origin, count(*) AS runs, round(avg(p), 6) AS precision_mean, round(min(p), 6) AS precision_min, round(max(p), 6) AS precision_max,
        round(avg(r), 6) AS recall_mean, round(min(r), 6) AS recall_min, round(max(r), 6) AS recall_max FROM (
      SELECT origin, run, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM (
        SELECT run, origin, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e) AS fp, count(*) FILTER (NOT p) AS fn FROM (
          SELECT run, origin, case_id, technique_id, bool_or(e) AS e, bool_or(p) AS p FROM (
            SELECT run, honeypot_id AS origin, session_id AS case_id, mitre_technique_id AS technique_id, true AS e, false AS p FROM ev, range(3) t(run) WHERE mitre_technique_id IS NOT NULL
            UNION ALL SELECT run, honeypot_id, session_id, technique_id, false, true FROM ev JOIN cmd_tech USING (command_line), range(3) t(run) WHERE k % 5 <> run) GROUP BY ALL) GROUP BY 1, 2)) GROUP BY 1""", O.CMD_TECH),
)
def _spread(spark, d):
    ev = A.events(spark, d)
    expected = ev.filter("mitre_technique_id IS NOT NULL").select(
        F.col("session_id").alias("case_id"), F.col("honeypot_id").alias("origin"), F.col("mitre_technique_id").alias("technique_id")
    )
    hits = rules.rule_hits(ev.select("session_id", "honeypot_id", "command_line", "k"))
    got = hits.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("k % 5 <> run")
    return rules.mapping_spread(expected, got.select("run", F.col("session_id").alias("case_id"), F.col("honeypot_id").alias("origin"), "technique_id"))


# --- evaluation ---
_PID = array([p[0] for p in PROBES] + list(A.SERVICES))
_FACT = array([p[3] for p in PROBES] + list(A.SERVICES))
_CHAR = array([p[1] for p in PROBES] + ["services"] * 3)
RUNS = """
ru AS (SELECT o_orderkey AS run_id, 'eval-' || o_custkey AS honeypot_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status,
  o_orderdate + to_microseconds(o_orderkey) AS started_at, 'h' || (o_orderkey % 3) AS honeypot_fingerprint,
  CASE WHEN o_orderkey % 5 = 0 THEN 'c1' ELSE 'c0' END AS evaluation_config_fingerprint, o_orderpriority AS arm FROM orders)"""
PR = f"""
pr AS (SELECT *, CASE WHEN fact_status = 'observed' THEN v END AS value FROM (SELECT run_id || '-' || position AS result_id, run_id, position,
    CASE WHEN position < 12 THEN 'agent' ELSE 'nmap' END AS module, {_PID}[position + 1] AS probe_id, {_FACT}[position + 1] AS establishes, {_CHAR}[position + 1] AS characteristic,
    CASE WHEN flag = 'R' THEN 'not_observed' WHEN flag = 'A' THEN 'observed' WHEN s % 3 = 0 THEN 'unknown' ELSE 'observed' END AS fact_status,
    CASE WHEN position <= 1 THEN {array(A.OS_TEXT)}[s % 4 + 1] WHEN position <= 4 THEN ['svr04', 'nas3', '127.0.1.1' || chr(9) || 'svr04'][s % 3 + 1] WHEN position = 5 THEN 'root'
      WHEN position = 6 THEN 'root:x:0:0' WHEN position = 7 THEN 'ok' WHEN position = 8 THEN 'GenuineIntel' WHEN position <= 11 THEN {array(A.ARCH_TEXT)}[s % 4 + 1] ELSE 'OpenSSH 8.4' END AS v,
    CASE WHEN position <= 1 THEN ['debian', 'ubuntu', 'red hat', NULL][s % 4 + 1] WHEN position <= 4 THEN ['svr04', 'nas3', 'svr04'][s % 3 + 1]
      WHEN position BETWEEN 9 AND 11 THEN ['x86_64', 'x86_64', 'aarch64', 'aarch64'][s % 4 + 1] WHEN position = 5 THEN 'root' WHEN position = 6 THEN 'root:x:0:0'
      WHEN position = 7 THEN 'ok' WHEN position = 8 THEN 'GenuineIntel' ELSE 'OpenSSH 8.4' END AS c
  FROM (SELECT l_orderkey AS run_id, (l_partkey + l_linenumber) % 15 AS position, min(l_suppkey) AS s, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2))),
st AS (SELECT run_id || '-c-' || c AS step_id, run_id, {array([e[0] for e in A.EXPECTED])}[c + 1] AS chain_id, {array([e[1] for e in A.EXPECTED])}[c + 1] AS step_index,
    {array([e[2] for e in A.EXPECTED])}[c + 1] AS technique_id, CASE WHEN pk % 10 = 0 THEN 'unknown' WHEN ls = 'F' THEN 'observed' ELSE 'not_observed' END AS fact_status, pk
  FROM (SELECT l_orderkey AS run_id, (l_suppkey + l_linenumber) % 7 AS c, min(l_linestatus) AS ls, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2)),
fa AS (SELECT run_id, characteristic, fact_status FROM pr UNION ALL SELECT run_id, 'attack_possibilities', fact_status FROM st),
sc AS (SELECT run_id, characteristic, round_even(count(*) FILTER (fact_status = 'observed') / nullif(count(*) FILTER (fact_status <> 'unknown'), 0)::DOUBLE, 3) AS score FROM fa GROUP BY 1, 2)"""
CON = """
con AS (SELECT a.run_id, a.establishes AS fact, a.probe_id AS probe_a, b.probe_id AS probe_b, a.value AS value_a, b.value AS value_b, a.result_id AS id_a, b.result_id AS id_b
  FROM pr a JOIN pr b ON a.run_id = b.run_id AND a.establishes = b.establishes AND a.position < b.position AND a.c <> b.c
  WHERE a.fact_status = 'observed' AND b.fact_status = 'observed')"""
KEYS = """
fk AS (SELECT run_id, CASE WHEN module = 'nmap' THEN 'service:' || establishes ELSE 'probe:' || probe_id || ':' || establishes END AS key, fact_status FROM pr
  UNION ALL SELECT run_id, 'chain:' || chain_id || ':' || technique_id, fact_status FROM st),
fnd AS (SELECT run_id, key FROM fk WHERE fact_status = 'not_observed'
  UNION SELECT run_id, 'sanity:' || fact || ':' || least(probe_a, probe_b) || '+' || greatest(probe_a, probe_b) FROM con),
stt AS (SELECT coalesce(f.run_id, k.run_id) AS run_id, coalesce(f.key, k.key) AS key,
  CASE WHEN f.key IS NOT NULL THEN 'present' WHEN k.fact_status = 'observed' THEN 'absent' ELSE 'undetermined' END AS state
  FROM fnd f FULL JOIN fk k ON f.run_id = k.run_id AND f.key = k.key),
seq AS (SELECT *, row_number() OVER (PARTITION BY honeypot_id ORDER BY started_at, run_id) - 1 AS n FROM ru),
pairs AS (SELECT h.honeypot_id, h.n, h.run_id AS head, b.run_id AS base, h.honeypot_fingerprint <> b.honeypot_fingerprint AS dh,
  h.evaluation_config_fingerprint <> b.evaluation_config_fingerprint AS dc FROM seq h JOIN seq b ON b.honeypot_id = h.honeypot_id AND b.n = h.n - 1)"""


def _eval(spark, d):
    return A.probe_results(spark, d), A.chain_results(spark, d)


def _findings(spark, d):
    pr, st = _eval(spark, d)
    con = V.contradictions(V.fact_claims(pr))
    return V.fact_findings(pr, st).unionByName(V.sanity_findings(con, pr))


@query("scores", sql("SELECT run_id, characteristic, score FROM sc", PR))
def _scores(spark, d):
    return V.scores(*_eval(spark, d))


@query("fact_claims", sql("SELECT result_id, CASE WHEN value IS NOT NULL THEN c END AS claim FROM pr", PR))
def _claims(spark, d):
    return V.fact_claims(A.probe_results(spark, d)).select("result_id", "claim")


@query("contradictions", sql("SELECT run_id, fact, probe_a, probe_b, value_a, value_b FROM con", PR, CON))
def _contradictions(spark, d):
    return V.contradictions(V.fact_claims(A.probe_results(spark, d)))


@query(
    "findings",
    sql("""SELECT run_id, CASE WHEN module = 'nmap' THEN 'service:' || establishes ELSE 'probe:' || probe_id || ':' || establishes END AS finding_key, characteristic,
        'medium' AS severity, CASE WHEN module = 'nmap' THEN 'expected service ' || establishes || ' was not found' ELSE probe_id || ' did not establish ' || establishes END AS finding,
        'probe:' || result_id AS evidence_ids FROM pr WHERE fact_status = 'not_observed'
      UNION ALL SELECT run_id, 'chain:' || chain_id || ':' || technique_id, 'attack_possibilities', 'high',
        'chain ' || chain_id || ': expected technique ' || technique_id || ' was not observed', 'chain:' || step_id FROM st WHERE fact_status = 'not_observed'
      UNION ALL SELECT run_id, 'sanity:' || fact || ':' || least(probe_a, probe_b) || '+' || greatest(probe_a, probe_b), 'sanity', 'high',
        probe_a || ' and ' || probe_b || ' disagree about ' || fact || ': ''' || replace(value_a, chr(9), '\\t') || ''' vs ''' || replace(value_b, chr(9), '\\t') || '''',
        'probe:' || id_a || ',probe:' || id_b FROM con""", PR, CON),
)
def _findings_q(spark, d):
    return _findings(spark, d)


@query(
    "lifecycle",
    sql("""SELECT head AS head_run_id, base AS base_run_id, key, status, CASE status WHEN 'regressed' THEN 0 WHEN 'new' THEN 1 WHEN 'persisting' THEN 2 WHEN 'undetermined' THEN 3 ELSE 4 END AS severity_rank,
        CASE WHEN a = 'present' THEN head ELSE base END AS from_run, NOT dc AS attributable FROM (
      SELECT x.*, CASE WHEN a = 'present' AND b = 'present' THEN 'persisting' WHEN a = 'present' THEN CASE WHEN EXISTS (
          SELECT 1 FROM seq e JOIN stt s2 ON s2.run_id = e.run_id WHERE e.honeypot_id = x.honeypot_id AND s2.key = x.key AND s2.state = 'present'
            AND e.status = 'completed' AND e.n <= x.n - 2 AND e.n >= x.n - 21) THEN 'regressed' ELSE 'new' END
        WHEN a = 'absent' THEN 'fixed' ELSE 'undetermined' END AS status FROM (
        SELECT p.*, k.key, coalesce(sh.state, 'undetermined') AS a, coalesce(sb.state, 'undetermined') AS b
        FROM pairs p JOIN (SELECT p2.head AS h2, s.key FROM pairs p2 JOIN stt s ON s.run_id = p2.head UNION SELECT p2.head, s.key FROM pairs p2 JOIN stt s ON s.run_id = p2.base) k ON k.h2 = p.head
        LEFT JOIN stt sh ON sh.run_id = p.head AND sh.key = k.key LEFT JOIN stt sb ON sb.run_id = p.base AND sb.key = k.key) x WHERE a = 'present' OR b = 'present')""",
        PR, CON, RUNS, KEYS),
)
def _lifecycle(spark, d):
    pr, st = _eval(spark, d)
    return V.lifecycle(A.runs(spark, d), _findings(spark, d), V.fact_status_by_key(pr, st))


@query(
    "run_delta",
    sql("""SELECT p.head AS head_run_id, p.base AS base_run_id, k.characteristic, sb.score AS base, sh.score AS head, round_even(sh.score - sb.score, 3) AS delta,
        concat_ws(',', CASE WHEN dh THEN 'honeypot_fingerprint' END, CASE WHEN dc THEN 'evaluation_config_fingerprint' END) AS differences,
        CASE WHEN dh OR dc THEN 'configuration_changed' ELSE 'same_configuration' END AS classification
      FROM pairs p JOIN (SELECT p2.head AS h2, s.characteristic FROM pairs p2 JOIN sc s ON s.run_id = p2.head UNION SELECT p2.head, s.characteristic FROM pairs p2 JOIN sc s ON s.run_id = p2.base) k ON k.h2 = p.head
      LEFT JOIN sc sh ON sh.run_id = p.head AND sh.characteristic = k.characteristic LEFT JOIN sc sb ON sb.run_id = p.base AND sb.characteristic = k.characteristic""", PR, CON, RUNS, KEYS),
)
def _delta(spark, d):
    return V.deltas(A.runs(spark, d), V.scores(*_eval(spark, d)))


RATE = f"""
rate AS (SELECT run_id, {array(CHARACTERISTICS)}[c + 1] AS characteristic, CASE WHEN pk % 7 <> 0 AND pk % 3 <> 0 THEN (pk % 101) / 100.0::DOUBLE END AS evaluator_rating,
  CASE WHEN pk % 7 = 0 THEN 'evaluator_failed' WHEN pk % 3 = 0 THEN 'unavailable' ELSE 'completed' END AS evaluator_status, CASE WHEN pk % 5 = 0 THEN 'seen ' || pk END AS verdict
  FROM (SELECT l_orderkey AS run_id, l_suppkey % 6 AS c, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2))"""


@query(
    "severity_bands",
    sql("""SELECT run_id, characteristic, CASE WHEN evaluator_rating < 0.34 THEN 'high' WHEN evaluator_rating < 0.67 THEN 'medium' WHEN evaluator_rating IS NOT NULL THEN 'low' END AS severity FROM rate""", RATE),
)
def _bands(spark, d):
    return A.ratings(spark, d).select("run_id", "characteristic", V.severity_band(F.col("evaluator_rating")).alias("severity"))


@query(
    "reassessments",
    sql("""SELECT p.head AS head_run_id, p.base AS base_run_id, k.characteristic, b.evaluator_rating AS base_rating, h.evaluator_rating AS head_rating,
        coalesce(b.evaluator_status, 'not_scored') AS base_status, coalesce(h.evaluator_status, 'not_scored') AS head_status, b.verdict AS base_verdict, h.verdict AS head_verdict
      FROM pairs p JOIN (SELECT p2.head AS h2, s.characteristic FROM pairs p2 JOIN rate s ON s.run_id = p2.head UNION SELECT p2.head, s.characteristic FROM pairs p2 JOIN rate s ON s.run_id = p2.base) k ON k.h2 = p.head
      LEFT JOIN rate h ON h.run_id = p.head AND h.characteristic = k.characteristic LEFT JOIN rate b ON b.run_id = p.base AND b.characteristic = k.characteristic
      WHERE h.evaluator_rating IS NOT NULL OR b.evaluator_rating IS NOT NULL OR h.verdict IS NOT NULL OR b.verdict IS NOT NULL""", PR, CON, RUNS, KEYS, RATE),
)
def _reassess(spark, d):
    return V.reassessments(V.consecutive(A.runs(spark, d)), A.ratings(spark, d), A.verdicts(spark, d))


@query(
    "run_status",
    sql("""SELECT f.run_id, CASE WHEN bool_or(fact_status <> 'unknown') THEN 'completed' ELSE 'failed' END AS status, any_value(e.es) AS evaluator_status FROM fa f
      LEFT JOIN (SELECT run_id, CASE WHEN bool_or(evaluator_status = 'evaluator_failed') THEN 'evaluator_failed' WHEN bool_or(evaluator_status = 'completed') THEN 'completed' ELSE 'unavailable' END AS es
        FROM rate GROUP BY 1) e ON e.run_id = f.run_id GROUP BY 1""", PR, RATE),
)
def _status(spark, d):
    return V.run_status(*_eval(spark, d)).join(V.evaluator_status(A.ratings(spark, d)), "run_id", "left")


@query(
    "stability",
    sql(f"""SELECT n.arm, n.characteristic, round(s.mean, 6) AS mean, s.lo AS min, s.hi AS max, coalesce(s.e, 0) AS established, n.n, n.shared_config FROM (
        SELECT arm, count(*) AS n, count(DISTINCT evaluation_config_fingerprint) <= 1 AS shared_config, unnest({array(CHARACTERISTICS)}) AS characteristic FROM ru GROUP BY arm) n
      LEFT JOIN (SELECT arm, characteristic, avg(score) AS mean, min(score) AS lo, max(score) AS hi, count(*) AS e FROM ru JOIN sc USING (run_id) WHERE score IS NOT NULL GROUP BY 1, 2) s
        ON s.arm = n.arm AND s.characteristic = n.characteristic""", PR, RUNS),
)
def _stability(spark, d):
    return V.stability(A.runs(spark, d), V.scores(*_eval(spark, d)))


@query(
    "contradictions_per_run",
    sql("""SELECT ru.run_id, arm, count(k) AS contradictions FROM ru LEFT JOIN (SELECT run_id, key AS k FROM fnd WHERE key LIKE 'sanity:%') f ON f.run_id = ru.run_id GROUP BY 1, 2""", PR, CON, RUNS, KEYS),
)
def _per_run(spark, d):
    return V.contradictions_per_run(A.runs(spark, d), _findings(spark, d))


@query(
    "chain_results",
    sql(f"""SELECT r.session_id AS run_id, r.chain_id, x.step_index, x.technique_id, coalesce(h.command_line, '') AS command, h.event_id,
        CASE WHEN h.event_id IS NOT NULL THEN x.technique_id END AS matched_rule_id, CASE WHEN h.event_id IS NULL THEN 'not_observed' ELSE 'observed' END AS fact_status
      FROM (SELECT DISTINCT session_id, ['dropper', 'ssh_persistence', 'miner'][user_id % 3 + 1] AS chain_id FROM ev WHERE command_line IS NOT NULL) r
      JOIN expd x ON x.chain_id = r.chain_id
      LEFT JOIN (SELECT session_id, technique_id, arg_min(event_id, (CASE command_line WHEN 'cd /tmp' THEN 0 ELSE 1 END, ts, event_id)) AS event_id,
          arg_min(command_line, (CASE command_line WHEN 'cd /tmp' THEN 0 ELSE 1 END, ts, event_id)) AS command_line FROM ev JOIN cmd_tech USING (command_line) GROUP BY 1, 2) h
        ON h.session_id = r.session_id AND h.technique_id = x.technique_id""", O.CMD_TECH, O.values(A.EXPECTED, "expd", "chain_id, step_index, technique_id")),
)
def _chains(spark, d):
    ev = A.events(spark, d).filter("command_line IS NOT NULL")
    runs = ev.select(F.col("session_id").alias("run_id"), A.pick(["dropper", "ssh_persistence", "miner"], F.col("user_id") % 3).alias("chain_id"), "event_id", "ts", "command_line")
    return V.verify_chains(runs, runs.select("run_id", "chain_id"), reference.chain_steps(spark), reference.chain_expectations(spark))


@query(
    "sessions_by_marker",
    sql("""SELECT run_id, arg_min(e.session_id, (e.ts, e.session_id)) AS session_id FROM
        (SELECT event_id AS run_id, honeypot_id, ts, '__probe' || left(md5(CAST(event_id % 500 AS VARCHAR)), 16) || '__' AS nonce FROM ev WHERE action = 'cowrie.login.success') m
      JOIN (SELECT session_id, honeypot_id, ts, command_line || '; echo a__probe' || left(md5(CAST(event_id % 700 AS VARCHAR)), 16) || '__b' AS command_line
        FROM ev WHERE action = 'cowrie.command.input' AND NOT labels_seeded) e
      ON e.honeypot_id = m.honeypot_id AND contains(e.command_line, m.nonce) AND e.ts BETWEEN m.ts - INTERVAL 24 HOUR AND m.ts + INTERVAL 24 HOUR GROUP BY 1"""),
)
def _marker(spark, d):
    ev = A.events(spark, d)
    marker = lambda n: F.concat(F.lit("__probe"), F.left(F.md5((F.col("event_id") % n).cast("string").cast("binary")), F.lit(16)), F.lit("__"))
    markers = ev.filter("action = 'cowrie.login.success'").select(
        F.col("event_id").alias("run_id"), marker(500).alias("nonce"), "honeypot_id", F.col("ts").alias("started_at"), F.col("ts").alias("finished_at")
    )
    said = ev.withColumn("command_line", F.concat("command_line", F.lit("; echo a"), marker(700), F.lit("b")))
    return V.sessions_by_marker(said, markers, skew_seconds=24 * 3600)


@query(
    "scan_facts",
    """SELECT l_orderkey AS run_id, 'nmap' AS module, s AS probe_id, s AS establishes, CASE WHEN done AND up THEN 'OpenSSH ' || k END AS value,
        CASE WHEN NOT done THEN 'unknown' WHEN up THEN 'observed' ELSE 'not_observed' END AS fact_status FROM (
      SELECT o_orderkey AS l_orderkey, o_custkey % 10 AS k, o_orderstatus <> 'P' AS done, s, CASE s WHEN 'service.ssh' THEN o_orderkey % 2 = 0 WHEN 'service.telnet' THEN o_orderkey % 3 = 0 ELSE false END AS up
      FROM orders, (VALUES ('service.ssh'), ('service.telnet'), ('service.http')) t(s))""",
)
def _scan(spark, d):
    o = A.table(spark, d, "orders")
    banner = F.concat(F.lit("OpenSSH "), (F.col("o_custkey") % 10).cast("string"))
    line = lambda cond, port: F.when(cond, F.concat(F.lit(f"{port}/tcp open  "), banner)).otherwise(F.lit(f"{port}/tcp closed x"))
    scans = o.select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("module_status"),
        F.concat_ws("\n", F.lit("Starting scan"), line(F.col("o_orderkey") % 2 == 0, 2222), line(F.col("o_orderkey") % 3 == 0, 2223), F.lit("done")).alias("output"),
    )
    return V.fact_from_scan(scans)


@query(
    "capture_facts",
    """SELECT o_orderkey AS run_id, 'tcpdump' AS module, 'network.activity' AS probe_id, 'network.activity' AS establishes,
      CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 4 AS VARCHAR) END AS value,
      CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_custkey % 4 > 0 THEN 'observed' ELSE 'not_observed' END AS fact_status FROM orders""",
)
def _capture(spark, d):
    o = A.table(spark, d, "orders")
    return V.fact_from_capture(o.select(
        F.col("o_orderkey").alias("run_id"), F.lit("completed").alias("module_status"), F.lit("").alias("stdout"),
        F.when(F.col("o_orderstatus") == "P", "interrupted").otherwise(
            F.concat(F.lit("listening\n"), (F.col("o_custkey") % 4).cast("string"), F.lit(" packets captured\n9 packets received"))
        ).alias("stderr"),
    ))


@query(
    "remediation",
    sql("""SELECT run_id, key AS finding_key,
        CASE WHEN key LIKE 'probe:passwd_present:%' THEN 'etc/passwd' WHEN key LIKE 'probe:proc_cpuinfo:%' THEN 'proc/cpuinfo'
          WHEN (key LIKE 'probe:os_release:%' OR key LIKE 'sanity:os.identity:%') AND distro IN ('debian', 'ubuntu') THEN 'usr/lib/os-release'
          WHEN key LIKE 'sanity:host.name:%' AND host IS NOT NULL THEN f END AS path,
        key NOT LIKE 'sanity:host.name:%' AND (key LIKE 'probe:passwd_present:%' OR key LIKE 'probe:proc_cpuinfo:%' OR
          ((key LIKE 'probe:os_release:%' OR key LIKE 'sanity:os.identity:%') AND coalesce(distro IN ('debian', 'ubuntu'), false))) AS from_template,
        CASE WHEN (key LIKE 'probe:os_release:%' OR key LIKE 'sanity:os.identity:%') AND NOT coalesce(distro IN ('debian', 'ubuntu'), false) THEN 'no_agreeing_os_release'
          WHEN key LIKE 'sanity:host.name:%' AND host IS NULL THEN 'hostname_not_observed'
          WHEN key LIKE 'probe:%' AND NOT (key LIKE 'probe:os_release:%' OR key LIKE 'probe:passwd_present:%' OR key LIKE 'probe:proc_cpuinfo:%') THEN 'no_lever_for_probe'
          WHEN key LIKE 'sanity:host.arch:%' THEN 'architecture_shows_in_file_tree' WHEN key LIKE 'service:%' THEN 'service_list_is_evaluation_config'
          WHEN key LIKE 'chain:%' THEN 'many_possible_causes' END AS unsupported_reason
      FROM (SELECT fnd.run_id, fnd.key, o.distro, o.host, unnest(CASE WHEN key LIKE 'sanity:host.name:%' AND o.host IS NOT NULL
            THEN list_filter([CASE WHEN key LIKE '%hostname_file%' THEN 'etc/hostname' END, CASE WHEN key LIKE '%hosts_file%' THEN 'etc/hosts' END], lambda x: x IS NOT NULL) ELSE [NULL] END) AS f
        FROM fnd LEFT JOIN (SELECT run_id, max(c) FILTER (probe_id = 'uname') AS distro, max(value) FILTER (probe_id = 'hostname_cmd') AS host
          FROM pr WHERE fact_status = 'observed' GROUP BY 1) o ON o.run_id = fnd.run_id)""", PR, CON, RUNS, KEYS),
)
def _remediation(spark, d):
    return V.remediation(_findings(spark, d), V.fact_claims(A.probe_results(spark, d))).drop("content")


@query(
    "evidence_packages",
    sql("""SELECT run_id, characteristic, 'probe:' || result_id AS item_id, 'probe ' || probe_id || ' (module ' || module || ') establishes ' || establishes || '; fact_status=' || fact_status
        || '; output: ' || coalesce(value, '(no output)') AS summary FROM pr
      UNION ALL SELECT run_id, 'attack_possibilities', 'chain:' || step_id, 'chain ' || chain_id || ' step ' || step_index || ' expected ' || technique_id || '; fact_status=' || fact_status
        || '; matched_rule=' || CASE WHEN fact_status = 'observed' THEN technique_id ELSE 'none' END || '; command: ' || CASE WHEN fact_status = 'observed' THEN 'cmd ' || pk ELSE '(no matching command)' END FROM st""", PR),
)
def _packages(spark, d):
    return V.evidence_packages(*_eval(spark, d))


@query(
    "verdict_gate",
    sql("""SELECT r.run_id, r.characteristic, CASE WHEN reason IS NULL THEN rating END AS rating, CASE WHEN reason IS NULL THEN 'completed' ELSE 'evaluator_failed' END AS status, reason, coalesce(cited, 0) AS cited FROM (
      SELECT v.*, c.cited, CASE WHEN rating IS NULL OR rating > 1 THEN 'rating_out_of_range' WHEN cited IS NULL THEN 'no_evidence_cited' WHEN invented > 0 THEN 'cited_evidence_not_in_package' END AS reason FROM (
        SELECT run_id, characteristic, evaluator_rating * 1.05 AS rating FROM rate) v
      LEFT JOIN (SELECT c.run_id, c.characteristic, count(*) AS cited, count(*) FILTER (p.run_id IS NULL) AS invented FROM (
          SELECT run_id, characteristic, 'probe:' || result_id AS item_id FROM pr WHERE fact_status <> 'unknown' UNION SELECT run_id, 'services', 'probe:made-up' FROM pr WHERE position = 13) c
        LEFT JOIN (SELECT run_id, characteristic, 'probe:' || result_id AS item_id FROM pr) p ON p.run_id = c.run_id AND p.characteristic = c.characteristic AND p.item_id = c.item_id GROUP BY 1, 2) c
      ON c.run_id = v.run_id AND c.characteristic = v.characteristic) r""", PR, RATE),
)
def _verdict_gate(spark, d):
    pr, st = _eval(spark, d)
    verdicts = A.ratings(spark, d).select("run_id", "characteristic", (F.col("evaluator_rating") * 1.05).alias("rating"), F.lit("seen").alias("critique"))
    place = V.characteristic(F.col("module"), F.col("probe_id")).alias("characteristic")
    cites = pr.filter("fact_status <> 'unknown'").select("run_id", place, F.concat(F.lit("probe:"), "result_id").alias("item_id")).unionByName(
        pr.filter("position = 13").select("run_id", F.lit("services").alias("characteristic"), F.lit("probe:made-up").alias("item_id"))
    )
    return K.verdict_gate(verdicts, cites, V.evidence_packages(pr, st))


CUTOFF = datetime(2024, 1, 21)


@query(
    "retention",
    sql(f"""SELECT CAST(d AS VARCHAR) AS partition, {ts('newest')}, referenced, CASE WHEN d = max(d) OVER () THEN 'write_target' WHEN newest >= TIMESTAMP '2024-01-21' THEN 'newer_than_cutoff'
        WHEN referenced > 0 THEN 'referenced' END AS keep_reason FROM (
      SELECT CAST(ts AS DATE) AS d, max(ts) AS newest, count(*) FILTER (session_id IN (SELECT session_id FROM an WHERE status = 'failed') OR event_id IN (SELECT event_id FROM kept)) AS referenced
      FROM ev GROUP BY 1)""", O.AN, CL),
)
def _retention(spark, d):
    ev = A.events(spark, d)
    an = A.analyses(ev)
    cl, ct = A.claims(ev, an)
    kept, _ = K.barrier(cl, ct, ev)
    plan = V.retention_plan(ev, [an.filter("status = 'failed'").select("session_id")], [kept.select("event_id")], CUTOFF)
    return plan.withColumn("partition", F.col("partition").cast("string"))


# --- experiment ---
X_START, X_END = datetime(2024, 1, 3), datetime(2024, 1, 27)
ROT = "rot AS (SELECT 'hp-' || s AS honeypot_id, b AS block, ['stock', 'web-server', 'nas-box', 'iot-arm'][(b + s) % 4 + 1] AS arm, TIMESTAMP '2024-01-03' + to_days(CAST(2 * b AS INTEGER)) AS b_start, TIMESTAMP '2024-01-05' + to_days(CAST(2 * b AS INTEGER)) AS b_end FROM range(4) t(s), range(12) u(b))"
STATS = f"""
xev AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-27'),
xs AS (SELECT session_id, arg_min(honeypot_id, (ts, event_id)) AS honeypot_id, min(ts) AS first, max(ts) AS last, bool_or(action = 'cowrie.login.success') AS logged_in,
    count(command_line) AS commands, count(*) FILTER (action = 'cowrie.session.file_download') AS downloads, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s,
    substr(sha256(string_agg({O.NORM.format(c='command_line')}, chr(10) ORDER BY ts, event_id) FILTER (command_line IS NOT NULL)), 1, 12) AS script
  FROM xev WHERE action <> 'cowrie.login.failed' GROUP BY 1),
asg AS (SELECT xs.*, block, arm, b_end, CASE WHEN NOT logged_in THEN 'not_logged_in' WHEN last >= b_end - INTERVAL 120 SECOND THEN 'cut' ELSE 'analysed' END AS fate
  FROM xs JOIN rot ON rot.honeypot_id = xs.honeypot_id AND first >= b_start AND first < b_end),
met AS (
  SELECT honeypot_id, block, 'session' AS view, unnest(['ran_any_share', 'commands_mean', 'download_share', 'duration_median_s']) AS metric,
    unnest([avg((commands > 0)::INT), avg(commands), avg((downloads > 0)::INT), median(duration_s)]) AS value FROM asg WHERE fate = 'analysed' GROUP BY 1, 2
  UNION ALL
  SELECT honeypot_id, block, 'script', unnest(['commands_mean', 'download_share', 'duration_median_s', 'scripts']), unnest([avg(c), avg(l), median(dd), count(script)::DOUBLE]) FROM (
    SELECT honeypot_id, block, script, avg(commands) AS c, avg((downloads > 0)::INT) AS l, avg(duration_s) AS dd FROM asg WHERE fate = 'analysed' GROUP BY 1, 2, 3) GROUP BY 1, 2),
jud AS (SELECT rot.honeypot_id, rot.block, rot.arm, b_start, b_end, coalesce(n, 0) AS analysed, coalesce(cut, 0) AS cut, coalesce(nl, 0) AS not_logged_in, coalesce(h, 0) AS covered, 48 AS total,
    CASE WHEN coalesce(h, 0) * 2 < 48 THEN 'low_coverage' WHEN coalesce(n, 0) = 0 THEN 'no_session' END AS excluded
  FROM rot LEFT JOIN (SELECT honeypot_id, block, count(*) FILTER (fate = 'analysed') AS n, count(*) FILTER (fate = 'cut') AS cut, count(*) FILTER (fate = 'not_logged_in') AS nl FROM asg GROUP BY 1, 2) a USING (honeypot_id, block)
  LEFT JOIN (SELECT rot.honeypot_id, rot.block, count(DISTINCT date_trunc('hour', ts)) AS h FROM ev JOIN rot ON rot.honeypot_id = ev.honeypot_id AND ts >= b_start AND ts < b_end GROUP BY 1, 2) c USING (honeypot_id, block))"""


def _assigned(spark, d):
    ev = A.events(spark, d)
    spans = ev.select("honeypot_id").distinct().select(
        "honeypot_id", F.lit(X_START.isoformat(sep=" ")).cast("timestamp").alias("start"), F.lit(X_END.isoformat(sep=" ")).cast("timestamp").alias("end")
    )
    blocks = X.blocks_as_run(A.rotation(spark), spans)
    # Session facts are read by every metric below.
    return ev, blocks, write_once(X.assign_to_blocks(X.session_stats(ev, X_START, X_END), blocks))


def _experiment(spark, d):
    ev, blocks, assigned = _assigned(spark, d)
    # What is judged is read twice by each of the queries that ask for it.
    return ev, assigned, write_once(X.block_exclusion(X.hour_coverage(ev, X.tallies(assigned, blocks)), list(A.ARMS)))


@query("session_stats", sql(f"SELECT honeypot_id, session_id, {ts('first')}, {ts('last')}, logged_in, commands, downloads, round(duration_s, 6) AS duration_s, script FROM xs", ROT, STATS))
def _stats(spark, d):
    return X.session_stats(A.events(spark, d), X_START, X_END)


@query(
    "experiment_blocks",
    sql(f"SELECT honeypot_id, block, arm, {ts('b_start', '\"start\"')}, {ts('b_end', '\"end\"')}, true AS opened_by_deployment, analysed, cut, not_logged_in, covered, total, excluded FROM jud", ROT, STATS),
)
def _blocks(spark, d):
    return _experiment(spark, d)[2]


@query("block_metrics", sql("SELECT honeypot_id, block, view, metric, round(value, 4) + 0.0 AS value FROM met", ROT, STATS))
def _metrics(spark, d):
    # Four places: a median of two microsecond values ends on a tie at six.
    return X.block_metrics(_assigned(spark, d)[2]).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(
    "mixes",
    sql("""SELECT arm, 'technique' AS kind, technique_id AS name, round(count(DISTINCT session_id) / any_value(n)::DOUBLE, 6) AS share FROM asg JOIN ev USING (session_id) JOIN cmd_tech USING (command_line)
        JOIN (SELECT arm, count(*) AS n FROM asg WHERE fate = 'analysed' GROUP BY 1) t USING (arm) WHERE fate = 'analysed' GROUP BY 1, 3
      UNION ALL SELECT arm, 'arch', a, round(count(*) / sum(count(*)) OVER (PARTITION BY arm)::DOUBLE, 6) FROM (
        SELECT arm, CASE regexp_extract(file_url, '[^/]*$') WHEN 'mirai.arm7' THEN 'arm' WHEN 'x86_64' THEN 'x86' WHEN 'sora.mpsl' THEN 'mips' WHEN 'i686' THEN 'x86' WHEN 'aarch64?x=1' THEN 'arm' ELSE 'none' END AS a
        FROM asg JOIN ev USING (session_id) WHERE fate = 'analysed' AND file_url IS NOT NULL) GROUP BY 1, 3""", ROT, STATS, O.CMD_TECH),
)
def _mixes(spark, d):
    ev, _, assigned = _assigned(spark, d)
    tech = X.technique_mix(assigned, ev, ["arm"]).select("arm", F.lit("technique").alias("kind"), F.col("technique_id").alias("name"), "share")
    return tech.unionByName(X.arch_mix(assigned, ev, ["arm"]).select("arm", F.lit("arch").alias("kind"), F.col("arch").alias("name"), "share"))


@query(
    "arm_summary",
    sql("""SELECT a.honeypot_id, a.view, a.metric, a.arm, round(mean, 4) + 0.0 AS mean, round(lo, 4) + 0.0 AS min, round(hi, 4) + 0.0 AS max, blocks, round(mean - s.m, 4) + 0.0 AS vs_stock FROM (
        SELECT honeypot_id, view, metric, arm, avg(value) AS mean, min(value) AS lo, max(value) AS hi, count(*) AS blocks FROM met JOIN (SELECT honeypot_id, block, arm FROM jud WHERE excluded IS NULL) USING (honeypot_id, block) GROUP BY ALL) a
      LEFT JOIN (SELECT honeypot_id, view, metric, avg(value) AS m FROM met JOIN (SELECT honeypot_id, block, arm FROM jud WHERE excluded IS NULL AND arm = 'stock') USING (honeypot_id, block) GROUP BY ALL) s
        ON s.honeypot_id = a.honeypot_id AND s.view = a.view AND s.metric = a.metric""", ROT, STATS),
)
def _arms(spark, d):
    _, assigned, judged = _experiment(spark, d)
    out = X.arm_summary(X.block_metrics(assigned), judged)
    return out.select("honeypot_id", "view", "metric", "arm", "blocks", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("mean", "min", "max", "vs_stock")])


#: Tested values per group with their place and arm number, and the groups with their arm sizes.
TESTED = """
able AS (SELECT honeypot_id FROM (SELECT honeypot_id, arm, count(*) AS n FROM jud WHERE excluded IS NULL GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (n >= 2) >= 2),
val AS (SELECT honeypot_id, view, metric, arm, value, row_number() OVER (PARTITION BY honeypot_id, view, metric ORDER BY block, arm, value) AS place,
    dense_rank() OVER (PARTITION BY honeypot_id, view, metric ORDER BY arm) AS label
  FROM met JOIN (SELECT honeypot_id, block, arm FROM jud WHERE excluded IS NULL) USING (honeypot_id, block) JOIN able USING (honeypot_id)
  WHERE (view = 'session' AND metric IN ('ran_any_share', 'commands_mean', 'download_share')) OR (view = 'script' AND metric IN ('commands_mean', 'download_share'))),
own AS (SELECT honeypot_id, view, metric, list(label ORDER BY place) AS flat FROM val GROUP BY 1, 2, 3),
grp AS (SELECT honeypot_id, view, metric, sum(n)::INT AS places, list(n ORDER BY label) AS sizes, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS observed,
    list_reduce(list_transform(range(1, sum(n)::INT + 1), lambda i: i::DOUBLE), lambda x, y: x * y) / list_reduce(list_transform(list(n ORDER BY label), lambda k: list_reduce(list_transform(range(1, k + 1), lambda i: i::DOUBLE), lambda x, y: x * y)), lambda x, y: x * y) AS ways
  FROM (SELECT honeypot_id, view, metric, label, count(*)::INT AS n, avg(value) AS m FROM val GROUP BY ALL) GROUP BY 1, 2, 3),
same AS (SELECT sizes, product(f) AS ties FROM (SELECT sizes, list_reduce(list_transform(range(1, c + 1), lambda i: i::DOUBLE), lambda x, y: x * y) AS f
    FROM (SELECT sizes, s, count(*)::INT AS c FROM (SELECT sizes, unnest(sizes) AS s FROM (SELECT DISTINCT sizes FROM grp)) GROUP BY 1, 2)) GROUP BY 1)"""
#: Every relabelling up to swapped names of arms of one size: an unused arm may come only after all earlier ones of its size.
EVERY = """
lab AS (SELECT sizes, 0 AS nth, CAST([] AS INT[]) AS labels, sizes AS left_over FROM (SELECT DISTINCT sizes FROM grp)
  UNION ALL SELECT sizes, nth + 1, list_append(labels, b), list_transform(left_over, lambda x, i: x - CASE WHEN i = b THEN 1 ELSE 0 END)
  FROM (SELECT *, unnest(range(1, len(sizes) + 1))::INT AS b FROM lab WHERE nth < list_sum(sizes))
  WHERE left_over[b] > 0 AND (left_over[b] < sizes[b] OR len(list_filter(range(1, b), lambda a: sizes[a] = sizes[b] AND left_over[a] = sizes[a])) = 0)),
tried AS (SELECT sizes, NULL AS flat, row_number() OVER () AS nr, labels FROM lab WHERE nth = list_sum(sizes))"""
SHUFFLES = 2_000
SHUFFLED = f"""
tried AS (SELECT sizes, flat, n AS nr, list(flat[r]::INT ORDER BY place) AS labels FROM (
    SELECT *, row_number() OVER (PARTITION BY sizes, flat, n ORDER BY md5('0:' || n || ':' || place)) AS r FROM (
      SELECT sizes, flat, n, unnest(range(places)) AS place FROM (SELECT DISTINCT sizes, places, flat FROM grp JOIN own USING (honeypot_id, view, metric)), range({SHUFFLES}) t(n)))
  GROUP BY 1, 2, 3)"""


def _permutation_sql(tried: str, p: str, exhaustive: str, relabelings: str) -> str:
    body = f"""SELECT honeypot_id, view, metric, p, {exhaustive} AS exhaustive, smallest_p, relabelings,
        max(least(1.0, raw * p)) OVER (PARTITION BY honeypot_id, view ORDER BY p, metric ROWS UNBOUNDED PRECEDING) AS holm FROM (
      SELECT *, count(*) OVER (PARTITION BY honeypot_id, view) - row_number() OVER (PARTITION BY honeypot_id, view ORDER BY p, metric) + 1 AS raw FROM (
        SELECT g.honeypot_id, g.view, g.metric, {p} AS p, ties / ways AS smallest_p, CAST({relabelings} AS BIGINT) AS relabelings FROM (
          SELECT honeypot_id, view, metric, count(*) AS scored, count(*) FILTER (spread >= observed - 1e-12 * greatest(1.0, abs(observed))) AS hits FROM (
            SELECT honeypot_id, view, metric, nr, any_value(observed) AS observed, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS spread FROM (
              SELECT v.honeypot_id, v.view, v.metric, t.nr, t.labels[v.place] AS a, count(*) AS n, avg(value) AS m, any_value(g.observed) AS observed
              FROM val v JOIN grp g USING (honeypot_id, view, metric) JOIN own o USING (honeypot_id, view, metric) JOIN tried t ON t.sizes = g.sizes AND (t.flat IS NULL OR t.flat = o.flat) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) h
        JOIN grp g USING (honeypot_id, view, metric) JOIN same USING (sizes)))"""
    return sql(body, ROT, STATS, TESTED, tried).replace("WITH ", "WITH RECURSIVE ", 1)


def _tested(spark, d):
    _, assigned, judged = _experiment(spark, d)
    return X.tested_values(X.block_metrics(assigned), judged)


@query("permutation", _permutation_sql(EVERY, "hits / scored", "true", "ways"))
def _permutation(spark, d):
    """The labellings of every sensor's blocks, all of them."""
    return X.holm(X.permutation(_tested(spark, d), ["honeypot_id", "view", "metric"]), ["honeypot_id", "view"])


@query("permutation_sampled", _permutation_sql(SHUFFLED, "(hits + 1) / (scored + 1)", "false", str(SHUFFLES)))
def _permutation_sampled(spark, d):
    """The same tests by shuffles that a counter decides."""
    return X.holm(X.permutation(_tested(spark, d), ["honeypot_id", "view", "metric"], limit=0, samples=SHUFFLES), ["honeypot_id", "view"])


#: A budget of this many tokens cuts the commands of an ordinary session several times.
SMALL_BUDGET = 150
FRAME = "\nsession_id: \nattacker_ip: \nfailed_logins: \nsuccessful_login: \ncommands:\n"


@query(
    "token_chunks",
    sql(f"""SELECT session_id, chunk_no, event_id, pos, cost AS chars FROM (SELECT * FROM packed) packed""", O.RUNS, O.OUTPUTS, f"""
heads AS (SELECT session_id, {len(text.BLOCK_BEGIN + text.BLOCK_END + FRAME)}
    + length(session_id) + length(arg_min(source_ip, (ts, event_id))) + length(CAST(count(*) FILTER (action = 'cowrie.login.failed') AS VARCHAR))
    + CASE WHEN bool_or(action = 'cowrie.login.success') THEN 4 ELSE 5 END AS frame FROM ev GROUP BY 1),
entries AS (SELECT session_id, event_id, frame, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS pos,
    length('  - event_id: ' || event_id || chr(10) || '    timestamp: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' || chr(10) || '    command: ' || command
        || CASE WHEN repeat_count > 1 THEN ' (repeated ' || repeat_count || 'x)' ELSE '' END || chr(10))
    + coalesce(length('    output: ' || replace(output_excerpt, chr(10), ' [line break] ') || chr(10)), 0) AS cost FROM outputs JOIN heads USING (session_id)),
packed AS (SELECT session_id, event_id, pos, cost, frame, 0 AS chunk_no, cost AS used FROM entries WHERE pos = 0
    UNION ALL SELECT e.session_id, e.event_id, e.pos, e.cost, e.frame,
      CASE WHEN p.used > 0 AND p.used + e.cost + e.frame > {SMALL_BUDGET * text.CHARS_PER_TOKEN} THEN p.chunk_no + 1 ELSE p.chunk_no END,
      CASE WHEN p.used > 0 AND p.used + e.cost + e.frame > {SMALL_BUDGET * text.CHARS_PER_TOKEN} THEN e.cost ELSE p.used + e.cost END
    FROM packed p JOIN entries e ON e.session_id = p.session_id AND e.pos = p.pos + 1)""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def _chunks(spark, d):
    ev = A.with_outputs(A.events(spark, d))
    return S.pack_chunks(S.compact(ev), S.compact_summary(ev), budget=SMALL_BUDGET)


@query(
    "conversation_chunks",
    """WITH t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, regexp_replace(regexp_replace(text, '(-{3,}|={3,}|_{3,}|\\*{3,}|~{3,}|#{3,})', '[fence-like delimiter run neutralised]', 'g'), '\\n$', '') AS flat FROM conversations)
      SELECT conv_id, turn, tokens, replace(flat, chr(10), ' [line break] ') AS flat FROM t""",
)
def _conversation(spark, d):
    from lureframe.functions import text

    return A.table(spark, d, "conversations").select("conv_id", "turn", text.estimate_tokens("text").alias("tokens"), text.fence_safe("text").alias("flat"))
