"""The adapter relations in DuckDB SQL, written apart from the Spark ones and used only to check them."""

from __future__ import annotations

from lureframe.plans import adapter as A


def q(value) -> str:
    if value is None:
        return "NULL"
    return "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values(rows, name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows) + ")"


def band(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 80 THEN 'critical' WHEN {score} >= 60 THEN 'high' WHEN {score} >= 40 THEN 'medium' "
        f"WHEN {score} >= 20 THEN 'low' ELSE 'informational' END"
    )


def ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name or column}"


EV = f"""
raw_ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k FROM events),
gap_ev AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {A.SESSION_GAP_US} THEN 1 ELSE 0 END AS nw
  FROM raw_ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
num_ev AS (
  SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
  FROM gap_ev),
ev AS (
  SELECT event_id, ts, user_id || '-' || session_no AS session_id, 'hp-' || (user_id % 4) AS honeypot_id,
    'decoy-' || (user_id % 4) AS honeypot_name,
    CASE WHEN user_id % 10 = 0 THEN '10.0.' || ((user_id // 250) % 256) || '.' || (user_id % 250 + 1)
      ELSE '62.' || ((user_id // 250) % 256) || '.' || (user_id % 7) || '.' || (user_id % 250 + 1) END AS source_ip,
    k + 1024 AS source_port,
    CASE WHEN user_id % 10 <> 0 THEN {array(A.COUNTRIES)}[user_id % 7 + 1] END AS source_country,
    '192.0.2.' || (user_id % 4 + 10) AS destination_ip,
    CASE WHEN k % 10 = 9 THEN NULL WHEN k % 10 = 8 THEN 0 WHEN k % 10 < 3 THEN 23 ELSE 22 END AS destination_port,
    CASE WHEN k % 10 < 3 THEN 'telnet' ELSE 'ssh' END AS protocol,
    CASE WHEN event_type = 'signup' THEN 'cowrie.login.success' WHEN event_type = 'error' THEN 'cowrie.login.failed'
      WHEN event_type = 'click' THEN 'cowrie.command.input'
      WHEN event_type = 'view' AND k >= 70 THEN 'cowrie.session.closed' WHEN event_type = 'view' THEN 'cowrie.session.connect'
      ELSE 'cowrie.session.file_download' END AS action,
    CASE event_type WHEN 'view' THEN 'network' WHEN 'signup' THEN 'authentication' WHEN 'error' THEN 'authentication'
      WHEN 'click' THEN 'process' ELSE 'file' END AS category,
    CASE WHEN event_type IN ('signup', 'error') THEN {array(A.USERS)}[k % 5 + 1] END AS username,
    CASE WHEN event_type IN ('signup', 'error') THEN 'pw' || (k % 13) END AS password,
    CASE WHEN event_type = 'click' THEN {array(A.COMMANDS)}[k % {len(A.COMMANDS)} + 1] END AS command_line,
    CASE WHEN event_type = 'purchase' THEN 'http://198.51.100.' || (k % 20) || '/bins/' || {array(A.ARCH_FILES)}[k % 6 + 1] END AS file_url,
    CASE WHEN event_type = 'purchase' THEN '/tmp/.b' || (k % 3) END AS file_name,
    CASE WHEN event_type = 'purchase' THEN sha256('payload-' || (k % 12)) END AS sha256,
    user_id % 25 = 1 AS labels_seeded,
    CASE WHEN user_id % 6 <> 5 THEN (user_id * 7 + k) % 101 END AS risk_score,
    CASE WHEN user_id % 6 <> 5 THEN {band('((user_id * 7 + k) % 101)')} END AS risk_level,
    CASE WHEN event_type = 'click' AND user_id % 6 <> 5 THEN {array(['T1082', 'T1105', None, 'T1033', 'T1070.004'])}[k % 5 + 1] END AS mitre_technique_id,
    CASE WHEN user_id % 6 <> 5 THEN {array(A.LABELS)}[user_id % 9 + 1] END AS ai_classification,
    user_id, session_no, k
  FROM num_ev)"""

AN = f"""
per_session AS (SELECT session_id, user_id, session_no, max(ts) AS last_ts, count(*) AS n FROM ev GROUP BY ALL),
an AS (
  SELECT session_id || '-a' || j AS analysis_id, session_id, last_ts + to_hours(CAST(j AS INTEGER)) AS created_at,
    CASE WHEN (user_id + session_no + j) % 11 = 0 THEN 'failed' ELSE 'completed' END AS status,
    (user_id * 7 + session_no * 13 + n * 5 + j) % 101 AS risk_score,
    {band('((user_id * 7 + session_no * 13 + n * 5 + j) % 101)')} AS risk,
    {array(A.LABELS)}[(user_id + session_no * 3 + j) % 9 + 1] AS classification,
    (user_id + session_no) % 5 = 0 AS inferred
  FROM per_session, (VALUES (1), (2)) AS t(j)
  WHERE (user_id + session_no) % 3 <> 0 AND (j = 1 OR (user_id + session_no) % 4 = 0))"""


def _catalog():
    from lureframe.sources.reference import CATALOG_ONLY, RULES

    return sorted([(i, n, t) for i, n, t, _ in RULES] + list(CATALOG_ONLY))


CATALOG = values(_catalog(), "catalog", "technique_id, name, tactic")
CMD_TECH = values(
    [(A.COMMANDS[i], t) for i, ts_ in A.COMMAND_TECHNIQUES.items() for t in ts_], "cmd_tech", "command_line, technique_id"
)
TM = """
sess_tech AS (SELECT DISTINCT session_id, technique_id FROM ev JOIN cmd_tech USING (command_line)),
tm AS (
  SELECT m.*, c.name AS technique_name, c.tactic, analysis_id || ':' || technique_id AS mapping_id FROM (
    SELECT analysis_id, technique_id, 1.0::DOUBLE AS confidence, 'rule' AS source, technique_id AS rule_id, created_at AS ts
    FROM an JOIN sess_tech USING (session_id)
    UNION ALL
    SELECT analysis_id, 'T1110.001', risk_score / 100.0::DOUBLE, 'llm', NULL, created_at FROM an WHERE inferred) m
  JOIN catalog c USING (technique_id))"""
DP = values(A.DEPLOYMENTS, "dp0", "deployment_id, honeypot_id, persona, at0") + (
    ", dp AS (SELECT deployment_id, honeypot_id, persona, CAST(at0 AS TIMESTAMP) AS deployed_at FROM dp0)"
)
CH = values(A.CHANGES, "ch0", "change_id, honeypot_id, at0, kind") + (
    ", ch AS (SELECT change_id, honeypot_id, CAST(at0 AS TIMESTAMP) AS changed_at, kind FROM ch0)"
)
# G1 in RE2 terms.
NORM = (
    "trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '\\b[0-9a-fA-F]{{32,64}}\\b', '<hash>', 'g'), "
    "'\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b', '<ip>', 'g')), '\\s+', ' ', 'g'))"
)
FP = f"""
fp_rows AS (SELECT session_id, event_id, ts, source_ip, honeypot_id, {NORM.format(c='command_line')} AS norm
  FROM ev WHERE action = 'cowrie.command.input'),
fp AS (
  SELECT session_id, substr(sha256(string_agg(norm, chr(10) ORDER BY ts, event_id)), 1, 12) AS fingerprint,
    count(*) AS command_count, list(norm ORDER BY ts, event_id)[1:20] AS commands, min(ts) AS first_ts, max(ts) AS last_ts,
    arg_min(source_ip, (ts, event_id)) AS source_ip, arg_min(honeypot_id, (ts, event_id)) AS honeypot_id
  FROM fp_rows GROUP BY session_id)"""
RUNS = """
cmd_prev AS (SELECT session_id, event_id, ts, command_line, lag(command_line) OVER w AS prev FROM ev
  WHERE action = 'cowrie.command.input' AND command_line <> '' WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
cmd_run AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> command_line THEN 1 ELSE 0 END)
  OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM cmd_prev),
comp AS (SELECT session_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, command_line AS command,
  count(*) AS repeat_count FROM cmd_run GROUP BY session_id, run, command_line)"""

# The compacted commands with the excerpt of their first event's output.
OUTPUTS = """
outputs AS (SELECT c.*, CASE WHEN len(l) <= 40 THEN array_to_string(l, chr(10))
    ELSE array_to_string(list_concat(l[1:20], ['... ' || (len(l) - 40) || ' lines omitted ...'], l[-20:]), chr(10)) END AS output_excerpt
  FROM comp c LEFT JOIN (SELECT event_id, CASE WHEN k % 3 = 0 THEN list_transform(range(1, k % 60 + 2), lambda i: 'line ' || i) END AS l FROM ev) USING (event_id))"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in (EV, *ctes)) + "\n" + body
