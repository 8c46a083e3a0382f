"""Readers, sinks and streaming jobs on temporary files."""

import json
import struct
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lureframe.operators import ingest, sessions
from lureframe.plans import adapter
from lureframe.sources import history, logs, recordings, sinks
from lureframe.streaming import jobs

T0 = datetime(2024, 3, 1)
SENSORS = [("ssh-a", "hp-a", "A"), ("ssh-b", "hp-b", "B")]


def line(i, **kw):
    return json.dumps({"eventid": sessions.COMMAND, "timestamp": f"2024-03-01T00:00:{i:02d}Z", "session": f"s{i % 3}", "src_ip": "1.2.3.4", "input": "id", **kw})


def logs_in(folder):
    for sensor in ("ssh-a", "ssh-b"):
        (folder / sensor).mkdir(parents=True)
        (folder / sensor / "x.json.2024-03-01").write_text("\n".join(line(i) for i in range(5)) + "\n" + line(9, odd=1) + "\n")
        (folder / sensor / "x.json").write_text(line(20) + "\n")
    return str(folder)


def test_batch_reader_stamps_the_sensor(spark, tmp_path):
    raw = logs.read_sensor_logs(spark, logs_in(tmp_path / "in"), SENSORS)
    assert {(r.honeypot_id, r["count"]) for r in raw.groupBy("honeypot_id").count().collect()} == {("hp-a", 7), ("hp-b", 7)}


def test_ingest_stream_reads_closed_logs_once(spark, tmp_path):
    folder = logs_in(tmp_path / "in")
    out, dead, ck = (str(tmp_path / n) for n in ("out", "dead", "ck"))
    for _ in range(2):
        q = jobs.ingest_stream(logs.stream_sensor_logs(spark, folder, SENSORS), out, dead, ck)
        q.awaitTermination(120)
        assert q.exception() is None
    ev = spark.read.parquet(out)
    assert ev.count() == 10 and ev.select("event_id").distinct().count() == 10 and spark.read.parquet(dead).count() == 2
    # The stream stores what the batch job would.
    good, _ = ingest.normalize(logs.read_sensor_logs(spark, folder, SENSORS).filter("raw NOT LIKE '%:20Z%'"))
    assert {r.event_id for r in good.collect()} == {r.event_id for r in ev.collect()}


def test_event_sink_prunes_partitions(spark, tmp_path):
    good, _ = ingest.normalize(logs.read_sensor_logs(spark, logs_in(tmp_path / "in"), SENSORS))
    sinks.write_events(good, str(tmp_path / "ev"))
    back = sinks.read_events(spark, str(tmp_path / "ev"))
    one = back.filter((F.col("event_date") == "2024-03-01") & (F.col("honeypot_id") == "hp-a") & (F.col("action") == sessions.COMMAND))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 6 and "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(action" in plan


def test_seed_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session": "seed-1", "src_ip": "1.2.3.4", "src_port": 9, "events": [{"offset": 0, "eventid": "cowrie.session.connect", "dst_port": 22}, {"offset": 30, "eventid": sessions.COMMAND, "input": "id"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"session": "seed-2", "src_ip": "1.2.3.5", "src_port": 9, "events": [{"offset": 100, "eventid": sessions.COMMAND, "input": "ls"}]}))
    raw = logs.seed_corpus(spark, str(tmp_path), T0)
    good, bad = ingest.normalize(raw.select("raw"))
    assert sorted(r.seed_id for r in raw.collect()) == ["seed-1-000", "seed-1-001", "seed-2-000"] and bad.count() == 0
    got = {(r.session_id, r.action): (r.ts, r.labels_seeded) for r in good.collect()}
    assert got["seed-2", sessions.COMMAND] == (T0 - timedelta(minutes=5), True) and got["seed-1", sessions.COMMAND][0] == T0 - timedelta(minutes=5, seconds=70)


def record(op, size, direction, sec, usec, data=b""):
    return struct.pack("<iLiiLL", op, 0, size, direction, sec, usec) + data


def test_recordings_and_replay(spark, tmp_path):
    sec = int(T0.replace(tzinfo=UTC).timestamp())
    body = record(1, 0, 0, sec, 0) + record(3, 2, 2, sec, 250_000, b"hi") + record(3, 1, 1, sec, 300_000, b"k") + record(3, 2, 3, sec + 1, 0, b"id") + record(3, 9, 2, sec + 2, 0, b"torn")
    name = "ab" * 32
    (tmp_path / name).write_bytes(body)
    (tmp_path / "notes.txt").write_bytes(body)
    frames = recordings.read_recordings(spark, str(tmp_path))
    assert [(r.data, r.truncated) for r in frames.orderBy("t").collect()] == [("hi", False), ("$ id\r\n", False)]
    rows = [("s", 1, T0, "cowrie.log.closed", name, "h"), ("gone", 2, T0, "cowrie.log.closed", "cd" * 32, "h"), ("none", 3, T0, "cowrie.session.connect", None, "h"), ("late", 4, T0 + timedelta(seconds=30), "cowrie.log.closed", name, "h")]
    ev = spark.createDataFrame(rows, "session_id string, event_id int, ts timestamp, action string, sha256 string, honeypot_id string")
    got = [(r.session_id, r.status, r.t, r.shared) for r in sessions.session_replay(ev, frames).orderBy("session_id", "t").collect()]
    assert got == [("gone", "missing", None, False), ("late", "ok", 0.25, True), ("late", "ok", 1.0, True), ("none", "no_recording", None, False), ("s", "ok", 0.25, False), ("s", "ok", 1.0, False)]


def test_csv_export(spark, tmp_path):
    ev = spark.createDataFrame([("h", "s", '=cmd,"x"', -5, T0)], "honeypot_id string, session_id string, command_line string, risk_score int, ts timestamp")
    cols = {"time": "ts", "command": "command_line", "score": "risk_score"}
    sinks.export_csv(ev, str(tmp_path / "csv"), cols)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert data == b'time,command,score\r\n2024-03-01T00:00:00.000Z,"\'=cmd,""x""",-5\r\n'


def test_history(spark, tmp_path):
    at = datetime(2024, 3, 1, tzinfo=UTC)
    history.append_deployments(history.deployment_rows(spark, ["b", "a"], "web", "d", "me", at), str(tmp_path / "dp"))
    assert [r.honeypot_id for r in history.read_history(spark, str(tmp_path / "dp"), "deployments").collect()] == ["a", "b"]
    ch = spark.createDataFrame([("1", "h", T0, "note", "x", "me"), ("2", "h", T0, "gossip", "x", "me")], history.CHANGE_DDL)
    assert [(r.change_id, r.reason) for r in history.append_changes(ch, str(tmp_path / "ch")).collect()] == [("2", "unknown_kind")]
    assert history.read_history(spark, str(tmp_path / "ch"), "changes").count() == 1


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    return q


def event_stream(spark, tmp_path, frames):
    """A file stream fed one frame per micro-batch."""
    folder = tmp_path / "stream"
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def slim(spark, rows):
    return spark.createDataFrame(rows, "event_id int, ts timestamp, session_id string, source_ip string, action string, command_line string, risk_level string")


def ev(i, minute, session="s", action=sessions.COMMAND, cmd="id", risk="low"):
    return (i, T0 + timedelta(minutes=minute), session, "9.9.9.9", action, cmd, risk)


def test_windowed_streams_agree_with_batch(spark, tmp_path):
    data = [ev(i, i, risk="high" if i % 4 == 0 else "low") for i in range(30)] + [ev(99, 600)]
    src = event_stream(spark, tmp_path, [slim(spark, data[:20]), slim(spark, data[20:])])
    q = drain(jobs.activity_counts(src), "tumbling")
    got = {(r.bucket, r.events, r.high_risk) for r in spark.table("tumbling").collect()}
    q.stop()
    want = slim(spark, data[:30]).groupBy(F.window("ts", "5 minutes").start.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("risk_level") == "high").alias("h"))
    assert got == {tuple(r) for r in want.collect()}
    q = drain(jobs.inactivity_sessions(src), "idle")
    assert [(r.ip, r.requests) for r in spark.table("idle").collect()] == [("9.9.9.9", 30)]
    q.stop()
    q = drain(jobs.sliding_kpis(src, "10 minutes", "5 minutes"), "sliding")
    trend = {r.start: (r.events, r.previous) for r in jobs.against_previous(spark.table("sliding")).collect()}
    q.stop()
    assert trend[T0 + timedelta(minutes=10)] == (10, 10) and trend[T0] == (10, 0)


def test_session_state_and_late_rows(spark, tmp_path):
    frames = [
        slim(spark, [ev(1, 0, "a", "cowrie.login.success"), ev(2, 1, "a"), ev(3, 1, "b")]), slim(spark, [ev(4, 2, "a", sessions.CLOSED)]),
        slim(spark, [ev(5, 600, "c")]), slim(spark, [ev(7, 601, "c")]), slim(spark, [ev(6, 5, "late"), ev(8, 602, "c")]),
    ]
    src = event_stream(spark, tmp_path, frames)
    q = drain(jobs.session_states(src), "states")
    got = {(r.session_id, r.events, r.commands, r.logged_in, r.ended) for r in spark.table("states").collect()}
    q.stop()
    assert ("a", 3, 1, True, "closed") in got and ("b", 1, 1, False, "timeout") in got
    late = jobs.LateRows()
    spark.streams.addListener(late)
    q = drain(jobs.activity_counts(src), "lateness")
    for _ in range(100):
        if late.rows.get(q.id):
            break
        time.sleep(0.1)
    assert late.rows[q.id] == 1
    q.stop()
    spark.streams.removeListener(late)


def test_an_event_after_the_close_is_part_of_its_session(spark, tmp_path):
    frames = [slim(spark, [ev(1, 0, "a")]), slim(spark, [ev(2, 2, "a", sessions.CLOSED)]), slim(spark, [ev(3, 1, "a")]), slim(spark, [ev(4, 600, "z")]), slim(spark, [ev(5, 601, "z")])]
    q = drain(jobs.session_states(event_stream(spark, tmp_path, frames)), "closing")
    got = [(r.session_id, r.events, r.commands, r.ended) for r in spark.table("closing").collect()]
    q.stop()
    assert got == [("a", 3, 2, "closed")]


def test_sessions_share_the_state_of_their_shard(spark, tmp_path):
    many = 2000
    first = [ev(i, i % 7, f"s{i}", "cowrie.login.success" if i % 3 else sessions.COMMAND) for i in range(many)]
    second = [ev(many + i, 20 + i % 7, f"s{i}", sessions.CLOSED if i % 5 else sessions.COMMAND) for i in range(0, many, 2)] + [ev(9000 + i, 21, "hot") for i in range(50)]
    frames = [slim(spark, first), slim(spark, second), slim(spark, [ev(9990, 600, "z")]), slim(spark, [ev(9991, 601, "z")])]
    q = drain(jobs.session_states(event_stream(spark, tmp_path, frames)), "shards")
    got = {tuple(r) for r in spark.table("shards").collect()}
    held = [op["numRowsTotal"] for p in q.recentProgress for op in json.loads(p.json)["stateOperators"]]
    q.stop()
    action = lambda name: F.col("action") == name
    want = slim(spark, first + second).groupBy("session_id").agg(
        F.min("ts"), F.max("ts"), F.count("*"), F.count_if(action(sessions.COMMAND)), F.bool_or(action("cowrie.login.success")),
        F.when(F.bool_or(action(sessions.CLOSED)), "closed").otherwise("timeout"))
    assert len(got) == many + 1 and got == {tuple(r) for r in want.collect()}
    assert 0 < max(held) < many / 3  # a row per shard, not one per session


def test_a_session_goes_by_its_own_times_in_a_shared_shard(spark, tmp_path):
    frames = [
        slim(spark, [ev(1, 0, "idle"), ev(2, 1, "shut", sessions.CLOSED), ev(3, 50, "open"), ev(4, 2, None), (5, None, "timeless", "9.9.9.9", sessions.COMMAND, "id", "low")]),
        slim(spark, [ev(6, 75, "z")]), slim(spark, [ev(7, 76, "open"), ev(8, 75, "z")]), slim(spark, [ev(9, 76, "open")]), slim(spark, [ev(10, 700, "z")]), slim(spark, [ev(11, 700, "idle")]), slim(spark, [ev(12, 701, "z")]),
    ]
    q = drain(jobs.session_states(event_stream(spark, tmp_path, frames), shards=1), "one_shard")
    got = {(r.session_id, r.started_at, r.last_at, r.events, r.ended) for r in spark.table("one_shard").collect() if r.session_id != "z"}
    q.stop()
    at = lambda minute: T0 + timedelta(minutes=minute)
    assert got == {
        ("idle", at(0), at(0), 1, "timeout"), ("shut", at(1), at(1), 1, "closed"), ("open", at(50), at(76), 3, "timeout"), (None, at(2), at(2), 1, "timeout"),
        ("timeless", None, None, 1, "timeout"),
    }


def test_a_session_due_at_the_watermark_is_given_out(spark, tmp_path):
    frames = [slim(spark, [ev(1, 0, "a")]), slim(spark, [ev(2, 70, "z")]), slim(spark, [ev(3, 70, "z")])]
    q = drain(jobs.session_states(event_stream(spark, tmp_path, frames)), "due")
    got = [(r.session_id, r.events, r.ended) for r in spark.table("due").collect()]
    q.stop()
    assert got == [("a", 1, "timeout")]


def test_indicator_stream_is_idempotent(spark, tmp_path):
    base = adapter.events(spark, "/root/testdata/sf0.001").drop("user_id", "session_no", "k")
    src = event_stream(spark, tmp_path, [base.filter("event_id < 500"), base.filter("event_id >= 500"), base.filter("event_id < 100")])
    links = str(tmp_path / "links")
    q = jobs.indicator_stream(src, links, str(tmp_path / "ck"))
    q.awaitTermination(180)
    assert q.exception() is None
    got = {(r.type, r.value, r.session_count, r.source) for r in jobs.current_indicators(jobs.stored_links(spark, links, base.schema["event_id"].dataType.simpleString())).collect()}
    from lureframe.operators import indicators as I

    batch = I.correlate(I.session_links(I.extract(base).withColumn("seen_at", F.lit(T0))))
    assert got == {(r.type, r.value, r.session_count, r.source) for r in batch.collect()}


def test_first_sightings(spark, tmp_path):
    src = event_stream(spark, tmp_path, [slim(spark, [ev(2, 5, cmd="uname -a"), ev(3, 6, cmd="id")]), slim(spark, [ev(1, 1, cmd="sudo id")])])
    q = drain(jobs.first_sightings(src), "first", "complete")
    assert {r.technique_id: r.event_id for r in spark.table("first").collect()} == {"T1082": 2, "T1033": 1}
    q.stop()


def test_ingest_stream_keeps_lines_of_any_age(spark, tmp_path):
    line = lambda n, day: json.dumps({"eventid": "cowrie.command.input", "timestamp": f"{day}T00:00:{n:02d}Z", "session": "s", "src_ip": "9.9.9.9", "input": f"cmd {n}"})
    folder = tmp_path / "logs" / "ssh-a"
    folder.mkdir(parents=True)
    days = {"2024-05-01": ["no json"], "2099-01-01": [], "2024-04-01": ["no json"], "2023-01-01": []}
    stored, dead, ck = (str(tmp_path / x) for x in ("events", "dead", "ck"))
    for k, (day, odd) in enumerate(days.items()):
        lines = [line(n, day) for n in range(5)] + odd + ([line(0, "2024-05-01")] if k else [])  # the last is redelivered
        (folder / f"cowrie.json.2024-01-{k + 1:02d}").write_text("\n".join(lines))
        q = jobs.ingest_stream(logs.stream_sensor_logs(spark, str(tmp_path / "logs"), SENSORS), stored, dead, ck)
        q.awaitTermination(180)
        assert q.exception() is None
    events = spark.read.parquet(stored)
    raw = logs.read_sensor_logs(spark, str(tmp_path / "logs"), SENSORS)
    good, bad = ingest.normalize(raw.distinct())
    ids = sorted(r.event_id for r in events.collect())
    assert len(ids) == 20 and ids == sorted(r.event_id for r in good.collect())
    assert [r.raw for r in spark.read.parquet(dead).collect()] == [r.raw for r in bad.collect()] == ["no json"]


def test_values_of_the_wrong_type_are_refused(spark):
    base = {"eventid": "cowrie.command.input", "timestamp": "2024-05-01T00:00:00Z", "session": "s"}
    odd = [{"src_port": "abc"}, {"src_port": 2**40}, {"http": "x"}, {"session": {"a": 1}}, {"input": [1]}, {"http": {"response": {"status_code": "no"}}}, {"labels": {"seeded": "maybe"}}]
    fine = [{"src_port": "22"}, {"src_port": 22}, {"input": "{not an object"}, {"input": '{"a":1}'}, {"http": {"response": {"status_code": 404}}}, {"labels": {"seeded": True}}]
    rows = [(json.dumps(base | x), "hp", "n") for x in odd + fine]
    good, bad = ingest.normalize(spark.createDataFrame(rows, "raw string, honeypot_id string, honeypot_name string"))
    assert sorted(r.raw for r in bad.filter("reason = 'invalid_type'").collect()) == sorted(json.dumps(base | x) for x in odd)
    kept = good.collect()
    assert sorted((r.source_port for r in kept if r.source_port)) == [22, 22] and {r.command_line for r in kept} == {None, "{not an object", '{"a":1}'}
    assert [r.http_status for r in kept if r.http_status] == [404] and sum(r.labels_seeded for r in kept) == 1


def test_countries_of_both_address_families(spark):
    cidr = spark.createDataFrame([("9.0.0.0/8", "AA"), ("9.9.0.0/16", "BB"), ("2a00::/12", "CC"), ("2a01:e00::/26", "DD"), ("2a01:e34:1::/47", "EE")], "cidr string, country string")
    want = {"9.1.1.1": "AA", "9.9.1.1": "BB", "2a0f:1::1": "CC", "2a01:e01::5": "DD", "2a01:e34:1:ffff::1": "EE", "2a01:e34:2::1": "DD", "2b00::1": None, "8.8.8.8": None}
    ev = spark.createDataFrame([(a, None) for a in want], "source_ip string, source_country string")
    assert {r.source_ip: r.source_country for r in ingest.geoip_country(ev, cidr).collect()} == want


def test_indicator_buckets_hold_each_key_once_and_survive_a_replay(spark, tmp_path):
    base = adapter.events(spark, "/root/testdata/sf0.001").drop("user_id", "session_no", "k")
    kind = base.schema["event_id"].dataType.simpleString()
    src = event_stream(spark, tmp_path, [base.filter("event_id < 500"), base.filter("event_id >= 500"), base.filter("event_id % 97 = 3")])
    links = str(tmp_path / "links")
    jobs.indicator_stream(src, links, str(tmp_path / "ck")).awaitTermination(180)
    read = lambda: jobs.stored_links(spark, links, kind)
    rows = read()
    assert rows.count() == rows.select("type", "value", "session_id").distinct().count() > 0
    before = sorted(map(str, rows.collect()))
    # A list that was written last is lost with its batch; the replay writes both again.
    import shutil

    shutil.rmtree(f"{links}/lists/batch=2")
    commits = tmp_path / "ck" / "commits" / "2"
    commits.unlink(), (commits.parent / ".2.crc").unlink()
    jobs.indicator_stream(src, links, str(tmp_path / "ck")).awaitTermination(180)
    assert sorted(map(str, read().collect())) == before
    named = set(jobs._bucket_files(spark, links).values()) | set(jobs._bucket_files(spark, links, before=2).values())
    assert {int(n.partition("=")[2]) for n in jobs._folders(spark, links) if n.startswith("generation=")} == named


def test_late_rows_have_a_table_that_outlives_a_restart(spark, tmp_path):
    frames = [slim(spark, [ev(1, 0), ev(2, 30)]), slim(spark, [ev(3, 25), ev(4, 19), ev(5, 60)])]
    more = [slim(spark, [ev(6, 49), ev(7, 51)])]
    src = event_stream(spark, tmp_path, frames)
    at = [str(tmp_path / n) for n in ("on", "late", "marks", "ck")]
    jobs.late_rows_stream(src, *at).awaitTermination(120)
    assert [r.event_id for r in spark.read.parquet(at[1]).collect()] == [4]
    more[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
    jobs.late_rows_stream(spark.readStream.schema(frames[0].schema).parquet(str(tmp_path / "stream")), *at).awaitTermination(120)
    assert sorted((r.event_id, r.batch_id) for r in spark.read.parquet(at[1]).collect()) == [(4, 1), (6, 2)]
    assert spark.read.parquet(at[0]).count() == 5


def test_a_page_is_read_with_all_that_hangs_on_it(spark):
    from lureframe.operators import search

    page = spark.createDataFrame([("a1", "s"), ("a2", "t")], "analysis_id string, session_id string")
    claims = spark.createDataFrame([(1, "a1", "x", None, "one"), (2, "a1", "x", "T1", "two"), (3, "a9", "x", None, "other")], "claim_id int, analysis_id string, kind string, technique_id string, text string")
    cites = spark.createDataFrame([(1, 10, T0, "b"), (1, 9, T0, "a"), (2, 8, T0, "c"), (3, 7, T0, "d")], "claim_id int, event_id int, ts timestamp, artifact string")
    refused = spark.createDataFrame([(4, "a2", "stage", "x", "why", None, "four", [1])], "claim_id int, analysis_id string, stage string, kind string, reason string, technique_id string, text string, cited_event_ids array<int>")
    actions = spark.createDataFrame([("a2", "P2", "b", "r"), ("a2", "P1", "a", "r")], "analysis_id string, priority string, action string, rationale string")
    one, two = search.hydrate(page, claims, cites, refused, actions).orderBy("analysis_id").collect()
    assert [(c.claim_id, [e.artifact for e in c.evidence]) for c in one.claims] == [(1, ["a", "b"]), (2, ["c"])] and one.rejections == one.actions == []
    assert two.claims == [] and [r.reason for r in two.rejections] == ["why"] and [a.priority for a in two.actions] == ["P1", "P2"]
