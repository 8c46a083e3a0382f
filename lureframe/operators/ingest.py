"""Raw sensor lines to the event log (I1-I7, I10), GeoIP (I5) and web sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.functions import net
from lureframe.functions.bind import bind
from lureframe.functions.ordered import number_runs
from lureframe.schema import conform

# --- fixed values: raw field -> event column, and the fields known to carry no analysis value ---
RENAMES = {
    "protocol": "protocol", "src_ip": "source_ip", "src_port": "source_port", "dst_ip": "destination_ip",
    "dst_port": "destination_port", "session": "session_id", "eventid": "action", "input": "command_line",
    "username": "username", "password": "password", "shasum": "sha256", "url": "file_url", "outfile": "file_name",
    "destfile": "file_path", "path": "url_path", "query": "url_query",
}
NOISE = (
    "message", "sensor", "system", "isError", "src_host", "duration", "duration_ms", "ttylog", "arch",
    "kernel_version", "kernel_build_string", "hassh", "hasshAlgorithms", "version", "macCS", "encCS", "kexAlgs",
    "keyAlgs", "compCS", "langCS", "shasum_hex", "shell", "input_hex", "uuid", "width", "height", "duplicate",
    "name", "value", "size",
)
PORTS = ("src_port", "dst_port")
TEXTS = tuple(c for c in (*RENAMES, "timestamp", "output") if c not in PORTS)
REASON_ACTIONS = ("cowrie.session.file_download.failed", "cowrie.telnet.error")
WEB_GAP_US = 30 * 60 * 1_000_000
# --- end of fixed values ------------------------------------------------------------------------


def event_category(action: Column) -> Column:
    """First matching family wins; no action, no category."""
    has = lambda *words: F.greatest(*[F.contains(action, F.lit(w)).cast("int") for w in words], F.lit(0)) == 1
    return (
        F.when(action.isNull(), None)
        .when(has("session.connect", "session.closed", "client."), "network")
        .when(has("login."), "authentication").when(has("command."), "process")
        .when(has("file_download", "file_upload"), "file").when(action.startswith("web."), "web").otherwise("other")
    )


def event_outcome(action: Column) -> Column:
    """Outcome of a login or a command."""
    category = event_category(action)
    return (
        F.when(category == "authentication", F.when(F.contains(action, F.lit("success")), "success").otherwise("failure"))
        .when(category == "process", F.when(F.contains(action, F.lit("failed")), "failure").otherwise("success"))
    )


def split_target(target: Column) -> tuple[Column, Column]:
    """(path, query) of a request target; an empty path reads as `/`, the fragment is dropped."""
    bare = F.substring_index(target, "#", 1)
    rest = F.regexp_replace(bare, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?]*", "")
    path = F.substring_index(rest, "?", 1)
    query = F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"(?s)\A[^?]*\?", ""))
    return F.when(path == "", "/").otherwise(path), F.when(query != "", query)


_NONE = "array<string>"
_NO_KEYS = lambda: F.array().cast(_NONE)
#: Fields that hold text, a whole number or a flag; fields of any kind; and objects with their own fields.
TEXT, WHOLE, FLAG, ANY = "text", "whole", "flag", "any"
TREE = {
    **dict.fromkeys(TEXTS, TEXT), **dict.fromkeys(PORTS, WHOLE), **dict.fromkeys(NOISE, ANY),
    "http": {"request": {"method": TEXT}, "response": {"status_code": WHOLE}}, "network": {"protocol": TEXT},
    "user_agent": {"original": TEXT}, "honeypot": {"id": TEXT, "name": TEXT}, "labels": {"seeded": FLAG}, "source": {"country": TEXT},
}
#: Raw fields that are handled after the action is looked at.
AFTER_ACTION = ("timestamp", *NOISE)


def _struct(tree: dict) -> str:
    """The declared fields as a type: whole numbers as int, everything else as text."""
    kinds = {TEXT: "string", FLAG: "string", WHOLE: "int"}
    return "struct<" + ",".join(f"{k}:{_struct(v) if isinstance(v, dict) else kinds[v]}" for k, v in tree.items() if v != ANY) + ">"


def _object(value: Column) -> Column:
    """The fields of a JSON object, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _mismatch(kind: str, value: Column) -> Column:
    shape = F.schema_of_variant(value)
    if kind == TEXT:
        return shape.startswith("OBJECT") | shape.startswith("ARRAY")
    if kind == WHOLE:
        return (shape != "VOID") & ((shape == "BOOLEAN") | F.try_variant_get(value, "$", "int").isNull())
    return (shape != "VOID") & ~F.coalesce(F.lower(F.try_variant_get(value, "$", "string")).isin("true", "false"), F.lit(False))


def _walk(tree: dict, fields: Column, path: str = "") -> Column:
    """(unknown, wrong) of one object against the declared tree, at every depth: the paths it doesn't know, and whether a
    known field holds a value that its column cannot: an object for text, text for a number, anything else for an object."""
    extra = F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in tree]))
    unknown = [F.transform(extra, lambda k: F.concat(F.lit(path), k)) if path else extra]
    wrong = F.lit(False)
    for kind in (TEXT, WHOLE, FLAG):
        if names := [k for k, v in tree.items() if v == kind]:
            wrong = wrong | F.exists(F.map_entries(fields), lambda e: e["key"].isin(*names) & _mismatch(kind, e["value"]))
    for name, below in tree.items():
        if isinstance(below, dict):
            child = F.try_element_at(fields, F.lit(name))
            inner = bind(_object(child), lambda m: F.when(m.isNotNull(), _walk(below, m, f"{path}{name}.")))
            nothing = F.struct(_NO_KEYS().alias("unknown"), (child.isNotNull() & (F.schema_of_variant(child) != "VOID")).alias("wrong"))
            seen = F.when(child.isNull(), F.struct(_NO_KEYS().alias("unknown"), F.lit(False).alias("wrong"))).otherwise(F.coalesce(inner, nothing))
            unknown.append(seen)
    children = unknown[1:]
    if not children:
        return F.struct(unknown[0].alias("unknown"), F.coalesce(wrong, F.lit(False)).alias("wrong"))
    return bind(F.array(*children), lambda found: F.struct(
        F.concat(unknown[0], F.flatten(F.transform(found, lambda x: x["unknown"]))).alias("unknown"),
        (F.coalesce(wrong, F.lit(False)) | F.exists(found, lambda x: x["wrong"])).alias("wrong"),
    ))


def _excused(fields: Column) -> Column:
    """Unknown fields that are noise on one event type only; on any other type the same field is a refusal. An error is a
    reason when it is a plain string, never when it is an object."""
    get = lambda name: F.try_element_at(fields, F.lit(name))
    kind = F.try_variant_get(get("eventid"), "$", "string")
    only_on = lambda cond, *names: F.when(cond, F.array(*[F.lit(n) for n in names])).otherwise(_NO_KEYS())
    return F.concat(
        only_on(kind == "cowrie.telnet.option", "command", "option_byte", "option_name"),
        only_on(kind.startswith("cowrie.session.file_download"), "late"),
        only_on(kind.isin(*REASON_ACTIONS) & (F.schema_of_variant(get("error")) == "STRING"), "error"),
    )


def _failed_step(fields: Column) -> Column:
    """(failed, left): whether a step of the take-over fails, and the raw fields that later steps would have handled.

    A protocol can't be taken over where the line already has its target; an action that isn't text has no
    category. The event is of the category `other` then, and every field that is left over is one the schema doesn't know.
    """
    get = lambda name: F.try_element_at(fields, F.lit(name))
    given = F.coalesce(F.schema_of_variant(F.try_variant_get(get("network"), "$.protocol", "variant")) != "VOID", F.lit(False))
    taken = get("protocol").isNotNull() & given
    odd = F.coalesce(~F.schema_of_variant(get("eventid")).isin("STRING", "VOID"), F.lit(False))
    left = lambda *names: F.array_intersect(F.map_keys(fields), F.array(*[F.lit(n) for n in names]))
    rest = (*[c for c in RENAMES if c != "protocol"], *AFTER_ACTION)
    return F.struct((taken | odd).alias("failed"), F.when(taken, left("protocol", *rest)).when(odd, left(*AFTER_ACTION)).otherwise(_NO_KEYS()).alias("left"))


def normalize(raw: DataFrame, cidr: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) from lines of JSON; see `judged_lines`."""
    return split_judged(judged_lines(raw, cidr))


def split_judged(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of judged lines."""
    rejected = lines.filter(F.col("_reason").isNotNull())
    events = lines.filter(F.col("_reason").isNull()).drop("_raw", "_unknown", "_reason")
    return conform(events), rejected.select(F.col("_raw").alias("raw"), F.col("_unknown").alias("unknown_keys"), F.col("_reason").alias("reason"), "honeypot_id")


def judged_lines(raw: DataFrame, cidr: DataFrame | None = None) -> DataFrame:
    """Every line once, with its event's columns and, if it is refused, the reason.

    `raw` holds `raw` and the reader's stamps `honeypot_id`, `honeypot_name`. A line that is no
    JSON, carries an unknown field, an address that is none or a value of the wrong type is
    rejected with its reason and its original; a bad timestamp is not a reason.
    """
    stamped = raw
    for c in ("honeypot_id", "honeypot_name"):
        if c not in raw.columns:
            stamped = stamped.withColumn(c, F.lit(None).cast("string"))

    def judge(line: Column) -> Column:
        return bind(_object(line), lambda m: bind(F.when(m.isNotNull(), _walk(TREE, m)), lambda seen: bind(
            F.when(m.isNotNull(), _failed_step(m)), lambda step: verdict(m, seen, step))))

    def verdict(m: Column, seen: Column, step: Column) -> Column:
        text_of = lambda c: F.try_variant_get(F.try_element_at(m, F.lit(c)), "$", "string")
        bad = lambda c: text_of(c).isNotNull() & ~_address(text_of(c))
        unknown = F.array_sort(F.concat(F.array_except(seen["unknown"], _excused(m)), step["left"]))
        return bind(F.coalesce(unknown, _NO_KEYS()), lambda unknown: F.struct(
            F.when(m.isNull(), "malformed_json").when(F.size(unknown) > 0, "unknown_field")
            .when(bad("src_ip") | bad("dst_ip"), "invalid_address").when(seen["wrong"], "invalid_type").alias("reason"),
            unknown.alias("unknown"), F.coalesce(step["failed"], F.lit(False)).alias("failed"),
        ))

    # One parse serves the walk, the verdict and the columns. The shipper may nest a sensor's line under its own name.
    line = F.try_parse_json("raw")
    nested = F.coalesce(F.try_variant_get(line, "$.cowrie", "variant"), line)
    # A generated column: a filter on it stays above, so each line is judged once.
    judged = stamped.withColumn("_line", F.explode_outer(F.array(nested))).withColumn("_v", F.explode_outer(F.array(judge(F.col("_line")))))
    good = judged.withColumn("_j", F.when(F.col("_v.reason").isNull(), F.try_variant_get("_line", "$", _struct(TREE))))
    j = lambda c: F.col(f"_j.{c}")
    failed = F.col("_v.failed")
    action = F.when(~failed, j("eventid"))
    events = good.select(
        F.sha2(F.concat_ws("\n", F.coalesce("honeypot_id", F.lit("")), "raw"), 256).alias("event_id"),
        F.try_to_timestamp(j("timestamp")).alias("ts"),
        F.coalesce("honeypot_id", j("honeypot.id")).alias("honeypot_id"),
        F.coalesce("honeypot_name", j("honeypot.name")).alias("honeypot_name"),
        F.coalesce(j("network.protocol"), j("protocol"), F.lit("ssh")).alias("protocol"),
        *[j(r).alias(c) for r, c in RENAMES.items() if c != "protocol"],
        F.when(failed & F.col("_v.reason").isNull(), "other").otherwise(event_category(action)).alias("category"), event_outcome(action).alias("outcome"),
        F.when(action.isin(*REASON_ACTIONS), F.try_variant_get("_line", "$.error", "string")).alias("reason"),
        j("output").alias("output"), j("http.request.method").alias("http_method"),
        j("http.response.status_code").alias("http_status"), j("user_agent.original").alias("user_agent"),
        j("source.country").alias("source_country"), F.coalesce(j("labels.seeded").try_cast("boolean"), F.lit(False)).alias("labels_seeded"),
        F.col("raw").alias("_raw"), F.col("_v.unknown").alias("_unknown"), F.col("_v.reason").alias("_reason"),
    )
    if cidr is not None:
        events = geoip_country(events, cidr)
    return events


def _address(x: Column) -> Column:
    return net.is_ipv4(x) | (F.contains(x, F.lit(":")) & net.ipv6_hex(x).isNotNull())


def _hex(ip: Column) -> Column:
    """An address as 8 or 32 hex digits; null for anything else."""
    return F.when(net.is_ipv4(ip), F.lpad(F.lower(F.hex(net.ipv4_long(ip))), 8, "0")).when(F.contains(ip, F.lit(":")), net.ipv6_hex(ip))


def _prefix(digits: Column, bits: Column) -> Column:
    """The first `bits` bits of hex digits; a digit that is cut keeps its upper bits."""
    rest = F.pmod(bits, F.lit(4))
    digit = F.conv(F.substring(digits, F.floor(bits / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    kept = digit - F.pmod(digit, F.pow(F.lit(2), F.lit(4) - rest).cast("int"))
    whole = F.substring(digits, F.lit(1), F.floor(bits / 4).cast("int"))
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lower(F.hex(kept.cast("long")))))


def cidr_prefixes(cidr: DataFrame) -> DataFrame:
    """(digits, bits, prefix, country): each block of (cidr, country) once; of a block with several countries the smallest."""
    parts = cidr.select("country", _hex(F.substring_index("cidr", "/", 1)).alias("_h"), F.substring_index("cidr", "/", -1).try_cast("int").alias("bits"))
    known = parts.filter(F.col("bits").between(0, 4 * F.length("_h")))
    return known.groupBy(F.length("_h").alias("digits"), "bits", _prefix(F.col("_h"), F.col("bits")).alias("prefix")).agg(F.min("country").alias("country"))


def geoip_country(ev: DataFrame, cidr: DataFrame, ip: str = "source_ip", country: str = "source_country") -> DataFrame:
    """Country of each address from a table of blocks; an existing country is kept, the longest prefix wins.

    Each address is looked up once per prefix length that the table has (at most 33 and 129), as an equi-join on
    family, length and prefix: a block is one row however wide it is, and a crowded block meets only its own addresses.
    """
    blocks = cidr_prefixes(cidr)
    lengths = blocks.select(F.struct("digits", "bits").alias("l")).agg(F.collect_set("l")).scalar()
    wanted = ev.filter(F.col(country).isNull() & F.col(ip).isNotNull()).select(ip).distinct().withColumn("_h", _hex(F.col(ip))).filter(F.col("_h").isNotNull())
    tried = wanted.withColumn("_l", F.explode(lengths)).filter(F.col("_l.digits") == F.length("_h"))
    keyed = tried.select(ip, F.col("_l.digits").alias("digits"), F.col("_l.bits").alias("bits"), _prefix(F.col("_h"), F.col("_l.bits")).alias("prefix"))
    located = keyed.join(blocks.withColumnRenamed("country", "_found"), ["digits", "bits", "prefix"]).groupBy(ip).agg(F.max_by("_found", "bits").alias("_country"))
    return ev.join(located, ip, "left").withColumn(country, F.coalesce(country, "_country")).select(*ev.columns)


def web_sessions(requests: DataFrame, gap_us: int = WEB_GAP_US) -> DataFrame:
    """Requests of one address are one session until more than the gap of silence."""
    apart = lambda cur, prev: F.unix_micros(cur["ts"]) - F.unix_micros(prev["ts"]) > gap_us
    runs = number_runs(requests.select("source_ip", "ts", "event_id"), ["source_ip"], "ts", "event_id", ["ts"], apart, out="n")
    return runs.groupBy("source_ip", "n").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("requests")
    ).select(F.col("source_ip").alias("ip"), F.concat_ws("-", "source_ip", F.col("n").cast("string")).alias("session_id"), "start", "end", "requests")
