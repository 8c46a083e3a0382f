"""Session reconstruction (D1-D6, D8) and token packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.functions.ordered import modal, number_rows, number_runs, top_per_group
from lureframe.functions.streamed import block_entries
from lureframe.schema import ensure

COMMAND = "cowrie.command.input"
CLOSED = "cowrie.session.closed"
DOWNLOAD = "cowrie.session.file_download"

# --- fixed values: what kind of timeline entry an action is -------------------------------------
KIND_BY_ACTION = {
    "cowrie.session.connect": "connection",
    "cowrie.session.closed": "disconnect",
    "cowrie.login.success": "auth",
    "cowrie.login.failed": "auth",
    "cowrie.command.input": "command",
    "cowrie.command.failed": "execution",
    "cowrie.command.success": "execution",
    "cowrie.session.file_download.failed": "download",
    "cowrie.session.file_download": "download",
    "cowrie.session.file_upload": "file",
    "cowrie.client.version": "protocol",
    "cowrie.client.kex": "protocol",
    "cowrie.client.size": "protocol",
    "cowrie.client.var": "protocol",
    "cowrie.client.fingerprint": "protocol",
    "cowrie.session.params": "protocol",
    "cowrie.log.closed": "protocol",
    "cowrie.telnet.option": "protocol",
    "cowrie.telnet.error": "protocol",
    "cowrie.direct-tcpip.request": "tunnel",
    "cowrie.direct-tcpip.data": "tunnel",
    "web.request": "request",
    "web.login.failed": "auth",
}
# --- end of fixed values ------------------------------------------------------------------------


def _floor_seconds(start: str, end: str) -> Column:
    return F.expr(f"(unix_micros({end}) - unix_micros({start})) div 1000000")


def sessions(ev: DataFrame) -> DataFrame:
    """One row per session. A plain two-phase aggregate: every field is an extremum, a count or
    a flag, so partial rows are combined before the shuffle and a hot session costs no task more."""
    has_user = F.col("username").isNotNull() & (F.col("username") != "")
    has_port = F.col("destination_port").isNotNull() & (F.col("destination_port") != 0)
    first = F.struct(
        "ts", "event_id", "source_ip", "source_port", "honeypot_id", "honeypot_name", "protocol", "source_country"
    )
    grouped = ev.groupBy("session_id").agg(
        F.min(first).alias("_first"),
        F.max("ts").alias("_last"),
        F.count_if(F.col("action") == COMMAND).alias("command_count"),
        F.bool_or(F.col("action") == CLOSED).alias("_closed"),
        F.min(F.when(has_user, F.struct("ts", "event_id", "username"))).alias("_user"),
        F.min(F.when(has_port, F.struct("ts", "event_id", "destination_port"))).alias("_port"),
    )
    return grouped.select(
        "session_id",
        F.col("_first.source_ip").alias("attacker_ip"),
        F.col("_first.source_port").alias("source_port"),
        F.col("_port.destination_port").alias("destination_port"),
        F.col("_first.honeypot_id").alias("honeypot_id"),
        F.col("_first.honeypot_name").alias("honeypot_name"),
        F.col("_first.protocol").alias("protocol"),
        F.col("_first.ts").alias("started_at"),
        F.when(F.col("_closed"), F.col("_last")).alias("ended_at"),
        _floor_seconds("_first.ts", "_last").alias("duration_seconds"),
        "command_count",
        F.col("_first.source_country").alias("country"),
        F.col("_user.username").alias("username"),
    )


def latest_analyses(an: DataFrame, completed_only: bool = False) -> DataFrame:
    """The newest analysis of each session."""
    if completed_only:
        an = an.filter(F.col("status") == "completed")
    return top_per_group(an, ["session_id"], [F.desc("created_at"), F.desc("analysis_id")], 1)


def with_verdicts(ss: DataFrame, an: DataFrame, tm: DataFrame) -> DataFrame:
    """Overlay the latest analysis; without one a session stays `not_analyzed`, 0, informational.

    A mapping list is bounded by the catalog, so it may be gathered per analysis.
    """
    latest = latest_analyses(an).select("session_id", "analysis_id", "risk", "risk_score")
    # A technique is mapped once per analysis: the lists stay as short as the catalog.
    ordered = (
        tm.groupBy("analysis_id", "technique_id", "tactic")
        .agg(F.min(F.struct("ts", "mapping_id")).alias("_o"))
        .groupBy("analysis_id")
        .agg(F.array_sort(F.collect_list(F.struct("_o", "technique_id", "tactic"))).alias("_t"))
    )
    verdicts = latest.join(ordered, "analysis_id", "left").select(
        "session_id",
        F.col("risk").alias("_risk"),
        F.col("risk_score").alias("_score"),
        F.coalesce(F.col("_t.technique_id"), F.array().cast("array<string>")).alias("_ids"),
        F.array_distinct(F.coalesce(F.col("_t.tactic"), F.array().cast("array<string>"))).alias("_tactics"),
    )
    none = F.array().cast("array<string>")
    return ss.join(verdicts, "session_id", "left").select(
        *ss.columns,
        F.coalesce("_risk", F.lit("informational")).alias("risk"),
        F.coalesce("_score", F.lit(0)).alias("risk_score"),
        F.coalesce("_ids", none).alias("mitre_technique_ids"),
        F.coalesce("_tactics", none).alias("classification_chain"),
        F.when(F.col("_risk").isNotNull(), "completed").otherwise("not_analyzed").alias("analysis_state"),
    )


def session_sensors(ev: DataFrame) -> DataFrame:
    """D3: the sensor that recorded most of a session."""
    return modal(ev, ["session_id"], "honeypot_id", "honeypot_id")


def event_kind(action: Column) -> Column:
    """D4."""
    pairs = [F.lit(x) for kv in KIND_BY_ACTION.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), action), F.lit("other"))


def timeline(ev: DataFrame) -> DataFrame:
    """A labelled entry per event. A projection only; readers sort what they show."""
    c = F.col
    kind, action = c("kind"), c("action")
    full = lambda x: c(x).isNotNull() & (c(x) != "")
    where = F.coalesce(c("file_url"), c("file_path"))
    has_url = full("file_url")
    request = F.concat(
        F.coalesce(c("http_method"), F.lit("?")), F.lit(" "), F.coalesce(c("url_path"), F.lit("None")),
        F.when(full("url_query"), F.concat(F.lit("?"), c("url_query"))).otherwise(""),
    )
    label = (
        F.when(kind.isin("command", "execution") & full("command_line"), c("command_line"))
        .when(kind == "auth", F.when(action.endswith("success"), "Login succeeded").otherwise("Login failed"))
        .when((kind == "request") & (c("url_path").isNotNull() | c("url_query").isNotNull()), request)
        .when(
            (kind == "download") & (has_url | full("file_path")),
            F.when(action.endswith(".failed"), F.concat(F.lit("Download failed: "), where))
            .when(has_url & full("file_path"), F.concat(F.lit("Download "), c("file_url"), F.lit(" to "), c("file_path")))
            .when(has_url, F.concat(F.lit("Download "), c("file_url")))
            .otherwise(F.concat(F.lit("File written to "), c("file_path"))),
        )
        .when(kind == "connection", F.concat(F.lit("Connection from "), c("source_ip")))
        .when(kind == "disconnect", "Session closed")
        .otherwise(action)
    )
    detail = (
        F.when((kind == "command") | (c("label") == action), None)
        .when((kind == "request") & c("http_status").isNotNull(), F.concat(F.lit("HTTP "), c("http_status").cast("string")))
        .otherwise(action)
    )
    ev = ensure(ev, "file_path", "file_url", "url_path", "url_query", "http_method", "http_status", "mitre_technique_id", "risk_level")
    return (
        ev.withColumn("kind", event_kind(action))
        .withColumn("label", label)
        .select(
            "session_id", "event_id", "ts", "kind", "label",
            detail.alias("detail"),
            F.coalesce("risk_level", F.lit("informational")).alias("severity"),
            F.col("mitre_technique_id").alias("technique_id"),
        )
    )


def compact(ev: DataFrame) -> DataFrame:
    """Consecutive identical commands of a session as one row with its first event and an excerpt of that event's output.

    Runs are numbered by `number_runs`, so a session of any length is split over tasks; runs are
    then combined map-side. Outputs are cut to their excerpt before anything moves.
    """
    commands = ensure(ev, "output").filter(
        (F.col("action") == COMMAND) & F.col("command_line").isNotNull() & (F.col("command_line") != "")
    ).select("session_id", "event_id", "ts", "command_line", text.truncate_output("output").alias("output_excerpt"))
    runs = number_runs(
        commands, ["session_id"], "ts", "event_id", ["command_line"],
        lambda cur, prev: cur["command_line"] != prev["command_line"],
    )
    return (
        runs.groupBy("session_id", "run", "command_line")
        .agg(F.count(F.lit(1)).alias("repeat_count"), F.min(F.struct("ts", "event_id", "output_excerpt")).alias("_f"))
        .select(
            "session_id", F.col("_f.event_id").alias("event_id"), F.col("_f.ts").alias("ts"),
            F.col("command_line").alias("command"), "repeat_count", F.col("_f.output_excerpt").alias("output_excerpt"),
        )
    )


def downloads(ev: DataFrame) -> DataFrame:
    """The download rows of a session, each still citable by its event."""
    ev = ensure(ev, "file_url", "file_name", "sha256")
    return ev.filter(F.col("action") == DOWNLOAD).select(
        "session_id", "event_id", "ts", F.col("file_url").alias("url"), F.col("file_name").alias("outfile"), F.col("sha256").alias("shasum")
    )


def compact_summary(ev: DataFrame) -> DataFrame:
    """The per-session facts beside the compacted commands."""
    has_user = F.col("username").isNotNull() & (F.col("username") != "")
    return (
        ev.groupBy("session_id")
        .agg(
            F.min(F.struct("ts", "event_id", "source_ip")).alias("_f"),
            F.max("ts").alias("_last"),
            F.count_if(F.col("action") == "cowrie.login.failed").alias("failed_logins"),
            F.bool_or(F.col("action") == "cowrie.login.success").alias("successful_login"),
            F.min(F.when(has_user, F.struct("ts", "event_id", "username"))).alias("_u"),
            F.count_if(F.col("action") == DOWNLOAD).alias("downloads"),
        )
        .select(
            "session_id",
            F.col("_f.source_ip").alias("attacker_ip"),
            F.col("_f.ts").alias("started_at"),
            _floor_seconds("_f.ts", "_last").alias("duration_seconds"),
            "failed_logins", "successful_login",
            F.col("_u.username").alias("username"),
            "downloads",
            F.col("_f.event_id").alias("first_event_id"),
        )
    )


# Commands of one session that one row may hold.
BLOCK_ROWS = 4096


def pack_chunks(
    compacted: DataFrame, heads: DataFrame, budget: int = text.TOKEN_BUDGET, rows_per_block: int = BLOCK_ROWS
) -> DataFrame:
    """Greedy in-order packing of a session's commands into chunks under a token budget.

    A chunk costs its fixed header and footer plus one rendered entry per command; a command that
    alone exceeds the budget is cut in the middle first. `heads` is `compact_summary`. Sessions are cut into
    blocks of `rows_per_block` commands. What a block does depends only on how full the open chunk is when
    it begins, so each block is summed up by a small table, a fold over tables tells how each block
    begins, and all blocks pack at the same time.
    """
    limit = budget * text.CHARS_PER_TOKEN
    size = lambda *parts: sum((F.length(p) for p in parts), F.lit(0))
    flag = F.initcap(F.col("successful_login").cast("string"))
    frame = heads.select(
        "session_id",
        (
            F.lit(len(text.BLOCK_BEGIN) + len(text.BLOCK_END) + len("\nsession_id: \nattacker_ip: \nfailed_logins: \nsuccessful_login: \ncommands:\n"))
            + size(text.fence_safe("session_id"), text.fence_safe("attacker_ip"), F.col("failed_logins").cast("string"), flag)
        ).alias("_frame"),
    )
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    repeated = F.when(F.col("repeat_count") > 1, F.length(F.concat(F.lit(" (repeated "), F.col("repeat_count").cast("string"), F.lit("x)")))).otherwise(0)
    output = F.coalesce(F.length(F.lit("    output: \n")) + F.length(text.fence_safe("output_excerpt")), F.lit(0)) if "output_excerpt" in compacted.columns else F.lit(0)
    entry = lambda command: (
        F.lit(len("  - event_id: \n    timestamp: \n    command: \n"))
        + size(F.col("event_id").cast("string"), stamp, text.fence_safe(command)) + repeated + output
    )
    whole = entry(F.col("command"))
    cost = F.when(F.col("_frame") + whole > limit, entry(text.truncate_middle("command", limit // 2))).otherwise(whole)
    placed = (
        number_rows(compacted, ["session_id"], "ts", "event_id")
        .join(frame, "session_id").withColumn("_cost", cost)
    )
    placed = placed.select("session_id", "event_id", "pos", F.col("_frame").cast("long").alias("frame"), F.col("_cost").cast("long").alias("cost"))
    items = F.array_sort(F.collect_list(F.struct("pos", "event_id", "cost"))).alias("_items")
    blocks = placed.groupBy("session_id", F.expr(f"pos div {rows_per_block}").alias("block")).agg(F.first("frame").alias("_frame"), items)
    # Only sessions of several blocks have to be told how theirs begin.
    several = placed.filter(F.col("pos") == rows_per_block).select("session_id").distinct()
    costs = blocks.join(several, "session_id", "left_semi").select("session_id", "block", F.transform("_items", lambda i: i["cost"]).alias("costs"), (F.lit(limit) - F.col("_frame")).alias("room"))
    entered = blocks.join(block_entries(costs), ["session_id", "block"], "left")
    # The fold keeps only where each further chunk starts; a chunk holds many commands, so that
    # list is short and is copied only when it grows.
    zero = F.struct(F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc, item):
        full = (acc["used"] > 0) & (acc["used"] + item["cost"] + F.col("_frame") > limit)
        return F.struct(
            F.when(full, item["cost"]).otherwise(acc["used"] + item["cost"]).alias("used"),
            F.when(full, F.concat(acc["starts"], F.array(item["pos"]))).otherwise(acc["starts"]).alias("starts"),
        )

    folded = entered.withColumn("_starts", F.aggregate("_items", zero, step, lambda acc: acc["starts"]))
    rows = folded.select("session_id", F.coalesce("chunk", F.lit(0)).alias("_chunk"), "_starts", F.explode("_items").alias("_i"))
    inside = F.size(F.filter("_starts", lambda at: at <= F.col("_i.pos")))
    return rows.select(
        "session_id", (F.col("_chunk") + inside).cast("long").alias("chunk_no"), F.col("_i.event_id").alias("event_id"), F.col("_i.pos").alias("pos"), F.col("_i.cost").alias("chars"),
    )


def session_replay(ev: DataFrame, frames: DataFrame, slack_seconds: float = 5.0, sensors: DataFrame | None = None) -> DataFrame:
    """The frames of the recordings a session's close events name, re-zeroed per session.

    `frames` is S7's output. One row per frame, or one status row for a session without frames.
    """
    spans = ev.groupBy("session_id").agg(F.min("ts").alias("_start"), F.max("ts").alias("_end"), F.min("honeypot_id").alias("_hp"))
    named = (
        ev.filter((F.col("action") == "cowrie.log.closed") & F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"))
        .select("session_id", "sha256").distinct()
    )
    opened = frames.groupBy("sha256").agg(F.min("opened").alias("_opened"), F.bool_or("truncated").alias("_trunc"))
    secs = lambda c: F.unix_micros(c) / 1e6
    linked = named.join(spans, "session_id").join(opened, "sha256", "left")
    outside = ~F.col("_opened").between(secs("_start") - slack_seconds, secs("_end") + slack_seconds)
    per_session = linked.groupBy("session_id").agg(
        F.min("_opened").alias("_zero"),
        F.coalesce(F.bool_or(outside), F.lit(False)).alias("shared"),
        F.coalesce(F.bool_or("_trunc"), F.lit(False)).alias("truncated"),
        F.bool_or(F.col("_trunc").isNotNull()).alias("_found"),
    )
    played = named.join(frames.filter(F.col("t").isNotNull()).select("sha256", "t", "data"), "sha256")
    earliest = played.groupBy("session_id").agg(F.min("t").alias("_first"))
    heads = (
        spans.select("session_id", "_hp").join(per_session, "session_id", "left").join(earliest, "session_id", "left")
        .withColumn("_base", F.coalesce("_zero", "_first"))
    )
    configured = F.lit(True)
    if sensors is not None:
        heads = heads.join(sensors.select(F.col("honeypot_id").alias("_hp"), F.lit(True).alias("_conf")), "_hp", "left")
        configured = F.col("_conf").isNotNull()
    status = (
        F.when(~configured, "not_configured").when(F.col("_found").isNull(), "no_recording")
        .when(F.col("_base").isNull(), "missing").otherwise("ok")
    )
    heads = heads.withColumn("status", status)
    return heads.join(played.select("session_id", "t", "data"), "session_id", "left").select(
        "session_id", "status",
        F.when(F.col("status") == "ok", F.bround(F.greatest(F.lit(0.0), F.col("t") - F.col("_base")), 3)).alias("t"),
        F.when(F.col("status") == "ok", F.col("data")).alias("data"),
        F.coalesce("shared", F.lit(False)).alias("shared"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
