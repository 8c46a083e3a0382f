"""Sinks (K1-K7)."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.schema import conform

# --- fixed values: exported header and the event column behind each ---
CSV_COLUMNS = {
    "timestamp": "ts", "honeypot_id": "honeypot_id", "session_id": "session_id", "source_ip": "source_ip", "event_action": "action",
    "event_category": "category", "protocol": "protocol", "username": "username", "command": "command_line",
    "risk_level": "risk_level", "risk_score": "risk_score", "technique_id": "mitre_technique_id",
}
# --- end of fixed values ---


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """K1: Parquet by day and sensor. The rebalance splits a busy sensor's day over many tasks and
    merges the small ones, so no key decides the size of a task or a file."""
    rows = conform(events).withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date", "honeypot_id")
    rows.write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy("event_date", "honeypot_id").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """K1 read back; a filter on `event_date` or `honeypot_id` prunes partitions."""
    return spark.read.parquet(path)


def write_dead_letters(rejected: DataFrame, path: str) -> None:
    """K2: rejected lines with reason and original."""
    rejected.write.mode("append").partitionBy("reason").parquet(path)


def dead_letter_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def csv_lines(events: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """K3: RFC 4180 lines. Text is guarded against formulas, numbers are not; a field with a quote,
    comma or line break is quoted."""
    kinds = dict(events.dtypes)

    def field(c: str):
        if kinds[c] == "timestamp":
            x = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        else:
            x = text.csv_safe(c) if kinds[c] == "string" else F.col(c).cast("string")
        x = F.coalesce(x, F.lit(""))
        return F.when(x.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return events.select(F.concat_ws(",", *[field(c) for c in (columns or CSV_COLUMNS).values()]).alias("line"))


def export_csv(events: DataFrame, path: str, columns: dict[str, str] | None = None) -> None:
    """K3: CSV part files with CRLF line ends and a header in each."""
    header = ",".join(columns or CSV_COLUMNS)

    def with_header(batches):
        first = True
        for batch in batches:
            yield pd.DataFrame({"value": ([header] if first else []) + batch["line"].tolist()})
            first = False

    lines = csv_lines(events, columns).mapInPandas(with_header, "value string")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_reports(reports: DataFrame, path: str, created: datetime) -> None:
    """K4: immutable JSON report rows, append-only."""
    reports.withColumn("created_at", F.lit(created.isoformat(sep=" ")).cast("timestamp")).write.mode("append").parquet(path)


def write_json_lines(rows: DataFrame, path: str, column: str = "json") -> None:
    """K5/K6: one object per line."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_blocklist(lines: DataFrame, path: str) -> None:
    """K7: sorted addresses; the sort is range-partitioned, so the part files are in order."""
    lines.select(F.col("line").alias("value")).orderBy("value").write.mode("overwrite").text(path)
