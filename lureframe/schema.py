"""Event log schema. Flat columns keep Parquet statistics and pruning available to every filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_DDL = """
event_id string, ts timestamp, session_id string, honeypot_id string, honeypot_name string,
source_ip string, source_port int, source_country string, destination_ip string, destination_port int,
protocol string, action string, category string, outcome string, reason string,
username string, password string, command_line string, output string,
file_url string, file_name string, file_path string, sha256 string,
url_path string, url_query string, http_method string, http_status int, user_agent string,
labels_seeded boolean, risk_score int, risk_level string,
mitre_technique_id string, mitre_tactic string, ai_classification string
"""
EVENT_COLUMNS = [c.split()[0] for c in EVENT_DDL.replace("\n", " ").split(",") if c.strip()]
_TYPES = dict((c.split()[0], c.split()[1]) for c in EVENT_DDL.replace("\n", " ").split(",") if c.strip())


def conform(df: DataFrame) -> DataFrame:
    """Every event column, in order; absent ones are null. Extra columns are dropped."""
    have = set(df.columns)
    cols = [
        F.col(c) if c in have else F.lit(None).cast(_TYPES[c]).alias(c)
        for c in EVENT_COLUMNS
    ]
    return df.select(*cols)


def ensure(df: DataFrame, *columns: str) -> DataFrame:
    """The frame with any of these event columns it lacks added as null."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(_TYPES[c]))
    return df
