"""Deployment and change history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE_KINDS = ("rate-limit", "note")
DEPLOYMENT_DDL = "deployment_id string, honeypot_id string, persona string, digest string, deployed_by string, deployed_at timestamp"
CHANGE_DDL = "change_id string, honeypot_id string, at timestamp, kind string, detail string, recorded_by string"


def read_history(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """`deployments` in (time, id) order or `changes` in theirs."""
    ddl, order = (DEPLOYMENT_DDL, ["deployed_at", "deployment_id"]) if kind == "deployments" else (CHANGE_DDL, ["at", "change_id"])
    return spark.read.schema(ddl).parquet(path).orderBy(*order)


def deployment_rows(spark: SparkSession, honeypot_ids: list[str], persona: str, digest: str, deployed_by: str, at) -> DataFrame:
    """K8: one row per sensor of a deploy, written together."""
    if at.tzinfo is None:
        raise ValueError("a deployment time needs a timezone")
    rows = [(f"{at.isoformat()}:{h}", h, persona, digest, deployed_by, at) for h in honeypot_ids]
    return spark.createDataFrame(rows, DEPLOYMENT_DDL)


def append_deployments(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(path)


def append_changes(rows: DataFrame, path: str) -> DataFrame:
    """K8: append the valid changes; returns the refused ones with their reason."""
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*CHANGE_KINDS), F.lit(False)), "unknown_kind").when(F.col("at").isNull(), "no_time")
        .when(F.col("honeypot_id").isNull(), "no_sensor")
    )
    judged = rows.withColumn("reason", reason)
    judged.filter("reason IS NULL").drop("reason").write.mode("append").parquet(path)
    return judged.filter("reason IS NOT NULL")
