"""Readers for sensor logs and seed sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureframe.operators.fleet import lit_ts

SEED_DDL = (
    "session string, src_ip string, src_port int, events array<struct<offset:double,eventid:string,dst_port:int,username:string,"
    "password:string,input:string,url:string,outfile:string,shasum:string>>"
)
# A day's log once the sensor has closed it: only these are read as a stream, whole and once.
ROTATED = "*.json.[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"


def _stamp(path: Column, sensors: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(id, name) of the sensor whose folder the file lies in. The sensor list is configuration."""
    hp, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for folder, i, n in sensors:
        inside = F.contains(path, F.lit(f"/{folder.strip('/')}/"))
        hp, name = F.when(inside, i).otherwise(hp), F.when(inside, n).otherwise(name)
    return hp, name


def _lines(df: DataFrame, sensors) -> DataFrame:
    hp, name = _stamp(F.col("_metadata.file_path"), sensors)
    return df.filter(F.col("value") != "").select(F.col("value").alias("raw"), hp.alias("honeypot_id"), name.alias("honeypot_name"))


def read_sensor_logs(spark: SparkSession, path: str | list[str], sensors: list[tuple[str, str, str]]) -> DataFrame:
    """Lines of JSON logs, each stamped with its own sensor: (folder, id, name)."""
    return _lines(spark.read.option("recursiveFileLookup", "true").text(path), sensors)


def stream_sensor_logs(spark: SparkSession, path: str, sensors: list[tuple[str, str, str]], files_per_batch: int = 1000, names: str = ROTATED) -> DataFrame:
    """Closed daily logs as a stream. The checkpoint remembers the files, each read once.

    A file that still grows would be read once, too early, so by default only logs renamed at the end of their day
    are taken; `names` is the glob, and `waiting_logs` counts the files that it leaves for later."""
    reader = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    )
    return _lines(reader.load(path), sensors)


def waiting_logs(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below path that `stream_sensor_logs` doesn't take yet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    closed = F.regexp_extract("path", r"[^/]*$", 0).rlike(r"\.json\.[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return files.filter(~closed).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def seed_corpus(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    """Fixture sessions as timed raw lines; the corpus ends five minutes before `as_of`."""
    rows = spark.read.schema(SEED_DDL).option("multiLine", "true").json(path)
    span = rows.agg(F.max(F.array_max(F.transform("events", lambda e: e["offset"])))).scalar()
    events = rows.select("session", "src_ip", "src_port", F.posexplode("events").alias("_i", "e")).withColumn("_last", span)
    at = F.timestamp_micros(F.unix_micros(lit_ts(as_of)) - 300_000_000 - ((F.col("_last") - F.col("e.offset")) * 1_000_000).cast("long"))
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    raw = F.to_json(F.struct(
        F.col("e.eventid").alias("eventid"), stamp.alias("timestamp"), "session", "src_ip", "src_port", F.col("e.dst_port").alias("dst_port"),
        F.col("e.input").alias("input"), F.col("e.username").alias("username"), F.col("e.password").alias("password"),
        F.col("e.url").alias("url"), F.col("e.outfile").alias("outfile"), F.col("e.shasum").alias("shasum"),
        F.struct(F.lit(True).alias("seeded")).alias("labels"),
    ))
    return events.select(F.format_string("%s-%03d", "session", "_i").alias("seed_id"), raw.alias("raw"))
