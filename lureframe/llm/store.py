"""Relations that later jobs read again, kept in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lureframe.session import shared_folder


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the folder in spark.checkpoint.dir and read it back.

    Lineage ends at the files, so a lost executor costs only its running tasks. The schema is that of df; an
    empty df gives an empty relation. The caller may `discard` the relation once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, dict]:
    """save(df, label), and aggregates over its rows taken while they are written."""
    seen = Observation()
    saved = save(df.observe(seen, *measures), label)
    return saved, seen.get


def discard(*frames: DataFrame) -> None:
    """Delete the files of saved relations that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if "/llm-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


#: Stands for a null id inside tasks, where a null would turn a column of long into one of double.
NO_ID = -(2**63)


def sent_id(column: str, none: int = NO_ID) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(none)).alias(column)


def back_id(df: DataFrame, column: str, none: int = NO_ID) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(none)))


def split_count(rows: int, rows_each: int, least: int = 1) -> int:
    """A power of two of parts so that each holds about rows_each rows; grows with the data."""
    parts = least
    while parts * rows_each < rows:
        parts *= 2
    return parts

