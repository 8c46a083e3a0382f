"""Session settings and relations written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-checked choices only: joins are broadcast when AQE has *measured* a small side, skewed
# shuffle partitions are split, and partition counts follow the data.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "lureframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; the cluster's own settings are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="lureframe-")
    return _local_folders[context.applicationId]


def write_once(df: DataFrame) -> DataFrame:
    """A relation that several later plans read: written to the shared folder and read back.

    It survives lost executors, its lineage is cut, and readers still prune columns and push filters.
    """
    path = f"{shared_folder(df.sparkSession)}/lureframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a relation written once that no later plan reads."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles() if "/lureframe-" in name}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
