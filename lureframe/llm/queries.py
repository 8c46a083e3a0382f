"""The registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureframe.llm import conversations, exact_dedup, html_text, jaccard_join, language_model, mixing, near_dedup, neighbours, packing, pii, quality, spelling, toxicity
from lureframe.llm.sql import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = ORACLE


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_neighbours")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


@query("op2_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op5_near_dedup")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return groups.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


@query("op6_language_model")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_corpus(table(spark, sf_dir, "documents"))


def _of_kind(spans: Column, kind: int) -> Column:
    """How many spans are of the kind. A second parameter of the lambda would be the span's position in the array."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op7_personal_data")
def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_of_kind(base, k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


@query("op8_exact_dedup")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return groups.select("doc_id", "keep_id", F.col("rows").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


@query("op9_quality")
def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op13_conversation_repair")
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.damaged_runs(table(spark, sf_dir, "documents")), shortest=5, rarest=3)


@query("op12_jaccard_join")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)
    return groups.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
