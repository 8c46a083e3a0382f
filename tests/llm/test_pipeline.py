import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the provided tables")


@needs
def test_stages_keep_the_columns_and_narrow_the_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= ids, name
        ids = {r["doc_id"] for r in rows}
        sizes.append((name, len(ids)))
        if name != "packing":
            assert out.columns == columns, name
            docs = spark.createDataFrame(rows, out.schema)
    assert [n for n, _ in sizes] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert sizes[0][1] >= sizes[1][1] >= sizes[2][1] >= sizes[3][1] == sizes[4][1] > 0


@needs
def test_exact_dedup_agrees_with_sql(spark):
    name = "op8_exact_dedup"
    assert compare(spark, duck(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok")


@needs
def test_pipeline_and_queries_are_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
