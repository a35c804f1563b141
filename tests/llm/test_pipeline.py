import corpus_pipeline
import pytest


@pytest.fixture
def folder(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages_keep_the_columns_and_run_is_their_sequence(spark, docs, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, rows, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == docs.columns
            made.write.parquet(f"{folder}/stage{k}")
            rows = spark.read.parquet(f"{folder}/stage{k}")
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(str, made.select("doc_id", "start", "length", "ids_crc32").collect())
    )


def test_stages_take_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
