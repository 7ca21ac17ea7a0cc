"""Queries that read all rows of their table."""

from prismata.plans import dataset_queries, registry


def test_attention_has_a_result_for_every_token(spark):
    sf = "/root/testdata/sf0.1"
    ids = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    got = registry.QUERIES["j9_image_attention"](spark, sf).select("vec_id")
    assert ids.count() == got.count() > 200 and ids.exceptAll(got).isEmpty()


def test_every_document_is_read_as_a_file_name(spark, sf, monkeypatch):
    monkeypatch.setattr(dataset_queries.M, "edit_pairs", lambda names: names)
    names = registry.QUERIES["j2_edit_pairs"](spark, sf)
    assert names.distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
