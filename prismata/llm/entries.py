"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, exact_dedup, jaccard, licenses, line_dedup, media, packing, secrets, substring_dedup, token_counts, toxicity, vector_codes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    settings = _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode(documents(spark, sf_dir), *settings, with_decoded=True).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("removed_spans").cast("long").alias("n_removed"),
        F.size(F.filter("removed_spans", lambda s: s["kind"] == "line")).cast("long").alias("n_line_spans"),
        F.expr("aggregate(removed_spans, 0L, (n, s) -> n + s.end - s.start)").alias("removed_chars"),
        F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op4_line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines only: what SQL can express of the same operator."""
    no_parts = 1 << 40
    found = substring_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), min_words=no_parts)
    return found.select(
        "doc_id",
        F.size("removed_spans").cast("long").alias("n_removed"),
        F.expr("aggregate(removed_spans, 0L, (n, s) -> n + s.end - s.start)").alias("removed_chars"),
        F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_probed(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "threshold", "rejected")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = jaccard.jaccard_components(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs)).select("doc_id", "secrets")
    kind = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select(
        "vec_id", F.array_join(F.transform("code", lambda k: F.format_string("%02x", k)), "").alias("code"),
        "error", "label_error", F.lit(vector_codes.digest(book)).alias("codebooks_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("blocks")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_token_counts": op6_token_counts,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_secret_scans": op10_secret_scans,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scans": op13_license_scans,
    "op4_line_spans": op4_line_spans,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op4_line_spans": substring_dedup.LINES_SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_license_scans": licenses.SQL,
}
