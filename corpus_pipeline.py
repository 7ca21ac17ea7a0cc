"""The corpus pipeline: five stages over ``documents``, each an operator of ``prismata.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes
each stage's result as Parquet in the shared folder and rereads it as the next
stage's documents. All stages but the last return the columns of ``documents``,
and no others: further columns of ``docs``, whatever their names, are left out.
Nulls in any column, empty, blank and very long texts, with or without blanks,
ties, repeated rows and empty tables are handled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.llm import jaccard, line_dedup, packing, secrets, toxicity
from prismata.llm.storage import materialize

#: Columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by its own text and language, so repeated rows go or stay
    alike. Null and empty texts have a score too, that of no words; a null
    language has the threshold 0.5. Without labels nothing is rejected; with
    labels of one class only, every text has the score of that class.
    """
    docs = docs.select(COLUMNS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("not rejected").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents that lose all their lines this way go too.

    Documents that were empty before stay.
    """
    found = line_dedup.dedup_lines(docs.select(COLUMNS))
    return _counted(found.where("n_dropped < n_lines"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the smallest id stays; a row without an id stays.

    Rows that share an id are one document and stay or go together. Null, empty
    and blank texts link with nothing and stay.
    """
    docs = docs.select(COLUMNS)
    found, _ = jaccard.jaccard_components(docs, width=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay, rows without an id or text too."""
    docs = docs.select(COLUMNS)
    return _counted(secrets.scan(docs, secrets.train(docs), mark="[SECRET]"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place.

    Null and empty texts are one piece of the end token alone; each of several
    repeated rows has pieces of its own, as have rows without an id.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the random field and the packing search are beyond SQL; the tests hold each
#: stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
