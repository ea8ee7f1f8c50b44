"""A corpus pipeline: toxic documents go, near-duplicates and contaminated ones go, secrets are blanked, and what is left is encoded.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results, for every stage: other columns of docs are dropped, so clashing names cannot
matter; an empty table gives an empty table; texts of any length count whole; null and empty
texts stay documents (they score as the share of toxic labels, are near nothing, hold no test
item and no secret, and are encoded as the end id alone); rows without an id stay unless their
text is toxic or holds a test item; ties of a group go to the smallest id; repeated rows (one id
and text) are one document after the near-duplicate stage, and rows of one id with unlike texts
are told apart by their texts only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontam, ngram_join, secrets, spm, toxicity
from spindrift.llm.common import durable, ensure_checkpoint_dir, few_pages, table
from spindrift.llm.queries import piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half; the index is learned from all labelled documents of the training part."""
    index = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.with_scores(docs.select(*COLUMNS), index).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id, once; documents without words all stay."""
    docs = docs.select(*COLUMNS)
    with few_pages(spark):
        found = durable(ngram_join.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null"))
        copies = found.where("component_id <> doc_id").select("doc_id").distinct()
        kept = ngram_join.rows_without(docs, copies)
        again = durable(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    return ngram_join.rows_without(kept, again).unionByName(kept.join(again, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.without_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    clean = secrets.redact_texts(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    ids = spm.encode_texts(docs, piece_model())
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("sentencepiece", encoded),
]

#: The learned scores and the vocabulary are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
