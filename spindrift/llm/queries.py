"""The operators over the tables, with the digests that their queries return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import chat, decontam, langid, licenses, ngram_join, secrets, sharding, spm, topk, toxicity
from spindrift.llm.common import remainder, table


def piece_model() -> str:
    """Path of the public SentencePiece model, on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def spans_text(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training_rows())
    scored = toxicity.score_toxicity(docs, index)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = langid.predict_languages(docs, langid.fit(docs, langid.training_rows()))
    return predicted.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chat(chat.row_records(rows.unionByName(extra)), "conv_id", ["turn"]))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("found").alias("labels"), F.least(F.lit(1.0), score).alias("score"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    ids = spm.encode_texts(table(spark, sf_dir, "documents"), model)
    text = spm.decode_ids(ids, model)
    return text.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda ids: ids % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_ngram_join, op3_secrets, op4_toxicity, op5_language, op6_chat, op7_licenses, op8_sharding, op9_sentencepiece, op10_topk)}
