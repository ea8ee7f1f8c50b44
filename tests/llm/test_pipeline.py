"""The pipeline and its toxicity stage against plain versions that share no code with them."""

from __future__ import annotations

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import toxicity
from spindrift.llm.queries import QUERIES, piece_model
from tests.llm import brute


def test_toxicity_against_all_pairs(spark, sf):
    """Every score of the query, by all cosines, plain votes and a plain calibration."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    expected = brute.toxicity(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    assert got.keys() == expected.keys() and max(abs(got[d] - expected[d]) for d in got) < 1e-5


def test_pipeline(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    scores = brute.toxicity(rows, labels)
    kept = {d: t for d, t in rows.items() if scores[d] < 0.5}
    groups = brute.near_duplicates(list(kept.items()))
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {d: t for d, t in kept.items() if not brute.holds_item(t, items)}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    expected = {d: library.encode(brute.without_spans(t), add_eos=True) for d, t in kept.items()}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == expected and len(got) < len(rows)


def test_stages_with_odd_rows(spark, sf):
    """Nulls in any column, empty and long texts, repeats, clashing columns; and no rows at all."""
    said = " ".join(f"word{i}" for i in range(60))
    texts = [(1, said), (1, said), (2, said + " more"), (None, said), (None, None), (3, None), (4, ""), (5, "x" * 30_000), (6, "token = abcdefgh12345 " + " ".join(f"other{i}" for i in range(40))), (7, None), (7, None)]
    table = spark.createDataFrame([(d, t, None, None, None, 1.0, "c") for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert name == "sentencepiece" or docs.columns == corpus_pipeline.COLUMNS
        assert stage(spark, before.where("false"), sf).count() == 0
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in docs.collect())
    # of rows 1, 1, 2 and the one without an id the smallest id stays once; rows without an id are never told to go
    assert [d for d, _ in left] == [-1, -1, 1, 3, 4, 5, 6, 7]
    assert {d: n for d, n in left}[3] == {d: n for d, n in left}[4] == 1


def test_stage_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "unlike text of one id"), (2, "g h i j k l")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert left == [(1, "a b c d e f"), (1, "unlike text of one id"), (2, "g h i j k l")]


def test_toxicity_without_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    index = toxicity.fit(docs, none, toxicity.training_rows())
    assert toxicity.score_toxicity(docs, index).agg(F.max("score")).first()[0] == 0


def test_queries_have_their_columns(spark, sf):
    expected = {
        "op2_ngram_join": ["doc_id", "n_shingles", "component_id"],
        "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op10_topk": ["query_id", "rank", "vec_id", "score"],
    }
    for name, columns in expected.items():
        assert QUERIES[name](spark, sf).columns[: len(columns)] == columns


def test_one_of_each_group_takes_few_pages(spark, monkeypatch):
    """The whole stage asks for few pages of memory, and the session's settings come back."""
    name, seen = "spark.sql.codegen.aggregate.map.twolevel.enabled", []
    before = spark.conf.get(name, None)
    plain = corpus_pipeline.ngram_join.rows_without
    monkeypatch.setattr(corpus_pipeline.ngram_join, "near_duplicates", lambda docs: docs.select("doc_id", F.lit(1).alias("n_shingles"), F.least("doc_id", F.lit(1)).alias("component_id")))
    monkeypatch.setattr(corpus_pipeline.ngram_join, "rows_without", lambda *a: seen.append(spark.conf.get(name)) or plain(*a))
    docs = spark.createDataFrame([(i, "a", "en", "s", 1) for i in (1, 2, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()] == [1]
    assert seen == ["false"] and spark.conf.get(name, None) == before
