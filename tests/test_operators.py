"""Operators on small tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spindrift.operators import budget, corpus, merge, passages, ranking, rerank


def tokens_of(text: str) -> list[str]:
    return list(dict.fromkeys(text.lower().split()))


def plain_scores(texts: list[str], query: str) -> list[tuple[float, float]]:
    docs, q = [tokens_of(t) for t in texts], tokens_of(query)
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in q}
    out = []
    for d in docs:
        bm = sum(max(0.25, math.log((n + 1) / (df[t] + 0.5))) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in q if t in d)
        sq = {t: (math.log((1 + n) / (1 + df[t])) + 1) ** 2 for t in q}
        out.append((bm, math.sqrt(sum(sq[t] for t in q if t in d) / sum(sq.values()))))
    return out


def test_rank_batches(spark):
    texts = ["a b c", "b c d e", "x y", "a a a", ""]
    table = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "q")], "batch int, item int, text string")
    queries = spark.createDataFrame([(1, "a b zz")], "batch int, query string")
    got = {(r.batch, r.item): r for r in ranking.rank_batches(table, queries, ["batch"], "item").collect()}
    for i, (bm, tf) in enumerate(plain_scores(texts, "a b zz")):
        assert abs(got[1, i].bm25 - bm) < 1e-9 and abs(got[1, i].tfidf - tf) < 1e-9
    assert got[2, 0].score == 0


def test_search_agrees_with_batches(spark):
    texts = [f"w{i % 7} w{i % 5} w{i % 3} common" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    queries = spark.createDataFrame([(0, "w1 w2"), (1, "w6 common")], "query_id int, query string")
    got = {(r.query_id, r.doc_id): round(r.score, 9) for r in ranking.search_corpus(docs, queries, 100).collect()}
    batches = docs.crossJoin(queries.select("query_id"))
    full = {(r.query_id, r.doc_id): round(r.score, 9) for r in ranking.rank_batches(batches, queries, ["query_id"], "doc_id").collect()}
    assert got and all(abs(full[k] - v) < 1e-8 for k, v in got.items())


def test_first_of_is_deterministic(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(map(tuple, merge.first_of(df, ["k"], ["o"]).collect())) == [("a", 1, "y"), ("b", 3, "z")]


def test_query_dedupe(spark):
    jobs = spark.createDataFrame([(0, "Foo bar", "primary"), (1, "foo  BAR", "llm"), (2, "bar foo", "llm"), (3, "baz", "llm"), (4, "qux", "llm"), (5, "!!", "llm"), (6, "??", "llm")], "job_index long, query string, source string")
    assert [r.job_index for r in merge.dedupe_queries(jobs, 3).orderBy("job_index").collect()] == [0, 3, 4, 5]


def test_passages(spark):
    md = "# Title\n\nThis is the first long sentence here. Short one.\nThis is the first long sentence here.\n```\ncode line that is never a passage at all\n```\n| a | b |\n## Next\n- another item that has many words in it"
    got = passages.passages(spark.createDataFrame([(1, md)], "k int, markdown string"), "k").orderBy("order").collect()
    assert [(r.heading, r.text) for r in got] == [("Title", "This is the first long sentence here."), ("Title", "a | b"), ("Next", "another item that has many words in it")]


def test_budget_prefix(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((3, 4, 9, 1))], "k int, o int, t string")
    assert [r.o for r in passages.within_budget(df, ["k"], [F.col("o")], "t", 10).collect()] == [0, 1]


def test_allocate(spark):
    cards = spark.createDataFrame([("a", 3, 0), ("b", 1, 1), ("c", 0, 2)], "question_id string, priority int, order int")
    got = {r.question_id: r.allocation for r in budget.allocate(cards, 10, 1).collect()}
    assert got == {"a": 6, "b": 3, "c": 1} and sum(got.values()) == 10
    assert all(r.allocation == 0 for r in budget.allocate(cards, 0, 1).collect())


def test_page_slots(spark):
    pages = spark.createDataFrame([(c, s) for c in range(3) for s in range(4)], "candidate int, sub int")
    chosen = {(r.candidate, r["sub"]) for r in budget.page_slots(pages, 5).where("selected").collect()}
    assert chosen == {(0, 0), (1, 0), (2, 0), (0, 1), (1, 1)}


def test_prompt_texts(spark):
    rows = [(0, 1, ["aaaa", "AAAA", "bbbbbbbbbbbbbbbb"]), (0, 2, ["cc", "dddd"]), (1, 1, ["x" * 30]), (1, 2, ["y"])]
    got = budget.prompt_texts(spark.createDataFrame(rows, "question int, source int, abstracts array<string>"), 10, ["question"]).orderBy("question", "at").collect()
    assert [(r.question, r.source, r.text) for r in got] == [(0, 1, "aaaa"), (0, 2, "cc"), (0, 2, "dddd"), (1, 1, "x" * 10)]


def test_new_and_old(spark):
    df = spark.createDataFrame([(i, 2 if i % 2 else 1) for i in range(10)], "rank int, round_index int")
    got = [r.rank for r in budget.new_and_old(df, 2, 4, 0.75, 2).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3]


def test_corpus_merge(spark):
    schema = "source_id long, canonical_url string, title string"
    target = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (3, "a", "")], schema)
    found = spark.createDataFrame([(1, "b", "B"), (2, "c", "C"), (3, "c", "C2"), (4, "d", "D")], schema)
    fresh, remap = corpus.merge_corpus(target, found, 4)
    assert sorted((r.source_id, r.title) for r in fresh.collect()) == [(4, "C"), (5, "D")]
    assert {r.source_id: r.corpus_id for r in remap.collect()} == {1: 2, 2: 4, 3: 4, 4: 5}


def test_decide(spark):
    names = "search_left int, fetch_left int, n_queries int, n_links int, rounds_done int, least_rounds int, gain double, confidence double, coverage double, uncertainty double, conflicts int, objectives int, wants_more boolean"
    rows = [(1, 0, 1, 0, 3, 1, 0.9, 0.9, 0.9, 0.1, 0, 0, True), (0, 1, 1, 0, 3, 1, 0.9, 0.9, 0.9, 0.1, 0, 0, True), (1, 1, 1, 0, 3, 1, 0.1, 0.9, 0.9, 0.1, 0, 0, True), (1, 1, 1, 0, 3, 1, 0.5, 0.1, 0.9, 0.1, 0, 0, False), (1, 1, 0, 0, 3, 1, 0.9, 0.9, 0.9, 0.1, 0, 1, True), (1, 1, 1, 0, 1, 1, 0.1, 0.9, 0.9, 0.1, 0, 0, False)]
    got = [r.stop_reason for r in corpus.decide(spark.createDataFrame(rows, names)).collect()]
    assert got == ["max_fetch_calls", "max_search_calls", "model_stop", "", "no_executable_path", ""]


def test_text_filters(spark):
    df = spark.createDataFrame([("Straße und  Haus",), (None,)], "t string")
    assert [r[0] for r in df.select(rerank.passes_text("t", ["STRASSE UND"])).collect()] == [True, False]
    assert [r[0] for r in df.select(rerank.passes_text("t", None, ["haus"])).collect()] == [False, True]


def test_merged_abstracts(spark):
    df = spark.createDataFrame([([" a ", "A", "", "b", None],)], "x array<string>")
    assert df.select(rerank.merged_abstracts("x")).first()[0] == "a\nb"
