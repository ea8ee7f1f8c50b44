"""Providers, stores, streams and the verbs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spindrift.plans.engine import Engine, Overrides, subpages
from spindrift.plans.requests import AnswerRequest, FetchRequest, ResearchRequest, SearchRequest
from spindrift.sources import providers, stores
from spindrift.streaming import telemetry


def pages_of(query: str, page: int, size: int, options: dict) -> list[dict]:
    rows = [{"url": f"https://e.org/{query}/{n // 2}", "title": f"t{n}"} for n in range(12)]
    return rows[page * size : (page + 1) * size]


def test_provider(spark):
    spark.dataSource.register(providers.provider("plain", pages_of))
    rows = spark.read.format("plain").option("queries", "a\nb").option("limit", 4).option("page_size", 5).load().orderBy("query", "position").collect()
    assert [(r["query"], r.position, r.url) for r in rows] == [(q, n + 1, f"https://e.org/{q}/{n}") for q in "ab" for n in range(4)]


def test_stores(spark):
    cache = spark.createDataFrame([("n", "a", 10, 1), ("n", "b", 99, 2)], "namespace string, key string, expires_at_ms long, value int")
    new = spark.createDataFrame([("n", "b", 120, 3)], cache.schema)
    assert sorted((r.key, r.value) for r in stores.upsert(cache, new, 10).collect()) == [("b", 3)]
    records = spark.createDataFrame([("1", 5, "k"), ("2", 4, "k"), ("3", 1, " ")], "id string, ts_ms long, key string")
    assert sorted((r.key, r.id) for r in stores.ledger(records).collect()) == [("3", "3"), ("k", "2")]


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = telemetry.read_events(spark, str(tmp_path / "in"), events.schema)
    stream.writeStream.format("memory").queryName("copied").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert spark.table("copied").count() == events.count()
    counted = telemetry.counts_by_window(telemetry.read_events(spark, str(tmp_path / "in"), events.schema, 10), "1 hour", "3650 days")
    counted.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start().awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize(
    "make",
    [
        lambda: SearchRequest(" "),
        lambda: SearchRequest("q", user_location="USA"),
        lambda: SearchRequest("q", additional_queries=["x"]),
        lambda: SearchRequest("q", include_domains=["a.org"], exclude_domains=["https://www.a.org/x"]),
        lambda: SearchRequest("q", start_published_date="2024-02-01", end_published_date="2024-01-01"),
        lambda: SearchRequest("q", include_text=["one two three four five six"]),
        lambda: FetchRequest([]),
        lambda: FetchRequest(["ftp://x"]),
        lambda: AnswerRequest(""),
        lambda: ResearchRequest("t", "huge"),
    ],
)
def test_bad_requests(make):
    with pytest.raises(ValueError):
        make()


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(spark, spark.read.parquet(f"{sf}/pages.parquet"))


def test_verbs(spark, sf, engine):
    title = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("html", "<title>(.*?)</title>", 1)).first()[0]
    found = engine.search(SearchRequest(title, "deep", 5)).collect()
    assert 0 < len(found) <= 5 and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    got = engine.fetch(FetchRequest([found[0].url, "https://nowhere.example/x"])).orderBy("url_index").collect()
    assert [r.status for r in got][1] == "error" and got[1].error_tag == "SOURCE_NOT_AVAILABLE"
    answer = engine.answer(AnswerRequest(title))
    assert all(f"[citation:{c['index']}]" in answer["answer"] for c in answer["citations"])
    made = engine.research(ResearchRequest(title, "fast"))
    numbers = [s["index"] for s in made["sources"]]
    assert numbers == list(range(1, len(numbers) + 1)) and len({s["url"] for s in made["sources"]}) == len(numbers) > 0
    assert made["content"].startswith("## ") and all(int(n) in numbers for n in re.findall(r"\[citation:(\d+)]", made["content"]))
    assert made["stop_reason"] in ("all_tracks_completed", "budget_exhausted") and made["tracks"][0]["stop_reason"]


def test_research_with_a_model(spark, sf):
    """Two cards, a second query of the review, sections of the model; failures of the model are told."""
    title = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("html", "<title>(.*?)</title>", 1)).first()[0]

    def model(task: str, inputs: dict) -> dict:
        if task == "theme":
            return {"cards": [{"question": title, "priority": 2}, {"question": title.split()[0], "priority": 1}]}
        if task == "review":
            return {"queries": [] if inputs["findings"] else [title.split()[-1]], "summary": "found | Found | more"}
        if task == "sections":
            return {"sections": [{"title": "All", "question_ids": [1, 0]}]}
        if task == "report":
            return {"text": inputs["so_far"] + f"<{len(inputs['sources'])}>"}
        raise ValueError(task)

    engine = Engine(spark, spark.read.parquet(f"{sf}/pages.parquet"), Overrides(model))
    made = engine.research(ResearchRequest("themes", "fast"))
    assert [p["title"] for p in made["structured"]] == ["All"] and "<" in made["content"] and len(made["tracks"]) == 2
    assert any(t["rounds"] > 1 for t in made["tracks"]) and ("expand", "ValueError: expand") in engine.failures


def test_overview(spark, sf, engine):
    url = spark.read.parquet(f"{sf}/pages.parquet").first().url
    got = engine.overview(FetchRequest([url, "https://nowhere.example/x"], query="the")).orderBy("url_index").collect()
    assert len(got) == 2 and got[1].overview == "" and len(got[0].overview) <= 900


def test_model_seam(spark, sf):
    calls = []

    def model(task: str, inputs: dict) -> dict:
        calls.append(task)
        raise RuntimeError

    engine = Engine(spark, spark.read.parquet(f"{sf}/pages.parquet"), Overrides(model))
    assert engine.answer(AnswerRequest("the"))["answer"] is not None and "plan" in calls


def test_subpages(spark):
    links = spark.createDataFrame([(1, 0, "u/a", "alpha"), (1, 1, "u/b", "beta"), (1, 2, "u/c", "beta gamma")], "page int, position int, url string, text string")
    assert [r.position for r in subpages(links, ["gamma", "beta"], 2).orderBy("rank").collect()] == [2, 1]
    assert [r.position for r in subpages(links, [], 2).orderBy("rank").collect()] == [0, 1]
