"""The four verbs over a corpus of pages: search, fetch, answer, research.

A language model is a seam: a callable that takes a task name and structured inputs and
gives a structure. Without one, planning keeps the question as it is and writing is
extractive: the best passages with their sources.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import dom, html, urls
from spindrift.functions.dates import in_range
from spindrift.functions.text import tokenize
from spindrift.operators import budget, merge, passages, ranking, rerank
from spindrift.operators.cuts import durable
from spindrift.plans import defaults as D
from spindrift.plans.requests import AnswerRequest, FetchRequest, ResearchRequest, SearchRequest

Model = Callable[[str, dict], dict]
log = logging.getLogger(__name__)


@dataclass
class Overrides:
    """What a caller may put in place of the defaults."""

    model: Model | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict(ranking.DEFAULT_WEIGHTS))


class Engine:
    """pages: url, html, and published_date if there is one (a table of any size; nothing of it is collected)."""

    def __init__(self, spark: SparkSession, pages: DataFrame, overrides: Overrides | None = None) -> None:
        self.spark, self.overrides, self.failures = spark, overrides or Overrides(), []
        if "published_date" not in pages.columns:
            pages = pages.withColumn("published_date", F.lit(""))
        self.pages = pages.select(urls.canonical_url("url").alias("canonical_url"), "url", "html", "published_date")

    def ask(self, task: str, inputs: dict, default: dict) -> dict:
        """The model's answer; the default without a model or when it fails."""
        if self.overrides.model is None:
            return default
        try:
            return self.overrides.model(task, inputs) or default
        except Exception as e:  # noqa: BLE001 - a failed model leaves the plain plan, and a trace
            self.failures.append((task, f"{type(e).__name__}: {e}"))
            log.warning("the model failed at %s: %s", task, e)
            return default

    def documents(self) -> DataFrame:
        """One row for each address: title and visible text, native on plain markup."""
        read = self.pages.withColumns({"title": html.title_native("html"), "text": html.visible_native("html"), "domain": urls.domain("url")})
        return merge.first_of(read.select("canonical_url", "url", "title", "text", "domain", "published_date"), ["canonical_url"], ["url"])

    def jobs(self, request: SearchRequest) -> list[tuple[int, str, str]]:
        mode = D.SEARCH_MODES[request.mode]
        more = self.ask("expand", {"query": request.query, "most": mode.extra_queries}, {"queries": []})["queries"] if mode.extra_queries else []
        rows = [(0, request.query, "primary"), *((i, q, "manual") for i, q in enumerate(request.additional_queries, 1))]
        rows += [(len(rows) + i, q, "llm") for i, q in enumerate(more)]
        kept = merge.dedupe_queries(self.spark.createDataFrame(rows, "job_index long, query string, source string"), mode.extra_queries + len(request.additional_queries))
        return [(r.job_index, r.query, r.source) for r in kept.orderBy("job_index").collect()]  # as many as a request names

    def search(self, request: SearchRequest) -> DataFrame:
        """rank, url, title, published_date, page_score, context_score, final_score and abstracts of the best pages."""
        mode = D.SEARCH_MODES[request.mode]
        limit = merge.prefetch_limit(request.max_results, mode.multiplier, mode.most_urls)
        jobs = self.spark.createDataFrame(self.jobs(request), "query_id long, query string, source string")
        docs = self.documents().where(urls.domain_allowed(F.col("domain"), request.include_domains, request.exclude_domains)).where(in_range("published_date", request.start_published_date, request.end_published_date)).where(rerank.passes_text("text", request.include_text, request.exclude_text))
        hits = ranking.search_corpus(docs, jobs, limit, doc="canonical_url", key="query_id", named=self.overrides.weights)
        order = F.row_number().over(Window.orderBy("job", "position"))
        first = hits.groupBy("canonical_url").agg(F.min("query_id").alias("job"), F.min("rank").alias("position")).withColumn("order", order).where(F.col("order") <= limit)
        found = durable(docs.join(F.broadcast(first), "canonical_url").withColumn("candidate", F.col("order")))  # at most `limit` addresses, used four times below
        question = self.spark.createDataFrame([(0, request.query)], "batch int, query string")
        batch = found.select(F.lit(0).alias("batch"), "candidate", "text")
        content = ranking.rank_batches(batch, question, ["batch"], "candidate", named=self.overrides.weights).select("candidate", F.col("score").alias("content_score"))
        lines = passages.passages(found.select("candidate", "text"), "candidate", "text", D.ABSTRACT_TOKENS)
        made = passages.rank_passages(lines, found.select("candidate", F.lit(request.query).alias("query")), "candidate", D.TITLE_ALPHA, D.ABSTRACT_SCORE, D.ABSTRACT_CHARS)
        abstracts = made.groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("abstracts"), F.avg("score").alias("abstract_score"))
        scored = found.join(content, "candidate").join(abstracts, "candidate", "left").withColumn("page_score", F.coalesce("content_score", F.lit(0.0)))
        contexts = None
        if mode.context_docs:
            c = rerank.context_documents(scored.select("candidate", F.array("title").alias("snippets"), "abstracts"), mode.context_docs, mode.context_chars)
            contexts = rerank.context_scores(c.withColumn("batch", F.lit(0)), question, ["batch"]).select("candidate", "context_score")
        final = rerank.final_scores(scored.drop("page_score"), scored.select("candidate", "page_score"), contexts)
        best = rerank.finalize(final, request.max_results)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "order")))
        return durable(ranked).select("rank", "url", "canonical_url", "title", "published_date", F.round("page_score", 6).alias("page_score"), F.round("context_score", 6).alias("context_score"), F.round("final_score", 6).alias("final_score"), F.coalesce("abstracts", F.array().cast("array<string>")).alias("abstracts"))

    def fetch(self, request: FetchRequest) -> DataFrame:
        """url_index, url, status, error_tag, title, markdown, links and abstracts of each requested address."""
        asked = self.spark.createDataFrame(list(enumerate(request.urls)), "url_index int, url string").withColumn("canonical_url", urls.canonical_url("url"))
        there = self.pages.join(F.broadcast(asked.select("canonical_url").distinct()), "canonical_url")  # the request bounds it
        one = merge.first_of(there, ["canonical_url"], ["url"]).withColumns({"p": html.page("html", "url"), "c": dom.content("html", "url")})
        read = asked.join(one.select("canonical_url", "p", "c"), "canonical_url", "left")
        short = F.length(F.coalesce("c.text", F.lit(""))) < D.MIN_TEXT_CHARS
        status = read.withColumn("error_tag", F.when(F.col("p").isNull(), "SOURCE_NOT_AVAILABLE").when(short, "CONTENT_TOO_SHORT").otherwise("")).withColumn("status", F.when(F.col("error_tag") == "", "success").otherwise("error"))
        out = status.select("url_index", "url", "status", "error_tag", "p.title", F.left("c.markdown", F.lit(D.MARKDOWN_CHARS)).alias("markdown"), F.slice("p.links", 1, D.MAX_LINKS).alias("links"))
        if not request.abstracts:
            return out
        good = out.where("status = 'success'")
        question = good.select("url_index", F.coalesce(F.nullif(F.lit(request.query), F.lit("")), F.nullif("title", F.lit("")), "url").alias("query"))
        made = passages.rank_passages(passages.passages(good, "url_index"), question, "url_index", max_chars=request.max_chars)
        listed = made.groupBy("url_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id", "text", "score"))), lambda x: F.struct(x["passage_id"].alias("passage_id"), x["text"].alias("text"), x["score"].alias("score"))).alias("abstracts"))
        return out.join(listed, "url_index", "left")

    def answer(self, request: AnswerRequest) -> dict:
        """The answer text with numbered citations and the cited sources; all of it bounded by the prompt's budget."""
        plan = self.ask("plan", {"query": request.query}, {"questions": [request.query]})
        questions = list(dict.fromkeys(plan["questions"]))[: D.SUB_QUESTIONS] or [request.query]
        sources = None
        for i, q in enumerate(questions):
            found = self.search(SearchRequest(q, "auto", D.ANSWER_RESULTS)).select(F.lit(i).alias("question"), F.col("rank").cast("long").alias("source"), "url", "title", "abstracts")
            sources = found if sources is None else sources.unionByName(found)
        texts = budget.prompt_texts(sources, D.ANSWER_CHARS, ["question"]).join(sources.select("question", "source", "url", "title"), ["question", "source"])
        rows = texts.orderBy("question", "at").collect()  # at most ANSWER_CHARS characters a question
        numbers = {u: n for n, u in enumerate(dict.fromkeys(r.url for r in rows), 1)}
        written = self.ask("answer", {"query": request.query, "texts": [(numbers[r.url], r.text) for r in rows]}, {})
        text = written.get("text") or " ".join(f"{r.text} [citation:{numbers[r.url]}]" for r in rows)
        return {"answer": text, "citations": [{"index": n, "url": u, "title": next(r.title for r in rows if r.url == u)} for u, n in numbers.items()]}

    def research(self, request: ResearchRequest) -> dict:
        """A report of sections with numbered sources, from bounded rounds for each question of the themes."""
        from spindrift.plans.research import Research

        return Research(self, D.RESEARCH[request.mode]).run(request.themes)

    def overview(self, request: FetchRequest) -> DataFrame:
        """url_index and overview of each page: the model's, else its best passages joined."""
        got = self.fetch(request)
        rows = got.select("url_index", "title", F.transform(F.coalesce("abstracts", F.array().cast("array<struct<passage_id:string,text:string,score:double>>")), lambda a: a["text"]).alias("texts")).collect()  # as many as the request names
        said = [(r.url_index, self.ask("overview", {"query": request.query, "title": r.title, "texts": r.texts}, {"text": " ".join(r.texts)[: D.OVERVIEW_CHARS]})["text"]) for r in rows]
        return self.spark.createDataFrame(said, "url_index int, overview string")


def subpages(links: DataFrame, keywords: list[str], limit: int) -> DataFrame:
    """The best links of each page by the mean score over the keywords, or the first ones without keywords.

    links: page, position, url, text. A keyword counts as one token, as it is.
    """
    w = Window.partitionBy("page")
    if not keywords:
        return links.withColumn("rank", F.row_number().over(w.orderBy("position"))).where(F.col("rank") <= limit)
    tokens = tokenize(F.concat_ws(" ", "text", "url"))
    mean = sum((F.array_contains(F.col("_tokens"), w).cast("int") for w in keywords[1:]), F.array_contains(F.col("_tokens"), keywords[0]).cast("int")) / len(keywords)
    scored = links.withColumn("_tokens", tokens)
    ranked = scored.withColumn("score", mean).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "position")))
    return ranked.where(F.col("rank") <= limit).select(*links.columns, "score", "rank")
