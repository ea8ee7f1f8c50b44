"""Queries over recorded answers of search services, made here from the tables, with what their hits must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.plans.registry import load, query
from spindrift.sources import payloads, result_pages

HEAD = r"trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))"


def recorded(spark: SparkSession, sf_dir: str, service: str, record: Column, wrap) -> DataFrame:
    """One answer for each document, with one record in it, read as hits of the service."""
    docs = load(spark, sf_dir, "documents").withColumns({"said": F.substring_index("text", "\n", 1), "i": F.col("doc_id").cast("string")})
    answers = docs.select("doc_id", F.to_json(wrap(F.array(record))).alias("payload"))
    return payloads.recorded_hits(answers, service, ["doc_id"]).select("doc_id", "engine", "url", "title", "snippet", "published_date", "pre_fetched_author")


def named(**fields) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in fields.items()])


def inside(*path: str):
    """A function that puts an array under nested names."""

    def wrap(records: Column) -> Column:
        for name in reversed(path):
            records = F.struct(records.alias(name))
        return records

    return wrap


def day() -> Column:
    return F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"))


DAY_SQL = "'2024-01-0' || (doc_id % 9 + 1)"


@query(f"""
SELECT doc_id, 'github' AS engine, 'https://github.com/a/' || doc_id AS url, 'a/' || doc_id AS title, CASE WHEN {HEAD} = '' THEN lang ELSE lang || ' / ' || {HEAD} END AS snippet, {DAY_SQL} || 'T10:00:00+00:00' AS published_date, '' AS pre_fetched_author FROM documents
""")
def github_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: repositories."""
    r = named(html_url=F.concat(F.lit("https://github.com/a/"), "i"), full_name=F.concat(F.lit("a/"), "i"), language=F.col("lang"), description=F.col("said"), created_at=F.concat(day(), F.lit("T10:00:00Z")))
    return recorded(spark, sf_dir, "github", r, inside("items"))


@query(f"""
SELECT doc_id, 'marginalia' AS engine, 'https://m.example/' || doc_id AS url, 't ' || doc_id AS title, CASE WHEN {HEAD} = '' THEN source ELSE {HEAD} || ' / ' || source END AS snippet, '' AS published_date, '' AS pre_fetched_author FROM documents WHERE doc_id % 5 <> 0
""")
def marginalia_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: small-web pages; hits without a title are none."""
    r = named(url=F.concat(F.lit("https://m.example/"), "i"), title=F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("t  "), "i")), description=F.col("said"), details=F.col("source"))
    return recorded(spark, sf_dir, "marginalia", r, inside("results"))


@query(f"""
SELECT doc_id, 'openalex' AS engine, CASE WHEN doc_id % 2 = 0 THEN 'https://p.example/' || doc_id ELSE 'https://openalex.org/W' || doc_id END AS url, 'work ' || doc_id AS title,
    'w' || doc_id || ' of w' || doc_id || ' / Authors: A ' || doc_id || ', B, C, D / ' || source || ' / Topics: ' || lang || ' / ' || doc_id || ' citations' AS snippet, {DAY_SQL} AS published_date, 'A ' || doc_id || ', B, C, D, E' AS pre_fetched_author FROM documents
""")
def openalex_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, X32: works, their abstracts put together from positions."""
    i = F.col("i")
    authors = F.array(*[named(author=named(display_name=n)) for n in (F.concat(F.lit("A "), i), "B", "C", "D", "E", "F")])
    place = named(landing_page_url=F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://p.example/"), i)), source=named(display_name=F.col("source")))
    index = F.create_map(F.concat(F.lit("w"), i), F.array(F.lit(0), F.lit(2)), F.lit("of"), F.array(F.lit(1)))
    r = named(id=F.concat(F.lit("https://openalex.org/W"), i), title=F.concat(F.lit("work "), i), primary_location=place, authorships=authors, concepts=F.array(named(display_name=F.col("lang"))), cited_by_count=F.col("doc_id"), publication_date=day(), abstract_inverted_index=index)
    return recorded(spark, sf_dir, "openalex", r, inside("results"))


@query(f"""
SELECT doc_id, 'reddit' AS engine, 'https://www.reddit.com/r/a/' || doc_id AS url, 'post ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'a.example' WHEN {HEAD} = '' THEN 'r/' || lang ELSE 'r/' || lang || ' / ' || {HEAD} END AS snippet,
    strftime(to_timestamp(1700000000 + doc_id), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_date, '' AS pre_fetched_author FROM documents
""")
def reddit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, D9: posts with relative addresses and epochs."""
    blank = F.col("doc_id") % 3 == 0
    data = named(permalink=F.concat(F.lit("/r/a/"), "i"), title=F.concat(F.lit("post "), "i"), subreddit_name_prefixed=F.when(blank, "").otherwise(F.concat(F.lit("r/"), "lang")), selftext=F.when(~blank, F.col("said")), domain="a.example", created_utc=(F.col("doc_id") + 1_700_000_000).cast("double"), thumbnail="self")
    return recorded(spark, sf_dir, "reddit", named(data=data), inside("data", "children"))


@query(f"""
SELECT doc_id, 'reuters' AS engine, 'https://www.reuters.com/w/' || doc_id AS url, 'news ' || doc_id AS title, CASE WHEN {HEAD} = '' THEN lang ELSE lang || ' / ' || {HEAD} END AS snippet, {DAY_SQL} || 'T01:02:03+00:00' AS published_date, '' AS pre_fetched_author FROM documents
""")
def reuters_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: articles."""
    r = named(canonical_url=F.concat(F.lit("/w/"), "i"), web=F.concat(F.lit("news "), "i"), kicker=named(name=F.col("lang")), description=F.col("said"), display_time=F.concat(day(), F.lit("T01:02:03Z")))
    return recorded(spark, sf_dir, "reuters", r, inside("result", "articles"))


@query(f"""
SELECT doc_id, 'searxng' AS engine, 'https://s.example/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS title, {HEAD} AS snippet, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {DAY_SQL} END AS published_date, '' AS pre_fetched_author FROM documents
""")
def searxng_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10: meta-search results; the date is the first of several keys that reads as one."""
    i = F.col("doc_id")
    r = named(url=F.concat(F.lit("https://s.example/"), "i"), title=F.when(i % 2 == 1, F.col("lang")), description=F.col("said"), publishedDate="soon", pubdate=F.when(i % 4 != 0, day()))
    return recorded(spark, sf_dir, "searxng", r, inside("results"))


@query(f"""
SELECT doc_id, 'semantic_scholar' AS engine, CASE WHEN doc_id % 2 = 0 THEN 'https://one.example/' || doc_id ELSE 'https://two.example/' || doc_id END AS url, 'paper ' || doc_id AS title, 'an abstract / Authors: N' || doc_id || ', M / ' || source || ' / Fields: ' || lang AS snippet, {DAY_SQL} AS published_date, 'N' || doc_id || ', M' AS pre_fetched_author FROM documents
""")
def semantic_scholar_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: papers."""
    i = F.col("i")
    author = lambda n: F.array(named(name=n))
    r = named(title=named(text=F.concat(F.lit("paper "), i)), primaryPaperLink=named(url=F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://one.example/"), i))), links=F.array(F.concat(F.lit("https://two.example/"), i)), paperAbstract=named(text="an <b>abstract</b>"), authors=F.array(author(F.concat(F.lit("N"), i)), author(F.lit("M"))), journal=named(name=F.col("source")), fieldsOfStudy=F.array("lang"), pubDate=day())
    return recorded(spark, sf_dir, "semantic_scholar", r, inside("results"))


@query(f"""
SELECT doc_id, 'wikidata' AS engine, CASE WHEN doc_id % 2 = 0 THEN 'https://site.example/' || doc_id ELSE 'http://www.wikidata.org/entity/Q' || doc_id END AS url, 'entity ' || doc_id AS title, {HEAD} AS snippet, '' AS published_date, '' AS pre_fetched_author FROM documents
""")
def wikidata_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: entities and their descriptions."""
    value = lambda c: named(value=c)
    r = named(item=value(F.concat(F.lit("http://www.wikidata.org/entity/Q"), "i")), itemLabel=value(F.concat(F.lit("entity "), "i")), itemDescription=value(F.col("said")), officialWebsites=value(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://site.example/"), "i")).otherwise("")))
    return recorded(spark, sf_dir, "wikidata", r, inside("results", "bindings"))


@query(f"""
SELECT doc_id, 'wikipedia' AS engine, CASE WHEN doc_id % 2 = 0 THEN 'https://full.example/' || doc_id ELSE 'https://w.example/' || doc_id END AS url, 'page ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'all of ' || lang ELSE 'part of ' || lang END AS snippet FROM documents
""")
def wikipedia_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13: pages, with their summaries by title where there is one."""
    r = named(title=F.concat(F.lit("page "), "i"), excerpt=F.concat(F.lit("part <span>of</span> "), "lang"), content_urls=named(desktop=named(page=F.concat(F.lit("https://w.example/"), "i"))))
    hits = recorded(spark, sf_dir, "wikipedia", r, inside("pages"))
    i = F.col("doc_id").cast("string")
    summaries = load(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("page "), i).alias("title"), F.concat(F.lit("https://full.example/"), i).alias("url"), F.concat(F.lit("all of "), "lang").alias("extract"))
    return payloads.with_summaries(hits, summaries).select("doc_id", "engine", "url", "title", "snippet")


@query(f"""
SELECT doc_id, 'arxiv' AS engine, 'http://arxiv.org/abs/' || doc_id AS url, 'T & ' || doc_id AS title, 'said ' || lang || ' / Authors: A1, A2, A3, A4' AS snippet, {DAY_SQL} || 'T00:00:00+00:00' AS published_date, 'A1, A2, A3, A4, A5' AS pre_fetched_author FROM documents
""")
def arxiv_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: entries of Atom feeds."""
    i = F.col("doc_id").cast("string")
    authors = "".join(f"<author><name>A{n}</name></author>" for n in range(1, 7))
    entry = F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/"), i, F.lit("</id><title> T  &amp; "), i, F.lit("</title><summary>\n said "), F.col("lang"), F.lit("\n</summary><published>"), day(), F.lit(f"T00:00:00Z</published>{authors}</entry><entry><id>x</id><title></title></entry></feed>"))
    feeds = load(spark, sf_dir, "documents").select("doc_id", entry.alias("payload"))
    return payloads.atom_hits(feeds, ["doc_id"]).select("doc_id", "engine", "url", "title", "snippet", "published_date", "pre_fetched_author")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey % 6 AS page, o_orderkey FROM orders), n AS (SELECT o_custkey, page, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT o_custkey, coalesce(min(page) FILTER (n < 2), max(page)) AS last FROM n GROUP BY o_custkey)
SELECT o_custkey, count(*) AS hits, max(page) AS last_page FROM p JOIN e USING (o_custkey) WHERE page <= last GROUP BY o_custkey
""")
def paged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC: what a paging reader takes: pages up to the first short one."""
    pages = load(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 6).alias("page"), "o_orderkey")
    return payloads.pages_until(pages, ["o_custkey"], 2).groupBy("o_custkey").agg(F.count("*").alias("hits"), F.max("page").alias("last_page"))


def shown(spark: SparkSession, sf_dir: str, service: str, block) -> DataFrame:
    """One result page for each source, with a block for each of its documents, read as hits of the service."""
    d = load(spark, sf_dir, "documents").withColumn("i", F.col("doc_id").cast("string"))
    pages = d.select((F.col("doc_id") % 50).alias("page"), F.struct("doc_id", F.concat(*block).alias("b")).alias("x")).groupBy("page").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")).alias("html"))
    return result_pages.result_hits(pages, service, ["page"]).select("page", "engine", "position", "url", "title", "snippet")


SHOWN = "(row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id))::INTEGER"


@query(f"""
SELECT doc_id % 50 AS page, 'duckduckgo' AS engine, {SHOWN} AS position, 'https://e.example/' || doc_id || '?a=1' AS url, 'Doc ' || doc_id || ' of ' || source AS title, 'said in ' || lang AS snippet FROM documents
""")
def duckduckgo_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, L9: blocks of a result page behind redirect links."""
    L = F.lit
    return shown(spark, sf_dir, "duckduckgo", (L('<div class="result web"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.example%2F'), "i", L('%3Fa%3D1&rut=x">Doc <b>'), "i", L("</b> of "), "source", L('</a></h2><a class="result__snippet">said  in '), "lang", L('</a></div><div class="result"><a class="result__a" href="/settings">inside</a></div>')))


@query(f"""
SELECT doc_id % 50 AS page, 'google' AS engine, {SHOWN} AS position, CASE WHEN doc_id % 2 = 0 THEN 'https://e.example/a b/' || doc_id ELSE 'https://f.example/' || doc_id END AS url, 'Doc ' || doc_id AS title, 'said in ' || lang AS snippet FROM documents
""")
def google_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, L9: blocks of a result page, links plain or behind a redirect."""
    L = F.lit
    href = F.when(F.col("doc_id") % 2 == 0, F.concat(L("/url?q=https://e.example/a%20b/"), "i", L("&sa=U&ved=1"))).otherwise(F.concat(L("https://f.example/"), "i"))
    return shown(spark, sf_dir, "google", (L('<div class="g"><a href="'), href, L('"><h3>Doc '), "i", L('</h3></a><div class="VwiC3b"><script>x()</script>said <em>in</em> '), "lang", L("</div></div>")))


@query(f"""
SELECT doc_id % 50 AS page, 'google_news' AS engine, {SHOWN} AS position, 'https://n.example/' || doc_id AS url, 'News ' || doc_id AS title, source || ' / ' || lang || ' ago' AS snippet FROM documents
""")
def google_news_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: news whose addresses stand in base64 in their links."""
    L = F.lit
    raw = F.concat(F.unhex(L("08132222")), F.encode(F.concat(L("https://n.example/"), "i"), "UTF-8"), F.unhex(L("D20100")))
    token = F.translate(F.regexp_replace(F.base64(raw), r"[=\s]", ""), "+/", "-_")
    block = (L('<div class="xrnccd"><article><a href="./articles/'), token, L('?hl=en"></a><h3>News '), "i", L('</h3><a data-n-tid="9" href="/p">'), "source", L("</a><time>"), "lang", L(" ago</time></article></div>"))
    return shown(spark, sf_dir, "google_news", (*block, *block))


@query("""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'doi' WHEN 1 THEN 'reddit' WHEN 2 THEN 'pdf' WHEN 3 THEN 'github' WHEN 4 THEN 'paper' WHEN 5 THEN 'markdown' ELSE 'html' END AS extractor FROM pages
""")
def extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18, SRC19, SRC30, F14: which extractor reads a page."""
    i, n = F.col("page_id").cast("string"), F.col("page_id") % 7
    url = F.when(n == 0, F.concat(F.lit("https://doi.org/10.1/"), i)).when(n == 1, F.concat(F.lit("https://old.reddit.com/r/a/comments/"), i)).when(n == 3, F.concat(F.lit("https://GitHub.com/a/b"), i)).otherwise(F.col("url"))
    kind = F.when(n == 2, "pdf").when(n == 5, "markdown").otherwise("html")
    page = F.when(n == 4, F.concat(F.lit('<meta name="citation_title" content="x">'), "html")).otherwise(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", result_pages.extractor_of(url, F.lit("text/html"), kind, page).alias("extractor"))
