"""Queries of the text, address, date, score and JSON rules that no larger query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import dates, documents, scores, text, urls
from spindrift.functions import json as js
from spindrift.operators import budget, fetching, ranking, review
from spindrift.plans import requests
from spindrift.plans.registry import load, query

CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(rf"""
SELECT doc_id, left(text, 40) AS cut, length({CLEAN.format("text")})::INTEGER AS flat_chars,
    CASE WHEN doc_id % 3 <> 0 THEN lang WHEN doc_id % 2 = 0 THEN source ELSE 'u' || doc_id END AS asked,
    '''!' || source || ''' ! ' || lang AS quoted,
    CASE doc_id % 4 WHEN 0 THEN (doc_id % 50) * 1000 WHEN 1 THEN 1500000 WHEN 2 THEN 1200 + doc_id % 10 ELSE 0 END::BIGINT AS n,
    CASE doc_id % 4 WHEN 0 THEN lang || '-' || upper(lang) WHEN 1 THEN lang || '-Latn' WHEN 2 THEN '' ELSE lang || '-419-x1' END AS tag
FROM documents
""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut, clean, effective queries, quoted bangs, counts with suffixes, language tags."""
    d, i = load(spark, sf_dir, "documents"), F.col("doc_id")
    blank = lambda n, c: F.when(i % n == 0, "").otherwise(c)
    asked = text.effective_query(blank(3, F.col("lang")), F.when((i % 2 == 0), F.col("source")).otherwise(" "), F.concat(F.lit("u"), i.cast("string")))
    count = F.when(i % 4 == 0, F.concat((i % 50).cast("string"), F.lit("K"))).when(i % 4 == 1, " 1.5 m").when(i % 4 == 2, F.concat(F.lit("1,20"), (i % 10).cast("string"))).otherwise("none")
    tag = F.when(i % 4 == 0, F.concat(F.upper("lang"), F.lit("_"), "lang")).when(i % 4 == 1, F.concat("lang", F.lit("-LATN"))).when(i % 4 == 2, "all").otherwise(F.concat("lang", F.lit("-419-X1")))
    return d.select("doc_id", text.truncate("text", 40).alias("cut"), F.length(text.collapse("text")).alias("flat_chars"), asked.alias("asked"), text.quote_bangs(F.concat(F.lit(" !"), "source", F.lit("  !  "), "lang")).alias("quoted"), text.count_suffix(count).alias("n"), text.language_tag(tag).alias("tag"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS said FROM documents),
m AS (SELECT doc_id, CASE line % 6 WHEN 0 THEN '## ' || said WHEN 1 THEN '- ' || said WHEN 2 THEN '| ' || said || ' |' WHEN 3 THEN '```' || said WHEN 4 THEN said ELSE '12) ' || said END AS raw FROM l)
SELECT doc_id, count(*) FILTER (regexp_matches(raw, '^\s{0,3}#{1,6}\s+\S')) AS headings, count(*) FILTER (regexp_matches(raw, '^\s*([-*+•]|\d+[.)])\s+\S')) AS items, count(*) FILTER (regexp_matches(trim(raw), '^\|.*\|$')) AS rows_,
    count(*) FILTER (regexp_matches(raw, '^\s*(```+|~~~+)')) AS fences, count(*) FILTER (regexp_matches(raw, '[.!?。！？…][''"”’)\]]*\s*$')) AS ends
FROM m GROUP BY doc_id
""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, list items, table rows, fences and sentence ends among the lines of every document."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "said"))
    kind = (F.col("at") + 1) % 6
    mark = F.when(kind == 0, "## ").when(kind == 1, "- ").when(kind == 2, "| ").when(kind == 3, "```").when(kind == 4, "").otherwise("12) ")
    raw = lines.select("doc_id", F.concat(mark, "said", F.when(kind == 2, " |").otherwise("")).alias("raw"))
    count = lambda rule, name: F.count_if(rule("raw")).alias(name)
    return raw.groupBy("doc_id").agg(count(text.is_heading, "headings"), count(text.is_list_item, "items"), count(text.is_table_line, "rows_"), count(text.is_fence, "fences"), count(text.sentence_end, "ends"))


@query("""
SELECT page_id, 'as [citation:u' || page_id % 3 || '] said, [citation:9] not [citation:u0]' AS named, 'title: "' || 'p: ' || page_id || '"' || chr(10) || 'url: plain' AS body,
    'w' || page_id || ' and w' || page_id AS abstract FROM pages
""")
def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by their ids, front matter, abstracts put together from inverted indexes."""
    i = F.col("page_id").cast("string")
    ids = F.create_map(*[x for n in range(3) for x in (F.lit(n), F.lit(f"u{n}"))])
    said = F.concat(F.lit("as [citation:"), (F.col("page_id") % 3).cast("string"), F.lit("] said, [citation:9] not [ Citation : 0 ]"))
    index = F.create_map(F.concat(F.lit("w"), i), F.array(F.lit(0), F.lit(2)), F.lit("and"), F.array(F.lit(1)))
    rows = load(spark, sf_dir, "pages").select("page_id", said.alias("said"), F.concat(F.lit("p: "), i).alias("title"), F.lit("plain").alias("url"), F.lit(" ").alias("author"), index.alias("index"))
    head = F.regexp_replace(text.front_matter(["title", "author", "url"]), r"^---\n|\n---$", "")
    return rows.select("page_id", text.citation_replace("said", ids).alias("named"), head.alias("body"), text.inverted_index_text("index").alias("abstract"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*', 0) AS head, regexp_replace(regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1), '/[^/]*$', '/'), '^([a-z]+://[^/]+)$', '\1/') AS dir,
    array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(gclid|fbclid|msclkid)(=|$)|^utm_')), '&') AS rest FROM pages)
SELECT page_id, head || CASE WHEN rest = '' THEN '' ELSE '?' || rest END AS link, dir || 'next.html' AS beside, '10.1234/ab' || page_id AS doi, page_id % 2 = 0 AS is_post, 'https://www.reddit.com/r/a/comments/' || page_id || '.json' AS post_json,
    'https://example.org/' || page_id AS target FROM p
""")
def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page, DOIs, discussion addresses, targets of result pages' redirects."""
    i = F.col("page_id").cast("string")
    post = F.concat(F.lit("https://www.reddit.com/r/a/"), F.when(F.col("page_id") % 2 == 0, "comments/").otherwise("about/"), i)
    serp = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.google.com/url?sa=t&q=https%3A%2F%2Fexample.org%2F"), i, F.lit("&x=1"))).otherwise(F.concat(F.lit("//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.org%2F"), i))
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", urls.page_link("url", F.lit("")).alias("link"), urls.page_link(F.lit("next.html#top"), "url").alias("beside"), urls.doi(F.concat(F.lit("see https://doi.org/10.1234/AB"), i, F.lit(")."))).alias("doi"), urls.is_reddit_post(post).alias("is_post"), urls.reddit_json(F.concat(F.lit("https://www.reddit.com/r/a/comments/"), i, F.lit("/?x=1#c"))).alias("post_json"), urls.redirect_target(serp).alias("target"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_pdf, strftime(o_orderdate, '%Y-%m-%d') AS day_only, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_epoch,
    CASE WHEN o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 1 DAY THEN 'day' WHEN o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 7 DAY THEN 'week' WHEN o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 31 DAY THEN 'month' WHEN o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 366 DAY THEN 'year' ELSE '' END AS since,
    least(50, 2 * (o_custkey % 40))::BIGINT AS fetched FROM orders WHERE o_orderdate <= TIMESTAMP '1998-08-01'
""")
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of PDF files and epochs, relative ranges, over-fetching of dated searches."""
    o = load(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")).where("at <= TIMESTAMP '1998-08-01 00:00:00'")
    stamp = F.date_format("at", "yyyyMMddHHmmss")
    return o.select("o_orderkey", dates.pdf_date(F.concat(F.lit("D:"), stamp, F.lit("Z"))).alias("from_pdf"), dates.pdf_date(F.left(stamp, F.lit(8))).alias("day_only"), dates.epoch(F.unix_timestamp("at")).alias("from_epoch"), dates.relative_range(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""), F.lit("1998-08-01 00:00:00").cast("timestamp")).alias("since"), dates.over_fetch((F.col("o_custkey") % 40), 50).cast("long").alias("fetched"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_acctbal AS v, (c_custkey % 97) / 97.0 AS a, (c_custkey % 89) / 89.0 AS b FROM customer)
SELECT k AS c_custkey, round(0.35 * a + 0.65 * b, 6)::DOUBLE AS reranked, CASE WHEN k % 3 = 0 THEN 0 ELSE v END::DOUBLE AS number, round((500 + k % 1000) / greatest(0.15, 0.45 * a + 0.55 * b), 6)::DOUBLE AS cost,
    k % 5 >= 3 AND b >= 0.72 AND k % 700 <= (k % 1000) * 0.78 AS browser, greatest(8, round_even((k % 100) * 0.3, 0))::INTEGER AS links, least(greatest(v, 0), 250) / 1000 AS delay, CASE WHEN k % 2 = 0 THEN (k % 60)::DOUBLE END AS wait FROM c
""")
def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blends, safe numbers, costs of routes, choices of a backend, limits and delays."""
    c = load(spark, sf_dir, "customer")
    k, a, b = F.col("c_custkey"), (F.col("c_custkey") % 97) / 97.0, (F.col("c_custkey") % 89) / 89.0
    number = F.when(k % 3 == 0, F.when(k % 2 == 0, "none").otherwise("NaN")).otherwise(F.col("c_acctbal").cast("string"))
    wait = F.when(k % 2 == 0, F.concat(F.lit(" "), (k % 60).cast("string"))).otherwise("Wed, 21 Oct")
    return c.select("c_custkey", F.round(ranking.rerank_blend(a, b), 6).alias("reranked"), scores.safe(number).alias("number"), F.round(scores.route_score(a, b, (k % 1000 + 500).cast("double")), 6).alias("cost"), scores.prefers_browser(k % 5, b, k % 700, k % 1000).alias("browser"), scores.subpage_links((k % 100).cast("double")).alias("links"), scores.clamp_delay(F.col("c_acctbal")).alias("delay"), scores.retry_after(wait).alias("wait"))


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, round(greatest(0.0, length(t) + 6 * len(regexp_extract_all(t, '[,.!?;:。！？；]')) + 1.5 * (length(t) - length(replace(t, ' ', ''))) - 80 * len(regexp_extract_all(t, 'https?://'))), 4)::DOUBLE AS article FROM t
""")
def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an article every document is."""
    return load(spark, sf_dir, "documents").select("doc_id", F.round(scores.html_text_score("text"), 4).alias("article"))


@query("""
SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, event_type IN ('click', 'view') AS yes, event_id % 3 <> 0 AS is_valid, 2 AS n_kept, left(repeat(event_type, 3), 9) AS kept FROM events
""")
def json_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3, V6, V7: JSON inside other text, checks against a schema, bounded attributes, truth in words."""
    e, t = load(spark, sf_dir, "events"), F.col("event_type")
    wrapped = F.concat(F.lit("Here you are: "), "props", F.lit(" - done"))
    word = F.when(t == "click", " YES").when(t == "view", "1").when(t == "error", "no").otherwise("maybe")
    made = F.when(F.col("event_id") % 3 != 0, F.col("props")).otherwise("no json")
    attrs = F.create_map(F.lit("a"), F.repeat(t, 3), F.lit("b"), F.lit("x"), F.lit("c"), F.lit("y"))
    kept = js.limited(attrs, 2, 9)
    return e.select("event_id", F.try_variant_get(js.parsed(wrapped), "$.k", "bigint").alias("k"), js.truthy(word).alias("yes"), js.valid(made, "k int").alias("is_valid"), F.size(kept).alias("n_kept"), kept["a"].alias("kept"))


@query(r"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'SOURCE_NOT_AVAILABLE' WHEN 1 THEN 'UNSUPPORTED_URL' ELSE '' END AS refused, CASE page_id % 6 WHEN 0 THEN 'CRAWL_LIVECRAWL_TIMEOUT' WHEN 1 THEN 'CRAWL_TIMEOUT' WHEN 2 THEN 'CRAWL_NOT_FOUND' WHEN 3 THEN 'CRAWL_UNKNOWN_ERROR' WHEN 4 THEN 'SOURCE_NOT_AVAILABLE' ELSE 'CRAWL_UNKNOWN_ERROR' END AS tag,
    CASE WHEN length(trim(regexp_replace(html, '\s+', ' ', 'g'))) < 1000 THEN 'SOURCE_NOT_AVAILABLE' ELSE '' END AS short FROM pages
""")
def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of addresses and contents, tags of failures."""
    i = F.col("page_id")
    url = F.when(i % 3 == 0, " ").when(i % 3 == 1, "ftp://x").otherwise(F.col("url"))
    code = F.when(i % 6 == 4, "fetch_cache_miss").when(i % 6 == 5, "other").otherwise("fetch_crawl_failed")
    message = F.when(i % 6 == 0, "LiveCrawl Timeout").when(i % 6 == 1, "Deadline passed").when(i % 6 == 2, "status 404").otherwise("odd")
    return load(spark, sf_dir, "pages").select("page_id", fetching.url_guard(url).alias("refused"), fetching.error_tag(code, message).alias("tag"), fetching.content_guard("html", 1000).alias("short"))


@query("""
WITH a AS (SELECT page_id AS i, page_id % 7 = 0 AS blocked, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS kind, page_id % 400 AS chars, (page_id % 10) / 10.0 AS script, contains(html, 'id="root"') OR page_id % 3 = 0 AS spa, page_id % 4 = 0 AS nextjs, (page_id % 11) / 11.0 AS quality, page_id % 2 = 0 AS prefers FROM pages)
SELECT i AS page_id, CASE WHEN blocked THEN false WHEN kind <> 'html' THEN true ELSE NOT ((spa AND (chars < 220 OR script >= 0.35)) OR (nextjs AND chars < 220) OR (script >= 0.35 AND quality < 0.4) OR (prefers AND quality < 0.55)) END AS goes_on,
    CASE WHEN blocked THEN 'blocked' WHEN kind = 'html' AND spa THEN 'spa' WHEN kind = 'html' AND nextjs THEN 'nextjs' WHEN kind = 'html' AND chars < 220 THEN 'low_text' ELSE 'curl_unusable' END AS reason FROM a
""")
def crawl_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20, M19: whether a plain crawl goes on, and why a browser takes over."""
    i = F.col("page_id")
    attempt = {"blocked": i % 7 == 0, "kind": F.when(i % 5 == 0, "pdf").otherwise("html"), "chars": i % 400, "script_ratio": (i % 10) / 10.0, "spa": F.contains("html", F.lit('id="root"')) | (i % 3 == 0), "nextjs": i % 4 == 0, "quality": (i % 11) / 11.0, "prefers_browser": i % 2 == 0}
    return load(spark, sf_dir, "pages").select("page_id", fetching.continues_plain(attempt).alias("goes_on"), fetching.browser_reason(attempt).alias("reason"))


@query("""
SELECT page_id, 'text=' || CASE WHEN page_id % 3 = 0 THEN '(none)' ELSE 'go ' || page_id END || '; url=' || url AS link_text, 'title=t' || page_id || chr(10) || 'url=' || url || chr(10) || 'overview=a b' || chr(10) || 'content=' AS source_text,
    page_id % 4 <> 0 AS readable, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INTEGER AS link_class, ['Ab', 'c' || page_id % 2, 'd'] AS merged FROM pages
""")
def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that sources and links are ranked by, what can be read, ordered unions."""
    i = F.col("page_id")
    name = F.concat(F.lit("t"), i.cast("string"))
    words = F.array(F.lit("Ab"), F.concat(F.lit("c"), (i % 2).cast("string")))
    site = F.when(i % 3 == 0, "https://arxiv.org/abs/1").when(i % 3 == 1, "https://example.org").otherwise("https://www.mdpi.com/1")
    return load(spark, sf_dir, "pages").select(
        "page_id",
        review.link_text(F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("go "), i.cast("string"))), F.col("url")).alias("link_text"),
        review.source_text(name, F.col("url"), F.lit(" a  b "), F.lit(None).cast("string")).alias("source_text"),
        review.reviewable(F.when(i % 4 == 1, "x").otherwise(" "), F.when(i % 2 == 0, F.when(i % 4 == 0, "").otherwise("y")).when(i % 4 == 3, "z")).alias("readable"),
        documents.link_class(site).alias("link_class"),
        review.merged_in_order(words, F.array(F.lit("AB"), F.lit("d")), F.transform(words, F.upper)).alias("merged"),
    )


@query("""
SELECT * FROM (VALUES ('concise', 'metadata,body'), ('standard', 'metadata,header,body'), ('full', 'metadata,header,navigation,banner,body,footer'), ('tags', 'metadata,sidebar,footer'), ('queries', 'A b,c'), ('reserve', '5'), ('settle', '3,2'), ('reclaim', '3,2,2'), ('extension', '4'), ('prefetch', '20')) AS t(rule, gives)
""")
def request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests ask for and what budgets give, decided on the driver before any plan is made."""
    from spindrift.operators.merge import prefetch_limit

    join = lambda xs: ",".join(map(str, xs))
    rows = [(d, join(fetching.sections(d, exclude=["sidebar", "metadata"]))) for d in ("concise", "standard", "full")]
    rows += [("tags", join(fetching.sections(include=["footer", "sidebar"]))), ("queries", join(requests.unique([" A  b", "a B", "", "c", "C"])))]
    rows += [("reserve", str(budget.reserve(9, 7, 5))), ("settle", join(budget.settle(5, 3))), ("reclaim", join(budget.reclaim(7, 3))), ("extension", str(budget.extension(9, "medium"))), ("prefetch", str(prefetch_limit(10, 2.0, 32)))]
    return spark.createDataFrame(rows, "rule string, gives string")
