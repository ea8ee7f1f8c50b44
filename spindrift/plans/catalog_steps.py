"""Queries of the steps of fetching and research that no larger query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import budget, corpus, fetching, merge, rerank, review
from spindrift.plans.engine import subpages
from spindrift.plans.registry import load, query

ITEM = "l_orderkey * 10 + l_linenumber"


@query(f"""
WITH s AS (SELECT l_partkey AS url, list_sort(list({ITEM})) AS ids FROM lineitem GROUP BY 1), a AS (SELECT url, len(ids) AS n, unnest(ids) AS source_id, generate_subscripts(ids, 1) - 1 AS at_ FROM s)
SELECT url, n::INTEGER AS n, at_::INTEGER AS "at", a.source_id, l_suppkey FROM a JOIN lineitem ON {ITEM} = a.source_id
""")
def source_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every address, and the sources of those ids in their order."""
    items = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), F.col("l_partkey").alias("canonical_url"), "l_suppkey")
    listed = corpus.ids_by_address(items)
    asked = listed.select(F.col("canonical_url").alias("url"), F.size("source_ids").alias("n"), F.col("source_ids").alias("ids"))
    exploded = asked.select("url", "n", F.posexplode("ids").alias("at", "source_id"))
    return exploded.join(items.select("source_id", "l_suppkey"), "source_id").select("url", "n", "at", "source_id", "l_suppkey")


@query("""
WITH p AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS position, 'l' || l_partkey % 9 || CASE WHEN l_linenumber % 2 = 0 THEN '#x' ELSE '' END AS url, CASE WHEN l_linenumber % 3 = 0 THEN 'image' ELSE 'link' END AS kind FROM lineitem),
c AS (SELECT page, kind, position, CASE WHEN kind = 'link' THEN regexp_replace(url, '#.*$', '') ELSE url END AS url FROM p),
k AS (SELECT page, kind, url, min(position) AS position FROM c WHERE url <> 'l' || page % 9 GROUP BY ALL),
l AS (SELECT page, kind, row_number() OVER (PARTITION BY page ORDER BY position) AS place, url FROM k WHERE kind = 'link' QUALIFY place <= 3),
i AS (SELECT page, kind, row_number() OVER (PARTITION BY page ORDER BY position) AS place, url FROM k WHERE kind = 'image' AND NOT EXISTS (SELECT 1 FROM l WHERE l.page = k.page AND l.url = k.url) QUALIFY place <= 1)
SELECT page, kind, place::INTEGER AS place, url FROM l UNION ALL SELECT page, kind, place::INTEGER, url FROM i
""")
def other_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images beside a page, its own address left out (the limits are the feature)."""
    items = load(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    url = F.concat(F.lit("l"), (F.col("l_partkey") % 9).cast("string"), F.when(n % 2 == 0, "#x").otherwise(""))
    links = items.select(F.col("l_orderkey").alias("page"), F.when(n % 3 == 0, "image").otherwise("link").alias("kind"), (n * 1_000_000 + F.col("l_partkey")).alias("position"), url.alias("url"))
    own = items.select(F.col("l_orderkey").alias("page"), F.concat(F.lit("l"), (F.col("l_orderkey") % 9).cast("string")).alias("url")).distinct()
    return fetching.other_links(links, own, 3, 1)


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms FROM events), w AS (SELECT *, row_number() OVER h AS k FROM e WINDOW h AS (PARTITION BY user_id ORDER BY at_ms, event_id)),
s AS (SELECT *, max(at_ms - k * 60000) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) + k * 60000 AS start_ms FROM w),
f AS (SELECT user_id, at_ms // 3600000 AS hour, min(event_id) AS leader FROM e GROUP BY ALL)
SELECT s.event_id, start_ms::BIGINT AS start_ms, s.event_id = leader AS fetches FROM s JOIN f ON f.user_id = s.user_id AND f.hour = s.at_ms // 3600000
""")
def paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, ST7: requests of one host a minute apart, and one fetch for the requests of a host and hour."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    spaced = fetching.paced(e, 60_000, "user_id", "at_ms", ["event_id"])
    shared = fetching.coalesced(spaced.withColumn("url", F.concat_ws("/", "user_id", F.floor(F.col("at_ms") / 3_600_000))), "url", "event_id")
    return shared.select("event_id", "start_ms", "fetches")


@query("""
WITH s AS (SELECT l_orderkey AS track, l_linenumber AS position, l_partkey AS source_id, l_quantity > 10 OR l_tax > 0.04 AS readable FROM lineitem),
a AS (SELECT l_orderkey AS track, l_partkey AS source_id, min(l_linenumber) AS at_ FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL),
r AS (SELECT s.track, s.source_id, min([CASE WHEN at_ IS NULL THEN 1 ELSE 0 END, coalesce(at_, position)]) AS rank_ FROM s LEFT JOIN a ON a.track = s.track AND a.source_id = s.source_id WHERE readable GROUP BY ALL)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY rank_, source_id)::INTEGER AS place, source_id FROM r QUALIFY place <= 3
""")
def sources_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a review asks for first, then the others (the window is the feature)."""
    items = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("source_id"), F.when(F.col("l_quantity") > 10, "x").otherwise(" ").alias("content"), F.when(F.col("l_tax") > 0.04, "y").alias("overview"), "l_discount")
    asked = items.where("l_discount >= 0.05").select("track", F.col("position").alias("at"), "source_id")
    return review.sources_to_read(items.drop("l_discount"), asked, 3, ["track"])


@query("""
WITH t AS (SELECT c_custkey AS question_id, c_nationkey AS section, round(c_acctbal, 0) AS confidence, c_custkey % 5 AS coverage, c_custkey % 3 AS conflicts, c_custkey % 7 AS found FROM customer)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY confidence DESC, coverage DESC, conflicts, found DESC, question_id)::INTEGER AS place, question_id FROM t
""")
def section_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of a section in the order of how much they found out."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tracks = c.select(k.alias("question_id"), F.round("c_acctbal", 0).alias("confidence"), (k % 5).alias("coverage"), (k % 3).alias("conflicts"), (k % 7).alias("findings"))
    sections = c.groupBy(F.col("c_nationkey").alias("section")).agg(F.sort_array(F.collect_list("c_custkey")).alias("question_ids"))
    return review.section_tracks(sections, tracks)


@query(r"""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, role || ' | ' || CASE WHEN turn % 2 = 0 THEN upper(role) ELSE 't' || turn END AS said, '|x ' || turn || '|' AS more FROM conversations),
p AS (SELECT conv_id, turn, 0 AS part, generate_subscripts(string_split(said, '|'), 1) AS at_, unnest(string_split(said, '|')) AS f FROM r WHERE back <= 8 UNION ALL SELECT conv_id, turn, 1, generate_subscripts(string_split(more, '|'), 1), unnest(string_split(more, '|')) FROM r WHERE back <= 8),
k AS (SELECT conv_id, trim(f) AS f, turn, part, at_, row_number() OVER (PARTITION BY conv_id, lower(trim(f)) ORDER BY turn, part, at_) AS nth FROM p WHERE trim(f) <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part, at_)::INTEGER AS place, f AS finding FROM k WHERE nth = 1 QUALIFY place <= 8
""")
def round_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last rounds found, each finding once (the limits are the feature)."""
    c = load(spark, sf_dir, "conversations")
    t = F.col("turn").cast("string")
    said = F.concat("role", F.lit(" | "), F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.concat(F.lit("t"), t)))
    rounds = c.select("conv_id", F.col("turn").alias("round_index"), said.alias("overview_summary"), F.concat(F.lit("|x "), t, F.lit("|")).alias("content_summary"))
    return review.findings(rounds, ["conv_id"])


@query("""
SELECT o_custkey, count(*) AS rounds, sum((o_orderstatus = 'F')::INTEGER + (o_orderkey % 4 = 0)::INTEGER)::BIGINT AS open, sum(1 + o_orderkey % 2)::BIGINT AS searches FROM orders GROUP BY o_custkey
""")
def round_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds, open conflicts and searches of every track."""
    k = F.col("o_orderkey")
    conflicts = F.array(F.when(F.col("o_orderstatus") == "F", "unresolved").otherwise("resolved"), F.when(k % 4 == 0, "insufficient").otherwise("none"))
    queries = F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return review.history(load(spark, sf_dir, "orders").select("o_custkey", conflicts.alias("conflicts"), queries.alias("queries")), ["o_custkey"])


@query("""
WITH r AS (SELECT o_orderkey AS i, o_orderkey % 7 - 1 AS search_left, o_orderkey % 5 - 1 AS fetch_left, o_orderkey % 3 AS n_queries, o_orderkey % 2 AS n_links, o_orderkey % 4 AS done, 2 AS least, (o_custkey % 10) / 10.0 AS gain, (o_custkey % 9) / 9.0 AS confidence, (o_custkey % 8) / 8.0 AS coverage, (o_custkey % 7) / 7.0 AS uncertainty, o_custkey % 2 AS conflicts, o_orderkey % 6 // 5 AS objectives, o_custkey % 3 = 0 AS wants FROM orders),
c AS (SELECT *, fetch_left > 0 AND n_links > 0 AS explore, search_left > 0 AND fetch_left > 0 AS search FROM r),
d AS (SELECT *, (search AND n_queries > 0) OR explore AS can_go, gain >= 0.45 AND (confidence < 0.45 OR coverage < 0.5 OR uncertainty > 0.6 OR conflicts > 0) AS doubts FROM c),
e AS (SELECT *, (done < greatest(1, least) AND (search OR explore)) OR (can_go AND (objectives > 0 OR doubts)) AS goes_on, ((NOT wants AND objectives = 0 AND NOT doubts) OR (gain < 0.35 AND objectives = 0)) AND NOT (done < 2 AND can_go) AS over_ FROM d)
SELECT i AS o_orderkey, CASE WHEN fetch_left <= 0 THEN 'max_fetch_calls' WHEN search_left <= 0 AND NOT explore THEN 'max_search_calls' WHEN goes_on THEN '' WHEN over_ THEN 'model_stop' WHEN NOT can_go THEN 'no_executable_path' ELSE '' END AS stop_reason FROM e
""")
def round_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: whether each round is the last one, and why."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rounds = load(spark, sf_dir, "orders").select("o_orderkey", (k % 7 - 1).alias("search_left"), (k % 5 - 1).alias("fetch_left"), (k % 3).alias("n_queries"), (k % 2).alias("n_links"), (k % 4).alias("rounds_done"), F.lit(2).alias("least_rounds"), ((c % 10) / 10.0).alias("gain"), ((c % 9) / 9.0).alias("confidence"), ((c % 8) / 8.0).alias("coverage"), ((c % 7) / 7.0).alias("uncertainty"), (c % 2).alias("conflicts"), F.floor((k % 6) / 5).alias("objectives"), (c % 3 == 0).alias("wants_more"))
    return corpus.decide(rounds).select("o_orderkey", "stop_reason")


@query("""
WITH s AS (SELECT l_partkey AS batch, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank_ FROM lineitem)
SELECT (SELECT CASE WHEN bool_or(o_orderstatus = 'P') THEN 'budget_exhausted' ELSE 'all_tracks_completed' END FROM orders) AS stop_reason, (SELECT count(*) FROM s WHERE rank_ = 1) AS best,
    (SELECT round(sum(o_totalprice), 2) FROM orders) AS page_sum, (SELECT count(*) FROM orders) AS n, (SELECT round(coalesce(avg(o_totalprice) FILTER (o_orderkey < 0), 0), 2) FROM orders) AS none
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a run ended, sums and means over its candidates."""
    o = load(spark, sf_dir, "orders")
    ended = corpus.stop_reason(o.select(F.when(F.col("o_orderstatus") == "P", "max_fetch_calls").otherwise("model_stop").alias("stop_reason")))
    stats = rerank.rank_stats(o.select(F.col("o_totalprice").alias("page_score"), F.lit(0.0).alias("context_score")))
    items = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("canonical_url"), F.col("l_extendedprice").alias("score"), F.lit(0).alias("round_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"))
    best = corpus.canonical_first(items).agg(F.count("*").alias("best"))
    none = o.agg(F.round(review.mean_or_zero(F.when(F.col("o_orderkey") < 0, F.col("o_totalprice"))), 2).alias("none"))
    # four tables of one row each
    return ended.crossJoin(best).crossJoin(stats.select(F.round("page_sum", 2).alias("page_sum"), "n")).crossJoin(none)


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS page, (l_linenumber * 1000000 + l_partkey) * 10 + l_suppkey % 3 AS position, 'p' || l_partkey % 5 || ' s' || l_suppkey % 3 AS said FROM lineitem),
s AS (SELECT *, (contains(said, 'p1')::INTEGER + contains(said, 's2')::INTEGER) / 2.0 AS score FROM l)
SELECT page, position, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY page ORDER BY score DESC, position)::INTEGER AS rank FROM s QUALIFY rank <= 2
""")
def subpage_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page that match its keywords best (the limit is the feature)."""
    said = F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string"), F.lit(" s"), (F.col("l_suppkey") % 3).cast("string"))
    place = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 10 + F.col("l_suppkey") % 3
    links = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), place.alias("position"), F.lit("").alias("url"), said.alias("text")).distinct()
    return subpages(links, ["p1", "s2"], 2).select("page", "position", F.round("score", 6).alias("score"), "rank")


@query("""
WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank_, s_suppkey % 4 AS round_ FROM supplier), n AS (SELECT count(*) FILTER (round_ = 3) AS n_new, count(*) FILTER (round_ <> 3) AS n_old FROM s),
q AS (SELECT *, least(n_old, greatest(20 - least(14, n_new), least(4, 20))) AS old_ FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY round_ = 3 ORDER BY rank_) AS place FROM s)
SELECT s_suppkey, rank_::INTEGER AS rank FROM p, q WHERE place <= CASE WHEN round_ = 3 THEN least(n_new, 20 - old_) ELSE old_ END
""")
def new_and_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the newest round and earlier ones in ranked order (the mix is the feature)."""
    from pyspark.sql import Window

    s = load(spark, sf_dir, "supplier")
    ranked = s.select("s_suppkey", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rank"), (F.col("s_suppkey") % 4).alias("round_index"))
    return budget.new_and_old(ranked, 3, 20, 0.7, 4).select("s_suppkey", "rank")


@query("""
WITH k AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<(h[1-6])[\\s>]')) AS headings, len(regexp_extract_all(html, '(?i)<(li)[\\s>]')) AS items, len(regexp_extract_all(html, '(?i)<(a)[\\s>]')) AS links, len(regexp_extract_all(html, '(?i)<(img)[\\s>]')) AS images FROM pages)
SELECT page_id % 10 AS part, sum(headings)::BIGINT AS headings, sum(items)::BIGINT AS items, sum(links)::BIGINT AS links, sum(images)::BIGINT AS images FROM k GROUP BY 1
""")
def render_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fragments hold, and the sums over several."""
    counted = load(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("part"), review.render_counts("html", F.lit("")).alias("c"))
    return review.merged_counts(counted, "c", ["part"]).select("part", "headings", "items", "links", "images")


@query(r"""
WITH s AS (SELECT 'c' || l_partkey AS url, l_orderkey * 10 + l_linenumber AS position, l_returnflag AS snippet FROM lineitem), j AS (SELECT url, string_agg(snippet, '' ORDER BY position, snippet) AS joined FROM s GROUP BY url)
SELECT p_partkey, coalesce(joined, '') AS contexts FROM part LEFT JOIN j ON url = 'c' || p_partkey
""")
def candidate_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippets of each candidate's address, in order."""
    snippets = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_returnflag").alias("snippet"))
    parts = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("url"))
    return review.with_contexts(parts, snippets).select("p_partkey", F.array_join("contexts", "").alias("contexts"))


@query("""
WITH e AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'browser' ELSE 'plain' END AS backend, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, event_id % 2) AS n, (event_type <> 'error')::INTEGER AS ok, greatest(1, value) AS ms FROM events WINDOW w AS (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id)),
s AS (SELECT user_id, backend, 0.6 * power(0.78, any_value(n)) + sum(ok * 0.22 * power(0.78, n - i)) AS success, 700 * power(0.78, any_value(n)) + sum(ms * 0.22 * power(0.78, n - i)) AS latency FROM e GROUP BY ALL),
c AS (SELECT user_id, backend, latency / greatest(0.15, success) AS cost FROM s)
SELECT c_custkey, coalesce(b.backend, 'plain') AS backend, round(b.cost, 4) AS cost FROM customer LEFT JOIN (SELECT user_id, arg_min(backend, cost) AS backend, min(cost) AS cost FROM c GROUP BY user_id) b ON b.user_id = c_custkey
""")
def crawl_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20, ST5, M13, J12: the cheaper backend of each host by what happened before."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.when(F.col("event_id") % 2 == 0, "browser").otherwise("plain").alias("backend"), "ts", "event_id", (F.col("event_type") != "error").cast("double").alias("ok"), F.greatest(F.lit(1.0), F.col("value")).alias("ms"))
    asked = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("host"))
    return fetching.crawl_routes(asked, e).select("c_custkey", "backend", F.round("cost", 4).alias("cost"))


@query("""
WITH t AS (SELECT l_partkey AS url, l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem),
a AS (SELECT url, min(d) FILTER (d <> '') AS d FROM t GROUP BY url)
SELECT p_partkey, coalesce(least(strftime(DATE '1994-01-01' + (p_partkey % 900)::INTEGER, '%Y-%m-%d'), a.d), '') AS published_date FROM part LEFT JOIN a ON a.url = p_partkey
""")
def merged_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier of a candidate's own date and its provider's."""
    from spindrift.functions import dates

    day = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    told = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(dates.earliest_of(day).alias("published_date"))
    own = load(spark, sf_dir, "part").select("p_partkey", F.date_format(F.date_add(F.lit("1994-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")), "yyyy-MM-dd").alias("published_date"))
    return merge.merge_dates(own, told, "p_partkey").select("p_partkey", "published_date")
