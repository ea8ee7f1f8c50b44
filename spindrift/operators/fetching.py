"""Rules around fetching: guards, error tags, links beside a page, pacing, sections, crawl policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import scores as S
from spindrift.functions.text import clean_whitespace
from spindrift.operators.merge import first_of

#: Error codes and what their messages say.
MISSING_CODES = ("fetch_load_failed", "fetch_cache_miss")
LEAST_CHARS = 220
#: Sections of a page, in their order, and what each level of detail holds.
SECTION_ORDER = ("metadata", "header", "navigation", "banner", "body", "sidebar", "footer")
DETAILS = {"concise": ("metadata", "body"), "standard": ("metadata", "header", "body"), "full": SECTION_ORDER}


def error_tag(code: Column | str, message: Column | str) -> Column:
    """What kind of failure a code and its message tell of."""
    c, said = F.col(code) if isinstance(code, str) else code, F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))
    crawl = F.when(has("livecrawl") & has("timeout"), "CRAWL_LIVECRAWL_TIMEOUT").when(has("timeout", "timed out", "deadline"), "CRAWL_TIMEOUT").when(has("404", "not found"), "CRAWL_NOT_FOUND")
    return F.when(c.isin(*MISSING_CODES), "SOURCE_NOT_AVAILABLE").when(c == "fetch_crawl_failed", F.coalesce(crawl, F.lit("CRAWL_UNKNOWN_ERROR"))).otherwise("CRAWL_UNKNOWN_ERROR")


def url_guard(url: Column | str) -> Column:
    """'' for an http address, else why it cannot be fetched."""
    clean = clean_whitespace(url)
    return F.when(clean == "", "SOURCE_NOT_AVAILABLE").when(~F.lower(clean).rlike("^https?://"), "UNSUPPORTED_URL").otherwise("")


def content_guard(markdown: Column | str, least: int = LEAST_CHARS) -> Column:
    """'' for content of some length, else its error tag."""
    return F.when(F.length(clean_whitespace(markdown)) < least, "SOURCE_NOT_AVAILABLE").otherwise("")


def other_links(links: DataFrame, excluded: DataFrame, most_links: int | None, most_images: int | None) -> DataFrame:
    """(page, kind, place, url): links without fragments, then images, that are not excluded, each address once, the first few of each kind.

    links: page, kind (link or image), position, url; excluded: page, url. An address among the links that stay is no image.
    """
    clean = links.withColumn("url", F.when(F.col("kind") == "link", F.regexp_replace(F.trim("url"), "#.*$", "")).otherwise(F.trim("url"))).where("url <> ''")
    left = clean.join(excluded.distinct(), ["page", "url"], "left_anti")
    once = first_of(left, ["page", "kind", "url"], ["position"])

    def first_few(df: DataFrame, most: int | None) -> DataFrame:
        placed = df.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("position")))
        return placed if most is None else placed.where(F.col("place") <= most)

    kept = first_few(once.where("kind = 'link'"), most_links)
    images = first_few(once.where("kind = 'image'").join(kept.select("page", "url"), ["page", "url"], "left_anti"), most_images)
    return kept.unionByName(images).select("page", "kind", "place", "url")


def coalesced(requests: DataFrame, url: str = "url", order: str = "at") -> DataFrame:
    """Requests with the one that fetches for all of one address: the first; the others share its result."""
    leader = requests.groupBy(url).agg(F.min(order).alias("leader"))
    return requests.join(leader, url).withColumn("fetches", F.col(order) == F.col("leader"))


def paced(requests: DataFrame, delay_ms: int, host: str = "host", at: str = "at_ms", order: list[str] | None = None) -> DataFrame:
    """Requests with start_ms: not before they come, and delay_ms after the one before at the same host.

    In closed form: the k-th start of a host is the largest of at(j) + (k - j) * delay over j up to k.
    """
    w = Window.partitionBy(host).orderBy(at, *(order or []))
    place = F.row_number().over(w)
    lead = F.max(F.col(at) - F.col("_k") * delay_ms).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("_k", place).withColumn("start_ms", lead + F.col("_k") * delay_ms).drop("_k")


def sections(detail: str = "standard", include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """The sections that a request asks for, in their order; metadata stays."""
    wanted = {"metadata", *include} if include else set(DETAILS.get(detail, ("metadata", "body")))
    return [s for s in SECTION_ORDER if s in wanted and (s == "metadata" or s not in (exclude or []))]


def continues_plain(attempt: dict[str, Column], least_chars: int = 220, most_script: float = 0.35, useful: float = 0.4) -> Column:
    """Whether a plain crawl goes on after its first bytes. attempt: blocked, kind, chars, script_ratio, spa, nextjs, quality, prefers_browser."""
    a = attempt
    little, scripted = a["chars"] < least_chars, a["script_ratio"] >= most_script
    stops = (a["spa"] & (little | scripted)) | (a["nextjs"] & little) | (scripted & (a["quality"] < useful)) | (a["prefers_browser"] & (a["quality"] < 0.55))
    return F.when(a["blocked"], False).when(a["kind"] != "html", True).otherwise(~stops)


def browser_reason(attempt: dict[str, Column], least_chars: int = 220) -> Column:
    """Why a browser has to take over from a plain crawl."""
    a = attempt
    html = F.when(a["spa"], "spa").when(a["nextjs"], "nextjs").when(a["chars"] < least_chars, "low_text")
    return F.when(a["blocked"], "blocked").when(a["kind"] == "html", F.coalesce(html, F.lit("curl_unusable"))).otherwise("curl_unusable")


def crawl_routes(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """attempts (host, …) with the cheaper backend of their route's statistics; events: host, backend, ts, event_id, ok, ms."""
    from spindrift.operators.rerank import route_stats

    stats = route_stats(events, ["host", "backend"], [F.col("ts"), F.col("event_id")])
    cost = stats.withColumn("cost", S.route_score(F.col("success"), F.col("success"), F.col("latency")))
    best = cost.groupBy("host").agg(F.min_by("backend", F.struct("cost", "backend")).alias("backend"), F.min("cost").alias("cost"))
    return attempts.join(best, "host", "left").withColumn("backend", F.coalesce("backend", F.lit("plain")))
