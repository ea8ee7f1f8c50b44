"""Merging hits of several sources: union, first wins by canonical address, one row for each address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import dates, scores as S
from spindrift.functions.text import clean_whitespace, fold, snippet_or_title, strip_html
from spindrift.functions.urls import canonical_url, domain, domain_allowed
from spindrift.operators.ranking import rank_batches


def union_routes(routes: dict[str, DataFrame], include: list[str] | None = None, exclude: list[str] | None = None, default: list[str] | None = None) -> DataFrame:
    """Hits of the chosen routes one after the other, with route and route_order; default counts if neither list is given."""
    names = [n for n in routes if (n in include if include else n not in (exclude or []))]
    if not include and not exclude and default:
        names = [n for n in routes if n in default]
    tagged = [routes[n].withColumns({"route": F.lit(n), "route_order": F.lit(i)}) for i, n in enumerate(names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with one key the first in the order, as a partial aggregate: hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*key, "row.*").select(*df.columns)


def address_key(url: Column | str) -> Column:
    made = canonical_url(url)
    return F.when(made == "", fold(url)).otherwise(made)


def normalize_hits(hits: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Hits with an address in an allowed domain, cleaned, with canonical_url."""
    url = clean_whitespace("url")
    kept = hits.where((url != "") & domain_allowed(domain(url), include, exclude))
    return kept.withColumns({"url": url, "canonical_url": canonical_url(url), "title": clean_whitespace(strip_html("title")), "snippet": clean_whitespace(strip_html("snippet")), "published_date": clean_whitespace("published_date")})


def blend_hits(hits: DataFrame, queries: DataFrame, limit: int | None, original_weight: float = 0.5) -> DataFrame:
    """Hits (query_id, route_order, position, url, title, snippet) without repeats, by lexical score and reciprocal rank."""
    keyed = hits.withColumn("key", address_key("url"))
    merged = first_of(keyed, ["query_id", "key"], ["route_order", "position"])
    w = Window.partitionBy("query_id")
    merged = merged.withColumn("index", F.row_number().over(w.orderBy("route_order", "position")) - 1).withColumn("text", F.concat_ws(" ", "title", "title", "snippet"))
    scored = rank_batches(merged, queries, ["query_id"], "index")
    score = (1 - original_weight) * S.over_max(F.col("score"), ["query_id"]) + original_weight * S.over_max(S.reciprocal_rank(F.col("position")), ["query_id"]) if original_weight > 0 else F.col("score")
    ranked = scored.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "index")))
    return ranked.where(F.col("rank") <= max(1, limit)) if limit is not None else ranked


def canonical_buckets(hits: DataFrame) -> DataFrame:
    """One row for each canonical_url of hits (job_index, source, position, url, …): the first hit's address, jobs, earliest date, first snippet for each source."""
    order = F.struct("job_index", "position")
    one = hits.withColumns({"order": order, "said": snippet_or_title("snippet", "title")})
    per_source = one.where("said <> ''").groupBy("canonical_url", "source").agg(F.min_by("said", "order").alias("snippet"), F.min("order").alias("order"))
    snippets = per_source.groupBy("canonical_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "source", "snippet"))), lambda s: F.struct(s["source"].alias("source"), s["snippet"].alias("snippet"))).alias("snippets"))
    at, by_day = dates.instant("published_date"), dates.is_date_only("published_date")
    key = F.when(at.isNotNull(), F.struct(at.alias("at"), F.when(by_day, -1).otherwise(-2).alias("precision"), dates.normalized("published_date").alias("text")))
    grouped = one.groupBy("canonical_url").agg(F.min_by("url", "order").alias("url"), F.min("order").alias("order"), F.count_distinct("job_index").alias("n_jobs"), F.coalesce(F.min(key)["text"], F.lit("")).alias("published_date"))
    return grouped.join(snippets, "canonical_url", "left")


def prefetch_limit(results: int, multiplier: float, most: int) -> int:
    from math import ceil

    return max(1, results, min(most, ceil(results * multiplier)))


def merge_dates(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the earlier of its and right's published_date."""
    other = right.select(key, F.col("published_date").alias("other"))
    both = F.array(F.coalesce("published_date", F.lit("")), F.coalesce("other", F.lit("")))
    return left.join(other, key, "left").withColumn("published_date", dates.earliest(both)).drop("other")


def dedupe_queries(jobs: DataFrame, extra: int) -> DataFrame:
    """Jobs (job_index, query, source) without repeated queries or token sets; at most `extra` that are not primary. A driver-sized table."""
    from spindrift.functions.text import tokenize

    exact = first_of(jobs.withColumn("key", fold(clean_whitespace("query"))).where("key <> ''"), ["key"], ["job_index"])
    signed = exact.withColumn("signature", F.array_join(F.array_sort(tokenize("query")), " "))
    free = signed.where("signature = ''")
    one = first_of(signed.where("signature <> ''"), ["signature"], ["job_index"]).unionByName(free)
    counted = one.withColumn("n", F.sum(F.when(F.col("source") != "primary", 1).otherwise(0)).over(Window.partitionBy(F.lit(0)).orderBy("job_index")))
    return counted.where((F.col("source") == "primary") | (F.col("n") <= extra)).select(jobs.columns)
