"""Caches and ledgers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.json import cache_key
from spindrift.operators.merge import first_of


def live(cache: DataFrame, now_ms: int) -> DataFrame:
    """Entries that have not expired; one that expires now has."""
    return cache.where(F.col("expires_at_ms") > now_ms)


def upsert(cache: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """The cache with the new entries in place of old ones, expired entries purged."""
    tagged = new.withColumn("age", F.lit(0)).unionByName(live(cache, now_ms).withColumn("age", F.lit(1)))
    return first_of(tagged, ["namespace", "key"], ["age"]).drop("age")


def fetch_entries(crawled: DataFrame, now_ms: int, ttl_s: int = 86_400) -> DataFrame:
    """Cache rows of crawl results (backend, url, content binary, …): sorted compact JSON, content as hex."""
    body = F.struct(F.lower(F.hex("content")).alias("content_hex"), F.col("content_type"), F.col("status_code"), F.col("url"))
    return crawled.select(F.lit("fetch").alias("namespace"), cache_key(F.col("backend"), F.col("url")).alias("key"), F.lit(now_ms + ttl_s * 1000).alias("expires_at_ms"), F.to_json(body).cast("binary").alias("value"))


def ledger(records: DataFrame) -> DataFrame:
    """Records, each key once (the earliest); a blank key falls back to the id."""
    keyed = records.withColumn("key", F.coalesce(F.nullif(F.trim("key"), F.lit("")), "id"))
    return first_of(keyed, ["key"], ["ts_ms", "id"])


def token_usage(records: DataFrame) -> DataFrame:
    """Tokens by request and model; missing and negative counts are 0."""
    count = lambda c: F.sum(F.greatest(F.coalesce(F.col(f"tokens.{c}"), F.lit(0)), F.lit(0))).alias(c)
    return records.groupBy("request_id", "model").agg(count("prompt_tokens"), count("completion_tokens"), count("total_tokens"))


LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def at_least(events: DataFrame, level: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.upper("level"))
    return events.where(rank >= LEVELS.index(level.upper()) + 1)


def write_json_lines(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def task_page(tasks: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Tasks by creation time and id, newest first, one page of 1 to 50."""
    return tasks.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(50, max(1, limit)))
