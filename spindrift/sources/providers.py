"""Search providers as Python data sources.

A provider is a class with a name and `fetch(query, page, size, options)` that gives rows;
paging, retries, date bounds and limits are the reader's. Network access is a seam: the
providers here read a table, and one for a service registers under its own name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spindrift.functions.dates import in_range
from spindrift.functions.text import language_tag

SCHEMA = "query string, position int, url string, title string, snippet string, engine string, published_date string, pre_fetched_content string, pre_fetched_author string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class QueryPart(InputPartition):
    def __init__(self, query: str) -> None:
        super().__init__(query)
        self.query = query


class ProviderReader(DataSourceReader):
    def __init__(self, fetch: Callable, name: str, options: dict) -> None:
        self.fetch, self.name, self.options = fetch, name, dict(options)

    def partitions(self) -> list[InputPartition]:
        """One for each query, so that queries run beside each other."""
        return [QueryPart(q) for q in self.options.get("queries", "").split("\n") if q.strip()]

    def read(self, partition: QueryPart) -> Iterator[tuple]:
        limit, size = int(self.options.get("limit", 10)), int(self.options.get("page_size", 10))
        seen, page = set(), 0
        while len(seen) < limit:
            rows = self.attempt(partition.query, page, size)
            for row in rows:
                key = str(row.get("url", "")).casefold()
                if key and key not in seen and len(seen) < limit:
                    seen.add(key)
                    yield tuple({"query": partition.query, "position": len(seen), "engine": self.name, **{k: "" for k in FIELDS[2:] if k != "engine"}, **row}.get(k) for k in FIELDS)
            if len(rows) < size:
                return
            page += 1

    def attempt(self, query: str, page: int, size: int) -> list[dict]:
        """One page, tried retries + 1 times with a fixed delay."""
        tries = int(self.options.get("retries", 1)) + 1
        for n in range(tries):
            try:
                return self.fetch(query, page, size, self.options)
            except Exception:  # noqa: BLE001 - a service may fail in any way
                if n + 1 == tries:
                    raise
                time.sleep(int(self.options.get("delay_ms", 200)) / 1000)
        return []


def provider(name: str, fetch: Callable[[str, int, int, dict], list[dict]]) -> type[DataSource]:
    """A data source class that reads a service by fetch; register it with spark.dataSource.register."""

    def name_of(cls) -> str:
        return name

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ProviderReader(fetch, name, self.options)

    return type(f"{name.title()}Source", (DataSource,), {"name": classmethod(name_of), "schema": schema, "reader": reader})


def table_hits(docs: DataFrame, route: str) -> DataFrame:
    """A table of documents (doc_id, text, source) as a provider's hits: the first line is the title, the next the snippet."""
    lines = F.split("text", "\n")
    return docs.where(F.col("source") == route).select(
        F.concat(F.lit("https://"), "source", F.lit(".example.org/doc/"), F.col("doc_id").cast("string")).alias("url"), F.get(lines, F.lit(0)).alias("title"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("snippet"), F.lit("").alias("published_date"), "doc_id"
    )


def bounded(hits: DataFrame, start: str = "", end: str = "", undated: bool = False) -> DataFrame:
    return hits.where(in_range("published_date", start, end, undated))


def check_request(spark: SparkSession, language: str) -> str:
    """The language tag in its usual case; '' if it is no tag."""
    return spark.range(1).select(language_tag(F.lit(language))).first()[0]
