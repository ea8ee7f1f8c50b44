"""JSON rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import clean_whitespace, col


def stable(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; null fields stay as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def parsed(c: Column | str) -> Column:
    """A variant of the text, else of its part from the first { to the last }; null where neither is JSON."""
    return F.coalesce(F.try_parse_json(col(c)), F.try_parse_json(F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))))


def truthy(c: Column | str, default: bool = False) -> Column:
    text = F.lower(clean_whitespace(col(c).cast("string")))
    return F.when(text.isin("1", "true", "yes", "y", "on"), True).when(text.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def cache_key(backend: Column, url: Column) -> Column:
    return F.sha2(stable({"backend": backend, "url": url}), 256)


def valid(c: Column | str, schema: str) -> Column:
    """Whether the text is JSON of a DDL schema, nothing missing."""
    made = F.from_json(col(c), schema, {"mode": "PERMISSIVE"})
    return F.try_parse_json(col(c)).isNotNull() & made.isNotNull()


def limited(c: Column | str, items: int = 64, chars: int = 4000) -> Column:
    """A map<string,string> with at most so many entries and characters a value."""
    entries = F.slice(F.array_sort(F.map_entries(col(c))), 1, items)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.left(e["value"], F.lit(chars)))))
