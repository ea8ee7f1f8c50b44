"""Recorded answers of search services as hits, declared as paths into JSON and read natively.

A service is a value: where its records are, and for every field of a hit the paths that
may hold it. Reading is one projection over a VARIANT column, so a scan of recorded
answers (or a DataSource that fetches them) needs no Python for parsing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import dates
from spindrift.functions.text import clean_whitespace, inverted_index_text, strip_html


@dataclass(frozen=True)
class Part:
    """A part of a snippet: the first path that holds something, or all values of an array, the first `most` of them."""

    paths: tuple[str, ...]
    label: str = ""
    each: str | None = None
    most: int = 4
    markup: bool = False
    unit: str = ""
    fallback: bool = False


@dataclass(frozen=True)
class Service:
    """records: path of the array; base: what relative addresses are under; each field: paths in order of preference."""

    name: str
    records: str
    url: tuple[str, ...]
    title: tuple[str, ...]
    snippet: tuple[Part, ...] = ()
    date: tuple[str, ...] = ()
    base: str = ""
    needs_title: bool = True
    content: tuple[str, ...] = ()
    authors: Part | None = None
    index: str | None = None
    epoch: bool = False
    unique: bool = False
    pictures_first: str | None = None


#: Where the services' answers hold what a hit needs.
SERVICES = {
    s.name: s
    for s in (
        Service("github", "$.items", ("$.html_url",), ("$.full_name", "$.name"), (Part(("$.language",)), Part(("$.description",))), ("$.created_at",), needs_title=False),
        Service("marginalia", "$.results", ("$.url",), ("$.title",), (Part(("$.description",)), Part(("$.details",)))),
        Service("openalex", "$.results", ("$.primary_location.landing_page_url", "$.id"), ("$.title",), (Part(("$.authorships",), "Authors: ", "$.author.display_name"), Part(("$.primary_location.source.display_name", "$.host_venue.display_name")), Part(("$.concepts",), "Topics: ", "$.display_name"), Part(("$.cited_by_count",), unit=" citations")), ("$.publication_date",), authors=Part(("$.authorships",), each="$.author.display_name", most=5), index="$.abstract_inverted_index"),
        Service("reddit", "$.data.children", ("$.data.permalink",), ("$.data.title",), (Part(("$.data.subreddit_name_prefixed",)), Part(("$.data.selftext",)), Part(("$.data.domain",), fallback=True)), ("$.data.created_utc",), base="https://www.reddit.com", epoch=True, unique=True, pictures_first="$.data.thumbnail"),
        Service("reuters", "$.result.articles", ("$.canonical_url",), ("$.web",), (Part(("$.kicker.name",)), Part(("$.description",))), ("$.display_time",), base="https://www.reuters.com"),
        Service("searxng", "$.results", ("$.url",), ("$.title",), (Part(("$.content", "$.description")),), ("$.publishedDate", "$.published_date", "$.published", "$.pubdate", "$.created_at", "$.date"), needs_title=False),
        Service("semantic_scholar", "$.results", ("$.primaryPaperLink.url", "$.links[0]", "$.alternatePaperLinks[0].url"), ("$.title.text",), (Part(("$.paperAbstract.text",), markup=True), Part(("$.authors",), "Authors: ", "$[0].name"), Part(("$.venue.text", "$.journal.name")), Part(("$.fieldsOfStudy",), "Fields: ", "$")), ("$.pubDate",), content=("$.paperAbstract.text",), authors=Part(("$.authors",), each="$[0].name", most=5)),
        Service("wikidata", "$.results.bindings", ("$.officialWebsites.value", "$.articleLocals.value", "$.articleEns.value", "$.item.value"), ("$.itemLabel.value",), (Part(("$.itemDescription.value",)),), unique=True),
        Service("wikipedia", "$.pages", ("$.content_urls.desktop.page",), ("$.title",), (Part(("$.extract", "$.excerpt", "$.description"), markup=True),), ("$.timestamp",), unique=True),
    )
}
HIT = "array<struct<url:string,title:string,snippet:string,published_date:string,pre_fetched_content:string,pre_fetched_author:string,picture:boolean>>"


def first_text(record: Column, paths: tuple[str, ...], markup: bool = False) -> Column:
    """The first of the paths that holds a text, clean; '' if none does."""
    texts = [clean_whitespace(F.try_variant_get(record, p, "string")) for p in paths]
    return F.coalesce(*[F.nullif(strip_html(t) if markup else t, F.lit("")) for t in texts], F.lit("")) if texts else F.lit("")


def part_text(record: Column, part: Part) -> Column:
    if part.each is None:
        found = first_text(record, part.paths, part.markup)
        return F.when(found != "", F.concat(F.lit(part.label), found, F.lit(part.unit))).otherwise("")
    values = F.coalesce(F.try_variant_get(record, part.paths[0], "array<variant>"), F.array().cast("array<variant>"))
    named = F.slice(F.filter(F.transform(values, lambda v: clean_whitespace(F.try_variant_get(v, part.each, "string"))), lambda v: v != ""), 1, part.most)
    return F.when(F.size(named) > 0, F.concat(F.lit(part.label), F.array_join(named, ", "))).otherwise("")


def hits_of(payload: Column, service: Service) -> Column:
    """The hits of one answer, in its order, as an array of structs."""
    records = F.coalesce(F.try_variant_get(F.try_parse_json(payload), service.records, "array<variant>"), F.array().cast("array<variant>"))

    def hit(r: Column) -> Column:
        url = first_text(r, service.url)
        url = F.when((url == "") | url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).otherwise(F.concat(F.lit(service.base), url)) if service.base else url
        abstract = clean_whitespace(inverted_index_text(F.try_variant_get(r, service.index, "map<string,array<int>>"))) if service.index else first_text(r, service.content, True)
        own = [abstract] if service.index else []
        said = F.filter(F.array(*own, *[part_text(r, p) for p in service.snippet if not p.fallback]), lambda x: x != "")
        spare = [part_text(r, p) for p in service.snippet if p.fallback]
        snippet = F.when(F.size(said) > 0, F.array_join(said, " / ")).otherwise(spare[0] if spare else F.lit(""))
        date = dates.epoch(F.try_variant_get(r, service.date[0], "double").cast("long")) if service.epoch else F.coalesce(*[F.nullif(dates.normalized(first_text(r, (p,))), F.lit("")) for p in service.date], F.lit("")) if service.date else F.lit("")
        picture = F.coalesce(F.lower(F.try_variant_get(r, service.pictures_first, "string")).rlike("^https?://"), F.lit(False)) if service.pictures_first else F.lit(False)
        author = part_text(r, service.authors) if service.authors else F.lit("")
        return F.struct(url.alias("url"), first_text(r, service.title).alias("title"), snippet.alias("snippet"), F.coalesce(date, F.lit("")).alias("published_date"), F.coalesce(abstract, F.lit("")).alias("pre_fetched_content"), author.alias("pre_fetched_author"), picture.alias("picture"))

    made = F.filter(F.transform(records, hit), lambda h: (h["url"] != "") & ((h["title"] != "") | F.lit(not service.needs_title)))
    if service.unique:
        keys = F.transform(made, lambda h: F.lower(h["url"]))
        made = F.filter(made, lambda h, i: F.array_position(keys, F.lower(h["url"])) == i + 1)
    if service.pictures_first:
        made = F.concat(F.filter(made, lambda h: h["picture"]), F.filter(made, lambda h: ~h["picture"]))
    return made.cast(HIT)


def recorded_hits(payloads: DataFrame, service: str, keep: list[str], payload: str = "payload") -> DataFrame:
    """keep, position (from 1) and the hits of recorded answers of a service."""
    made = payloads.select(*keep, F.posexplode(hits_of(F.col(payload), SERVICES[service])).alias("at", "hit"))
    return made.select(*keep, F.lit(service).alias("engine"), (F.col("at") + 1).alias("position"), "hit.url", "hit.title", "hit.snippet", "hit.published_date", "hit.pre_fetched_content", "hit.pre_fetched_author")


ENTRY = "struct<title:string,id:string,summary:string,published:string,author:array<struct<name:string>>>"


def atom_hits(feeds: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """keep, position and the hits of Atom feeds (arxiv): summary and up to four authors as the snippet."""
    read = feeds.select(*keep, F.from_xml(payload, f"entry array<{ENTRY}>", {"rowTag": "feed"})["entry"].alias("entries"))
    e = read.select(*keep, F.posexplode("entries").alias("at", "e")).select(*keep, "at", *[clean_whitespace(f"e.{c}").alias(c) for c in ("title", "id", "summary", "published")], F.filter(F.transform(F.coalesce("e.author", F.array().cast("array<struct<name:string>>")), lambda a: clean_whitespace(a["name"])), lambda n: n != "").alias("names"))
    said = F.array_join(F.filter(F.array("summary", F.when(F.size("names") > 0, F.concat(F.lit("Authors: "), F.array_join(F.slice("names", 1, 4), ", "))).otherwise("")), lambda x: x != ""), " / ")
    return e.where("title <> '' and id <> ''").select(*keep, F.lit("arxiv").alias("engine"), (F.col("at") + 1).alias("position"), F.col("id").alias("url"), "title", said.alias("snippet"), F.coalesce(dates.normalized("published"), F.lit("")).alias("published_date"), F.col("summary").alias("pre_fetched_content"), F.array_join(F.slice("names", 1, 5), ", ").alias("pre_fetched_author"))


def with_summaries(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """Hits (title, url, snippet, …) with the address and extract of their summary by title where there is one (wikipedia)."""
    known = summaries.select("title", F.col("url").alias("summary_url"), F.col("extract").alias("summary"))
    joined = hits.join(known, "title", "left")
    return joined.withColumns({"url": F.coalesce(F.nullif("summary_url", F.lit("")), "url"), "snippet": F.coalesce(F.nullif(clean_whitespace("summary"), F.lit("")), "snippet")}).drop("summary_url", "summary")


def created_range(query: str, start: str = "", end: str = "") -> str:
    """A repository query with its date bounds as qualifiers, which the service applies itself."""
    return " ".join(x for x in (" ".join(query.split()), f"created:>={start}" if start else "", f"created:<{end}" if end else "") if x)


def pages_until(pages: DataFrame, by: list[str], size: int) -> DataFrame:
    """Hits of pages (by, page, …) up to the first short page of each query: what a paging reader would have read."""
    from pyspark.sql import Window

    counts = pages.groupBy(*by, "page").agg(F.count("*").alias("n"))
    full = F.min(F.when(F.col("n") < size, F.col("page"))).over(Window.partitionBy(*by))
    ends = counts.select(*by, "page", F.coalesce(full, F.max("page").over(Window.partitionBy(*by))).alias("last")).where("page <= last").drop("last")
    return pages.join(ends, [*by, "page"])
