"""What rounds of research are reviewed by: sources to read, findings, sections, texts to rank by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import clean_whitespace
from spindrift.operators.merge import first_of


def reviewable(content: Column | str, overview: Column | str) -> Column:
    text = lambda c: F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) != ""
    return text(content) | text(overview)


def sources_to_read(sources: DataFrame, asked: DataFrame, window: int, by: list[str]) -> DataFrame:
    """by, place and source_id: sources that are asked for by id, in that order, then the others in theirs, as many as the window holds.

    sources: by, position, source_id, content, overview; asked: by, at, source_id. Only sources with something to read count.
    """
    wanted = asked.groupBy(*by, "source_id").agg(F.min("at").alias("at"))
    rows = sources.where(reviewable("content", "overview")).join(wanted, [*by, "source_id"], "left")
    once = first_of(rows.select(*by, "source_id", F.struct(F.col("at").isNull().alias("unasked"), F.coalesce("at", "position").alias("n")).alias("rank")), [*by, "source_id"], ["rank"])
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "source_id")))
    return placed.where(F.col("place") <= max(1, window)).select(*by, "place", "source_id")


def section_tracks(sections: DataFrame, tracks: DataFrame) -> DataFrame:
    """section, place and question_id: a section's tracks by confidence, coverage, few conflicts and many findings."""
    named = sections.select("section", F.posexplode("question_ids").alias("at", "question_id")).join(tracks, "question_id")
    order = Window.partitionBy("section").orderBy(F.desc("confidence"), F.desc("coverage"), "conflicts", F.desc("findings"), "at")
    return named.withColumn("place", F.row_number().over(order)).select("section", "place", "question_id")


def findings(rounds: DataFrame, by: list[str], last: int = 8, most: int = 8) -> DataFrame:
    """by, place and finding: parts (between |) of the summaries of the last rounds, each once, the first few.

    rounds: by, round_index, overview_summary, content_summary.
    """
    recent = rounds.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("round_index")))).where(F.col("back") <= last)
    texts = F.array(F.struct(F.lit(0).alias("part"), F.col("overview_summary").alias("text")), F.struct(F.lit(1).alias("part"), F.col("content_summary").alias("text")))
    said = recent.select(*by, "round_index", F.explode(texts).alias("t")).select(*by, "round_index", "t.part", F.posexplode(F.split("t.text", r"\|")).alias("at", "finding"))
    clean = said.withColumn("finding", F.trim("finding")).where("finding <> ''").withColumn("same", F.lower("finding"))
    once = first_of(clean.withColumn("order", F.struct("round_index", "part", "at")), [*by, "same"], ["order"])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("order"))).where(F.col("place") <= most).select(*by, "place", "finding")


def history(rounds: DataFrame, by: list[str]) -> DataFrame:
    """by, rounds, open (unresolved and insufficient conflicts) and searches of what was done so far."""
    counted = F.sum(F.size(F.filter("conflicts", lambda c: c.isin("unresolved", "insufficient"))))
    return rounds.groupBy(*by).agg(F.count("*").alias("rounds"), counted.alias("open"), F.sum(F.size("queries")).alias("searches"))


def source_text(title: Column | str, url: Column | str, overview: Column | str, content: Column | str) -> Column:
    """What a research source is ranked by."""
    raw = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("title="), raw(title)), F.concat(F.lit("url="), raw(url)), F.concat(F.lit("overview="), clean_whitespace(overview)), F.concat(F.lit("content="), clean_whitespace(content)))


def link_text(text: Column | str, url: Column | str) -> Column:
    """What a link is ranked by."""
    said = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("text="), F.coalesce(F.nullif(said, F.lit("")), F.lit("(none)")), F.lit("; url="), F.col(url) if isinstance(url, str) else url)


def merged_in_order(*lists: Column) -> Column:
    """Ordered union of arrays, each text once whatever its case."""
    every = F.concat(*lists)
    keys = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def mean_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def with_contexts(candidates: DataFrame, snippets: DataFrame) -> DataFrame:
    """Candidates (url) with the snippets of their address, in order; none as an empty array."""
    listed = snippets.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "snippet"))), lambda s: s["snippet"]).alias("contexts"))
    return candidates.join(listed, "url", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def render_counts(html: Column | str, markdown: Column | str) -> Column:
    """How many headings, list items, links, images, table rows and code blocks a fragment has, and how much of its text the markdown keeps."""
    said = F.col(html) if isinstance(html, str) else html
    tags = lambda p: F.regexp_count(said, F.lit(rf"(?i)<({p})[\s>]")).cast("long")
    source = F.length(clean_whitespace(F.regexp_replace(said, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]+>", " ")))
    kept = F.length(F.col(markdown) if isinstance(markdown, str) else markdown)
    recall = F.when(source == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), kept / source)))
    return F.struct(tags("h[1-6]").alias("headings"), tags("li").alias("items"), tags("a").alias("links"), tags("img").alias("images"), tags("tr").alias("rows"), tags("pre").alias("code_blocks"), recall.alias("recall"))


def merged_counts(df: DataFrame, counts: str, by: list[str]) -> DataFrame:
    """Counts of several fragments as their sums, the share of kept text as its mean."""
    names = ("headings", "items", "links", "images", "rows", "code_blocks")
    return df.groupBy(*by).agg(*[F.sum(f"{counts}.{n}").alias(n) for n in names], F.coalesce(F.avg(f"{counts}.recall"), F.lit(1.0)).alias("recall"))
