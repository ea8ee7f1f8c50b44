"""Passages of markdown pages: made in one pass over a page, scored with their headings, kept within a budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import scores as S
from spindrift.functions import text as T
from spindrift.operators.cuts import durable
from spindrift.operators.ranking import batch_scores

FENCE_LINE = re.compile(r"\s*(```|~~~)", re.ASCII)
HEADING_LINE = re.compile(r"\s{0,3}#{1,6}\s+\S", re.ASCII)


def page_passages(markdown: str, least_tokens: int) -> Iterator[tuple[str, str]]:
    """(heading, text) of each passage of a page, repeats dropped; the heading and the code fence are the state of the pass."""
    heading, code, seen = "", False, set()
    for raw in re.split("\r?\n", markdown):
        if FENCE_LINE.match(raw):
            code = not code
        elif not code and HEADING_LINE.match(raw):
            heading = T.plain_line(raw)
        elif not code and raw.strip(" "):
            row = raw.strip(" ")
            is_row = len(row) > 1 and row[0] == row[-1] == "|"
            for text in [T.plain_row(row)] if is_row else T.split_sentences(T.plain_line(raw)):
                key = T.folded(" ".join(text.split()))
                if text and key not in seen and (is_row or len(T.plain_tokens(text)) > least_tokens):
                    seen.add(key)
                    yield heading, text


def passages(pages: DataFrame, key: str, markdown: str = "markdown", least_tokens: int = 4) -> DataFrame:
    """key, order, heading and text: table rows and sentences of more than least_tokens tokens outside code, repeats on a page dropped.

    Nothing is shuffled: a page is one pass in an Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [list(page_passages(t, least_tokens)) if t else [] for t in batch.column(1).to_pylist()]
            at = [i for i, found in enumerate(made) for _ in found]
            order = [n for found in made for n in range(len(found))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(order, pa.int32()), pa.array([h for found in made for h, _ in found], pa.string()), pa.array([t for found in made for _, t in found], pa.string())], names=[key, "order", "heading", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, markdown).mapInArrow(run, f"`{key}` {kind}, order int, heading string, text string")


def rank_passages(made: DataFrame, queries: DataFrame, key: str, alpha: float = 0.35, least_score: float = 0.2, max_chars: int | None = 2000) -> DataFrame:
    """Passages (key, order, heading, text) of each page that answer its query, best first, within max_chars.

    A page's passages and distinct headings are one batch; a heading's score lifts the passages under it.
    """
    made = durable(made)
    heads = made.where("heading <> ''").groupBy(key, F.col("heading").alias("text")).agg(F.min("order").alias("at"))
    batch = made.select(key, F.struct(F.lit(0).alias("kind"), F.col("order").alias("at")).alias("item"), "text").unionByName(heads.select(key, F.struct(F.lit(1).alias("kind"), "at").alias("item"), "text"))
    scored = durable(batch_scores(batch, queries, [key], "item"))
    titles = scored.where("item.kind = 1").select(key, F.col("item.at").alias("at"), F.col("score").alias("title_score")).join(heads.withColumnRenamed("text", "heading"), [key, "at"]).select(key, "heading", "title_score")
    own = scored.where("item.kind = 0").select(key, F.col("item.at").alias("order"), "score")
    joined = made.join(own, [key, "order"]).join(titles, [key, "heading"], "left")
    boosted = joined.withColumn("score", F.round(S.title_boost(F.col("score"), F.coalesce("title_score", F.lit(0.0)), alpha), 9)).where(F.col("score") >= least_score)
    return within_budget(boosted.drop("title_score"), [key], [F.desc("score"), F.col("order")], "text", max_chars).withColumn("passage_id", F.concat(F.lit("S1:A"), F.col("rank")))


def within_budget(df: DataFrame, by: list[str], order: list, text: str, max_chars: int | None) -> DataFrame:
    """Rows with rank; the longest run of first ones whose texts, joined by newlines, stay within max_chars."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    if not max_chars or max_chars <= 0:
        return ranked
    used = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return ranked.withColumn("used_chars", used).where(F.col("used_chars") <= max_chars)
