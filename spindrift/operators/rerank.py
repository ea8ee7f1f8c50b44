"""Reranking fetched candidates by page and context signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import scores as S
from spindrift.functions.text import clean_whitespace, dedupe_key, fold
from spindrift.operators.ranking import rank_batches


def passes_text(text: Column | str, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """All of include and none of exclude as parts of the text, in folded case."""
    hay = dedupe_key(text)
    fit = lambda xs: F.array(*[F.lit(" ".join(x.split()).casefold()) for x in xs])
    ok = F.lit(True)
    if include:
        ok &= F.forall(fit(include), lambda x: F.contains(hay, x))
    if exclude:
        ok &= ~F.exists(fit(exclude), lambda x: F.contains(hay, x))
    return ok


def merged_abstracts(abstracts: Column | str) -> Column:
    """Distinct texts (folded) of an array in order, one on each line."""
    clean = F.filter(F.transform(F.coalesce(abstracts if isinstance(abstracts, Column) else F.col(abstracts), F.array().cast("array<string>")), clean_whitespace), lambda t: t != "")
    keys = F.transform(clean, fold)
    return F.array_join(F.filter(clean, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1), "\n")


def context_documents(candidates: DataFrame, limit: int = 18, least_chars: int = 16) -> DataFrame:
    """(candidate, at, text): snippets, then abstracts of at least least_chars, repeats dropped, the first `limit`.

    candidates: candidate, snippets array<string>, abstracts array<string>.
    """
    tagged = F.concat(F.transform(F.coalesce("snippets", F.array().cast("array<string>")), lambda t: F.struct(F.lit(0).alias("least"), clean_whitespace(t).alias("text"))), F.transform(F.coalesce("abstracts", F.array().cast("array<string>")), lambda t: F.struct(F.lit(least_chars).alias("least"), clean_whitespace(t).alias("text"))))
    rows = candidates.select("candidate", F.posexplode(tagged).alias("at", "x")).select("candidate", "at", "x.text", "x.least").where((F.col("text") != "") & (F.length("text") >= F.col("least")))
    first = rows.withColumn("same", fold("text")).withColumn("n", F.row_number().over(Window.partitionBy("candidate", "same").orderBy("at"))).where("n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("candidate").orderBy("at"))).where(F.col("rank") <= limit).select("candidate", F.col("rank").alias("at"), "text")


def context_scores(documents: DataFrame, queries: DataFrame, batch: list[str]) -> DataFrame:
    """Mean score of each candidate's documents, all documents of a batch scored together."""
    scored = rank_batches(documents.withColumn("item", F.struct("candidate", "at")), queries, batch, "item")
    return scored.groupBy(*batch, "candidate").agg(F.avg("score").alias("context_score"))


def final_scores(candidates: DataFrame, pages: DataFrame, contexts: DataFrame | None, use_pages: bool = True) -> DataFrame:
    """candidates with the largest page score of main and sub pages, the context score, and their mean."""
    best = pages.groupBy("candidate").agg(F.max("page_score").alias("page_score"))
    out = candidates.join(best, "candidate", "left").withColumn("page_score", F.coalesce("page_score", F.lit(0.0)) if use_pages else F.lit(0.0))
    if contexts is not None:
        out = out.join(contexts, "candidate", "left").withColumn("context_score", F.coalesce("context_score", F.lit(0.0)))
    else:
        out = out.withColumn("context_score", F.lit(0.0))
    parts = [F.col("page_score")] * use_pages + [F.col("context_score")] * (contexts is not None)
    return out.withColumn("final_score", S.mean_of(parts))


def finalize(candidates: DataFrame, limit: int, by_score: bool = True) -> DataFrame:
    """The first `limit` by score, then order; by order alone without a score."""
    order = [F.desc("final_score"), F.col("order")] if by_score else [F.col("order")]
    return candidates.orderBy(*order).limit(limit)


def rank_stats(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.sum("page_score").alias("page_sum"), F.sum("context_score").alias("context_sum"), F.count("*").alias("n"))


def route_stats(events: DataFrame, by: list[str], order: list[Column], success: float = 0.60, latency: float = 700.0, rate: float = S.LEARNING_RATE) -> DataFrame:
    """Moving averages of ok and ms over the events of a route in their order, by their closed form: the k-th last value weighs rate * (1 - rate)^k.

    Values beyond the last few hundred weigh nothing that a double holds, so the sums are partial aggregates.
    """
    back = F.row_number().over(Window.partitionBy(*by).orderBy(*[c.desc() for c in order])) - 1
    weighed = events.withColumn("_w", F.pow(F.lit(1 - rate), back) * rate)
    out = weighed.groupBy(*by).agg(F.count("*").alias("samples"), F.sum(F.col("ok") * F.col("_w")).alias("ok"), F.sum(F.col("ms") * F.col("_w")).alias("ms"))
    left = F.pow(F.lit(1 - rate), F.col("samples"))
    return out.select(*by, "samples", (left * success + F.col("ok")).alias("success"), (left * latency + F.col("ms")).alias("latency"))
