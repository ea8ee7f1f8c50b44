"""Budgets: shares by priority, page slots, prompt texts, mixes of new and old sources."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import clean_whitespace, fold


def allocate(cards: DataFrame, total: int, protected: int, key: str = "question_id", priority: str = "priority", by: list[str] | None = None) -> DataFrame:
    """cards with floor and allocation: a protected floor each, the rest by priority, what is left over by the largest remainder."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)]))
    n, whole = F.count("*").over(w), F.lit(max(total, 0))
    floor = F.least(F.lit(max(0, protected)), F.floor(whole / n)).cast("int")
    first = cards.withColumns({"floor": floor, "n": n, "sum": F.sum(priority).over(w)})
    rest = whole - F.col("floor") * F.col("n")
    share = rest * F.col(priority) / F.when(F.col("sum") > 0, F.col("sum")).otherwise(F.col("n"))
    second = first.withColumns({"extra": F.floor(share).cast("int"), "fraction": F.round(share - F.floor(share), 9)})
    left = rest - F.sum("extra").over(w)
    place = F.row_number().over(w.orderBy(F.desc("fraction"), F.desc(priority), "order"))
    return second.withColumn("allocation", F.col("floor") + F.col("extra") + F.when(place <= left, 1).otherwise(0)).select(*cards.columns, "floor", "allocation")


def page_slots(pages: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """Pages (candidate, sub: 0 for the main page) with selected: main pages first in order, then subpages in turn, while the budget lasts.

    A subpage counts only where its main page was selected.
    """
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)]))
    main = F.dense_rank().over(w.orderBy("candidate")) <= max(budget, 0)
    eligible = pages.withColumn("main_in", main)
    turn = F.sum(F.col("main_in").cast("int")).over(w.orderBy("sub", "candidate").rowsBetween(Window.unboundedPreceding, 0))
    return eligible.withColumn("selected", F.col("main_in") & (turn <= max(budget, 0))).drop("main_in")


def prompt_texts(sources: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """sources (by, source, abstracts) gathered per question: the abstracts that fit the budget of characters.

    Texts repeat once over all sources; an abstract that overflows ends its source, later ones may still fit; the very
    first may be cut. The state depends on what was taken before, so it is one fold over a question's abstracts.
    """
    items = sources.select(*by, "source", F.posexplode("abstracts").alias("at", "text"))
    first = items.withColumns({"same": fold(clean_whitespace("text")), "place": F.struct("source", "at")}).where("same <> ''")
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "same", "text"))).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).cast("long").alias("closed"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<source:long,text:string>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        source = x["place"]["source"].cast("long")
        left = F.lit(budget) - acc["used"]
        done = (F.lit(budget) > 0) & (acc["used"] >= budget)
        skip = done | (acc["closed"] == source) | F.array_contains(acc["seen"], x["same"])
        over = (F.lit(budget) > 0) & (F.length(x["text"]) > left)
        cut = over & (acc["used"] == 0)
        text = F.when(cut, clean_whitespace(F.left(x["text"], F.lit(budget)))).otherwise(x["text"])
        closes = ~skip & over & (~cut | (text == ""))
        takes = ~skip & ~closes
        return F.struct(
            F.when(takes, acc["used"] + F.length(text)).otherwise(acc["used"]).alias("used"),
            F.when(closes, source).otherwise(acc["closed"]).alias("closed"),
            F.when(takes, F.array_append(acc["seen"], x["same"])).otherwise(acc["seen"]).alias("seen"),
            F.when(takes, F.array_append(acc["kept"], F.struct(source.alias("source"), text.alias("text")))).otherwise(acc["kept"]).alias("kept"),
        )

    folded = listed.withColumn("out", F.aggregate("items", start, step))
    return folded.select(*by, F.col("out.used").alias("used_chars"), F.posexplode("out.kept").alias("at", "item")).select(*by, "used_chars", "at", "item.source", "item.text")


def new_and_old(sources: DataFrame, newest: int, limit: int, ratio: float, least_old: int) -> DataFrame:
    """Of ranked sources (rank, round_index) the mix of the newest round's and earlier ones, in rank order."""
    target = min(limit, ceil(limit * ratio))
    w = Window.partitionBy(F.lit(0))
    is_new = F.col("round_index") == newest
    tagged = sources.withColumns({"is_new": is_new, "n_new": F.sum(is_new.cast("int")).over(w), "n_old": F.sum((~is_new).cast("int")).over(w)})
    placed = tagged.withColumn("place", F.row_number().over(Window.partitionBy("is_new").orderBy("rank")))
    old = F.least(F.col("n_old"), F.greatest(F.lit(limit) - F.least(F.lit(target), F.col("n_new")), F.least(F.lit(least_old), F.lit(limit))))
    take = F.when(F.col("is_new"), F.least(F.col("n_new"), F.lit(limit) - old)).otherwise(old)
    return placed.where(F.col("place") <= take).select(sources.columns)


def extension(original: int, level: str) -> int:
    """Extra budget that a track may ask for once."""
    return ceil(original * {"low": 0.2, "medium": 0.4, "high": 0.6}[level])


def reserve(quota: int, left: int, per_round: int) -> int:
    return max(0, min(quota, left, per_round))


def settle(reserved: int, used: int) -> tuple[int, int]:
    """(used, given back) of a reservation."""
    spent = max(0, min(used, reserved))
    return spent, reserved - spent


def reclaim(freed: int, waiting: int) -> list[int]:
    """Freed budget in equal shares for those that wait, the first ones one more."""
    return [freed // waiting + (i < freed % waiting) for i in range(waiting)] if waiting > 0 else []
