"""The research corpus: appending new sources, finding known ones, ordering and pairing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.merge import first_of
from spindrift.operators.numbering import numbered


def merge_corpus(target: DataFrame, found: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(sources to append with new ids, map of found ids to corpus ids).

    Both have source_id and canonical_url. An address that the corpus has maps to its first id there; others are
    appended once, numbered from next_id in the order of their found ids.
    """
    known = target.groupBy("canonical_url").agg(F.min("source_id").alias("corpus_id"))
    fresh = first_of(found.join(known, "canonical_url", "left_anti"), ["canonical_url"], ["source_id"])
    added = numbered(fresh, [], [F.col("source_id")], "nth").withColumn("new_id", F.col("nth") - 1 + next_id).drop("nth")
    ids = known.unionByName(added.select("canonical_url", F.col("new_id").alias("corpus_id")))
    remap = found.select("source_id", "canonical_url").join(ids, "canonical_url").select("source_id", "corpus_id")
    return added.withColumn("source_id", F.col("new_id")).drop("new_id"), remap


def ids_by_address(sources: DataFrame) -> DataFrame:
    return sources.groupBy("canonical_url").agg(F.sort_array(F.collect_list("source_id")).alias("source_ids"))


def pick_by_ids(sources: DataFrame, asked: DataFrame, ids: str = "ids") -> DataFrame:
    """Sources of an array of ids, in its order with `at`; unknown ids are dropped."""
    return asked.select(F.posexplode(ids).alias("at", "source_id")).join(sources, "source_id").orderBy("at")


def pair_in_order(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th row of a key on the left beside the k-th on the right; rows without a partner stay on the left."""
    nth = lambda df, order: df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return nth(left, left_order).join(nth(right, right_order), [key, "nth"], "left").drop("nth")


def canonical_first(sources: DataFrame) -> DataFrame:
    """The best source of each address by (score, round, id) descending."""
    return first_of(sources.withColumn("_rank", F.struct(-F.col("score"), -F.col("round_index"), -F.col("source_id"))), ["canonical_url"], ["_rank"]).drop("_rank")


def rerank_order(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("rank_score"), F.desc("score"), F.desc("round_index"), "source_id")


def page_sources(rows: DataFrame) -> DataFrame:
    """One source for each url_key of rows (url_key, order, url, title, content, abstract): first non-empty values, distinct abstracts in order."""
    filled = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("order")))
    once = rows.where("abstract <> ''").groupBy("url_key", "abstract").agg(F.min("order").alias("order"))  # repeats go before anything is gathered
    listed = once.groupBy("url_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "abstract"))), lambda x: x["abstract"]).alias("abstracts"))
    fields = rows.groupBy("url_key").agg(F.min("order").alias("first_order"), F.min_by("url", "order").alias("url"), F.coalesce(filled("title"), F.lit("")).alias("title"), F.coalesce(filled("content"), F.lit("")).alias("content"))
    return fields.join(listed, "url_key", "left").withColumn("abstracts", F.coalesce("abstracts", F.array().cast("array<string>")))


def citations(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """Cited sources (answer_id, source_index, key, url) of answers (answer_id, indexes): unknown numbers dropped, each key once, in order."""
    cited = answers.select("answer_id", F.posexplode("indexes").alias("at", "source_index")).join(sources, ["answer_id", "source_index"])
    return first_of(cited, ["answer_id", "key"], ["at"])


def statuses(requested: DataFrame, results: DataFrame) -> DataFrame:
    """One status for every requested url (url_index, url), `not processed` where no result tells."""
    told = results.select("url_index", "status", "error_tag")
    return requested.join(told, "url_index", "left").withColumns({"status": F.coalesce("status", F.lit("error")), "error_tag": F.coalesce("error_tag", F.when(F.col("status").isNull(), "not processed"), F.lit(""))})


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("error"))


def load_by_mode(requests: DataFrame, cache: DataFrame, crawled: DataFrame, prefetched: DataFrame, mode: str) -> DataFrame:
    """Content of each url by the mode's order of sources, and which source gave it ('' if none).

    never: cache; always: crawl, prefetched; fallback: cache, crawl, prefetched; preferred: crawl, cache, prefetched.
    """
    orders = {"never": ["cache"], "always": ["crawl", "prefetched"], "fallback": ["cache", "crawl", "prefetched"], "preferred": ["crawl", "cache", "prefetched"]}
    out = requests
    for name, df in (("cache", cache), ("crawl", crawled), ("prefetched", prefetched)):
        if name in orders[mode]:
            out = out.join(df.select("url", F.col("content").alias(name)), "url", "left")
    origin = F.coalesce(*[F.when(F.col(n).isNotNull(), n) for n in orders[mode]], F.lit(""))
    stores = {"always": ("crawl", "prefetched"), "fallback": ("crawl", "prefetched"), "preferred": ("crawl",)}.get(mode, ())
    return out.withColumns({"content": F.coalesce(*map(F.col, orders[mode])), "origin": origin}).withColumn("write_back", F.col("origin").isin(*stores) if stores else F.lit(False)).drop(*orders[mode])


#: Where a round's scores call for more work.
LOW_GAIN, LOW_CONFIDENCE, LOW_COVERAGE, HIGH_UNCERTAINTY, SUPPORT, CONFIDENT_ROUNDS = 0.35, 0.45, 0.50, 0.60, 0.45, 2


def decide(rounds: DataFrame) -> DataFrame:
    """stop and stop_reason of each round.

    rounds: search_left, fetch_left, n_queries, n_links, rounds_done, least_rounds, gain, confidence, coverage,
    uncertainty, conflicts, objectives, wants_more. Budgets decide first; then anything that calls for another round,
    if one can be run; then whether the work is done.
    """
    c = F.col
    explore = (c("fetch_left") > 0) & (c("n_links") > 0)
    search = (c("search_left") > 0) & (c("fetch_left") > 0)
    can_go = (search & (c("n_queries") > 0)) | explore
    backed = c("gain") >= SUPPORT
    doubts = backed & ((c("confidence") < LOW_CONFIDENCE) | (c("coverage") < LOW_COVERAGE) | (c("uncertainty") > HIGH_UNCERTAINTY) | (c("conflicts") > 0))
    left = c("objectives") > 0
    done = (~c("wants_more") & ~left & ~doubts) | ((c("gain") < LOW_GAIN) & ~left)
    done = done & ~((c("rounds_done") < CONFIDENT_ROUNDS) & can_go)
    goes_on = ((c("rounds_done") < F.greatest(F.lit(1), c("least_rounds"))) & (search | explore)) | (can_go & (left | doubts))
    reason = F.when(c("fetch_left") <= 0, "max_fetch_calls").when((c("search_left") <= 0) & ~explore, "max_search_calls").when(goes_on, "").when(done, "model_stop").when(~can_go, "no_executable_path").otherwise("")
    return rounds.withColumn("stop_reason", reason).withColumn("stop", F.col("stop_reason") != "")


def stop_reason(tracks: DataFrame) -> DataFrame:
    """Whether any track ended for want of budget."""
    short = F.col("stop_reason").isin("budget_exhausted", "max_search_calls", "max_fetch_calls")
    return tracks.agg(F.when(F.coalesce(F.bool_or(short), F.lit(False)), "budget_exhausted").otherwise("all_tracks_completed").alias("stop_reason"))
