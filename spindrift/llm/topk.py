"""Exact top-k by inner product in three phases with a uniform threshold.

Vectors are kept in blocks that stay where they are; in a block each run of dimensions (a
list) scores every candidate on its own. Queries go out in waves of bounded size, one wave
after the other, each to all blocks:
1. every task gathers, from its first block of a dimension, per list its best entries,
   scores these exactly, and keeps the best k; the k-th best of all tasks is a cutoff that
   no result can miss;
2. the cutoffs go out. A block whose longest vector cannot reach a query's cutoff is passed
   by. Scores of a list are counted from the least score it can give, so a candidate that
   reaches the cutoff has one list with at least the m-th part of it: the entries over that
   part are collected, and the ones whose lists, with what a list can still give at most,
   stay under the cutoff are dropped;
3. what is left is scored exactly from its lists, and the best k of all tasks are kept.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors are compared with those of the same number of components only; an empty
vector scores 0; ties go to the smaller id; repeated rows with one id are rows of their
own, and only the query's own row is no candidate; scores beyond 64 bits become the
nearest 64-bit value; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import durable, ensure_checkpoint_dir

#: Vectors of a block, bytes of the queries of a wave, queries that are scored at once, lists.
BLOCK, WAVE_BYTES, QUERY_BLOCK, LISTS = 2048, 16 << 20, 512, 4
PACKED = "dim int, block long, kind string, ids binary, vectors binary"


def small_kind(vectors: np.ndarray) -> str:
    """The smallest type that holds these whole numbers."""
    most = np.abs(vectors).max(initial=0)
    return "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"


def read_vectors(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["dim"]).astype(np.float64)


def pack(rows: DataFrame, scale: float) -> DataFrame:
    """Blocks of up to BLOCK vectors (by number of components), floored to whole numbers as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            made += 1
            kind = small_kind(vectors)
            row = {"dim": dim, "block": (part << 32) + made, "kind": kind, "ids": ids.tobytes(), "vectors": vectors.astype(kind).tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, column = batch.column(0).slice(at, BLOCK), batch.column(1).slice(at, BLOCK)
                good = np.array(column.is_valid()) & np.array(ids.is_valid())
                column, ids = column.filter(pa.array(good)), ids.filter(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                lengths = np.array(column.value_lengths(), np.int64)
                starts = np.cumsum(lengths) - lengths
                with np.errstate(over="ignore", invalid="ignore"):
                    whole = np.floor(flat * scale)
                for dim in np.unique(lengths):
                    some = np.flatnonzero(lengths == dim)
                    vectors = whole[starts[some][:, None] + np.arange(dim)] if dim else np.empty((len(some), 0))
                    fine = np.isfinite(flat[starts[some][:, None] + np.arange(dim)]).all(1) & np.isfinite(vectors).all(1) if dim else np.ones(len(some), bool)
                    if fine.any():
                        held.setdefault(int(dim), []).append((ids[some][fine], vectors[fine]))
                        if sum(len(x) for x, _ in held[int(dim)]) >= BLOCK:
                            yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    return rows.mapInArrow(run, PACKED)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: as doubles while every sum fits them, else as Python's integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    return whole(a).dot(whole(b).T)


def runs(dim: int) -> list[slice]:
    m = max(1, min(LISTS, dim))
    return [slice(dim * g // m, dim * (g + 1) // m) for g in range(m)]


def within(score: int) -> int:
    """The score, or the nearest one that 64 bits hold."""
    return max(min(score, 2**63 - 1), -(2**63))


class Best:
    """The k best candidates of each query of a block so far: (-score, id, own place)."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, {}

    def add(self, query: int, scores: list, ids: list) -> None:
        kept = self.rows.get(query, [])
        kept = sorted([*kept, *((-within(int(s)), int(i)) for s, i in zip(scores, ids, strict=True))])[: self.k]
        self.rows[query] = kept


def exact(queries: np.ndarray, vectors: np.ndarray, q: int, some: np.ndarray) -> np.ndarray:
    return dot(queries[q : q + 1], vectors[some])[0]


def gather(queries, own, ids, vectors, block, best: Best, k: int) -> None:
    """Phase 1 for one pair of blocks."""
    picks = [np.empty((len(queries), 0), np.int64)]
    take = min(len(ids), k + 1)  # one may be the query's own row
    for part in runs(queries.shape[1]):
        scores = dot(queries[:, part], vectors[:, part])
        picks.append(np.argpartition(-scores, take - 1, axis=1)[:, :take] if scores.dtype != object else np.argsort(-scores, axis=1)[:, :take])
    merged = np.concatenate(picks, axis=1)
    for q in range(len(queries)):
        some = np.unique(merged[q])
        if own[q][0] == block:
            some = some[some != own[q][1]]
        if len(some):
            best.add(q, exact(queries, vectors, q, some), ids[some])


def resolve(queries, own, cutoffs, ids, vectors, block, best: Best) -> None:
    """Phases 2 and 3 for one pair of blocks."""
    with np.errstate(over="ignore"):
        reach = np.sqrt((queries * queries).sum(1)) * np.sqrt((vectors * vectors).sum(1)).max(initial=0)
    rows = np.flatnonzero(reach * (1 + 1e-9) + 1 >= cutoffs)
    if not len(rows):
        return
    queries, cutoffs = queries[rows], cutoffs[rows]
    parts = runs(queries.shape[1])
    lists = [dot(queries[:, part], vectors[:, part]) for part in parts]
    least = [x.min(axis=1) for x in lists]
    from_least = cutoffs - sum(least)  # the cutoff, counted from the least score of each list
    threshold = from_least / len(parts)
    over = [x - low[:, None] >= threshold[:, None] for x, low in zip(lists, least, strict=True)]
    sent = over[0].copy()
    for x in over[1:]:
        sent |= x
    upper = sum(np.where(o, x - low[:, None], np.broadcast_to(np.maximum(threshold, 0)[:, None], x.shape)) for o, x, low in zip(over, lists, least, strict=True))
    # a doubtful rounding keeps an entry: its sum is exact
    left = sent & (upper >= from_least[:, None] - 1)
    for at in np.flatnonzero(left.any(axis=1)):
        q, some = int(rows[at]), np.flatnonzero(left[at])
        if own[q][0] == block:
            some = some[some != own[q][1]]
        scores = sum(x[at, some] for x in lists) if lists[0].dtype != object and np.abs(queries[at]).sum() * np.abs(vectors).max(initial=0) < 2**53 else exact(queries, vectors, at, some)
        keep = scores >= cutoffs[at]
        if keep.any():
            best.add(q, scores[keep], ids[some[keep]])


FOUND = "query int, score long, vec_id long"


def wave_results(blocks: DataFrame, wave: list, k: int) -> DataFrame:
    """query (its number in the wave), score and vec_id of the k best candidates of every query of a wave."""
    spark = blocks.sparkSession
    by_dim: dict[int, list[int]] = {}
    for n, q in enumerate(wave):
        by_dim.setdefault(q.dim, []).append(n)

    def phase(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, cutoffs = shared.value
            best, seen = Best(k), set()
            for batch in batches:
                for row in batch.to_pylist():
                    if row["dim"] not in queries or not last and row["dim"] in seen:
                        continue
                    seen.add(row["dim"])
                    ids, vectors = read_vectors(row)
                    numbers, own, all_queries = queries[row["dim"]]
                    for a in range(0, len(numbers), QUERY_BLOCK):
                        some = numbers[a : a + QUERY_BLOCK]
                        part = Best(k)
                        part.rows = {i: best.rows[n] for i, n in enumerate(some) if n in best.rows}
                        if last:
                            resolve(all_queries[a : a + QUERY_BLOCK], own[a : a + QUERY_BLOCK], cutoffs[some], ids, vectors, row["block"], part)
                        else:
                            gather(all_queries[a : a + QUERY_BLOCK], own[a : a + QUERY_BLOCK], ids, vectors, row["block"], part, k)
                        best.rows.update({int(some[i]): kept for i, kept in part.rows.items()})
            rows = [(n, -s, i) for n, kept in best.rows.items() for s, i in kept]
            if rows:
                n, score, vec_id = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(score, pa.int64()), pa.array(vec_id, pa.int64())], names=["query", "score", "vec_id"])

        return run

    queries = {dim: (np.array(ns), [(wave[n].block, wave[n].place) for n in ns], np.array([np.frombuffer(wave[n].vector) for n in ns]).reshape(len(ns), dim)) for dim, ns in by_dim.items()}
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    first = blocks.mapInArrow(phase(spark.sparkContext.broadcast((queries, None)), False), FOUND)
    # the k-th best of what was gathered; none if fewer than k candidates are known
    cut = first.withColumn("rank", place).where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("cutoff")).collect()
    cutoffs = np.full(len(wave), -np.inf)
    for r in cut:  # a little lower where a double cannot hold the score
        cutoffs[r["query"]] = r.cutoff if abs(r.cutoff) < 2**53 else r.cutoff - abs(r.cutoff) * 1e-15 if r.cutoff > -(2.0**63) else -np.inf
    second = blocks.mapInArrow(phase(spark.sparkContext.broadcast((queries, cutoffs)), True), FOUND)
    names = spark.createDataFrame([(n, q.id) for n, q in enumerate(wave)], "query int, query_id long")
    return second.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, query_filter, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for every row that query_filter (a condition on id) picks.

    query_filter: a function of a numpy array of ids that gives a mask.
    """
    spark = vectors.sparkSession
    blocks = durable(pack(vectors.select(F.col(id_col).cast("long"), vector_col), scale))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids, own = read_vectors(x)
                some = np.flatnonzero(query_filter(ids))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([x["dim"]] * len(some), pa.int32()), pa.array([x["block"]] * len(some)), pa.array(some), pa.array(ids[some]), pa.array([r.tobytes() for r in own[some]], pa.binary())], names=["dim", "block", "place", "id", "vector"])

    queries = durable(blocks.mapInArrow(pick, "dim int, block long, place long, id long, vector binary"))
    total = queries.agg(F.sum(F.length("vector") + 64)).first()[0] or 0
    waves = max(1, ceil(2 * total / wave_bytes))
    queries = queries.withColumn("wave", F.pmod(F.xxhash64("block", "place"), F.lit(waves)))
    wave = lambda n: queries.where(F.col("wave") == n).orderBy("block", "place").collect()
    if waves == 1:
        return wave_results(blocks, wave(0), k)
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/top-{uuid.uuid4().hex}"
    for n in range(waves):
        if rows := wave(n):
            wave_results(blocks, rows, k).write.mode("append").parquet(at)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(at)
