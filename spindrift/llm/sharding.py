"""Sharding by histogram sort.

Rows have a 64-bit key and a size. Candidate boundaries (probes) are refined round by
round: every task counts, exactly, the bytes and rows between neighbouring probes, the
counts are summed, and each splitter's interval shrinks to the pair of probes around
its target, until the bytes below it meet the tolerance or the interval is one key.
Then every row is sent once, to its bucket; a shard is a run of buckets.

The key is the upper 40 bits of the text's hash and 24 bits of a hash of the row, so equal
texts lie together and only a splitter that must cut a group of them does so. The row's
hash takes its place in the table as well as its id, so repeated rows have keys of their own.

Defined results: a null text has size 1 and the checksum of the empty text; texts of
any length count whole; rows of one key are ordered by id; repeated rows are rows of their
own; an empty table gives an empty table; only the columns named are read, so clashing
names cannot matter. Buckets are alike in bytes and ROW_BYTES for each row, so what one
task sorts is bounded however small its rows are.
What the driver holds is a few numbers for each probe, bounded by buckets * probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import durable

GROUP_BITS, ROW_BYTES = 24, 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def group_key(group: Column, row: Column) -> Column:
    """Sort key: rows of a group are neighbours, and still have keys of their own."""
    mask = (1 << GROUP_BITS) - 1
    return F.xxhash64(group).bitwiseAND(F.lit(-1 - mask)).bitwiseOR(F.xxhash64(row).bitwiseAND(F.lit(mask)))


def counts_below(keyed: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key under each probe (sorted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(size, at, batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(probes) + 1)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["bin", "size", "rows"])

    found = keyed.select("key", "size").mapInArrow(count, "bin long, size long, rows long").groupBy("bin").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toPandas()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    size[found["bin"].to_numpy(np.int64)], rows[found["bin"].to_numpy(np.int64)] = found["size"], found["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keyed: DataFrame, targets: np.ndarray, tolerance: int, probes_each: int = 16, rounds: int = 20) -> np.ndarray:
    """For each target the key with about so many bytes below it (at most tolerance away, unless one key holds more)."""
    low, high = np.full(len(targets), LOW, object), np.full(len(targets), HIGH, object)
    best, miss = np.full(len(targets), LOW, object), np.array([int(t) for t in targets], object)
    open_ = miss > tolerance
    for _ in range(rounds):
        if not open_.any():
            break
        probes = sorted({int(low[i] + (high[i] - low[i]) * k // (probes_each + 1)) for i in np.flatnonzero(open_) for k in range(1, probes_each + 1)} | {int(high[i]) for i in np.flatnonzero(open_)})
        below, _ = counts_below(keyed, np.array(probes, np.int64))
        for i in np.flatnonzero(open_):
            a, b = np.searchsorted(probes, [low[i] + 1, high[i]], side="left")
            for p, n in zip(probes[a : b + 1], below[a : b + 1].tolist(), strict=True):
                if abs(n - int(targets[i])) < miss[i]:
                    best[i], miss[i] = p, abs(n - int(targets[i]))
                if n <= targets[i]:
                    low[i] = p
                else:
                    high[i] = p
                    break
            open_[i] = miss[i] > tolerance and high[i] - low[i] > 1
    return np.maximum.accumulate(np.array(best, np.int64))


def shard_rows(df: DataFrame, shards: int, key: Column, size: Column, order: list[str], tolerance: float = 0.001, bucket_bytes: int = 256 << 20, least_buckets: int = 8) -> DataFrame:
    """df's columns with size, shard and slot: shards of nearly equal bytes, slots without gaps from 0 in key order.

    tolerance: of a shard's bytes. A shard has at least least_buckets buckets, more where it holds more
    than bucket_bytes each; a bucket is what one task sorts. df must be cheap to keep: it is written once.
    """
    keyed = durable(df.withColumns({"key": key, "size": size.cast("long")}))
    total, weight = (int(x or 0) for x in keyed.agg(F.sum("size"), F.sum(F.col("size") + ROW_BYTES)).first())
    n = shards * max(least_buckets, ceil(weight / shards / bucket_bytes))
    # the cuts between shards are held to the tolerance; buckets only have to be alike
    cuts = splitters(keyed, np.array([total * s // shards for s in range(1, shards)], np.int64), max(1, int(total / shards * tolerance))) if total else np.full(shards - 1, LOW, np.int64)
    weighed = keyed.select("key", (F.col("size") + ROW_BYTES).alias("size"))
    inner = splitters(weighed, np.array([weight * b // n for b in range(1, n)], np.int64), max(1, weight // n // 4)) if total else cuts
    bounds = np.unique(np.concatenate([cuts, inner]))
    _, rows = counts_below(keyed, bounds)
    shard_of = np.searchsorted(np.sort(cuts), np.concatenate([[LOW], bounds]), side="right")
    starts = np.concatenate([[0], rows])
    first = np.array([starts[np.searchsorted(shard_of, s)] if (shard_of == s).any() else 0 for s in range(shards)])
    offset = starts - first[shard_of]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.searchsorted(bounds, batch.column(batch.schema.get_field_index("key")).to_numpy(), side="right")
            more = [pa.array(bucket.astype(np.int32)), pa.array(shard_of[bucket].astype(np.int32)), pa.array(offset[bucket])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "bucket", "shard", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    dealt = keyed.mapInArrow(deal, f"{schema}, bucket int, shard int, offset long")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", *order))
    return dealt.withColumn("slot", F.col("offset") + place - 1).drop("bucket", "offset", "key")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; write the texts by joining them on doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).alias("octets"), F.xxhash64(text).alias("text_hash"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("row_hash"))
    return shard_rows(rows, shards, group_key(F.col("text_hash"), F.col("row_hash")), F.col("octets") + 1, ["doc_id"]).drop("octets", "text_hash", "row_hash")
