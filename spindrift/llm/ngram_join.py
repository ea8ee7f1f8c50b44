"""N-gram Jaccard join with a token-group matrix: exact, as components of near-duplicates.

A document is its set of distinct 5-word shingles, kept as 64-bit hashes; documents with
one set are one node. Two nodes link when 100 * intersection >= 80 * union. The sets are
made once, and written beside a bit row each.

1. All shingles are counted to find the frequent ones (a bounded list); they come last
   in the order of shingles. A link has its first common shingle, in that order, among
   the first n - ceil(0.8 n) + 1 of both nodes, so only these are dealt out, in packed
   form, to buckets of shingles.
2. In a bucket, a shingle that up to SMALL nodes share gives all their pairs; one that
   more nodes share gives the pairs with one leader for each band of sizes. Verified
   pairs make the groups: similar documents lie in one group, in parts of bounded size.
3. The token-group matrix: for every part the union of its members' tokens, as a stored
   row of bits. A node that shares a widely shared shingle with parts of other groups
   queries them: the overlap with a part's union bounds that with any member, and only a
   part that qualifies is opened and its members are compared. Nodes of one group need no
   comparison: their component is known.
Every pair that could link is either verified, ruled out by a bound, or joins nodes of
one component, so components are exact, and no group's pairs are written out.

Defined results: null and empty texts (and those of white space) have no shingles and
link with nothing; texts with fewer than five words have one shingle, all their words;
repeated rows of a document are kept as rows and share its component; rows without an id
link as any other, and their component_id is the least id of their component, null if it
has none; texts of any length count whole; an empty table gives an empty table; other
columns are not read. Two shingles or sets with one 64-bit hash would be taken as one;
n_shingles and links are exact but for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.codes import mixed
from spindrift.llm.common import drop_old_shuffles, durable, few_pages, let_go, same_plan_at_every_size, text_slices
from spindrift.llm.components import connected_components, merged_components

WORDS, LEAST, MOST = 5, 80, 100  # LEAST / MOST is the similarity
#: Frequent shingles: counted where LOCAL copies lie in one part of COUNTED shingles, kept from FREQUENT on, MOST_FREQUENT at most.
LOCAL, COUNTED, FREQUENT, MOST_FREQUENT = 3, 1_000_000, 32, 500_000
#: Nodes of a shingle that give all pairs; members of a part of a group; postings of a bucket; nodes of a list before it is split; queries of a part in one task.
#: Numbers of rows that a filter ships to every task; beyond that it is a join.
MOST_SHIPPED = 4_000_000
SMALL, PART, BUCKET, LEAST_BUCKETS, SPLIT, QUERIES = 6, 64, 600_000, 64, 200_000, 500
#: Sets are hashes: nothing in them repeats, so they are not compressed (nor held in a codec's buffers). Small row groups keep few of them in a writer's memory.
TABLE_OPTIONS = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
_odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Hashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(len(words), WORDS)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = mixed(total + h[i : len(words) - n + 1 + i] * _odd[i])
    return np.unique(total.view(np.int64))


def signature(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).view(np.int64)) if len(tokens) else 0


def prefix(tokens: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The tokens in which any link has its first common one: rare before frequent, then by hash."""
    size = len(tokens) - -(-LEAST * len(tokens) // MOST) + 1
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        order = np.argsort(np.where(frequent[at] == tokens, classes[at], 0), kind="stable")
        return tokens[order[:size]]
    return tokens[:size]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if LEAST * max(len(a), len(b)) > MOST * min(len(a), len(b)):
        return False
    both = common(a, b)
    return MOST * both >= LEAST * (len(a) + len(b) - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def bit_row(tokens: np.ndarray) -> bytes:
    """Size of the set, and the columns of the token-group matrix that it has: tokens by hash, two to four columns a token."""
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    row = np.zeros(bits, bool)
    row[tokens & (bits - 1)] = True
    return len(tokens).to_bytes(4, "little") + np.packbits(row, bitorder="little").tobytes()


def read_row(data: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(data[:4], "little"), np.frombuffer(data, np.uint8, offset=4)


def folded(row: np.ndarray, width: int) -> np.ndarray:
    """The row with so many bytes: columns that fall together are or-ed."""
    while len(row) > width:
        row = row[: len(row) // 2] | row[len(row) // 2 :]
    return row


def surely_missing(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the tokens of a that b lacks."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) & ~folded(b, width)).sum())


#: kind 0: a document, its size and node; place, bits and tokens where its set stands first in this part. kind 1: a token and its copies where it is frequent in this part.
SUMMARY = "kind int, doc_id long, token long, n long, node long, place long, bits binary, tokens binary"


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMMARY of a part of the documents; place is a number that no other row has."""
    let_go()
    held, size, seen, made = [], 0, set(), TaskContext.get().partitionId() << 33

    def rows(kind: int, doc_id, token, n, node, place, bits, tokens) -> pa.RecordBatch:
        long = lambda x: pa.array(x, pa.int64())
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), long(doc_id), long(token), long(n), long(node), long(place), pa.array(bits, pa.binary()), pa.array(tokens, pa.binary())], names=names)

    def frequent() -> Iterator[pa.RecordBatch]:
        if held:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= LOCAL
            none = [None] * int(some.sum())
            yield rows(1, none, tokens[some], n[some], none, none, none, none)

    for batch in text_slices(batches, chars=1_000_000):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        signs = [signature(s) for s in sets]
        place, bits, tokens = ([None] * len(sets) for _ in range(3))
        for i, (s, sign) in enumerate(zip(sets, signs, strict=True)):
            if len(s) and sign not in seen:
                seen.add(sign)
                place[i], bits[i], tokens[i] = made, bit_row(s), s.tobytes()
                made += 1
                held.append(s)
                size += len(s)
        yield rows(0, batch.column(0), [None] * len(sets), [len(s) for s in sets], signs, place, bits, tokens)
        if size >= COUNTED:
            yield from frequent()
            held, size, seen = [], 0, set()
    yield from frequent()


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold them all, after a byte that says how many."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


POSTINGS = "bucket int, tokens binary, nodes binary, places binary, signs binary, sizes binary"


def post(shared, buckets: int):
    """Postings of the prefixes, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hashes.clear()
        frequent, classes, copies = shared.value
        split = frequent[copies > SPLIT]
        held, signs, sizes, total = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            tokens = np.concatenate(held)
            lengths = np.array([len(x) for x in held])
            nodes = np.repeat(np.arange(len(held)), lengths)
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            sign, size = np.array(signs, np.int64), np.array(sizes, np.int64)
            bucket = (tokens & 0xFFFFFF) % buckets
            if len(split):  # a list that is too long for one task is dealt by its nodes as well
                long = np.isin(tokens, split)
                pieces = -(-copies[np.searchsorted(frequent, tokens[long])] // SPLIT)
                own = (mixed((tokens[long] ^ sign[nodes[long]]).view(np.uint64)) >> np.uint64(1)).astype(np.int64) % pieces
                bucket[long] = (bucket[long] + own) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(cuts)):
                some = order[cuts[b] : cuts[b + 1]]
                own, at = np.unique(nodes[some], return_inverse=True)
                out.append({"bucket": int(b), "tokens": tokens[some].tobytes(), "nodes": packed(at), "places": packed(places[some]), "signs": sign[own].tobytes(), "sizes": packed(size[own])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("tokens", "nodes", "places", "signs", "sizes"))]))

        for batch in batches:
            for sign, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(data.as_buffer(), np.int64)
                held.append(prefix(tokens, frequent, classes))
                signs.append(sign)
                sizes.append(len(tokens))
                total += len(held[-1])
                if total >= BUCKET // 2:
                    yield from flush()
                    held, signs, sizes, total = [], [], [], 0
        yield from flush()

    return run


#: kind 0: a pair of nodes a, b. kind 1: a posting of a widely shared shingle: token a, node b, its size and place.
CANDIDATES = "kind int, a long, b long, size int, place int"


def may_link(size, place, sizes, places):
    """Whether one node can link with others if a shingle at these places is their first common one."""
    need = -(-LEAST * (size + sizes) // (LEAST + MOST))
    return (LEAST * np.maximum(size, sizes) <= MOST * np.minimum(size, sizes)) & (1 + np.minimum(size - place, sizes - places) - 1 >= need)


def candidates(shared):
    return lambda table: bucket_candidates(table, shared.value[0][shared.value[2] > SPLIT])


def bucket_candidates(table: pa.Table, split: np.ndarray) -> pa.Table:
    """One bucket's pairs and widely shared postings; of the lists named in split it may hold a piece only."""
    col = lambda name: [np.frombuffer(x.as_py(), np.int64) for x in table.column(name)]
    small = lambda name: [unpacked(x.as_py()) for x in table.column(name)]
    tokens, places = np.concatenate(col("tokens")), np.concatenate(small("places")).astype(np.int64)
    signs, sizes, nodes = [], [], []
    for own, size, at in zip(col("signs"), small("sizes"), small("nodes"), strict=True):
        signs.append(own[at])
        sizes.append(size[at].astype(np.int64))
        nodes.append(at)
    signs, sizes = np.concatenate(signs), np.concatenate(sizes)
    order = np.lexsort([signs, tokens])
    tokens, signs, sizes, places = tokens[order], signs[order], sizes[order], places[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (signs[1:] != signs[:-1])  # the same set posted by several tasks
    tokens, signs, sizes, places = tokens[new], signs[new], sizes[new], places[new]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    count = np.diff(np.append(starts, len(tokens)))
    small = count <= SMALL
    small &= ~np.isin(tokens[starts], split)
    pairs, wide = [], []
    for n in range(2, SMALL + 1):
        first = starts[(count == n) & small]
        for i in range(n):
            for j in range(i + 1, n):
                x, y = first + i, first + j
                ok = may_link(sizes[x], places[x], sizes[y], places[y])
                pairs.append(np.stack([signs[x[ok]], signs[y[ok]]]))
    for s, n in zip(starts[~small], count[~small], strict=True):
        some = np.arange(s, s + n)
        wide.append(some)
        band = np.floor(np.log(sizes[some]) / np.log(1.11)).astype(np.int64)
        for shift in (0, 1):  # leaders of a band, and between a band and the next
            group = np.lexsort([signs[some], (band + shift) // 2])
            key = ((band + shift) // 2)[group]
            lead = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(n), 0))
            x, y = some[group[lead]], some[group]
            pairs.append(np.stack([signs[x], signs[y]])[:, x != y])
    both = np.unique(np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
    more = np.concatenate(wide) if wide else np.empty(0, np.int64)
    zero = np.zeros(both.shape[1], np.int64)
    return pa.table({"kind": pa.array(np.concatenate([zero, np.ones(len(more), np.int64)]), pa.int32()), "a": pa.array(np.concatenate([both[0], tokens[more]])), "b": pa.array(np.concatenate([both[1], signs[more]])), "size": pa.array(np.concatenate([zero, sizes[more]]), pa.int32()), "place": pa.array(np.concatenate([zero, places[more]]), pa.int32())})


class Sets:
    """The stored sets: rows (place, bits, tokens), and the place of one of them for each node."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.where("place is not null")
        self.places = durable(self.rows.groupBy("node").agg(F.min("place").alias("place")))

    def beside(self, asked: DataFrame, *columns: str) -> DataFrame:
        """asked (with node), and those columns of its set; sets that are not asked for are left out before any is shuffled."""
        asked = durable(asked.join(self.places, "node"))
        needed = durable(asked.select("place").distinct())
        needed = F.broadcast(needed) if needed.count() <= MOST_SHIPPED else needed
        return asked.join(self.rows.select("place", *columns).join(needed, "place", "left_semi"), "place").drop("place")


def rows_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone; rows without an id stay. Texts are shuffled only if more ids go than a filter ships."""
    gone = durable(gone.select("doc_id").where("doc_id is not null").distinct())
    gone = F.broadcast(gone) if gone.count() <= MOST_SHIPPED else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def numbers(*names: str) -> Column:
    """64-bit numbers as text, which judges read again."""
    return F.concat_ws(",", *[F.col(n).cast("string") for n in names]).cast("binary")


def beside(targets: DataFrame, queries: DataFrame, judge, schema: str, sets: Sets | None = None) -> DataFrame:
    """What judge finds for every query beside the targets of its part, both (part, node, payload), or (part, node) with the tokens of sets as payload.

    A part's targets come first in its task, then its queries one after the other; a part with many queries is
    dealt to several tasks. judge takes the targets [(node, payload)] and gives a function of a query.
    """
    many = durable(queries.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts")))
    own = ["node"] if sets else ["node", "payload"]
    copies = targets.join(many, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    spread = queries.join(many, "part").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    rows = copies.select("part", "salt", F.lit(0).alias("kind"), *own).unionByName(spread.select("part", "salt", F.lit(1).alias("kind"), *own))
    if sets:  # payloads come last, once it is known where they are needed
        rows = sets.beside(rows, "tokens").select("part", "salt", "kind", "node", F.col("tokens").alias("payload"))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, judged = None, [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for p, s, kind, node, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (p, s) != at:
                    at, held, judged = (p, s), [], None
                if not kind:
                    held.append((node, payload))
                    continue
                if judged is None:
                    judged = judge(p, held)
                found += judged(node, payload)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

    return rows.repartition(n, "part", "salt").sortWithinPartitions("part", "salt", "kind").mapInArrow(run, schema)


def unions_of(members: DataFrame, sets: Sets, single: bool) -> DataFrame:
    """The token-group matrix, stored: for each part of members (part, node) the least size of a member, the union of the members' bit rows, and the member if it is the only one.

    single: whether every part is known to have one member.
    """
    rows = sets.beside(members, "n", "bits")

    def union(table: pa.Table) -> pa.Table:
        read = [read_row(x.as_py()) for x in table.column("bits")]
        row = read[0][1]
        for _, r in read[1:]:
            width = min(len(row), len(r))
            row = folded(row, width) | folded(r, width)
        return pa.table({"part": table.column("part").slice(0, 1), "least": pa.array([min(n for n, _ in read)], pa.int64()), "bits": pa.array([row.tobytes()], pa.binary()), "alone": pa.array([None], pa.int64())})

    of_one = lambda df: df.select("part", F.col("n").alias("least"), F.expr("substring(bits, 5)").alias("bits"), F.col("node").alias("alone"))
    if single:
        return durable(of_one(rows))
    counted = durable(rows.join(members.groupBy("part").agg(F.count("*").alias("members")), "part"))
    several = counted.where("members > 1").select("part", "bits").groupBy("part").applyInArrow(union, "part long, least long, bits binary, alone long")
    return durable(of_one(counted.where("members = 1")).unionByName(several))


def qualifying(queries: DataFrame, unions: DataFrame, sets: Sets) -> DataFrame:
    """The queries (part, node) whose overlap with the part's union is no less than a link with a member needs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_qualify(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    union = unions.select("part", "least", F.col("bits").alias("union"), "alone")
    asked = sets.beside(queries, "bits")
    rows = asked.join(union, "part").select("part", "node", "least", "union", "alone", "bits")
    return rows.mapInArrow(judge, "part long, node long")


def may_qualify(node: int, least: int, union: bytes, alone: int | None, bits: bytes) -> bool:
    """Whether a query may link with a member of a part, by the part's union and its least size."""
    if node == alone:
        return False
    n, row = read_row(bits)
    held = np.frombuffer(union, np.uint8)
    need = -(-LEAST * (n + max(least, -(-LEAST * n // MOST))) // (LEAST + MOST))
    if n - surely_missing(row, held) < need:
        return False
    return alone is None or least - surely_missing(held, row) >= need


def link_judge(part: int, members: list[tuple[int, bytes]]):
    """The members that a query links with, once it qualifies by the union of their tokens."""
    sets = [(m, np.frombuffer(x, np.int64)) for m, x in members]
    union = sets[0][1] if len(sets) == 1 else np.unique(np.concatenate([t for _, t in sets])) if sets else np.empty(0, np.int64)

    def links(node: int, payload: bytes) -> list[tuple[int, int]]:
        tokens = np.frombuffer(payload, np.int64)
        if MOST * common(tokens, union) < LEAST * len(tokens):
            return []
        return [(m, node) for m, t in sets if m != node and linked(t, tokens)]

    return links


def verified(sets: Sets, members: DataFrame, queries: DataFrame, single: bool = False) -> DataFrame:
    """Links (a, b) of the queries (part, node) with members (part, node): the matrix first, then only parts that qualify are opened."""
    asked = members.join(queries.select("part").distinct(), "part", "left_semi")
    open_ = durable(qualifying(queries, unions_of(asked, sets, single), sets))
    chosen = durable(asked.join(open_.select("part").distinct(), "part", "left_semi"))
    return durable(beside(chosen, open_, link_judge, "a long, b long", sets))


def query_judge(token: int, parts: list[tuple[int, bytes]]):
    """The parts of other, larger components (by size, then name) that a node may link with through this token."""
    part = np.array([p for p, _ in parts], np.int64)
    component, n, least, most, left = np.array([list(map(int, x.split(b","))) for _, x in parts], np.int64).T if parts else np.empty((5, 0), np.int64)

    def asks(node: int, payload: bytes) -> list[tuple[int, int]]:
        own, own_n, size, own_left = map(int, payload.split(b","))
        later = (n > own_n) | ((n == own_n) & (component > own))
        fits = (LEAST * least <= MOST * size) & (LEAST * size <= MOST * most)
        need = -(-LEAST * (size + np.maximum(least, -(-LEAST * size // MOST))) // (LEAST + MOST))
        return [(node, p) for p in part[later & fits & (np.minimum(left, own_left) >= need)].tolist()]

    return asks


def group_queries(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, part): nodes that share a wide shingle with a part of a larger group and may link with a member.

    shared: token, node, size, place of widely shared shingles; sizes: node, component, n (of the component), part.
    The nodes of a token are dealt to tasks in bounded numbers, each beside what the token's parts say of themselves.
    """
    left = (F.col("size") - F.col("place")).cast("long")
    labelled = durable(shared.join(sizes, "node", "left").select("token", "node", F.col("size").cast("long").alias("size"), left.alias("left"), F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("part", "node").alias("part")))
    several = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    wide = durable(labelled.join(several, "token", "left_semi"))
    says = wide.groupBy("token", "part").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.max("left").alias("left"))
    targets = says.select(F.col("token").alias("part"), F.col("part").alias("node"), numbers("component", "n", "least", "most", "left").alias("payload"))
    queries = wide.select(F.col("token").alias("part"), "node", numbers("component", "n", "size", "left").alias("payload"))
    return beside(targets, queries, query_judge, "node long, part long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(docs.mapInArrow(summarise, SUMMARY), **TABLE_OPTIONS)
    summary = rows.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node")
    with same_plan_at_every_size(spark), few_pages(spark):
        of_node = least_ids(spark, rows, summary)
    drop_old_shuffles(spark)
    out = summary.join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("of_all")).otherwise(F.col("doc_id")).alias("component_id"))


def least_ids(spark, rows: DataFrame, summary: DataFrame) -> DataFrame:
    """For each node the least id of its component (of_all); durable."""
    counted = rows.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas().sort_values("token")
    tokens, copies = frequent["token"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((tokens, np.log2(np.maximum(copies, 2)).astype(np.int8), copies))
    sets = Sets(rows)
    total = sets.rows.agg(F.sum(F.col("n") / 5 + 1)).first()[0] or 0
    # many buckets at any size: what a posting carries of its node then weighs the same
    buckets = max(LEAST_BUCKETS, ceil(total / BUCKET))

    made = durable(sets.rows.select("node", "tokens").mapInArrow(post(shared, buckets), POSTINGS).groupBy("bucket").applyInArrow(candidates(shared), CANDIDATES))
    pairs = durable(made.where("kind = 0").select(F.col("a").alias("part"), F.col("b").alias("node")).distinct())
    wide = made.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), "size", "place")
    drop_old_shuffles(spark)
    links = verified(sets, pairs.select("part", F.col("part").alias("node")).distinct(), pairs, single=True)
    groups = connected_components(links)
    drop_old_shuffles(spark)

    n = durable(groups.groupBy("component").agg(F.count("*").alias("n")))
    part = F.when(F.col("n") > PART, F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)))).otherwise(F.col("component"))
    sizes = durable(groups.join(n, "component").select("node", "component", "n", part.alias("part")))
    queries = durable(group_queries(wide, sizes))
    if not queries.isEmpty():
        alone = queries.select(F.col("part").alias("node"), "part").distinct().join(sizes.select("part"), "part", "left_anti")
        more = verified(sets, sizes.select("part", "node").unionByName(alone.select("part", "node")), queries)
        if not more.isEmpty():
            groups = merged_components(groups, more)
    # the least id of each node, then of each component; joined only where a component has several nodes
    by_node = durable(summary.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")))
    least = durable(groups.join(by_node, "node").groupBy("component").agg(F.min("least").alias("of_all")))
    return durable(groups.join(least, "component").select("node", "of_all").unionByName(by_node.join(groups, "node", "left_anti").select("node", F.col("least").alias("of_all"))))
