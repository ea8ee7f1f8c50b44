"""Toxicity by the nearest labelled examples.

Examples and texts are TF-IDF vectors over every term of the labelled sample (words, and
their first 4 to 6 letters): 1 + ln(tf), times idf, times the term's relevance
z / (z + 2 ln V), where z is the chi-square of the term and the label in the sample and V the number of
terms, so a term counts by how sure its link with the label is, and none is left out.
The inverted index keeps, for each term, the examples that hold it in blocks of similar
examples, and the largest weight in each block. For a text these maxima bound every
block's best cosine; blocks are opened from the highest bound down, until no closed
block can reach the k-th best cosine. So the k nearest examples, with all that tie with
the last of them, are exact. Examples of one text are one example that holds all their
labels. Votes are weighted by 1 / distance and by how often their class occurs among all
labels; their share of toxic votes is calibrated by isotonic regression on the votes
that the examples themselves get when they are left out. The examples that voted are
the evidence.

Learning is bounded: at most per_class labelled rows of each class (those with the
smallest hash of their id, so the choice does not depend on the layout of the data), and
of these as many as sample_chars characters hold. Everything else covers every row.

Defined results: null and empty texts, and texts without a known term, have no nearest
example and score as the share of toxic labels; repeated rows score alike, and teach
once; without labelled rows of both classes every score is the share of toxic labels (0
without any); an empty table gives an empty table; labels with a null id, a class other
than 0 and 1 or of documents that are not there teach nothing; an id with both labels
teaches both; columns other than the id and the text are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import codes
from spindrift.llm.common import durable, map_texts, one_a_worker, remainder

PER_CLASS, SAMPLE_CHARS, NEIGHBOURS, BLOCK, FIRST_OPEN, WIDE, BATCH = 2000, 32_000_000, 10, 128, 64, 12, 64
HEADS = (4, 5, 6)
#: Postings that one pass holds, and characters of the texts that are scored at once.
PASS, GROUP_CHARS = 400_000, 500_000


def term_hashes(begins: list[tuple[int, int]], text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk: for each term that occurs, its text's place and its hash."""
    points = codes.code_points(text)
    starts, ends = codes.runs(codes.is_word()[points])
    total = codes.sums(points)
    places, at = np.array([p for p, _ in begins]), np.array([a for _, a in begins])
    owner = places[np.searchsorted(at, starts, side="right") - 1]
    found = [(owner, codes.part_hash(total, starts, ends))]
    for n in HEADS:
        long = ends - starts >= n
        found.append((owner[long], codes.part_hash(total, starts[long], starts[long] + n, n)))
    return np.concatenate([o for o, _ in found]), np.concatenate([h for _, h in found])


class Lookup:
    """Places of hashes in a sorted vocabulary, by buckets of their upper bits."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        bits = max(4, min(22, len(vocabulary).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((vocabulary >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are known, their places), in no particular order."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        rows = np.flatnonzero(at < end)
        at, end, own, found = at[rows], end[rows], hashes[rows], []
        while len(rows):
            hit = self.vocabulary[at] == own
            found.append((rows[hit], at[hit]))
            at = at + 1
            more = ~hit & (at < end)
            rows, at, end, own = rows[more], at[more], end[more], own[more]
        return np.concatenate([np.empty(0, np.int64), *(r for r, _ in found)]), np.concatenate([np.empty(0, np.int32), *(a for _, a in found)])


def term_counts(texts: list[str | None], lookup: Lookup | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct terms and how often they occur; with a lookup only the terms of its vocabulary, as their places in it."""
    owners, terms = [], []
    for begins, part in codes.chunks([(t or "").lower() for t in texts]):
        owner, term = term_hashes(begins, part)
        if lookup is not None:
            known, at = lookup.places(term)
            owner, term = owner[known], at
        owners.append(owner)
        terms.append(term)
    owner, term = np.concatenate([np.empty(0, np.int64), *owners]), np.concatenate(terms or [np.empty(0, np.uint64)])
    if lookup is None:
        order = np.lexsort([term, owner])
        owner, term = owner[order], term[order]
    else:  # places are small: one number holds both
        both = np.sort(owner * (len(lookup.vocabulary) + 1) + term)
        owner, term = both // (len(lookup.vocabulary) + 1), both % (len(lookup.vocabulary) + 1)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])) if len(owner) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(owner)))
    cuts = np.searchsorted(owner[first], np.arange(len(texts) + 1))
    kept = term[first]
    return [(kept[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def relevance(held: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each term idf times the certainty of its link with the label. held: of each class the labels of the examples that hold the term."""
    n, size = labels.sum(0), held.shape[1]
    p, q = (held[1] + 0.5) / (n[1] + 1), (held[0] + 0.5) / (n[0] + 1)
    mean = (held.sum(0) + 1) / (n.sum() + 2)
    z = (p - q) ** 2 / (mean * (1 - mean) * (1 / n[0] + 1 / n[1]))
    return (np.log((n.sum() + 1) / (held.sum(0) + 1)) + 1) * z / (z + 2 * np.log(max(size, 2)))


@dataclass
class Index:
    """Examples in blocks; cells (term, block) with the largest weight; postings (example, weight) of each cell.

    Terms that stand in a WIDE-th part of the examples are wide: their lists have a weight for every example.
    All follows from what is sent to the workers: the terms' hashes and numbers of postings, the postings'
    examples (in the order of terms) and counts, the ids and labels of the examples, and the numbers of labels.
    """

    vocabulary: np.ndarray
    lengths: np.ndarray
    examples: np.ndarray
    counts: bytes
    count_kind: str
    ids: np.ndarray
    labels: np.ndarray
    class_counts: dict[int, int]
    calibration: tuple[np.ndarray, np.ndarray] | None = None
    shared: Broadcast | None = None

    def __post_init__(self) -> None:
        n_all, n = sum(self.class_counts.values()), self.labels.sum(0)
        self.prior = self.class_counts.get(1, 0) / max(1, n_all)
        if not len(self.ids):
            return
        self.rates = np.array([self.class_counts[c] / n_all for c in (0, 1)]) / (n / n.sum())

    def open(self) -> Index:
        """The index with its lists; they are made where texts are scored, and once."""
        if hasattr(self, "lookup") or not len(self.ids):
            return self
        size, n = len(self.vocabulary), len(self.ids)
        lengths = self.lengths.astype(np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.frombuffer(zlib.decompress(self.counts), self.count_kind)
        # all passes go over a bounded number of postings at once
        cuts = np.unique(np.append(np.searchsorted(at, np.arange(0, at[-1], PASS), side="right") - 1, size))
        parts = list(zip(cuts, cuts[1:], strict=False))

        def postings(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.repeat(np.arange(a, b), lengths[a:b]), self.examples[at[a] : at[b]].astype(np.int64), 1 + np.log(counts[at[a] : at[b]].astype(np.float64))

        held = np.zeros((2, size))
        for a, b in parts:
            term, example, _ = postings(a, b)
            for c in (0, 1):
                held[c, a:b] = np.bincount(term - a, self.labels[example, c], minlength=b - a)
        self.weight = relevance(held, self.labels)
        norm = np.zeros(n)
        for a, b in parts:
            term, example, tf = postings(a, b)
            norm += np.bincount(example, (tf * self.weight[term]) ** 2, minlength=n)
        norm = np.where(norm, np.sqrt(norm), 1)
        many = lengths * WIDE >= n
        self.wide_row = np.where(many, np.cumsum(many) - 1, -1)
        self.wide = np.zeros((int(many.sum()), n))
        self.posting_example, self.posting_weight = np.empty(int(lengths[~many].sum()), np.int32), np.empty(int(lengths[~many].sum()))
        self.cell_at, done, cells = np.zeros(size + 1, np.int32), 0, []
        for a, b in parts:
            term, example, tf = postings(a, b)
            value = tf * self.weight[term] / norm[example]
            in_wide = many[term]
            self.wide[self.wide_row[term[in_wide]], example[in_wide]] = value[in_wide]
            term, example, value = term[~in_wide], example[~in_wide], value[~in_wide]
            self.posting_example[done : done + len(term)], self.posting_weight[done : done + len(term)] = example, value
            block = example // BLOCK
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
            starts = np.flatnonzero(new)
            if len(starts):
                self.cell_at[a + 1 : b + 1] = np.bincount(term[starts] - a, minlength=b - a)
                cells.append((block[starts].astype(np.int32), np.maximum.reduceat(value, starts), (starts + done).astype(np.int32)))
            done += len(term)
        np.cumsum(self.cell_at, out=self.cell_at)
        self.cell_block = np.concatenate([np.empty(0, np.int32), *(c[0] for c in cells)])
        self.cell_most = np.concatenate([np.empty(0), *(c[1] for c in cells)])
        self.posting_at = np.append(np.concatenate([np.empty(0, np.int32), *(c[2] for c in cells)]), np.int32(done))
        self.lookup = Lookup(self.vocabulary)
        return self

    @property
    def parts(self) -> tuple:
        return self.vocabulary, self.lengths, self.examples, self.counts, self.count_kind, self.ids, self.labels, self.class_counts

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector (terms, counts) places and cosines of the k nearest examples and of all that tie with the last of them, nearest first; those with cosine 0 are none."""
        for a in range(0, len(vectors), BATCH):
            units = []
            wide = np.zeros((len(vectors[a : a + BATCH]), len(self.wide)))
            for row, (terms, counts) in enumerate(vectors[a : a + BATCH]):
                terms = terms.astype(np.int64)
                q = (1 + np.log(counts)) * self.weight[terms]
                q = q / (np.sqrt((q * q).sum()) or 1.0)
                at = self.wide_row[terms]
                wide[row, at[at >= 0]] = q[at >= 0]
                units.append((terms[at < 0], q[at < 0]))
            for (terms, q), known in zip(units, wide @ self.wide, strict=True):
                yield self.best(terms, q, known, k)

    def best(self, terms: np.ndarray, q: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of one vector: terms that are not wide, their weights, and what the wide ones give every example."""
        lengths = self.cell_at[terms + 1] - self.cell_at[terms]
        cells, q = codes.ranges(self.cell_at[terms], lengths), np.repeat(q, lengths)
        block = self.cell_block[cells]
        starts = np.arange(0, len(cosines), BLOCK)
        bound = np.bincount(block, q * self.cell_most[cells], minlength=len(starts)) + np.maximum.reduceat(cosines, starts)
        order = np.argsort(-bound, kind="stable")
        done, step = 0, FIRST_OPEN
        least = np.partition(cosines, -k)[-k] if len(cosines) >= k else 0.0
        while done < len(order) and bound[order[done]] >= max(least - 1e-9, 1e-12):
            now = order[done : done + step]
            mask = np.zeros(len(bound), bool)
            mask[now[bound[now] >= least - 1e-9]] = True
            some = mask[block]
            chosen = cells[some]
            n = self.posting_at[chosen + 1] - self.posting_at[chosen]
            at = codes.ranges(self.posting_at[chosen], n)
            cosines = cosines + np.bincount(self.posting_example[at], np.repeat(q[some], n) * self.posting_weight[at], minlength=len(cosines))
            done, step = done + step, step * 2
            if len(cosines) >= k:
                least = np.partition(cosines, -k)[-k]
        cosines = np.round(cosines, 9)
        least = np.partition(cosines, -k)[-k] if len(cosines) >= k else 0.0
        places = np.flatnonzero((cosines >= least) & (cosines > 0))
        places = places[np.lexsort([self.ids[places], -cosines[places]])]
        return places, cosines[places]

    def votes(self, places: np.ndarray, cosines: np.ndarray, left_out: int | None = None, label: int = 0) -> float | None:
        """Share of toxic votes of the nearest examples; left_out: an example whose one label does not vote."""
        held = self.labels[places]
        if left_out is not None:
            held = held.copy()
            held[places == left_out, label] -= 1
        weights = held * self.rates / (1e-3 + 1 - np.minimum(cosines, 1))[:, None]
        total = weights.sum()
        return float(weights[:, 1].sum() / total) if total else None

    def calibrated(self, share: float | None) -> float:
        if share is None:
            return self.prior
        return min(max(share if self.calibration is None else float(np.interp(share, *self.calibration)), 0.0), 1.0)

    def scores(self, texts: list[str | None], k: int) -> list[tuple[float, list[int]]]:
        """Score and evidence of every text."""
        if not len(self.ids):
            return [(self.prior, [])] * len(texts)
        self.open()
        out: list[tuple[float, list[int]]] = []
        for some in groups_of(texts):
            vectors = term_counts(some, self.lookup)
            keys = [(t.tobytes(), c.tobytes()) for t, c in vectors]
            unlike = dict(zip(keys, vectors, strict=True))
            found = {}
            for key, (places, cosines) in zip(unlike, self.nearest(list(unlike.values()), k), strict=True):
                found[key] = self.calibrated(self.votes(places, cosines)), self.ids[places].tolist()
            out += [found[key] for key in keys]
        return out


def groups_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in groups of about GROUP_CHARS characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing steps nearest to y: both edges of each step, and its height twice; between steps it rises evenly."""
    steps: list[list[float]] = []  # weight, weighted sum, least x, largest x
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    total, high = np.add.reduceat(w[order], first), np.add.reduceat((w * y)[order], first)
    for at, n, s in zip(xs.tolist(), total.tolist(), high.tolist(), strict=True):
        steps.append([n, s, at, at])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            n, s, _, to = steps.pop()
            steps[-1] = [steps[-1][0] + n, steps[-1][1] + s, steps[-1][2], to]
    return np.array([e for _, _, a, b in steps for e in (a, b)]), np.array([s / n for n, s, _, _ in steps for _ in (0, 1)])


def blocks_of(example: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """An order of the examples in which similar ones are neighbours: halves by their cosines with two unlike examples, again and again."""
    at = np.searchsorted(example, np.arange(n + 1))
    order, todo = np.arange(n), [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= BLOCK:
            continue
        own = order[a:b]
        entries = codes.ranges(at[own], at[own + 1] - at[own]).astype(np.int32)
        row = np.repeat(np.arange(b - a, dtype=np.int32), at[own + 1] - at[own])

        def cosines(i: int, own=own, entries=entries, row=row) -> np.ndarray:
            dense = np.zeros(int(term.max()) + 1)
            dense[term[at[own[i]] : at[own[i] + 1]]] = value[at[own[i]] : at[own[i] + 1]]
            return np.bincount(row, dense[term[entries]] * value[entries], minlength=len(own))

        one = cosines(0)
        other = cosines(int(np.argmin(one)))
        order[a:b] = own[np.lexsort([own, other - one])]
        middle = a + -(-(b - a) // (2 * BLOCK)) * BLOCK
        todo += [(a, middle), (middle, b)]
    return order


def build(rows: pd.DataFrame, class_counts: dict[int, int]) -> Index:
    """The index of examples: rows of doc_id, toxic, text (a hash), terms and counts (arrays)."""
    blank = Index(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), b"", "u1", np.empty(0, np.int64), np.empty((0, 2), np.int64), class_counts)
    toxic = rows["toxic"].to_numpy(np.int64)
    _, first, group = np.unique(rows["text"].to_numpy(np.int64), return_index=True, return_inverse=True)
    labels = np.stack([np.bincount(group, toxic == c, minlength=len(first)) for c in (0, 1)], 1).astype(np.int64)
    terms = [rows["terms"].iloc[i] for i in first]
    if not labels.sum(0).all() or not any(map(len, terms)):
        return blank
    ids = pd.Series(rows["doc_id"].to_numpy(np.int64)).groupby(group).min().to_numpy()
    example, counts = np.repeat(np.arange(len(first), dtype=np.int32), [len(t) for t in terms]), np.concatenate([rows["counts"].iloc[i] for i in first])
    vocabulary = np.unique(np.concatenate(terms))
    term = np.concatenate([np.searchsorted(vocabulary, t).astype(np.int32) for t in terms])
    held = np.stack([np.bincount(term, labels[example, c], minlength=len(vocabulary)) for c in (0, 1)])
    value = (1 + np.log(counts)) * relevance(held, labels)[term]
    norm = np.sqrt(np.bincount(example, value * value, minlength=len(first)))
    value /= np.where(norm, norm, 1)[example]
    order = blocks_of(example, term, value, len(first))
    del value
    place = np.empty(len(first), np.int32)
    place[order] = np.arange(len(first))
    example = place[example]
    by = np.argsort(term.astype(np.int64) * len(first) + example)
    lengths = np.bincount(term, minlength=len(vocabulary))
    small, few = np.min_scalar_type(len(first)), np.min_scalar_type(int(counts.max()))
    return Index(vocabulary, lengths.astype(small), example[by].astype(small), zlib.compress(counts[by].astype(few).tobytes(), 1), few.str, ids[order], labels[order], class_counts)


def fit(docs: DataFrame, labels: DataFrame, keep, per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS, k: int = NEIGHBOURS) -> Index:
    """An index from at most per_class labelled documents of each class; keep: condition on doc_id of the rows that may teach."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(keep)
    class_counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    picks = [marked.where(F.col("toxic") == c).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    picked = F.broadcast(picks[0].unionByName(picks[1]))
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = durable(said.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    sizes = texts.select("doc_id", "toxic", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id", "toxic"])
    sizes = sizes[sizes["n"].cumsum() <= sample_chars]

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = term_counts(batch.column(3).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t.tobytes() for t, _ in made], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in made], pa.binary())], names=["doc_id", "toxic", "said", "terms", "counts"])

    taught = texts.select("doc_id", "toxic", F.xxhash64("text").alias("said"), "text")
    rows = map_texts(taught, vectors, "doc_id long, toxic int, said long, terms binary, counts binary").toPandas().rename(columns={"said": "text"})
    rows = rows.merge(sizes[["doc_id", "toxic"]]).sort_values(["doc_id", "toxic"], ignore_index=True)
    rows["terms"], rows["counts"] = [np.frombuffer(x, np.uint64) for x in rows["terms"]], [np.frombuffer(x, np.int32) for x in rows["counts"]]
    index = build(rows, class_counts)
    if len(index.ids):
        index.shared = docs.sparkSession.sparkContext.broadcast(index.parts)
        index.calibration = calibrate(taught, rows, index, k)
    return index


def calibrate(taught: DataFrame, rows: pd.DataFrame, index: Index, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the labels on the votes that each example gets without its own label."""
    place_of_id = {int(d): i for i, d in enumerate(index.ids)}
    places = {t: place_of_id[int(d)] for t, d in rows.groupby("text")["doc_id"].min().to_dict().items()}
    shared = index.shared

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held_index(shared.value)
        some = [i for i, t in enumerate(batch.column(2).to_pylist()) if t in places]
        batch = batch.take(pa.array(some, pa.int64()))
        near = own.nearest(term_counts(batch.column(3).to_pylist(), own.lookup), k + 1)
        shares = [own.votes(*at, places[s], x) for at, s, x in zip(near, batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(shares, pa.float64())], names=["toxic", "share"])

    got = map_texts(taught, vote, "toxic int, share double").toPandas().dropna()
    if not len(got):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    toxic = got["toxic"].to_numpy(np.int64)
    return isotonic(np.round(got["share"].to_numpy(), 9), toxic.astype(float), index.rates[toxic])


def held_index(parts: tuple) -> Index:
    """The index of these parts, made once a worker."""
    return one_a_worker(parts, lambda: Index(*parts).open())


def scorer(docs: DataFrame, index: Index, k: int):
    """A function of texts on a worker, with the index shared among them."""
    shared, calibration = index.shared or docs.sparkSession.sparkContext.broadcast(index.parts), index.calibration

    def scores(texts: list[str | None]) -> list[tuple[float, list[int]]]:
        own = held_index(shared.value)
        own.calibration = calibration
        return own.scores(texts, k)

    return scores


def score_toxicity(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score and evidence (ids of the labelled examples that voted, nearest first) of every whole text."""
    score = scorer(docs, index, k)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = score(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, evidence array<long>")


def with_scores(docs: DataFrame, index: Index, k: int = NEIGHBOURS, text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with score (an own column of that name gives way); nothing is joined or shuffled."""
    docs = docs.drop("score")
    score, at = scorer(docs, index, k), docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [s for s, _ in score(batch.column(at).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_texts(docs, work, f"{schema}, score double", text_col)


def training_rows():
    """The rows that may teach: all but the held-out fifth."""
    return remainder("doc_id", 5) != 0
