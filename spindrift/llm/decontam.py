"""Benchmark decontamination by pigeonhole edit matching.

A test item may appear in a text with up to k edits (insertions, deletions,
substitutions of characters). Cut the item into k + 1 pieces: one of them is then
there unchanged. One automaton holds the pieces of all items; each hit gives the place
where the item would stand, and Myers' bit-parallel algorithm gives the least number
of edits between the item and any part of the text around that place.

Both sides are compared in lower case, with every run of characters that are neither
letters nor digits taken as one space; whole texts are searched.

Defined results: null and empty texts match nothing, nor do null or empty items; items
under least_chars match without edits and as whole words only; one row for every document and item that match, with the
fewest edits and the first place that has them; repeated items match each on their
own; an empty table on either side gives an empty result; only the columns named are
read, so clashing names cannot matter; repeated documents give repeated rows. The
benchmark is read and held in parts of about part_chars characters, one after the other,
and the documents are read once for each part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import durable, map_texts

ERROR_RATE, LEAST_CHARS, PART_CHARS = 0.06, 24, 8_000_000
_gaps = re.compile(r"[\W_]+").sub
FOUND = "doc_id long, item_id long, edits int, budget int, start long, end long, item_chars int"


def plain(text: str) -> str:
    return _gaps(" ", text.lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Fewest edits (if at most `most`) between item and a part of text, and where that part ends first."""
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    size = len(item)
    mask, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = mask, 0, size, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(h | plus) & mask), plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = down | (~(x | up) & mask), up & x
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """The pieces of some items, and the search for them."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_chars: int) -> None:
        self.least_chars = least_chars
        self.items = [(i, p, int(len(p) * error_rate) if len(p) >= least_chars else 0) for i, t in items if (p := plain(t or ""))]
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                held.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item id, edits, budget, start, end, item's length) for each item that the plain text holds."""
        if not self.items:
            return []
        text = plain(text)
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                places.setdefault(n, set()).add(end + 1 - size - at)
        found = []
        for n, starts in places.items():
            item_id, item, errors = self.items[n]
            if len(item) < self.least_chars:
                starts = {s for s in starts if text[s - 1 : s] in ("", " ") and text[s + len(item) : s + len(item) + 1] in ("", " ")}
                if starts:
                    found.append((item_id, 0, 0, min(starts), min(starts) + len(item), len(item)))
                continue
            best = None
            for a, b in windows(sorted(starts), errors, len(item), len(text)):
                at = text.find(item, a, b)
                got = (0, at + len(item)) if at >= 0 else myers(item, text[a:b], errors)
                if got and at < 0:
                    got = got[0], got[1] + a
                if got and (best is None or got < best):
                    best = got
                if best and not best[0]:
                    break
            if best:
                back = myers(item[::-1], text[max(0, best[1] - len(item) - errors) : best[1]][::-1], best[0]) if best[0] else (0, len(item))
                found.append((item_id, best[0], errors, best[1] - (back[1] if back else len(item)), best[1], len(item)))
        return found


def windows(starts: list[int], errors: int, size: int, end: int) -> list[tuple[int, int]]:
    """Parts of a text that hold every place where an item may stand, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s in starts:
        a, b = max(0, s - errors), min(end, s + size + errors)
        if out and a <= out[-1][1] - size:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def benchmark_parts(benchmark: DataFrame, part_chars: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in parts of bounded size, each read when it is asked for, and whether it is the last one."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, 2 * total // part_chars)
    for k in range(n):
        own = sized.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else sized
        yield [(r.item_id, r.text) for r in own.toLocalIterator()], k == n - 1


def contamination(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """One row for every document and test item whose text the document holds with at most error_rate edits a character."""
    docs, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for part, is_last in benchmark_parts(benchmark, part_chars):
        shared = docs.sparkSession.sparkContext.broadcast((part, error_rate, least_chars))
        found = map_texts(docs, searcher(shared), FOUND)
        if not is_last:  # a part is let go of before the next one is read
            found = durable(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def searcher(shared):
    held: list[Matcher] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not held:
            held.append(Matcher(*shared.value))
        rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for x in held[0].search(t)]
        if not rows:
            return None
        d, i, e, k, a, b, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32())], names=["doc_id", "item_id", "edits", "budget", "start", "end", "item_chars"])

    return work


def without_hits(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """docs without the rows whose text holds a test item, all columns kept; nothing is joined or shuffled."""
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for part, is_last in benchmark_parts(benchmark, part_chars):
        shared = docs.sparkSession.sparkContext.broadcast((part, error_rate, least_chars))
        docs = map_texts(docs, keeper(shared, at), schema)
        if not is_last:
            docs = durable(docs)
            shared.destroy()
    return docs


def keeper(shared, at: int):
    held: list[Matcher] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Matcher(*shared.value))
        return batch.filter(pa.array([not (t and held[0].search(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return work
