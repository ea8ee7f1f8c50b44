"""SentencePiece (BPE) encoding and decoding by a merge-type prefix table.

For every prefix of a segment the encoding ends in one token that is the only one
possible: of the vocabulary matches that end there (found by an Aho-Corasick
automaton), the one that is compatible with the last token of the prefix before it.
Two tokens are compatible when merging their joined text gives the two again. The
table holds that last token for each prefix; the ids are read from its end backwards.

Segments are cut where no vocabulary piece can reach across: before a character that
never follows another one within a piece, and where a space mark follows anything
else. This keeps the table short and lets repeated segments be looked up.

Defined results: a null text counts as empty; an empty text gives the end id alone;
texts of any length are encoded whole; a model without an end id adds none, and one that
normalises its text is refused; characters outside the vocabulary become their
UTF-8 byte pieces; repeated rows give repeated results; an empty table gives an empty
table; other columns of the input are dropped, so clashing names cannot matter.
"""

from __future__ import annotations

import re
from collections import ChainMap
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from spindrift.llm.common import map_texts, one_a_worker

MARK = "▁"
#: Remembered segments and pairs a worker; beyond that the memory starts anew.
SEGMENTS, PAIRS = 250_000, 300_000
#: Characters from which a segment is not remembered.
LONG = 100
NEVER = 1 << 30
#: Fixed value: how the unknown id reads.
UNKNOWN = " ⁇ "


class PrefixTable:
    """The vocabulary of a model file, and what is derived from it."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        probe = "ﬁ Ａ  b\u00a0\u0301 \t\u2028x "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises its text; only models that leave it as it is can be read")
        self.end_id = model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unused(i)}
        unknown = {i for i in range(n) if model.is_unknown(i)}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        normal = [i for i in range(n) if i not in self.special and i not in unknown and i not in self.byte_of]
        self.id_of = {self.pieces[i]: i for i in normal}
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.length = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds a space mark after another character; segments cannot be cut there")
        known = {p for p in self.id_of if len(p) == 1} - {MARK}
        inner = {c for p in self.id_of for c in p[1:]} - {MARK}
        cls = lambda chars: "".join(re.escape(c) for c in sorted(chars))
        self.segments = re.compile(f"{MARK}+[{cls(inner)}]*|[^{MARK}{cls(known)}]|[^{MARK}][{cls(inner)}]*").findall
        self.compatible: dict[int, bool] = {}
        self.edges: dict[int, dict[int, list[tuple[int, str]]]] = {0: {}, -1: {}}
        self.known: dict[str, tuple[int, ...]] = {}
        self.alone = {i: self.merged(self.pieces[i]) == [i] for i in normal if len(self.pieces[i]) > 1}
        self.shown = ["" if i in self.special else UNKNOWN if i in unknown else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.shown)]
        self.raw, self.raw_length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.spaced = np.array([i not in self.special and p.startswith(MARK) for i, p in enumerate(self.pieces)])

    def __reduce__(self):  # pragma: no cover - a table is built where it is used
        raise TypeError("build a table on each worker from the path of its model file")

    def merged(self, text: str) -> list[int]:
        """Ids of a short text by merging the best neighbouring pair, leftmost first, until none is left."""
        return [self.id_of.get(p, -1) for p in self.steps(text)[-1][1]]

    def steps(self, text: str) -> list[tuple[int, list[str]]]:
        """The parts of a short text before its first merge and after each, with the rank of the merge that comes next (NEVER at the end)."""
        parts, out = list(text), []
        while True:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks, default=NEVER)
            out.append((best, parts))
            if best == NEVER:
                return out
            at = ranks.index(best)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]

    def edge(self, i: int, side: int) -> list[tuple[int, str]]:
        """How a token grows: its outermost part (side 0: first, -1: last) and the rank of the merge that comes next, step by step."""
        found = self.edges[side].get(i)
        if found is None:
            found = self.edges[side][i] = [(rank, parts[side]) for rank, parts in self.steps(self.pieces[i])]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge across the two comes before the merges within them, each side growing in its own order."""
        key = left << 20 | right
        found = self.compatible.get(key)
        if found is not None:
            return found
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        a, b, i, j, rank, found = self.edge(left, -1), self.edge(right, 0), 0, 0, self.rank, True
        while True:
            (in_a, x), (in_b, y) = a[i], b[j]
            across = rank.get(x + y, NEVER)
            if across < in_a and across <= in_b and across != NEVER:
                found = False
                break
            if in_a == NEVER and in_b == NEVER:
                break
            if in_a <= in_b:
                i += 1
            else:
                j += 1
        self.compatible[key] = found
        return found

    def encode_segment(self, segment: str) -> list[int]:
        whole = self.id_of.get(segment)
        if whole is not None and (len(segment) == 1 or self.alone[whole]):
            return [whole]
        if len(segment) == 1:
            return [self.byte_ids[b] for b in segment.encode("utf-8", "replace")]
        last, length, fits, pairs = [-1] * (len(segment) + 1), self.length, self.fits, self.compatible
        for end, i in self.automaton.iter(segment):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[i]
            if (last[start] >= 0 and ((seen := pairs.get(last[start] << 20 | i)) or seen is None and fits(last[start], i))) if start else (end == 1 or self.alone[i]):
                last[end] = i
        ids, at = [], len(segment)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def encode(self, text: str, end: bool = True) -> np.ndarray:
        """Ids of the whole text, with the model's end id where it has one."""
        ids: np.ndarray = np.empty(0, np.int32)
        if text:
            segments = self.segments(MARK + text.replace(" ", MARK))
            new = set(segments).difference(self.known)
            if len(self.known) + len(new) > SEGMENTS:
                self.known.clear()
                new = set(segments)
            own: dict[str, tuple[int, ...]] = {}  # long segments, and all of a text that has more than are remembered
            keep = len(new) <= SEGMENTS
            for segment in new:
                (self.known if keep and len(segment) < LONG else own)[segment] = tuple(self.encode_segment(segment))
            known = ChainMap(own, self.known) if own else self.known
            ids = np.fromiter(chain.from_iterable(map(known.__getitem__, segments)), np.int32)
        return np.append(ids, np.int32(self.end_id)) if end and self.end_id >= 0 else ids

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: special ids say nothing, runs of byte pieces are read as UTF-8, the leading space goes."""
        ids = [i for i in ids if i not in self.special]
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                else:
                    if run:
                        parts.append(lenient(bytes(run)))
                        run.clear()
                    parts.append(self.shown[i])
            text = "".join(parts) + lenient(bytes(run))
        return text[1:] if ids and ids[0] not in self.byte_of and self.pieces[ids[0]].startswith(MARK) else text

    def decode_all(self, flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Texts of many rows, whose ids stand one after the other, by gathering the pieces' bytes."""
        row_ends = np.cumsum(lengths)
        size = self.raw_length[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.raw_start[flat] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        starts, stops = ends[row_ends - lengths], ends[row_ends]
        first = np.minimum(row_ends - lengths, max(len(flat) - 1, 0))
        plain = np.zeros(len(lengths), bool)
        if len(flat):
            plain = (lengths > 0) & self.spaced[flat[first]]
        starts = starts + plain
        texts = []
        for row, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            own = flat[row_ends[row] - lengths[row] : row_ends[row]]
            try:
                if lengths[row] and int(own[0]) in self.special:
                    raise ValueError
                texts.append(data[a:b].decode())
            except ValueError:  # a special id first, or bytes that are no UTF-8
                texts.append(self.decode(own.tolist()))
        return pa.array(texts, pa.string())


def lenient(data: bytes) -> str:
    """UTF-8, with one U+FFFD for every byte that is no part of a character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + lenient_rest(data[e.start + 1 :])


def lenient_rest(data: bytes) -> str:
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


def table_of(path: str) -> PrefixTable:
    """The table of a model file, built once a worker."""
    return one_a_worker(path, lambda: PrefixTable(path))


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """id_col and ids array<int> of every whole text. model: path of the model file on every machine."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = table_of(model).encode
        found = [encode(t or "", end) for t in batch.column(1).to_pylist()]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, ids array<int>", text_col)


def decode_ids(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids_col and the decoded text of every row; null ids count as none."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(1)
        lengths = np.array(pc.fill_null(pc.list_value_length(ids), 0))
        flat = np.asarray(ids.flatten(), np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), ids, table_of(model).decode_all(flat, lengths)], names=[id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_texts(encoded.select(id_col, ids_col), work, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string", ids_col)
