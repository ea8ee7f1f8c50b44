"""License scans by a positional rare-token index.

Templates are paragraphs of licence texts, their standard notices, short notices and
identifier lines, each with key phrases. The index holds, for every key phrase, its two
words of highest idf among the scanned files and where they stand in it. A file's licence
words are looked up from the highest idf down; the places of a phrase's two words, each
less its place in the template, are intersected, and where they agree the phrase is
verified word for word. A verified phrase counts with a score from 0.5 to 1: half of it
is the idf-weighted share of the template's words that stand at their places.

Beside that, base phrases are found as words that stand consecutively, through the same
index (each base phrase is a template whose key phrase is all of it).

Defined results: a null or empty text has no words, no labels and score 0; whole texts of
any length are searched; every place of a phrase is found, and of phrases of one label that
begin at one word the longest counts; labels list each label once, n_base counts every
place; repeated rows give repeated results; an empty table gives an empty table; columns
other than the id and the text are dropped, so clashing names cannot matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import map_texts, text_slices
from spindrift.llm.licence_texts import TEMPLATES

#: A word: a run of ASCII letters (lower case), digits and characters beyond ASCII.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes.lower() changes A-Z alone


class LicenceIndex:
    """Key phrases of templates (and base phrases as templates of their own) by their two rarest words. idf: of words, by default among the templates."""

    def __init__(self, templates=TEMPLATES, base=BASE, idf: dict[str, float] | None = None) -> None:
        bodies = [(label, [k.split() for k in keys], words_of(text), False) for label, keys, text in templates] + [(label, [phrase.split()], phrase.split(), True) for phrase, label in base.items()]
        if idf is None:
            seen = Counter(w for _, _, body, _ in bodies for w in set(body))
            idf = {w: log(1 + len(bodies) / n) for w, n in seen.items()}
        self.idf = idf
        self.most = max(idf.values(), default=1.0)
        #: label, key phrase, its place in the body, body, whether it is a base phrase
        self.entries = [(label, key, next(i for i in range(len(body)) if body[i : i + len(key)] == key), body, is_base) for label, keys, body, is_base in bodies for key in keys]
        self.postings: dict[str, list[tuple[int, int, str, int]]] = defaultdict(list)
        for e, (_, key, _, _, _) in enumerate(self.entries):
            rare = sorted(range(len(key)), key=lambda i, key=key: (-self.of(key[i]), i))[:2]
            self.postings[key[rare[0]]].append((e, rare[0], key[rare[-1]], rare[-1]))
        self.rarest_first = sorted(self.postings, key=lambda w: (-self.of(w), w))
        self.watched = set(self.postings) | {w for x in self.postings.values() for _, _, w, _ in x}

    def of(self, word: str) -> float:
        return self.idf.get(word, self.most)

    def candidates(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(phrase, place where it begins) wherever its two rarest words stand as they do in it."""
        known = self.watched.intersection(words)
        if not known.intersection(self.postings):
            return
        places: dict[str, list[int]] = {w: [] for w in known}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        for word in self.rarest_first:
            if word in known:
                for e, i, other, j in self.postings[word]:
                    if other == word:
                        yield from ((e, p - i) for p in places[word] if p >= i)
                    elif other in known:
                        yield from ((e, s) for s in sorted({p - i for p in places[word]}.intersection([p - j for p in places[other]])) if s >= 0)

    def scan(self, text: str) -> dict:
        words = words_of(text)
        base, found = [], {}
        for e, at in self.candidates(words):
            label, key, offset, body, is_base = self.entries[e]
            if words[at : at + len(key)] != key:
                continue
            if is_base:
                base.append({"label": label, "start": at})
            start = at - offset
            whole = sum(map(self.of, body))
            there = sum(self.of(w) for i, w in enumerate(body) if 0 <= start + i < len(words) and words[start + i] == w)
            new = {"label": label, "start": at, "end": at + len(key), "score": 0.5 + 0.5 * (there / whole if whole else 1.0)}
            old = found.get((label, at))
            if old is None or (new["end"], new["score"]) > (old["end"], old["score"]):
                found[label, at] = new
        return {"n_words": len(words), "base": sorted(base, key=lambda x: (x["start"], x["label"])), "found": sorted(found.values(), key=lambda x: (x["start"], x["label"]))}


def corpus_idf(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, base=BASE) -> dict[str, float]:
    """idf among all texts of docs of every word of the templates (no others are gathered)."""
    vocabulary = {w for _, _, text in templates for w in words_of(text)} | {w for phrase in base for w in phrase.split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in text_slices(batches, text_col):
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words_of(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    got = {r.word: r.n for r in docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = got.pop("", 0)
    return {w: log(1 + n / (1 + got.get(w, 0))) for w in sorted(vocabulary)}


FOUND = "n_words long, base array<struct<label:string,start:long>>, found array<struct<label:string,start:long,end:long,score:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE, idf: dict[str, float] | None = None) -> DataFrame:
    """id_col, n_words, base (places of base phrases) and found (verified phrases, with word spans and scores). idf: by default that of docs, which are read once more for it."""
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    idf = corpus_idf(docs, text_col, templates, base) if idf is None else idf
    held: list[LicenceIndex] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(LicenceIndex(templates, base, idf))
        rows = [held[0].scan(t or "") for t in batch.column(1).to_pylist()]
        columns = [pa.array([r["n_words"] for r in rows], pa.int64()), pa.array([r["base"] for r in rows], base_type), pa.array([r["found"] for r in rows], found_type)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_words", "base", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, {FOUND}", text_col)
