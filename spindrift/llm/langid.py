"""Language identification in two levels.

First linear support vector machines, one for each two families, choose the family;
then one for each two languages of that family choose the language. Features are the
character 1- to 3-grams of the words (runs of letters, with word ends), hashed; a text's
features are their shares. They are counted over whole texts in chunks that end between
words, however long a word is.

Learning is bounded: per_language documents of a language, or sample_rows over the number of
languages where that is less, those with the smallest hash of their id. Prediction covers
every row and whole texts.

Defined results: null texts and texts without a letter are `und` with score 0, as is
everything when there is nothing to learn from; with one learned language that one is
predicted with score 1; repeated rows are predicted alike, and teach once (an id with several
texts by the least of them, an id with several languages each of them); an empty table gives
an empty table; columns other than the id and the text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import codes
from spindrift.llm.common import durable, map_texts, remainder

DIMENSIONS, PER_LANGUAGE, SAMPLE_ROWS, BATCH = 4096, 400, 20_000, 256
#: Families of languages; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz",
    "sinitic": "zh yue",
    "indic": "hi ur bn pa mr gu ne",
    "semitic": "ar he am",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """For each text how often each hashed n-gram occurs, and after them the number of all n-grams."""
    out = np.zeros((len(texts), DIMENSIONS + 1))
    for begins, part in codes.chunks([(t or "").lower() for t in texts]):
        points = codes.code_points(part)
        letter = codes.is_letter()[points]
        # one 0 stands for all that lies between two words; every chunk begins and ends with one
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        at = np.flatnonzero(kept)
        if not len(at):
            continue
        line = np.concatenate([[0], np.where(letter[at], points[at], 0), [0]]).astype(np.uint32)
        places = np.concatenate([at[:1], at, at[-1:]])
        one = mixed32(line * np.uint32(0x9E3779B1) + np.uint32(1))
        two = mixed32(one[:-1] * np.uint32(0x85EBCA77) + line[1:])
        three = mixed32(two[:-1] * np.uint32(0xC2B2AE3D) + line[2:])
        filled = line > 0
        # an n-gram belongs to the text of a letter in it
        grams = ((one, filled, places), (two, filled[:-1] | filled[1:], np.where(filled[:-1], places[:-1], places[1:])), (three, filled[1:-1], places[1:-1]))
        for values, real, where in grams:
            values, where = values[real] & np.uint32(DIMENSIONS - 1), where[real]
            cuts = np.append(np.searchsorted(where, [begin for _, begin in begins]), len(where))
            for (row, _), a, b in zip(begins, cuts, cuts[1:], strict=False):
                if b > a:
                    out[row, :-1] += np.bincount(values[a:b], minlength=DIMENSIONS)
                    out[row, -1] += b - a
    return out


def mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled shares of the n-grams of each text, the last one constant; and whether the text has any."""
    counts = gram_counts(texts)
    shares = counts[:, :-1] * (SCALE / np.maximum(counts[:, -1:], 1))
    return np.concatenate([shares, np.ones((len(texts), 1))], axis=1), counts[:, -1] > 0


SCALE = 30.0


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent in a fixed order."""
    alpha, w, square = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(1) + 0.5 / cost
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


class Model:
    """duels: for families and, within a family, for languages: (name, name, weights)."""

    def __init__(self, languages: dict[str, list[str]], duels: dict[str, list[tuple[str, str]]], weights: np.ndarray) -> None:
        self.languages, self.duels, self.weights = languages, duels, weights
        self.column, n = {}, 0
        for level, pairs in duels.items():
            self.column[level] = slice(n, n + len(pairs))
            n += len(pairs)

    def winner(self, level: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Name with most duels won, then with the largest sum of margins; its mean sigmoid is the score."""
        if len(names) == 1:
            return names[0], 1.0
        votes = {x: [0, 0.0, 0.0] for x in names}
        for (a, b), m in zip(self.duels[level], margins[self.column[level]], strict=True):
            for name, own in ((a, m), (b, -m)):
                v = votes[name]
                v[0] += own > 0
                v[1] += own
                v[2] += 1 / (1 + np.exp(-2 * max(min(own, 50), -50)))
        best = max(sorted(names), key=lambda x: (votes[x][0], votes[x][1]))
        return best, votes[best][2] / (len(names) - 1)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for at in range(0, len(texts), BATCH):
            x, some = features(texts[at : at + BATCH])
            for margins, there in zip(x @ self.weights, some.tolist(), strict=True):
                if not self.languages or not there:
                    yield "und", 0.0
                    continue
                family, p = self.winner("", sorted(self.languages), margins)
                language, q = self.winner(family, self.languages[family], margins)
                yield language, float(p * q)


def sample(docs: DataFrame, keep, per_language: int, sample_rows: int) -> tuple[DataFrame, int]:
    """doc_id, lang, h and text of somewhat more than the wanted number of documents a language, those under a bound of the hash h of their id; and that number.

    The bounds follow from the languages' counts, so no language's rows meet in one task and what is gathered is bounded.
    """
    teachers = docs.where(keep).where("lang is not null and text is not null and doc_id is not null")
    counts = {r.lang: r["count"] for r in teachers.groupBy("lang").count().collect()}
    each = max(1, min(per_language, sample_rows // max(1, len(counts))))
    # the unsigned hash of a row of n is under this with probability (each + 6 of its root) / n
    bound = {lang: min(1.0, (each + 6 * each**0.5) / n) for lang, n in counts.items()}
    limits = docs.sparkSession.createDataFrame([(lang, int(p * 2.0**62)) for lang, p in bound.items()], "lang string, most long")
    low = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)
    picked = teachers.join(F.broadcast(limits), "lang").where(low < F.col("most")).select("doc_id", "lang", low.alias("h"), "text")
    return durable(picked.groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))), each


def fit(docs: DataFrame, keep, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> tuple:
    """What Model takes, learned from at most per_language documents of each language; keep: condition on doc_id."""
    taught, each = sample(docs, keep, per_language, sample_rows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, _ = features(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([m.tobytes() for m in x.astype(np.float32)], pa.binary())], names=["doc_id", "lang", "h", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(taught.select("doc_id", "lang", "text", "h"), work, f"doc_id {kind}, lang string, h long, x binary").toPandas()
    rows = rows.sort_values(["lang", "h", "doc_id"]).groupby("lang").head(each).sort_values(["doc_id", "lang"])
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]], np.float64).reshape(len(rows), DIMENSIONS + 1)
    lang = rows["lang"].to_numpy(object)
    languages: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        languages.setdefault(FAMILY_OF.get(name, f"of {name}"), []).append(name)
    family = np.array([FAMILY_OF.get(n, f"of {n}") for n in lang], object)
    duels = {"": list(combinations(sorted(languages), 2))}
    duels |= {f: list(combinations(names, 2)) for f, names in languages.items()}
    todo = [(level, a, b) for level, pairs in duels.items() for a, b in pairs]
    weights = trained(docs.sparkSession, todo, x, lang, family)
    return languages, duels, np.array(weights).T if weights else np.zeros((DIMENSIONS + 1, 0))


def trained(spark, duels: list[tuple[str, str, str]], x: np.ndarray, lang: np.ndarray, family: np.ndarray) -> list[np.ndarray]:
    """The machine of every duel, each trained in a task of its own on the bounded sample."""
    if not duels:
        return []
    shared = spark.sparkContext.broadcast((x.astype(np.float32), lang, family))
    numbered = spark.createDataFrame(list(enumerate(duels)), "n long, duel struct<level:string,a:string,b:string>").repartition(min(len(duels), 256))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, duel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, own_lang, own_family = shared.value
                side = own_lang if duel["level"] else own_family
                some = (side == duel["a"]) | (side == duel["b"])
                w = support_vectors(rows[some].astype(np.float64), np.where(side[some] == duel["a"], 1.0, -1.0))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["n", "w"])

    found = {r.n: np.frombuffer(r.w) for r in numbered.mapInArrow(train, "n long, w binary").collect()}
    shared.unpersist()
    return [found[n] for n in range(len(duels))]


def predict_languages(docs: DataFrame, learned: tuple) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(Model(*shared.value).predict(batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double")


def training_rows():
    """The rows that may teach: all but the held-out third."""
    return remainder("doc_id", 3) != 1
