"""Plain versions of the contracts, row by row, to hold the queries against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def word_sets(docs: list[tuple]) -> list[set]:
    out = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


def near_duplicates(docs: list[tuple]) -> dict:
    sets = word_sets(docs)
    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            holds[t].append(i)
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        count = defaultdict(int)
        for t in s:
            for j in holds[t]:
                if j < i:
                    count[j] += 1
        for j, n in count.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(docs):
        first[root(i)] = min(first.get(root(i), d), d)
    return {d: (len(sets[i]), first[root(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)}


def base_secrets(text: str | None) -> tuple:
    text = text or ""
    spans = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    names = ("assign", "access", "hex")
    shown = [f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    return (*(sum(k == n for _, k, _ in spans) for n in range(3)), sha(",".join(shown)), shown)


def base_licenses(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def chat_digest(turns: list[tuple[str, str]]) -> tuple:
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def top_k(vectors: list[tuple], k: int = 5) -> list[tuple]:
    import math

    rows = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), -(2**63)), i) for m, (i, b) in enumerate(rows) if m != n and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def toxicity(docs: dict, labels: list[tuple], k: int = 10) -> dict:
    """Scores of texts by id: TF-IDF with relevance, all cosines, votes, calibration by leaving one out. labels: (doc_id, toxic)."""
    import math

    def counts(text: str | None) -> dict:
        out = defaultdict(int)
        for w in re.findall(r"\w+", (text or "").lower()):
            out[w, 0] += 1
            for n in (4, 5, 6):
                if len(w) >= n:
                    out[w[:n], n] += 1
        return out

    taught = [(d, y) for d, y in labels if d is not None and y in (0, 1) and zlib.crc32(str(d).encode()) % 5]
    n_class = [sum(y == c for _, y in taught) for c in (0, 1)]
    examples = defaultdict(lambda: [0, 0, 1 << 62])
    for d, y in sorted({(d, y) for d, y in taught if d in docs}):
        e = examples[docs[d] or ""]
        e[y] += 1
        e[2] = min(e[2], d)
    n = [sum(e[c] for e in examples.values()) for c in (0, 1)]
    vectors = {t: counts(t) for t in examples}
    held = defaultdict(lambda: [0, 0])
    for t, e in examples.items():
        for w in vectors[t]:
            held[w][0] += e[0]
            held[w][1] += e[1]

    def weight(w) -> float:
        if w not in held:
            return 0.0
        p, q = (held[w][1] + 0.5) / (n[1] + 1), (held[w][0] + 0.5) / (n[0] + 1)
        mean = (sum(held[w]) + 1) / (sum(n) + 2)
        z = (p - q) ** 2 / (mean * (1 - mean) * (1 / n[0] + 1 / n[1]))
        return (math.log((sum(n) + 1) / (sum(held[w]) + 1)) + 1) * z / (z + 2 * math.log(max(len(held), 2)))

    def unit(c: dict) -> dict:
        v = {w: (1 + math.log(f)) * weight(w) for w, f in c.items() if w in held}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    units = {t: unit(c) for t, c in vectors.items()}
    rates = [n_class[c] / sum(n_class) / (n[c] / sum(n)) for c in (0, 1)]

    def share(text: str | None, k: int, out: tuple | None = None) -> float | None:
        v = unit(counts(text))
        cosines = {t: round(sum(x * u.get(w, 0.0) for w, x in v.items()), 9) for t, u in units.items()}
        least = sorted(cosines.values())[-k] if len(cosines) >= k else 0.0
        votes = [0.0, 0.0]
        for t, c in cosines.items():
            if c >= least and c > 0:
                for y in (0, 1):
                    votes[y] += (examples[t][y] - (out == (t, y))) * rates[y] / (1e-3 + 1 - min(c, 1))
        return votes[1] / sum(votes) if sum(votes) else None

    points = defaultdict(lambda: [0.0, 0.0])
    for t, e in examples.items():
        for y in (0, 1):
            if e[y] and (s := share(t, k + 1, (t, y))) is not None:
                points[round(s, 9)][0] += rates[y] * e[y]
                points[round(s, 9)][1] += rates[y] * y * e[y]
    steps = []
    for x in sorted(points):
        steps.append([*points[x], x, x])
        while len(steps) > 1 and steps[-2][1] / steps[-2][0] >= steps[-1][1] / steps[-1][0]:
            last = steps.pop()
            steps[-1] = [steps[-1][0] + last[0], steps[-1][1] + last[1], steps[-1][2], last[3]]
    edges = [(x, s / m) for m, s, a, b in steps for x in (a, b)]

    def calibrated(x: float) -> float:
        if x <= edges[0][0]:
            return edges[0][1]
        for (a, p), (b, q) in zip(edges, edges[1:], strict=False):
            if a <= x <= b:
                return q if a == b else p + (q - p) * (x - a) / (b - a)
        return edges[-1][1]

    prior = n_class[1] / sum(n_class)
    return {d: prior if (s := share(t, k)) is None else calibrated(s) for d, t in docs.items()}


def least_edits(item: str, text: str) -> int:
    """Fewest edits between item and a part of text, by the whole table."""
    import numpy as np

    chars = np.array([ord(c) for c in text], np.int64)
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, a in enumerate(item, 1):
        new = row + 1
        new[0] = i
        new[1:] = np.minimum(new[1:], row[:-1] + (chars != ord(a)))
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def holds_item(text: str | None, items: list[str], error_rate: float = 0.06, least_chars: int = 24) -> bool:
    hay = plain(text or "")
    for item in filter(None, map(plain, items)):
        if len(item) < least_chars:
            if f" {item} " in f" {hay} ":
                return True
        elif hay and least_edits(item, hay) <= int(len(item) * error_rate):
            return True
    return False


def without_spans(text: str | None) -> str | None:
    """The text with what base_secrets finds replaced, overlapping spans as one."""
    out, at = [], 0
    for shown in base_secrets(text)[4]:
        _, a, b = shown.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], "[secret]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]]) if out else text
