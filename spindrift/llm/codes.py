"""Texts as arrays of code points: runs of characters of a kind, and hashes of any part of a run.

Work is done in chunks of about CHUNK characters that end between runs, so memory does
not grow with the length of a text (but for a run that is longer than a chunk).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

CHUNK = 200_000
_base = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, for every value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def is_word() -> np.ndarray:
    """For each code point whether it is a letter, a digit or _."""
    return np.frombuffer(bytes(chr(c).isalnum() or c == 95 for c in range(0x110000)), bool)


@cache
def is_letter() -> np.ndarray:
    return np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, 2^bits of each."""
    up = np.full(1 << bits, _base, np.uint64)
    down = np.full(1 << bits, pow(_base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_between = re.compile(r"\W").search


def chunks(texts: list[str]) -> Iterator[tuple[list[int], str]]:
    """(where the part of each text in it begins, parts of the texts, a line end after each), each about CHUNK characters or one run.

    The begins are negative one where a text has no part in the chunk: begins of a chunk are given for the texts
    from the first to the last that are in it, by place: (place, begin) pairs.
    """
    held: list[str] = []
    begins: list[tuple[int, int]] = []
    size = 0
    for place, text in enumerate(texts):
        at = 0
        while True:
            room = CHUNK - size
            if len(text) - at <= room:
                end = len(text)
            else:
                cut = _between(text, at + max(room, 0))
                end = cut.start() if cut else len(text)
            begins.append((place, size))
            held.append(text[at:end])
            size += end - at + 1
            at = end
            if size >= CHUNK:
                yield begins, "\n".join(held)
                held, begins, size = [], [], 0
            if at >= len(text):
                break
    if held:
        yield begins, "\n".join(held)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which part_hash takes the hash of any part."""
    up, _ = powers(max(int(len(codes)).bit_length(), 18))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])


def part_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the characters of each part, wherever it stands."""
    _, down = powers(max(int(len(total) - 1).bit_length(), 18))
    return mixed((total[ends] - total[starts]) * down[starts] + np.uint64(salt))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
