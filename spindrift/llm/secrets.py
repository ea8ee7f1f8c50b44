"""Secret scans with a recursive decoding worklist.

The whole text is searched as it is (the base spans). Then layers are unwrapped: URL
escapes and Unicode escapes of a layer as a whole (an escape whose own mark is escaped, any
number of times over, in one step), base64 runs one by one, in parts between slashes, and
joined over the lines they are wrapped at, and compressed bytes that base64 held. Every new
layer is searched and goes back on the worklist; a layer that was seen before at the same
place of this text is not taken again, so the work ends, and each copy of a layer is
reported. Each character of a layer knows the part of the source text it comes from, so
what a layer shows is reported as a span of the source.

Defined results: a null text counts as empty and has no spans; texts of any length are
searched whole, and so are compressed layers of any size and with any number of members,
in parts that end at line ends, up to where a stream is broken; repeated rows give repeated
results; an empty table gives an empty table; columns other than the id and the text are
dropped, so clashing names cannot matter. Redaction keeps every row and column.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from spindrift.llm.common import map_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = re.compile(r"passw|secret|token|api_?key")
#: %2541, %252541 and so on are one escape of the same character as %41; likewise \\u005cu0041 and \\x5cx41.
URL_ESCAPES = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(r"(?:\\u(?:005[cC]u)*[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x(?:5[cC]x)*[0-9A-Fa-f]{2}")
MARKS_OF_MARKS = (re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})"), re.compile(r"\\u(?:005[cC]u)+(?=[0-9A-Fa-f]{4})"), re.compile(r"\\x(?:5[cC]x)+(?=[0-9A-Fa-f]{2})"))
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
NEXT_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])", re.ASCII)
#: Line ends that no match, escape or base64 run crosses.
SAFE_END = re.compile(r"[^A-Za-z0-9+/_=\r\n-]\r?\n")
#: Bytes of a compressed layer that are opened at once, and characters that are searched at once.
PIECE, PART = 1 << 20, 4 << 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the text shows as it is."""
    found = []
    if (":" in text or "=" in text) and KEYWORDS.search(text.lower()):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def unescape_url(run: str) -> str:
    return unquote_to_bytes(MARKS_OF_MARKS[0].sub("%", run)).decode("utf-8", "replace")


def unescape_unicode(run: str) -> str:
    run = MARKS_OF_MARKS[2].sub(r"\\x", MARKS_OF_MARKS[1].sub(r"\\u", run))
    codes = [int(x or y or z or w, 16) for x, y, z, w in re.findall(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})", run)]
    text = "".join(chr(c) if c < 0x110000 else "�" for c in codes)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def decompressor(head: bytes) -> tuple[Callable, bytes] | None:
    """What makes a decompressor, and how each member starts, of bytes that start so; None if they are not compressed."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2]) % 31 == 0:
        return lambda: zlib.decompressobj(47), head[:2]
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor, head[:3]
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor, head[:6]
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor, head[:4]
    return None


class Chunks:
    """Chunks as a file that is read forward."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks = chunks

    def read(self, size: int = -1) -> bytes:
        return next(self.chunks, b"")


def open_members(chunks: Iterator[bytes], new: Callable, magic: bytes) -> Iterator[bytes]:
    """What all members of a compressed stream hold, in pieces of at most PIECE bytes."""
    if new is zstandard.ZstdDecompressor:
        with new(max_window_size=1 << 31).stream_reader(Chunks(chunks), read_across_frames=True) as reader:
            while out := reader.read(PIECE):
                yield out
        return
    d, data = new(), b""
    for chunk in chunks:
        data += chunk
        while data:
            if d.eof:
                data = data.lstrip(b"\0")  # padding
                if len(data) < len(magic):
                    break
                if not data.startswith(magic):
                    return
                d = new()
            while True:
                out = d.decompress(data, PIECE)
                if out:
                    yield out
                data = d.unused_data if d.eof else getattr(d, "unconsumed_tail", b"")
                if d.eof or not data and len(out) < PIECE:
                    break


def opened(chunks: Iterator[bytes], new: Callable, magic: bytes) -> Iterator[bytes]:
    """open_members as far as the stream is whole."""
    try:
        yield from open_members(chunks, new, magic)
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
        return


def readable(chunks: Iterator[bytes]) -> bool:
    """Whether bytes are text: UTF-8 without control characters other than white space."""
    decoder, some = codecs.getincrementaldecoder("utf-8")(), False
    try:
        for chunk in chunks:
            text = decoder.decode(chunk)
            if CONTROL.search(text):
                return False
            some = some or bool(text)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return some


def text_parts(chunks: Iterator[bytes]) -> Iterator[str]:
    """Text in parts of about PART characters, cut only at line ends that nothing we look for can cross; a part grows until there is one."""
    decoder, held, size, least = codecs.getincrementaldecoder("utf-8")(), [], 0, PART
    for chunk in chunks:
        held.append(decoder.decode(chunk))
        size += len(held[-1])
        if size >= least:
            text = "".join(held)
            at = max((m.end() for m in SAFE_END.finditer(text)), default=0)
            if at:
                yield text[:at]
            held, size = [text[at:]], len(text) - at
            least = max(PART, 2 * size)
    if text := "".join(held):
        yield text


def base64_parts(run: str) -> Iterator[str]:
    """Text that a base64 run holds, through compressed layers, in parts."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return
    data = base64.b64decode(body + "=" * (-len(body) % 4))
    source, seen = (lambda: iter((data,))), set()
    while not readable(source()):
        if not (kind := decompressor(next(source(), b"")[:6])):
            return
        digest = hashlib.blake2b()
        for chunk in source():
            digest.update(chunk)
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        source = partial(lambda inner, kind: opened(inner(), *kind), source, kind)
    yield from text_parts(source())


def open_base64(run: str) -> list[str]:
    return list(base64_parts(run))


def unescaped(text: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with its escapes decoded, and for each character where its source starts and ends; None without escapes."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        new = decode(m[0])
        parts += [text[at : m.start()], new]
        plain = np.arange(at, m.start())
        starts += [plain, np.full(len(new), m.start())]
        ends += [plain + 1, np.full(len(new), m.end())]
        at = m.end()
    if not parts:
        return None
    plain = np.arange(at, len(text))
    return "".join([*parts, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


#: Where the characters of a layer come from: the source itself, one part of it for all, or a start and an end for each.
Place = None | tuple[int, int] | tuple[np.ndarray, np.ndarray]


def source_span(place: Place, start: int, end: int) -> tuple[int, int]:
    if place is None:
        return start, end
    a, b = place
    return (a, b) if isinstance(a, int) else (int(a[start]), int(b[end - 1]))


def layer_key(text: str, place: Place) -> bytes:
    """Digest of a layer and of where it comes from."""
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=32)
    for x in place or ():
        digest.update(b"\xff" + (str(x).encode() if isinstance(x, int) else x.tobytes()))
    return digest.digest()


def base64_runs(layer: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of base64 runs as they are, of their parts between slashes, and of those that lines of equal length make together, without and with a shorter line at their end."""
    wrapped = 0
    for m in BASE64.finditer(layer):
        yield m.start(), m.end(), m[0]
        if "/" in m[0]:
            at = m.start()
            for part in m[0].split("/"):
                if 16 <= len(part) < len(m[0]):
                    yield at, at + len(part), part
                at += len(part) + 1
        if m.start() < wrapped or m[0][-1] == "=":
            continue
        lines, end = [m[0]], m.end()
        while (n := NEXT_LINE.match(layer, end)) and len(n[1]) == len(m[0]):
            lines.append(n[1])
            end = wrapped = n.end()
            if n[1][-1] == "=":
                break
        if len(lines) > 1:
            yield m.start(), end, "".join(lines)
        if n and len(n[1]) < len(m[0]):
            yield m.start(), n.end(), "".join([*lines, n[1]])


def inner_layers(layer: str, place: Place) -> Iterator[tuple[str, Place]]:
    """Layers right under one, and where they come from; one lives at a time."""
    for pattern, decode, mark in ((URL_ESCAPES, unescape_url, "%"), (UNICODE_ESCAPES, unescape_unicode, "\\")):
        if mark in layer and (got := unescaped(layer, pattern, decode)):
            new, a, b = got
            yield new, (a, b) if place is None else place if isinstance(place[0], int) else (place[0][a], place[1][b - 1])
    for start, end, run in base64_runs(layer):
        for new in base64_parts(run):
            yield new, source_span(place, start, end)


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each by start and kind."""
    by = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=by)
    spans, seen = set(base), set()
    work = [inner_layers(text, None)]
    while work:
        if (found := next(work[-1], None)) is None:
            work.pop()
            continue
        new, at = found
        if (key := layer_key(new, at)) not in seen:
            seen.add(key)
            spans.update((*source_span(at, s, e), kind) for s, e, kind in base_spans(new))
            work.append(inner_layers(new, at))
    return base, sorted(spans, key=by)


SCANNED = "base array<struct<start:long,end:long,kind:string>>, spans array<struct<start:long,end:long,kind:string>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base (spans of the text as it is) and spans (those and what layers show) of every whole text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [all_spans(t) if t else ([], []) for t in batch.column(1).to_pylist()]
        lists = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x[n]] for x in both], span) for n in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[id_col, "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, {SCANNED}", text_col)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every span, and what overlaps it, replaced by mark."""
    out, at = [], 0
    for start, end, _ in all_spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets of each text replaced; every other column and every row stays; null texts stay null."""
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array([redact(t) if t else t for t in columns[at].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_texts(docs, work, schema, text_col)
