"""Markdown as text. Lines are classified once; everything else works on the classified lines.

A fence opens a state that lasts over lines, hence Arrow batches. Links are taken out by a
scanner that matches brackets, so links within links and addresses with brackets are whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import col

#: Phrases of lines that say nothing about a page's subject.
NOISE_PHRASES = ("privacy policy", "cookie policy", "terms of service", "all rights reserved", "sign up", "subscribe", "advertisement", "sponsored content", "related posts")
#: Lines that only lead past a menu.
SKIP_LINES = ("skip to main content", "跳到主要内容")
#: Where an image, a link, an anchor's tag or a bare address may begin.
_begins = re.compile(r"!?\[|(?P<tag></?a[\s>])|(?P<address><?https?://)", re.I)


class Line(NamedTuple):
    """A line: what it is, as it stands, and without its indent and mark."""

    kind: str  # blank, fence, code, table, divider, heading, quote, item, rule, reference or text
    raw: str
    body: str


def run_length(text: str, char: str) -> int:
    return len(text) - len(text.lstrip(char))


def marked(text: str) -> tuple[str, int] | None:
    """(kind, length of the mark with its space) of a heading, quote or list item."""
    hashes = run_length(text, "#")
    digits = len(text) - len(text.lstrip("0123456789"))
    for kind, size in (("heading", hashes if hashes <= 6 else 0), ("quote", int(text[:1] == ">")), ("item", int(text[:1] in "-*+")), ("item", digits + 1 if digits and text[digits : digits + 1] in (".", ")") else 0)):
        rest = text[size:]
        if size and (kind == "quote" or rest[:1].isspace()):
            return kind, size + len(rest) - len(rest.lstrip())
    return None


def classified(line: str) -> Line:
    """What a line outside code is."""
    text = line.strip()
    cells = text.strip("|").split("|")
    only = set(text) - set(" \t")
    if not text:
        return Line("blank", line, "")
    if run_length(text, "`") >= 3:
        return Line("fence", line, text)
    if len(cells) > 1 and all(len(c.strip().strip(":")) >= 3 and set(c.strip().strip(":")) == {"-"} for c in cells):
        return Line("divider", line, text)
    mark = marked(text)
    if text.count("|") >= 2:
        return Line("table", line, text[mark[1] :] if mark else text)
    if only <= {"=", "-"} and len(text) >= 2 and " " not in text or len(only) == 1 and only <= {"-", "*", "_"} and sum(map(text.count, only)) >= 3:
        return Line("rule", line, text)
    if mark:
        return Line(mark[0], line, text[mark[1] :])
    label = closing(text, 0, "[", "]") if text[0] == "[" else -1
    if label > 1 and text[label + 1 : label + 2] == ":" and text[label + 2 : label + 3].isspace() and text[label + 3 :].strip():
        return Line("reference", line, text)
    return Line("text", line, text)


def lines_of(markdown: str | None) -> Iterator[Line]:
    """The classified lines; a fence of at least the opening one's length closes a code block."""
    width = 0
    for line in re.split(r"\r\n|\r|\n", markdown or ""):
        ticks = run_length(line.strip(), "`")
        if ticks >= max(3, width):
            width = 0 if width else ticks
            yield Line("fence", line, line.strip())
        else:
            yield Line("code", line, line) if width else classified(line)


def closing(text: str, at: int, opens: str, closes: str) -> int:
    """Where the bracket that opens at `at` closes, brackets within it skipped; -1 if nowhere."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == opens) - (text[i] == closes)
        if not depth:
            return i
    return -1


def linked(text: str, at: int) -> tuple[str, str, int] | None:
    """(label, bracket of the target, end) of a link whose label opens at `at`."""
    end = closing(text, at, "[", "]")
    bracket = text[end + 1 : end + 2] if end > 0 else ""
    if bracket not in ("(", "["):
        return None
    last = closing(text, end + 1, bracket, {"(": ")", "[": "]"}[bracket])
    if last < 0 or bracket == "(" and last == end + 2:
        return None
    return text[at + 1 : end], bracket, last + 1


def without_links(text: str, alternatives: bool) -> str:
    """Links as their labels, images as their alternative texts or nothing, anchors' tags and bare addresses gone."""
    if not any(sign in text for sign in ("[", "<", "://")):
        return text
    out, i = [], 0
    while found := _begins.search(text, i):
        out.append(text[i : found.start()])
        i = found.start()
        image = text[i] == "!"
        link = linked(text, i + image) if image or text[i] == "[" else None
        if link and not (image and link[1] == "["):
            out.append(without_links(link[0], alternatives) if alternatives or not image else "")
            i = link[2]
        elif found["tag"] and ">" in text[i:]:
            i = text.index(">", i) + 1
        elif found["address"]:
            i = next((j for j in range(i + 1, len(text)) if text[j].isspace() or text[j] == ">"), len(text))
            i += text[i : i + 1] == ">"
        else:
            out.append(text[i])
            i += 1
    out.append(text[i:])
    return "".join(out)


def ticked(text: str) -> Iterator[tuple[bool, str]]:
    """Parts of a text: (whether within backticks, part with its ticks)."""
    marks = [(m.start(), m.end()) for m in re.finditer("`+", text)]
    at = 0
    while marks:
        start, inner = marks.pop(0)
        same = next((n for n, (a, b) in enumerate(marks) if b - a == inner - start), None)
        yield False, text[at:start]
        at = marks[same][1] if same is not None else len(text)
        marks = marks[same + 1 :] if same is not None else []
        yield True, text[start:at]
    yield False, text[at:]


def squeezed(text: str) -> str:
    """White space as single spaces, but as it is within backticks."""
    return "".join(part if code else re.sub(r"\s+", " ", part) for code, part in ticked(text))


def spoken(text: str) -> str:
    """A body without links, ticks and cell borders, in single spaces."""
    said = without_links(text, False)
    said = "".join(part.strip("`") if code and part.endswith("`") else part for code, part in ticked(said))
    return " ".join(said.replace("|", " ").split())


def to_text(markdown: str | None) -> str:
    """Plain lines; code stays."""
    said = (x.raw if x.kind == "code" else "" if x.kind == "fence" else spoken(x.body) for x in lines_of(markdown))
    return "\n".join(filter(None, said)).strip()


def to_abstract_text(markdown: str | None) -> str:
    """Plain lines without code, rules, reference definitions and emphasis."""
    out = []
    for x in lines_of(markdown):
        if x.kind in ("text", "heading", "quote", "item", "table") and x.raw.strip().lower() not in SKIP_LINES:
            said = x.body
            for mark, plain in (("\\*", "*"), ("\\_", "_"), ("**", ""), ("__", "")):
                said = said.replace(mark, plain)
            said = spoken(said)
            if said and said.lower() not in SKIP_LINES:
                out.append(said)
    return "\n".join(out)


def unlinked(markdown: str | None) -> str:
    """Links as their text, images as their alternative text; code stays."""
    kept = (x.raw.rstrip() if x.kind in ("code", "fence") else without_links(x.raw.rstrip(), True) for x in lines_of(markdown) if x.kind != "reference")
    return "\n".join(kept).strip()


class Piece(NamedTuple):
    """Lines of the finished text that stay together, and whether a text may end after them."""

    text: str
    kind: str


def pieces_of(lines: Iterable[Line]) -> Iterator[Piece]:
    """Paragraphs as one piece, every other line as its own; lines of noise phrases are left out, tables begin after a blank line."""
    held: list[str] = []
    before = "blank"
    for x in lines:
        body = squeezed(x.raw.strip())
        kind = "table" if x.kind in ("table", "divider") else "line" if x.kind in ("heading", "quote", "item") else "paragraph" if x.kind in ("text", "rule", "reference") else x.kind
        if kind in ("paragraph", "line") and any(phrase in body.lower() for phrase in NOISE_PHRASES):
            continue
        if kind == "paragraph":
            held.append(body)
        else:
            if held:
                yield Piece("\n".join(held), "paragraph")
                held = []
            if kind == "table" and before != "table":
                yield Piece("", "blank")
            indent = x.raw[: len(x.raw) - len(x.raw.lstrip(" \t"))].replace("\t", "    ")
            yield Piece({"line": indent + body, "code": x.raw, "blank": ""}.get(kind, x.raw.rstrip()), kind)
        before = kind
    if held:
        yield Piece("\n".join(held), "paragraph")


def compacted(pieces: Iterable[Piece]) -> list[Piece]:
    """Single blank lines, one before each code block; of equal paragraphs with more than ten characters the first."""
    out: list[Piece] = []
    seen: set[str] = set()
    inside = False
    for x in pieces:
        empty = not out or not out[-1].text
        if x.kind == "paragraph":
            key = squeezed(x.text).lower().strip()
            if len(key) > 10:
                if key in seen:
                    continue
                seen.add(key)
        elif x.kind == "fence":
            if not inside and not empty:
                out.append(Piece("", "blank"))
            inside = not inside
        if empty and x.kind in ("blank", "code") and not x.text:
            continue
        out.append(x)
    while out and not out[-1].text.strip():
        out.pop()
    return out


def cut(pieces: list[Piece], most: int) -> str:
    """The pieces as text of at most so many characters.

    A longer text ends after the last blank line, heading, table or list line outside code, if that lies beyond
    55 % of the room, else anywhere; a code block that would stay open is left out.
    """
    whole = "\n".join(x.text for x in pieces)
    if len(whole) <= most:
        return whole
    at = safe = 0
    opened: list[tuple[int, int]] = []  # start and end of every code block
    start = None
    for x in pieces:
        end = at + len(x.text) + 1
        if x.kind == "fence":
            if start is None:
                start = at
            else:
                opened.append((start, end))
                start = None
        if end <= most and start is None and x.kind in ("blank", "line", "table"):
            safe = end
        at = end
    if start is not None:
        opened.append((start, at))
    last = safe if safe > int(most * 0.55) else most
    last = next((a for a, b in opened if a < last < b - 1), last)
    return whole[:last].rstrip()


def front_matter(metadata: dict[str, str] | None) -> str:
    """A block of names and values; values with signs of the format in them are quoted."""
    signs = frozenset(":\\\"'\n#[{}]")
    quoted = lambda v: '"' + v.translate({92: "\\\\", 34: '\\"'}) + '"'
    rows = [f"{name}: {quoted(value) if signs.intersection(value) else value}" for name, value in (metadata or {}).items() if value]
    return "\n".join(["---", *rows, "---"]) if metadata else ""


def finalized(markdown: str | None, most: int = 160_000, metadata: dict[str, str] | None = None) -> str:
    """Clean markdown: repeated paragraphs once, single blank lines, front matter, at most so many characters."""
    pieces = compacted(pieces_of(lines_of(markdown)))
    if head := front_matter(metadata):
        pieces = [Piece(line, "paragraph") for line in head.split("\n")] + ([Piece("", "blank"), *pieces] if pieces else [])
    if pieces and not metadata:
        pieces[0] = Piece(pieces[0].text.lstrip(), pieces[0].kind)
    return cut(pieces, most)


def clipped(text: str, most: int) -> str:
    """A text of lines as cut gives it."""
    kinds = {"heading": "line", "item": "line", "divider": "table"}
    return cut([Piece(x.raw, kinds.get(x.kind, x.kind)) for x in lines_of(text)], most)


#: Character sets that are tried where none is declared or the declared one reads badly.
CHARSETS = ("utf-8", "utf-8-sig", "gb18030", "shift_jis", "euc_jp", "iso-2022-jp", "cp1252", "latin-1")
#: First bytes that name a character set.
BYTE_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def damage(text: str) -> tuple[float, float, float, bool]:
    """Shares of replaced and of control characters, less the share of CJK ones, and whether the text is short."""
    size = max(1, len(text))
    control = sum(c < " " and c not in "\t\n\r" for c in text)
    cjk = sum("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in text)
    return text.count("�") / size, control / size, -cjk / size, len(text) < 200


def decoded(data: bytes | None, content_type: str = "", detect: Callable[[bytes], str | None] | None = None) -> str:
    """Text of bytes: a declared (or detected) charset where it reads cleanly, else the one with the least damage."""
    if not data:
        return ""
    said = (content_type or "", data[:16_384].decode("ascii", "ignore"))
    declared = [name for mark, name in BYTE_MARKS if data.startswith(mark)][:1]
    declared += [m[1] for text, p in zip(said, (r"charset\s*=\s*([\w-]+)", r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)"), strict=True) if (m := re.search(p, text))]
    declared += [found] if detect and (found := detect(data)) else []
    table = []
    for place, name in enumerate(dict.fromkeys([*declared, *CHARSETS])):
        try:
            text = data.decode(name, "replace").replace("\0", "")
        except LookupError:
            continue
        how = damage(text)
        trusted = name in declared and max(how[:2]) <= 0.001
        table.append(((0,) if trusted else (1, *how), place, text))
    text = re.sub("\r\n?", "\n", min(table)[2])
    is_html = any(mark in text[:8192].lower() for mark in ("<!doctype", "<html", "<meta", "<body", "</p", "</div"))
    return text if is_html else re.sub(r"\s+", " ", text)


def mapped(rule: Callable[[str | None], str], c: Column | str) -> Column:
    """rule of every text, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(rule)

    return F.pandas_udf(run, "string")(col(c))


def markdown_text(c: Column | str) -> Column:
    return mapped(to_text, c)


def abstract_text(c: Column | str) -> Column:
    return mapped(to_abstract_text, c)


def strip_links(c: Column | str) -> Column:
    return mapped(unlinked, c)


def finalize(c: Column | str, most: int = 160_000) -> Column:
    return mapped(lambda t: finalized(t, most), c)


def decode(data: Column | str, content_type: Column | str) -> Column:
    def run(data: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([decoded(d, t) for d, t in zip(data, types, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(col(data), col(content_type))
