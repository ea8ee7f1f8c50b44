"""Text rules as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's \s has it: Unicode's, and the four separators U+001C to U+001F.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
WORD = r"([A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*)"
CJK_RUN = r"([㐀-鿿぀-ヿㇰ-ㇿ々ーｦ-ﾝ]{2,})"
#: What markdown_line_text takes out of a line, in this order, and what it leaves.
LINE_RULES = ((r"!\[([^\]]*)\]\([^)]*\)", 1), (r"\[([^\]]*)\]\([^)]*\)", 1), (r"<https?://[^>\s]+>|(?<![\w/])https?://[^\s)>\]]+", 0), (r"^\s{0,3}(#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", 0), (r"\*\*|__|~~|`", 0))
LINE_MARKS = tuple((re.compile(p, re.ASCII), r"\1" if group else "") for p, group in LINE_RULES)
CITATION = r"(?i)\[\s*citation\s*:\s*(\d+)\s*\]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_whitespace(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE + "+", " "))


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).lower()).strip() if t else "")


def normalize_text(c: Column | str) -> Column:
    """NFKC, lower case, clean white space. Spark has no Unicode normalisation, hence Arrow batches."""
    return F.pandas_udf(_normalized, "string")(col(c))


def normalize_nfkc(c: Column | str) -> Column:
    """As normalize_text, for text that is NFKC already (no Python)."""
    return clean_whitespace(F.lower(col(c)))


def _casefolded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.casefold() if t else "")


def casefold(c: Column | str) -> Column:
    """Full Unicode case folding, in Arrow batches."""
    return F.pandas_udf(_casefolded, "string")(col(c))


def fold(c: Column | str) -> Column:
    """Case folding with built-ins: lower case, sharp s as ss, final sigma as sigma."""
    return F.replace(F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def dedupe_key(c: Column | str) -> Column:
    return fold(clean_whitespace(c))


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", ""), f"^{SPACE}+|{SPACE}+$", "")


def tokenize(c: Column | str, normalized: bool = False) -> Column:
    """Distinct tokens in order: ASCII words (joined by . _ or -), then runs of two or more CJK characters."""
    text = col(c) if normalized else normalize_nfkc(c)
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(WORD), 1), F.regexp_extract_all(text, F.lit(CJK_RUN), 1)))


def has_words(stop: list[str], c: Column | str) -> Column:
    """Tokens without stop words; stop words are a bounded list."""
    return F.array_except(col(c), F.array(*map(F.lit, stop))) if stop else col(c)


def table_row(c: Column | str) -> Column:
    """`| a | b |` as `a | b`; a separator row as nothing."""
    body = F.regexp_replace(F.trim(col(c)), r"^\|+|\|+$", "")
    cells = F.filter(F.transform(F.split(body, r"\|"), clean_whitespace), lambda x: x != "")
    rule = F.forall(cells, lambda x: x.rlike(r"^:?-{2,}:?$"))
    return F.when((F.size(cells) == 0) | rule, "").otherwise(F.array_join(cells, " | "))


def plain_row(row: str) -> str:
    """table_row of a Python text."""
    cells = [" ".join(c.split()) for c in row.strip("|").split("|")]
    cells = [c for c in cells if c]
    return "" if all(re.fullmatch(r":?-{2,}:?", c) for c in cells) else " | ".join(cells)


def plain_line(line: str) -> str:
    """markdown_line_text of a Python text."""
    for pattern, by in LINE_MARKS:
        line = pattern.sub(by, line)
    return " ".join(line.split())


def plain_tokens(text: str) -> set[str]:
    """tokenize of a Python text, without the order."""
    text = " ".join(text.lower().split())
    return set(re.findall(WORD, text)) | set(re.findall(CJK_RUN, text))


def folded(text: str) -> str:
    """fold of a Python text."""
    return text.lower().replace("ß", "ss").replace("ς", "σ")


def effective_query(query, title, url) -> Column:
    """The query, else the title, else the URL."""
    found = [F.nullif(clean_whitespace(x), F.lit("")) for x in (query, title, url)]
    return F.coalesce(*found, F.lit(""))


def snippet_or_title(snippet, title) -> Column:
    return F.coalesce(F.nullif(clean_whitespace(snippet), F.lit("")), clean_whitespace(title))


def quote_bangs(c: Column | str) -> Column:
    """Words that begin with ! in single quotes, a lone ! as it is."""
    return F.regexp_replace(clean_whitespace(c), r"(?<!\S)(!\S+)", "'$1'")


def truncate(c: Column | str, limit: int) -> Column:
    return F.left(col(c), F.lit(limit))


def count_suffix(c: Column | str) -> Column:
    """`1.2k` as 1200, `3m` as 3000000; 0 where there is no number."""
    text = F.regexp_replace(F.lower(clean_whitespace(c)), "[, ]", "")
    scale = F.when(F.endswith(text, F.lit("k")), 1e3).when(F.endswith(text, F.lit("m")), 1e6).otherwise(1.0)
    return F.coalesce((F.regexp_replace(text, "[km]$", "").try_cast("double") * scale).cast("long"), F.lit(0).cast("long"))


def language_tag(c: Column | str) -> Column:
    """BCP-47 casing: lower language, Title script, UPPER region; `all` and malformed tags as ''."""
    tag = F.replace(clean_whitespace(c), F.lit("_"), F.lit("-"))
    parts = F.transform(F.split(tag, "-"), lambda x, i: F.when(i == 0, F.lower(x)).when((F.length(x) == 4) & x.rlike("^[A-Za-z]+$"), F.initcap(F.lower(x))).when(x.rlike("^([A-Za-z]{2}|[0-9]{3})$"), F.upper(x)).otherwise(F.lower(x)))
    ok = tag.rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$") & (F.lower(tag) != "all")
    return F.when(ok, F.array_join(parts, "-")).otherwise("")


def citation_indexes(c: Column | str) -> Column:
    """Distinct cited numbers in order of their first place; groups are expanded first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(citation_expand(c), F.lit(CITATION), 1), lambda x: x.cast("int")))


def citation_expand(c: Column | str) -> Column:
    """`[citation:1, 2]` as `[citation:1][citation:2]`, each number once in its group."""
    group = r"(?i)(\[\s*citation\s*:\s*[^\]]*?\d[^\]]*?\s*\])"
    text = F.coalesce(col(c), F.lit(""))
    marks, rest = F.regexp_extract_all(text, F.lit(group), 1), F.split(text, r"(?i)\[\s*citation\s*:\s*[^\]]*?\d[^\]]*?\s*\]", -1)

    def expanded(mark: Column) -> Column:
        numbers = F.array_distinct(F.transform(F.regexp_extract_all(mark, F.lit(r"(\d+)"), 1), lambda n: n.cast("long").cast("string")))
        return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("[citation:"), n, F.lit("]"))), "")

    pieces = F.zip_with(rest, F.concat(F.transform(marks, expanded), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


def citation_strip(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?i)\[\s*citation\s*:\s*\d+(?:\s*[,，]\s*\d+)*\s*\]", "")


def citation_replace(c: Column | str, ids: Column) -> Column:
    """Each known number by `[citation:<id>]` of the map ids (int to string); unknown ones stay."""
    text = F.coalesce(col(c), F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(r"(?i)(\[\s*citation\s*:\s*\d+\s*\])"), 1)
    rest = F.split(text, r"(?i)\[\s*citation\s*:\s*\d+\s*\]", -1)

    def named(mark: Column) -> Column:
        known = F.try_element_at(ids, F.regexp_extract(mark, r"(\d+)", 1).cast("int"))
        return F.when(known.isNull(), mark).otherwise(F.concat(F.lit("[citation:"), known, F.lit("]")))

    return F.array_join(F.zip_with(rest, F.concat(F.transform(marks, named), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def front_matter(names: list[str]) -> Column:
    """A YAML block of the columns that are not empty; values with special characters are quoted."""

    def line(name: str) -> Column:
        value = clean_whitespace(name)
        quoted = F.when(value.rlike(r"[:#\[\]{}&*!|>'\"%@`]|^[-?]"), F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)
        return F.when(value != "", F.concat(F.lit(f"{name}: "), quoted))

    body = F.concat_ws("\n", *map(line, names))
    return F.when(body == "", "").otherwise(F.concat(F.lit("---\n"), body, F.lit("\n---")))


def is_fence(c: Column | str) -> Column:
    return col(c).rlike(r"^\s*(```+|~~~+)")


def is_heading(c: Column | str) -> Column:
    return col(c).rlike(r"^\s{0,3}#{1,6}\s+\S")


def is_list_item(c: Column | str) -> Column:
    return col(c).rlike(r"^\s*([-*+•]|\d+[.)])\s+\S")


def is_table_line(c: Column | str) -> Column:
    return F.trim(col(c)).rlike(r"^\|.*\|$")


def without_marks(c: Column | str, rules: tuple) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    for pattern, group in rules:
        text = F.regexp_replace(text, pattern, "$1" if group else "")
    return text


def strip_links(c: Column | str) -> Column:
    """Markdown links as their text, images as their alternative text, bare addresses gone (outside code)."""
    return without_marks(c, LINE_RULES[:3])


def markdown_line_text(c: Column | str) -> Column:
    """A line without markdown's marks: prefixes, emphasis, links, inline code ticks."""
    return clean_whitespace(without_marks(c, LINE_RULES))


def sentence_end(c: Column | str) -> Column:
    return col(c).rlike("[.!?。！？…]['\"”’)\\]]*\\s*$")


def collapse(c: Column | str) -> Column:
    return clean_whitespace(c)


def repair(c: Column | str) -> Column:
    """Without U+FFFD, with newlines alone as line ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "�", ""), "\r\n?", "\n")


def inverted_index_text(c: Column | str) -> Column:
    """Text of an inverted index map<token, array<position>>: tokens by position, the first token for a repeated one."""
    entries = F.flatten(F.transform(F.map_entries(col(c)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.array_join(F.transform(F.array_sort(entries), lambda x: x["t"]), " ")


#: Words before a dot that ends no sentence, and those that end none before a small letter.
NEVER_LAST = set("mr mrs ms dr prof sr jr st mt vs no fig eq sec art vol dept gen sen gov pres capt cmdr col lt sgt adm rev".split())
SOMETIMES_LAST = set("etc inc ltd corp co jan feb mar apr jun jul aug sep sept oct nov dec".split())
OPENERS, CLOSERS, QUOTES = "([{（［｛【「『〈《", ")]}）］｝】」』〉》", "\"'”’»›"
DOTS, ENDERS = ".．", "!?;。！？；｡"


class Dot(NamedTuple):
    """A dot with what stands around it: the character before, all that follows, what follows after white space, and the word and letters it ends."""

    before: str
    rest: str
    after: str
    word: str
    initials: bool
    within: bool


def latin(c: str) -> bool:
    return c.isascii() and c.isalpha()


def opens_sentence(c: str) -> bool:
    """A Latin capital, or a character of a script without capitals."""
    return bool(re.match(r"[A-Z㐀-鿿぀-ヿㇰ-ㇿｦ-ﾝ々]", c))


def closes_all(rest: str) -> bool:
    """Whether nothing but closing marks follows, up to a closing bracket or the end."""
    return bool(re.match(f"[{re.escape(QUOTES + DOTS + ENDERS)}…]*([{re.escape(CLOSERS)}]|$)", rest))


#: What decides whether a dot ends a sentence: (whether the rule holds, its verdict); the first rule that holds decides.
DOT_RULES: tuple[tuple[Callable[[Dot], bool], bool | None], ...] = (
    (lambda d: not d.before, False),
    (lambda d: not d.rest, True),
    (lambda d: d.within and not closes_all(d.rest), False),
    (lambda d: d.before.isdigit() and d.rest[0].isdigit(), False),
    (lambda d: d.rest[0] in DOTS, False),
    (lambda d: latin(d.before) and latin(d.rest[0]), False),
    (lambda d: d.rest[0] in CLOSERS + QUOTES, True),
    (lambda d: not d.rest[0].isspace(), None),
    (lambda d: not d.after, True),
    (lambda d: d.word in NEVER_LAST, False),
    (lambda d: d.word in SOMETIMES_LAST and latin(d.after) and d.after.islower(), False),
    (lambda d: d.initials and d.after.isascii() and d.after.isalnum(), False),
    (lambda d: d.after in OPENERS + QUOTES, True),
    (lambda d: True, None),
)


def dot_ends(text: str, i: int, depth: int) -> bool:
    """Whether the dot at i ends a sentence; where no rule decides, whether what follows can begin one."""
    rest, head = text[i + 1 :], text[max(0, i - 32) : i]
    word = re.search(r"[A-Za-z][A-Za-z0-9'-]{0,20}$", head)
    dot = Dot(text[i - 1 : i] if i else "", rest, rest.lstrip()[:1], word[0].casefold() if word else "", bool(re.search(r"(?:\b[A-Za-z]\.)+[A-Za-z]$", head)), depth > 0)
    verdict = next(v for holds, v in DOT_RULES if holds(dot))
    return opens_sentence(dot.after if rest[0].isspace() else rest[0]) if verdict is None else verdict


def split_sentences(text: str) -> list[str]:
    """Sentences of a line: no cut within brackets, after abbreviations and initials, in numbers; closers stay with their sentence."""
    text = " ".join(text.split())
    out, start, depth, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        depth += (c in OPENERS) - (c in CLOSERS and depth > 0)
        if c in DOTS:
            ends = dot_ends(text, i, depth)
        else:
            ends = c in ENDERS and (not depth or closes_all(text[i + 1 :]))
        if ends:
            i += 1
            while i < len(text) and text[i] in DOTS + ENDERS + "…" + CLOSERS + QUOTES:
                depth -= text[i] in CLOSERS and depth > 0
                i += 1
            out.append(text[start:i].strip())
            start = i
        else:
            i += 1
    out.append(text[start:].strip())
    return [s for s in out if s]


def _sentences(lines: pd.Series) -> pd.Series:
    return lines.map(lambda t: split_sentences(t) if t else [])


def sentences(c: Column | str) -> Column:
    """Sentences of each line; the rule has a state over characters, hence Arrow batches."""
    return F.pandas_udf(_sentences, "array<string>")(col(c))
