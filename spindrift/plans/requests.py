"""Requests of the verbs, checked and normalised on the driver before any plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from spindrift.plans.defaults import MAX_RESULTS, RESEARCH, SEARCH_MODES


def clean(text: object) -> str:
    return re.sub(r"\s+", " ", str(text or "")).strip()


def required(name: str, text: object) -> str:
    value = clean(text)
    if not value:
        raise ValueError(f"{name} must not be empty")
    return value


def unique(values: list[str] | None) -> list[str]:
    """Clean, non-empty and distinct in folded case, in order."""
    out: dict[str, str] = {}
    for v in map(clean, values or []):
        if v:
            out.setdefault(v.casefold(), v)
    return list(out.values())


def domain_token(value: str) -> str:
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", clean(value).lower())
    return re.split(r"[/:?#]", host)[0].strip(".").removeprefix("www.")


def text_filter(value: str) -> str:
    """At most five words, or six CJK characters where there is at most one Latin word."""
    text = clean(value)
    cjk = re.findall("[㐀-鿿぀-ヿ]", text)
    latin = re.findall(r"[A-Za-z0-9]+", text)
    if cjk and len(latin) <= 1:
        if len(cjk) > 6:
            raise ValueError("a text filter holds at most 6 CJK characters")
    elif len(text.split()) > 5:
        raise ValueError("a text filter holds at most 5 words")
    return text


def instant(value: str) -> datetime | None:
    token = clean(value)
    if not token:
        return None
    try:
        at = datetime.fromisoformat(token.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"{value!r} is no ISO 8601 date") from None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


@dataclass(frozen=True)
class SearchRequest:
    query: str
    mode: str = "auto"
    max_results: int = MAX_RESULTS
    user_location: str = "US"
    additional_queries: list[str] = field(default_factory=list)
    include_domains: list[str] = field(default_factory=list)
    exclude_domains: list[str] = field(default_factory=list)
    include_text: list[str] = field(default_factory=list)
    exclude_text: list[str] = field(default_factory=list)
    start_published_date: str = ""
    end_published_date: str = ""

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("query", required("query", self.query))
        if self.mode not in SEARCH_MODES:
            raise ValueError(f"mode must be one of {', '.join(SEARCH_MODES)}")
        if not re.fullmatch("[A-Za-z]{2}", clean(self.user_location)):
            raise ValueError("user_location must be two letters")
        put("user_location", clean(self.user_location).upper())
        put("additional_queries", unique(self.additional_queries))
        if self.additional_queries and self.mode != "deep":
            raise ValueError("additional_queries need mode deep")
        for name in ("include_domains", "exclude_domains"):
            put(name, list(dict.fromkeys(d for d in map(domain_token, getattr(self, name)) if d)))
        if set(self.include_domains) & set(self.exclude_domains):
            raise ValueError("a domain is both included and excluded")
        for name in ("include_text", "exclude_text"):
            put(name, unique([text_filter(t) for t in getattr(self, name)]))
        start, end = instant(self.start_published_date), instant(self.end_published_date)
        if start and end and start > end:
            raise ValueError("start_published_date is after end_published_date")
        if self.max_results < 1:
            raise ValueError("max_results must be at least 1")


@dataclass(frozen=True)
class FetchRequest:
    urls: list[str]
    query: str = ""
    crawl_mode: str = "fallback"
    content: bool = True
    abstracts: bool = True
    overview: bool = False
    subpages: int = 0
    subpage_keywords: list[str] = field(default_factory=list)
    max_chars: int | None = 2000

    def __post_init__(self) -> None:
        urls = [clean(u) for u in self.urls]
        if not urls or not all(re.match("https?://", u) for u in urls):
            raise ValueError("urls must be http(s) and not empty")
        object.__setattr__(self, "urls", urls)
        if not (self.content or self.abstracts or self.overview or self.subpages):
            raise ValueError("nothing is asked for")
        words = [w for k in self.subpage_keywords for w in re.split("[,，]", k)]
        object.__setattr__(self, "subpage_keywords", unique(words))
        if self.crawl_mode not in ("never", "always", "fallback", "preferred"):
            raise ValueError("unknown crawl_mode")


@dataclass(frozen=True)
class AnswerRequest:
    query: str
    content: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "query", required("query", self.query))


@dataclass(frozen=True)
class ResearchRequest:
    themes: str
    mode: str = "standard"

    def __post_init__(self) -> None:
        object.__setattr__(self, "themes", required("themes", self.themes))
        if self.mode not in RESEARCH:
            raise ValueError(f"mode must be one of {', '.join(RESEARCH)}")
