"""The defaults of the verbs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchMode:
    extra_queries: int
    multiplier: float
    most_urls: int
    context_docs: int = 0
    context_chars: int = 16


SEARCH_MODES = {"fast": SearchMode(0, 1.0, 16), "auto": SearchMode(1, 2.0, 32), "deep": SearchMode(6, 3.0, 48, 18, 16)}
MAX_RESULTS = 16
ABSTRACT_CHARS, ABSTRACT_SCORE, ABSTRACT_TOKENS, TITLE_ALPHA = 2000, 0.20, 4, 0.35
OVERVIEW_CHARS, MARKDOWN_CHARS, MIN_TEXT_CHARS, MAX_LINKS = 900, 160_000, 220, 800
SUB_QUESTIONS, ANSWER_RESULTS, ANSWER_CHARS = 8, 5, 1000


@dataclass(frozen=True)
class ResearchProfile:
    rounds: int
    searches: int
    fetches: int
    results: int
    cards: int
    min_rounds: int


RESEARCH = {"fast": ResearchProfile(3, 6, 12, 5, 2, 1), "standard": ResearchProfile(5, 12, 24, 8, 4, 2), "pro": ResearchProfile(8, 24, 48, 10, 6, 3)}
