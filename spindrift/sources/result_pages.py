"""Recorded result pages of search services as hits, by what their blocks, titles and snippets look like."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.dom import Node, tree
from spindrift.functions.text import col

Look = Callable[[Node], bool]
HITS = "array<struct<url:string,title:string,snippet:string>>"


def a(tag: str = "", klass: str = "", **attrs: str) -> Look:
    """Whether a node is of a tag, has a class, and has attributes (with a part of their value)."""
    return lambda n: (not tag or n.tag == tag) and (not klass or n.has_class(klass)) and all(v in n.attrs.get(k, "") and k in n.attrs for k, v in attrs.items())


@dataclass(frozen=True)
class ResultPage:
    """How a service's page is read: result blocks, and in each the first title, snippet and link that say something."""

    name: str
    host: str
    base: str
    blocks: tuple[Look, ...]
    titles: tuple[Look, ...]
    snippets: tuple[Look, ...]
    targets: tuple[str, ...] = ()
    unique: bool = False
    joined: bool = False


#: What the services' pages are made of.
PAGES = {
    p.name: p
    for p in (
        ResultPage("duckduckgo", "duckduckgo.com", "https://html.duckduckgo.com/html/", (a("div", "result"), a("article", **{"data-testid": "result"})), (a("a", "result__a"), a("h2")), (a(klass="result__snippet"), a(**{"data-result": "snippet"})), ("uddg", "u")),
        ResultPage("google", "google.", "https://www.google.com/", (a("div", "g"), a("div", "MjjYud")), (a("div", role="link"), a("h3"), a(role="heading")), (a("div", "VwiC3b"), a("div", **{"data-sncf": "1"})), ("q",)),
        ResultPage("google_news", "google.", "https://news.google.com/", (a("div", "xrnccd"),), (a("h3"),), (a("a", **{"data-n-tid": ""}), a("time")), unique=True, joined=True),
    )
}


def first(node: Node, looks: tuple[Look, ...]) -> str:
    return next((said for look in looks for n in node.walk() if n is not node and look(n) and (said := n.text())), "")


def news_address(path: str) -> str:
    """The address that the last step of a news link's path holds in base64; '' if none."""
    token = next((s for s in reversed(path.split("/")) if s and s not in ("articles", "read")), "")
    try:
        data = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    except (binascii.Error, ValueError):
        return ""
    at = data.find(b"http")
    if at < 0:
        return ""
    cuts = [i for mark in (b"\xd2", b"\0", b"&ved=", b"\x08\x13") if (i := data.find(mark, at)) > at]
    return data[at : cuts[0] if cuts else None].decode("utf-8", "ignore")


def target(href: str, page: ResultPage) -> str:
    """Where a link leads: outside the service, through its redirect or its coded path; '' if it stays inside."""
    url = urljoin(page.base, href.strip())
    parts = urlsplit(url)
    if page.host in parts.netloc and page.targets:
        asked = parse_qs(parts.query)
        url = next((asked[k][0] for k in page.targets if k in asked), "")
    elif page.host in parts.netloc:
        url = news_address(parts.path)
    parts = urlsplit(url)
    return url if parts.scheme in ("http", "https") and page.host not in parts.netloc else ""


def hits(html: str | None, page: ResultPage) -> Iterator[dict]:
    seen: set[str] = set()
    for block in [n for n in tree(html).walk() if any(look(n) for look in page.blocks)]:
        title = first(block, page.titles)
        url = next((u for n in block.walk() if n.tag == "a" and "href" in n.attrs and (u := target(n.attrs["href"], page))), "")
        said = [s for look in page.snippets if (s := first(block, (look,)))] if page.joined else [first(block, page.snippets)]
        if title and url and not (page.unique and url.casefold() in seen):
            seen.add(url.casefold())
            yield {"url": url, "title": title, "snippet": " / ".join(said)}


def page_hits(html: Column | str, name: str) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda t: list(hits(t, PAGES[name])))

    return F.pandas_udf(run, HITS)(col(html))


def result_hits(pages: DataFrame, name: str, keep: list[str], html: str = "html") -> DataFrame:
    """keep, engine, position (from 1) and the hits of recorded result pages of a service."""
    made = pages.select(*keep, F.posexplode(page_hits(html, name)).alias("at", "hit"))
    return made.select(*keep, F.lit(name).alias("engine"), (F.col("at") + 1).alias("position"), "hit.*")


#: Meta names that tell a paper's page.
PAPER_TAGS = ("citation_title", "citation_author", "citation_doi", "citation_abstract", "citation_pdf_url")


def extractor_of(url: Column | str, content_type: Column | str, kind: Column | str, html: Column | str) -> Column:
    """Which extractor reads a page: the first special one that can, else html."""
    u, ct, k = F.lower(col(url)), F.lower(F.coalesce(col(content_type), F.lit(""))), col(kind)
    is_page = k.isin("html", "unknown") & ((ct == "") | F.contains(ct, F.lit("html")))
    host = F.regexp_extract(u, r"^https?://(?:www\.)?([^/?#:]+)", 1)
    paper = is_page & F.lower(F.coalesce(col(html), F.lit(""))).rlike(rf"<meta[^>]+name=[\"']({'|'.join(PAPER_TAGS)})[\"']")
    return (
        F.when(host.isin("doi.org", "dx.doi.org"), "doi")
        .when(F.endswith(host, F.lit("reddit.com")) & F.contains(u, F.lit("/comments/")), "reddit")
        .when((k == "pdf") | F.contains(ct, F.lit("pdf")) | F.endswith(u, F.lit(".pdf")), "pdf")
        .when((host == "github.com") & u.rlike(r"^https?://(www\.)?github\.com/[^/?#]+/[^/?#]+/?$") & is_page, "github")
        .when(paper, "paper")
        .when(k.isin("text", "markdown"), k)
        .otherwise("html")
    )
