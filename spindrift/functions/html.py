"""HTML as text, with built-ins for plain markup and the standard parser for the rest."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import clean_whitespace, col

HIDDEN = {"script", "style", "noscript", "svg", "template"}
SECONDARY = {"nav", "aside", "footer", "header", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "figure"}
BANNERISH = re.compile(r"(?i)(^|[\s_-])(ads?|advert\w*|banner|cookie|promo|sidebar|share|social|related|breadcrumb)([\s_-]|$)")
SIGNALS = "text_chars int, script_ratio double, link_density double, punctuation_density double, visible_text string, title_text string, heading_text string, tag_count int"
PAGE = "title string, description string, author string, published string, image string, favicon string, lang string, markdown string, text string, links array<struct<url:string,text:string,zone:string,internal:boolean,nofollow:boolean,position:int>>, images array<struct<url:string,text:string,zone:string>>"
PAGE_FIELDS = "title description author published image favicon lang markdown text links images".split()
_ws = re.compile(r"\s+")
_ampersand = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def visible_native(c: Column | str) -> Column:
    """Visible text of plain markup: hidden elements and tags as spaces, entities of the basic set decoded."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return clean_whitespace(text)


def title_native(c: Column | str) -> Column:
    return clean_whitespace(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def lang_native(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1))


def hrefs_native(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"']"), 1)


class Parser(HTMLParser):
    """The standard parser, which reads `&amp` before other signs as `&amp;`; closed: only references with their semicolon are read, as in XML."""

    def __init__(self, closed: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.closed, self.mark = closed, ""

    def feed(self, data: str) -> None:
        """A whole page."""
        if self.closed:
            # One sign that the page does not have, from the noncharacters on, stands for bare ampersands.
            self.mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in data)
            data = _ampersand.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else self.mark + m[0][1:], data)
        super().feed(data)

    def said(self, text: str | None) -> str:
        """A text or value with its bare ampersands."""
        return (text or "").replace(self.mark, "&") if self.mark else text or ""


class Reader(Parser):
    """One pass over a page: text by zone, markdown of the primary part, references and metadata."""

    def __init__(self, base: str, closed: bool = False) -> None:
        super().__init__(closed)
        self.base, self.stack, self.tags, self.scripts = base, [], 0, 0
        self.meta, self.title, self.headings, self.visible, self.linked = {}, [], [], [], []
        self.blocks: list[tuple[str, str]] = []
        self.block: list[str] = []
        self.kind, self.links, self.images, self.lang, self.favicon = "", [], [], "", ""
        self.link: dict | None = None

    def zone(self) -> str:
        return "secondary" if any(second for _, second in self.stack) else "primary"

    def flush(self) -> None:
        text = _ws.sub(" ", "".join(self.block)).strip()
        if text and self.zone() == "primary":
            mark = {"li": "- ", "blockquote": "> "}.get(self.kind, "#" * int(self.kind[1]) + " " if re.fullmatch("h[1-6]", self.kind) else "")
            self.blocks.append((mark, text))
        self.block = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: self.said(v) for k, v in attrs}
        self.tags += 1
        self.scripts += tag == "script"
        if tag in BLOCKS or tag in SECONDARY:
            self.flush()
            self.kind = tag
        if tag == "html":
            self.lang = a.get("lang", "").lower()
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if name and a.get("content", "").strip():
                self.meta.setdefault(name, _ws.sub(" ", a["content"]).strip())
        elif tag == "link" and "icon" in a.get("rel", "").lower() and a.get("href"):
            self.favicon = self.favicon or urljoin(self.base, a["href"])
        elif tag == "img" and a.get("src"):
            self.images.append({"url": urljoin(self.base, a["src"]), "text": a.get("alt", ""), "zone": self.zone()})
        elif tag == "br":
            self.block.append("\n")
        elif tag == "a" and a.get("href"):
            self.link = {"url": urljoin(self.base, a["href"].strip()), "text": "", "zone": self.zone(), "nofollow": "nofollow" in a.get("rel", "").lower(), "position": len(self.links)}
        if tag not in VOID:
            second = tag in SECONDARY or bool(BANNERISH.search(f"{a.get('class', '')} {a.get('id', '')}")) or "hidden" in a or a.get("aria-hidden") == "true"
            self.stack.append((tag, second))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SECONDARY:
            self.flush()
            self.kind = ""
        if tag == "a" and self.link is not None:
            url = urlsplit(self.link["url"])
            if url.scheme in ("http", "https") and url.netloc:
                self.link["text"] = _ws.sub(" ", self.link["text"]).strip()
                self.links.append(self.link | {"internal": url.netloc.lower() == urlsplit(self.base).netloc.lower()})
            self.link = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        names, data = {t for t, _ in self.stack}, self.said(data)
        if names & HIDDEN:
            return
        if "title" in names:
            self.title.append(data)
            return
        if "head" in names and "body" not in names:
            return
        self.visible.append(data)
        self.block.append(data)
        if names & {"h1", "h2"}:
            self.headings.append(data)
        if self.link is not None:
            self.link["text"] += data
            self.linked.append(data)


def read(html: str | None, base: str | None, closed: bool = False) -> Reader:
    reader = Reader(base or "", closed)
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader


def signals(c: Column | str, closed: bool = False) -> Column:
    """Text, script, link and punctuation figures of each page, by one parse; closed: as Parser has it."""

    def run(pages: pd.Series) -> pd.DataFrame:
        return _signals(pages, closed)

    return F.pandas_udf(run, SIGNALS)(col(c))


def _signals(pages: pd.Series, closed: bool) -> pd.DataFrame:
    def one(html: str | None) -> tuple:
        r = read(html, "", closed)
        clean = lambda parts: _ws.sub(" ", " ".join(parts)).strip()
        text = clean(r.visible)
        n = max(1, len(text))
        return len(text), r.scripts / max(1, r.tags), len(clean(r.linked)) / n, len(re.findall("[,.!?;:。！？；]", text)) / n, text, clean(r.title), clean(r.headings), r.tags

    return pd.DataFrame([one(p) for p in pages], columns=[x.split()[0] for x in SIGNALS.split(", ")])


def page(c: Column | str, url: Column | str, closed: bool = False) -> Column:
    """Metadata, markdown and text of the primary part, links and images of each page; closed: as Parser has it."""

    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return _pages(pages, urls, closed)

    return F.pandas_udf(run, PAGE)(col(c), col(url))


def _pages(pages: pd.Series, urls: pd.Series, closed: bool) -> pd.DataFrame:
    def one(html: str | None, url: str | None) -> dict:
        r, first = read(html, url, closed), lambda *names: next((r.meta[n] for n in names if r.meta.get(n)), "")
        seen, links = set(), []
        for x in r.links:
            if (x["url"], x["text"]) not in seen:
                seen.add((x["url"], x["text"]))
                links.append(x)
        ordered = sorted(links, key=lambda x: (x["zone"] != "primary", x["position"]))
        shown, images = set(), []
        for x in r.images:
            if (x["url"], x["zone"]) not in shown:
                shown.add((x["url"], x["zone"]))
                images.append(x)
        title = first("og:title", "twitter:title") or _ws.sub(" ", "".join(r.title)).strip()
        return {
            "title": title,
            "description": first("og:description", "twitter:description", "description"),
            "author": first("article:author", "author", "dc.creator"),
            "published": first("article:published_time", "og:published_time", "datepublished", "date"),
            "image": first("og:image", "twitter:image"),
            "favicon": r.favicon,
            "lang": r.lang,
            "markdown": "\n\n".join(m + t for m, t in r.blocks),
            "text": " ".join(t for _, t in r.blocks),
            "links": ordered,
            "images": images,
        }

    return pd.DataFrame([one(p, u) for p, u in zip(pages, urls, strict=True)], columns=PAGE_FIELDS)
