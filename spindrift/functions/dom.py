"""Pages as trees: which part is the content, and that part as markdown.

One parse gives a tree; zones, candidates, rendering and figures are walks over it. A page
is one value, so this is an Arrow batch function without any shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.html import BLOCKS, HIDDEN, VOID, Parser
from spindrift.functions.text import col

#: Elements that end an open element of the keyed kind.
ENDED_BY = {"p": BLOCKS | {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Classes of documentation sites' content.
DOC_CLASSES = ("vp-doc", "theme-doc-markdown", "markdown-body", "md-content", "rst-content")
#: Parts of a class or id that content does not have.
NO_CONTENT = ("nav", "footer", "sidebar", "menu", "header", "comment", "social", "share", "related", "advertisement", "ad-", "ads-")
SIDE_WORDS = ("sidebar", "related", "recommend", "comment", "discussion", "faq", "appendix")
BANNER_WORDS = ("banner", "hero", "masthead")
LEAST_HEURISTIC, LEAST_PRIMARY, LEAST_STRING = 100, 120, 80
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
EXTRACTED = "engine string, markdown string, text string, sections map<string,string>, warnings array<string>, json_ld map<string,string>, counts map<string,int>"
EXTRACTED_FIELDS = [f.split()[0] for f in EXTRACTED.split(", ")]


class Node:
    """An element with its attributes and, in order, its texts and elements."""

    __slots__ = ("attrs", "inner", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.inner = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements in and under this one that show something."""
        if self.tag not in HIDDEN:
            yield self
            for x in self.inner:
                if isinstance(x, Node):
                    yield from x.walk()

    def text(self) -> str:
        return " ".join(" ".join(self.texts()).split())

    def texts(self) -> Iterator[str]:
        if self.tag not in HIDDEN:
            for x in self.inner:
                if isinstance(x, Node):
                    yield from x.texts()
                else:
                    yield x

    def count(self, *tags: str) -> int:
        return sum(n.tag in tags for n in self.walk()) - (self.tag in tags)

    @property
    def ident(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower()

    def has_class(self, name: str) -> bool:
        return name.lower() in self.attrs.get("class", "").lower().split()


class Builder(Parser):
    def __init__(self, closed: bool = False) -> None:
        super().__init__(closed)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while tag in ENDED_BY.get(self.nearest(tag), ()):
            self.handle_endtag(self.nearest(tag))
        node = Node(tag, {k: self.said(v) for k, v in attrs}, self.at)
        self.at.inner.append(node)
        if tag not in VOID:
            self.at = node

    def nearest(self, tag: str) -> str:
        """The innermost open element that the tag may end, up to the next block."""
        at = self.at
        while at.parent is not None and at.tag not in ENDED_BY and at.tag not in BLOCKS:
            at = at.parent
        return at.tag

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.inner.append(self.said(data))


def tree(html: str | None, closed: bool = False) -> Node:
    builder = Builder(closed)
    builder.feed(html or "")
    builder.close()
    return builder.root


def weight(node: Node) -> float:
    """How much an element looks like content: its text and structure, and how dense the text stands."""
    text, size = node.text(), sum(len(n.tag) * 2 + 5 + sum(len(k) + len(v) + 4 for k, v in n.attrs.items()) for n in node.walk())
    score = len(text) + 50 * node.count("p") + 30 * node.count(*HEADINGS) + 40 * node.count("pre", "code") + 10 * node.count("li")
    density = len(text) / max(1, size + len(text))
    return score * (1.5 if density > 0.3 else 1.2 if density > 0.2 else 1.0)


def article_score(text: str) -> float:
    """How much of an article a text is: length, punctuation and spaces for it, addresses against."""
    return max(0.0, len(text) + 6 * len(re.findall("[,.!?;:。！？；]", text)) + 1.5 * text.count(" ") - 80 * len(re.findall("https?://", text)))


def candidates(root: Node) -> Iterator[tuple[str, list[Node]]]:
    """What may be the content, by what it was found: documentation's classes, main, article, the densest part, the body."""
    every = list(root.walk())
    classed = [(n, n.attrs["class"].lower().split()) for n in every if "class" in n.attrs]
    for name in DOC_CLASSES:
        yield "docs", [n for n, classes in classed if name in classes]
    for holds in (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main"):
        yield "semantic", [n for n in every if holds(n)]
    dense = [n for n in every if n.tag in ("div", "section") and not any(w in n.ident for w in NO_CONTENT) and len(n.text()) >= LEAST_HEURISTIC]
    yield "heuristic", sorted(dense, key=weight, reverse=True)[:1]
    yield "body", [n for n in every if n.tag == "body"] or [root]


def primary(root: Node) -> tuple[str, Node | None]:
    for engine, nodes in candidates(root):
        filled = [n for n in nodes if n.text()]
        if filled:
            return engine, max(filled, key=lambda n: len(n.text()))
    return "none", None


def zone(node: Node) -> str:
    """The section that an element opens, '' if none."""
    role, words = node.attrs.get("role", ""), node.ident
    if node.tag == "nav" or role == "navigation":
        return "navigation"
    if node.tag == "footer" or role == "contentinfo":
        return "footer"
    if node.tag == "aside" or role == "complementary" or any(w in words for w in SIDE_WORDS):
        return "sidebar"
    if role == "banner" or any(w in words for w in BANNER_WORDS):
        return "banner"
    return "header" if node.tag == "header" else ""


def inline(node: Node, base: str) -> str:
    """What stands within a block, with code, links and images as markdown; emphasis is left to the text."""
    out = []
    for x in node.inner:
        if not isinstance(x, Node):
            out.append(x)
        elif x.tag in HIDDEN:
            continue
        elif x.tag in ("code", "kbd", "samp"):
            out.append(f"`{x.text()}`" if x.text() else "")
        elif x.tag == "br":
            out.append(" ")
        elif x.tag == "img" and x.attrs.get("src"):
            out.append(f"![{x.attrs.get('alt', '')}]({urljoin(base, x.attrs['src'])})")
        elif x.tag == "a" and x.attrs.get("href", "").strip() and not x.attrs["href"].lower().startswith("javascript:"):
            said = " ".join(inline(x, base).split())
            out.append(f"[{said}]({urljoin(base, x.attrs['href'].strip())})" if said else "")
        else:
            out.append(inline(x, base))
    return "".join(out)


def table(node: Node, base: str) -> str:
    """Rows between bars, the first one as the head; rows are filled up to the widest."""
    rows = [[" ".join(inline(c, base).split()).replace("|", "\\|") for c in r.inner if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def rendered(node: Node, base: str, skip: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of an element as markdown."""
    out: list[str] = []
    loose: list = []

    def end() -> None:
        if said := " ".join(inline(_of(loose), base).split()):
            out.append(said)
        loose.clear()

    for x in node.inner:
        if not isinstance(x, Node) or x.tag not in BLOCKS | {"nav", "header", "footer", "aside", "form", "dl", "dt", "dd", "body", "html", "tbody", "main"}:
            if not isinstance(x, Node) or (x.tag not in HIDDEN and x.tag != "head"):
                inner = isinstance(x, Node) and any(n.tag in BLOCKS for n in x.walk() if n is not x)
                if inner:
                    end()
                    out += rendered(x, base, skip)
                else:
                    loose.append(x)
            continue
        end()
        if id(x) in skip or x.tag in HIDDEN:
            continue
        if x.tag in HEADINGS:
            if said := " ".join(inline(x, base).split()):
                out.append("#" * int(x.tag[1]) + " " + said)
        elif x.tag == "pre":
            body = "".join(x.texts()).strip("\n")
            lang = next((m[1] for n in x.walk() if (m := re.search(r"(?:language|lang)-([\w+#-]+)", n.attrs.get("class", "")))), "")
            out += [f"```{lang}\n{body}\n```"] if body.strip() else []
        elif x.tag == "table":
            out += [t] if (t := table(x, base)) else []
        elif x.tag in ("ul", "ol"):
            out += ["\n".join(items)] if (items := list(listed(x, base, 0))) else []
        elif x.tag == "blockquote":
            out += ["\n".join("> " + line for line in "\n\n".join(inner).split("\n"))] if (inner := rendered(x, base, skip)) else []
        else:
            out += rendered(x, base, skip)
    end()
    return out


def _of(parts: list) -> Node:
    node = Node("", {}, None)
    node.inner = list(parts)
    return node


def listed(node: Node, base: str, depth: int) -> Iterator[str]:
    n = 0
    for x in node.inner:
        if isinstance(x, Node) and x.tag == "li":
            n += 1
            own = _of([y for y in x.inner if not (isinstance(y, Node) and y.tag in ("ul", "ol"))])
            if said := " ".join(inline(own, base).split()):
                yield "  " * depth + (f"{n}. " if node.tag == "ol" else "- ") + said
            for y in x.inner:
                if isinstance(y, Node) and y.tag in ("ul", "ol"):
                    yield from listed(y, base, depth + 1)


def long_strings(payload: str) -> list[str]:
    """The texts in JSON that read like content, each once, in order."""
    try:
        todo = [json.loads(payload)]
    except ValueError:
        return []
    found: dict[str, None] = {}
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, str):
            said = " ".join(re.sub(r"<[^>]+>", " ", x).split())
            if len(said) >= LEAST_STRING and said.count(" ") >= 8 and article_score(said) > 0:
                found.setdefault(said)
    return list(found)


def scripts(root: Node, kind: str) -> Iterator[str]:
    """Contents of scripts whose type holds kind."""
    todo = [root]
    while todo:
        n = todo.pop(0)
        if n.tag == "script" and kind in n.attrs.get("type", "").lower():
            yield "".join(x for x in n.inner if isinstance(x, str))
        todo = [x for x in n.inner if isinstance(x, Node)] + todo


def json_ld(root: Node) -> dict[str, str]:
    """Headline, author, date, description and image that structured data names, the first of each."""
    out: dict[str, str] = {}
    for payload in scripts(root, "ld+json"):
        try:
            todo = [json.loads(payload)]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                todo += x.get("@graph") or []
                named = lambda v: named(v[0]) if isinstance(v, list) and v else v.get("name") or v.get("url") or "" if isinstance(v, dict) else v  # noqa: E731, B023
                for field, keys in (("title", ("headline", "name")), ("author", ("author",)), ("published", ("datePublished", "dateCreated")), ("description", ("description",)), ("image", ("image",))):
                    value = next((v for k in keys if isinstance(v := named(x.get(k)), str) and v.strip()), "")
                    if value:
                        out.setdefault(field, " ".join(value.split()))
    return out


def extracted(html: str | None, url: str | None, closed: bool = False) -> dict:
    """EXTRACTED of a page; closed: as Parser has it."""
    base, root = url or "", tree(html, closed)
    engine, node = primary(root)
    zones: dict[str, list[Node]] = {}
    inside = {id(n) for n in node.walk()} if node is not None else set()
    todo = [root]
    while todo:
        n = todo.pop(0)
        if (name := zone(n)) and n is not node and n.tag not in HIDDEN:
            zones.setdefault(name, []).append(n)
        else:
            todo = [x for x in n.inner if isinstance(x, Node)] + todo
    aside = frozenset(id(n) for nodes in zones.values() for n in nodes if id(n) in inside)
    blocks = rendered(node, base, aside) if node is not None else []
    text = " ".join(w for n in ([node] if node is not None else []) for w in n.text().split())
    if article_score(text) < LEAST_PRIMARY:
        strings = [s for kind in ("json",) for p in scripts(root, kind) if "ld+json" not in p for s in long_strings(p)]
        if article_score(" ".join(strings)) > article_score(text):
            engine, blocks, text = "script", strings, " ".join(strings)
    count = node.count if node is not None and engine != "script" else lambda *tags: 0
    return {
        "engine": engine,
        "markdown": "\n\n".join(blocks),
        "text": text,
        "sections": {name: "\n\n".join(b for n in nodes for b in rendered(n, base)) for name, nodes in zones.items()},
        "warnings": ["primary content is short"] if len(text) < LEAST_PRIMARY else [],
        "json_ld": json_ld(root),
        "counts": {"headings": count(*HEADINGS), "paragraphs": count("p"), "items": count("li"), "rows": count("tr"), "code_blocks": count("pre"), "links": count("a"), "images": count("img")},
    }


def content(html: Column | str, url: Column | str, closed: bool = False) -> Column:
    """EXTRACTED of each page, as a struct; closed: as Parser has it."""

    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extracted(p, u, closed) for p, u in zip(pages, urls, strict=True)], columns=EXTRACTED_FIELDS)

    return F.pandas_udf(run, EXTRACTED)(col(html), col(url))
