"""Special documents: plain text, papers, DOI records, discussion threads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.dates import date_parts
from spindrift.functions.text import clean_whitespace, col

#: Sites whose copies can usually be read, and sites that usually refuse.
READABLE = ("plos.org", "ncbi.nlm.nih.gov", "arxiv.org", "biorxiv.org", "medrxiv.org", "frontiersin.org", "sciencedirect.com", "nature.com")
REFUSING = ("mdpi.com", "elsevier.com", "springer.com", "wiley.com", "tandfonline.com", "ieee.org", "acm.org")
THREAD_DEPTH = 3


def plain_text(c: Column | str) -> Column:
    """Clean lines of a text, one blank line between them."""
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), "\r\n?|\n"), clean_whitespace)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def one_line_markdown(c: Column | str) -> Column:
    return clean_whitespace(c)


def link_class(url: Column | str) -> Column:
    """0 for readable sites, 2 for refusing ones, else 1: sort by it, then by position."""
    u = F.lower(col(url))
    has = lambda sites: F.exists(F.array(*map(F.lit, sites)), lambda s: F.contains(u, s))
    return F.when(has(READABLE), 0).when(has(REFUSING), 2).otherwise(1)


def meta_values(html: Column | str, name: str) -> Column:
    """Contents of all meta tags of a name or property, clean, none empty."""
    quoted = name.replace(".", r"\.")
    tags = F.regexp_extract_all(col(html), F.lit(rf"(?is)(<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']{quoted}[\"'][^>]*>)"), 1)
    return F.filter(F.transform(tags, lambda t: clean_whitespace(F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1))), lambda v: v != "")


def paper_meta(html: Column | str) -> Column:
    """Title, authors, date and abstract of a paper's page; null where it names none of them."""
    first = lambda *names: F.coalesce(*[F.get(meta_values(html, n), F.lit(0)) for n in names], F.lit(""))
    made = F.struct(first("citation_title", "og:title").alias("title"), F.array_join(meta_values(html, "citation_author"), "; ").alias("authors"), first("citation_date", "citation_publication_date").alias("published_date"), first("citation_abstract").alias("abstract"))
    return F.when((made["title"] != "") | (made["authors"] != "") | (made["published_date"] != "") | (made["abstract"] != ""), made)


def documents_first(links: Column, document_urls: Column) -> Column:
    """Links (array<struct<url,…>>) whose address without query and fragment is a document's, then the others, each in order."""
    bare = lambda u: F.regexp_replace(F.lower(u), "[?#].*$", "")
    known = F.transform(document_urls, bare)
    is_doc = lambda x: F.array_contains(known, bare(x["url"]))
    return F.concat(F.filter(links, is_doc), F.filter(links, lambda x: ~is_doc(x)))


def doi_record(message: Column | str) -> Column:
    """Title, authors, date and markdown of a registry's JSON record."""
    get = lambda path: F.coalesce(F.get_json_object(col(message), path), F.lit(""))
    people = F.from_json(get("$.author"), "array<struct<given:string,family:string>>")
    names = F.array_join(F.filter(F.transform(F.coalesce(people, F.array().cast("array<struct<given:string,family:string>>")), lambda p: clean_whitespace(F.concat_ws(" ", p["given"], p["family"]))), lambda n: n != ""), "; ")
    parts = F.coalesce(*[F.from_json(F.nullif(get(f"$.{k}.date-parts[0]"), F.lit("")), "array<int>") for k in ("published-print", "published-online", "published", "issued", "created")])
    date = F.coalesce(date_parts(parts), F.lit(""))
    title, abstract = clean_whitespace(get("$.title[0]")), clean_whitespace(F.regexp_replace(get("$.abstract"), "<[^>]+>", ""))
    body = F.concat_ws("\n\n", F.when(title != "", F.concat(F.lit("# "), title)), F.when(names != "", F.concat(F.lit("Authors: "), names)), F.when(date != "", F.concat(F.lit("Published: "), date)), F.when(abstract != "", F.concat(F.lit("## Abstract\n\n"), abstract)))
    return F.struct(title.alias("title"), names.alias("authors"), date.alias("published_date"), body.alias("markdown"))


def thread_lines(children: list, depth: int) -> list[str]:
    """Comments of one level and, within THREAD_DEPTH, the replies under each."""
    out: list[str] = []
    for child in children if isinstance(children, list) else []:
        data = child.get("data") if isinstance(child, dict) and child.get("kind") == "t1" else None
        body = str((data or {}).get("body") or "").strip()
        if not body or body == "[deleted]":
            continue
        indent = "> " * depth
        out += [f"{indent}### **{data.get('author') or '[deleted]'}** ({int(data.get('score') or 0)} pts)", ""]
        out += [indent + line if line.strip() else "" for line in body.split("\n")] + [""]
        replies = data.get("replies")
        if depth + 1 < THREAD_DEPTH and isinstance(replies, dict):
            out += thread_lines(replies.get("data", {}).get("children", []), depth + 1)
    return out


def thread_markdown(text: str | None) -> str:
    try:
        post, comments = json.loads(text or "")[:2]
        head = post["data"]["children"][0]["data"]
    except (ValueError, KeyError, IndexError, TypeError):
        return ""
    said = str(head.get("selftext") or "").strip()
    lines = thread_lines(comments.get("data", {}).get("children", []), 0) if isinstance(comments, dict) else []
    return "\n".join([f"# {head.get('title') or ''}", "", *([said, ""] if said else []), *lines]).strip()


def _threads(texts: pd.Series) -> pd.Series:
    return texts.map(thread_markdown)


def thread(c: Column | str) -> Column:
    """Markdown of a discussion's JSON, replies up to THREAD_DEPTH levels; '' where it is none."""
    return F.pandas_udf(_threads, "string")(col(c))
