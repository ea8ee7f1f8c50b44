"""URL rules as columns."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import clean_whitespace, col

#: Query keys that track visitors.
TRACKING_KEYS, TRACKING_PREFIX = ("gclid", "fbclid", "msclkid"), "utm_"
DEFAULT_PORTS = {"http": "80", "https": "443"}
DOI = r"(10\.\d{4,9}/[^\s\"<>?#]+)"
REDDIT_HOSTS = ("reddit.com", "www.reddit.com", "old.reddit.com", "m.reddit.com", "np.reddit.com", "new.reddit.com")


def canonical_exact(raw: str | None) -> str:
    """Canonical form of any URL, by the standard library's URL rules."""
    token = " ".join((raw or "").split())
    try:
        parts = urlsplit(token)
        host, port = (parts.hostname or "").strip(), parts.port
    except ValueError:
        return token
    if not token or not host:
        return token
    scheme = parts.scheme.lower() or "https"
    where = f"[{host}]" if ":" in host else host
    if port and str(port) != DEFAULT_PORTS.get(scheme):
        where = f"{where}:{port}"
    path = " ".join(parts.path.split()) or "/"
    while "//" in path:
        path = path.replace("//", "/")
    path = path.rstrip("/") or "/"
    pairs = [(" ".join(k.split()), " ".join(v.split())) for k, v in parse_qsl(parts.query)]
    kept = [(k, v) for k, v in pairs if k and k.casefold() not in TRACKING_KEYS and not k.casefold().startswith(TRACKING_PREFIX)]
    return urlunsplit((scheme, where, path, urlencode(sorted(kept, key=lambda x: (x[0].casefold(), x[1]))), ""))


def _canonical(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_exact)


def canonical_url_exact(c: Column | str) -> Column:
    """canonical_exact in Arrow batches; for URLs with escapes, odd ports or users, where built-ins fall short."""
    return F.pandas_udf(_canonical, "string")(col(c))


def canonical_url(c: Column | str) -> Column:
    """Canonical form with built-ins alone, for plain URLs (scheme://host[:port]/path?query#fragment, no escapes in the query)."""
    token = clean_whitespace(c)
    scheme = F.lower(F.regexp_extract(token, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(token, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    port = F.regexp_extract(token, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]+:(\d+)", 1)
    path = F.regexp_extract(token, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(token, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.lower(p).rlike(f"^({'|'.join(TRACKING_KEYS)})=|^{TRACKING_PREFIX}"))
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"), p.alias("p"))))
    rest = F.array_join(F.transform(ordered, lambda x: x["p"]), "&")
    shown_port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    made = F.concat(scheme, F.lit("://"), host, shown_port, F.when(path == "", "/").otherwise(path), F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))
    return F.when(host == "", token).otherwise(made)


def domain(c: Column | str) -> Column:
    """Host without user, port and www."""
    place = F.regexp_extract(clean_whitespace(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.substring_index(F.substring_index(place, "@", -1), ":", 1)), r"^www\.", "")


def domain_matches(d: Column, tokens: list[str]) -> Column:
    """Whether a domain is one of the tokens or under one."""
    clean = [t.strip().lower().strip(".").removeprefix("www.") for t in tokens]
    return F.exists(F.array(*[F.lit(t) for t in clean if t]).cast("array<string>"), lambda t: (d == t) | F.endswith(d, F.concat(F.lit("."), t))) & (d != "")


def domain_allowed(d: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """An include list decides alone; otherwise nothing that the exclude list names."""
    if include:
        return domain_matches(d, include)
    return ~domain_matches(d, exclude) if exclude else F.lit(True)


def strip_fragment(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "#.*$", "")


def without_query(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[?#].*$", "")


def url_key(c: Column | str) -> Column:
    """Lower scheme and place, no fragment, path and query as they are."""
    token = strip_fragment(clean_whitespace(c))
    head = F.regexp_extract(token, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substring(token, F.length(head) + 1, F.length(token)))


def route_key(c: Column | str) -> Column:
    """Host and up to four path segments, with numbers, ids and long names as templates."""
    path = F.regexp_extract(clean_whitespace(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, 4)

    def named(s: Column) -> Column:
        s = F.lower(F.trim(s))
        return F.when(s.rlike(r"^\d+$"), ":int").when(s.rlike("^[0-9a-f]{8,}(-[0-9a-f]{4,})+[0-9a-f]{4,}$"), ":uuid").when(s.rlike("^[0-9a-f]{12,}$"), ":hash").when(F.length(s) > 40, ":long").when(s == "", "_").otherwise(s)

    host = F.lower(F.regexp_extract(clean_whitespace(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.concat(host, F.lit("/"), F.array_join(F.transform(segments, named), "/"))


def doi(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(col(c), F.lit("")), DOI, 1), r"[.,;)]+$", ""))


def is_reddit_post(c: Column | str) -> Column:
    host = F.lower(F.regexp_extract(col(c), r"^https?://([^/?#:@]+)", 1))
    return host.isin(*REDDIT_HOSTS) & F.contains(col(c), F.lit("/comments/")) & ~col(c).rlike("/(user|u)/")


def reddit_json(c: Column | str) -> Column:
    return F.concat(F.regexp_replace(without_query(c), "/+$", ""), F.lit(".json"))


def redirect_target(c: Column | str) -> Column:
    """What a result page's redirect link leads to (its q, url or uddg value); other links as they are."""
    link = col(c)
    found = F.coalesce(*[F.nullif(F.regexp_extract(link, rf"[?&]{k}=([^&#]+)", 1), F.lit("")) for k in ("uddg", "q", "url")])
    return F.when(link.rlike(r"(?i)^(https?:)?//[^/]*(google|duckduckgo|bing)\.[^/]*/|^/(url|l/)\?") & found.isNotNull(), F.try_url_decode(found)).otherwise(link)


def page_link(url: Column | str, base: Column | str) -> Column:
    """A link of a page as an absolute http(s) URL without tracking keys and fragment, or null; order and blank values of the query stay."""
    return F.pandas_udf(_page_links, "string")(col(url), col(base))


def _page_links(urls: pd.Series, bases: pd.Series) -> pd.Series:
    def one(url: str | None, base: str | None) -> str | None:
        try:
            parts = urlsplit(urljoin(base or "", (url or "").strip()))
        except ValueError:
            return None
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return None
        kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.casefold() not in TRACKING_KEYS and not k.casefold().startswith(TRACKING_PREFIX)]
        return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(kept), ""))

    return pd.Series([one(u, b) for u, b in zip(urls, bases, strict=True)], dtype=object)
