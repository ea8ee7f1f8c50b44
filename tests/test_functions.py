"""Column functions on single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spindrift.functions import dates, html, json, scores, text, urls


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for i, v in enumerate(values)))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (text.clean_whitespace, " a  \n b\x1c ", "a b"),
        (text.clean_whitespace, None, ""),
        (text.normalize_text, "ＡＢＣ ﬁ  X", "abc fi x"),
        (text.strip_html, " <b>a</b> <i>b</i> ", "a b"),
        (text.tokenize, "The the für foo-bar.baz 日本語 語 x", ["the", "f", "r", "foo-bar.baz", "x", "日本語"]),
        (text.casefold, "Straße", "strasse"),
        (text.fold, "Straße ΣΑΣ", "strasse σασ"),
        (text.table_row, "| a | b |", "a | b"),
        (text.table_row, "|---|:--:|", ""),
        (text.count_suffix, "1.2k", 1200),
        (text.count_suffix, "3m", 3_000_000),
        (text.count_suffix, "1,234", 1234),
        (text.count_suffix, "many", 0),
        (text.language_tag, "EN_us", "en-US"),
        (text.language_tag, "zh-hant-tw", "zh-Hant-TW"),
        (text.language_tag, "all", ""),
        (text.quote_bangs, "find !g !  x", "find '!g' ! x"),
        (text.citation_expand, "a [citation:1, 2,1] b", "a [citation:1][citation:2] b"),
        (text.citation_indexes, "[citation:3] [Citation: 1,3]", [3, 1]),
        (text.citation_strip, "a[citation:1, 2] b", "a b"),
        (text.sentences, "Dr. Smith paid 3.5 (see v. 2. or so) today. Then he left! \"Why?\" End", ["Dr. Smith paid 3.5 (see v. 2. or so) today.", "Then he left!", "\"Why?\"", "End"]),
        (text.sentences, "第一句。第二句！", ["第一句。", "第二句！"]),
        (text.strip_links, "[t](http://u) ![alt](x.png) see http://a.b/c", "t alt see "),
        (urls.canonical_url, "HTTPS://Example.com:443//a//b/?b=2&utm_x=1&a=1&z=#f", "https://example.com/a/b?a=1&b=2"),
        (urls.canonical_url_exact, "HTTPS://Example.com:443//a//b/?b=2&utm_x=1&a=1&z=#f", "https://example.com/a/b?a=1&b=2"),
        (urls.canonical_url_exact, "http://u:p@h.org:8080", "http://h.org:8080/"),
        (urls.canonical_url, "no host", "no host"),
        (urls.domain, "https://u@www.Example.com:80/x", "example.com"),
        (urls.domain, "example.org/x", "example.org"),
        (urls.url_key, "HTTP://Ex.com/A?b#c", "http://ex.com/A?b"),
        (urls.route_key, "https://Ex.com/p/123/0123456789abcdef/x/y", "ex.com/p/:int/:hash/x"),
        (urls.doi, "https://doi.org/10.1234/AbC.", "10.1234/abc"),
        (urls.is_reddit_post, "https://www.reddit.com/r/x/comments/1/t", True),
        (urls.redirect_target, "https://www.google.com/url?q=https%3A%2F%2Fa.b%2Fc&x=1", "https://a.b/c"),
        (dates.normalized, "2024-05-01T10:00:00+02:00", "2024-05-01T08:00:00+00:00"),
        (dates.normalized, "2024-05-01", "2024-05-01"),
        (dates.normalized, "2024-13-01", None),
        (dates.end_exclusive, "2024-02-29", "2024-03-01"),
        (dates.pdf_date, "D:20240102030405Z", "2024-01-02T03:04:05+00:00"),
        (html.visible_native, "<html><head><title>t</title></head><body><p>a &amp; b</p><script>x</script></body>", "a & b"),
        (html.title_native, "<title> a\n b </title>", "a b"),
        (scores.safe, "nan", 0.0),
        (scores.safe, "1.5", 1.5),
        (json.truthy, "Yes", True),
    ],
)
def test_value(spark, make, value, expected):
    assert one(spark, make, value) == expected


def test_ranges(spark):
    rows = spark.createDataFrame([("2024-01-31",), ("2024-01-31T23:59:59Z",), ("2024-02-01",), ("",), ("bad",)], "d string")
    inside = lambda **k: [r[0] for r in rows.select(dates.in_range("d", **k)).collect()]
    assert inside(start="2024-01-01", end="2024-01-31") == [True, True, False, False, False]
    assert inside(end="2024-01-31T00:00:00Z") == [True, False, False, False, False]
    assert inside(start="2024-01-01", undated=True) == [True, True, True, True, False]
    assert inside() == [True] * 5


def test_earliest(spark):
    d = F.array(F.lit("2024-01-02"), F.lit("2024-01-01"), F.lit("2024-01-01T00:00:00Z"), F.lit("x"), F.lit(""))
    assert spark.range(1).select(dates.earliest(d)).first()[0] == "2024-01-01T00:00:00+00:00"


def test_percentile(spark):
    def ranks(values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s double")
        return [r.p for r in df.select("i", scores.percentile("s", [], ["i"]).alias("p")).orderBy("i").collect()]

    assert ranks([2.0]) == [0.75] and ranks([0.0]) == [0.0]
    assert ranks([0.0, 0.0]) == [0.0, 0.0]
    assert ranks([1.0, 1.0, 1.0]) == [1.0, 0.5, 0.0]
    assert ranks([3.0, 1.0, 1.0, float("nan")]) == [1.0, 0.5, 0.5, 0.0]


def test_html_page(spark):
    page = "<html lang='EN'><head><title>T</title><meta property='og:title' content='OG'></head><body><nav><a href='/n'>nav</a></nav><main><h1>Head</h1><p>One <a href='b?x=1'>link</a>.</p><div class='ad'>ad</div></main></body></html>"
    p = spark.createDataFrame([(page, "https://e.org/a/")], "h string, u string").select(html.page("h", "u").alias("p")).first().p
    assert (p.title, p.lang, p.markdown) == ("OG", "en", "# Head\n\nOne link.")
    assert [(x.url, x.zone) for x in p.links] == [("https://e.org/a/b?x=1", "primary"), ("https://e.org/n", "secondary")]


def test_markers(spark):
    hit = lambda v, t, h: one(spark, scores.marker_hit, v, t, h)
    assert hit("just a moment cloudflare", "just a moment", "") is True
    assert hit("about cloudflare", "", "") is False
    assert hit("cloudflare access denied", "", "") is True
    assert hit("cloudflare access denied" + " x" * 2000, "", "") is False
