"""Character references with and without their semicolon."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from spindrift.functions import dom, html
from spindrift.plans.catalog import ORACLES, QUERIES
from tests.test_catalog import shaped

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{0}</title><style>p{{margin:0}}</style><script>var t="</p>" && 1;</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav>
<article><h1>{0}</h1><p>Words, in a row &amp; one more. {0}</p><p>Others &quot;said&quot; &amp;lt; &lt;b&gt;.</p></article><footer>&copy; example.org &middot; end.</footer></body></html>"""
#: Titles that were cut within a reference, as those of large tables are.
TITLES = ["one &amp;&amp", "two &am", "three &a", "four &quot", "five &quo", "six & &lt", "seven &notit; &ampx", "eight && &amp;amp", "nine ﷐ &amp"]


def as_sql(spark, path, name, texts):
    pd.DataFrame({"page_id": range(len(texts)), "url": "https://example.org/x", "html": texts}).to_parquet(path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    pd.testing.assert_frame_equal(shaped(QUERIES[name](spark, str(path)).toPandas()), shaped(con.execute(ORACLES[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", ["final_markdown", "page_content", "page_extraction", "page_quality"])
def test_query(spark, tmp_path, name):
    """A query reads what its SQL reads: references with their semicolon."""
    as_sql(spark, tmp_path, name, [PAGE.format(t) for t in TITLES])


def test_content():
    """By itself the tree reads references as the HTML standard does; closed, values and scripts keep their ampersands too."""
    page = '<main><p>a &amp b &eacute; &#38; &notit;</p><a href="/x?y=1&z=2&amp;w=3">&amp</a></main><script type="application/ld+json">{"headline": "R&D &amp; S&amp"}</script>'
    assert dom.extracted(page, "")["markdown"] == "a & b é & ¬it;\n\n[&](/x?y=1&z=2&w=3)"
    closed = dom.extracted(page, "", closed=True)
    assert closed["markdown"] == "a &amp b é & &notit;\n\n[&amp](/x?y=1&z=2&w=3)"
    assert closed["json_ld"]["title"] == "R&D &amp; S&amp"


@pytest.mark.parametrize(("closed", "title", "link"), [(False, "R&D &", "&"), (True, "R&D &amp", "&amp")])
def test_page(spark, closed, title, link):
    rows = spark.createDataFrame([("<title>R&amp;D &amp</title><a href='/x?y=1&z=2'>&amp</a>", "https://example.org")], "h string, u string")
    got = rows.select(html.page("h", "u", closed).alias("p")).first().p
    assert (got.title, got.links[0].url, got.links[0].text) == (title, "https://example.org/x?y=1&z=2", link)


def test_ties(spark, tmp_path):
    """With one script among 32 tags every content score is a tie at the sixth digit, which SQL rounds as a product."""
    page = "<html><head><title>t</title><script>1</script></head><body>" + "<p>" * 27
    as_sql(spark, tmp_path, "page_quality", [page + "w" * n for n in (28, 36, 89, 200, 1020, 1437)])
