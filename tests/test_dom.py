"""Pages as trees, on hand-written markup."""

from __future__ import annotations

from spindrift.functions import dom

PAGE = """<html><head><title>T</title><script type="application/ld+json">{"@graph":[{"headline":"Head  line","author":[{"name":"Ann"}],"datePublished":"2024-01-02"}]}</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav>
<main><h1>One <em>two</em></h1><p>First <code>x = 1</code> and <a href="b?q=1">link</a><p>Second<br>line <img src="i.png" alt="pic">
<ul><li>a<li>b<ul><li>c</ul></ul><ol><li>x</li><li>y</li></ol>
<pre><code class="language-py">def f():
    return 1</code></pre>
<table><tr><th>k<th>v<tr><td>a|b<td>2<tr><td>only</table><blockquote><p>said</p><p>more</p></blockquote>
<aside class="related">see also</aside><script>var x = "<p>no</p>"</script><div>loose text</div></main><footer>end</footer></body></html>"""


def test_markdown():
    got = dom.extracted(PAGE, "https://h.example/d/")
    assert got["engine"] == "semantic"
    assert got["markdown"].split("\n\n") == [
        "# One two",
        "First `x = 1` and [link](https://h.example/d/b?q=1)",
        "Second line ![pic](https://h.example/d/i.png)",
        "- a\n- b\n  - c",
        "1. x\n2. y",
        "```py\ndef f():\n    return 1\n```",
        "| k | v |\n| --- | --- |\n| a\\|b | 2 |\n| only |  |",
        "> said\n> \n> more",
        "loose text",
    ]
    assert got["sections"] == {"header": "[Home](https://h.example/)", "navigation": "- [A](https://h.example/a)", "sidebar": "see also", "footer": "end"}
    assert got["json_ld"] == {"title": "Head line", "author": "Ann", "published": "2024-01-02"}
    assert got["counts"]["items"] == 5 and got["counts"]["rows"] == 3 and got["warnings"] == ["primary content is short"]


def test_candidates():
    long = "Words in a row, as they stand. " * 8
    assert dom.extracted(f"<body><div class='menu'>{long * 3}</div><div id='x'><p>{long}</p></div></body>", "")["engine"] == "heuristic"
    assert dom.extracted(f"<article>{long}</article><div class='vp-doc'>docs {long}</div>", "")["engine"] == "docs"
    assert dom.extracted("<body>short</body>", "")["engine"] == "body" and dom.extracted("<body>short</body>", "")["warnings"]
    assert dom.extracted(None, None)["engine"] == "none" and dom.extracted("", "")["markdown"] == ""
    many = dom.extracted(f"<article>one</article><article>{long}</article>", "")
    assert many["text"] == long.strip()


def test_scripts():
    said = "This sentence is long enough to be read as the content of a page, with words and commas, and more."
    page = '<body><div id="root"></div><script type="application/json">{"a": {"b": ["%s", "%s", "https://x"]}, "c": 1}</script></body>' % (said, said)
    got = dom.extracted(page, "")
    assert (got["engine"], got["markdown"]) == ("script", said)
    assert dom.long_strings("no json") == [] and dom.long_strings('["short"]') == []
