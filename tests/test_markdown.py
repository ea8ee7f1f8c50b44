"""Markdown rules on hand-written cases."""

from __future__ import annotations

import pytest

from spindrift.functions import markdown as md


@pytest.mark.parametrize(
    ("line", "kind", "body"),
    [("", "blank", ""), ("  ## Head two", "heading", "Head two"), ("#no", "text", "#no"), ("####### x", "text", "####### x"), ("> said", "quote", "said"), ("- one", "item", "one"), ("12) two", "item", "two"), ("12.5 x", "text", "12.5 x"),
     ("| a | b |", "table", "| a | b |"), ("|---|:---:|", "divider", "|---|:---:|"), ("---", "rule", "---"), ("* * *", "rule", "* * *"), ("====", "rule", "===="), ("[a]: http://x", "reference", "[a]: http://x"), ("[a] b", "text", "[a] b"), ("```py", "fence", "```py")],
)
def test_lines(line, kind, body):
    found = md.classified(line)
    assert (found.kind, found.body) == (kind, body)


@pytest.mark.parametrize(
    ("text", "plain", "with_images"),
    [("a [b](http://x) c", "a b c", "a b c"), ("![alt](u) z", " z", "alt z"), ("[![alt](i)](u)", "", "alt"), ("[t][r] and [u]", "t and [u]", "t and [u]"), ('x <a href="u">y</a> z', "x y z", "x y z"), ("see https://h/p?q=1 now <http://z>", "see  now ", "see  now "), ("f(x)[0] [w](a_(b))", "f(x)[0] w", "f(x)[0] w"), ("[open](", "[open](", "[open]("), ("[e]()", "[e]()", "[e]()")],
)
def test_links(text, plain, with_images):
    assert (md.without_links(text, False), md.without_links(text, True)) == (plain, with_images)


PAGE = """# Title

Some  `code  stays` text with [a link](http://x).
Subscribe to our letter
- item one
\t- deeper

Some  `code  stays` text with [a link](http://x).
| a | b |
|---|---|
| 1 | 2 |


```py
x  =  1

y = [z](w)
```
[ref]: http://x
***
Skip to main content
The **end** \\* __here__
"""


def test_texts():
    assert md.to_text(PAGE).split("\n")[:4] == ["Title", "Some code  stays text with a link.".replace("  ", " "), "Subscribe to our letter", "item one"]
    assert "x  =  1" in md.to_text(PAGE) and "y = [z](w)" in md.to_text(PAGE)
    assert md.to_abstract_text(PAGE).split("\n") == ["Title", "Some code stays text with a link.", "Subscribe to our letter", "item one", "deeper", "Some code stays text with a link.", "a b", "1 2", "The end * here"]
    assert "y = [z](w)" in md.unlinked(PAGE) and "[ref]" not in md.unlinked(PAGE) and "a link." in md.unlinked(PAGE)
    assert md.to_text(None) == md.to_abstract_text("") == md.finalized(None) == ""


def test_finished():
    got = md.finalized(PAGE)
    assert got == "# Title\n\nSome `code  stays` text with [a link](http://x).\n- item one\n    - deeper\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx  =  1\n\ny = [z](w)\n```\n[ref]: http://x\n***\nSkip to main content\nThe **end** \\* __here__"
    assert md.finalized(got) == got
    assert md.finalized("x", metadata={"title": "a: b", "url": "", "by": "me"}) == '---\ntitle: "a: b"\nby: me\n---\n\nx'
    assert md.finalized("short one\n\nshort one\n\na long paragraph\n\nA  long paragraph") == "short one\n\nshort one\n\na long paragraph"


def test_cut():
    text = "para " * 10 + "\n\n" + "- item\n" * 10 + "```\n" + "code\n" * 50 + "```\nend"
    assert md.clipped(text, 10_000) == text
    for most in range(5, len(text)):
        got = md.clipped(text, most)
        assert len(got) <= most and text.startswith(got) and got.count("```") in (0, 2)
    assert md.clipped(text, 110).endswith("- item")


def test_decoding():
    assert md.decoded("é\r\nü  x".encode(), "text/plain; charset=utf-8") == "é ü x"
    assert md.decoded("<p>ж</p>\r\n".encode("cp1251"), "text/html; charset=cp1251") == "<p>ж</p>\n"
    assert md.decoded("日本語".encode("shift_jis"), "text/plain; charset=Shift_JIS") == "日本語"
    assert md.decoded(b"\xff\xfe" + "<html>x".encode("utf-16-le")).endswith("<html>x")
    assert md.decoded("ж".encode("koi8-r"), "", lambda data: "koi8-r") == "ж" and md.decoded(None) == ""
    assert md.squeezed("a  b `c  d`  e ``f ` g  h`` `i  j") == "a b `c  d` e ``f ` g  h`` `i  j"
