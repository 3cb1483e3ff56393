"""Main text of all pages of the table against a plain reading of their articles, and pages that are hard to read."""

import html
import re
import time

import pandas as pd
import pytest

from palimpsest.llm import pages

DATA = "/root/testdata/sf0.01"


def plain(page):
    """Of the table's pages: blocks of the article, which holds a title, paragraphs, bold words and line breaks alone."""
    body = re.search(r"(?s)<article>(.*)</article>", page)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_all_pages_of_the_table(spark):
    rows = pd.read_parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.op8_html_extraction(spark, DATA).collect()}
    assert found == {i: (plain(h), len(plain(h))) for i, h in zip(rows.page_id, rows.html, strict=True)}


SENTENCE = "This is a sentence of the article that says something."


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<p>The area is <math><mi>x</mi></math> units for all.</p>", "The area is x units for all."),
        ('<p>This <span title="x>broken attr</span> goes on here.</p>', "This broken attr goes on here."),
        (f'<div class="tabs"><p>{SENTENCE}</p></div>', SENTENCE),
        (f"<noscript><p>{SENTENCE}</p></noscript>", SENTENCE),
        (f'<p><object data="x">{SENTENCE}</object></p>', SENTENCE),
        (f"<p>{SENTENCE}<script>var p = '<p>no</p>';</script><style>p{{}}</style></p>", SENTENCE),
    ],
)
def test_nothing_of_the_article_is_lost(inner, want):
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>On it</h1><p>{SENTENCE}</p>{inner}</article><footer>&copy; me</footer></body></html>"
    assert pages.extract(page, pages.trained()) == f"On it\n\n{SENTENCE}\n\n{want}"


@pytest.mark.parametrize("part", ["<div>", '<a title="x ', "<p><b>", "<p></i>", "<!--", "<li><ul>", "<"])
def test_reading_takes_linear_time(part):
    def took(n):
        began = time.process_time()
        pages.parse(part * n)
        return time.process_time() - began

    assert took(40_000) < 30 * max(0.02, took(4_000))
