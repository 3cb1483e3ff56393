"""Text and dates of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Text(HTMLParser):
    SKIPPED = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def plain_text(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def html_to_text(page: Column) -> Column:
    """All text of a page but scripts and styles; the parser needs Python, in Arrow batches."""

    @F.pandas_udf("string")
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(plain_text)

    return parse(page)


def compact_date(said: Column, fallback: str) -> Column:
    """yyyyMMdd of the first three groups of digits, else of the first eight digits, else the fallback; not checked against the calendar."""
    groups = F.filter(F.split(said, r"[^0-9]+"), lambda x: x != "")
    digits = F.regexp_replace(said, "[^0-9]", "")
    year = F.try_element_at(groups, F.lit(1)).cast("int")
    full = F.concat(F.lpad(F.when(year < 100, year + 2000).otherwise(year).cast("string"), 4, "0"), F.lpad(F.try_element_at(groups, F.lit(2)), 2, "0"), F.lpad(F.try_element_at(groups, F.lit(3)), 2, "0"))
    return F.when(F.size(groups) >= 3, full).when(F.length(digits) >= 8, F.left(digits, F.lit(8))).otherwise(F.lit(fallback))


def page_date(page: Column, url: Column, published: Column, snippet: Column, fallback: str) -> Column:
    """Publish date: of the URL, the search result, JSON-LD, meta tags, time elements, the page's start, the snippet."""
    got = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    day = r"((?:19|20)\d{2}[-./년 ]{1,2}\d{1,2}[-./월 ]{1,2}\d{1,2})"
    found = F.coalesce(
        got(url, r"((?:19|20)\d{2}[-/]?(?:0[1-9]|1[0-2])[-/]?(?:0[1-9]|[12]\d|3[01]))"),
        F.nullif(published, F.lit("")),
        got(page, r'"datePublished"\s*:\s*"([^"]+)"'),
        got(page, r'"dateModified"\s*:\s*"([^"]+)"'),
        got(page, r'(?i)<meta[^>]+(?:published_time|pubdate|dc\.date|date)[^>]+content="([^"]+)"'),
        got(page, r'(?i)<time[^>]+datetime="([^"]+)"'),
        got(F.left(page, F.lit(3000)), day),
        got(snippet, day),
    )
    return compact_date(F.coalesce(found, F.lit("")), fallback)
