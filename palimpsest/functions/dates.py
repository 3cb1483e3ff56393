"""Publish dates of web pages from their elements.

Sources, in order: the URL, the search result, JSON-LD scripts (published
before modified), meta elements of known names or properties, elements of known classes and ids,
``time`` elements, the first characters of the page's text, the Last-Modified
header, the search snippet. What is no day of the calendar is passed over.
Attributes may stand in any order and in any quotes.
"""

from __future__ import annotations

import datetime
import json
import re
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of meta elements, classes and ids that hold a date, in order.
META_NAMES = ("article:published_time", "article:modified_time", "date", "pubdate", "publish_date", "created_at", "og:updated_time", "regdate")
SELECTORS = (("class", "date"), ("class", "pubDate"), ("class", "published"), ("class", "time"), ("id", "date"), ("class", "reg-date"))
#: Characters of the page's text that are looked through.
START = 3000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_URL = re.compile(r"20\d{2}[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])")
IN_TEXT = (re.compile(r"20\d{2}[-./](?:0[1-9]|1[0-2])[-./](?:0[1-9]|[12]\d|3[01])"), re.compile(r"20\d{2}년\s*(?:0?[1-9]|1[0-2])월\s*(?:0?[1-9]|[12]\d|3[01])일"))
IN_JSON = {name: re.compile(rf'"{name}"\s*:\s*"([^"]+)"') for name in ("datePublished", "dateModified")}


def day_of(said: str | None) -> str | None:
    """yyyyMMdd of the first three groups of digits, else of the first eight digits; None where that is no day."""
    groups = re.findall(r"\d+", said or "")
    digits = "".join(groups)
    if len(groups) >= 3:
        year, month, day = groups[0], groups[1], groups[2]
    elif len(digits) >= 8:
        year, month, day = digits[:4], digits[4:6], digits[6:8]
    else:
        return None
    try:
        number = int(year)
        return datetime.date(number + 2000 if number < 100 else number, int(month), int(day)).strftime("%Y%m%d")
    except (ValueError, OverflowError):
        return None


def in_text(text: str | None) -> str | None:
    for pattern in IN_TEXT:
        for found in pattern.findall(text or ""):
            if day_of(found):
                return found
    return None


class _Elements(HTMLParser):
    """What a date may stand in: JSON-LD scripts, meta elements, the text of elements of known class or id, ``time``, and all text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.scripts: list[str] = []
        self.meta: dict[str, str] = {}
        self.times: list[str] = []
        self.of: dict[tuple[str, str], list[list[str]]] = {s: [] for s in SELECTORS}
        self.text: list[str] = []
        self.size = 0
        #: open elements, and the texts that each collects
        self.open: list[tuple[str, list[list[str]]]] = []
        self.names: dict[str, int] = {}
        self.collecting: list[list[str]] = []
        self.raw: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        said = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            for key in ("name", "property"):
                name = said.get(key, "").lower()
                if name in META_NAMES and said.get("content"):
                    self.meta.setdefault(f"{key} {name}", said["content"])
        elif tag == "time" and said.get("datetime"):
            self.times.append(said["datetime"])
        if tag in ("script", "style"):
            self.raw = []
            if tag == "script" and said.get("type", "").strip().lower() == "application/ld+json":
                self.scripts.append("")
                self.raw.append("json")
            return
        if tag in VOID:
            return
        own = []
        classes = said.get("class", "").lower().split()
        for kind, name in SELECTORS:
            if name.lower() in classes if kind == "class" else said.get("id") == name:
                part: list[str] = []
                self.of[kind, name].append(part)
                own.append(part)
        self.open.append((tag, own))
        self.names[tag] = self.names.get(tag, 0) + 1
        self.collecting += own

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = None
            return
        if self.names.get(tag):
            while True:
                name, own = self.open.pop()
                self.names[name] -= 1
                for _ in own:
                    self.collecting.pop()
                if name == tag:
                    return

    def handle_data(self, data):
        if self.raw is not None:
            if self.raw:
                self.scripts[-1] += data
            return
        for part in self.collecting:
            part.append(data)
        if self.size < 4 * START:
            self.text.append(data)
            self.size += len(data)


def _in_json(value, name: str) -> str | None:
    """The first text of a name, wherever it stands."""
    todo = [value]
    while todo:
        one = todo.pop()
        if isinstance(one, dict):
            if isinstance(one.get(name), str) and one[name]:
                return one[name]
            todo += list(one.values())[::-1]
        elif isinstance(one, list):
            todo += one[::-1]
    return None


def _candidates(page: str):
    walk = _Elements()
    walk.feed(page)
    walk.close()
    for script in walk.scripts:
        try:
            held = json.loads(script)
            yield from (_in_json(held, name) for name in IN_JSON)
        except ValueError:
            yield from (m[1] for name in IN_JSON if (m := IN_JSON[name].search(script)))
    for name in META_NAMES:
        yield walk.meta.get(f"name {name}") or walk.meta.get(f"property {name}")
    for selector in SELECTORS:
        yield from (in_text(" ".join("".join(part).split())) for part in walk.of[selector])
    yield from walk.times
    yield in_text(" ".join(" ".join(walk.text).split())[:START])


def publish_day(page: str | None, url: str | None, published: str | None, modified: float | None, snippet: str | None) -> str | None:
    """yyyyMMdd of the first source that has a day."""
    found = IN_URL.search(unquote(url or ""))
    first = day_of(found[0] if found else None) or day_of(published)
    if first:
        return first
    for said in _candidates(page or ""):
        if day := day_of(said):
            return day
    if modified is not None and not pd.isna(modified) and 0 < modified < 253_402_300_800_000:
        return datetime.datetime.fromtimestamp(modified / 1000, datetime.UTC).strftime("%Y%m%d")
    return day_of(in_text(snippet))


def document_date(page: Column, url: Column, published: Column, modified: Column, snippet: Column, fallback: str) -> Column:
    """Publish date of a page; ``modified`` is its Last-Modified header in milliseconds. The walk needs Python, in Arrow batches."""

    @F.pandas_udf("string")
    def days(pages: pd.Series, urls: pd.Series, said: pd.Series, times: pd.Series, snippets: pd.Series) -> pd.Series:
        return pd.Series([publish_day(*row) or fallback for row in zip(pages, urls, said, times, snippets, strict=True)], dtype=object)

    return days(page, url, published, modified.cast("double"), snippet)
