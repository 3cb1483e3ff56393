"""No operator may fail on nulls, empty or long texts, repeated rows, empty tables or clashing columns."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, linededup, mixing, neardup, pages, private, quality, suffix, tokens, toxicity

BENCH = "item_id long, text string"


def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda s, d: mixing.mixed(d)[0].select("doc_id", "_kept"),
    "quality": lambda s, d: quality.quality_rules(d, min_docs=1),
    "lines": lambda s, d: linededup.dedup_lines(d),
    "suffix": lambda s, d: suffix.remove_repeats(d),
    "decontaminate": lambda s, d: decontaminate.flagged(d, s.createDataFrame([(1, None), (2, ""), (3, "a b")], BENCH)),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "tokens": lambda s, d: tokens.token_output(d),
    "private": lambda s, d: private.replace_private(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, odd, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert len(rows) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows(spark, odd, name):
    twice = odd.filter("doc_id is not null and doc_id <> 5").union(odd.filter("doc_id = 3"))
    assert OPERATORS[name](spark, twice).count() >= twice.select("doc_id").distinct().count()


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (None, "u", "<article><p>A b c.</p>"), (5, "u", "<" * 50), (6, "u", "<div>" * 3000 + "x")]
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert out.count() == 6
    assert out.filter("page_id = 1").first()["text"] == ""
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokens_of_rows_without_an_id_come_first_in_order_of_text(spark):
    rows = [(2, "b c"), (None, "z"), (None, None), (1, "x y"), (None, "a"), (1, "k")]
    found = tokens.token_output(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    tool = tokens.encoder(tokens.tokenizer_path())
    texts = [None, "a", "z", "k", "x y", "b c"]
    want = [len(x) // 4 + 1 for x in tool.encode([t or "" for t in texts])]
    assert [r["doc_id"] for r in found] == [None, None, None, 1, 1, 2]
    assert [r["n_tokens"] for r in found] == want
    assert [r["start"] for r in found] == [sum(want[:i]) for i in range(len(want))]
