"""Dates of elements, languages by profile, encoders of both kinds, merged weights and structures, against plain versions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import dates, jsonx, languages
from palimpsest.operators import assembly, checks, retrieval

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("page", "day"),
    [
        ("<script type='application/ld+json'>{\"a\": [{\"x\": 1}, {\"datePublished\": \"2022-01-05T10:00\"}], \"dateModified\": \"2023-02-01\"}</script>", "20220105"),
        ('<script id=a TYPE="application/LD+json">{"dateModified": "2023-02-01"</script>', "20230201"),
        ('<script type="application/ld+json">{"datePublished": "not yet"}</script><meta content="2021-03-04" name="pubdate">', "20210304"),
        ('<meta name="date" content="2020-02-02"><meta property="article:published_time" content="2021-03-04T01:02">', "20210304"),
        ("<META CONTENT=2020.2.9 PROPERTY='og:updated_time'>", "20200209"),
        ('<meta name="date" content="2021-02-30"><p id="date">2019/05/06</p>', "20190506"),
        ('<div class="big published"><b>2020</b>-01-02 is no date in one word, 2018-04-05 is</div>', "20200102"),
        ('<span class="reg-date">2021년 3월 7일</span>', "20210307"),
        ('<div class="update">2011-01-01</div><i class="time">2012-01-01', "20120101"),
        ("<p class=date>none</p><p class=date>2013.01.01</p>", "20130101"),
        ("<div class='date'><p>a</div>2014-01-01</p>", "20140101"),
        ("<time>x</time><time datetime='2016-07-08'>y</time><p>2015-01-01</p>", "20160708"),
        ("<style>.a{x:2015-01-01}</style><script>'2015-01-02'</script><!-- 2015-01-03 --><p>2015-01-04</p>", "20150104"),
        ("<p>" + "word " * 700 + "2015-01-04</p>", "19990101"),
        ("<<<meta <div class='date' 2015-01-01", "20150101"),
        ("", "19990101"),
        (None, "19990101"),
    ],
)
def test_dates_of_elements(page, day):
    assert (dates.publish_day(page, None, None, None, None) or "19990101") == day


def test_order_of_the_other_sources():
    page = "<p>2015-01-04</p>"
    assert dates.publish_day(page, "http://a/2020%2D01%2D02/x", "2019-01-01", 1.0, "2018-01-01") == "20200102"
    assert dates.publish_day(page, "http://a/20201399/x", "2019. 1. 1", 1.0, None) == "20190101"
    assert dates.publish_day("<p>no</p>", None, "no date", 1_600_000_000_000.0, "2018-01-01") == "20200913"
    assert dates.publish_day("<p>no</p>", None, None, float("nan"), "seen 2018-01-01") == "20180101"
    assert dates.publish_day(None, None, None, None, None) is None


def test_attributes_in_any_order():
    """Every order and kind of quotes gives the same."""
    for parts in itertools.permutations(["name={0}pubdate{0}", "content={0}2021-03-04{0}", "lang={0}en{0}", "x"]):
        for quote in ("'", '"', ""):
            assert dates.publish_day(f"<meta {' '.join(parts).format(quote)}>", None, None, None, None) == "20210304"


def test_dates_of_all_pages(spark):
    """The table's pages hold no date: those that are put before them decide, or the URL."""
    import pandas as pd

    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r["day"] for r in catalog.queries()["page_dom_dates"](spark, DATA).collect()}
    assert set(found) == set(pages.page_id) and all(re.fullmatch(r"\d{8}", d) for d in found.values()) and len(set(found.values())) > 80


def test_languages_of_texts_held_out(spark):
    """Trained on three quarters of the table, tried on the rest; random labels are no better than chance."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("length(text) > 60").select("doc_id", "text", "lang")
    profiles = languages.train(docs.filter("doc_id % 4 <> 0"), "text", "lang", 400)
    assert all(len(p) <= languages.GRAMS for p in profiles.values()) and set(profiles) == {"en", "fr", "de", "es"}
    rows = docs.filter("doc_id % 4 = 0").select("lang", languages.languages(F.col("text"), profiles).alias("l")).collect()
    hits = [r["lang"] == r["l"]["top"][0]["language"] for r in rows]
    sure = [h for h, r in zip(hits, rows, strict=True) if r["l"]["reliable"]]
    assert sum(hits) > 0.95 * len(rows) and len(sure) > 0.9 * len(rows) and sum(sure) > 0.97 * len(sure)
    assert all(len(r["l"]["top"]) == 3 and sum(x["share"] for x in r["l"]["top"]) <= 1.0002 for r in rows)


def test_sample_of_a_language_moves_no_other_text(spark):
    """The profile of 4,000 texts, some of them twice, is that of the texts of least hash, found by hashes in parts."""
    frame = spark.range(4000).select(F.lit("aa").alias("lang"), F.concat(F.lit("wort "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("t"))
    frame = frame.union(frame.limit(50))
    want = languages.Counter()
    for r in frame.distinct().orderBy(F.xxhash64("t"), "t").limit(30).collect():
        want += languages.grams(r["t"])
    profile = languages.train(frame, "t", "lang", 30)["aa"]
    total = sum(want.values())
    assert profile == {g: languages.math.log(n / total) for g, n in want.items()}
    assert languages.PARTS > 1


def test_texts_without_a_language(spark):
    profiles = {"aa": {" la": -1.0, "lal": -2.0}, "bb": {" ke": -1.0}}
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 56"), (4, "la"), (5, "lala lala lala lala")], "i int, t string")
    found = {r["i"]: r["l"] for r in frame.select("i", languages.languages(F.col("t"), profiles).alias("l")).collect()}
    assert all(found[i]["top"] == [] and not found[i]["reliable"] for i in (1, 2, 3, 4)) and found[5]["top"][0]["language"] == "aa" and found[5]["reliable"]
    assert languages.ranked("lala lala lala lala", {}) == []


def test_both_kinds_of_vectors_from_one_call(spark):
    def model():
        seen = []

        def encode(texts):
            assert [len(t) for t in texts] == sorted(len(t) for t in texts) and len(texts) <= 3
            seen.append(len(texts))
            return [[float(len(t.split())), float(len(seen))] for t in texts], [{"a": 1.0} for _ in texts]

        return encode

    rows = spark.createDataFrame([(i, "w " * (7 - i) + "x") for i in range(7)] + [(7, None), (8, " ")], "i int, t string").coalesce(1)
    found = {r["i"]: r for r in retrieval.encoded(rows, "t", model, 3, 5).collect()}
    assert [found[i]["embedding"] for i in (7, 8)] == [None, None] and found[0]["embedding"][0] == 5.0 and found[6]["embedding"] == [2.0, 1.0]
    assert found[3]["lexical"] == {"a": 1.0} and found[7]["lexical"] is None
    alone = retrieval.encoded(rows, "t", lambda: lambda texts: ([[3.0, 4.0] for _ in texts], None), 2).filter("i = 1").first()
    assert alone["embedding"] == pytest.approx([0.6, 0.8]) and alone["lexical"] is None


def test_merged_weights(spark):
    row = spark.range(1).select(retrieval.merged_weights(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.lit(None), F.create_map(F.lit("b"), F.lit(0.5))).alias("m"), retrieval.merged_weights(F.lit(None), F.lit(None)).alias("n")).first()
    assert row["m"] == {"a": 1.0, "b": 2.5} and row["n"] == {}


ANSWERS = [
    '```json\n{"markdown_content": "# A\\nx", "reference_blocks": [{"section_ref": "1", "start_line": 0, "end_line": 2, "keywords": ["k"]}], "metadata": {"title": "", "authority": "EU"}, "entities": [{"name": "n", "type": "t", "context": "first"}], "tables": [{"caption": "c", "headers": ["h"], "rows": [["1"]]}]}\n```',
    '{"markdown_content": "y", "reference_blocks": [{"section_ref": "2", "start_line": 0, "end_line": 1, "keywords": []}], "metadata": {"title": "T", "authority": "US"}, "entities": [{"name": "n", "type": "t", "context": "second"}, {"name": "m", "type": "t", "context": "z"}], "tables": [{"caption": "c", "headers": ["h"], "rows": [["2"], ["3"]]}, {"caption": "", "headers": ["h"], "rows": [["4"]]}]}',
    "no JSON at all",
    '{"markdown_content": "w", "tables": [{"caption": "", "headers": ["h"], "rows": [["5"]]}, {"caption": "c", "headers": ["g"], "rows": null}]}',
]


@pytest.mark.parametrize("parts", [1, 4])
def test_one_structure_of_a_batch(spark, parts):
    rows = [("b", i, a, i / 10, 10) for i, a in enumerate(ANSWERS)] + [("b", 9, None, 0.4, 1), ("e", 0, ANSWERS[1], 1.0, 5)]
    random.Random(parts).shuffle(rows)
    pages = spark.createDataFrame(rows, "batch string, at int, said string, complexity double, tokens int").repartition(parts)
    pages = pages.withColumn("structure", F.when(F.col("said").isNotNull(), jsonx.page_structure(F.col("said"))))
    found = {r["batch"]: r for r in assembly.unified_structures(pages, ["batch"], "at").collect()}
    s = found["b"]["structure"]
    assert (found["b"]["pages"], found["b"]["tokens"], round(found["b"]["complexity"], 6)) == (5, 41, 0.2) and s["page_num"] == 1
    assert s["markdown_content"] == "# A\nx\n\ny\n\nno JSON at all\n\nw"
    lines = s["markdown_content"].split("\n")
    assert [(b["section_ref"], b["start_line"], b["end_line"], lines[b["start_line"] : b["end_line"]]) for b in s["reference_blocks"]] == [("1", 0, 2, ["# A", "x"]), ("2", 3, 4, ["y"])]
    assert s["metadata"]["title"] == "T" and s["metadata"]["authority"] == "EU" and s["metadata"]["language"] is None
    assert [(e["name"], e["context"]) for e in s["entities"]] == [("n", "first"), ("m", "z")]
    assert [(t["caption"], t["headers"], t["rows"]) for t in s["tables"]] == [("c", ["h"], [["1"], ["2"], ["3"]]), ("", ["h"], [["4"]]), ("", ["h"], [["5"]]), ("c", ["g"], [])]
    assert found["e"]["structure"]["markdown_content"] == "y"


def test_rules_of_reading(spark):
    rows = [("Reduce the nicotine of the liquid", ["liquid"], ["reduce nicotine in liquid"]), ("Reduce the nicotine of the liquid", ["device"], None), ("nicotine matters", ["none"], []), ("change the battery", ["device"], ["submit a paper"]), (None, [], None)]
    frame = spark.createDataFrame(rows, "said string, kinds array<string>, history array<string>")
    rules = checks.strategy_fit(F.col("said"), F.col("kinds"), F.col("history"))
    assert [tuple(r) for r in frame.select(*(c.alias(k) for k, c in rules.items())).collect()] == [(True, True, True), (False, True, True), (True, False, True), (True, True, False), (True, False, True)]
    made = spark.createDataFrame([("a long reason about tar and cost of it", ["tar limit", "cost"], "High", 3, 1), ("tar cost", ["tar"], "low", 5, 1), ("a long reason about something else here", ["tar"], None, 5, 5)], "why string, sources array<string>, hard string, urgency int, cost int")
    rules = checks.impact_fit(*(F.col(c) for c in made.columns))
    assert [tuple(r) for r in made.select(*(c.alias(k) for k, c in rules.items())).collect()] == [(True, False), (False, False), (False, True)]
    said = spark.createDataFrame([("limit", "tar of 10 mg", "no more than 10 mg of tar"), ("other", "tar", "tar"), ("limit", "tar of 12 mg", "10 mg of tar"), (None, None, None)], "kind string, condition string, text string")
    rule = checks.grounded_mapping(F.col("kind"), F.col("condition"), F.col("text"), ("limit",))["M1"]
    assert [r[0] for r in said.select(rule).collect()] == [True, False, False, False]
