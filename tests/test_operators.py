"""Small cases: nulls, ties, empty inputs, and invariants."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import jsonx, scores, text
from palimpsest.functions.html import plain_text
from palimpsest.operators import changes, chunking, frames, retrieval, versions


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_section_keys(spark):
    rows = [("§ 1160.5(a)",), ("1160.5",), ("Page 3",), ("",), (None,), ("§Unknown",)]
    assert values(spark, text.section_key(F.col("s")), rows, "s string") == ["1160.5", "1160.5", "Page3", "", None, "Unknown"]


def test_keywords_are_unicode(spark):
    assert values(spark, text.keywords(F.col("s")), [("Limit 18mg 니코틴18 Alpha Beta Alpha 3 4",)], "s string") == [["18mg", "니코틴18", "3", "Limit", "Alpha"]]


def test_confidence_bounds(spark):
    rows = [(0.4,), (0.5,), (0.7,), (0.8,), (0.39,), (None,)]
    assert values(spark, scores.confidence_level(F.col("c")), rows, "c double") == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "UNCERTAIN", "UNCERTAIN"]
    assert values(spark, scores.adjusted_confidence(F.col("c"), F.lit(None), F.lit(True)), [(0.95,), (None,)], "c double") == [1.0, 0.6]


def test_truthy_skips_zero(spark):
    assert values(spark, scores.truthy(F.col("a"), F.col("b")), [(0.0, 0.7), (None, None), (0.3, 0.9)], "a double, b double") == [0.7, 0.0, 0.3]


def test_months_left(spark):
    rows = [("2024-13-01",), ("",), ("2024-03-01",), ("2020-01-01",), (None,)]
    assert values(spark, scores.months_left(F.col("e"), F.lit("2024-01-01").cast("date")), rows, "e string") == [None, None, 2.0, 0.0, None]


def test_uri_parts(spark):
    rows = [("arn:aws:s3:::b/k/x.pdf",), ("s3://b",), ("s3://b/k/",), ("k/x",)]
    bucket, key = text.uri_parts(F.col("u"))
    found = spark.createDataFrame(rows, "u string").select(bucket.alias("b"), key.alias("k")).collect()
    assert [tuple(r) for r in found] == [("b", "k/x.pdf"), ("b", ""), ("b", "k/"), (None, "k/x")]


def test_last_of_equal_keys(spark):
    rows = [(["a: 1", "b: x: y", "none", "a: 2"],)]
    assert values(spark, jsonx.key_values(F.col("k")), rows, "k array<string>") == [{"a": "2", "b": "x: y"}]


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 4, "b"), (1, 5, "c")], "k int, t int, v string")
    found = {(r["k"], r["t"]): r["found_v"] for r in versions.as_of(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert found == {(1, 5): "b", (1, 1): None, (2, 9): None}
    loose = {(r["k"], r["t"]): r["found_v"] for r in versions.as_of(left, right, ["k"], "t", "t", ["v"], strict=False).collect()}
    assert loose == {(1, 5): "c", (1, 1): "a", (2, 9): None}


def test_best_wins_is_stable(spark):
    df = spark.createDataFrame([("a", 0.5, 2), ("a", 0.5, 1), ("b", None, 3), ("", 0.9, 4)], "s string, c double, pos int")
    assert {(r["s"], r["pos"]) for r in frames.best_wins(df, ["s"], "c", "pos").collect()} == {("a", 1), ("b", 3)}


def test_greedy_is_one_to_one(spark):
    c = spark.createDataFrame([("p", 1, 7, 0.5), ("p", 1, 8, 0.5), ("p", 2, 7, 0.9), ("p", 3, 7, 0.4)], "k string, new_id long, old_id long, score double")
    assert sorted((r["new_id"], r["old_id"]) for r in changes.greedy_matches(c, "k").collect()) == [(1, 7)]


def test_fusion_bounds(spark):
    d = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, point_id int, rank int")
    s = spark.createDataFrame([(1, 11, 1)], "query_id int, point_id int, rank int")
    rows = retrieval.fuse(d, s, 5, 1.7).collect()
    assert [r["point_id"] for r in sorted(rows, key=lambda r: -r["score"])] == [10, 11]
    with pytest.raises(ValueError):
        retrieval.hybrid_search(d, s, d, s, strategy="other")


def test_headers():
    found = chunking.split_headers("intro\n# A\none\n## B\ntwo\n```\n# no\n```\n# C\nthree")
    assert [(c["hierarchy"], c["body"]) for c in found] == [([], "intro"), (["A"], "one"), (["A", "B"], "two\n```\n# no\n```"), (["C"], "three")]
    assert chunking.split_headers(None) == []


@given(st.lists(st.text("ab \n", max_size=30), max_size=8))
def test_packing_keeps_lines(parts):
    body = "\n".join(parts)
    packed = chunking.pack_lines(body, 20)
    assert "\n".join(packed).split("\n") == ([x for x in body.split("\n") if x.strip()] or [""])


def test_long_texts_overlap():
    body = " ".join(f"w{i}" for i in range(500))
    parts = chunking.split_long(body, 100, 200, 50)
    assert parts[0].split()[-50:] == parts[1].split()[:50] and parts[-1].split()[-1] == "w499"


def test_plain_text():
    assert plain_text("<p>a&amp;b<script>x</script></p>\n<b>c</b>") == "a&b c"
    assert plain_text(None) == ""
