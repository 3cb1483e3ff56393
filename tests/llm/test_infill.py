"""Fill-in-the-middle against a plain version that finds lines by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import infill
from tests.llm.conftest import prose


def lines(text):
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append(text[at:end])
        at = end
    return out


def plain(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = lines(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


HARD = ["\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb\rc\x0b\x0cd e\u0085f\n", "é漢字\U0001f600\n\U0001f600x\n", "has <S> inside\nb", "<P", "x<\nP>\n<", "<M>", "\0\n\0", "é\n" * 9, "line\n" * 20_000 + "end", "no break " * 30_000]


def check(frame, rows, **args):
    found = infill.fill_in_middle(frame, **args).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((d, *plain(d, t, **{k.replace("spm_rate", "spm"): v for k, v in args.items()})) for d, t in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in found), key=repr) == want
    assert sorted((r["doc_id"] or -1, r["back"]) for r in found) == sorted((d or -1, t or "") for d, t in rows)


def test_odd_rows(spark, odd, odd_rows):
    check(odd, [(r[0], r[1]) for r in odd_rows])


def test_hard_texts(make):
    texts = HARD + ["\n".join(prose(i, 12) for i in range(i)) for i in range(40)]
    check(make(texts), list(enumerate(texts)))
    check(make(texts), list(enumerate(texts)), seed=11, rate=60, spm_rate=20)


def test_repeated_rows_and_other_columns(spark):
    rows = [(4, "a\nb\nc\n", "n"), (4, "a\nb\nc\n", "n"), (4, "other\n", "x"), (None, "k\nl", "n"), (None, None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, form string").withColumn("output", F.lit(1)), [r[:2] for r in rows])


def test_empty_table(none):
    assert infill.fill_in_middle(none).collect() == []


def test_other_units_and_marks(spark):
    texts = ["one two  three\tfour", "<fim> stays? ", "plain"]
    marks = ("<|pre|>", "␞suf", "[mid]")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = infill.fill_in_middle(frame, pattern=r"\S+\s*", marks=marks).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).orderBy("doc_id").collect()
    assert [r["back"] for r in rows] == texts and [r["n"] for r in rows] == [4, 2, 1]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "b", "c"), ("<<", "a", "b")])
def test_marks_that_could_be_mistaken(none, marks):
    with pytest.raises(ValueError):
        infill.fill_in_middle(none, marks=marks)


def test_both_orders_and_all_places(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    counts = {r["form"]: r["count"] for r in infill.fill_in_middle(docs).groupBy("form").count().collect()}
    assert set(counts) == {"spm", "psm"} and min(counts.values()) > 900
    assert infill.fill_in_middle(docs).select("prefix_chars", "middle_chars").distinct().count() == 10


