"""What a reader of the queries found: ties, and forms that take no more than the whole job needs."""

import contextlib
import gc
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from palimpsest.operators import changes, chunking, mapping, reports, retrieval, similar, vectorlists
from palimpsest.operators.postings import Index
from palimpsest.plans import mapped


def test_lines_at_one_position_keep_the_order_of_the_file(spark, tmp_path):
    """Two lines of one order at the same position differ by supplier: the first written is kept, wherever it is read."""
    rows = [(k, 1, 100 + k % 7, s) for k in range(400) for s in ((1, 2) if k % 2 else (2, 1))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = mapped.per_doc_cap(spark, str(tmp_path)).collect()
    assert {(r.l_orderkey, r.doc) for r in found} == {(k, 1 if k % 2 else 2) for k in range(400)}
    assert len(found) == 400


@pytest.mark.parametrize("few", [1000, 5])
def test_all_points_compared_equal_plain_scores(spark, monkeypatch, few):
    """Few queries and many, vectors of two widths, null, empty and zero ones, and a third of all points at one place."""
    monkeypatch.setattr(vectorlists, "FEW", few)
    monkeypatch.setattr(vectorlists, "POINT_BLOCK", 90)
    monkeypatch.setattr(vectorlists, "QUERY_BLOCK", 7)
    draw = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 2.0] if i % 3 == 0 else draw.normal(size=3).tolist() if i % 7 else draw.normal(size=2).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "point_id long, embedding array<float>")
    asked = points.filter("point_id % 15 = 0 or point_id > 280").withColumnRenamed("point_id", "query_id")
    held = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and any(v)}
    want = set()
    for i in (r.query_id for r in asked.collect()):
        if i in held:
            close = [(-round(float(held[i] @ v / np.sqrt(held[i] @ held[i]) / np.sqrt(v @ v)), 6), j) for j, v in held.items() if len(v) == len(held[i])]
            want |= {(i, j, -s, rank + 1) for rank, (s, j) in enumerate(sorted(close)[:10])}
    found = retrieval.dense_topk(asked, points, 10).collect()
    assert {(r.query_id, r.point_id, r.score, r.rank) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("few", [1000, 2])
def test_rows_of_words_are_added(spark, monkeypatch, few):
    """A search without an index takes each word of a text by itself, and finds what grouped counts give."""
    monkeypatch.setattr(retrieval, "FEW", few)
    texts = spark.createDataFrame([(i, " ".join(f"w{j % (i % 5 + 2)}" for j in range(i + 3))) for i in range(60)] + [(60, None), (61, " ")], "point_id long, text string")
    asked = retrieval.tokens(texts.filter("point_id % 20 = 0").withColumnRenamed("point_id", "query_id"), "query_id", "text").withColumnRenamed("n", "query_n")
    whole = retrieval.sparse_topk(asked, Index.build(retrieval.tokens(texts, "point_id", "text")), 10)
    parts = retrieval.sparse_topk(asked, retrieval.occurrences(texts, "point_id", "text"), 10)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 30


def test_words_of_a_chunk_do_not_meet_the_products(spark):
    """Whether a chunk applies is told once for its feature; the join with products carries no texts."""
    features = spark.createDataFrame([(p, "label", "x", "text") for p in range(40)], "product_id long, feature string, value string, unit string")
    chunks = spark.createDataFrame([("label", 1, 1, ["warning", "y"], None), ("label", 2, 2, ["z"], "3")], "feature string, point_id long, pos int, words array<string>, required_value string")
    items = mapping.mapped_items(features, chunks)
    assert "words" not in items.columns
    assert {(r.point_id, r.applies) for r in items.collect()} == {(1, True), (2, False)} and items.count() == 80


def _plain_matches(rows, least):
    pairs, chosen = set(), set()
    for key in {r[0] for r in rows} - {None}:
        bags = [(i, side, set(words)) for k, i, side, words in sorted(rows, key=lambda r: r[1]) if k == key and words is not None]
        taken = set()
        for new, side, a in bags:
            found = sorted((-len(a & b) / len(a | b), old) for old, other, b in bags if side == 0 and other == 1 and len(a & b) / len(a | b) >= least and a & b)
            pairs |= {(key, new, old, -s) for s, old in found}
            free = [(s, old) for s, old in found if old not in taken]
            if free:
                taken.add(free[0][1])
                chosen.add((key, new, free[0][1], -free[0][0]))
    return pairs, chosen


@pytest.mark.parametrize("listed", [1, 3])
def test_blocks_are_compared_without_rows_for_shared_words(spark, monkeypatch, listed):
    """Many small blocks, copies, near copies, ties, and lists that end too early, against all pairs; only found pairs are rows."""
    monkeypatch.setattr(similar, "BLOCK_WORDS", 150)
    monkeypatch.setattr(similar, "ROWS", 7)
    monkeypatch.setattr(similar, "COLUMNS", 11)
    draw = np.random.default_rng(listed)
    rows = []
    for i in range(240):
        size = int(draw.integers(1, 25))
        words = [f"w{int(40 * draw.random() ** 2)}" for _ in range(size)] if i % 3 else ["same", "words", "of", "many"] + (["near"] if i % 2 else []) * (i % 9 == 0)
        rows.append((("a", "a", "a", "b")[i % 4 if i < 200 else 3], i, int(draw.integers(0, 2)), words))
    rows += [(None, 300, 0, ["same"]), ("a", 301, 1, None), ("c", 302, 0, ["alone"])]
    frame = spark.createDataFrame(rows, "k string, id long, side int, words array<string>")
    new, old = frame.filter("side = 0"), frame.filter("side = 1")
    pairs, _ = _plain_matches(rows, 0.3)
    found = similar.similar_pairs(new, old, "k", "id", "words", 0.3).collect()
    assert {tuple(r) for r in found} == pairs and len(found) == len(pairs)
    _, chosen = _plain_matches(rows, 0.1)
    matched = similar.greedy_similar(new, old, "k", "id", "words", 0.1, listed=listed).collect()
    assert {tuple(r) for r in matched} == chosen and len(matched) == len(chosen)


def test_disk_of_matches_does_not_grow_with_pairs_of_blocks(spark, monkeypatch):
    """A source of a dozen blocks a side: after no write does the disk hold more than four times the words, nor are words left at the end."""
    monkeypatch.setattr(similar, "BLOCK_WORDS", 8000)
    monkeypatch.setattr(similar, "WAVE_WORDS", 0, raising=False)
    draw = np.random.default_rng(7)
    texts = [[f"w{j}" for j in draw.choice(20_000, 200, replace=False)] for _ in range(500)]
    rows = [("a", i, i % 2, texts[i // 2]) for i in range(1000)] + [("b", 1000, 0, ["x"]), ("b", 1001, 1, ["x"])]
    for i in range(0, 1000, 5):
        rows[i] = (*rows[i][:3], texts[i // 7][: 100 + i % 90])
    frame = spark.createDataFrame(rows, "k string, id long, side int, words array<string>").localCheckpoint()
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [spark.sparkContext.getConf().get("spark.checkpoint.dir"), *(local[i].getPath() for i in range(len(local)))]

    def used():
        total = 0
        for f in (f for folder in folders for f in Path(folder).rglob("*")):
            with contextlib.suppress(FileNotFoundError):
                total += f.stat().st_size if f.is_file() else 0
        return total

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    held, most, write = used(), [], DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        most.append(used() - held)
        time.sleep(0.2)  # shuffle files go a moment after they are given up

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    words = 8 * sum(len(set(r[3])) for r in rows)
    matched = similar.greedy_similar(frame.filter("side = 0"), frame.filter("side = 1"), "k", "id", "words", 0.1, listed=1000).collect()
    assert {tuple(r) for r in matched} == _plain_matches(rows, 0.1)[1] and len(matched) > 300
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    assert max(most) < 4 * words
    assert used() - held < words / 2


def test_a_batch_is_cut_and_sent_in_parts(spark, monkeypatch):
    """Chunkers and models hold a bounded part of a batch: 40 texts are at no time one list."""
    held = []
    batch = pa.RecordBatch.from_pydict({"body": ["x" * 50] * 7 + [None, "y" * 500, ""]})
    monkeypatch.setattr(chunking, "BYTES", 100)
    some = [s.column("body").to_pylist() for s in chunking.slices(batch, "body")]
    assert [t for s in some for t in s] == batch.column("body").to_pylist() and max(map(len, some)) <= 4 and min(map(len, some)) >= 1
    frames = retrieval.parts(iter([pd.DataFrame({"i": range(600)}), pd.DataFrame({"i": []})]))
    for frame in frames:
        held += frame.i.tolist()
        assert len(frame) <= retrieval.PART
    assert held == list(range(600))


def test_weights_of_repeated_words_and_rows(spark):
    """Buckets are counted in the text's own row; rows of one id are added, texts without words drop out."""
    texts = [(1, "B a b"), (1, "a c"), (2, None), (3, " "), (4, "x")]
    found = retrieval.sparse_vector(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 1)
    assert {(r.doc_id, tuple(map(tuple, r.sparse))) for r in found.collect()} == {(1, ((0, 5.0),)), (4, ((0, 1.0),))}
    wide = retrieval.sparse_vector(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    rows = {r.doc_id: r.sparse for r in wide.collect()}
    assert sorted(x.value for x in rows[1]) == [1.0, 2.0, 2.0] and [x["index"] for x in rows[1]] == sorted(x["index"] for x in rows[1])
    assert "token" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_small_keys_are_matched_without_a_group_each(spark):
    """A task goes through all its keys in one stream: no call of Python for each key."""
    rows = [(k, n, o, 1.0 - o / 10) for k in range(50) for n in range(3) for o in range(3)]
    found = changes.greedy_matches(spark.createDataFrame(rows, "k long, new_id long, old_id long, score double"), "k")
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[:3] for r in found.collect()} == {(k, n, n) for k in range(50) for n in range(3)}


def test_sections_of_reports_are_grouped_where_rows_are_dealt(spark):
    """Rows are dealt by key before they are grouped, so no task groups a whole split or joins sorted sides; keys of no report fall out."""
    keys = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 0, "a"), (3, 0, "c"), (None, 0, "d")], "k long, pos int, line string")
    stamped = rows.select("k", F.struct(F.lit("x").alias("s"), "pos").alias("pos"), F.upper("line").alias("line"))
    out = reports.report_sections(keys, "k", [("x", "list", "t", rows, "none"), ("y", "links", "u", rows.limit(0), ""), ("z", "list", "v", stamped, "")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.rindex("collect_list") < plan.index("REPARTITION_BY_NUM")
    assert out.schema["k"].dataType.simpleString() == "int" and out.columns == ["k", "place", "section_id", "kind", "title", "content"]
    found = {(r["k"], r["place"]): (r["section_id"], r["kind"], r["title"], r["content"]) for r in out.collect()}
    empty = {(k, 1): ("y", "links", "u", []) for k in (1, 2, None)}
    assert found == empty | {(k, 0): ("x", "list", "t", ["none"]) for k in (2, None)} | {(k, 2): ("z", "list", "v", []) for k in (2, None)} | {(1, 0): ("x", "list", "t", ["a", "a", "b"]), (1, 2): ("z", "list", "v", ["A", "A", "B"])}
