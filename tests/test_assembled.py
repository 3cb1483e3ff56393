"""Operators without SQL, and writers, against plain versions on small inputs."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import ingest, jsonx, text
from palimpsest.operators import assembly, chunking, frames, history, reports, retrieval, versions
from palimpsest.operators.workflow import Workflow
from palimpsest.plans import runs
from palimpsest.sources import files, store

DATA = "/root/testdata/sf0.001"


def test_chunks_of_all_documents(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    want = []
    for source, group in docs.groupby("source"):
        n, lang = 0, group.lang.iloc[0]
        for doc, body, tongue, src in zip(group.doc_id, group.text, group.lang, group.source, strict=True):
            for part in [p for c in chunking.split_headers(body) for p in chunking.split_long(c["body"])]:
                n += 1
                ref = "th" if "th" in part else None
                want.append((source, doc, "text", f"{source}-Chunk{n:04d}", f"Page {doc}", ref, ref and f"{source}-{ref}", lang))
            if doc % 3 == 0:
                n += 1
                want.append((source, doc, "table", f"{source}-Table{n:04d}", "of it" if doc % 2 == 0 else "Table 1", "th", f"{source}-th", lang))
                assert tongue and src
    rows = catalog.queries()["chunk_assembly"](spark, DATA).drop("body_md5").collect()
    key = lambda r: (r[0], r[1], r[3])
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)


def test_previous_crosses_runs(spark):
    ids = [("a", i) for i in (1, 5, 12, 13, 40)] + [("b", 7), (None, 3), (None, 30)]
    found = {(r["k"], r["i"]): r["previous"] for r in versions.previous(spark.createDataFrame(ids, "k string, i long"), ["k"], "i", 10).collect()}
    assert found == {("a", 1): None, ("a", 5): 1, ("a", 12): 5, ("a", 13): 12, ("a", 40): 13, ("b", 7): None, (None, 3): None, (None, 30): 3}


def test_a_later_filter_wins(spark):
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("x"), F.lit("3"))
    row = spark.range(1).select(retrieval.merged_filters(a, F.lit(None).cast("map<string,string>"), b).alias("m"), retrieval.merged_filters(a).alias("n")).first()
    assert row["m"] == {"x": "3", "y": "2"} and row["n"] == {"x": "1", "y": "2"}


def test_history_skips_runs_without_strategies(spark):
    rows = [(1, " a law ", ["p", None], ["x "]), (2, "b", [], []), (3, "c", [], ["x", "y"]), (4, "d", None, None)]
    kept = history.history_rows(spark.createDataFrame(rows, "run_id long, summary string, products array<string>, strategies array<string>"))
    assert {r["run_id"]: (r["text"], r["n_products"]) for r in kept.collect()} == {1: ("Regulation: a law\nProducts: p", 1), 3: ("Regulation: c\nProducts: (no mapped products)", 0)}
    asked = spark.createDataFrame([(9, "Regulation: c\nProducts: (no mapped products)")], "query_id long, text string")
    found = history.search_history(asked, kept)
    best = max(found.collect(), key=lambda r: r["score"])
    assert best["point_id"] == 3
    assert history.reused_strategies(found, kept).first()["strategies"] == ["x", "y"]


def test_answers_that_are_no_json(spark):
    said = [("```json\n{\"markdown_content\": \"m\", \"tables\": [{\"caption\": \"c\"}]}\n```",), ("plain",), (None,), ('{"entities": 5}',)]
    rows = [r["s"] for r in spark.createDataFrame(said, "t string").select(jsonx.page_structure(F.col("t")).alias("s")).collect()]
    assert [r["markdown_content"] for r in rows[:3]] == ["m", "plain", None]
    assert [len(r["tables"]) for r in rows[:3]] == [1, 0, 0] and rows[1]["entities"] == []


def test_languages_by_script(spark):
    rows = [("이 규정은 니코틴 함량을 제한한다 " * 3,), ("the law of the land and that " * 3,), ("short",), (None,), ("....." * 5,)]
    found = [r["s"] for r in spark.createDataFrame(rows, "t string").select(ingest.language_scores(F.col("t")).alias("s")).collect()]
    assert found[0][0]["language"] == "KO" and found[1][0]["language"] == "EN"
    assert found[2] is None and found[3] is None and found[4] == []


def test_templates_keep_braces(spark):
    row = spark.range(1).select(text.filled("{{a}} {x}", x=F.lit("{y}")).alias("t")).first()
    assert row["t"] == "{a} {y}"


def test_files(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", ".hidden.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 7)
    found = files.pdf_listing(spark, str(tmp_path))
    assert [(r["name"], r["length"]) for r in found.collect()] == [("B.PDF", 7), ("a.pdf", 7)]
    assert files.modified_since(found, date(2000, 1, 1)).count() == 2 and files.modified_since(found, date(2999, 1, 1)).count() == 0
    (tmp_path / "g.json").write_text('{"tar": "타르", "label": "라벨"}')
    assert {tuple(r) for r in files.glossary(spark, str(tmp_path / "g.json")).collect()} == {("tar", "타르"), ("label", "라벨")}
    assert files.glossary(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert files.glossary(spark, str(tmp_path / "bad.json")).count() == 0


def test_points_and_snapshots(spark, tmp_path):
    points = spark.createDataFrame([("a", [1.0, 2.0], [1]), ("b", [3.0, 4.0], [])], "text string, dense array<double>, sparse array<int>")
    files.write_points(points, str(tmp_path / "points"))
    n, some = files.verify_points(spark.read.parquet(str(tmp_path / "points")), 1)
    assert n == 2 and some.count() == 1 and some.first()["dense_size"] == 2
    files.snapshot(points.select("text"), str(tmp_path / "json"))
    assert {r["text"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {"a", "b"}


def test_tables_are_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    store.staged_write(spark.range(3), path)
    store.staged_write(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    name = "points_of_a_test"
    store.drop_table(spark, name)
    store.create_table(spark, name, "id long")
    spark.range(2).write.insertInto(name)
    store.create_table(spark, name, "id long")
    assert spark.table(name).count() == 2
    store.reset_table(spark, name)
    assert spark.table(name).count() == 0
    store.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_upload_uri_is_null_where_a_part_lacks(spark):
    row = spark.range(1).select(store.upload_uri(F.lit("b"), F.lit(""), F.lit(None), F.lit("x.pdf")).alias("a"), store.upload_uri(F.lit(""), F.lit("p"), F.lit("c"), F.lit("x")).alias("b")).first()
    assert row["a"] == "s3://b/x.pdf" and row["b"] is None


def test_batches_and_openings(spark):
    pages = spark.createDataFrame([("d", i, f"p{i}") for i in range(12)], "doc string, n int, body string")
    assert assembly.opening_text(pages, "doc", "n", "body", 10, 5).first()["opening"] == "p0\n\np"
    assert {r["batch"] for r in assembly.page_batches(pages, "doc", "n", 5).collect()} == {0, 1, 2}
    assert frames.capped(pages, ["doc"], [F.col("n").desc()], 2, "body", 2).count() == 2


def test_sections_without_rows_get_the_default(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "k int, pos int, line string")
    found = {(r["k"], r["section_id"]): r["content"] for r in reports.report_sections(keys, "k", [("x", "list", "t", rows, "none"), ("y", "list", "u", rows.limit(0), "")]).collect()}
    assert found == {(1, "x"): ["a", "b"], (2, "x"): ["none"], (1, "y"): [], (2, "y"): []}


def test_a_run_starts_where_it_must(spark, tmp_path):
    made = []

    def stage(name, before=None):
        def run(tables):
            made.append(name)
            return tables[before].withColumn(name, F.lit(len(made))) if before else tables["input"]

        return run

    flow = Workflow(spark, str(tmp_path / "flow"), {"a": stage("a"), "b": stage("b", "a"), "c": stage("c", "b")})
    inputs = {"input": spark.range(2)}
    assert flow.run(inputs)["c"].columns == ["id", "b", "c"] and made == ["a", "b", "c"]
    flow.run(inputs)
    assert flow.made == []
    flow.rerun(inputs, "b")
    assert flow.made == ["b", "c"]
    flow.run(inputs, start="c")
    assert flow.made == ["c"]
    flow.run(inputs, force=True)
    assert flow.made == ["a", "b", "c"]
    tried = []
    flow.validated_run(inputs, {"b": lambda tables: tried.append(1) or len(tried) > 5}, retries=2)
    assert len(tried) == 2 and flow.made == ["b", "c"]
    with pytest.raises(ValueError):
        flow.run(inputs, start="z")


def test_the_whole_run(spark, tmp_path):
    flow = runs.regulation_flow(spark, DATA, str(tmp_path / "run"))
    tables = flow.run({})
    assert flow.made == list(flow.stages)
    due = {r["d"] for r in tables["detect_changes"].filter("change_detected").select(F.expr(f"pos div {runs.LINES}").alias("d")).collect()}
    assert {r["doc_id"] for r in tables["embed"].collect()} == due
    features = {r["feature"] for r in tables["score_impact"].collect()}
    assert {(r["feature"], r["place"]) for r in tables["report"].collect()} == {(f, p) for f in features for p in range(3)}
    lines = {r["feature"]: r["content"][0] for r in tables["report"].filter("section_id = 'overall_summary'").collect()}
    assert all(re.fullmatch(r"(High|Medium|Low) \d+\.\d+", x) for x in lines.values())
    flow.rerun({}, "score_impact")
    assert flow.made == ["score_impact", "report", "translate"] and flow.retried == 0
    assert {tuple(r["content"]) for r in tables["translate"].collect()} == {tuple(r["content"]) for r in tables["report"].collect()}
    asked = runs.regulation_flow(spark, DATA, str(tmp_path / "run"), ask=True)
    assert "report" not in asked.run({}, start="report") and asked.question == {"stage": "report", "text": f"report on {len(features)} features?"}
    asked.answer("yes")
    assert "translate" in runs.regulation_flow(spark, DATA, str(tmp_path / "run"), ask=True).run({})


def test_embeddings_come_in_batches(spark):
    sizes = []

    def model():
        return lambda texts: [[float(len(texts)), float(len(t.split()))] for t in texts]

    rows = spark.createDataFrame([(i, "w " * i) for i in range(7)] + [(7, None)], "i int, t string").coalesce(1)
    found = {r["i"]: r["embedding"] for r in retrieval.embedded(rows, "t", model, 3, 4).collect()}
    sizes = [found[i][0] for i in range(8)]
    assert sizes == [3.0] * 6 + [2.0] * 2 and found[6][1] == 4.0 and found[7][1] == 0.0


def test_chunkers_and_parsers_over_whole_tables(spark):
    import pandas as pd
    import xxhash

    from palimpsest.functions.html import plain_text

    docs, pages = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/pages.parquet")
    rows = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, DATA).collect())
    headers, parts, packs, vectors = [], [], [], []
    for doc, body in zip(docs.doc_id, docs.text, strict=True):
        lines = [f"{'#' * (i // 5 % 3 + 1)} {x[:30]}" if i % 5 == 0 else x for i, x in enumerate(body.split("\n"))]
        headers += [(doc, i, " > ".join(c["hierarchy"]), len(c["body"])) for i, c in enumerate(chunking.split_headers("\n".join(lines)))]
        parts += [(doc, i, len(x)) for i, x in enumerate(chunking.split_long(body, 200, 300, 50))]
        packs += [(doc, i, len(x)) for i, x in enumerate(chunking.pack_lines(body, 1000))]
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", body.strip(" ").lower()) if w]
        vectors.append((doc, len({xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(w.encode(), 42) >> 63) for w in words}), float(len(words))))
    assert rows("chunk_headers") == sorted(headers) and rows("chunk_split") == sorted(parts) and rows("chunk_pack") == sorted(packs)
    found = rows("sparse_vectors")
    assert [(d, w) for d, _, w in found] == [(d, w) for d, _, w in sorted(vectors)]
    # buckets are shared by few words
    assert all(n - 3 * n * n / retrieval.BUCKETS - 3 <= k <= n for (_, k, _), (_, n, _) in zip(found, sorted(vectors), strict=True))
    assert rows("html_to_text") == sorted((i, plain_text(h)) for i, h in zip(pages.page_id, pages.html, strict=True))
