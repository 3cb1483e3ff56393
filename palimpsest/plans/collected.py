"""Collected documents: crawl targets, ids, search texts, languages and pairs of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import ingest
from palimpsest.plans.registry import query
from palimpsest.sources.files import table


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'X' || c_custkey END AS code, CASE c_custkey % 4 WHEN 0 THEN 'regulation' WHEN 1 THEN 'news' ELSE c_mktsegment END AS category,
  CASE WHEN c_custkey % 5 = 0 THEN 'Given' WHEN c_custkey % 4 = 0 THEN 'Regulation' WHEN c_custkey % 4 = 1 THEN 'News' ELSE c_mktsegment END AS label FROM customer""")
def crawl_targets(spark, sf):
    k = F.col("c_custkey")
    code, category, label = ingest.target_fields(
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("X"), k.cast("string"))), F.col("c_mktsegment"), F.when(k % 4 == 0, "reg").when(k % 4 == 1, "news").otherwise(F.col("c_mktsegment")), F.when(k % 5 == 0, "Given")
    )
    return table(spark, sf, "customer").select("c_custkey", code.alias("code"), category.alias("category"), label.alias("label"))


@query("""
SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' site:x.org' ELSE '' END || ' after:' || CASE WHEN o_orderkey % 3 = 0 THEN '2023-12-02' ELSE strftime(o_orderdate, '%Y-%m-%d') END
  || CASE WHEN o_orderkey % 5 = 0 THEN ' filetype:html' WHEN o_orderstatus = 'F' THEN ' filetype:pdf' ELSE '' END AS query FROM orders""")
def search_texts(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    said = ingest.search_text(F.col("o_orderpriority"), F.when(k % 2 == 0, "x.org").otherwise(""), F.when(k % 3 != 0, F.col("o_orderdate").cast("date")), F.when(k % 5 == 0, "html"), F.when(F.col("o_orderstatus") == "F", "Reg").otherwise("news"), F.lit("2024-03-11").cast("date"))
    return o.select("o_orderkey", said.alias("query"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a-b-' || doc_id ELSE concat_ws('-', 'FDA', CASE WHEN doc_id % 2 = 0 THEN lang END, nullif(array_to_string(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))[1:3], '-'), '')) END AS id FROM documents""")
def regulation_ids(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select("doc_id", ingest.regulation_id(F.lit("FDA"), F.when(k % 2 == 0, F.col("lang")).otherwise(""), F.when(k % 4 != 0, F.col("text")), F.concat(F.lit("x/a b."), k.cast("string"), F.lit(".pdf"))).alias("id"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE array_to_string((list_concat(CASE WHEN p_partkey % 4 = 1 THEN [] ELSE string_split(p_name, ' ') END, [p_size::VARCHAR, p_brand]))[1:5], ' ') END AS query,
  'tar' || ' ' || p_size || ' ' || array_to_string((list_concat(CASE WHEN p_partkey % 4 > 1 THEN string_split(p_name, ' ')[1:3] ELSE [] END, CASE WHEN p_partkey % 4 > 0 THEN [p_size::VARCHAR] ELSE [] END))[1:2], ' ') AS hinted FROM part""")
def change_queries(spark, sf):
    k = F.col("p_partkey") % 4
    words = F.when(k > 1, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    numbers = F.when(k > 0, F.array(F.struct(F.col("p_brand").alias("field"), F.col("p_size").cast("string").alias("new_value")))).otherwise(F.array().cast("array<struct<field:string,new_value:string>>"))
    own = F.transform(numbers, lambda n: F.struct(F.lit("tar").alias("field"), n["new_value"].alias("new_value")))
    p = table(spark, sf, "part")
    return p.select("p_partkey", ingest.change_query(words, numbers).alias("query"), ingest.hinted_query(F.lit("tar"), F.col("p_size").cast("string"), words, own).alias("hinted"))


@query("""
WITH w AS (SELECT doc_id, lang, length(text) AS n, regexp_split_to_array(lower(regexp_replace(text, '[.,;:!?]', '', 'g')), '\\s+') AS ws FROM documents),
c AS (SELECT doc_id, n, len(list_filter(ws, lambda x: x IN ('the', 'of', 'and', 'that', 'with', 'was', 'for', 'are'))) AS en, len(list_filter(ws, lambda x: x IN ('der', 'die', 'und', 'das', 'nicht', 'von', 'mit', 'ist'))) AS de,
  len(list_filter(ws, lambda x: x IN ('le', 'les', 'des', 'est', 'que', 'dans', 'une', 'pour'))) AS fr, len(list_filter(ws, lambda x: x IN ('el', 'los', 'del', 'que', 'por', 'con', 'una', 'las'))) AS es FROM w),
b AS (SELECT *, greatest(en, de, fr, es) AS best FROM c)
SELECT doc_id, CASE WHEN n < 10 OR best = 0 THEN 'UNKNOWN' WHEN en = best THEN 'EN' WHEN de = best THEN 'DE' WHEN fr = best THEN 'FR' ELSE 'ES' END AS language, CASE WHEN n < 10 OR best = 0 THEN false ELSE round(best / (en + de + fr + es), 4) >= 0.7 END AS reliable FROM b""")
def language_detect(spark, sf):
    found = ingest.detected_language(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.language", "f.reliable")


@query("SELECT m.doc_id, t.doc_id IS NOT NULL AS has_text FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) m LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) t ON m.doc_id = t.doc_id")
def metadata_with_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    name = lambda suffix: F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path")
    m = d.filter("doc_id % 2 = 0").select("doc_id", name("_metadata.json"))
    t = d.filter("doc_id % 3 = 0").select(name(".txt"))
    stem = lambda p: F.regexp_replace(p, r"(_metadata\.json|\.txt)$", "")
    return m.withColumn("stem", stem("path")).join(t.select(stem("path").alias("stem"), F.lit(True).alias("found")), "stem", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("has_text"))


@query("SELECT p_partkey, p_size::DOUBLE AS mg, CASE WHEN p_partkey % 2 = 0 THEN (p_size * 100)::DOUBLE END AS mah, NULL::DOUBLE AS cm FROM part")
def specifications(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    body = F.concat(F.lit("nicotine "), n.cast("string"), F.lit(" MG per piece"), F.when(k % 2 == 0, F.concat(F.lit(", battery "), (n * 100).cast("string"), F.lit("mAh"))).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", ingest.specifications(body).alias("s")).select("p_partkey", "s.*")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END >= TIMESTAMP '1996-06-01', false) AS fresh FROM orders")
def report_freshness(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ingest.is_fresh(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")), F.lit("1996-06-01").cast("timestamp")).alias("fresh"))


@query("SELECT doc_id, CASE WHEN length(trim(left(text, doc_id % 120))) >= 50 THEN left(text, doc_id % 120) ELSE 'ocr' END AS body FROM documents")
def text_or_ocr(spark, sf):
    some = F.left("text", (F.col("doc_id") % 120).cast("int"))
    return table(spark, sf, "documents").select("doc_id", ingest.text_or_ocr(some, F.lit("ocr")).alias("body"))
