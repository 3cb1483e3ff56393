"""Filters, projections, keynote lists, batch results, checks and routes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import html, ingest, scores, text
from palimpsest.operators import checks, frames, history, reports, retrieval, review, versions
from palimpsest.plans.registry import query
from palimpsest.sources.files import table


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL'")
def sources_by_type(spark, sf):
    return frames.optional(table(spark, sf, "part"), p_type="SMALL", p_brand=None).orderBy("p_partkey").select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount >= 0.07 AS high FROM lineitem WHERE l_partkey = 17")
def impacts_of_product(spark, sf):
    rows = frames.optional(table(spark, sf, "lineitem"), l_partkey=17)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (scores.risk_level(F.col("l_discount") * 10) == "high").alias("high"))


@query("SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en'")
def translations_of(spark, sf):
    return frames.optional(table(spark, sf, "documents"), source="src3", lang="en").select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def reports_filtered(spark, sf):
    return frames.optional(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal >= 0 AS enabled, row_number() OVER (ORDER BY c_acctbal >= 0 DESC, c_custkey) AS place FROM customer WHERE c_mktsegment = 'MACHINERY'")
def crawl_list(spark, sf):
    """Targets of a category, those enabled first."""
    rows = frames.optional(table(spark, sf, "customer"), c_mktsegment="MACHINERY").select("c_custkey", (F.col("c_acctbal") >= 0).alias("enabled"))
    return frames.placed(rows, [F.col("enabled").desc(), F.col("c_custkey")])


@query("SELECT doc_id, len(string_split(text, chr(10))) - 1 AS n FROM documents WHERE len(string_split(text, chr(10))) > 1")
def with_section_changes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.slice(F.split("text", "\n"), F.lit(2), F.size(F.split("text", "\n"))).alias("rest"))
    return frames.nonempty(d, "rest").select("doc_id", F.size("rest").cast("long").alias("n"))


@query("SELECT page_id, strlen(html) AS n_bytes FROM pages WHERE strlen(html) > 2000")
def large_contents(spark, sf):
    return frames.large_contents(table(spark, sf, "pages"), "html").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7 ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10")
def admin_page(spark, sf):
    rows = frames.optional(table(spark, sf, "customer"), c_nationkey=7)
    return frames.numbered_page(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 10).select("c_custkey")


@query("""
SELECT source, lang, n_chars // 500 AS version, doc_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang, n_chars // 500 ORDER BY n_chars DESC, doc_id DESC) AS k FROM documents) WHERE k = 1""")
def payload_latest(spark, sf):
    d = table(spark, sf, "documents").withColumn("version", F.expr("n_chars div 500"))
    return versions.latest_of(d, ["source", "lang", "version"], [F.col("n_chars"), F.col("doc_id")], ["doc_id", "text"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-06-30' UNION ALL SELECT -1, '2024-01-05', NULL")
def report_range(spark, sf):
    rows = frames.between(table(spark, sf, "orders"), "o_orderdate", "1995-03-01", "1995-06-30").select("o_orderkey", F.col("o_orderdate").alias("made"))
    every = rows.unionByName(rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit(None).cast(rows.schema["made"].dataType).alias("made")))
    return every.select("o_orderkey", text.shown_time(F.col("made"), F.lit("2024-01-05")).alias("shown"), text.iso_time(F.col("made")).alias("iso"))


def _keynotes(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 5
    impact = F.when(k == 0, "high").when(k == 1, "Low").when(k == 2, "odd").when(k == 3, "MEDIUM")
    fields = {"country": F.col("c_nationkey").cast("string"), "category": F.col("c_mktsegment"), "summary": F.col("c_name"), "impact": impact, "title": F.col("c_name"), "analysis_date": F.lit("2024-02-01")}
    data = F.map_filter(F.create_map(*(x for n, v in fields.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())
    return c.select(F.col("c_custkey").alias("keynote_id"), data.alias("data"), F.when(k != 4, F.timestamp_seconds(F.col("c_custkey") * 1000)).alias("generated_at"))


@query("""
SELECT c_custkey AS keynote_id, c_nationkey::VARCHAR AS country, c_mktsegment AS category, c_name AS summary,
  CASE c_custkey % 5 WHEN 0 THEN '높음' WHEN 1 THEN '낮음' WHEN 2 THEN 'odd' WHEN 3 THEN '보통' ELSE '' END AS impact, count(*) OVER () AS today_count FROM customer""")
def keynote_list(spark, sf):
    return reports.list_rows(_keynotes(spark, sf))


@query("""
SELECT c_custkey AS keynote_id, c_name AS title, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE coalesce(i, 1) END AS impact_level, '2024-02-01' AS category
FROM customer LEFT JOIN (SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS i FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def keynotes_of_country(spark, sf):
    level = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "MEDIUM").otherwise("LOW")
    sections = table(spark, sf, "orders").select(F.col("o_custkey").alias("keynote_id"), level.alias("level"), F.lit("").alias("n"))
    return reports.country_rows(_keynotes(spark, sf), reports.inferred_impact(sections, "keynote_id", "level", "n"))


@query("""
SELECT c_custkey AS keynote_id, c_name AS file_name, '' AS promulgated, '' AS effective,
  CASE WHEN c_custkey % 5 = 4 THEN '2024-02-01' ELSE strftime(make_timestamp(c_custkey * 1000000000), '%Y-%m-%d %H:%M:%S') END AS collected FROM customer""")
def keynote_details(spark, sf):
    return reports.detail_rows(_keynotes(spark, sf))


@query("""
SELECT user_id, count(*) AS total_files, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, coalesce(array_to_string(list_sort(list(f) FILTER (NOT ok)), ','), '') AS failed_files,
  (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::BIGINT AS duration_seconds, round(count(*) FILTER (ok) / count(*) * 100, 1) AS success_rate,
  coalesce(sum(t) FILTER (ok), 0)::BIGINT AS total_tokens, coalesce(sum(p) FILTER (ok), 0)::BIGINT AS total_pages,
  CASE WHEN coalesce(sum(p) FILTER (ok), 0) > 0 THEN round(sum(t) FILTER (ok) / sum(p) FILTER (ok), 6) END AS tokens_per_page
FROM (SELECT user_id, ts, event_id::VARCHAR AS f, value < 300 AS ok, event_id % 100 AS t, event_id % 7 AS p FROM events) GROUP BY 1""")
def batch_results(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.col("event_id").cast("string").alias("file"), F.when(F.col("value") < 300, "success").otherwise("error").alias("state"), (F.col("event_id") % 100).alias("t"), (F.col("event_id") % 7).alias("p"))
    out = reports.batch_result(e, ["user_id"], "file", "state", "ts", "ts", "t", "p")
    return out.withColumn("failed_files", F.array_join("failed_files", ",")).withColumn("tokens_per_page", F.round("tokens_per_page", 6))


@query("""
SELECT conv_id, count(*) AS chunks, (sum(length(text)) // count(*))::BIGINT AS mean_length, count(DISTINCT role)::INT AS products, count(DISTINCT left(text, 1)) AS sections FROM conversations GROUP BY 1""")
def embedding_summaries(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "text", F.array("role").alias("products"), F.left("text", F.lit(1)).alias("section"))
    return reports.embedding_summary(c, ["conv_id"], "text", "products", "section")


@query("""
SELECT o_custkey, '[Report] product=' || CASE WHEN o_custkey % 3 = 0 THEN 'unknown' ELSE 'p' || o_custkey END || ' items=' || count(*) || ' unknown=' || count(*) FILTER (o_orderstatus = 'O') || ' report generated.' AS said,
  '보고서 생성 완료 (Unknown)' || chr(10) || '규제명칭: t' || chr(10) || '영향도: N/A | 매핑 항목: ' || count(DISTINCT o_orderstatus) || '개 유효 카테고리 (' || array_to_string(list_sort(list_distinct(list(o_orderstatus)))[1:2], ', ') || ')'
  || chr(10) || '제품: Unknown' || chr(10) || 'Key Change: § 1: new' AS alert FROM orders GROUP BY 1""")
def notifications(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("u"), F.collect_set("o_orderstatus").alias("features"))
    product = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).otherwise("")
    none = F.lit(None).cast("string")
    return o.select("o_custkey", reports.notification(product, F.col("n"), F.col("u")).alias("said"), reports.alert_text(none, F.lit("t"), F.lit(""), F.col("features"), none, F.lit("§ 1: new")).alias("alert"))


@query("""
WITH m AS (SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id))::VARCHAR AS payload FROM events GROUP BY 1, 2)
SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN payload END) AS output, string_agg(event_type, ',' ORDER BY event_type) AS nodes FROM m WHERE user_id % 7 <> 0 GROUP BY 1""")
def node_outputs(spark, sf):
    e = table(spark, sf, "events").withColumn("payload", F.col("event_id").cast("string"))
    merged = reports.merged_payloads(e, "user_id", "event_type", "payload", "ts", "event_id")
    kept = frames.delete(merged, e.filter("user_id % 7 = 0"), ["user_id"])
    return reports.node_output(kept, "purchase").select("user_id", "output", F.array_join("nodes", ",").alias("nodes"))


@query("""
WITH m AS (SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id))::VARCHAR AS payload FROM events GROUP BY 1, 2)
SELECT c_custkey AS user_id, c_name, max(CASE WHEN event_type = 'purchase' THEN payload END) AS mapping, max(CASE WHEN event_type = 'click' THEN payload END) AS changes FROM customer JOIN m ON user_id = c_custkey GROUP BY 1, 2""")
def restored_state(spark, sf):
    e = table(spark, sf, "events").withColumn("payload", F.col("event_id").cast("string"))
    merged = reports.merged_payloads(e, "user_id", "event_type", "payload", "ts", "event_id")
    regulations = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return reports.restored_state(regulations, merged, "user_id", {"purchase": "mapping", "click": "changes"})


@query("SELECT p_partkey, array_to_string(list_concat(CASE WHEN p_partkey % 3 = 0 THEN [] ELSE string_split(p_name, ' ') END, CASE WHEN p_partkey % 2 = 0 THEN [p_brand] ELSE [] END), '|') AS trace FROM part")
def trace_appended(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.array_join(reports.trace_append(F.when(k % 3 != 0, F.split("p_name", " ")), F.when(k % 2 == 0, F.array("p_brand"))), "|").alias("trace"))


def _runs(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents")
    products = F.when(k % 4 != 0, F.array(F.col("source"), F.when(k % 3 == 0, F.col("lang")))).otherwise(F.array().cast("array<string>"))
    strategies = F.when(k % 5 != 0, F.array(F.concat(F.lit("do "), (k % 50).cast("string")), F.lit(" keep ")))
    return d.select(k.alias("run_id"), F.col("text").alias("summary"), products.alias("products"), strategies.alias("strategies"))


@query("""
SELECT doc_id AS run_id, 'Regulation: ' || trim(text) || chr(10) || 'Products: ' || CASE WHEN doc_id % 4 = 0 THEN '(no mapped products)' WHEN doc_id % 3 = 0 THEN source || ', ' || lang ELSE source END AS text,
  CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS n_products FROM documents WHERE doc_id % 5 <> 0""")
def history_rows(spark, sf):
    return history.history_rows(_runs(spark, sf)).select("run_id", "text", "n_products")


@query()
def history_search(spark, sf):
    kept = history.history_rows(_runs(spark, sf))
    asked = table(spark, sf, "benchmark").filter("item_id % 20 = 0")
    queries = asked.select(F.col("item_id").alias("query_id"), history.run_text(F.col("text"), F.array(F.lit("src3"))).alias("text"))
    found = history.search_history(queries, kept)
    return history.reused_strategies(found, kept).select("query_id", F.array_join("strategies", "|").alias("strategies"))


@query("""
WITH h AS (SELECT doc_id, sha256(array_to_string(string_split(coalesce(text, ''), ' ')[1:8192], ' ')) AS d FROM documents)
SELECT doc_id, round(list_sum(list_transform(range(0, 32), lambda i: ('0x' || substr(d, 2 * i + 1, 2))::BIGINT / 255.0::DOUBLE)) * 32, 6) AS total, round(('0x' || substr(d, 1, 2))::BIGINT / 255.0::DOUBLE, 9) AS first FROM h""")
def batch_embedding(spark, sf):
    v = retrieval.embedded(table(spark, sf, "documents").select("doc_id", "text"), "text", retrieval.digest_model)
    return v.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("embedding", 1), 9).alias("first"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'KR' ELSE 'US' END AS country, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind, (1 + (p_partkey % 2 = 0)::INT)::INT AS n FROM part")
def merged_filters(spark, sf):
    k = F.col("p_partkey")
    first = F.create_map(F.lit("country"), F.lit("US"))
    second = F.when(k % 2 == 0, F.create_map(F.lit("kind"), F.col("p_type")))
    third = F.when(k % 3 == 0, F.create_map(F.lit("country"), F.lit("KR")))
    m = retrieval.merged_filters(retrieval.product_filter(k), first, second, third)
    rows = table(spark, sf, "part").select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", F.try_element_at("m", F.lit("country")).alias("country"), F.try_element_at("m", F.lit("kind")).alias("kind"), F.size("m").alias("n"))


@query("""
WITH ok AS (SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src3' AND doc_id IN (SELECT vec_id FROM embeddings)),
dn AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (
  SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 AND p.vec_id IN (SELECT doc_id FROM ok))),
t AS (SELECT doc_id AS point_id, w AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM ok)) WHERE w <> '' GROUP BY ALL),
u AS (SELECT item_id AS query_id, w AS token, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM benchmark WHERE item_id % 20 = 0) WHERE w <> '' GROUP BY ALL),
sp AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT query_id, point_id, sum(t.n * u.n)::DOUBLE AS score FROM t JOIN u USING (token) GROUP BY ALL)),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.point_id, b.point_id) AS point_id, a.rank AS dr, b.rank AS sr, coalesce(0.7::DOUBLE / (a.rank + 60), 0.0) + coalesce(0.3::DOUBLE / (b.rank + 60), 0.0) AS score
  FROM (SELECT * FROM dn WHERE rank <= 20) a FULL JOIN (SELECT * FROM sp WHERE rank <= 20) b ON a.query_id = b.query_id AND a.point_id = b.point_id)
SELECT query_id, point_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST, point_id) AS k FROM f) WHERE k <= 10""")
def filtered_search(spark, sf):
    """Hybrid search within a country and a regulation."""
    from palimpsest.plans.searched import _vectors, _words

    queries, vectors = _vectors(spark, sf)
    words, stored = _words(spark, sf)
    points = vectors.join(table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "lang", "source"), "point_id")
    within = (F.col("lang") == "en") & (F.col("source") != "src3")
    return retrieval.hybrid_search(queries, words, points, stored, 10, filters=within).select("query_id", "point_id", F.round("score", 8).alias("score"))


@query("""
WITH t AS (SELECT doc_id AS point_id, w AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
u AS (SELECT item_id AS query_id, w AS token, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM benchmark WHERE item_id % 20 = 0) WHERE w <> '' GROUP BY ALL),
sp AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT query_id, point_id, sum(t.n * u.n)::DOUBLE AS score FROM t JOIN u USING (token) GROUP BY ALL))
SELECT query_id, string_agg(point_id::VARCHAR, ',' ORDER BY rank) AS sources, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM sp JOIN documents ON doc_id = point_id WHERE rank <= 3 GROUP BY 1""")
def question_context(spark, sf):
    from palimpsest.plans.searched import _words

    found = retrieval.sparse_topk(*_words(spark, sf), 3)
    points = table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "text")
    return retrieval.answer_context(found, points, "text").withColumn("sources", F.array_join("sources", ","))


@query("""
WITH i AS (SELECT l_returnflag <> 'N' AS applies, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS required, CASE WHEN l_returnflag <> 'N' THEN l_suppkey::DOUBLE END AS current, CASE WHEN l_returnflag = 'A' AND l_linenumber % 3 <> 0 THEN l_suppkey - l_quantity END AS gap,
  'limit ' || l_quantity AS evidence, CASE WHEN l_linestatus = 'F' THEN 'c' END AS category FROM lineitem)
SELECT rule, failed FROM (SELECT count(*) FILTER (NOT (applies OR (required IS NULL AND current IS NULL AND gap IS NULL))) AS M2, count(*) FILTER (NOT coalesce(gap IS NULL OR abs(current - required - gap) < 1e-9, false)) AS M3,
  count(*) FILTER (NOT (required IS NULL OR contains(evidence, required::VARCHAR))) AS M4, count(*) FILTER (NOT (category IS NOT NULL AND (NOT applies OR required IS NOT NULL))) AS M5 FROM i) UNPIVOT (failed FOR rule IN (M2, M3, M4, M5))""")
def mapping_rules(spark, sf):
    flag, third = F.col("l_returnflag"), F.col("l_linenumber") % 3 != 0
    required, current = F.when(third, F.col("l_quantity")), F.when(flag != "N", F.col("l_suppkey").cast("double"))
    gap = F.when((flag == "A") & third, F.col("l_suppkey") - F.col("l_quantity"))
    evidence = F.concat(F.lit("limit "), F.col("l_quantity").cast("string"))
    rules = checks.mapping_rules(flag != "N", required, current, gap, F.when(F.col("l_linestatus") == "F", "c"), F.lit("k"), F.lit("x"), evidence)
    return reports.validation(table(spark, sf, "lineitem"), rules)


@query("""
SELECT rule, failed FROM (SELECT count(*) FILTER (NOT (p_size % 10) IN (1, 2, 3)) AS S1, count(*) FILTER (p_partkey % 7 = 0) AS S4 FROM part) UNPIVOT (failed FOR rule IN (S1, S4))""")
def strategy_rules(spark, sf):
    known = F.array(*map(F.lit, ["f1", "f2", "f3"]))
    feature = F.concat(F.lit("f"), (F.col("p_size") % 10).cast("string"))
    rules = checks.strategy_rules(feature, F.lit("High"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_name")), known)
    return reports.validation(table(spark, sf, "part"), rules)


_W = {"directness": "l_linenumber % 3", "legal_severity": "1 + l_partkey % 5", "scope": "1 + l_suppkey % 6", "regulatory_urgency": "1 + l_orderkey % 5", "operational_urgency": "2", "response_cost": "3"}
_TOTAL = " + ".join(f"({e})::DECIMAL(5,2) * {w}" for e, w in zip(_W.values(), scores.IMPACT_WEIGHTS.values(), strict=True))


@query(f"""
SELECT rule, failed FROM (SELECT count(*) FILTER (NOT (l_linenumber % 3 IN (0, 1) AND 1 + l_suppkey % 6 <= 5 AND l_partkey % 4 <> 0)) AS I2, count(*) FILTER (l_returnflag = 'N') AS I4
FROM (SELECT *, {_TOTAL} AS total FROM lineitem)) UNPIVOT (failed FOR rule IN (I2, I4))""")
def impact_rules(spark, sf):
    factors = {k: F.expr(e) for k, e in _W.items()}
    weighted = scores.impact_score(factors).cast("double") + F.when(F.col("l_partkey") % 4 == 0, 0.5).otherwise(0.0)
    rules = checks.impact_rules(factors, weighted, F.when(F.col("l_returnflag") != "N", "why"))
    return reports.validation(table(spark, sf, "lineitem"), rules)


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal / 10000 BETWEEN 0 AND 1 THEN round(s_acctbal / 10000, 3) END AS score, length(s_name) >= 3 AS user_ok, s_suppkey % 2 = 0 AS code_ok FROM supplier""")
def api_values(spark, sf):
    k = F.col("s_suppkey")
    rules = checks.api_rules(F.when(k % 2 == 0, "KR").otherwise("KOR"), F.col("s_name"), F.lit(None).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", checks.api_score(F.col("s_acctbal") / 10000).alias("score"), checks.user_name(F.col("s_name")).alias("user_ok"), (rules["code"] & rules["name"] & rules["url"]).alias("code_ok"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 >= 2 OR event_id % 3 = 0 THEN 'ok' WHEN event_id % 5 = 0 THEN 'detect_changes' WHEN event_id % 5 = 1 THEN 'map_products' WHEN event_id % 5 = 2 THEN 'score_impact' ELSE 'ok' END AS stage FROM events""")
def validation_routes(spark, sf):
    k = F.col("event_id")
    restart = F.when(k % 5 == 0, "change_detection").when(k % 5 == 1, "map_products").when(k % 5 == 2, "score_impact").when(k % 5 == 3, "report")
    return table(spark, sf, "events").select("event_id", checks.next_stage(k % 3 == 0, restart, k % 4).alias("stage"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1160.' || doc_id WHEN 1 THEN NULL WHEN 2 THEN '12.5' WHEN 3 THEN '7.1' END AS section,
  CASE doc_id % 5 WHEN 0 THEN '§ 1160.' || doc_id || '(a)' WHEN 1 THEN 'General' WHEN 2 THEN '§ 12.5' WHEN 3 THEN 'SECTION 7.1' ELSE 'CFR-1' END AS shown,
  'R' || doc_id || '-' || source || '-P' || n_chars AS reference FROM documents""")
def chunk_section_keys(spark, sf):
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    label = F.when(k == 0, F.concat(F.lit("§ 1160."), n, F.lit("(a)"))).when(k == 1, "General").otherwise("")
    body = F.when(k == 2, "as § 12.5 says").when(k == 3, "see SECTION 7.1 of it").otherwise("nothing")
    return table(spark, sf, "documents").select(
        "doc_id", text.section_of_chunk(label, none, none, body).alias("section"), text.section_display(none, label, none, none, body, F.lit("CFR-1")).alias("shown"),
        text.reference_id(F.concat(F.lit("R"), n), F.col("source"), F.col("n_chars")).alias("reference"),
    )


@query("""
SELECT doc_id, left(coalesce(text, ''), 120) AS short, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['b', 'a'] ELSE [] END, [lang, source], ['a'], CASE WHEN doc_id % 3 = 0 THEN ['n1'] ELSE [] END))), ',') AS words FROM documents""")
def united_keywords(spark, sf):
    k = F.col("doc_id")
    lists = F.when(k % 2 == 0, F.array(F.lit("b"), F.lit("a"))), F.array("lang", "source"), F.array(F.lit("a"), F.lit(None).cast("string")), F.when(k % 3 == 0, F.array(F.lit("n1")))
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), 120).alias("short"), F.array_join(text.united_keywords(*lists), ",").alias("words"))


@query("SELECT p_partkey, contains('label_size', translate(lower(split_part(p_name, ' ', 1)), ' -.', '___')) OR p_partkey % 4 = 0 AS named FROM part")
def area_features(spark, sf):
    area = F.when(F.col("p_partkey") % 4 == 0, "Label Size").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return table(spark, sf, "part").select("p_partkey", text.in_feature(area, F.lit("label.size")).alias("named"))


@query("""SELECT p_partkey, 'Name: ' || p_name || chr(10) || '{"size": ' || p_size || ', "kind": "{' || p_type || '}"} ' AS prompt FROM part""")
def prompt_texts(spark, sf):
    said = text.filled('Name: {name}\n{{"size": {size}, "kind": "{kind}"}} {none}', name=F.col("p_name"), size=F.col("p_size"), kind=F.concat(F.lit("{"), F.col("p_type"), F.lit("}")), none=F.lit(None).cast("string"))
    return table(spark, sf, "part").select("p_partkey", said.alias("prompt"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '모델 ' || p_partkey || ',제품 A' || p_size WHEN 1 THEN 'X 전자담배' ELSE '' END AS names, CASE p_partkey % 3 WHEN 1 THEN 'e-cigarette' WHEN 2 THEN 'tobacco' END AS kind,
  CASE p_partkey % 3 WHEN 1 THEN 2 ELSE 1 END AS n_pages, CASE p_partkey % 3 WHEN 1 THEN p_size || 'mg,니코틴,베이핑,액상,전자담배' WHEN 2 THEN p_size || 'mg' ELSE p_size || 'mg,라벨' END AS words FROM part""")
def products_named(spark, sf):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    body = F.when(k == 0, F.concat(F.lit("모델 "), F.col("p_partkey").cast("string"), F.lit(" / 제품 A"), n, F.lit(" 라벨"))).when(k == 1, "X 전자담배\n\n\n 니코틴 ").otherwise("담배")
    rows = table(spark, sf, "part").select("p_partkey", body.alias("b"), n.alias("n")).withColumn("kind", ingest.product_kind(F.col("b")))
    return rows.select("p_partkey", F.array_join(ingest.product_names(F.col("b")), ",").alias("names"), "kind", F.size(ingest.blank_line_pages(F.col("b"))).alias("n_pages"), F.array_join(ingest.enriched_keywords(F.col("b"), F.col("kind"), F.col("n")), ",").alias("words"))


_LANGUAGE = """
s AS (SELECT doc_id, text, CASE WHEN length(text) > 3000 THEN left(text, 1000) || ' ' || substr(text, (floor(length(text) / 2) - 500 + 1)::BIGINT, 1000) || ' ' || right(text, 1000) ELSE text END AS sampled FROM {0}),
w AS (SELECT doc_id, text, regexp_split_to_array(lower(regexp_replace(sampled, '[.,;:!?]', '', 'g')), '\\s+') AS ws FROM s),
c AS (SELECT doc_id, text, len(list_filter(ws, lambda x: x IN ('the', 'of', 'and', 'that', 'with', 'was', 'for', 'are'))) AS en, len(list_filter(ws, lambda x: x IN ('der', 'die', 'und', 'das', 'nicht', 'von', 'mit', 'ist'))) AS de,
  len(list_filter(ws, lambda x: x IN ('le', 'les', 'des', 'est', 'que', 'dans', 'une', 'pour'))) AS fr, len(list_filter(ws, lambda x: x IN ('el', 'los', 'del', 'que', 'por', 'con', 'una', 'las'))) AS es FROM w),
r AS (SELECT doc_id, text, en + de + fr + es AS total, list_sort(list_filter([{{'least': -en, 'language': 'EN'}}, {{'least': -de, 'language': 'DE'}}, {{'least': -fr, 'language': 'FR'}}, {{'least': -es, 'language': 'ES'}}], lambda x: x.least < 0)) AS best FROM c)"""


@query(f"""
WITH {_LANGUAGE.format("documents")}
SELECT doc_id, CASE WHEN length(trim(text)) >= 10 THEN array_to_string(list_transform(best[1:3], lambda x: x.language || '=' || round(-x.least / total, 4)::DECIMAL(6,4)::VARCHAR), ',') END AS top FROM r""")
def language_top(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", ingest.language_scores(F.col("text")).alias("s"))
    return d.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["language"], x["share"].cast("decimal(6,4)").cast("string"))), ",").alias("top"))


@query(f"""
WITH k AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents), {_LANGUAGE.format("k")},
f AS (SELECT doc_id, text, coalesce(CASE WHEN length(trim(text)) >= 10 THEN best[1].language END, 'UNKNOWN') AS detected, coalesce(CASE WHEN length(trim(text)) >= 10 THEN round(-best[1].least / total, 4) >= 0.7 END, false) AS reliable FROM r),
e AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'ES' END AS expected FROM f)
SELECT doc_id, length(text)::INT AS n_clean, detected, reliable, expected = detected AS country_match, CASE WHEN NOT reliable THEN expected ELSE detected END AS language FROM e""")
def clean_detect(spark, sf):
    k = F.col("doc_id") % 4
    country = F.when(k == 0, "us").when(k == 1, "DE").when(k == 2, "FR").otherwise("ES")
    rows = table(spark, sf, "documents").select("doc_id", ingest.cleaned(F.col("text"), country).alias("c"))
    return rows.select("doc_id", F.length("c.clean").alias("n_clean"), "c.detected", "c.reliable", "c.country_match", "c.language")


_DAY = r"((?:19|20)\d{2}[-./년 ]{1,2}\d{1,2}[-./월 ]{1,2}\d{1,2})"


@query(rf"""
WITH f AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '((?:19|20)\d{{2}}[-/]?(?:0[1-9]|1[0-2])[-/]?(?:0[1-9]|[12]\d|3[01]))', 1), ''), CASE WHEN page_id % 6 = 0 THEN '2021-03-04' END,
  nullif(regexp_extract(html, '"datePublished"\s*:\s*"([^"]+)"', 1), ''), nullif(regexp_extract(html, '"dateModified"\s*:\s*"([^"]+)"', 1), ''),
  nullif(regexp_extract(html, '(?i)<meta[^>]+(?:published_time|pubdate|dc\.date|date)[^>]+content="([^"]+)"', 1), ''), nullif(regexp_extract(html, '(?i)<time[^>]+datetime="([^"]+)"', 1), ''),
  nullif(regexp_extract(left(html, 3000), '{_DAY}', 1), ''), nullif(regexp_extract('seen 2020.1.9', '{_DAY}', 1), ''), '') AS s FROM pages),
p AS (SELECT page_id, s, list_filter(regexp_split_to_array(s, '[^0-9]+'), lambda x: x <> '') AS g FROM f)
SELECT page_id, CASE WHEN len(g) >= 3 THEN lpad(CASE WHEN g[1]::BIGINT < 100 THEN g[1]::BIGINT + 2000 ELSE g[1]::BIGINT END::VARCHAR, 4, '0') || lpad(g[2], 2, '0') || lpad(g[3], 2, '0')
  WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) >= 8 THEN left(regexp_replace(s, '[^0-9]', '', 'g'), 8) ELSE '20240101' END AS day FROM p""")
def page_dates(spark, sf):
    published = F.when(F.col("page_id") % 6 == 0, "2021-03-04").otherwise("")
    return table(spark, sf, "pages").select("page_id", html.page_date(F.col("html"), F.col("url"), published, F.lit("seen 2020.1.9"), "20240101").alias("day"))


@query("""
WITH c AS (SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS changes FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
i AS (SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], ',') AS items FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
s AS (SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS strategies FROM orders GROUP BY 1)
SELECT o_custkey, changes, items, strategies FROM c FULL JOIN i USING (o_custkey) FULL JOIN s USING (o_custkey)""")
def answer_contexts(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("v"), "o_orderstatus")
    changed = o.filter("o_orderstatus = 'F'").withColumnRenamed("v", "section_ref")
    items = o.withColumnRenamed("v", "feature").withColumn("applies", F.col("o_orderstatus") == "O")
    out = review.answer_context(changed, items, o.withColumnRenamed("v", "strategy"), "o_custkey")
    return out.select("o_custkey", *(F.array_join(n, ",").alias(n) for n in ("changes", "items", "strategies")))
