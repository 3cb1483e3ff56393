"""Reports, dashboards, job status and model answers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import ingest, jsonx
from palimpsest.operators import reports, versions
from palimpsest.plans.registry import query
from palimpsest.sources.files import table

_SAID = """CASE turn % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"n": ' || conv_id || ', "t": [1, 2,], }' || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || '{"n": ' || conv_id || '}' || chr(10) || '```' WHEN 2 THEN 'x {"n": ' || conv_id || '} y' ELSE 'no json' END"""


@query(f"SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE conv_id END AS n FROM (SELECT conv_id, turn, {_SAID} AS s FROM conversations)")
def json_parse_fenced(spark, sf):
    k = F.col("turn") % 4
    n = F.col("conv_id").cast("string")
    said = F.when(k == 0, F.concat(F.lit('Sure:\n```json\n{"n": '), n, F.lit(', "t": [1, 2,], }\n```'))).when(k == 1, F.concat(F.lit('```\n{"n": '), n, F.lit("}\n```"))).when(k == 2, F.concat(F.lit('x {"n": '), n, F.lit("} y"))).otherwise("no json")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.try_variant_get(jsonx.parsed(said), "$.n", "long").alias("n"))


@query("""
SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN 'keep ' || conv_id || '|act' ELSE 'first ' || conv_id || '|second' END AS strategies FROM conversations""")
def strategy_parse(spark, sf):
    n = F.col("conv_id").cast("string")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('[{"recommended_strategy": "keep '), n, F.lit('"}, {"strategy": "act"}, {"strategy": ""}]'))).otherwise(F.concat(F.lit("1. first "), n, F.lit("\n\n - second\n")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(jsonx.strategies(said), "|").alias("strategies"))


@query("""
SELECT conv_id, list_first(list(text ORDER BY turn)) AS first, count(DISTINCT text) AS n FROM (SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE role = 'assistant' AND trim(text) <> '') GROUP BY conv_id""")
def strategy_history(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.trim("text").alias("text")).filter("text <> ''")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.countDistinct("text").alias("n"))


@query("""
SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'qty' ELSE l_returnflag END AS field, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT::VARCHAR ELSE '' END AS new_value FROM lineitem
UNION ALL SELECT l_orderkey, 'disc', (l_discount * 100)::BIGINT::VARCHAR FROM lineitem WHERE l_linenumber % 2 = 0""")
def numerical_changes_explode(spark, sf):
    pair = lambda name, v: F.struct(F.lit(name).alias("field"), v.cast("long").cast("string").alias("new_value"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, F.array(pair("qty", F.col("l_quantity")), pair("disc", F.round(F.col("l_discount") * 100)))).otherwise(F.array().cast("array<struct<field:string,new_value:string>>")).alias("numbers"))
    return reports.exploded_numbers(rows, "l_orderkey", "numbers", "l_returnflag")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS article_no, CASE o_orderstatus WHEN 'F' THEN '삭제' WHEN 'O' THEN '조항 신설' ELSE '개정 없음' END AS label FROM (SELECT DISTINCT o_custkey, o_orderkey, o_orderstatus FROM orders)""")
def articles(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").distinct()
    kind = F.when(F.col("o_orderstatus") == "F", "removed").when(F.col("o_orderstatus") == "O", "new_clause").otherwise("none")
    out = reports.article_rows(o.withColumn("kind", kind), "o_custkey", "o_orderkey", "kind")
    return out.select("o_custkey", "o_orderkey", F.col("article_no").cast("long").alias("article_no"), "label")


@query("""
SELECT l_orderkey, greatest(max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END), coalesce(max(CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN CASE WHEN l_quantity > 40 THEN 3 ELSE 2 END END), 1)) AS impact FROM lineitem GROUP BY 1""")
def impact_inferred(spark, sf):
    level = F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "R", "MEDIUM").otherwise("LOW")
    impact = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0), F.when(F.col("l_quantity") > 40, "high").otherwise("Medium")).otherwise("")
    return reports.inferred_impact(table(spark, sf, "lineitem").withColumns({"level": level, "impact": impact}), "l_orderkey", "level", "impact")


@query("SELECT user_id, count(*) AS n_nodes, string_agg(event_type || '=' || payload, ',' ORDER BY event_type) AS data FROM (SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id))::VARCHAR AS payload FROM events GROUP BY 1, 2) GROUP BY 1")
def node_json_merge(spark, sf):
    merged = reports.merged_payloads(table(spark, sf, "events").withColumn("payload", F.col("event_id").cast("string")), "user_id", "event_type", "payload", "ts", "event_id")
    return merged.select("user_id", F.size("data").cast("long").alias("n_nodes"), F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("data"))


@query("SELECT u.user_id, coalesce(s.status, 'unknown') AS status FROM (SELECT user_id FROM events UNION SELECT c_custkey FROM customer) u LEFT JOIN (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status FROM events GROUP BY 1) s USING (user_id)")
def job_status_latest(spark, sf):
    e = table(spark, sf, "events")
    latest = reports.latest_status(e, "user_id", "event_type", "ts", "event_id")
    wanted = e.select(F.col("user_id").cast("long").alias("user_id")).union(table(spark, sf, "customer").select("c_custkey")).distinct()
    return reports.status_of(wanted, latest, "user_id").select("user_id", "status")


_ITEMS = """
i AS (SELECT p_brand AS product_name, p_size % 10 AS feature, p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR END AS required_value,
  CASE p_partkey % 5 WHEN 0 THEN 'Not Regulated here' WHEN 1 THEN 'already compliant' WHEN 2 THEN 'unrelated' ELSE '' END AS reasoning FROM part)"""


@query(f"WITH {_ITEMS} SELECT product_name, feature, coalesce(required_value, CASE WHEN contains(lower(reasoning), 'not regulated') THEN '규제 대상 아님' WHEN contains(lower(reasoning), 'already compliant') THEN '기준 충족' WHEN contains(lower(reasoning), 'unrelated') THEN '해당 없음' ELSE '규제 없음' END) AS required FROM (SELECT *, row_number() OVER (PARTITION BY product_name, feature ORDER BY pos) AS k FROM i) WHERE k = 1")
def report_product_table(spark, sf):
    k = F.col("p_partkey")
    reasoning = F.when(k % 5 == 0, "Not Regulated here").when(k % 5 == 1, "already compliant").when(k % 5 == 2, "unrelated").otherwise("")
    i = table(spark, sf, "part").select(F.col("p_brand").alias("product_name"), (F.col("p_size") % 10).alias("feature"), k.alias("pos"), F.when(k % 4 == 0, F.col("p_size").cast("string")).alias("required_value"), reasoning.alias("reasoning"))
    return reports.product_table(i).select("product_name", "feature", "required")


@query("SELECT o_custkey, CASE WHEN min(o_orderdate) < TIMESTAMP '1996-01-01' THEN 'Legacy' ELSE 'New' END AS kind FROM orders GROUP BY 1")
def report_references(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda c: o.filter(c).select("o_custkey").distinct()
    return reports.references(side(F.col("o_orderdate") >= "1996-01-01"), side(F.col("o_orderdate") < "1996-01-01"), "o_custkey").select("o_custkey", "kind")


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value < 300) AS succeeded, count(*) FILTER (value >= 300) AS failed, CASE WHEN count(*) FILTER (value < 300) = count(*) THEN 'completed' WHEN count(*) FILTER (value < 300) = 0 THEN 'error' ELSE 'partial' END AS status FROM events GROUP BY 1")
def run_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("state", F.when(F.col("value") < 300, "ok").otherwise("bad"))
    return reports.run_summary(e, ["event_type"], "state")


@query("SELECT event_type, hour, sum(event_id % 100)::BIGINT AS total FROM (SELECT *, extract(hour FROM ts)::INT AS hour FROM events) GROUP BY GROUPING SETS ((), (event_type), (hour))")
def token_usage_sets(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"), (F.col("event_id") % 100).alias("n"))
    return reports.usage_sets(e, "event_type", "hour", "n")


@query("""
SELECT doc_id, CASE WHEN expected = upper(lang) THEN true ELSE false END AS country_match, CASE WHEN doc_id % 4 = 0 THEN expected ELSE upper(lang) END AS language FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'ES' END AS expected FROM documents)""")
def lang_country_validate(spark, sf):
    k = F.col("doc_id") % 4
    country = F.when(k == 0, "us").when(k == 1, "DE").when(k == 2, "FR").otherwise("ES")
    told = ingest.validated_language(country, F.upper("lang"), k != 0)
    return table(spark, sf, "documents").select("doc_id", told.alias("t")).select("doc_id", "t.country_match", "t.language")


@query("SELECT prev || ' → ' || lang AS transition, count(*) AS n FROM (SELECT lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents) WHERE prev IS NOT NULL GROUP BY 1")
def lang_transitions(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "lang")
    old = d.select(F.col("doc_id").alias("previous"), F.col("lang").alias("prev"))
    pairs = versions.previous(d, ["source"], "doc_id").join(d.select("doc_id", "lang"), "doc_id").join(old, "previous")
    return reports.count_by(pairs.select(F.concat_ws(" → ", "prev", "lang").alias("transition")), "transition")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS changed, max(CASE WHEN value > 400 THEN 3 WHEN value > 200 THEN 2 ELSE 1 END) AS level, count(DISTINCT user_id) AS products, (ceil(count(*) * 1.2::DOUBLE) + 1)::BIGINT AS axis FROM events GROUP BY 1, 2")
def weekly_dashboard(spark, sf):
    level = F.when(F.col("value") > 400, 3).when(F.col("value") > 200, 2).otherwise(1)
    return reports.daily(table(spark, sf, "events"), "event_type", "ts", [F.count(F.lit(1)).alias("changed"), F.max(level).alias("level"), F.countDistinct("user_id").alias("products"), reports.axis_max(F.count(F.lit(1))).cast("long").alias("axis")])


@query("""
SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'question' ELSE 'modify' END AS intent, CASE WHEN contains(lower(text), 'the') THEN 'change_detection' WHEN contains(lower(text), 'in') THEN 'score_impact' ELSE 'map_products' END AS target FROM conversations WHERE role = 'user'""")
def review_feedback_route(spark, sf):
    from palimpsest.operators.review import route

    c = table(spark, sf, "conversations").filter("role = 'user'")
    return route(c, "text", F.length("text") % 3 == 0, {"change_detection": ["the"], "score_impact": ["in"]}).select("conv_id", "turn", "intent", "target")


@query("SELECT conv_id, count(*) AS n_items, string_agg(CASE WHEN turn <= 3 THEN role END, ',' ORDER BY turn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1 HAVING min(turn) >= 0 AND max(k) = count(*) AND sum(CASE WHEN turn <= 3 THEN 1 ELSE 0 END) > 0")
def keynote_items(spark, sf):
    c = table(spark, sf, "conversations")
    out = reports.keynote_items(c, "conv_id", "turn", ["role"], 10)
    firsts = F.filter("items", lambda x: x["turn"] <= 3)
    return out.filter(F.size(firsts) > 0).select("conv_id", "n_items", F.array_join(F.transform(firsts, lambda x: x["role"]), ",").alias("roles"))


@query("""
SELECT source, field, arg_max(n_chars, doc_id) AS content FROM (SELECT *, CASE WHEN contains(text, 'idiot') THEN 'first' WHEN contains(text, 'License') THEN 'second' END AS field FROM documents) WHERE field IS NOT NULL GROUP BY 1, 2""")
def report_fields(spark, sf):
    return reports.report_fields(table(spark, sf, "documents"), "source", "text", "n_chars", "doc_id", [("idiot", "first"), ("License", "second")])


@query("SELECT n_nationkey, 'b' AS v, n_name AS w FROM nation")
def key_value_lists(spark, sf):
    m = jsonx.key_values(F.array(F.lit("k: a"), F.lit("none"), F.concat(F.lit("n: "), F.col("n_name")), F.lit("k: b")))
    return table(spark, sf, "nation").select("n_nationkey", m["k"].alias("v"), m["n"].alias("w"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN (event_id % 7)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events")
def score_values(spark, sf):
    k, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    said = F.when(k == 0, n).when(k == 1, F.concat(F.lit('{"score": 0, "value": '), (F.col("event_id") % 7).cast("string"), F.lit("}"))).otherwise(F.lit('{"type": "integer"}'))
    return table(spark, sf, "events").select("event_id", jsonx.score_value(F.parse_json(said)).alias("score"))
