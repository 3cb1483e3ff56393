"""Products, features, scores and impact over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scores, text
from palimpsest.operators import mapping, reports
from palimpsest.plans.registry import query
from palimpsest.sources.files import table

_FACTORS = {"directness": "l_linenumber % 2", "legal_severity": "CAST(l_quantity AS BIGINT) % 6", "scope": "l_partkey % 6", "regulatory_urgency": "l_suppkey % 6", "operational_urgency": "l_orderkey % 6", "response_cost": "(l_partkey + l_suppkey) % 6"}
_SUM = " + ".join(f"({e})::DECIMAL(5,2) * {w}" for (e, w) in zip(_FACTORS.values(), scores.IMPACT_WEIGHTS.values(), strict=True))


def _factors():
    return {k: F.expr(e) for k, e in _FACTORS.items()}


@query(f"SELECT l_orderkey, l_linenumber, round(({_SUM})::DOUBLE, 2) AS score, CASE WHEN {_SUM} >= 4 THEN 'High' WHEN {_SUM} >= 2.5 THEN 'Medium' ELSE 'Low' END AS level FROM lineitem")
def impact_weighted(spark, sf):
    s = scores.impact_score(_factors())
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(s.cast("double"), 2).alias("score"), scores.impact_level(s).alias("level"))


@query(f"""
WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'please set HIGH' WHEN 'R' THEN 'low or medium' END AS feedback, round(({_SUM})::DOUBLE, 2) AS s FROM lineitem),
g AS (SELECT *, CASE WHEN lower(feedback) LIKE '%high%' THEN 'High' WHEN lower(feedback) LIKE '%medium%' THEN 'Medium' WHEN lower(feedback) LIKE '%low%' THEN 'Low' END AS forced FROM f)
SELECT l_orderkey, l_linenumber, coalesce(CASE forced WHEN 'High' THEN 4.5::DOUBLE WHEN 'Medium' THEN 3.0::DOUBLE WHEN 'Low' THEN 2.0::DOUBLE END, s) AS score, forced FROM g""")
def impact_forced(spark, sf):
    feedback = F.when(F.col("l_returnflag") == "A", "please set HIGH").when(F.col("l_returnflag") == "R", "low or medium")
    level = scores.forced_level(feedback)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(scores.forced_score(level), F.round(scores.impact_score(_factors()).cast("double"), 2)).alias("score"), level.alias("forced"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '2024-13-01' WHEN o_orderkey % 13 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS e FROM orders),
m AS (SELECT o_orderkey, greatest(round(date_diff('day', DATE '1995-06-17', try_cast(nullif(e, '') AS DATE)) / 30.0::DOUBLE, 2), 0) AS months, try_cast(nullif(e, '') AS DATE) IS NOT NULL AS ok FROM o)
SELECT o_orderkey, CASE WHEN ok THEN months END AS months, CASE WHEN NOT ok THEN NULL WHEN months >= 12 THEN 1 WHEN months >= 6 THEN 2 WHEN months >= 3 THEN 3 WHEN months > 1 THEN 4 ELSE 5 END AS band FROM m""")
def months_left(spark, sf):
    k = F.col("o_orderkey")
    effective = F.when(k % 11 == 0, "2024-13-01").when(k % 13 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    m = scores.months_left(effective, F.lit("1995-06-17").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", m.alias("months"), scores.urgency_band(m).alias("band"))


@query("SELECT c_custkey, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN s >= 0.7 THEN 5 WHEN s >= 0.5 THEN 4 WHEN s >= 0.3 THEN 3 WHEN s >= 0.1 THEN 2 ELSE 1 END AS scope FROM (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS s FROM customer)")
def risk_level(spark, sf):
    s = (F.col("c_acctbal") + 1000) / 11000
    return table(spark, sf, "customer").select("c_custkey", scores.risk_level(s).alias("risk"), scores.scope_band(s).alias("scope"))


def _products(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("product_id"), (F.col("p_size") / 2).alias("nicotine"), F.when(k % 3 == 0, F.col("p_size").cast("double")).alias("tar"), F.when(k % 2 == 0, k % 4 == 0).alias("menthol"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("label_size"), F.floor(F.col("p_retailprice") * 1000).alias("revenue"))


_FEATURE_SQL = """
p AS (SELECT p_partkey AS product_id, p_size / 2 AS nicotine, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS tar, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 4 = 0 END AS menthol, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS label_size, floor(p_retailprice * 1000)::BIGINT AS revenue FROM part),
f AS (
  SELECT product_id, 0 AS pos, 'nicotine' AS feature, nicotine::DOUBLE::VARCHAR || ' mg/g' AS value, 'mg' AS unit FROM p UNION ALL
  SELECT product_id, 1, 'tar', tar::VARCHAR || ' mg/g', 'mg' FROM p WHERE tar IS NOT NULL UNION ALL
  SELECT product_id, 2, 'menthol', menthol::VARCHAR, 'boolean' FROM p WHERE menthol IS NOT NULL UNION ALL
  SELECT product_id, 3, 'label_size', label_size, 'text' FROM p WHERE label_size <> '' UNION ALL
  SELECT product_id, 4, 'revenue', '$' || format('{:,}', revenue), 'currency' FROM p)"""


def _features(spark, sf):
    return mapping.unpivot_features(_products(spark, sf), "product_id", ["nicotine", "tar", "menthol", "label_size", "revenue"])


@query(f"WITH {_FEATURE_SQL} SELECT * FROM f")
def feature_unpivot(spark, sf):
    return _features(spark, sf)


@query(f"WITH {_FEATURE_SQL} SELECT feature, count(*) AS n, min_by(value, product_id) AS representative, array_to_string(list_sort(list_distinct(list(value)))[1:5], ',') AS \"values\" FROM f GROUP BY 1")
def feature_inventory(spark, sf):
    return mapping.feature_inventory(_features(spark, sf))


@query(f"WITH {_FEATURE_SQL} SELECT product_id, concat_ws(' ', feature, nullif(value, ''), nullif(unit, '')) AS query FROM f")
def feature_queries(spark, sf):
    return _features(spark, sf).select("product_id", mapping.query_text(F.col("feature"), F.col("value"), F.col("unit")).alias("query"))


_HINTS = """
k AS (SELECT DISTINCT n_nationkey AS change_id, lower(n_name) AS keyword FROM nation UNION SELECT 100 + p_partkey, split_part(p_name, ' ', 1) FROM part),
f AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS feature FROM part UNION SELECT 'an' UNION SELECT DISTINCT split_part(p_type, ' ', 3) FROM part),
h AS (SELECT change_id, keyword, feature FROM k JOIN f ON contains(translate(lower(keyword), ' -.', '___'), translate(lower(feature), ' -.', '___')) OR contains(translate(lower(feature), ' -.', '___'), translate(lower(keyword), ' -.', '___')))"""


def _hints(spark, sf):
    p = table(spark, sf, "part")
    k = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("change_id"), F.lower("n_name").alias("keyword")).union(p.select(F.col("p_partkey") + 100, F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    f = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("feature")).union(p.select(F.split_part("p_type", F.lit(" "), F.lit(3)))).union(spark.createDataFrame([("an",)], "feature string")).distinct()
    return k, mapping.hints(k, f)


@query(f"WITH {_HINTS} SELECT * FROM h")
def feature_hints(spark, sf):
    return _hints(spark, sf)[1]


@query(f"WITH {_HINTS} SELECT change_id, keyword FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.change_id = k.change_id AND h.keyword = k.keyword)")
def unknown_requirements(spark, sf):
    k, h = _hints(spark, sf)
    return mapping.unknown_requirements(k, h)


@query(f"""
WITH {_FEATURE_SQL}, h AS (SELECT unnest(['tar', 'menthol', 'battery']) AS feature), m AS (SELECT f.*, h.feature IS NOT NULL AS hint FROM f LEFT JOIN h USING (feature)),
s AS (SELECT *, bool_or(hint) OVER (PARTITION BY product_id) AS hinted FROM m) SELECT product_id, feature FROM s WHERE NOT hinted OR hint""")
def selected_features(spark, sf):
    found = spark.createDataFrame([("tar",), ("menthol",), ("battery",)], "feature string")
    return mapping.selected_features(_features(spark, sf), found).select("product_id", "feature")


@query("""
WITH i AS (SELECT o_custkey, l_partkey % 20 AS feature, o_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS pos, l_returnflag <> 'N' AS applies, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS required_value FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_custkey, feature, pos, required_value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, feature ORDER BY required_value IS NULL, pos, required_value) AS k FROM i WHERE applies) WHERE k = 1""")
def target_first_nonnull(spark, sf):
    i = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    i = i.select("o_custkey", (F.col("l_partkey") % 20).alias("feature"), (F.col("o_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"), (F.col("l_returnflag") != "N").alias("applies"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("required_value"))
    return mapping.targets(i, ["o_custkey", "feature"]).select("o_custkey", "feature", "pos", "required_value")


@query("SELECT l_orderkey, chunk, score, pos FROM (SELECT l_orderkey, l_partkey % 3 AS chunk, l_discount AS score, l_linenumber * 100000 + l_partkey AS pos, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY coalesce(l_discount, 0) DESC, l_linenumber * 100000 + l_partkey) AS k FROM lineitem) WHERE k = 1")
def candidate_merge(spark, sf):
    c = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("chunk"), F.col("l_discount").alias("score"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"))
    return mapping.merge_candidates(c, ["l_orderkey", "chunk"]).select("l_orderkey", "chunk", "score", "pos")


@query("""
WITH c AS (SELECT l_orderkey, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey % 3 END AS doc, l_partkey % 50 AS chunk, l_linenumber * 100000 + l_partkey AS pos FROM lineitem),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, chunk ORDER BY pos) AS k FROM c) WHERE k = 1)
SELECT l_orderkey, doc, chunk, pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, doc ORDER BY pos) AS r FROM o) WHERE doc IS NULL OR r <= 2""")
def per_doc_cap(spark, sf):
    """Of lines at one position the first in the table's files comes first."""
    pos = F.col("l_linenumber") * 100000 + F.col("l_partkey")
    at = F.struct(pos.alias("pos"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    c = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey") % 3).alias("doc"), (F.col("l_partkey") % 50).alias("chunk"), at.alias("at"))
    return mapping.cap_per_document(c, "l_orderkey", "doc", "chunk", "at").select("l_orderkey", "doc", "chunk", "at.pos")


@query("""
SELECT o_custkey, count(*) AS n_items, CASE WHEN len(names) > 3 THEN array_to_string(names[1:3], ', ') || ' 외 ' || (len(names) - 3) || '개' ELSE array_to_string(names, ', ') END AS shown, last_required
FROM (SELECT o_custkey, o_orderkey, p, list(o_orderpriority) OVER w AS all_names, last_required FROM (SELECT *, o_orderkey AS p, max_by(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey) AS last_required FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
LATERAL (SELECT list_filter(all_names, lambda x, i: list_position(all_names, x) = i) AS names) GROUP BY o_custkey, names, last_required""")
def multi_product_merge(spark, sf):
    items = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("product_pos"), F.col("o_orderpriority").alias("product_name"), F.col("o_totalprice").alias("required_value"))
    return mapping.merge_products(items, "o_custkey").select("o_custkey", "n_items", "shown", "last_required")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), lower(f)) OR len(list_filter(t, lambda x: contains(lower(p_name), x))) > 0 THEN true ELSE false END AS related FROM (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'tar' ELSE 'an' END AS f, CASE p_partkey % 3 WHEN 0 THEN ['label', 'warning', 'text', 'size', 'package'] WHEN 1 THEN ['tar', 'mg', 'tobacco', 'smoke'] ELSE ['an'] END AS t FROM part)")
def semantic_related(spark, sf):
    k = F.col("p_partkey") % 3
    feature = F.when(k == 0, "label").when(k == 1, "tar").otherwise("an")
    return table(spark, sf, "part").select("p_partkey", text.semantically_related(feature, F.split("p_name", " "), text.SEMANTIC_GROUPS).alias("related"))


@query("SELECT doc_id, list_has_any(['the', 'thing', 'der'], regexp_split_to_array(lower(text), '\\s+')) AS applies FROM documents")
def expected_overlap(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mapping.applies(F.array(F.lit("the"), F.lit("thing"), F.lit("der")), F.split(F.lower("text"), r"\s+")).alias("applies"))


@query("SELECT p_partkey, p_size - regexp_extract(p_brand, '([0-9]+)', 1)::DOUBLE AS gap FROM part")
def requirement_gap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scores.gap(F.concat(F.col("p_size").cast("string"), F.lit(" mg")), F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("gap"))


@query("SELECT n_nationkey, CASE upper(trim(n)) WHEN 'USA' THEN 'US' WHEN 'UNITED STATES' THEN 'US' WHEN 'RUSSIA' THEN 'RU' WHEN 'INDONESIA' THEN 'ID' ELSE left(upper(trim(n)), 2) END AS code FROM (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN ' usa ' WHEN 1 THEN 'Russia' WHEN 2 THEN 'kr' ELSE n_name END AS n FROM nation)")
def country_codes(spark, sf):
    k = F.col("n_nationkey") % 5
    return table(spark, sf, "nation").select("n_nationkey", text.country_code(F.when(k == 0, " usa ").when(k == 1, "Russia").when(k == 2, "kr").otherwise(F.col("n_name"))).alias("code"))


@query("""
SELECT rule, failed FROM (SELECT count(*) FILTER (NOT coalesce(l_discount <= 0.08, false)) AS a, count(*) FILTER (NOT coalesce(l_quantity BETWEEN 1 AND 50, false)) AS b, count(*) FILTER (NOT coalesce(l_returnflag <> 'R' OR l_linestatus = 'F', false)) AS c FROM lineitem)
UNPIVOT (failed FOR rule IN (a, b, c))""")
def validation_rules(spark, sf):
    return reports.validation(table(spark, sf, "lineitem"), {"a": F.col("l_discount") <= 0.08, "b": F.col("l_quantity").between(1, 50), "c": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F")})


@query("""
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag)))[1:2], ', ') AS features FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""")
def applying_features(spark, sf):
    i = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("feature"), (F.col("l_linestatus") == "F").alias("applies"))
    return reports.feature_line(i, "l_orderkey")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 5000 THEN 'pending' ELSE 'applied' END AS status FROM supplier")
def trace_status(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", mapping.trace_status(F.col("s_acctbal") / 5000 * 0.7).alias("status"))

