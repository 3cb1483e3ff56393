"""Dates of elements, languages by profile, grounded rules, word weights, unified structures, units of work and runs that ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates, ingest, languages
from palimpsest.operators import assembly, checks, reports, retrieval
from palimpsest.operators.workflow import Workflow
from palimpsest.plans.registry import query
from palimpsest.sources import files, store
from palimpsest.sources.files import table
from palimpsest.sources.units import Store

#: What is put before a page, by the remainder of page_id; ``{d}`` is a day of two digits. The last of each pair is the day told.
_MARKED = [
    ('<script type="application/ld+json">{{"@graph":[{{"dateModified":"2023-02-{d}"}},{{"datePublished":"2022-03-{d}T08:00"}}]}}</script>', "202203{d}"),
    ("<meta content='2021.04.{d}' property='article:published_time'><meta name='date' content='2001-01-01'>", "202104{d}"),
    ('<div id="x" class="info date">posted <b>2020년 5월 {d}일</b> by me</div>', "202005{d}"),
    ('<meta name="date" content="2021-13-{d}"><time datetime="2019-06-{d}T10:00">some time ago</time>', "201906{d}"),
    ("<p>of 2018/07/{d}, a day</p>", "201807{d}"),
    ("<script>var t = '2017-08-{d}';</script><!-- 2017-09-{d} -->", None),
]
_CASES = " ".join(f"WHEN {i} THEN '{told.replace('{d}', '')}' || d" for i, (_, told) in enumerate(_MARKED) if told)


@query(rf"""
WITH p AS (SELECT page_id, lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS d, nullif(regexp_replace(regexp_extract(url, '20\d{{2}}[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])'), '[^0-9]', '', 'g'), '') AS u FROM pages)
SELECT page_id, coalesce(u, CASE page_id % 6 {_CASES} END, CASE WHEN page_id % 12 = 5 THEN strftime(make_timestamp(page_id * 86400000000), '%Y%m%d') END, '20240101') AS day FROM p""")
def page_dom_dates(spark, sf):
    """Dates in JSON-LD, meta elements, classed elements, time elements and text, or of the header, in front of every page."""
    d = F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0")
    marked = F.element_at(F.array(*(F.lit(m.replace("{{", "{").replace("}}", "}")) for m, _ in _MARKED)), (F.col("page_id") % 6 + 1).cast("int"))
    page = F.concat(F.replace(marked, F.lit("{d}"), d), F.col("html"))
    modified = F.when(F.col("page_id") % 12 == 5, F.col("page_id") * 86_400_000)
    none = F.lit(None).cast("string")
    return table(spark, sf, "pages").select("page_id", dates.document_date(page, F.col("url"), none, modified, none, "20240101").alias("day"))


@query()
def language_profiles(spark, sf):
    """The three likeliest languages of every document, by profiles trained from the bounded sample of the table's own labels."""
    docs = table(spark, sf, "documents")
    told = docs.select("doc_id", languages.languages(F.col("text"), languages.train(docs, "text", "lang")).alias("l"))
    return told.select("doc_id", F.try_element_at("l.top", F.lit(1))["language"].alias("language"), F.array_join(F.transform("l.top", lambda x: x["language"]), ",").alias("top"), "l.reliable")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))".format


@query(f"""
WITH d AS (SELECT text, CASE WHEN doc_id % 4 < 3 THEN 'limit' ELSE 'other' END AS kind, CASE WHEN doc_id % 3 = 0 THEN left(text, 60) || ' zzqx' ELSE left(text, instr(text || ' ', ' ') - 1) END AS condition FROM documents)
SELECT 'M1' AS rule, count(*) FILTER (NOT (kind = 'limit' AND list_has_all({_WORDS('text')}, {_WORDS('condition')}))) AS failed FROM d""")
def mapping_grounds(spark, sf):
    k = F.col("doc_id")
    condition = F.when(k % 3 == 0, F.concat(F.left("text", F.lit(60)), F.lit(" zzqx"))).otherwise(F.substring_index("text", " ", 1))
    rules = checks.grounded_mapping(F.when(k % 4 < 3, "limit").otherwise("other"), condition, F.col("text"), ("limit", "label"))
    return reports.validation(table(spark, sf, "documents"), rules)


_SAID = "CASE p_partkey % 4 WHEN 0 THEN 'reduce the ' || p_name WHEN 1 THEN 'label on ' || p_name WHEN 2 THEN 'change the battery of ' || p_name ELSE p_name END"
_KINDS = "CASE p_size % 3 WHEN 0 THEN ['device'] WHEN 1 THEN ['labeling', 'liquid'] ELSE ['none'] END"


@query(f"""
WITH s AS (SELECT {_SAID} AS said, {_KINDS} AS kinds, CASE p_partkey % 3 WHEN 0 THEN [p_type, 'reduce the ' || p_name] WHEN 1 THEN [p_type] END AS history FROM part),
w AS (SELECT *, {_WORDS('said')} AS words FROM s),
r AS (SELECT NOT ((list_has_any(words, ['device', 'battery']) AND NOT list_contains(kinds, 'device')) OR (list_has_any(words, ['label', 'labeling']) AND NOT list_contains(kinds, 'labeling')) OR (list_has_any(words, ['liquid', 'flavour']) AND NOT list_contains(kinds, 'liquid')) OR list_has_any(words, ['packaging', 'pack'])) AS S2,
  list_has_any(words, ['reduce', 'change']) AS S3,
  history IS NULL OR len(list_filter(history, lambda h: len(list_intersect(words, {_WORDS('h')})) / len(list_distinct(list_concat(words, {_WORDS('h')}))) >= 0.2)) > 0 AS S5 FROM w)
SELECT rule, failed FROM (SELECT count(*) FILTER (NOT S2) AS S2, count(*) FILTER (NOT S3) AS S3, count(*) FILTER (NOT S5) AS S5 FROM r) UNPIVOT (failed FOR rule IN (S2, S3, S5))""")
def strategy_fits(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    said = F.when(k % 4 == 0, F.concat(F.lit("reduce the "), name)).when(k % 4 == 1, F.concat(F.lit("label on "), name)).when(k % 4 == 2, F.concat(F.lit("change the battery of "), name)).otherwise(name)
    some = lambda *x: F.array(*map(F.lit, x))
    kinds = F.when(F.col("p_size") % 3 == 0, some("device")).when(F.col("p_size") % 3 == 1, some("labeling", "liquid")).otherwise(some("none"))
    history = F.when(k % 3 == 0, F.array(F.col("p_type"), F.concat(F.lit("reduce the "), name))).when(k % 3 == 1, F.array("p_type"))
    return reports.validation(table(spark, sf, "part"), checks.strategy_fit(said, kinds, history))


@query(f"""
WITH s AS (SELECT p_name || ' must be held under the new limit of ' || p_brand AS said, p_name AS a, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS b, CASE p_partkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS hard, 1 + p_size % 5 AS urgency, 1 + p_partkey % 5 AS cost FROM part)
SELECT rule, failed FROM (SELECT count(*) FILTER (NOT (list_has_any({_WORDS('said')}, {_WORDS('a')}) AND list_has_any({_WORDS('said')}, {_WORDS('b')}))) AS I1,
  count(*) FILTER ((hard = 'High' AND least(urgency, cost) <= 1) OR (hard = 'Low' AND greatest(urgency, cost) >= 5)) AS I3 FROM s) UNPIVOT (failed FOR rule IN (I1, I3))""")
def impact_fits(spark, sf):
    k = F.col("p_partkey")
    said = F.concat(F.col("p_name"), F.lit(" must be held under the new limit of "), F.col("p_brand"))
    sources = F.array(F.col("p_name"), F.when(k % 5 == 0, F.col("p_type")).otherwise(F.col("p_brand")))
    hard = F.when(k % 3 == 0, "High").when(k % 3 == 1, "Low").otherwise("Medium")
    return reports.validation(table(spark, sf, "part"), checks.impact_fit(said, sources, hard, 1 + F.col("p_size") % 5, 1 + k % 5))


@query("""
WITH w AS (SELECT doc_id, w AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
t AS (SELECT doc_id, token, n / sum(n) OVER (PARTITION BY doc_id) AS weight FROM w)
SELECT doc_id, count(*) AS n_words, round(max(weight), 6) AS most, 1.0::DOUBLE AS norm, round(sum(weight) + 0.5, 6) AS merged FROM t GROUP BY 1""")
def lexical_weights(spark, sf):
    """Dense vectors and word weights of every document from one model, and its weights merged with those of another part."""
    both = retrieval.encoded(table(spark, sf, "documents").select("doc_id", "text"), "text", retrieval.digest_lexical_model, longest=1 << 20)
    weights = F.map_values("lexical")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    more = F.create_map(F.lit("an added part"), F.lit(0.5))
    norm = F.sqrt(total(F.transform("embedding", lambda x: x * x)))
    return both.filter("lexical is not null").select("doc_id", F.size("lexical").cast("long").alias("n_words"), F.round(F.array_max(weights), 6).alias("most"), F.round(norm, 6).alias("norm"), F.round(total(F.map_values(retrieval.merged_weights(F.col("lexical"), more, F.lit(None)))), 6).alias("merged"))


@query("""
WITH p AS (SELECT conv_id, turn // 2 AS batch, turn, role, text FROM conversations),
b AS (SELECT conv_id, batch, count(*) AS pages, avg(turn / 8) AS complexity, sum(length(text))::BIGINT AS tokens, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body, list(text ORDER BY turn) AS texts, list(role ORDER BY turn) AS roles, list(turn ORDER BY turn) AS turns FROM p GROUP BY ALL)
SELECT conv_id, batch, pages, round(complexity, 6) AS complexity, tokens, sha256(body) AS body, array_to_string(list_transform(range(1, len(turns) + 1), lambda i: (coalesce(list_sum(list_transform(texts[1:i - 1], lambda t: len(string_split(t, chr(10))) + 1)), 0)::BIGINT)::VARCHAR), ',') AS starts,
  'turn ' || list_filter(turns, lambda t: t % 4 > 0)[1] AS title, len(list_distinct(roles)) AS n_entities, 1 AS n_tables, len(turns) AS n_rows FROM b""")
def unified_structures(spark, sf):
    """Turns of a conversation as pages of batches of two."""
    c = table(spark, sf, "conversations")
    empty = F.lit(None).cast("string")
    block = F.struct(F.col("role").alias("section_ref"), F.lit(0).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.col("role")).alias("keywords"))
    title = F.when(F.col("turn") % 4 > 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).otherwise("")
    about = F.struct(title.alias("title"), *(empty.alias(n) for n in ("jurisdiction_code", "authority", "citation_code", "language", "effective_date")))
    entity = F.struct(F.col("role").alias("name"), F.lit("role").alias("type"), F.left("text", F.lit(9)).alias("context"))
    held = F.struct(F.lit("turns").alias("caption"), F.array(F.lit("turn")).alias("headers"), F.array(F.array(F.col("turn").cast("string"))).alias("rows"))
    page = F.struct(F.col("text").alias("markdown_content"), F.array(block).alias("reference_blocks"), about.alias("metadata"), F.array(entity).alias("entities"), F.array(held).alias("tables"))
    pages = c.select("conv_id", F.expr("turn div 2").alias("batch"), "turn", page.alias("structure"), (F.col("turn") / 8).alias("complexity"), F.length("text").cast("long").alias("tokens"))
    s = assembly.unified_structures(pages, ["conv_id", "batch"], "turn")
    starts = F.array_join(F.transform("structure.reference_blocks", lambda b: b["start_line"].cast("string")), ",")
    rows = F.size(F.try_element_at("structure.tables", F.lit(1))["rows"])
    return s.select("conv_id", "batch", "pages", F.round("complexity", 6).alias("complexity"), "tokens", F.sha2("structure.markdown_content", 256).alias("body"), starts.alias("starts"), "structure.metadata.title", F.size("structure.entities").cast("long").alias("n_entities"), F.size("structure.tables").alias("n_tables"), rows.cast("long").alias("n_rows"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def unit_of_work(spark, sf):
    """Orders written, those that are pending taken out, and a part that fails taken back, in one unit over two tables."""
    db = Store(spark, store.work_folder(spark, "unit"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    with db.unit() as unit:
        unit.write("orders", orders.filter("o_orderkey % 2 = 0"))
        unit.append("orders", orders.filter("o_orderkey % 2 = 1"))
        try:
            with unit.nested():
                unit.write("orders", orders.filter("false"))
                raise ValueError("taken back")
        except ValueError:
            pass
        unit.write("orders", unit.read("orders").filter("o_orderstatus <> 'P'"))
        unit.write("customers", unit.read("orders").select("o_custkey").distinct())
    return db.read("orders").join(db.read("customers"), "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT p_brand, count(*) AS n, max(p_size) AS largest, 'yes' AS answer, 1::BIGINT AS retries FROM part WHERE p_size > 10 GROUP BY 1""")
def checked_run(spark, sf):
    """A run over parts that its own rule sends back once, that stops to ask, is answered, and goes on in a second object."""
    folder = store.work_folder(spark, "checked")

    def flow() -> Workflow:
        def sized(t):
            # the rule fails what the first attempt gives
            return t["parts"].filter(F.col("p_size") > (10 if runs[0].retried else 0))

        def grouped(t):
            return t["map_products"].groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("largest"))

        def told(t):
            return t["score_impact"].withColumn("answer", F.lit(runs[0].answers["report"])).withColumn("retries", F.lit(runs[0].retried).cast("long"))

        runs = [Workflow(spark, folder, {"map_products": sized, "score_impact": grouped, "report": told}, {"report": lambda t: "publish?"}, {"map_products": lambda t: t["map_products"].filter("p_size <= 10").isEmpty()}, "score_impact")]
        return runs[0]

    inputs = {"parts": table(spark, sf, "part")}
    flow().run(inputs)
    second = flow()
    second.answer("yes")
    return second.run(inputs)["report"]


@query("SELECT count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, count(DISTINCT vec_id) AS kept FROM embeddings")
def stored_points(spark, sf):
    """All vectors written as points, and as JSON lines, and read back."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("dense"), F.array(F.lit(1)).alias("sparse"))
    at, lines = store.work_folder(spark, "points"), store.work_folder(spark, "lines")
    files.write_points(e, at)
    files.snapshot(e.select("text"), lines)
    back = spark.read.parquet(at)
    size = F.size("dense").cast("long")
    return back.join(spark.read.schema("text string").json(lines), "text").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.countDistinct("id").alias("kept"))


@query("""
WITH c AS (SELECT c_custkey FROM customer),
i AS (SELECT o_custkey AS c_custkey, count(*) FILTER (o_orderstatus = 'F') AS applies, count(*) AS items FROM orders GROUP BY 1),
h AS (SELECT o_custkey AS c_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:5], ',') AS changes FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
s AS (SELECT o_custkey AS c_custkey, array_to_string(list(o_orderpriority ORDER BY o_orderkey, o_orderpriority)[1:3], ',') AS strategies FROM orders WHERE o_totalprice > 20000 GROUP BY 1)
SELECT c_custkey, coalesce(applies, 0) AS applies, coalesce(items, 0) AS items, coalesce(changes, '') AS changes, coalesce(strategies, '') AS strategies FROM c LEFT JOIN i USING (c_custkey) LEFT JOIN h USING (c_custkey) LEFT JOIN s USING (c_custkey)""")
def run_digest(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    items = o.select("c_custkey", (F.col("o_orderstatus") == "F").alias("applies"))
    pos = F.struct("o_orderdate", "o_orderkey")
    changed = o.filter("o_orderstatus <> 'F'").select("c_custkey", pos.alias("pos"), F.col("o_orderkey").cast("string").alias("line"))
    plans = o.filter("o_totalprice > 20000").select("c_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("line"))
    out = reports.run_digest(table(spark, sf, "customer"), "c_custkey", items, changed, plans)
    return out.withColumn("changes", F.array_join("changes", ",")).withColumn("strategies", F.array_join("strategies", ","))


@query("""
SELECT p_partkey, array_to_string(list_concat([p_type], CASE WHEN p_partkey % 3 = 0 THEN [] ELSE string_split(p_name, ' ') END), '|') AS entries, CASE WHEN p_partkey % 3 = 0 THEN 'before' ELSE 'now' END AS last_updated FROM part""")
def trace_updates(spark, sf):
    trace = F.struct(F.array("p_type").alias("entries"), F.lit("before").alias("last_updated"))
    new = F.when(F.col("p_partkey") % 3 != 0, F.split("p_name", " "))
    out = table(spark, sf, "part").select("p_partkey", reports.trace_updated(trace, new, F.lit("now")).alias("t"))
    return out.select("p_partkey", F.array_join("t.entries", "|").alias("entries"), "t.last_updated")


@query("""
WITH k AS (SELECT p_partkey, p_partkey % 3 AS k, p_name, p_brand, p_size, p_type FROM part)
SELECT p_partkey, concat_ws(chr(10) || chr(10), CASE WHEN k > 0 THEN '섹션: ' || p_brand END, CASE WHEN k < 2 THEN '규제 내용: 니코틴 ' || p_name END, CASE WHEN k <> 1 THEN '관련 제품: ' || p_name || ', ' || p_type END,
  CASE k WHEN 0 THEN '제품 특성: 니코틴 함량: ' || p_size || 'mg, 제품 카테고리: e-cigarette' WHEN 1 THEN '제품 특성: 배터리 용량: ' || p_size || 'mAh, 라벨 크기: 9cm, color: red' END,
  CASE k WHEN 0 THEN '관련 키워드: ' || p_size || 'mg, 니코틴, 베이핑, 액상, 전자담배' WHEN 1 THEN '관련 키워드: 니코틴' END) AS text FROM k""")
def combined_texts(spark, sf):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    none = F.create_map().cast("map<string,string>")
    specs = F.when(k == 0, F.create_map(F.lit("nicotine"), size, F.lit("category"), F.lit("e-cigarette"))).when(k == 1, F.create_map(F.lit("battery_capacity"), size, F.lit("label_size"), F.lit("9"), F.lit("color"), F.lit("red"))).otherwise(none)
    products = F.when(k != 1, F.array("p_name", "p_type")).otherwise(F.array().cast("array<string>"))
    body = ingest.combined_text(F.when(k > 0, F.col("p_brand")), F.when(k < 2, F.concat(F.lit("니코틴 "), F.col("p_name"))), products, specs)
    return table(spark, sf, "part").select("p_partkey", body.alias("text"))
