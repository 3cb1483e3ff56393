"""Chunk assembly, page structures, batches and cases over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import jsonx, text
from palimpsest.operators import assembly, changes, frames, reports
from palimpsest.plans.registry import query
from palimpsest.sources import store
from palimpsest.sources.files import table


def document_pages(spark, sf):
    """Every document as a page of its source, with two references and, on every third, a table."""
    d = table(spark, sf, "documents")
    refs = F.array(F.struct(F.lit("").alias("section_ref")), F.struct(F.lit("th").alias("section_ref")))
    row = F.array(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    caption = F.when(F.col("doc_id") % 2 == 0, F.lit("of it"))
    one = F.struct(caption.alias("caption"), F.array(F.lit("a"), F.lit("b")).alias("headers"), F.array(row).alias("rows"))
    tables = F.when(F.col("doc_id") % 3 == 0, F.array(one)).otherwise(F.array().cast("array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>"))
    return d.select("source", F.col("doc_id").alias("page_num"), F.col("text").alias("markdown"), refs.alias("blocks"), tables.alias("tables"), F.struct("lang", "n_chars").alias("metadata"))


@query()
def chunk_assembly(spark, sf):
    out = assembly.assembled(document_pages(spark, sf), "source")
    return out.select("source", "page", "kind", "ref_id", "section_label", "section_ref", "parent_section_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.col("metadata.lang").alias("lang"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id % 2 = 0 ELSE false END AS has_table,
  CASE WHEN page_id % 3 <> 0 THEN 300 ELSE 150 END AS dpi FROM pages""")
def page_info(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    infos = p.filter("page_id % 3 <> 0").select("page_id", (F.col("page_id") % 2 == 0).alias("has_table"), F.lit(300).alias("dpi"))
    return assembly.with_page_info(p, infos, ["page_id"])


@query("""
SELECT conv_id, ((k - 1) // 3)::BIGINT AS batch, ((k - 1) % 3)::INT AS place, turn + 1 AS page
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)""")
def page_batches(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("page"))
    sent = assembly.page_batches(c, "conv_id", "turn", 3)
    answered = sent.select("conv_id", "batch", "place", F.when(F.col("turn") % 4 != 0, F.col("page")).alias("page"))
    return assembly.filled_pages(answered, sent, ["conv_id", "batch", "place"], "page").select("conv_id", "batch", "place", "page")


@query("""
SELECT conv_id, left(string_agg(text, chr(10) || chr(10) ORDER BY turn), 5000) AS opening
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 10 GROUP BY 1""")
def opening_texts(spark, sf):
    return assembly.opening_text(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("""
SELECT conv_id, turn // 2 AS batch, count(*) AS pages, round(avg(turn / 8), 6) AS complexity, sum(length(text))::BIGINT AS tokens
FROM conversations GROUP BY 1, 2""")
def batch_structures(spark, sf):
    c = table(spark, sf, "conversations")
    pages = c.select("conv_id", F.expr("turn div 2").alias("batch"), (F.col("turn") / 8).alias("complexity"), F.length("text").cast("long").alias("tokens"))
    return assembly.batch_structures(pages, ["conv_id", "batch"]).withColumn("complexity", F.round("complexity", 6))


@query("""
SELECT doc_id, 'CASE_' || doc_id AS case_id,
  concat_ws(chr(10), CASE WHEN doc_id % 5 <> 0 THEN 'Regulation: ' || text END, CASE WHEN doc_id % 3 <> 0 THEN 'Products: ' || source || ', ' || lang END) AS text,
  CASE WHEN doc_id % 4 < 2 THEN 'US' ELSE 'KR' END AS country, CASE WHEN doc_id % 4 = 1 THEN 'en' ELSE 'ko' END AS lang,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n_products, doc_id % 2 = 0 AS has_strategy FROM documents""")
def case_chunks(spark, sf):
    k = F.col("doc_id")
    products = F.when(k % 3 != 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    country = F.when(k % 4 == 1, "US").when(k % 4 > 1, "KR")
    chunk = assembly.case_chunk(F.concat(F.lit("CASE_"), k.cast("string")), F.when(k % 5 != 0, F.col("text")).otherwise(""), products, F.when(k % 2 == 0, F.lit("x")), country)
    return table(spark, sf, "documents").select("doc_id", chunk.alias("c")).select("doc_id", "c.*")


@query("SELECT conv_id, arg_min(role || '/' || length(text), turn) AS metadata FROM conversations GROUP BY 1")
def page_metadata(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("/", "role", F.length("text").cast("string")).alias("m"))
    return assembly.first_page_metadata(c, "conv_id", "turn", "m")


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'm' || conv_id WHEN 1 THEN '{"entities": [{"name": "e", "type": "t"}], }' ELSE 'no json' END AS markdown,
  CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS n_entities FROM conversations""")
def page_structures(spark, sf):
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit('```json\n{"markdown_content": "m'), F.col("conv_id").cast("string"), F.lit('", "tables": []}\n```')))
    said = said.when(k == 1, '{"entities": [{"name": "e", "type": "t"}], }').otherwise("no json")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", jsonx.page_structure(said).alias("s"))
    return rows.select("conv_id", "turn", F.col("s.markdown_content").alias("markdown"), F.size("s.entities").alias("n_entities"))


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[1, ' || conv_id || ']' WHEN 1 THEN '{"k": [' || conv_id || ']}' END AS body FROM conversations""")
def answer_json(spark, sf):
    k, n = F.col("turn") % 3, F.col("conv_id").cast("string")
    said = F.when(k == 0, F.concat(F.lit("x\x07 [1, "), n, F.lit("] y"))).when(k == 1, F.concat(F.lit('a {"k": ['), n, F.lit("]} b"))).otherwise("none")
    return table(spark, sf, "conversations").select("conv_id", "turn", jsonx.first_json(said).alias("body"))


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 2 ELSE 1 END AS n, CASE turn % 3 WHEN 0 THEN 's' || conv_id WHEN 1 THEN 'r' ELSE 'first' END AS recommended,
  CASE turn % 3 WHEN 0 THEN 'c' WHEN 1 THEN '' ELSE '(변경 감지 실패)' END AS change, CASE turn % 3 WHEN 1 THEN 'p' ELSE '없음' END AS previous,
  CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'w' ELSE '(근거 없음)' END AS rationale FROM conversations""")
def strategy_items(spark, sf):
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit('{"items": [{"change_summary": "c", "summary": "s'), F.col("conv_id").cast("string"), F.lit('"}, {"summary": ""}]}')))
    said = said.when(k == 1, '```json\n{"items": [{"recommended_strategy": "r", "rationale": "w", "previous_strategy": "p"}]}\n```').otherwise("1) first\n\n- second")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", jsonx.strategy_items(said).alias("s"))
    one = F.element_at("s", 1)
    return rows.select(
        "conv_id", "turn", F.size("s").alias("n"), one["recommended_strategy"].alias("recommended"), one["regulation_change"].alias("change"),
        one["previous_strategy"].alias("previous"), one["rationale"].alias("rationale"),
    )


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a|' || n_name WHEN 1 THEN '5' WHEN 2 THEN '데이터가 없습니다.' ELSE 'x' END AS content,
  CASE WHEN n_nationkey % 4 = 0 THEN 'a>a|' || n_name || '>' || n_name ELSE '' END AS links,
  CASE WHEN n_nationkey % 4 = 3 THEN n_name || ':h:1' ELSE ':항목:1' END AS tables FROM nation""")
def section_contents(spark, sf):
    k, name = F.col("n_nationkey") % 4, F.col("n_name")
    said = F.when(k == 0, F.concat(F.lit('{"content": ["a", "'), name, F.lit('"]}'))).when(k == 1, '{"content": 5}').when(k == 2, "{}")
    said = said.otherwise(F.concat(F.lit('{"content": "x", "tables": [{"product_name": "'), name, F.lit('", "headers": ["h"], "rows": []}]}')))
    n = table(spark, sf, "nation").select("n_nationkey", F.parse_json(said).alias("v"))
    links = F.transform(jsonx.content_links(F.col("v")), lambda x: F.concat_ws(">", x["url"], x["text"]))
    one = lambda t: F.concat_ws(":", t["product_name"], t["headers"][0], F.size(t["rows"]).cast("string"))
    return n.select("n_nationkey", F.array_join(jsonx.content_list(F.col("v")), "|").alias("content"), F.array_join(links, "|").alias("links"), F.array_join(F.transform(jsonx.content_tables(F.col("v")), one), "|").alias("tables"))


@query("""
WITH s AS (SELECT source, doc_id AS pos, 'i' || doc_id % 3 AS i, doc_id % 9 AS t, n_chars AS content FROM documents),
n AS (SELECT source, pos, CASE WHEN t = 8 THEN 'strategy' ELSE i END AS section_id, content,
  CASE t WHEN 0 THEN 'overall of it' WHEN 1 THEN '1. 규제 변경 요약' WHEN 2 THEN '제품 분석' WHEN 3 THEN 'major' WHEN 4 THEN '영향 평가' WHEN 5 THEN '참고' WHEN 6 THEN 'changes' WHEN 7 THEN '' END AS title FROM s),
p AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS place, unnest(['0. 종합 요약', '1. 규제 변경 요약', '2. 영향받는 제품 목록', '3. 주요 변경 사항 해석', '4. 대응 전략', '5. 영향 평가 근거', '6. 참고 및 원문 링크']) AS shown,
  unnest([['overall', '종합 요약'], ['규제 변경 요약', 'change'], ['제품 분석', 'products'], ['변경 사항', 'major', 'changes'], ['대응 전략', 'strategy'], ['영향 평가', 'impact'], ['참고', 'references']]) AS words),
f AS (SELECT source, place, shown, section_id, content, row_number() OVER (PARTITION BY source, place ORDER BY pos) AS k
  FROM n JOIN p ON len(list_filter(words, lambda w: contains(coalesce(title, ''), w) OR section_id = w)) > 0)
SELECT source, place, shown AS title, section_id, content FROM f WHERE k = 1""")
def placed_sections(spark, sf):
    k = F.col("doc_id") % 9
    title = F.lit(None).cast("string")
    for i, name in enumerate(["overall of it", "1. 규제 변경 요약", "제품 분석", "major", "영향 평가", "참고", "changes", ""]):
        title = F.when(k == i, name).otherwise(title)
    ident = F.when(k == 8, "strategy").otherwise(F.concat(F.lit("i"), (F.col("doc_id") % 3).cast("string")))
    rows = table(spark, sf, "documents").select("source", F.col("doc_id").alias("pos"), ident.alias("section_id"), title.alias("title"), F.col("n_chars").alias("content"))
    return reports.placed_sections(rows, "source")


@query("""
WITH c AS (SELECT l_orderkey AS o, string_agg('line ' || l_linenumber, '|' ORDER BY l_linenumber, l_partkey) AS content FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1),
r AS (SELECT o_orderkey, o_orderpriority FROM orders)
SELECT o_orderkey, 0 AS place, 'overall_summary' AS section_id, 'list' AS kind, o_orderpriority AS content FROM r
UNION ALL SELECT o_orderkey, 1, 'change_summary', 'structured_list', coalesce(content, '변경 사항 없음') FROM r LEFT JOIN c ON o = o_orderkey
UNION ALL SELECT o_orderkey, 2, 'references', 'links', '' FROM r""")
def report_sections(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    overall = o.select("o_orderkey", F.lit(0).alias("pos"), F.col("o_orderpriority").alias("line"))
    changed = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("line"))
    changed = frames.dealt(changed, "o_orderkey").distinct()
    parts = [("overall_summary", "list", "0. 종합 요약", overall, ""), ("change_summary", "structured_list", "1. 규제 변경 요약", changed, "변경 사항 없음"), ("references", "links", "6. 참고 및 원문 링크", overall.limit(0), "")]
    out = reports.report_sections(o.select("o_orderkey"), "o_orderkey", parts)
    return out.select("o_orderkey", "place", "section_id", "kind", F.array_join("content", "|").alias("content"))


@query("""
SELECT r_regionkey, '<!DOCTYPE html><html><head><title>A &amp; ' || r_name || '</title></head><body><h1>A &amp; ' || r_name || '</h1><h2>n &lt; 3</h2><ul>'
  || string_agg('<li>' || n_name || '</li>', '' ORDER BY n_nationkey) || '</ul></body></html>' AS page FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, r_name""")
def report_html(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    joined = table(spark, sf, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"))
    sections = F.array(F.struct(F.lit("n < 3").alias("title"), F.col("names").alias("content")))
    return joined.select("r_regionkey", store.report_page(F.concat(F.lit("A & "), F.col("r_name")), sections).alias("page"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 's3://b/' || CASE WHEN p_partkey % 2 = 0 THEN 'base/app/' ELSE '' END || p_type || '/' || replace(p_name, ' ', '_') END AS uri FROM part""")
def upload_uris(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 5 != 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise("")
    return table(spark, sf, "part").select("p_partkey", store.upload_uri(F.lit("b"), F.when(k % 2 == 0, "/base//app/").otherwise(""), F.col("p_type"), name).alias("uri"))


@query("SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 10)::BIGINT AS batch, len(embedding)::INT AS dense_size FROM embeddings")
def point_batches(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("dense_size"))
    return store.point_batches(e, "label", "vec_id", 10)


@query("SELECT l_linenumber, l_partkey, l_suppkey, o_orderkey + 1000000 AS report_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def report_children(spark, sf):
    parents = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") + 1_000_000).alias("report_id"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return frames.with_children(parents, items, ["o_orderkey"], "report_id")


@query("SELECT page_id FROM pages WHERE page_id % 31 = 4")
def files_of_day(spark, sf):
    from datetime import date

    from palimpsest.sources.files import of_day

    day = F.lpad((F.col("page_id") % 31 + 1).cast("string"), 2, "0")
    keys = table(spark, sf, "pages").select("page_id", F.concat(F.lit("x/a_202403"), day, F.lit(".pdf")).alias("key"))
    return of_day(keys, "key", date(2024, 3, 5)).select("page_id")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND ts >= TIMESTAMP '2024-01-03'")
def files_since(spark, sf):
    from datetime import date

    from palimpsest.sources.files import modified_since

    k = F.col("event_id") % 3
    files = table(spark, sf, "events").select("event_id", F.col("ts").alias("modificationTime"), F.when(k == 0, "a.txt").when(k == 1, "a.PDF").otherwise("b/a.pdf").alias("path"))
    return modified_since(files, date(2024, 1, 3)).select("event_id")


@query("""
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'b' || page_id END AS bucket, CASE page_id % 3 WHEN 0 THEN 'k/x.pdf' WHEN 1 THEN 'k' ELSE 'rel/x' END AS key FROM pages""")
def object_uris(spark, sf):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    uri = F.when(k == 0, F.concat(F.lit("arn:aws:s3:::b"), n, F.lit("/k/x.pdf"))).when(k == 1, F.concat(F.lit("s3://b"), n, F.lit("/k"))).otherwise("rel/x")
    bucket, key = text.uri_parts(uri)
    return table(spark, sf, "pages").select("page_id", bucket.alias("bucket"), key.alias("key"))


@query("""
SELECT n.doc_id AS new_id, o.doc_id AS old_id, coalesce(CASE WHEN n.doc_id % 3 = 0 THEN 0.9 END, 0.5)::DOUBLE AS confidence
FROM documents n JOIN documents o ON o.doc_id = n.doc_id // 2 WHERE n.doc_id % 2 = 0""")
def injected_matches(spark, sf):
    d = table(spark, sf, "documents")
    new, old = d.select(F.col("doc_id").alias("new_idx"), F.col("doc_id").alias("new_id")), d.select(F.col("doc_id").alias("old_idx"), F.col("doc_id").alias("old_id"))
    given = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("new_idx"), F.expr("doc_id div 2").alias("old_idx"), F.when(F.col("doc_id") % 3 == 0, F.lit(0.9)).alias("confidence"))
    out_of_range = given.select((-F.col("new_idx") - 1).alias("new_idx"), "old_idx", "confidence")
    return changes.injected_matches(new, old, given.union(out_of_range)).select("new_id", "old_id", "confidence")


@query("""
SELECT source, doc_id, left(text, 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 10""")
def capped_blocks(spark, sf):
    return frames.capped(table(spark, sf, "documents").select("source", "doc_id", "text"), ["source"], [F.col("doc_id").asc()], 10, "text", 200)
