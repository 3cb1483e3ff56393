"""Chunking, pages and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import html, scores, text
from palimpsest.operators import chunking, graphs
from palimpsest.plans.registry import query
from palimpsest.sources.files import table


def _markdown():
    """Every fifth line of a document as a header."""
    lines = F.split("text", "\n")
    return F.array_join(F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (i / 5 % 3 + 1).cast("int")), F.lit(" "), F.left(x, F.lit(30)))).otherwise(x)), "\n")


@query()
def chunk_headers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _markdown().alias("md"))
    return chunking.header_chunks(d, "doc_id", "md").select("doc_id", "pos", F.array_join("hierarchy", " > ").alias("path"), F.length("body").alias("n_chars"))


@query()
def chunk_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return chunking.limited_chunks(d, "body", 200, 300, 50).select("doc_id", "part", F.length("part_body").alias("n_chars"))


@query()
def chunk_pack(spark, sf):
    return chunking.packed_chunks(table(spark, sf, "documents"), "doc_id", "text", 1000).select("doc_id", "pos", F.length("chunk").alias("n_chars"))


@query("""
SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Table' ELSE 'Chunk' END || lpad(row_number() OVER (PARTITION BY source ORDER BY doc_id % 5, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, doc_id)::VARCHAR, 4, '0') AS chunk_name FROM documents""")
def chunk_ids(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", (F.col("doc_id") % 5).alias("page"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("text").alias("kind"), F.col("doc_id").alias("pos"))
    return chunking.numbered(d, "source").select("source", "doc_id", "chunk_name")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE source || ' > ' || lang || chr(10) || chr(10) || text END AS body FROM documents")
def context_inject(spark, sf):
    path = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang"))
    return table(spark, sf, "documents").select("doc_id", text.with_context(path, F.col("text")).alias("body"))


@query("SELECT r_regionkey, '**' || r_name || '**' || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END || ' |', chr(10) ORDER BY n_nationkey) AS md FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def table_to_markdown(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name")))).alias("rows"))
    rows = F.transform("rows", lambda r: F.array(r["n_nationkey"].cast("string"), r["name"]))
    joined = table(spark, sf, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("r_regionkey", text.table_markdown(F.col("r_name"), F.array(F.lit("key"), F.lit("name")), rows).alias("md"))


@query("SELECT doc_id, CASE WHEN contains(text, 'xq') THEN 'xq' WHEN contains(text, 'th') THEN 'th' WHEN contains(text, 'de') THEN 'de' END AS section FROM documents")
def chunk_sections(spark, sf):
    refs = F.array(*map(F.lit, ["", "xq", "th", "de"]))
    return table(spark, sf, "documents").select("doc_id", chunking.chunk_section(refs, F.col("text")).alias("section"))


_ENTITIES = """
e AS (SELECT n_regionkey AS doc, n_nationkey * 10 AS pos, n_name AS name, 'Organization' AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'a' END AS context FROM nation
  UNION ALL SELECT r_regionkey, 1, r_name, 'Regulation', 'a' FROM region UNION ALL SELECT n_regionkey, n_nationkey * 10 + 3, lower(n_name), 'Organization', '' FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT s_suppkey % 5, 1000 + s_suppkey, s_name, 'Chemical', 'b' FROM supplier)"""
_EDGES = """
g AS (SELECT a.doc, a.name AS source, b.name AS target, 'enforces' AS relation FROM e a JOIN e b ON a.doc = b.doc AND a.type = 'Organization' AND b.type = 'Regulation'
  UNION ALL SELECT a.doc, a.name, b.name, 'regulates' FROM e a JOIN e b ON a.doc = b.doc AND a.type = 'Regulation' AND b.type = 'Chemical'
  UNION ALL SELECT doc, name, t, 'related_to' FROM (SELECT *, lead(name) OVER (PARTITION BY doc, coalesce(nullif(context, ''), 'unknown') ORDER BY pos) AS t FROM e) WHERE t IS NOT NULL)"""


def _entities(spark, sf):
    n = table(spark, sf, "nation")
    a = n.selectExpr("n_regionkey AS doc", "n_nationkey * 10 AS pos", "n_name AS name", "'Organization' AS type", "CASE WHEN n_nationkey % 2 = 0 THEN 'a' END AS context")
    b = table(spark, sf, "region").selectExpr("r_regionkey AS doc", "1 AS pos", "r_name AS name", "'Regulation' AS type", "'a' AS context")
    c = n.filter("n_nationkey % 3 = 0").selectExpr("n_regionkey AS doc", "n_nationkey * 10 + 3 AS pos", "lower(n_name) AS name", "'Organization' AS type", "'' AS context")
    d = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey % 5 AS INT) AS doc", "CAST(1000 + s_suppkey AS INT) AS pos", "s_name AS name", "'Chemical' AS type", "'b' AS context")
    return a.union(b).union(c).union(d).withColumn("doc", F.col("doc").cast("long"))


@query(f"WITH {_ENTITIES} SELECT doc, name, type FROM (SELECT *, row_number() OVER (PARTITION BY doc, lower(name), type ORDER BY pos) AS k FROM e) WHERE k = 1")
def entity_nodes(spark, sf):
    return graphs.nodes(_entities(spark, sf), "doc").select("doc", "name", "type")


@query(f"WITH {_ENTITIES}, {_EDGES} SELECT * FROM g")
def entity_graph(spark, sf):
    return graphs.edges(_entities(spark, sf), "doc")


@query(f"WITH {_ENTITIES}, {_EDGES}, n AS (SELECT doc, count(DISTINCT name) AS n_nodes FROM e GROUP BY 1), m AS (SELECT doc, count(*) AS n_edges FROM (SELECT DISTINCT doc, source, target FROM g) GROUP BY 1) SELECT doc, n_nodes, coalesce(n_edges, 0) AS n_edges, round(CASE WHEN n_nodes > 1 THEN coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 8) AS density FROM n LEFT JOIN m USING (doc)")
def graph_density(spark, sf):
    e = _entities(spark, sf)
    return graphs.summary(e, graphs.edges(e, "doc"), "doc").withColumn("density", F.round("density", 8))


@query("""
SELECT conv_id, turn, CASE WHEN n = 0 THEN NULL ELSE (array_agg(v) FILTER (v IS NOT NULL) OVER w)[1] END AS title FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN left(text, 10) END AS v, count(CASE WHEN turn % 2 = 1 THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def metadata_carry_forward(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.left("text", F.lit(10))).alias("title"))
    return chunking.carry_forward(c, "conv_id", "turn", ["title"])


@query("SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM conversations) WHERE spent <= 800")
def token_budget(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("tokens"))
    return chunking.within_budget(c, "conv_id", "turn", "tokens", 800).select("conv_id", "turn", "spent")


@query("SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY conv_id, m ORDER BY turn) - 1) / CASE WHEN m = 'x-mini' THEN 5 ELSE 2 END)::BIGINT AS batch FROM (SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN 'x-mini' ELSE 'x' END AS m FROM conversations)")
def model_batches(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length("text") % 2 == 0, "x-mini").otherwise("x").alias("m"))
    return chunking.model_batches(c, ["conv_id"], "turn", "m").select("conv_id", "turn", "batch")


@query("""
WITH c AS (SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) / 3 AS h, (length(html) - length(replace(html, '<li>', ''))) / 4 AS v, page_id % 2 = 0 AS t FROM pages),
x AS (SELECT page_id, t, CASE WHEN t THEN least(0.5::DOUBLE + h * v / 1000, 1.0) ELSE 0.1::DOUBLE END AS c FROM c)
SELECT page_id, round(c, 6) AS complexity, CASE WHEN c >= 0.3 THEN 'large' ELSE 'mini' END AS model, CASE WHEN t OR c >= 0.3 THEN 300 ELSE 150 END AS dpi FROM x""")
def page_complexity_route(spark, sf):
    count = lambda tag: (F.length("html") - F.length(F.replace(F.col("html"), F.lit(tag), F.lit("")))) / len(tag)
    t = F.col("page_id") % 2 == 0
    c = scores.page_complexity(t, count("<p>"), count("<li>"))
    model, dpi = scores.page_route(c, t)
    return table(spark, sf, "pages").select("page_id", F.round(c, 6).alias("complexity"), model.alias("model"), dpi.alias("dpi"))


@query()
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query("""
WITH d AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024.1.5' WHEN 1 THEN '2023-11-07' WHEN 2 THEN '99/3/21' WHEN 3 THEN '20240131 rev' ELSE 'no date' END AS s FROM pages),
p AS (SELECT page_id, s, list_filter(regexp_split_to_array(s, '[^0-9]+'), lambda x: x <> '') AS g FROM d)
SELECT page_id, CASE WHEN len(g) >= 3 THEN lpad(CASE WHEN g[1]::INT < 100 THEN g[1]::INT + 2000 ELSE g[1]::INT END::VARCHAR, 4, '0') || lpad(g[2], 2, '0') || lpad(g[3], 2, '0') WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) >= 8 THEN left(regexp_replace(s, '[^0-9]', '', 'g'), 8) ELSE '20240101' END AS day FROM p""")
def publish_date(spark, sf):
    k = F.col("page_id") % 5
    s = F.when(k == 0, "2024.1.5").when(k == 1, "2023-11-07").when(k == 2, "99/3/21").when(k == 3, "20240131 rev").otherwise("no date")
    return table(spark, sf, "pages").select("page_id", html.compact_date(s, "20240101").alias("day"))


@query("SELECT doc_id, n AS article, pos::INT AS line_no, CASE WHEN o THEN 'article' WHEN regexp_matches(line, '^\\(?\\d+\\)?') THEN 'section' ELSE 'text' END AS kind FROM (SELECT *, count(*) FILTER (o) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT doc_id, pos, line, regexp_matches(line, '(?i)^Article\\s+\\d+') AS o FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, CASE WHEN generate_subscripts(ls, 1) % 4 = 1 THEN 'Article ' || generate_subscripts(ls, 1) || ' x' WHEN generate_subscripts(ls, 1) % 4 = 2 THEN '(1) ' || unnest(ls) ELSE unnest(ls) END AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))")
def article_blocks(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("Article "), (i + 1).cast("string"), F.lit(" x"))).when(i % 4 == 1, F.concat(F.lit("(1) "), x)).otherwise(x))
    d = table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("body"))
    return chunking.articles(d, "doc_id", "body").select("doc_id", "article", "line_no", "kind")


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 100) || ' ' || substr(text, (floor(length(text) / 2) - 50 + 1)::BIGINT, 100) || ' ' || right(text, 100) ELSE text END AS sample FROM documents")
def sample_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.sample_parts(F.col("text"), 300).alias("sample"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE CASE WHEN n >= 5 THEN p BETWEEN floor(n / 2) AND floor(n / 2) + 2 WHEN n = 4 THEN p <= 3 ELSE true END")
def sample_pages(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("p"))
    return chunking.sampled_pages(c, "conv_id", "p").select("conv_id", "turn")
