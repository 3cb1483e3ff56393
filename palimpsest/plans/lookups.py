"""Filters, paging, top rows, versions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import frames, reports, versions
from palimpsest.plans.registry import query
from palimpsest.sources.files import table


@query("SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def count_by_country(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "country")
    return reports.count_by(joined, "country").orderBy(F.desc("n"), "country")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def json_path_filter(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return frames.optional(rows, k=7)


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type ILIKE '%c%' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 3 ORDER BY ts DESC, event_id LIMIT 25 OFFSET 10")
def json_multi_filter_page(spark, sf):
    rows = table(spark, sf, "events").filter(F.col("event_type").ilike("%c%") & (F.get_json_object("props", "$.k").cast("long") >= 3))
    return rows.orderBy(F.desc("ts"), "event_id").offset(10).limit(25).select("event_id", "event_type", "user_id")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def date_range_latest(spark, sf):
    rows = frames.between(table(spark, sf, "orders"), "o_orderdate", "1995-01-01", "1996-12-31")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT source, max(doc_id) AS doc_id FROM documents WHERE doc_id <> (SELECT max(doc_id) FROM documents) GROUP BY source")
def top1_excluding(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    last = docs.agg(F.max("doc_id").alias("last"))
    return frames.top_per(docs.join(F.broadcast(last), F.col("doc_id") != F.col("last")), ["source"], [F.desc("doc_id")]).select("source", "doc_id")


@query("SELECT p_partkey, s_suppkey, upper(translate(p_brand, '- ', '')) AS brand_key FROM part JOIN supplier ON right(upper(translate(p_brand, '- ', '')), 2) = right(upper(translate(s_name, '- #', '')), 2)")
def normalized_key_match(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", text.citation_key(F.col("p_brand")).alias("brand_key"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.right(F.upper(F.translate("s_name", "- #", "")), F.lit(2)).alias("_tail"))
    return p.join(s, F.right("brand_key", F.lit(2)) == F.col("_tail")).select("p_partkey", "s_suppkey", "brand_key")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'steel')")
def glossary_search(spark, sf):
    rows = table(spark, sf, "part")
    return frames.search(rows, "an", "p_name").select("p_partkey", "p_name").union(frames.search(rows, "steel", "p_type").select("p_partkey", "p_name")).distinct()


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 ORDER BY c_custkey LIMIT 20 OFFSET 40")
def paged_scan(spark, sf):
    return frames.page(table(spark, sf, "customer").filter("c_acctbal >= 0").select("c_custkey"), "c_custkey", 40, 20)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT -c_custkey, 'ADDED' FROM customer WHERE c_custkey < 5")
def upsert_delete(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = base.filter("c_custkey % 10 = 0").withColumn("segment", F.lit("CHANGED"))
    added = base.filter("c_custkey < 5").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("ADDED").alias("segment"))
    kept = frames.delete(frames.upsert(base, changed, ["c_custkey"]), base.filter("c_custkey % 7 = 0"), ["c_custkey"])
    return frames.upsert(kept, added, ["c_custkey"])


@query("""
SELECT coalesce(o.source, n.source) AS source, coalesce(o.seq, n.seq) AS seq, o.doc_id AS old_doc_id, n.doc_id AS new_doc_id
FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, doc_id FROM documents WHERE doc_id % 3 = 0) o
FULL JOIN (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, doc_id FROM documents WHERE doc_id % 3 <> 0) n ON o.source = n.source AND o.seq = n.seq""")
def version_pair_full_outer(spark, sf):
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").select("source", "doc_id")
    numbered = lambda d: d.withColumn("seq", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    return versions.pair_full_outer(numbered(docs.filter("doc_id % 3 = 0")), numbered(docs.filter("doc_id % 3 <> 0")), ["source", "seq"], "doc_id")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, max(CASE WHEN k = 1 THEN o_orderkey END) AS latest, max(CASE WHEN k = 2 THEN o_orderkey END) AS previous FROM r WHERE k <= 2 GROUP BY 1""")
def latest_and_previous(spark, sf):
    return versions.latest_and_previous(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderkey")


@query("SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next_version FROM lineitem GROUP BY 1")
def next_version(spark, sf):
    return versions.next_version(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
SELECT a.o_orderkey, (SELECT max(struct_pack(d := b.o_orderdate, k := b.o_orderkey)).k FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate) AS found_o_orderkey FROM orders a""")
def legacy_asof(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return versions.as_of(orders, orders, ["o_custkey"], "o_orderdate", "o_orderdate", ["o_orderkey"]).select("o_orderkey", "found_o_orderkey")


@query("""
WITH j AS (SELECT a.o_orderkey, b.o_orderkey AS found_id, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS k
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND strftime(b.o_orderdate, '%m%d') < strftime(a.o_orderdate, '%m%d'))
SELECT o_orderkey, found_id FROM j WHERE k = 1""")
def legacy_month_day(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    right = orders.select("o_custkey", F.col("o_orderkey").alias("found_id"), F.col("o_orderdate").alias("found_time"))
    found = versions.month_day_before(orders, right, ["o_custkey"], "o_orderdate", "found_time", "o_orderkey", "found_id", [F.desc("found_time"), F.desc("found_id")])
    return found.filter("found_id is not null").select("o_orderkey", "found_id")


@query("""
WITH d AS (SELECT doc_id, source, lang, n_chars, text FROM documents), n AS (SELECT * FROM d WHERE doc_id % 4 = 3), o AS (SELECT * FROM d WHERE doc_id % 4 <> 3),
c AS (
  SELECT n.doc_id, o.doc_id AS found_id, 1 AS priority FROM n JOIN o ON n.source = o.source AND n.text = o.text AND o.doc_id < n.doc_id
  UNION ALL SELECT n.doc_id, o.doc_id, 2 FROM n JOIN o ON lower(left(n.text, 40)) = lower(left(o.text, 40)) AND o.doc_id < n.doc_id
  UNION ALL SELECT n.doc_id, o.doc_id, 3 FROM n JOIN o ON n.source = o.source AND n.lang = o.lang AND n.n_chars // 100 = o.n_chars // 100 AND o.doc_id < n.doc_id
  UNION ALL SELECT n.doc_id, o.doc_id, 4 FROM n JOIN o ON n.source = o.source AND o.lang = n.lang AND o.doc_id < n.doc_id AND o.n_chars > 1000),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, found_id DESC) AS k FROM c)
SELECT n.doc_id, r.found_id, r.priority FROM n LEFT JOIN r ON n.doc_id = r.doc_id AND k = 1""")
def legacy_cascade(spark, sf):
    docs = table(spark, sf, "documents")
    body = F.sha2("text", 256).alias("body")
    head = F.lower(F.left("text", F.lit(40))).alias("head")
    cols = ["doc_id", "source", "lang", "n_chars"]
    d = docs.select(*cols, body, head, F.floor(F.col("n_chars") / 100).alias("size"))
    new = d.filter("doc_id % 4 = 3")
    old = d.filter("doc_id % 4 <> 3").withColumnRenamed("doc_id", "found_id")
    earlier = F.col("found_id") < F.col("doc_id")
    last = lambda keys, rows=old: new.select("doc_id", *keys).join(rows.select("found_id", *keys), keys).filter(earlier).groupBy("doc_id").agg(F.max("found_id").alias("found_id"))
    return versions.cascade(new, "doc_id", [last(["source", "body"]), last(["head"]), last(["source", "lang", "size"]), last(["source", "lang"], old.filter("n_chars > 1000"))], [F.desc("found_id")])


@query("SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def exists_semi(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("""
WITH p AS (SELECT url, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS parts FROM pages)
SELECT url, parts[-1] AS name, parts[-2] AS country, regexp_replace(lower(parts[1]), '[^a-z0-9]+', '-', 'g') AS title FROM p WHERE parts[-1] <> ''""")
def object_listing(spark, sf):
    from palimpsest.sources.files import object_rows

    keys = table(spark, sf, "pages").select("url", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "").alias("key"))
    rows = object_rows(keys, "key")
    return rows.select("url", "name", "country", F.regexp_replace(F.lower(F.split("key", "/")[0]), "[^a-z0-9]+", "-").alias("title"))


@query("""
WITH t AS (SELECT page_id, 'Page (' || page_id || ') Title' AS title, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS tail FROM pages),
n AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN tail = '' THEN title ELSE tail END, '[\\\\/:*?\"<>|]', '_', 'g'), '\\s+', '_', 'g') AS safe FROM t)
SELECT page_id, left(safe, 200) || '.pdf' AS name, 'raw/' || page_id || '/' || replace(regexp_replace(lower(title), '[()]', '', 'g'), ' ', '-') AS path FROM n""")
def file_names(spark, sf):
    p = table(spark, sf, "pages")
    title = F.concat(F.lit("Page ("), F.col("page_id").cast("string"), F.lit(") Title"))
    return p.select("page_id", text.file_name(F.lit(None).cast("string"), F.col("url"), title).alias("name"), text.object_key(F.lit("raw"), F.lit(""), F.col("page_id").cast("string"), text.title_key(title)).alias("path"))


@query("SELECT n.doc_id FROM documents n WHERE n.doc_id % 2 = 1 AND md5(n.text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def content_dedup_md5(spark, sf):
    from palimpsest.sources.files import new_content

    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(0).alias("k"))
    stored = docs.filter("doc_id % 2 = 0").select("k", F.md5(F.col("text").cast("binary")).alias("md5")).distinct()
    return new_content(docs.filter("doc_id % 2 = 1"), stored, "k", "text").select("doc_id")


@query("SELECT doc_id FROM documents a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND md5(concat_ws('_', b.source, b.n_chars, b.lang)) = md5(concat_ws('_', a.source, a.n_chars, a.lang)))")
def file_dedup(spark, sf):
    from palimpsest.sources.files import new_files

    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), F.col("n_chars").alias("size"), F.col("lang").alias("modified"))
    return new_files(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")).select("doc_id")


@query("SELECT doc_id, sha256(text) AS sha256, length(text)::INT AS n_chars, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))::INT AS n_words FROM documents")
def text_metadata(spark, sf):
    from palimpsest.sources.files import text_metadata as meta

    return table(spark, sf, "documents").select("doc_id", meta(F.col("text")).alias("m")).select("doc_id", "m.*")


@query("SELECT c_custkey, o_orderkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def eager_children(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    grouped = c.join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.collect_list("o_orderkey").alias("orders"), F.count(F.lit(1)).alias("n"))
    return grouped.select("c_custkey", F.explode_outer("orders").alias("o_orderkey"), "n")
