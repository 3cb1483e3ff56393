"""Change detection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scores, text
from palimpsest.operators import changes, frames, similar, versions
from palimpsest.plans.registry import query
from palimpsest.sources.files import table

_SECTION = "concat('§ 11', doc_id % 7, '.', doc_id % 5, '(a)')"
_LEVEL = "CASE WHEN c >= 0.8 THEN 'HIGH' WHEN c >= 0.5 THEN 'MEDIUM' WHEN c >= 0.4 THEN 'LOW' ELSE 'UNCERTAIN' END"


def _section(doc_id="doc_id"):
    return F.concat(F.lit("§ 11"), (F.col(doc_id) % 7).cast("string"), F.lit("."), (F.col(doc_id) % 5).cast("string"), F.lit("(a)"))


def _confidence():
    return F.round(F.col("value") / 500, 4)


@query(f"SELECT doc_id, regexp_extract(regexp_replace({_SECTION}, '[§\\s]', '', 'g'), '\\d+\\.\\d+') AS section FROM documents")
def section_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.section_key(_section()).alias("section"))


@query("""
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], ',') AS words FROM (
  SELECT doc_id, list_concat(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda x: regexp_matches(x, '\\p{Nd}'))[1:3], list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))[1:3]) AS w FROM documents)""")
def keyword_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), ",").alias("words"))


@query(f"""
WITH s AS (SELECT l.doc_id, {_SECTION} AS section, ((l.doc_id * 37) % 100) / 100.0 AS score FROM (SELECT DISTINCT doc_id FROM labels) l)
SELECT section, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, doc_id) AS k FROM s) WHERE k = 1""")
def section_dedup_best(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id").distinct().select("doc_id", _section().alias("section"), ((F.col("doc_id") * 37 % 100) / 100).alias("score"))
    return frames.best_wins(rows, ["section"], "score", "doc_id").select("section", "doc_id")


@query(f"SELECT {_SECTION} AS section, max(doc_id) AS doc_id FROM labels WHERE toxic = 0 GROUP BY 1")
def section_index_last(spark, sf):
    rows = table(spark, sf, "labels").filter("toxic = 0").select("doc_id", _section().alias("section"))
    return rows.groupBy("section").agg(F.max_by("doc_id", "doc_id").alias("doc_id"))


@query(f"""
WITH e AS (SELECT event_id, round(value / 500, 4) AS base, CASE WHEN event_id % 3 = 0 THEN floor(value / 600 * 1000) / 1000 END AS adv, event_id % 4 = 0 AS num FROM events),
a AS (SELECT event_id, CASE WHEN num THEN least(coalesce(adv, base) + 0.1, 1.0) ELSE coalesce(adv, base) END AS c FROM e)
SELECT event_id, round(c, 6) AS confidence, {_LEVEL} AS level FROM a""")
def confidence_levels(spark, sf):
    e = table(spark, sf, "events").select("event_id", _confidence().alias("base"), F.when(F.col("event_id") % 3 == 0, F.floor(F.col("value") / 600 * 1000) / 1000).alias("adv"), (F.col("event_id") % 4 == 0).alias("num"))
    c = scores.adjusted_confidence(F.col("base"), F.col("adv"), F.col("num"))
    return e.select("event_id", F.round(c, 6).alias("confidence"), scores.confidence_level(c).alias("level"))


@query("SELECT event_id, round(value / 500, 4) AS confidence FROM events WHERE CASE WHEN event_id % 2 = 0 THEN round(value / 500, 4) >= 0.5 ELSE round(value / 500, 4) >= 0.55 END")
def confidence_filter(spark, sf):
    e = table(spark, sf, "events").select("event_id", _confidence().alias("confidence"))
    return e.filter(scores.passes_confidence(F.col("event_id") % 2 == 0, F.col("confidence")))


@query("""
WITH e AS (SELECT event_id, event_id % 5 = 0 AS flag, CASE event_id % 6 WHEN 0 THEN 'Changed' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'NEW' WHEN 3 THEN 'same' ELSE NULL END AS status,
  coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(value / 500, 4) END, 0), nullif(round(value / 700, 4), 0), 0.0) AS c FROM events)
SELECT event_id, CASE WHEN lower(coalesce(status, '')) = 'inconclusive' THEN 'pending'
  WHEN (flag OR lower(coalesce(status, '')) IN ('changed', 'updated', 'new', 'modified', 'added')) AND c >= 0.7 THEN 'actionable'
  WHEN (flag OR lower(coalesce(status, '')) IN ('changed', 'updated', 'new', 'modified', 'added')) AND c >= 0.5 THEN 'pending' ELSE 'dropped' END AS triage FROM e""")
def change_triage(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_id") % 6 == 0, "Changed").when(F.col("event_id") % 6 == 1, "inconclusive").when(F.col("event_id") % 6 == 2, "NEW").when(F.col("event_id") % 6 == 3, "same")
    first = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(_confidence())
    c = scores.truthy(first, F.round(F.col("value") / 700, 4))
    return e.select("event_id", scores.triage(F.col("event_id") % 5 == 0, status, c).alias("triage"))


@query(f"""
WITH e AS (SELECT event_type, event_id % 3 <> 0 AS changed, round(value / 500, 4) AS c FROM events)
SELECT event_type, count(*) AS total, count(*) FILTER (changed) AS changed, count(*) FILTER (({_LEVEL}) = 'HIGH') AS high_confidence, count(*) FILTER (({_LEVEL}) = 'HIGH' AND changed) AS high_confidence_changed FROM e GROUP BY 1""")
def change_summary(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("event_id") % 3 != 0).alias("change_detected"), scores.confidence_level(_confidence()).alias("level"))
    return changes.change_summary(e, "event_type")


_PAIRS = """
WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, text FROM documents),
w AS (SELECT DISTINCT source, doc_id, seq, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM s),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
j AS (SELECT a.source, a.doc_id AS new_id, b.doc_id AS old_id, count(*) AS shared FROM w a JOIN w b ON a.source = b.source AND a.word = b.word AND a.seq % 2 = 1 AND b.seq % 2 = 0 GROUP BY ALL)
"""


def _blocks(spark, sf):
    """Documents of odd and of even number in their source; ids are numbered alone, texts are joined to them."""
    docs = table(spark, sf, "documents")
    numbers = versions.numbered(docs, ["source"], "doc_id").select("doc_id", "seq")
    rows = docs.select("doc_id", "source", "text").join(numbers, "doc_id")
    words = lambda some: some.select("doc_id", "source", F.split(F.lower("text"), r"\s+").alias("words"))
    return words(rows.filter("seq % 2 = 1")), words(rows.filter("seq % 2 = 0"))


@query(_PAIRS + "SELECT source, new_id, old_id, round(shared / (a.n + b.n - shared), 6) AS score FROM j JOIN n a ON a.doc_id = new_id JOIN n b ON b.doc_id = old_id WHERE shared / (a.n + b.n - shared) >= 0.3")
def jaccard_candidates(spark, sf):
    new, old = _blocks(spark, sf)
    return similar.similar_pairs(new, old, "source", "doc_id", "words", changes.MIN_JACCARD).select("source", "new_id", "old_id", F.round("score", 6).alias("score"))


@query()
def jaccard_greedy_match(spark, sf):
    new, old = _blocks(spark, sf)
    return similar.greedy_similar(new, old, "source", "doc_id", "words", 0.1)


@query("""
WITH c AS (SELECT doc_id AS change_id, doc_id % 11 AS section, doc_id % 40 AS chunk, doc_id % 17 AS doc FROM documents WHERE doc_id % 4 < 2),
k AS (SELECT doc_id AS candidate, doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN doc_id % 30 END AS section, doc_id % 400 AS chunk, doc_id % 17 AS doc FROM documents WHERE doc_id % 4 >= 2),
m AS (SELECT change_id, candidate, pos, 1 AS priority FROM c JOIN k USING (section) UNION ALL SELECT change_id, candidate, pos, 2 FROM c JOIN k USING (chunk) UNION ALL SELECT change_id, candidate, pos, 3 FROM c JOIN k USING (doc))
SELECT change_id, candidate, pos AS candidate_pos, priority FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY priority, pos, candidate) AS r FROM m) WHERE r = 1""")
def change_match_priority(spark, sf):
    """All documents: two changes, then two candidates, by turns of doc_id."""
    d = table(spark, sf, "documents").select("doc_id")
    c = d.filter("doc_id % 4 < 2").selectExpr("doc_id AS change_id", "doc_id % 11 AS section", "doc_id % 40 AS chunk", "doc_id % 17 AS doc")
    k = d.filter("doc_id % 4 >= 2").selectExpr("doc_id AS candidate", "doc_id AS pos", "CASE WHEN doc_id % 2 = 0 THEN doc_id % 30 END AS section", "doc_id % 400 AS chunk", "doc_id % 17 AS doc")
    return changes.match_by_priority(c, k, ["section", "chunk", "doc"], "candidate")


@query("""
WITH p AS (SELECT doc_id, 1 + doc_id % 3 AS page_num, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, page_num::INT AS page_num, concat('§ ', b) AS section_ref, array_to_string(ls[(b * 2 + 1):(CASE WHEN b = 2 THEN b * 2 + 20 ELSE b * 2 + 2 END)], chr(10)) AS body
FROM p, (SELECT unnest([0, 1, 2]) AS b) WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, page_num::INT, concat('Page ', page_num), left(text, 500) FROM p WHERE doc_id % 2 = 1""")
def reference_blocks(spark, sf):
    block = F.array(*(F.struct(F.lit(f"§ {b}").alias("section_ref"), F.lit(2 * b).alias("start_line"), F.lit(2 * b + 2 if b < 2 else 0).alias("end_line"), F.array().cast("array<string>").alias("keywords")) for b in range(3)))
    pages = table(spark, sf, "documents").select("doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("page_num"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, block).alias("blocks"))
    return changes.reference_blocks(pages).select("doc_id", "page_num", "section_ref", "body")


@query("""
WITH s AS (SELECT doc_id, source, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old_text, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS old_id FROM documents),
n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(coalesce(old_text, ''), '\\s+', ' ', 'g'))) AS b,
  list_sort(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS x, list_sort(regexp_extract_all(coalesce(old_text, ''), '\\d+(?:\\.\\d+)?')) AS y FROM s)
SELECT doc_id, old_id, CASE WHEN old_text IS NULL THEN 'new_clause' WHEN a = b THEN 'none' WHEN x <> y THEN 'value_change' ELSE 'wording_only' END AS change_type FROM n""")
def change_verdicts(spark, sf):
    return changes.verdicts(_with_previous(spark, sf)).select("doc_id", "old_id", "change_type")


def _with_previous(spark, sf):
    """Every document beside the one before in its source: ids are paired, and texts then joined by id."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    pairs = versions.previous(docs, ["source"], "doc_id").withColumnRenamed("previous", "old_id")
    old = docs.select(F.col("doc_id").alias("old_id"), F.col("text").alias("old_text"))
    return pairs.join(docs.select("doc_id", F.col("text").alias("new_text")), "doc_id").join(old, "old_id", "left")


@query("SELECT doc_id, true AS needs_embedding FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 3 = 0 AND b.source = a.source AND b.lang = a.lang) AND doc_id % 3 <> 0")
def new_without_legacy(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("k"), (F.col("doc_id") % 3).alias("m"))
    return changes.without_legacy(d.filter("m <> 0"), d.filter("m = 0"), "k").select("doc_id", "needs_embedding")


@query("""
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'kept' WHEN l.quality = 1 THEN 'rerun' ELSE 'manual_no_change' END AS status, CASE WHEN l.quality IS NULL THEN d.doc_id % 2 = 0 ELSE false END AS change_detected
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def manual_feedback(spark, sf):
    results = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("change_detected"))
    flags = table(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("manual_change"))
    return changes.with_feedback(results, flags, "doc_id").select("doc_id", "status", "change_detected")


@query(f"""
WITH s AS (SELECT source, doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old_text FROM documents),
w AS (SELECT source, doc_id, list_distinct(regexp_split_to_array(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) AS a, list_distinct(regexp_split_to_array(lower(trim(regexp_replace(old_text, '\\s+', ' ', 'g'))), ' ')) AS b FROM s WHERE old_text IS NOT NULL),
c AS (SELECT source, 1 - len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS c FROM w)
SELECT source, count(*) AS n, count(*) FILTER (({_LEVEL}) = 'HIGH') AS high, round(avg(c), 6) AS mean FROM c GROUP BY 1""")
def source_changes(spark, sf):
    """The flagship: how far each document of a source is from the one before."""
    words = lambda c: F.array_distinct(F.split(F.lower(text.collapse_space(F.col(c))), " "))
    c = _with_previous(spark, sf).filter("old_text is not null").select("source", (1 - text.jaccard(words("new_text"), words("old_text"))).alias("c"))
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(scores.confidence_level(F.col("c")) == "HIGH").alias("high"), F.round(F.avg("c"), 6).alias("mean"))


@query("""
WITH f AS (SELECT DISTINCT l.doc_id, l.quality FROM labels l)
SELECT d.doc_id, f.quality AS prior FROM documents d LEFT JOIN (SELECT doc_id, min(quality)  AS quality FROM f GROUP BY 1) f USING (doc_id)""")
def prior_verdicts(spark, sf):
    prior = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("prior"))
    return changes.previous_verdict(table(spark, sf, "documents").select("doc_id"), prior, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_run(spark, sf):
    return changes.not_yet_run(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
