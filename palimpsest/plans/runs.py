"""The two long runs: change detection of a document against the one before, and mapping of changes onto products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import jsonx, scores, text
from palimpsest.operators import changes, checks, frames, mapping, reports, retrieval, versions
from palimpsest.operators.workflow import Workflow
from palimpsest.plans.registry import query
from palimpsest.sources import store
from palimpsest.sources.files import table


def detect_changes(blocks: DataFrame, matches: DataFrame | None = None, max_blocks: int | None = None) -> dict[str, DataFrame]:
    """All results, filtered results, summary and index.

    ``max_blocks`` of each side are compared where it is given (a model's prompt
    holds ``changes.MAX_BLOCKS``); without it, all are.

    ``blocks``: pair_id, side (old or new), block_id, section_ref, body,
    keywords. Blocks match by keywords unless a table of matches is given; new
    blocks without a match are new clauses.
    """
    if max_blocks is not None:
        w = Window.partitionBy("pair_id", "side").orderBy("block_id")
        blocks = blocks.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_blocks)
    new, old = blocks.filter("side = 'new'"), blocks.filter("side = 'old'")
    if matches is None:
        matches = changes.greedy_matches(changes.block_candidates(new, old, "pair_id", "block_id", "keywords"), "pair_id")
    a = new.select("pair_id", F.col("block_id").alias("new_id"), "section_ref", F.col("body").alias("new_text"), F.col("keywords").alias("new_words"))
    b = old.select("pair_id", F.col("block_id").alias("old_id"), F.col("body").alias("old_text"), F.col("keywords").alias("old_words"))
    pairs = a.join(matches.select("pair_id", "new_id", "old_id"), ["pair_id", "new_id"], "left").join(b, ["pair_id", "old_id"], "left")
    judged = changes.verdicts(pairs).withColumn("has_numbers", F.col("change_type") == "value_change").withColumn("adversarial", F.lit(None).cast("double"))
    every = judged.withColumn("section", F.concat_ws("/", F.col("pair_id").cast("string"), text.section_key(F.col("section_ref")))).withColumn("pos", F.col("new_id"))
    best = frames.best_wins(every, ["section"], "confidence_score", "pos")
    c = scores.adjusted_confidence(F.col("confidence_score"), F.col("adversarial"), F.col("has_numbers"))
    leveled = best.withColumn("confidence", c).withColumn("level", scores.confidence_level(F.col("confidence"))).withColumn("words", F.array_sort(F.array_union(F.coalesce("new_words", F.array().cast("array<string>")), F.coalesce("old_words", F.array().cast("array<string>")))))
    kept = leveled.filter(scores.passes_confidence(F.col("change_detected"), F.col("confidence")))
    summary = changes.change_summary(kept, "pair_id").withColumn("needs_embedding", F.col("changed") > 0)
    return {"all": leveled, "results": kept, "summary": summary, "index": frames.last_wins(kept.filter("change_detected"), ["section"], "pos")}


def map_products(features: DataFrame, queries: DataFrame, points: DataFrame, changed: DataFrame, top_k: int = 10, alpha: float = 0.7, within: Column | None = None) -> dict[str, DataFrame]:
    """Mapping items and targets of a country's products; ``within`` narrows the points, to a country and a regulation.

    ``features``: product_id, feature, value, unit. ``queries``: a dense vector
    for each distinct feature. ``points``: point_id, embedding, doc_id, body.
    ``changed``: section, words, confidence. One search serves all products.
    """
    named = queries.select(F.col("feature").alias("query_id"), "embedding")
    words = retrieval.tokens(queries.select(F.col("feature").alias("query_id"), "query"), "query_id", "query").withColumnRenamed("n", "query_n")
    found = retrieval.hybrid_search(named, words, points, retrieval.occurrences(points, "point_id", "body"), top_k, alpha, within)
    # as few rows as queries times top_k
    ranked = F.broadcast(found).join(points.select("point_id", "doc_id", "body"), "point_id").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")))
    capped = mapping.cap_per_document(ranked, "query_id", "doc_id", "point_id", "pos")
    chunks = capped.select(F.col("query_id").alias("feature"), "point_id", "pos", F.split(F.lower("body"), r"\s+").alias("words"), F.regexp_extract("body", r"(\d+(?:\.\d+)?)", 1).alias("_number")).withColumn("required_value", F.nullif("_number", F.lit("")))
    items = mapping.mapped_items(features.drop("pos"), chunks)
    return {"items": items, "targets": mapping.targets(items, ["product_id", "feature"])}


#: More lines than a document has; a block's id is doc_id times this, and its line.
LINES = 1 << 28


def _pairs(spark, sf) -> DataFrame:
    """Lines of every document beside those of the one before in its source: a document is new in its own pair and old in the next.

    Ids are numbered alone; texts are joined to them.
    """
    docs = table(spark, sf, "documents")
    numbers = versions.numbered(docs, ["source"], "doc_id")
    sides = F.when(F.col("seq") < F.col("of"), F.array(F.lit("new"), F.lit("old"))).otherwise(F.array(F.lit("new")))
    roles = numbers.select("source", "seq", "doc_id", F.explode(sides).alias("side"))
    pair_id = F.concat_ws("/", "source", (F.col("seq") + F.when(F.col("side") == "old", 1).otherwise(0)).cast("string"))
    lines = roles.select("doc_id", "side", pair_id.alias("pair_id")).join(docs.select("doc_id", "text"), "doc_id").select("pair_id", "side", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "body"))
    section = F.concat(F.lit("§ "), F.col("i").cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"))
    return lines.select("pair_id", "side", (F.col("doc_id") * LINES + F.col("i")).alias("block_id"), section.alias("section_ref"), "body").withColumn("keywords", text.keywords(F.col("body")))


@query()
def change_detection_run(spark, sf):
    out = detect_changes(_pairs(spark, sf))
    return out["results"].select("pair_id", "section", "change_type", "level", F.round("confidence", 6).alias("confidence"))


@query()
def product_mapping_run(spark, sf):
    e = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents")
    points = e.join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("point_id"), "embedding", (F.col("doc_id") % 50).alias("doc_id"), F.col("text").alias("body"))
    names = spark.createDataFrame([(0, "nicotine", "the concentration"), (1, "label", "warning text"), (2, "tar", "of the mg")], "k long, feature string, query string")
    queries = names.join(e, F.col("k") == F.col("vec_id")).select("feature", "query", "embedding")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").alias("nicotine"), F.col("p_brand").alias("label"))
    features = mapping.unpivot_features(parts, "product_id", ["nicotine", "label"])
    out = map_products(features, queries, points, docs)
    return out["items"].select("product_id", "feature", "point_id", "applies", "gap")


def regulation_flow(spark, sf, folder: str, ask: bool = False) -> Workflow:
    """The whole run over saved tables: blocks, changes, points of what changed, mapped products, strategies, impact, report, translation.

    A feature of the products is the key from mapping on. Where no document
    changed, nothing is embedded, and the stages after it are empty. When impact
    is scored, mapping, strategies and scores are checked by their rules, and
    the first stage that breaks one is made anew, twice at most. With ``ask`` the run
    stops before the report until it is approved. A translator stands outside:
    its answer is read as JSON, and here it is the report itself.
    """

    def preprocess(t):
        return _pairs(spark, sf)

    def changed(t):
        return detect_changes(t["preprocess"])["results"].select("pair_id", "section", "pos", "change_type", "change_detected", "level", "confidence")

    def embed(t):
        docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
        due = t["detect_changes"].filter("change_detected").select(F.expr(f"pos div {LINES}").alias("doc_id")).distinct()
        return docs.join(due, "doc_id", "left_semi").select(F.col("doc_id").alias("point_id"), "doc_id", "body", scores.pseudo_embedding(F.col("body")).alias("embedding"))

    def mapped(t):
        names = spark.createDataFrame([("nicotine", "the concentration"), ("label", "warning text")], "feature string, query string")
        queries = names.withColumn("embedding", scores.pseudo_embedding(F.col("query")))
        parts = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").alias("nicotine"), F.col("p_brand").alias("label"))
        items = map_products(mapping.unpivot_features(parts, "product_id", ["nicotine", "label"]), queries, t["embed"], t["detect_changes"])["items"]
        return items.select("product_id", "feature", "point_id", "applies", "required_value", "gap")

    def strategies(t):
        due = t["map_products"].filter("applies").groupBy("feature").agg(F.countDistinct("product_id").alias("products"), F.min("required_value").alias("least"))
        line = F.concat(F.lit("bring "), F.col("feature"), F.lit(" of "), F.col("products").cast("string"), F.lit(" products to "), F.coalesce("least", F.lit("what is asked")))
        return due.select("feature", line.alias("strategy"))

    def impact(t):
        share = F.countDistinct(F.when(F.col("applies"), F.col("product_id"))) / F.countDistinct("product_id")
        found = t["map_products"].groupBy("feature").agg(share.alias("share"), F.max(F.col("applies").cast("int")).alias("direct"))
        band = scores.scope_band(F.col("share"))
        factors = {"directness": F.col("direct"), "legal_severity": band, "scope": band, "regulatory_urgency": F.lit(1), "operational_urgency": F.lit(1), "response_cost": band}
        total = scores.impact_score(factors)
        return found.select("feature", F.round(total.cast("double"), 2).alias("score"), scores.impact_level(total).alias("level"))

    def report(t):
        line = lambda rows, said: rows.select("feature", F.lit(0).alias("pos"), said.alias("line"))
        overall = line(t["score_impact"], F.concat_ws(" ", "level", F.col("score").cast("string")))
        plans = line(t["generate_strategy"], F.col("strategy"))
        kinds = t["detect_changes"].filter("change_detected").groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))
        found = t["score_impact"].select("feature").join(F.broadcast(kinds)).select("feature", F.col("change_type").alias("pos"), F.concat_ws(" ", "change_type", F.col("n").cast("string")).alias("line"))
        parts = [("overall_summary", "list", "0. 종합 요약", overall, ""), ("change_summary", "list", "1. 규제 변경 요약", found, "변경 사항 없음"), ("strategy", "list", "5. 대응 전략 제안", plans, "(빈값 대응) 전략 수립 데이터 부족")]
        return reports.report_sections(t["score_impact"], "feature", parts)

    def translated(t):
        said = F.to_json(F.struct("content"))
        return t["report"].withColumn("content", F.from_json(jsonx.repaired(jsonx.fenced(said)), "content array<string>")["content"]).withColumn("language", F.lit("en"))

    def keeps(stage: str, rules):
        """Whether every row of a stage keeps all rules."""
        return lambda t: t[stage].filter(~F.coalesce(reduce(lambda a, b: a & b, rules.values()), F.lit(False))).isEmpty()

    rules = {
        "map_products": keeps("map_products", {"M2": F.col("applies") | F.col("gap").isNull(), "M5": F.col("applies").isNotNull() & F.col("feature").isNotNull()}),
        "generate_strategy": keeps("generate_strategy", checks.strategy_fit(F.col("strategy"), F.array(*map(F.lit, checks.PRODUCT_WORDS)), F.lit(None).cast("array<string>"))),
        "score_impact": keeps("score_impact", {"I2": F.col("score").between(0, 5), "I4": F.col("level").isin("High", "Medium", "Low")}),
    }
    questions = {"report": lambda t: f"report on {t['score_impact'].count()} features?"} if ask else {}
    stages = {"preprocess": preprocess, "detect_changes": changed, "embed": embed, "map_products": mapped, "generate_strategy": strategies, "score_impact": impact, "report": report, "translate": translated}
    return Workflow(spark, folder, stages, questions, rules, "score_impact")


@query()
def regulation_run(spark, sf):
    out = regulation_flow(spark, sf, store.work_folder(spark, "regulation-run")).run({})["translate"]
    return out.select("feature", "place", "section_id", F.array_join("content", "|").alias("content"))
