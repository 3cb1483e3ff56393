"""Products and their features against changed requirements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scores, text
from palimpsest.operators.frames import best_wins, top_per

#: Units of the product features.
FEATURE_UNITS = {"nicotine": "mg", "tar": "mg", "label_size": "text", "images_size": "text", "package": "text", "certifying_agencies": "text", "revenue": "currency", "supply_partner": "text", "effective": "json", "menthol": "boolean", "flavor": "boolean"}
FEATURES = ("nicotine", "tar", "menthol", "flavor", "label_size", "images_size", "package", "certifying_agencies", "revenue")


def feature_text(name: str, value: Column) -> Column:
    """How a feature is shown: amounts with mg/g, revenue in dollars, all else as it is."""
    if name in ("nicotine", "tar"):
        return F.concat(value.cast("double").cast("string"), F.lit(" mg/g"))
    if name == "revenue":
        return F.concat(F.lit("$"), F.format_number(value.cast("double"), 0))
    return value.cast("string")


def unpivot_features(products: DataFrame, ident: str, features: Sequence[str]) -> DataFrame:
    """(product, pos, feature, value, unit) of each feature that is neither null nor empty."""
    items = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), feature_text(f, F.col(f)).alias("value"), F.lit(FEATURE_UNITS.get(f, "text")).alias("unit")) for i, f in enumerate(features)))
    return products.select(F.col(ident).alias("product_id"), F.inline(items)).filter("value is not null and value <> ''")


def _grams(key: Column) -> Column:
    """All runs of one to three characters of a key, each once, and the empty one."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.array(*(F.substr(key, i, F.lit(n)) for n in (1, 2, 3))))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(runs)))


def hints(keywords: DataFrame, features: DataFrame) -> DataFrame:
    """(change_id, keyword, feature) where one names the other, as token keys.

    What lies in a key begins with a run of it: both ways are joins on the first
    three characters of one side and the runs of the other, and then compared.
    """
    k = keywords.withColumn("_k", text.token_key(F.col("keyword")))
    f = features.withColumn("_f", text.token_key(F.col("feature")))
    head = lambda c: F.left(c, F.lit(3)).alias("_g")
    inside = k.select("*", F.explode(_grams(F.col("_k"))).alias("_g")).join(f.select("*", head("_f")), "_g").filter(F.contains("_k", F.col("_f")))
    around = f.select("*", F.explode(_grams(F.col("_f"))).alias("_g")).join(k.select("*", head("_k")), "_g").filter(F.contains("_f", F.col("_k")))
    names = [*keywords.columns, *features.columns]
    return inside.select(*names).union(around.select(*names)).distinct()


def unknown_requirements(keywords: DataFrame, found: DataFrame) -> DataFrame:
    return keywords.join(found.select("change_id", "keyword").distinct(), ["change_id", "keyword"], "left_anti")


def selected_features(features: DataFrame, found: DataFrame) -> DataFrame:
    """Hinted features of a product where there are any, else all of them."""
    marked = features.join(found.select("feature").distinct().withColumn("hint", F.lit(True)), "feature", "left")
    some = F.max(F.coalesce("hint", F.lit(False))).over(Window.partitionBy("product_id"))
    return marked.withColumn("_some", some).filter(~F.col("_some") | F.coalesce("hint", F.lit(False))).drop("_some", "hint")


def targets(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The applying item of each feature: the first whose required value is known, else the first."""
    return top_per(items.filter("applies"), keys, [F.col("required_value").isNull().asc(), F.col("pos").asc(), F.col("required_value").asc()])


def merge_candidates(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each chunk: the highest score, the first of equals."""
    return best_wins(candidates, list(keys), "score", "pos")


def cap_per_document(candidates: DataFrame, query: str, document: str, chunk: str, position: str, n: int = 2) -> DataFrame:
    """Repeated chunks once, then at most ``n`` chunks of a document; rows without a document are not capped."""
    once = top_per(candidates, [query, chunk], [F.col(position).asc()])
    w = Window.partitionBy(query, document).orderBy(position)
    return once.withColumn("_n", F.row_number().over(w)).filter(F.col(document).isNull() | (F.col("_n") <= n)).drop("_n")


def feature_inventory(features: DataFrame) -> DataFrame:
    """For each feature its products, values and the value of the first product."""
    return features.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "product_id").alias("representative"), F.array_join(F.slice(F.array_sort(F.collect_set("value")), 1, 5), ",").alias("values"))


def query_text(name: Column, value: Column, unit: Column) -> Column:
    return F.concat_ws(" ", name, text.blank_to_null(value), text.blank_to_null(unit))


def applies(expected: Column, found: Column) -> Column:
    """Offline rule: a chunk applies to a feature if it has one of the expected words."""
    return F.arrays_overlap(expected, found)


def mapped_items(features: DataFrame, chunks: DataFrame) -> DataFrame:
    """Features with their retrieved chunks, whether they apply, and the gap; chunk words decide."""
    groups = F.create_map(*(x for k, v in text.SEMANTIC_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    expected = F.coalesce(F.try_element_at(groups, F.lower("feature")), F.array(F.lower("feature")))
    # a chunk is judged once for its feature, and numbers are read once on each side; words do not meet the products; chunks are as few as queries times top_k
    judged = chunks.withColumn("applies", applies(expected, F.col("words"))).withColumn("_required", scores.leading_number(F.col("required_value"))).drop("words")
    joined = features.withColumn("_current", scores.leading_number(F.col("value"))).join(F.broadcast(judged), "feature")
    return joined.withColumn("gap", F.when(F.col("applies"), F.col("_current") - F.col("_required"))).drop("_current", "_required")


def merge_products(items: DataFrame, key: str) -> DataFrame:
    """Over the products of a document: number of items, target of the last product for each feature, names shown as 'a, b, c 외 n개'."""
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("product_pos", "product_name"))), lambda x: x["product_name"]))
    shown = F.when(F.size("names") > 3, F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.lit(" 외 "), (F.size("names") - 3).cast("string"), F.lit("개"))).otherwise(F.array_join("names", ", "))
    merged = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), names.alias("names"), F.max_by("required_value", "product_pos").alias("last_required"))
    return merged.withColumn("shown", shown)


def trace_status(confidence: Column) -> Column:
    return F.when(confidence < 0.7, "pending").otherwise("applied")
