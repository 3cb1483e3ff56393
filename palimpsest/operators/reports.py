"""Reports, articles, keynotes, job status and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scores, text
from palimpsest.operators.frames import dealt, first_wins, top_per


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def inferred_impact(sections: DataFrame, key: str, level: str, impact: str) -> DataFrame:
    """Greatest level of a document over its sections' confidence and its numbers' impacts; 1 at least."""
    number = F.when(F.coalesce(F.col(impact), F.lit("")) != "", scores.level_number(F.col(impact)))
    return sections.groupBy(key).agg(F.greatest(F.coalesce(F.max(scores.level_number(F.col(level))), F.lit(1)), F.coalesce(F.max(number), F.lit(1))).alias("impact"))


def article_rows(sections: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    return sections.withColumn("article_no", F.row_number().over(w)).withColumn("label", text.change_label(F.col(kind)))


def exploded_numbers(rows: DataFrame, key: str, numbers: str, kind: str) -> DataFrame:
    """One row for each numerical change; a section without any shows its change type."""
    n = F.col("number")
    return rows.select(key, kind, F.explode_outer(numbers).alias("number")).select(key, F.coalesce(n["field"], F.col(kind)).alias("field"), F.coalesce(n["new_value"], F.lit("")).alias("new_value"))


def product_table(items: DataFrame) -> DataFrame:
    """First row of each product and feature with its requirement as shown."""
    return first_wins(items, ["product_name", "feature"], "pos").withColumn("required", text.required_display(F.col("required_value"), F.col("reasoning")))


def references(new: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Legacy and new regulations of a report, each id once, legacy before new."""
    every = legacy.withColumn("kind", F.lit("Legacy")).withColumn("pos", F.lit(0)).unionByName(new.withColumn("kind", F.lit("New")).withColumn("pos", F.lit(1)))
    return first_wins(every, [key], "pos").drop("pos")


def latest_status(log: DataFrame, key: str, status: str, time: str, ident: str) -> DataFrame:
    """Last status of each job in an append log."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(time, ident)).alias("status"), F.max(time).alias("updated_at"))


def status_of(wanted: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    return wanted.join(latest, key, "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def merged_payloads(log: DataFrame, key: str, node: str, payload: str, time: str, ident: str) -> DataFrame:
    """One map of node to its last payload for each key."""
    last = log.groupBy(key, node).agg(F.max_by(payload, F.struct(time, ident)).alias("payload"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(node, "payload")))).alias("data"))


def daily(df: DataFrame, key: str, time: str, aggregates: list[Column]) -> DataFrame:
    return df.groupBy(key, F.date_format(time, "yyyy-MM-dd").alias("day")).agg(*aggregates)


def axis_max(value: Column) -> Column:
    return F.ceil(value * 1.2) + 1


def keynote_items(items: DataFrame, key: str, order: str, fields: list[str], n: int = 10) -> DataFrame:
    """Number of items of a keynote and its first ones."""
    ordered = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.slice(ordered, 1, n).alias("items"))


def report_fields(sections: DataFrame, key: str, title: str, content: str, order: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Named fields of report sections: the first rule whose word is in the title decides, the last section of a field wins."""
    name = F.lit(None).cast("string")
    for word, field in reversed(rules):
        name = F.when(F.col(title).contains(word), field).otherwise(name)
    return sections.withColumn("field", name).filter("field is not null").groupBy(key, "field").agg(F.max_by(content, order).alias("content"))


def feature_line(items: DataFrame, key: str) -> DataFrame:
    """The first two of the features that apply, in order of name."""
    return items.filter("applies").groupBy(key).agg(F.array_join(F.slice(F.array_sort(F.collect_set("feature")), 1, 2), ", ").alias("features"))


def trace_append(existing: Column, new: Column) -> Column:
    return F.concat(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def trace_updated(trace: Column, new: Column, at: Column) -> Column:
    """A trace (entries, last_updated) with ``new`` entries behind its own; the time stays where there are none."""
    entries = trace_append(trace["entries"], new)
    return F.struct(entries.alias("entries"), F.when(F.coalesce(F.size(new), F.lit(0)) > 0, at).otherwise(trace["last_updated"]).alias("last_updated"))


def run_digest(runs: DataFrame, key: str, items: DataFrame, changes: DataFrame, strategies: DataFrame, n_changes: int = 5, n_strategies: int = 3) -> DataFrame:
    """What is shown of each run: how many items apply, of how many, and its first changes and strategies.

    ``items``: the key and applies. ``changes`` and ``strategies``: the key,
    pos and line. Only the first lines of each run are collected.
    """
    counts = items.groupBy(key).agg(F.count_if("applies").alias("applies"), F.count(F.lit(1)).alias("items"))

    def first(lines: DataFrame, n: int, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
        return top_per(lines.select(key, "pos", "line"), [key], [F.col("pos"), F.col("line")], n).groupBy(key).agg(F.transform(ordered, lambda x: x["line"]).alias(name))

    out = runs.select(key).join(counts, key, "left").join(first(changes, n_changes, "changes"), key, "left").join(first(strategies, n_strategies, "strategies"), key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, F.coalesce("applies", F.lit(0)).alias("applies"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("changes", none).alias("changes"), F.coalesce("strategies", none).alias("strategies"))


def validation(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failed): how many rows break each rule; null counts as broken."""
    counted = items.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counted.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules)))).alias("rule", "failed"))


def run_summary(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """completed, error or partial, from the number of successes."""
    ok, n = F.count_if(F.col(status) == "ok"), F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("total"), ok.alias("succeeded"), (n - ok).alias("failed"), F.when(ok == n, "completed").when(ok == 0, "error").otherwise("partial").alias("status"))


def usage_sets(df: DataFrame, model: str, page: str, amount: str) -> DataFrame:
    """Token totals in all, by model and by page, in one pass."""
    return df.groupingSets([[], [model], [page]], model, page).agg(F.sum(amount).alias("total"))


def batch_result(files: DataFrame, keys: list[str], file: str, status: str, began: str, ended: str, tokens: str, pages: str) -> DataFrame:
    """A run over files: how many, how many went well and their rate, the names of the others, its time, and tokens and pages of those that went well."""
    ok = F.col(status) == "success"
    n, good = F.count(F.lit(1)), F.count_if(ok)
    spent, read = F.sum(F.when(ok, F.col(tokens)).otherwise(0)), F.sum(F.when(ok, F.col(pages)).otherwise(0))
    seconds = F.unix_timestamp(F.max(ended)) - F.unix_timestamp(F.min(began))
    return files.groupBy(*keys).agg(
        n.alias("total_files"), good.alias("succeeded"), (n - good).alias("failed"), F.array_sort(F.collect_list(F.when(~ok, F.col(file)))).alias("failed_files"),
        seconds.alias("duration_seconds"), F.round(good / n * 100, 1).alias("success_rate"), spent.alias("total_tokens"), read.alias("total_pages"), F.try_divide(spent, read).alias("tokens_per_page"),
    )


def embedding_summary(chunks: DataFrame, keys: list[str], body: str, products: str, section: str) -> DataFrame:
    """Chunks of a run, their mean length in whole characters, and how many products and sections they name."""
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"), F.floor(F.sum(F.length(body)) / F.count(F.lit(1))).alias("mean_length"),
        F.size(F.array_distinct(F.flatten(F.collect_set(products)))).alias("products"), F.countDistinct(F.coalesce(section, F.lit(""))).alias("sections"),
    )


def list_rows(keynotes: DataFrame) -> DataFrame:
    """What a list of keynotes shows: id, country, category, summary and the impact's name; and how many rows there are.

    ``keynotes``: keynote_id and ``data``, a map of the keynote's fields.
    """
    field = lambda name: F.coalesce(F.try_element_at("data", F.lit(name)), F.lit(""))
    rows = keynotes.select("keynote_id", field("country").alias("country"), field("category").alias("category"), field("summary").alias("summary"), text.level_name(field("impact")).alias("impact"))
    return rows.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("today_count"))))


def country_rows(keynotes: DataFrame, inferred: DataFrame) -> DataFrame:
    """Keynotes of a country: title, analysis day, and the impact they state, else the one inferred from their sections, else 1."""
    field = lambda name: F.try_element_at("data", F.lit(name))
    stated = F.when(F.upper(field("impact")).isin("LOW", "MEDIUM", "HIGH"), scores.level_number(field("impact")))
    joined = keynotes.join(inferred.select("keynote_id", F.col("impact").alias("_inferred")), "keynote_id", "left")
    return joined.select("keynote_id", F.coalesce(field("title"), F.lit("")).alias("title"), F.coalesce(stated, "_inferred", F.lit(1)).alias("impact_level"), F.coalesce(field("analysis_date"), F.lit("")).alias("category"))


def detail_rows(keynotes: DataFrame) -> DataFrame:
    """What a keynote's page shows: a file name from citation, title or id, its dates under either of their names, and when it was collected."""
    field = lambda *names: F.coalesce(*(text.blank_to_null(F.try_element_at("data", F.lit(n))) for n in names))
    name = F.coalesce(field("citation_code", "title"), F.concat(F.lit("regulation_"), F.col("keynote_id").cast("string")))
    return keynotes.select(
        "keynote_id", name.alias("file_name"), F.coalesce(field("promulgation_date", "promulgationDate"), F.lit("")).alias("promulgated"),
        F.coalesce(field("effective_date", "effectiveDate"), F.lit("")).alias("effective"), text.shown_time(F.col("generated_at"), field("analysis_date")).alias("collected"),
    )


#: Places of a report, their titles, and the words in a section's title, or its id, that put it there.
REPORT_PLACES = (
    ("0. 종합 요약", ("overall", "종합 요약")),
    ("1. 규제 변경 요약", ("규제 변경 요약", "change")),
    ("2. 영향받는 제품 목록", ("제품 분석", "products")),
    ("3. 주요 변경 사항 해석", ("변경 사항", "major", "changes")),
    ("4. 대응 전략", ("대응 전략", "strategy")),
    ("5. 영향 평가 근거", ("영향 평가", "impact")),
    ("6. 참고 및 원문 링크", ("참고", "references")),
)


def placed_sections(sections: DataFrame, key: str, places=REPORT_PLACES) -> DataFrame:
    """(key, place, title, section_id, content): the first section of a report for each place; one section may fill several.

    ``sections``: the key, pos, section_id, title, content.
    """
    slots = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(title).alias("shown"), F.array(*map(F.lit, words)).alias("words")) for i, (title, words) in enumerate(places)))
    said, ident = F.coalesce("title", F.lit("")), F.coalesce("section_id", F.lit(""))
    fits = F.filter(slots, lambda s: F.exists(s["words"], lambda w: F.contains(said, w) | (ident == w)))
    rows = sections.select(key, "pos", "section_id", "content", F.explode(fits).alias("slot"))
    first = rows.groupBy(key, "slot.place", "slot.shown").agg(F.min_by(F.struct("section_id", "content"), "pos").alias("found"))
    return first.select(key, "place", F.col("shown").alias("title"), "found.section_id", "found.content")


def report_sections(reports: DataFrame, key: str, parts: list[tuple[str, str, str, DataFrame, str]]) -> DataFrame:
    """(key, place, section_id, kind, title, content): the sections of each report in order.

    Each part is (section_id, kind, title, rows, default): ``rows`` hold the
    key, pos and line; a report without rows of a part gets the default as its
    only line, or no line where the default is empty.

    Reports and the rows of all parts are dealt by key once and grouped where
    they lie. Nothing is grouped before that, as few lines of a report meet in
    a file, and none of the shuffle's tasks is given the share of several.
    """
    every = reports.select(key, F.lit(True).alias("_asked"))
    for place, (_, _, _, rows, _) in enumerate(parts):
        # a row without a key is no report's
        every = every.unionByName(rows.filter(F.col(key).isNotNull()).select(key, F.struct("pos", "line").alias(f"_{place}")), allowMissingColumns=True)
    met = dealt(every, key).groupBy(key).agg(F.max("_asked").alias("_asked"), *(F.collect_list(f"_{place}").alias(f"_{place}") for place in range(len(parts)))).filter("_asked")
    sections = []
    for place, (section_id, kind, title, _, default) in enumerate(parts):
        lines = F.transform(F.array_sort(f"_{place}"), lambda x: x["line"])
        content = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(default))) if default else lines
        sections.append(F.struct(F.lit(place).alias("place"), F.lit(section_id).alias("section_id"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), content.alias("content")))
    return met.select(F.col(key).cast(reports.schema[key].dataType).alias(key), F.inline(F.array(*sections)))


def notification(product: Column, n_items: Column, n_unknown: Column) -> Column:
    named = F.coalesce(text.blank_to_null(product), F.lit("unknown"))
    return F.concat(F.lit("[Report] product="), named, F.lit(" items="), n_items.cast("string"), F.lit(" unknown="), n_unknown.cast("string"), F.lit(" report generated."))


def alert_text(country: Column, title: Column, level: Column, features: Column, product: Column, change: Column) -> Column:
    """What is sent when a report is ready; ``features`` are those that apply, of which two are named."""
    named = F.when(F.size(features) > 0, F.array_join(F.slice(F.array_sort(features), 1, 2), ", ")).otherwise(F.lit("없음"))
    or_else = lambda c, x: F.coalesce(text.blank_to_null(c), F.lit(x))
    return F.concat(
        F.lit("보고서 생성 완료 ("), or_else(country, "Unknown"), F.lit(")\n규제명칭: "), or_else(title, "규제명 없음"), F.lit("\n영향도: "), or_else(level, "N/A"),
        F.lit(" | 매핑 항목: "), F.size(features).cast("string"), F.lit("개 유효 카테고리 ("), named, F.lit(")\n제품: "), or_else(product, "Unknown"),
        F.lit("\nKey Change: "), or_else(change, "No changes detected"),
    )


def node_output(merged: DataFrame, node: str | None = None) -> DataFrame:
    """Saved outputs of ``merged_payloads``: all of them, or one node's; and the names there are."""
    names = F.array_sort(F.map_keys("data")).alias("nodes")
    return merged.select("*", names) if node is None else merged.withColumn("output", F.try_element_at("data", F.lit(node))).select("*", names)


def restored_state(regulations: DataFrame, merged: DataFrame, key: str, nodes: dict[str, str]) -> DataFrame:
    """Regulations that have saved outputs, each with the output of every node of ``nodes`` under the name given there."""
    return regulations.join(merged, key).withColumns({name: F.try_element_at("data", F.lit(node)) for node, name in nodes.items()}).drop("data")
