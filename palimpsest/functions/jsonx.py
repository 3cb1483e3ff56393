"""JSON in the output of models: fences, trailing commas, alternatives of names, key-value lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fenced(said: Column) -> Column:
    """The block in a json fence, else in any fence, else all; from the first { to the last }."""
    blank = lambda c: F.nullif(c, F.lit(""))
    body = F.coalesce(blank(F.regexp_extract(said, r"(?s)```json\s*(.*?)```", 1)), blank(F.regexp_extract(said, r"(?s)```\s*(.*?)```", 1)), said)
    return F.coalesce(blank(F.regexp_extract(body, r"(?s)\{.*\}", 0)), body)


def repaired(body: Column) -> Column:
    """Without trailing commas and control characters."""
    return F.regexp_replace(F.regexp_replace(body, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]", ""), r",\s*([}\]])", "$1")


def parsed(said: Column) -> Column:
    """VARIANT of the text, of the repaired text, or null."""
    body = fenced(said)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(repaired(body)))


def key_values(items: Column) -> Column:
    """Map of 'key: value' strings, split at the first ': '; the last of equal keys wins."""
    good = F.filter(items, lambda x: x.contains(": "))
    last_first = F.reverse(F.transform(good, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substr(x, F.instr(x, F.lit(": ")) + 2).alias("v"))))
    names = F.transform(last_first, lambda p: p["k"])
    return F.map_from_entries(F.filter(last_first, lambda p, i: F.array_position(names, p["k"]) == i + 1))


def strategies(said: Column) -> Column:
    """Recommendations of a strategy answer: of JSON items under any of their names, else of its lines."""
    item = "array<struct<recommended_strategy:string,strategy:string>>"
    listed = F.filter(F.transform(F.from_json(F.regexp_extract(said, r"(?s)\[.*\]", 0), item), lambda x: F.coalesce(F.nullif(x["recommended_strategy"], F.lit("")), F.nullif(x["strategy"], F.lit("")))), lambda x: x.isNotNull())
    lines = F.transform(F.split(said, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[0-9]{1,2}[.)]\s+", ""), r"^[-*•]\s*", "")))
    return F.when(F.size(listed) > 0, listed).otherwise(F.filter(lines, lambda x: x != ""))


def score_value(value: Column) -> Column:
    """A number, or the score or value of an object; zero where neither is."""
    number = lambda path: F.nullif(F.try_variant_get(value, path, "double"), F.lit(0.0))
    return F.coalesce(number("$"), number("$.score"), number("$.value"), F.lit(0.0))


def first_json(said: Column) -> Column:
    """What lies between the first bracket, of an object or of an array, and the last of its kind, without control characters."""
    clean = F.regexp_replace(said, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]", "")
    return F.nullif(F.regexp_extract(clean, r"(?s)^[^\[{]*(\{.*\}|\[.*\])", 1), F.lit(""))


#: Fields of a strategy item, other names they come under, and what stands in for them.
STRATEGY_FIELDS = {
    "regulation_change": ("change_summary", ""),
    "product_context": ("current_product_status", ""),
    "previous_strategy": (None, "없음"),
    "recommended_strategy": ("summary", ""),
    "rationale": ("strategy_reasoning", ""),
}
#: Fields of a strategy that is a line of text.
LINE_FIELDS = {"regulation_change": "(변경 감지 실패)", "product_context": "(알 수 없음)", "previous_strategy": "없음", "rationale": "(근거 없음)"}


def strategy_items(said: Column) -> Column:
    """Strategies of an answer as structs: its JSON items under any of their names, without those that recommend nothing; else its lines."""
    names = [n for field, (other, _) in STRATEGY_FIELDS.items() for n in (field, other) if n]
    schema = f"struct<items:array<struct<{','.join(f'{n}:string' for n in names)}>>>"
    items = F.from_json(F.when(parsed(said).isNotNull(), repaired(fenced(said))), schema)["items"]

    def item(x: Column) -> Column:
        said_as = lambda field, other, default: F.coalesce(x[field], x[other] if other else F.lit(None).cast("string"), F.lit(default))
        return F.struct(*(said_as(f, other, default).alias(f) for f, (other, default) in STRATEGY_FIELDS.items()))

    def line(x: Column) -> Column:
        return F.struct(*((x if f == "recommended_strategy" else F.lit(LINE_FIELDS[f])).alias(f) for f in STRATEGY_FIELDS))

    listed = F.filter(F.transform(items, item), lambda x: x["recommended_strategy"] != "")
    plain = F.transform(F.split(said, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[0-9]{1,2}[.)]\s+", ""), r"^[-*•]\s*", "")))
    return F.when(F.size(listed) > 0, listed).otherwise(F.transform(F.filter(plain, lambda x: x != ""), line))


#: The parts of a page that a model answers with.
STRUCTURE = (
    "markdown_content string, reference_blocks array<struct<section_ref:string,start_line:int,end_line:int,keywords:array<string>>>, "
    "metadata struct<title:string,jurisdiction_code:string,authority:string,citation_code:string,language:string,effective_date:string>, "
    "entities array<struct<name:string,type:string,context:string>>, tables array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>"
)


def page_structure(said: Column) -> Column:
    """The structure of a page; an answer that is no JSON object is the page's text and nothing else."""
    good = F.from_json(F.when(parsed(said).isNotNull(), repaired(fenced(said))), STRUCTURE)
    empty = {"reference_blocks": "array<struct<section_ref:string,start_line:int,end_line:int,keywords:array<string>>>", "entities": "array<struct<name:string,type:string,context:string>>", "tables": "array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>"}
    lists = [F.coalesce(good[n], F.array().cast(kind)).alias(n) for n, kind in empty.items()]
    return F.struct(F.coalesce(good["markdown_content"], said).alias("markdown_content"), *lists, good["metadata"].alias("metadata"))


#: What stands where a report has no content.
NO_DATA, NO_LINK, TABLE_HEAD, NO_ROWS = "데이터가 없습니다.", "링크", ("항목", "내용"), ("데이터 없음", "-")


def content_list(section: Column) -> Column:
    """Content of a report section (VARIANT) as strings: a list's elements but nulls, a scalar alone, or a note that there is none."""
    content = F.try_variant_get(section, "$.content", "variant")
    items = F.transform(F.filter(F.try_variant_get(section, "$.content", "array<variant>"), lambda x: ~F.is_variant_null(x)), lambda x: x.cast("string"))
    absent = content.isNull() | F.is_variant_null(content)
    return F.when(absent, F.array(F.lit(NO_DATA))).when(items.isNotNull(), items).otherwise(F.array(content.cast("string")))


def content_links(section: Column) -> Column:
    """Links of a report section as (url, text); a plain string is both."""

    def link(x: Column) -> Column:
        said = lambda *names: F.coalesce(*(F.nullif(F.try_variant_get(x, f"$.{n}", "string"), F.lit("")) for n in names))
        plain = F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))
        return F.struct(F.coalesce(plain, said("url", "link"), F.lit("#")).alias("url"), F.coalesce(plain, said("text", "title", "url"), F.lit(NO_LINK)).alias("text"))

    return F.coalesce(F.transform(F.try_variant_get(section, "$.content", "array<variant>"), link), F.array().cast("array<struct<url:string,text:string>>"))


def content_tables(section: Column) -> Column:
    """Tables of a report section, with a head and a row that say so where there are none."""
    kind = "array<struct<product_name:string,headers:array<string>,rows:array<array<string>>>>"
    head, row = F.array(*map(F.lit, TABLE_HEAD)), F.array(F.array(*map(F.lit, NO_ROWS)))
    some = lambda c, default: F.when(F.size(c) > 0, c).otherwise(default)
    made = F.transform(F.from_json(F.try_variant_get(section, "$.tables", "variant").cast("string"), kind), lambda t: F.struct(F.coalesce(t["product_name"], F.lit("")).alias("product_name"), some(t["headers"], head).alias("headers"), some(t["rows"], row).alias("rows")))
    return some(made, F.array(F.struct(F.lit("").alias("product_name"), head.alias("headers"), row.alias("rows"))))
