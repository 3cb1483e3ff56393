"""Keys, sections, keywords and labels of regulation text. All are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country names and the codes they stand for.
COUNTRY_CODES = {
    "USA": "US",
    "UNITED STATES": "US",
    "KOREA": "KR",
    "SOUTH KOREA": "KR",
    "REPUBLIC OF KOREA": "KR",
    "RUSSIA": "RU",
    "RUSSIAN FEDERATION": "RU",
    "INDONESIA": "ID",
    "EUROPEAN UNION": "EU",
}
#: Main language of a country.
COUNTRY_LANGUAGES = {
    "US": "EN", "GB": "EN", "CA": "EN", "AU": "EN", "KR": "KO", "JP": "JA", "CN": "ZH", "TW": "ZH", "DE": "DE", "FR": "FR", "ES": "ES", "BR": "PT",
    "RU": "RU", "IT": "IT", "NL": "NL", "PL": "PL", "TR": "TR", "VN": "VI", "TH": "TH", "ID": "ID", "SA": "AR", "AE": "AR", "EG": "AR",
}
#: Labels of change types.
CHANGE_LABELS = {"removed": "삭제", "new_clause": "조항 신설", "wording_only": "문언 정비", "scope_change": "범위 변경"}
NO_CHANGE_LABEL = "개정 없음"


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def section_key(section: Column) -> Column:
    """``1160.5`` of ``§ 1160.5(a)``: the first d.d, else what is left without the sign and white space."""
    bare = F.regexp_replace(section, r"(?U)[§\s]", "")
    return F.coalesce(blank_to_null(F.regexp_extract(bare, r"\d+\.\d+", 0)), bare)


def section_of_chunk(label: Column, ref: Column, last_heading: Column, text: Column) -> Column:
    """Numeric section of a chunk: of the first label that is present, else of the text's own section signs."""
    said = F.coalesce(blank_to_null(label), blank_to_null(ref), blank_to_null(last_heading))
    own = F.coalesce(blank_to_null(F.regexp_extract(text, r"§\s*(\d+\.\d+)", 1)), blank_to_null(F.regexp_extract(text, r"(?i)section\s+(\d+\.\d+)", 1)))
    return F.when(said.isNotNull(), blank_to_null(F.regexp_extract(said, r"\d+\.\d+", 0))).otherwise(own)


def section_display(evidence: Column, label: Column, ref: Column, last_heading: Column, text: Column, citation: Column) -> Column:
    found = [blank_to_null(F.regexp_extract(text, p, 0)) for p in (r"§\s*\d+(?:\.\d+)*", r"(?i)section\s+\d+(?:\.\d+)*", r"(?i)article\s+\d+")]
    return F.coalesce(*(blank_to_null(c) for c in (evidence, label, ref, last_heading)), *found, blank_to_null(citation), F.lit("§Unknown"))


def keywords(text: Column) -> Column:
    """Up to three tokens with a digit, then up to three capitalised words, without repeats, five at most."""
    digits = F.regexp_extract_all(text, F.lit(r"(?U)\b\w*\d+\w*\b"), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(F.slice(digits, 1, 3), F.slice(names, 1, 3))), 1, 5)


def token_key(text: Column) -> Column:
    return F.translate(F.lower(text), " -.", "___")


def citation_key(text: Column) -> Column:
    return F.upper(F.translate(text, "- ", ""))


def country_code(country: Column) -> Column:
    name = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    return F.coalesce(F.try_element_at(lookup(COUNTRY_CODES), name), F.when(F.length(name) == 2, name).otherwise(F.substring(name, 1, 2)))


def title_key(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(title)), r"[()]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"[^a-z0-9\s-]", "")), r"\s+", "-")


def file_name(given: Column, url: Column, title: Column, extension: str = "pdf", limit: int = 200) -> Column:
    """Header, last part of the URL, or title, made safe; the extension is added where it lacks."""
    tail = blank_to_null(F.try_url_decode(F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), "/", -1)))
    raw = F.coalesce(blank_to_null(given), tail, title)
    safe = F.left(F.regexp_replace(F.regexp_replace(raw, r'[\\/:*?"<>|]', "_"), r"\s+", "_"), F.lit(limit))
    return F.when(F.lower(safe).endswith(f".{extension}"), safe).otherwise(F.concat(safe, F.lit(f".{extension}")))


def object_key(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *(blank_to_null(p) for p in parts)), "/{2,}", "/")


def uri_parts(uri: Column) -> tuple[Column, Column]:
    """Bucket and key of ``arn:...:bucket/key``, ``s3://bucket/key`` or a plain key."""
    arn, s3 = uri.startswith("arn:"), uri.startswith("s3://")
    rest = F.when(arn, F.substring_index(uri, ":", -1)).when(s3, F.substr(uri, F.lit(6))).otherwise(uri)
    slash = F.instr(rest, "/")
    return F.when(arn | s3, F.substring_index(rest, "/", 1)), F.when(arn | s3, F.when(slash > 0, F.substr(rest, slash + 1)).otherwise(F.lit(""))).otherwise(rest)


def reference_id(regulation: Column, section: Column, page: Column) -> Column:
    return F.concat_ws("-", regulation, section, F.concat(F.lit("P"), page.cast("string")))


def sample_parts(text: Column, size: int) -> Column:
    """Start, middle and end of a text longer than ``size``, a third of it each."""
    third, n = size // 3, F.length(text)
    middle = F.substr(text, F.floor(n / 2).cast("int") - third // 2 + 1, F.lit(third))
    return F.when(n > size, F.concat_ws(" ", F.left(text, F.lit(third)), middle, F.right(text, F.lit(third)))).otherwise(text)


def required_display(required: Column, reasoning: Column) -> Column:
    low = F.lower(F.coalesce(reasoning, F.lit("")))
    said = lambda *words: [low.contains(w) for w in words]
    no, done, other = said("not regulated", "규제하지 않"), said("already compliant", "충족"), said("unrelated", "무관", "비적용")
    return F.coalesce(required.cast("string"), F.when(no[0] | no[1], "규제 대상 아님").when(done[0] | done[1], "기준 충족").when(other[0] | other[1] | other[2], "해당 없음").otherwise("규제 없음"))


def change_label(kind: Column) -> Column:
    return F.when(kind.isNull() | kind.isin("", "none"), NO_CHANGE_LABEL).otherwise(F.coalesce(F.try_element_at(lookup(CHANGE_LABELS), kind), kind))


def with_context(hierarchy: Column, text: Column) -> Column:
    return F.when(F.size(hierarchy) > 0, F.concat(F.array_join(hierarchy, " > "), F.lit("\n\n"), text)).otherwise(text)


def table_markdown(caption: Column, headers: Column, rows: Column) -> Column:
    """Bold caption, header, rule and rows, null cells empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    head = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("**"), caption, F.lit("**")))
    return F.concat_ws("\n", head, line(headers), rule, F.array_join(F.transform(rows, line), "\n"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


def hinted(keyword: Column, feature: Column) -> Column:
    """Equal or one in the other, after both are token keys. An empty keyword hints at everything."""
    k, f = token_key(keyword), token_key(feature)
    return k.contains(f) | f.contains(k)


def semantically_related(feature: Column, words: Column, groups: dict[str, list[str]]) -> Column:
    """The feature's name, or a term of its synonym group, is in the joined keywords."""
    name, joined = F.lower(feature), F.lower(F.array_join(words, " "))
    terms = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), name), F.array(name))
    return F.when(F.size(words) > 0, joined.contains(name) | F.exists(terms, lambda t: joined.contains(t))).otherwise(F.lit(False))


#: Terms that speak of a product feature.
SEMANTIC_GROUPS = {
    "nicotine": ["nicotine", "mg/ml", "concentration", "content", "liquid"],
    "tar": ["tar", "mg", "tobacco", "smoke"],
    "label": ["label", "warning", "text", "size", "package"],
    "label_size": ["label", "warning", "text", "size", "package"],
    "images_size": ["image", "graphic", "picture", "warning"],
    "battery": ["battery", "mah", "capacity", "power", "lithium"],
    "menthol": ["menthol", "flavor", "flavored", "mint"],
    "flavor": ["flavor", "flavored", "taste", "menthol"],
}


def snippet(body: Column, size: int) -> Column:
    """The first ``size`` characters; nothing of null."""
    return F.left(F.coalesce(body, F.lit("")), F.lit(size))


def united_keywords(*lists: Column) -> Column:
    """All keywords of several lists, each once, in order; null lists count as empty."""
    every = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda w: w.isNotNull())))


def in_feature(area: Column, feature: Column) -> Column:
    """Whether an affected area is a feature's name or part of it, both as token keys."""
    return F.contains(token_key(feature), token_key(area))


def filled(template: str, **values: Column) -> Column:
    """A template with ``{name}`` replaced by columns; ``{{`` and ``}}`` are plain braces, also where a value has braces."""
    parts, at = [], 0
    for found in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts.append(F.lit(template[at : found.start()]))
        parts.append(F.coalesce(values[found[1]].cast("string"), F.lit("")) if found[1] else F.lit(found[0][0]))
        at = found.end()
    return F.concat(*parts, F.lit(template[at:]))


#: Names of impact levels as lists show them.
LEVEL_NAMES = {"LOW": "낮음", "MEDIUM": "보통", "HIGH": "높음"}


def level_name(level: Column) -> Column:
    """An impact level as shown; other words as they are."""
    return F.coalesce(F.try_element_at(lookup(LEVEL_NAMES), F.upper(level)), level, F.lit(""))


def shown_time(made: Column, fallback: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, else the fallback as it is, else nothing."""
    return F.coalesce(F.date_format(made, "yyyy-MM-dd HH:mm:ss"), fallback.cast("string"), F.lit(""))


def iso_time(made: Column) -> Column:
    return F.concat(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
