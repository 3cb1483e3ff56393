"""Crawl targets, search texts, ids, specifications, languages and dates of collected documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import COUNTRY_LANGUAGES, blank_to_null, collapse_space, let, lookup, sample_parts

#: Frequent short words of a language.
STOP_WORDS = {
    "en": ["the", "of", "and", "that", "with", "was", "for", "are"],
    "de": ["der", "die", "und", "das", "nicht", "von", "mit", "ist"],
    "fr": ["le", "les", "des", "est", "que", "dans", "une", "pour"],
    "es": ["el", "los", "del", "que", "por", "con", "una", "las"],
}


def target_fields(code: Column, country: Column, category: Column, label: Column) -> tuple[Column, Column, Column]:
    """(code, category, label): the country where the code lacks, reg as regulation, and a label from the category."""
    kind = F.when(F.lower(category) == "reg", "regulation").otherwise(category)
    shown = F.when(F.lower(kind) == "regulation", "Regulation").when(F.lower(kind) == "news", "News").otherwise(kind)
    return F.coalesce(blank_to_null(code), country), kind, F.coalesce(blank_to_null(label), shown)


def search_text(keyword: Column, site: Column, since: Column, format_: Column, category: Column, as_of: Column) -> Column:
    """Keyword with site, date (100 days back where none is given) and, for regulations or where a format is given, file type."""
    typed = F.lower(category).isin("regulation", "reg") | format_.isNotNull()
    return F.concat_ws(
        " ", keyword, F.concat(F.lit("site:"), blank_to_null(site)), F.concat(F.lit("after:"), F.date_format(F.coalesce(since, F.date_sub(as_of, 100)), "yyyy-MM-dd")), F.when(typed, F.concat(F.lit("filetype:"), F.coalesce(blank_to_null(format_), F.lit("pdf"))))
    )


def regulation_id(kind: Column, country: Column, title: Column, path: Column) -> Column:
    """Type, country and three capitalised words of the title; without a title, the file's stem."""
    words = F.slice(F.regexp_extract_all(title, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0)), 1, 3)
    made = F.concat_ws("-", blank_to_null(kind), blank_to_null(country), blank_to_null(F.array_join(words, "-")))
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), "[^A-Za-z0-9-]", "-")
    return F.when(blank_to_null(title).isNotNull() & (made != ""), made).otherwise(stem)


def change_query(keywords: Column, numbers: Column) -> Column:
    """First five of the keywords and then the new values and fields of the numbers; null where there are none."""
    values = F.flatten(F.transform(F.coalesce(numbers, F.array().cast("array<struct<field:string,new_value:string>>")), lambda n: F.array(n["new_value"], n["field"])))
    parts = F.filter(F.transform(F.concat(F.coalesce(keywords, F.array().cast("array<string>")), values), lambda x: F.trim(x)), lambda x: x != "")
    return blank_to_null(F.array_join(F.slice(parts, 1, 5), " "))


def hinted_query(name: Column, value: Column, keywords: Column, numbers: Column) -> Column:
    """Fallback search text of a feature: name, value and two hints (three keywords, then its own new values of two numbers)."""
    own = F.transform(F.filter(F.slice(numbers, 1, 2), lambda n: n["field"] == name), lambda n: F.coalesce(n["new_value"], F.lit("")))
    return F.concat_ws(" ", name, blank_to_null(value), F.array_join(F.slice(F.concat(F.slice(keywords, 1, 3), own), 1, 2), " "))


def specifications(body: Column) -> Column:
    """Amounts that a text names: mg, mAh and cm, the first of each."""
    first = lambda unit: blank_to_null(F.regexp_extract(body, rf"(?i)(\d+(?:\.\d+)?)\s*{unit}\b", 1)).cast("double")
    return F.struct(first("mg").alias("mg"), first("mAh").alias("mah"), first("cm").alias("cm"))


def numbered_sections(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(r"(\d+\.\s*[^.\n]+)"), F.lit(1)), lambda x: F.trim(x))


def detected_language(body: Column) -> Column:
    """Language whose frequent words are most often in a text, and its share of all hits; UNKNOWN below ten characters or without a hit."""
    words = F.split(F.lower(F.regexp_replace(body, r"[.,;:!?]", "")), r"\s+")

    def hits(stops: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stops)))

    counts = {lang: hits(stops) for lang, stops in STOP_WORDS.items()}
    total = sum(counts.values(), F.lit(0))
    best = F.greatest(*counts.values())
    code = F.lit("UNKNOWN")
    for lang, n in reversed(counts.items()):
        code = F.when(n == best, lang.upper()).otherwise(code)
    known = (F.length(body) >= 10) & (best > 0)
    share = F.round(best / total, 4)
    return F.struct(F.when(known, code).otherwise("UNKNOWN").alias("language"), F.when(known, share).otherwise(F.lit(0.0)).alias("confidence"), F.coalesce(known & (share >= 0.7), F.lit(False)).alias("reliable"))


def is_fresh(made: Column, changed: Column) -> Column:
    """A cached report is fresh if it was made when or after its summary last changed; unknown times are not."""
    return F.coalesce(made >= changed, F.lit(False))


def text_or_ocr(extracted: Column, recognised: Column, least: int = 50) -> Column:
    """The text layer of a page where it has enough, else what OCR gave."""
    return F.when(F.length(F.trim(F.coalesce(extracted, F.lit("")))) >= least, extracted).otherwise(recognised)


#: Ranges of characters that are of one language.
SCRIPTS = {"ko": "\uac00-\ud7a3", "ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff", "ru": "\u0400-\u04ff", "ar": "\u0600-\u06ff", "th": "\u0e00-\u0e7f"}
#: Characters of a script that count as one frequent word.
SCRIPT_WORD = 4


def language_scores(body: Column, sample: int = 3000, n: int = 3) -> Column:
    """The ``n`` likeliest languages and their shares of all hits in a sample of a text: frequent words, and characters of a script."""
    names = [lang.upper() for lang in (*STOP_WORDS, *SCRIPTS)]

    def hits(some: Column, words: Column) -> Column:
        stops = [_stop_hits(words, stops) for stops in STOP_WORDS.values()]
        return F.array(*stops, *(F.floor(F.regexp_count(some, F.lit(f"[{span}]")) / SCRIPT_WORD).cast("int") for span in SCRIPTS.values()))

    def ranked(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        rows = F.zip_with(counts, F.array(*map(F.lit, names)), lambda c, name: F.struct((-c).alias("least"), name.alias("language")))
        best = F.slice(F.array_sort(F.filter(rows, lambda r: r["least"] < 0)), 1, n)
        return let(total, lambda t: F.transform(best, lambda r: F.struct(r["language"].alias("language"), F.round(F.try_divide(-r["least"], t), 4).alias("share"))))

    some = sample_parts(body, sample)
    words = F.split(F.lower(F.regexp_replace(some, r"[.,;:!?]", "")), r"\s+")
    found = let(F.struct(some.alias("some"), words.alias("words")), lambda v: let(hits(v["some"], v["words"]), ranked))
    return F.when(F.length(F.trim(body)) >= 10, found)


def _stop_hits(words: Column, stops: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*stops)))


def validated_language(country: Column, language: Column, reliable: Column) -> Column:
    """Whether the language is the country's, and the language to go by: the country's where the guess is not reliable."""
    expected = F.try_element_at(lookup(COUNTRY_LANGUAGES), F.upper(country))
    override = ~F.coalesce(reliable, F.lit(False)) & expected.isNotNull()
    return F.struct((expected == language).alias("country_match"), F.when(override, expected).otherwise(language).alias("language"))


def cleaned(body: Column, country: Column) -> Column:
    """The text with single spaces, its likeliest language, whether that is reliable, and what the country makes of it."""

    def told(clean: Column, best: Column) -> Column:
        language, reliable = F.coalesce(best["language"], F.lit("UNKNOWN")), F.coalesce(best["share"] >= 0.7, F.lit(False))
        by = validated_language(country, language, reliable)
        return F.struct(clean.alias("clean"), language.alias("detected"), reliable.alias("reliable"), by["country_match"].alias("country_match"), by["language"].alias("language"))

    return let(collapse_space(body), lambda clean: let(F.try_element_at(language_scores(clean), F.lit(1)), lambda best: told(clean, best)))


#: How products are named, words of a category, and the categories.
PRODUCT_NAMES = (r"제품\s*[A-Z가-힣0-9]+", r"[A-Z가-힣]+\s*전자담배", r"[A-Z가-힣]+\s*궐련", r"모델\s*[A-Z가-힣0-9]+")
PRODUCT_KINDS = {"전자담배": "e-cigarette", "궐련": "cigarette", "담배": "tobacco"}
#: Words of a regulation, and words that go with a category.
REGULATION_WORDS = ("니코틴", "함량", "제한", "라벨", "크기", "경고", "문구", "배터리", "용량", "인증", "요구사항", "규제", "준수")
KIND_WORDS = {"e-cigarette": ("전자담배", "베이핑", "액상"), "cigarette": ("궐련", "담배", "연소")}


def product_names(body: Column) -> Column:
    """Names of products in a text, each once, in order."""
    found = [F.regexp_extract_all(body, F.lit(f"(?i){p}"), F.lit(0)) for p in PRODUCT_NAMES]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def product_kind(body: Column) -> Column:
    kind = F.lit(None).cast("string")
    for word, name in reversed(PRODUCT_KINDS.items()):
        kind = F.when(F.contains(body, F.lit(word)), name).otherwise(kind)
    return kind


def blank_line_pages(body: Column) -> Column:
    """Pages of a text that two empty lines and more part."""
    return F.filter(F.transform(F.split(body, "\n\n\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def enriched_keywords(body: Column, kind: Column, nicotine: Column) -> Column:
    """Words to find a document by: regulation words it has, words of its category, its amount of nicotine; in order."""
    said = F.filter(F.array(*map(F.lit, REGULATION_WORDS)), lambda w: F.contains(body, w))
    none = F.array().cast("array<string>")
    extra = none
    for name, words in KIND_WORDS.items():
        extra = F.when(kind == name, F.array(*map(F.lit, words))).otherwise(extra)
    amount = F.when(nicotine.isNotNull(), F.array(F.concat(nicotine.cast("string"), F.lit("mg")))).otherwise(none)
    return F.array_sort(F.array_distinct(F.concat(said, extra, amount)))


#: How a case names its parts, and what is behind the number of a specification.
CASE_PARTS = {"section": "섹션: ", "regulation": "규제 내용: ", "products": "관련 제품: ", "specs": "제품 특성: ", "keywords": "관련 키워드: "}
CASE_SPECS = {"nicotine": ("니코틴 함량: ", "mg"), "battery_capacity": ("배터리 용량: ", "mAh"), "label_size": ("라벨 크기: ", "cm"), "category": ("제품 카테고리: ", "")}


def combined_text(section: Column, regulation: Column, products: Column, specs: Column) -> Column:
    """A case in one text: section, regulation, products, specifications and keywords, those it has, an empty line between.

    ``products``: array<string>. ``specs``: map<string,string> in the order to
    be named; its category and nicotine add to the keywords.
    """
    said = lambda part, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(CASE_PARTS[part]), body))

    def named(e: Column) -> Column:
        out = F.concat(e["key"], F.lit(": "), e["value"])
        for key, (label, unit) in CASE_SPECS.items():
            out = F.when(e["key"] == key, F.concat(F.lit(label), e["value"], F.lit(unit))).otherwise(out)
        return out

    regulation = F.coalesce(regulation, F.lit(""))
    listed = F.array_join(F.transform(F.map_entries(specs), named), ", ")
    words = F.array_join(enriched_keywords(regulation, F.try_element_at(specs, F.lit("category")), F.try_element_at(specs, F.lit("nicotine"))), ", ")
    return F.concat_ws("\n\n", said("section", section), said("regulation", regulation), said("products", F.array_join(products, ", ")), said("specs", listed), said("keywords", words))
