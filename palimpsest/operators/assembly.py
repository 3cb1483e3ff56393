"""Pages to numbered chunks, and what goes with a page: its document's metadata, its scan, its translation batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import chunking
from palimpsest.operators.frames import top_per


def first_page_metadata(pages: DataFrame, document: str, order: str, metadata: str) -> DataFrame:
    """(document, metadata) of each document's first page, null where that page has none."""
    first = top_per(pages.select(document, order, metadata), [document], [F.col(order).asc()])
    return first.select(document, F.col(metadata).alias("metadata"))


def text_chunks(pages: DataFrame, document: str, most: int = 1024, size: int = 4096, overlap: int = 100) -> DataFrame:
    """Chunks under the headers of each page, long ones cut by tokens, each with the first section of the page that it names."""
    key = F.struct(document, "page_num", F.transform(F.coalesce("blocks", F.array().cast("array<struct<section_ref:string>>")), lambda b: b["section_ref"]).alias("refs"))
    found = chunking.header_chunks(pages.select(key.alias("page"), "markdown"), "page", "markdown")
    parts = chunking.limited_chunks(found, "body", most, size, overlap)
    page, path = F.col("page.page_num"), F.array_join("hierarchy", " > ")
    label = F.when(F.size("hierarchy") > 0, path).otherwise(F.concat(F.lit("Page "), page.cast("string")))
    return parts.select(
        F.col(f"page.{document}").alias(document), page.alias("page"), F.lit("text").alias("kind"), (F.col("pos") * 100_000 + F.col("part")).cast("long").alias("pos"),
        "hierarchy", label.alias("section_label"), chunking.chunk_section(F.col("page.refs"), F.col("part_body")).alias("section_ref"), F.col("part_body").alias("body"),
    )


def table_chunks(pages: DataFrame, document: str) -> DataFrame:
    """Each table of a page as text, with the page's first section."""
    sections = F.transform("blocks", lambda b: b["section_ref"])
    ref = F.try_element_at(F.filter(sections, lambda s: s != ""), F.lit(1))
    rows = pages.select(document, F.col("page_num").alias("page"), ref.alias("section_ref"), F.posexplode("tables").alias("at", "table"))
    t = F.col("table")
    label = F.coalesce(t["caption"], F.concat(F.lit("Table "), (F.col("at") + 1).cast("string")))
    return rows.select(
        document, "page", F.lit("table").alias("kind"), F.col("at").cast("long").alias("pos"), F.array().cast("array<string>").alias("hierarchy"),
        label.alias("section_label"), "section_ref", text.table_markdown(t["caption"], t["headers"], t["rows"]).alias("body"),
    )


def assembled(pages: DataFrame, document: str, **limits: int) -> DataFrame:
    """All chunks of each document under one numbering, with reference ids and the metadata of its first page.

    ``pages``: the document, page_num, markdown, blocks array<struct<section_ref>>,
    tables array<struct<caption, headers, rows>>, metadata (any struct or string).
    """
    chunks = text_chunks(pages, document, **limits).unionByName(table_chunks(pages, document))
    name = F.col(document).cast("string")
    named = chunking.numbered(chunks, document).withColumn("ref_id", F.concat_ws("-", name, "chunk_name"))
    linked = named.withColumn("parent_section_id", F.when(F.col("section_ref").isNotNull(), F.concat_ws("-", name, "section_ref")))
    return linked.join(first_page_metadata(pages, document, "page_num", "metadata"), document, "left")


def with_page_info(results: DataFrame, infos: DataFrame, key: Sequence[str]) -> DataFrame:
    """Results with ``has_table`` and ``dpi`` of their page; no table and 150 where the page is not known."""
    joined = results.join(infos.select(*key, "has_table", "dpi"), list(key), "left")
    return joined.withColumns({"has_table": F.coalesce("has_table", F.lit(False)), "dpi": F.coalesce("dpi", F.lit(150))})


def page_batches(pages: DataFrame, document: str, order: str, size: int) -> DataFrame:
    """Adds ``batch`` and ``place``: pages in runs of ``size``, for one call each."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(order)) - 1
    return pages.withColumn("batch", F.floor(n / size)).withColumn("place", (n % size).cast("int"))


def filled_pages(translated: DataFrame, sent: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """Answers of a batch with the page number that stood in their place in what was sent, where they lack one."""
    given = sent.select(*keys, F.col(page).alias("_sent"))
    return translated.join(given, list(keys), "left").withColumn(page, F.coalesce(page, "_sent")).drop("_sent")


def opening_text(pages: DataFrame, document: str, order: str, body: str, n: int = 10, size: int = 5000) -> DataFrame:
    """The first ``size`` characters of the first ``n`` pages, an empty line between two."""
    first = top_per(pages.select(document, order, body), [document], [F.col(order).asc()], n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda p: p[body])
    return first.groupBy(document).agg(F.left(F.array_join(ordered, "\n\n"), F.lit(size)).alias("opening"))


def batch_structures(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each batch of pages that was answered as one: pages, mean complexity and tokens."""
    return pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.avg("complexity").alias("complexity"), F.sum("tokens").alias("tokens"))


def unified_structures(pages: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One structure for each batch of pages, as if the batch had been one page.

    ``pages``: the keys, ``order``, ``structure`` (see ``jsonx.page_structure``),
    complexity and tokens. Texts stand one after the other, an empty line
    between; blocks keep their order, their lines counted from the batch's start. Each field
    of the metadata is the first that a page knows. Entities of one name and
    type are one, the first. Tables of one caption and head are one, with all
    rows; a table without a caption stands alone. A page without a structure adds its complexity and tokens only.
    The order of pages decides, not how they are partitioned; a batch is the pages of one call.
    """
    said = F.struct(F.col(order).alias("at"), F.col("structure").alias("s"))
    batch = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(said)).alias("all"), F.count(F.lit(1)).alias("pages"), F.avg("complexity").alias("complexity"), F.sum("tokens").alias("tokens"))
    batch = batch.withColumn("all", F.transform(F.filter("all", lambda p: p["s"].isNotNull()), lambda p: p["s"]))
    texts = F.transform("all", lambda s: F.coalesce(s["markdown_content"], F.lit("")))
    height = lambda t: F.size(F.split(t, "\n")) + 1  # noqa: E731  (and the empty line behind it)
    joined = lambda name: F.flatten(F.transform("all", lambda s: s[name]))

    def moved(s: Column, i: Column) -> Column:
        above = F.aggregate(F.slice(F.col("_texts"), F.lit(1), i), F.lit(0), lambda n, t: n + height(t))
        return F.transform(s["reference_blocks"], lambda b: F.struct(b["section_ref"].alias("section_ref"), (b["start_line"] + above).alias("start_line"), (b["end_line"] + above).alias("end_line"), b["keywords"].alias("keywords")))

    fields = ("title", "jurisdiction_code", "authority", "citation_code", "language", "effective_date")
    known = lambda name: F.try_element_at(F.filter(F.transform("all", lambda s: F.nullif(s["metadata"][name], F.lit(""))), lambda v: v.isNotNull()), F.lit(1)).alias(name)
    entity = lambda e: F.struct(e["name"], e["type"])
    head = lambda t: F.struct(t["caption"], t["headers"])
    batch = batch.withColumn("_texts", texts).withColumn("_entities", joined("entities")).withColumn("_tables", joined("tables"))
    first_entity = F.filter("_entities", lambda e, i: F.array_position(F.transform("_entities", entity), entity(e)) == i + 1)
    nameless = lambda t: F.coalesce(t["caption"], F.lit("")) == ""
    first_table = F.filter("_tables", lambda t, i: nameless(t) | (F.array_position(F.transform("_tables", head), head(t)) == i + 1))
    rows = lambda t: F.when(nameless(t), t["rows"]).otherwise(F.flatten(F.transform(F.filter("_tables", lambda o: head(o) == head(t)), lambda o: F.coalesce(o["rows"], F.array().cast("array<array<string>>")))))
    tables = F.transform(first_table, lambda t: F.struct(t["caption"].alias("caption"), t["headers"].alias("headers"), rows(t).alias("rows")))
    blocks = F.flatten(F.transform("all", moved))
    structure = F.struct(F.lit(1).alias("page_num"), F.array_join("_texts", "\n\n").alias("markdown_content"), blocks.alias("reference_blocks"), F.struct(*map(known, fields)).alias("metadata"), first_entity.alias("entities"), tables.alias("tables"))
    return batch.withColumn("structure", structure).select(*keys, "pages", "complexity", "tokens", "structure")


def case_chunk(case_id: Column, body: Column, products: Column, strategy: Column, country: Column) -> Column:
    """A case as a chunk: the text to embed, and its metadata; cases without a country are of US, which alone is in English."""
    said = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("Regulation: "), body))
    names = F.when(F.size(products) > 0, F.concat(F.lit("Products: "), F.array_join(products, ", ")))
    return F.struct(
        case_id.alias("case_id"), F.concat_ws("\n", said, names).alias("text"), F.coalesce(country, F.lit("US")).alias("country"),
        F.when(country == "US", "en").otherwise("ko").alias("lang"), F.size(products).alias("n_products"),
        (F.coalesce(strategy, F.lit("")) != "").alias("has_strategy"),
    )
