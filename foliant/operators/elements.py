"""Blocks to typed elements in one reading order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.operators.scans import BLOCK, two_level

#: The order in which elements with one index follow each other.
TYPES = ("heading", "paragraph", "list_item", "caption", "code_block", "image", "table", "drawing", "link", "annotation", "header_footer", "page_number")
#: Scan order of a page.
SOURCES = ("block", "drawing", "table", "link", "annotation")
STRIDE = 100_000
#: Pages of a document that one task puts in order.
PAGES = 128
#: What an element has beyond keys, order, type and geometry.
FIELDS = {
    "text": "string", "font_size": "double", "region": "string", "image_index": "int", "image_xref": "int", "image_ext": "string", "image_bytes": "binary",
    "row_count": "int", "column_count": "int", "item_count": "int", "uri": "string", "destination_page": "int", "kind": "string", "content": "string",
}


def type_ordinal(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), c).cast("int") - 1


def shaped(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Adds the fields of FIELDS that df lacks as nulls, in one column order; more columns follow."""
    keys = ["doc_id", "page_number", "reading_order_index", "elem_type", "bbox", "norm_bbox"]
    return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()], *more)


def block_texts(blocks: DataFrame) -> DataFrame:
    """Blocks with text, fonts, sizes and boxes.

    What block_type asks of the text (`shown`, `text_kind`, `is_number`) is answered here, before blocks meet
    on their page: a reading that needs the types alone shuffles no text.
    """
    text_block = F.col("block_type") == 0
    sizes = F.when(text_block, T.font_sizes(F.col("lines"))).otherwise(F.array().cast("array<double>"))
    facts = blocks.select(
        "doc_id", "page_number", "page_width", "page_height", "block_no", "block_type", "xref", "ext", "image",
        F.when(text_block, T.block_text(F.col("lines"))).alias("text"),
        F.when(text_block, T.fonts(F.col("lines"))).alias("fonts"),
        sizes.alias("sizes"),
        G.with_size(F.col("bbox")).alias("bbox"),
        G.normal(F.col("bbox"), F.col("page_width"), F.col("page_height")).alias("norm_bbox"),
    )
    # the text of a block is stripped, so its head begins where it does
    return facts.withColumn("__h", F.left("text", F.lit(8))).select("*", *text_tests()).drop("__h")


def with_body_size(facts: DataFrame, page: WindowSpec) -> DataFrame:
    """block_texts with the page's body size (E1) and the block's largest size (E2) in place of its sizes."""
    # sizes are sifted before they meet, as what stands over a window is computed for each row of it
    facts = facts.withColumn("__m", F.array_max("sizes")).withColumn("sizes", F.filter("sizes", lambda x: x > 0))
    # the median over the spans of the page: sizes are gathered per page, whose block count a page bounds
    all_sizes = F.sort_array(F.flatten(F.collect_list("sizes").over(page)))
    n = F.size("__s")
    mid = F.when(n == 0, F.lit(10.0)).otherwise((F.get("__s", F.floor((n - 1) / 2).cast("int")) + F.get("__s", F.floor(n / 2).cast("int"))) / 2)
    return facts.withColumn("__s", all_sizes).withColumn("body_size", mid).withColumn("max_size", F.coalesce("__m", F.col("body_size"))).drop("__s", "__m", "sizes")


def block_facts(blocks: DataFrame) -> DataFrame:
    """Blocks with all that block_type asks of them and of their page."""
    return with_body_size(block_texts(blocks), Window.partitionBy("doc_id", "page_number"))


def text_tests() -> list[Column]:
    """What a block's text, its head and its fonts say by themselves (D3, D5 to D7): whether it is shown, its kind if they decide, whether it is a number."""
    h = F.col("__h")
    shown = (F.col("block_type") == 0) & (h != "")
    kind = F.when(T.caption_head(h), "caption").when(T.item_head(h), "list_item").when(T.is_code(F.col("text"), F.col("fonts")), "code_block")
    return [shown.alias("shown"), F.when(shown, kind).alias("text_kind"), T.only_if(shown, T.number_head(h)).alias("is_number")]


def block_type(facts: DataFrame) -> DataFrame:
    """Facts with `elem_type` (null: nothing is emitted), `is_number` and `region`."""
    shown = F.col("shown")
    kind = F.coalesce("text_kind", F.when(F.col("max_size") >= F.col("body_size") * 1.25, "heading").otherwise("paragraph"))
    return facts.select(
        *[c for c in facts.columns if c not in ("shown", "text_kind", "is_number")],
        F.when(F.col("block_type") == 1, "image").when(shown, kind).alias("elem_type"),
        "is_number",
        F.when(shown, G.region(F.col("norm_bbox"))).alias("region"),
    )


def local_index(page: WindowSpec) -> Column:
    """Place within the page by source and position, from 0."""
    return F.row_number().over(page.orderBy("source_ordinal", "position")) - 1


def page_range(pages: int = PAGES) -> Column:
    """Which range of a document's pages a page is in, from 0."""
    return F.coalesce(F.floor((F.greatest(F.lit(1), F.col("page_number")) - 1) / pages), F.lit(0)).cast("long")


def elements(blocks: DataFrame, drawings: DataFrame | None = None, tables: DataFrame | None = None, links: DataFrame | None = None, annotations: DataFrame | None = None, ranged: bool = False) -> DataFrame:
    """All elements of all pages, each with its index in the page.

    A block that gives nothing (skipped kind, blank text) still takes an index. A text block
    may give up to three elements with one index: its class, a page number, and a header or
    footer. The other scans follow the blocks in the order drawings, tables, links,
    annotations; each needs doc_id, page_number, position and bbox, and brings its fields.
    Images are counted by in_order, over all pages.

    Blocks and scans meet before they are dealt, by ranges of pages, so that a text is shuffled once.
    ranged keeps the range, by which in_order then goes: for pages that hold fewer than STRIDE elements.
    """
    facts = block_texts(blocks)
    scans = {"drawing": drawings, "table": tables, "link": links, "annotation": annotations}
    parts = [facts.drop("fonts").withColumnRenamed("block_no", "position").withColumn("source_ordinal", F.lit(0))]
    for name, scan in scans.items():
        if scan is not None:
            own = [c for c in FIELDS if c in scan.columns and c not in ("font_size", "region")]
            parts.append(scan.select("doc_id", "page_number", F.lit(SOURCES.index(name)).alias("source_ordinal"), "position", G.with_size(F.col("bbox")).alias("bbox"), *own))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    every = every.withColumn(BLOCK, page_range()).repartition("doc_id", BLOCK)
    page = Window.partitionBy("doc_id", BLOCK, "page_number")
    # a scan's box is set by the size of the page's blocks
    size = lambda c: F.coalesce(F.when(F.col("doc_id").isNotNull() & F.col("page_number").isNotNull(), F.max(c).over(page)), F.lit(0.0))
    every = every.withColumn("reading_order_index", local_index(page)).withColumns({"__w": size("page_width"), "__h": size("page_height")})
    scanned = F.col("source_ordinal") > 0
    every = every.withColumn("norm_bbox", F.when(scanned, G.normal(F.col("bbox"), F.col("__w"), F.col("__h"))).otherwise(F.col("norm_bbox")))
    every = block_type(with_body_size(every, page))
    every = every.withColumn("elem_type", F.when(scanned, F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("source_ordinal"))).otherwise(F.col("elem_type"))).withColumnRenamed("max_size", "font_size")
    image = F.col("elem_type") == "image"
    if {"xref", "ext"} <= set(every.columns):
        digits = F.regexp_extract(F.coalesce("xref", F.lit("")), r"^(\d+)$", 1)
        ext = F.lower(T.strip(F.coalesce("ext", F.lit(""))))
        every = every.select(
            "*",
            F.when(image & (digits != ""), digits.try_cast("int")).alias("image_xref"),
            F.when(image & (ext != ""), ext).alias("image_ext"),
            F.when(image, F.col("image")).alias("image_bytes"),
        )
    kinds = F.filter(
        F.array(
            F.struct(F.col("elem_type").alias("t")),
            F.struct(F.when(F.col("region").isNotNull() & (F.col("source_ordinal") == 0), "header_footer").alias("t")),
            F.struct(F.when(F.coalesce("is_number", F.lit(False)), "page_number").alias("t")),
        ),
        lambda x: x["t"].isNotNull(),
    )
    out = every.withColumn("__k", F.explode(kinds)).withColumn("elem_type", F.col("__k.t"))
    out = out.withColumn("font_size", F.when(F.col("elem_type") == "heading", F.col("font_size"))).withColumn("region", F.when(F.col("elem_type") == "header_footer", F.col("region")))
    return shaped(out, [BLOCK] if ranged else [])


def in_order(elems: DataFrame, stride: int = STRIDE, pages: int = PAGES, several: DataFrame | None = None) -> DataFrame:
    """Elements in the order of their index over all pages; headings on one line.

    Adds `type_ordinal`, `pos` (from 1 within the document), `image_index` (W2), and `headings`, how many
    headings stand up to here, with `headings_total`, how many the document has. A task orders
    `pages` pages of a document; what stands before them is the sum of the ranges before. Elements that
    come ranged are in the tasks that order them already, and stay there. several are the elements of all
    documents of more than `pages` pages, if these are known: then no others are counted beforehand.
    """
    stride = max(1, stride)
    index = F.col("reading_order_index").cast("long") + (F.greatest(F.lit(1), F.col("page_number")) - 1) * F.lit(stride).cast("long")
    text = F.when(F.col("elem_type") == "heading", T.single_line(F.col("text"))).otherwise(F.col("text"))
    out, more = (e and e.withColumns({"reading_order_index": index, "type_ordinal": type_ordinal(F.col("elem_type")), "text": text}) for e in (elems, several))
    one = lambda kind: (F.col("elem_type") == kind).cast("long")
    block = None if BLOCK in elems.columns else F.floor(F.col("reading_order_index") / (stride * pages))
    counted = two_level(out, ["doc_id"], block, ["reading_order_index", "page_number", "type_ordinal"], {"pos": F.lit(1).cast("long"), "images": one("image"), "headings": one("heading")}, several=more)
    return counted.withColumn("image_index", F.when(F.col("elem_type") == "image", F.col("images")).cast("int")).drop("images", "images_total", "pos_total")


def pages(elems: DataFrame) -> DataFrame:
    """One row per (doc_id, page) with an array of elements for each type, named as the type."""
    rows = elems.select("doc_id", F.col("page_number").alias("page"), "elem_type", F.struct("reading_order_index", "text", "bbox", "norm_bbox").alias("item"))
    own = [F.array_sort(F.collect_list(F.when(F.col("elem_type") == t, F.col("item")))).alias(t) for t in TYPES]
    return rows.groupBy("doc_id", "page").agg(*own)
