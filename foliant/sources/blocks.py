"""Page blocks: the input contract of the document flow, and adapters that make it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T

LINES = "array<struct<spans:array<struct<text:string,font:string,size:double>>>>"
BLOCKS = f"doc_id long, page_number int, page_width double, page_height double, block_no int, block_type int, bbox struct<x0:double,y0:double,x1:double,y1:double>, lines {LINES}, xref string, ext string, image binary"
WIDTH, HEIGHT = 612.0, 792.0


def read_blocks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A1, A4: block rows that a PDF reader wrote as JSON lines (or multi-line JSON with multiLine=true).

    PDF bytes themselves are left to external readers; a missing path is an error.
    """
    return spark.read.options(**options).schema(BLOCKS).json(path)


def page_ranges(documents: DataFrame, per_chunk: int, doc_id: str = "doc_id", pages: str = "total_pages") -> DataFrame:
    """A2: (doc_id, start_page, end_page), 1-based and inclusive; no rows for a document without pages."""
    size = max(1, per_chunk)
    begin = documents.where(F.col(pages) > 0).select(doc_id, pages, F.explode(F.sequence(F.lit(1), F.col(pages), F.lit(size))).alias("start_page"))
    return begin.select(doc_id, "start_page", F.least(F.col("start_page") + (size - 1), F.col(pages)).cast("int").alias("end_page"))


def read_range(blocks: DataFrame, start: int, end: int, total: int | None = None) -> DataFrame:
    """A3: the pages of one range of a document; one that is not 1 <= start <= end <= total is an error.

    total is the document's page count; if it is not given, the last page that has a block.
    """
    if total is None:
        total = blocks.agg(F.max("page_number")).first()[0] or 0
    if not 1 <= start <= end <= total:
        raise ValueError(f"pages {start} to {end} are no range of {total}")
    return blocks.where(F.col("page_number").between(start, end))


def read_ranges(blocks: DataFrame, ranges: DataFrame, per_chunk: int) -> DataFrame:
    """A3 for many documents: blocks with start_page and end_page of the range that holds their page.

    ranges are those of page_ranges with the same per_chunk, which says where a page's range starts:
    a page meets its own range alone. Blocks of pages that no range holds go.
    """
    size = max(1, per_chunk)
    start = (F.floor((F.col("page_number") - 1) / size) * size + 1).cast("int")
    joined = blocks.withColumn("start_page", start).join(ranges.select("doc_id", "start_page", "end_page"), ["doc_id", "start_page"])
    return joined.where("page_number <= end_page")


# ------------------------------------------------------------------ what a page reader gives beside blocks


def drawing_scan(pages: DataFrame) -> DataFrame:
    """A row per drawing of (doc_id, page_number, drawings: array of (rect, items)); item_count counts the items."""
    rows = pages.select("doc_id", "page_number", F.posexplode("drawings").alias("position", "d"))
    return rows.select("doc_id", "page_number", "position", G.box(F.col("d.rect")).alias("bbox"), F.greatest(F.lit(0), F.coalesce(F.size("d.items"), F.lit(0))).alias("item_count"))


def table_scan(pages: DataFrame) -> DataFrame:
    """A row per table of (doc_id, page_number, tables: array of (bbox, rows, columns, column_count)).

    Columns may be a list, which is counted, or a number; missing ones count 0. Null tables give no rows.
    """
    rows = pages.select("doc_id", "page_number", F.posexplode("tables").alias("position", "t"))
    counted = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return rows.select(
        "doc_id", "page_number", "position", G.box(F.col("t.bbox")).alias("bbox"),
        F.coalesce(counted("t.rows"), F.lit(0)).alias("row_count"), F.coalesce(counted("t.columns"), F.col("t.column_count"), F.lit(0)).cast("int").alias("column_count"),
    )


def link_scan(pages: DataFrame) -> DataFrame:
    """A row per link of (doc_id, page_number, links: array of (from, uri, page)); the target page stays as it is."""
    rows = pages.select("doc_id", "page_number", F.posexplode("links").alias("position", "l"))
    return rows.select("doc_id", "page_number", "position", G.box(F.col("l.from")).alias("bbox"), "l.uri", F.col("l.page").alias("destination_page"))


def annotation_scan(pages: DataFrame) -> DataFrame:
    """A10: a row per annotation of (doc_id, page_number, annotations: array of (rect, type, content)); content may be null."""
    rows = pages.select("doc_id", "page_number", F.posexplode("annotations").alias("position", "a"))
    return rows.select("doc_id", "page_number", "position", G.box(F.col("a.rect")).alias("bbox"), F.col("a.type").alias("kind"), "a.content")


def _span(c: Column, font: Column, size: Column) -> Column:
    return F.struct(F.array(F.struct(c.alias("text"), font.alias("font"), size.alias("size"))).alias("spans"))


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, line, k): the lines of a text, each with a marker number from 0 to 11."""
    rows = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    return rows.withColumn("k", ((F.col("doc_id") * 7 + F.col("i")) % 12).cast("int"))


def blocks_from_documents(docs: DataFrame) -> DataFrame:
    """Blocks of the canonical adapter: every line becomes a block of a kind that its marker says.

    Eight lines make a page of 612 by 792. 0 heading, 1 figure caption, 2 and 3 list items,
    4 and 5 code, 6 a bare number, 7 a running header, 8 a citation set in a code font, 9 a
    line cut by a hyphen, 10 plain, 11 plain or an image or a kind that is skipped. What 4 to
    9 make of a line cuts or replaces it, so a second block below has the whole line.
    """
    i, k, line, part = F.col("i"), F.col("k"), F.col("line"), F.col("part")
    s = i.cast("string")
    code = F.when(i % 2 == 0, F.concat(F.lit("call_"), s, F.lit("(a, b);\nreturn x["), k.cast("string"), F.lit("];")))
    code = code.otherwise(F.concat(F.lit("call("), s, F.lit(", {"), F.lit("\ny = 1")))
    more = F.when(i % 3 == 0, F.lit("The following query returns:")).when(i % 3 == 1, F.concat(F.lit("SELECT a, b FROM t_"), s, F.lit(" WHERE a = 1 AND b = 2 ORDER BY a;")))
    more = more.otherwise(F.concat(F.lit("else {"), F.lit("\n  z = "), s, F.lit(";\n}")))
    body = (
        F.when(k == 1, F.concat(F.lit("Figure "), s, F.lit(" "), line))
        .when(k == 2, F.concat(F.lit("10. "), line))
        .when(k == 3, F.concat(F.lit("- "), line))
        .when(k == 4, code)
        .when(k == 5, more)
        .when(k == 6, s)
        .when(k == 7, F.concat(F.left(line, F.lit(20)), F.lit(" | "), s))
        .when(k == 8, F.concat(F.lit("["), s, F.lit("] "), F.left(line, F.lit(24)), F.lit(" ISBN 978 Press 2017")))
        .when(k == 9, F.concat(F.left(line, F.lit(60)), F.lit("a-\nb"), F.when(i % 2 == 0, F.lit(" end-")).otherwise(F.lit(" end"))))
        .otherwise(line)
    )
    font = F.when(k.isin(4, 5, 8), F.lit("Courier New")).otherwise(F.lit("Serif"))
    size = F.when(k == 0, F.lit(16.0)).otherwise(F.lit(10.0))
    kind = F.when((k == 11) & (i % 5 == 0), 1).when((k == 11) & (i % 5 == 1), 2).otherwise(0)
    x0 = F.when((F.col("doc_id") % 5 == 0) & (i % 2 == 1), F.lit(350.0)).otherwise(F.lit(60.0))
    y0 = F.lit(40.0) + 90.0 * (i % 8) + 45.0 * part
    image = F.col("block_type") == 1
    return (
        marked_lines(docs)
        .withColumn("part", F.explode(F.when(k.between(4, 9), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .withColumn("k", F.when(part == 1, 10).otherwise(k))
        .withColumn("block_type", kind)
        .select(
            "doc_id",
            (F.floor(i / 8) + 1).cast("int").alias("page_number"),
            F.lit(WIDTH).alias("page_width"),
            F.lit(HEIGHT).alias("page_height"),
            (i % 8 * 2 + part).cast("int").alias("block_no"),
            "block_type",
            F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 200.0).alias("x1"), (y0 + 80.0).alias("y1")).alias("bbox"),
            F.when(F.col("block_type") == 0, F.transform(F.split(body, "\n", -1), lambda x: _span(x, font, size))).cast(LINES).alias("lines"),
            F.when(image, s).alias("xref"),
            F.when(image, F.when(i % 2 == 0, F.lit(" PNG")).otherwise(F.lit(""))).alias("ext"),
            F.lit(None).cast("binary").alias("image"),
        )
    )


def last_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, last_page) of the canonical adapter: pages have no gaps, so the longest text of a doc_id tells them."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return docs.where("doc_id is not null").groupBy("doc_id").agg((F.floor((F.max(lines) - 1) / 8) + 1).cast("int").alias("last_page"))


def page_numbers(docs: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number) of the canonical adapter, or those up to the last pages where these are known."""
    last = last_pages(docs) if last is None else last
    return last.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("last_page"))).alias("page_number"))


def drawings_from_documents(docs: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """One drawing for each page of the canonical adapter, some small, some of few parts."""
    n = F.col("doc_id") + F.col("page_number")
    side = F.when(n % 3 == 0, F.lit(20.0)).otherwise(F.lit(200.0))
    one = F.struct(F.array(F.lit(60.0), F.lit(100.0), 60.0 + side, 100.0 + side).alias("rect"), F.array_repeat(F.lit("l"), (n % 5).cast("int")).alias("items"))
    return drawing_scan(page_numbers(docs, last).withColumn("drawings", F.array(one)))


def scans_from_documents(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables, links and annotations of the canonical adapter's pages, some without a box, count or content."""
    n = F.col("doc_id") + F.col("page_number")
    box = lambda *xs: F.array(*[F.lit(x) for x in xs])
    table = F.struct(
        F.when(n % 12 == 0, box(1.0, 2.0)).otherwise(box(10.0, 20.0, 316.0, 416.0)).alias("bbox"),
        F.when(n % 3 != 1, F.sequence(F.lit(1), (n % 3 + 2).cast("int"))).alias("rows"),
        F.when(n % 8 == 0, F.array(F.lit("a"), F.lit("b"))).alias("columns"),
        F.when(n % 5 != 0, (n % 5).cast("int")).alias("column_count"),
    )
    links = F.array(
        F.struct(box(5.0, 6.0, 50.0, 16.0).alias("from"), F.concat(F.lit("https://example.org/"), n.cast("string")).alias("uri"), F.lit(None).cast("int").alias("page")),
        F.struct(box().cast("array<double>").alias("from"), F.lit(None).cast("string").alias("uri"), (n % 7).cast("int").alias("page")),
    )
    note = F.struct(box(1.0, 700.0, 90.0, 720.0).alias("rect"), F.lit("Highlight").alias("type"), F.when(n % 2 == 1, F.concat(F.lit("note "), n.cast("string"))).alias("content"))
    pages = page_numbers(docs).select("doc_id", "page_number", F.when(n % 4 == 0, F.array(table)).alias("tables"), F.when(n % 2 == 0, links).alias("links"), F.when(n % 3 == 1, F.array(note)).alias("annotations"))
    return {"tables": table_scan(pages), "links": link_scan(pages), "annotations": annotation_scan(pages)}


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, position, elem_type, text, uri) of raw HTML, in document order.

    h1 is a heading, p a paragraph, li a list item, a a link, nav and footer header_footer.
    Only opening tags are matched, each with the text up to the next tag, since closing tags
    may be missing. A null page has no elements.
    """
    tag = r"(?i)<(?:h1|p|li|a|nav|footer)(?:\s[^<>]*)?>[^<]*"
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(tag), F.lit(0))).alias("position", "m"))
    name = F.lower(F.regexp_extract("m", r"^<([A-Za-z0-9]+)", 1))
    kinds = {"h1": "heading", "p": "paragraph", "li": "list_item", "a": "link", "nav": "header_footer", "footer": "header_footer"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), name)
    text = T.single_line(F.regexp_extract("m", r"^<[^>]*>([\s\S]*)$", 1))
    href = F.regexp_extract("m", r"(?i)href=\"([^\"]*)\"", 1)
    return found.select("page_id", F.col("position").cast("int").alias("position"), kind.alias("elem_type"), text.alias("text"), F.when((name == "a") & (href != ""), href).alias("uri"))
