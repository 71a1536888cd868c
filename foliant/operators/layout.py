"""What a page's layout tells: table regions from words (A8), and texts that recur from page to page.

Both work on pages of any document at once: words and blocks meet on their page, whose size
bounds them, and recurring texts are counted by document before anything is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.operators import tables as R

PAGE = ["doc_id", "page_number"]

# ------------------------------------------------------------------ table regions


def row_bands(words: DataFrame, gap: float) -> DataFrame:
    """(doc_id, page_number, band, y0, y1, x0, x1, white): words whose heights overlap, directly or through others.

    This is the projection of the words on the page's height, cut where it is white. white are the
    intervals (a, b) between the words that are at least `gap` wide, from the left: the band's projection
    on the page's width, where it is white.
    """
    down = Window.partitionBy(*PAGE).orderBy("y0", "y1", "x0", "x1")
    above = F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    rows = words.withColumn("__new", F.coalesce(F.col("y0") >= above, F.lit(True)).cast("int"))
    rows = rows.withColumn("band", F.sum("__new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    # how far the words reach that begin before, so that a band of any number of words is passed once
    across = Window.partitionBy(*PAGE, "band").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__right", F.max("x1").over(across))
    hole = F.when(F.col("x0") - F.col("__right") >= gap, F.struct(F.col("__right").alias("a"), F.col("x0").alias("b")))
    return rows.groupBy(*PAGE, "band").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_sort(F.collect_list(hole)).alias("white"))


def common_white(a: Column, b: Column, gap: float) -> Column:
    """What two lists of white intervals have in common, where it is at least `gap` wide; each list's are apart.

    Both lists' ends are put in one order. After an even number of them none or two intervals are open, and
    two if the last of them opens one: so no interval meets all of the other list.
    """
    end = lambda side, opens: lambda w: F.struct(w[side].alias("at"), F.lit(opens).alias("opens"))
    ends = F.array_sort(F.concat(*[F.transform(w, end(side, opens)) for w in (a, b) for side, opens in (("a", True), ("b", False))]))

    def cut(e: Column) -> Column:
        pairs = F.transform(e, lambda x, k: F.struct(x["at"].alias("a"), F.get(e, k + 1)["at"].alias("b"), (x["opens"] & (k % 2 == 1)).alias("both")))
        wide = F.filter(pairs, lambda w: w["both"] & (w["b"] - w["a"] >= gap))
        return F.transform(wide, lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b")))

    return T.let(ends, cut)


def detected_tables(words: DataFrame, gap: float = 12.0, least_rows: int = 3) -> DataFrame:
    """(doc_id, page_number, position, bbox, row_count, column_count): table regions, from the top of each page.

    A region is a run of bands, at least `least_rows` of them, that share a white column of at
    least `gap`: from the first band on the white columns are cut down to what the next one leaves, and
    the run ends where it leaves none. position counts from 0. Pages without words have no regions.
    """
    band = F.struct("band", "y0", "y1", "x0", "x1", "white")
    pages = row_bands(words, gap).groupBy(*PAGE).agg(F.array_sort(F.collect_list(band)).alias("bands"))
    region = "struct<first:bigint,last:bigint,n:int,columns:int>"
    white = "array<struct<a:double,b:double>>"
    begin = F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).alias("n"), F.array().cast(white).alias("white"), F.array().cast(f"array<{region}>").alias("out"))

    def closed(s: Column, upto: Column) -> Column:
        one = F.struct(s["first"].alias("first"), upto.alias("last"), s["n"].alias("n"), (F.size(s["white"]) + 1).alias("columns"))
        return F.when(s["n"] >= least_rows, F.concat(s["out"], F.array(one))).otherwise(s["out"])

    def step(s: Column, b: Column) -> Column:
        def gone_on(kept: Column) -> Column:
            goes_on = (s["n"] > 0) & (F.size(kept) > 0)
            return F.struct(
                F.when(goes_on, s["first"]).otherwise(b["band"]).alias("first"),
                F.when(goes_on, s["n"] + 1).otherwise((F.size(b["white"]) > 0).cast("int")).alias("n"),
                F.when(goes_on, kept).otherwise(b["white"]).alias("white"),
                F.when(goes_on, s["out"]).otherwise(closed(s, b["band"] - 1)).alias("out"),
            )

        return T.let(common_white(s["white"], b["white"], gap), gone_on)

    found = F.aggregate("bands", begin, step, lambda s: closed(s, F.array_max(F.transform("bands", lambda b: b["band"]))))
    boxes = F.transform("bands", lambda b: F.struct(*[b[k].alias(k) for k in ("band", *G.SIDES)]))
    rows = pages.select(*PAGE, boxes.alias("boxes"), F.posexplode(found).alias("position", "r"))
    own = F.filter("boxes", lambda b: b["band"].between(F.col("r.first"), F.col("r.last")))
    side = lambda agg, k: agg(F.transform(own, lambda b: b[k])).alias(k)
    box = F.struct(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))
    return rows.select(*PAGE, "position", box.alias("bbox"), F.col("r.n").alias("row_count"), F.col("r.columns").alias("column_count"))


def scored_tables(words: DataFrame, drawings: DataFrame | None, page_width: float, gap: float = 12.0) -> DataFrame:
    """Regions of detected_tables with the score and verdict of E7 (score, is_table, reasons)."""
    regions = detected_tables(words, gap).withColumnRenamed("position", "region_no")
    lined = R.grouped_lines(R.words_in(words, regions.select(*R.REGION, "bbox")))
    scores = R.table_score(R.region_metrics(lined, regions.select(*R.REGION, "bbox"), drawings, page_width))
    return regions.join(scores.select(*R.REGION, "score", "is_table", "reasons"), R.REGION).withColumnRenamed("region_no", "position")


# ------------------------------------------------------------------ recurring headers and footers


def masked(text: Column) -> Column:
    """A text on one line with every run of digits as one sign."""
    return F.regexp_replace(T.single_line(text), "[0-9]+", "#")


def recurring_texts(blocks: DataFrame, depth: int = 2, least_pages: int = 3, share: float = 0.8) -> DataFrame:
    """Running headers and footers: (doc_id, band, place, text, n_pages, first_page, last_page, shift).

    blocks are (doc_id, page_number, block_no, bbox, text). What stands among the first or last `depth`
    non-blank blocks of a page, by (y0, x0, block_no), is a candidate with its band (top or
    bottom) and place, 1 at the edge. Candidates of a document that are alike but for their digits recur if they
    stand on at least `least_pages` pages. Where a text ends in a number it has to go along with the
    pages: shift, the number less the page's, must be one and the same on at least `share` of
    the pages, else it is no running text. shift is null for texts that do not end in a number. A page
    of few blocks may give one to both bands.
    """
    order = ["y0", "x0", "block_no"]
    rows = blocks.where(T.strip(F.coalesce("text", F.lit(""))) != "").select(*PAGE, "block_no", "bbox.y0", "bbox.x0", "text")
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumns({"top": F.row_number().over(page.orderBy(*order)), "bottom": F.row_number().over(page.orderBy(*[F.desc(c) for c in order]))})
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("place")) for b in ("top", "bottom")])
    near = rows.select(*PAGE, "text", F.explode(F.filter(bands, lambda b: b["place"] <= depth)).alias("b")).select(*PAGE, "b.band", "b.place", T.single_line(F.col("text")).alias("text"))
    number = F.regexp_extract("text", r"([0-9]{1,9})$", 1)
    near = near.select("doc_id", "page_number", "band", "place", masked(F.col("text")).alias("text"), (F.when(number != "", number).cast("long") - F.col("page_number")).alias("shift"))
    alike = ["doc_id", "band", "place", "text"]
    # shifts are counted first, so that a text on very many pages is summed up where its pages are
    shifts = near.groupBy(*alike, "shift").agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    most = F.max(F.when(F.col("shift").isNotNull(), F.struct("n", (-F.col("shift")).alias("s"))))
    out = shifts.groupBy(*alike).agg(F.sum("n").alias("n_pages"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), most.alias("m"))
    return out.where((F.col("n_pages") >= least_pages) & (F.col("m").isNull() | (F.col("m.n") >= share * F.col("n_pages")))).select(*alike, "n_pages", "first_page", "last_page", (-F.col("m.s")).alias("shift"))
