"""Sections: boundaries, selection, cleaning, merging, reflow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.scans import two_level

SECTION = ["doc_id", "section_number"]


#: Elements that one task counts where a frame does not come from the reading order.
ELEMENTS = 1 << 14


def detect_sections(ordered: DataFrame) -> DataFrame:
    """Adds section_number, from 1, and sections_total; what stands before a document's first heading goes.

    The reading order has counted the headings already; rows without these counts are counted here by pos.
    """
    if "headings" not in ordered.columns:
        ordered = two_level(ordered, ["doc_id"], F.floor(F.col("pos") / ELEMENTS), ["pos"], {"headings": (F.col("elem_type") == "heading").cast("long")})
    numbered = ordered.withColumns({"section_number": F.col("headings").cast("int"), "sections_total": F.col("headings_total").cast("int")})
    return numbered.where("section_number > 0").drop("headings", "headings_total")


def united(ranges: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """Inclusive ranges as the fewest that do not meet, in order; what is no pair of whole numbers is ignored."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((min(r), max(r)) for r in ranges if len(r) == 2 and all(isinstance(x, int) for x in r)):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def select_sections(sections: DataFrame, ranges: Sequence[Sequence[int]] = ((15, 238),)) -> DataFrame:
    """The sections in the union of inclusive ranges; a document in which none is, keeps all.

    Ends may be given in either order and reach beyond the last section; what is no pair of
    whole numbers is ignored. Adds kept_number, the place of a section among those that are
    kept: sections are numbered without gaps, so it and whether any is hit follow from the ranges.
    """
    n, total = F.col("section_number"), F.col("sections_total")
    hit, any_hit, upto = F.lit(False), F.lit(False), F.lit(0)
    for low, high in united(ranges):
        hit, any_hit = hit | n.between(low, high), any_hit | ((total >= low) & F.lit(high >= 1))
        upto = upto + F.greatest(F.lit(0), F.least(n, F.lit(high)) - F.lit(max(1, low)) + 1)
    return sections.withColumn("kept_number", F.when(any_hit, upto).otherwise(n).cast("int")).where(hit | ~any_hit)


def united_table(ranges: DataFrame) -> DataFrame:
    """W17 on a table: (doc_id, low, high) as the fewest ranges that do not meet, with `before`, how many numbers the earlier ones hold.

    Ends may come in either order; rows with a null are left out, and so is what lies below 1.
    """
    clean = ranges.select("doc_id", F.greatest(F.lit(1), F.least("low", "high")).cast("long").alias("low"), F.greatest("low", "high").cast("long").alias("high"), (F.col("low") + F.col("high")).alias("__b"))
    clean = clean.where("doc_id is not null and __b is not null and high >= 1").select("doc_id", "low", "high").distinct()
    order = Window.partitionBy("doc_id").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = clean.withColumn("__new", F.coalesce(F.col("low") > reach + 1, F.lit(True)).cast("int"))
    islands = starts.withColumn("__k", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "__k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    earlier = Window.partitionBy("doc_id").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    return islands.select("doc_id", "low", "high", F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(earlier), F.lit(0)).alias("before"))


def select_by_table(sections: DataFrame, ranges: DataFrame) -> DataFrame:
    """D16, W17, J9 with ranges that come as rows (doc_id, low, high): as select_sections does, document by document.

    Ranges and sections of a document are put in one order, and a section looks up the last range that
    begins at or before it: a sorted search in which no section meets all ranges. A document without ranges keeps all.
    """
    islands = united_table(ranges)
    least = islands.groupBy("doc_id").agg(F.min("low").alias("__least"))
    known = sections.join(least, "doc_id", "left")
    marks = islands.select("doc_id", F.col("low").alias("section_number"), F.struct("low", "high", "before").alias("__own"))
    rows = known.withColumn("__mark", F.lit(1)).unionByName(marks.withColumn("__mark", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumn("__at", F.col("section_number").cast("long"))
    found = two_level(rows, ["doc_id"], F.floor(F.col("__at") / ELEMENTS), ["__at", "__mark"], lasts={"__range": F.col("__own")}).where("__mark = 1")
    hit = F.coalesce(F.col("section_number") <= F.col("__range.high"), F.lit(False))
    any_hit = F.coalesce(F.col("__least") <= F.col("sections_total"), F.lit(False))
    number = F.when(any_hit, F.col("__range.before") + F.col("section_number") - F.col("__range.low") + 1).otherwise(F.col("section_number"))
    kept = found.where(hit | ~any_hit).withColumn("kept_number", number.cast("int"))
    return kept.select(*[F.col(c).cast(sections.schema[c].dataType).alias(c) for c in sections.columns], "kept_number")


def preclean(sections: DataFrame) -> DataFrame:
    """Noise goes, hyphens are mended, captions among paragraphs are named so; one pass over the rows."""
    kind, text = F.col("elem_type"), F.col("text")
    area = F.col("norm_bbox.width") * F.col("norm_bbox.height")
    gone = kind.isin("link", "header_footer", "page_number") | T.only_if(kind == "paragraph", T.is_artifact_early(text)) | ((kind == "drawing") & ((area <= 0.002) | (F.col("item_count") <= 2)))
    out = sections.where(~F.coalesce(gone, F.lit(False)))
    out = out.withColumn("text", F.when(kind.isin("heading", "paragraph", "list_item", "caption"), T.mend_hyphens(text)).otherwise(text))
    return out.withColumn("elem_type", F.when(T.only_if(kind == "paragraph", T.is_late_caption(text)), "caption").otherwise(kind))


def demote_code(sections: DataFrame, fixed: bool = False) -> DataFrame:
    """Code blocks that are prose, citations or running headers become paragraphs."""
    out = sections.withColumn("__d", T.only_if(F.col("elem_type") == "code_block", T.is_prose_in_code(F.col("text"), fixed)))
    return out.withColumn("text", F.when(F.col("__d"), T.normalized(F.col("text"))).otherwise(F.col("text"))).withColumn("elem_type", F.when(F.col("__d"), "paragraph").otherwise(F.col("elem_type"))).drop("__d")


# ------------------------------------------------------------------ W6

HARD, SKIP, CODE, TINY, OTHER = range(5)


def code_role(kind: Column, text: Column) -> Column:
    """What an element is to a run of code: D23, D24, D22."""
    paragraph = kind == "paragraph"
    return (
        F.when(kind.isin("heading", "caption", "image", "table", "drawing"), HARD)
        .when(kind.isin("link", "annotation") | T.only_if(paragraph, T.is_artifact_in_code(text)), SKIP)
        .when(kind == "code_block", CODE)
        .when(T.only_if(paragraph, T.is_tiny(text)), TINY)
        .otherwise(OTHER)
    )


def code_runs(roles: Sequence[int], pages: Sequence[int], goes_on: Sequence[bool]) -> list[list[int]]:
    """Runs of code blocks to be merged, as positions: [code..., stop], where stop is the first position not consumed.

    goes_on[i] says whether the code block at i continues the code block before it. A run
    accepts a block on the page of its first block, or one that continues the last. A tiny
    paragraph is passed over only if an accepted block follows at once.
    """
    runs, i, n = [], 0, len(roles)
    while i < n:
        if roles[i] != CODE:
            i += 1
            continue
        run, at = [i], i + 1
        while at < n:
            if roles[at] == SKIP:
                at += 1
                continue
            target = at + 1 if roles[at] == TINY else at
            if target >= n or roles[target] != CODE or not (pages[target] == pages[i] or goes_on[target]):
                break
            run.append(target)
            at = target + 1
        if len(run) > 1:
            runs.append([*run, at])
            i = at
        else:
            i += 1
    return runs


# ------------------------------------------------------------------ where merged texts come from

ORIGINS = "origins"
ORIGIN = "array<struct<pos:bigint,page_number:int,at:int,start:int,length:int>>"


def with_origins(sections: DataFrame) -> DataFrame:
    """Adds origins: text[at : at + length] of a row is text[start : start + length] of the element at (page_number, pos).

    Both merges keep the column up to date where it is there: intervals are cut where texts are
    stripped and shifted where texts are joined, so merges one after the other compose.
    """
    whole = F.array(F.struct(F.col("pos"), F.col("page_number"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.length("text").alias("length")))
    return sections.withColumn(ORIGINS, F.when(F.length("text") > 0, whole).otherwise(F.array()).cast(ORIGIN))


def cut_out(origins: Column, low: Column, length: Column, to: Column) -> Column:
    """The origins of text[low : low + length], when this stands at `to`."""
    first, last = lambda o: F.greatest(o["at"], low), lambda o: F.least(o["at"] + o["length"], low + length)
    inside = F.filter(origins, lambda o: last(o) > first(o))
    return F.transform(inside, lambda o: F.struct(o["pos"].alias("pos"), o["page_number"].alias("page_number"), (first(o) - low + to).cast("int").alias("at"), (o["start"] + first(o) - o["at"]).cast("int").alias("start"), (last(o) - first(o)).cast("int").alias("length")))


def laid_out(parts: list[str], origins: list[list[dict]]) -> list[dict]:
    """The origins of parts joined by line breaks, empty ones left out, each part a beginning of the text its origins tell of."""
    out, to = [], 0
    for text, own in zip(parts, origins):
        out += [o | {"at": o["at"] + to, "length": min(o["length"], len(text) - o["at"])} for o in own if o["at"] < len(text)]
        to += len(text) + 1 if text else 0
    return out


def untold(merged: DataFrame, sources: DataFrame) -> DataFrame:
    """What origins do not tell rightly: (doc_id, n_elements, n_chars, n_wrong, n_unaccounted, n_lost) for each document.

    merged are rows with origins, sources the rows with_origins was given. n_wrong counts intervals whose
    two sides differ, n_unaccounted characters of merged texts that neither come from a source nor are
    white space, n_lost characters of a source that is used in part, but for white space and hyphens.
    """
    key = ["doc_id", "pos"]
    rest = lambda text, cuts, at: F.aggregate(F.array_sort(F.transform(cuts, lambda o: F.struct(o[at].alias("a"), o["length"].alias("n")))), F.struct(F.lit(0).alias("to"), F.lit("").alias("left")), lambda s, o: F.struct((o["a"] + o["n"]).alias("to"), F.concat(s["left"], F.substring(text, s["to"] + 1, o["a"] - s["to"])).alias("left")), lambda s: F.concat(s["left"], F.substring(text, s["to"] + 1, F.length(text))))
    told = merged.where("text is not null")
    own = told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_elements"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.length(F.regexp_replace(rest(F.col("text"), F.col(ORIGINS), "at"), r"\s", ""))).alias("n_unaccounted"))
    parts = told.select("doc_id", F.col("text").alias("__t"), F.explode(ORIGINS).alias("o")).select("doc_id", "o.*", F.substring("__t", F.col("o.at") + 1, F.col("o.length")).alias("__said"))
    met = parts.groupBy(*key).agg(F.collect_list(F.struct("start", "length", "__said")).alias("cuts")).join(sources.select(*key, "text"), key, "left")
    wrong = F.size(F.filter("cuts", lambda o: ~F.coalesce(F.substring(F.col("text"), o["start"] + 1, o["length"]) == o["__said"], F.lit(False))))
    lost = F.length(F.regexp_replace(rest(F.coalesce("text", F.lit("")), F.col("cuts"), "start"), r"[\s-]", ""))
    back = met.groupBy("doc_id").agg(F.sum(wrong).alias("n_wrong"), F.sum(lost).alias("n_lost"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(back, "doc_id", "left").select("doc_id", "n_elements", none("n_chars"), none("n_wrong"), none("n_unaccounted"), none("n_lost"))


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (doc_id, section_number, pos), with __page, __role and __on last; gives them without these, runs joined."""

    def joined(rows: pa.Table) -> pa.Table:
        """Whole sections: a run's texts meet in its first row, its other rows go."""
        keys = list(zip(*(rows.column(c).to_pylist() for c in SECTION)))
        pages, roles, on = (rows.column(c).to_pylist() for c in ("__page", "__role", "__on"))
        gone, texts, origins, names, at = set(), {}, {}, rows.column_names, 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if roles[at:end].count(CODE) > 1:
                for *run, stop in code_runs(roles[at:end], pages[at:end], on[at:end]):
                    parts = [rows.column("text")[at + k].as_py().rstrip("\n") for k in run]
                    texts[at + run[0]] = "\n".join(t for t in parts if t)
                    gone.update(range(at + run[0] + 1, at + stop))
                    if ORIGINS in names:
                        held_by = [rows.column(ORIGINS)[at + k].as_py() or [] for k in run]
                        origins[at + run[0]] = laid_out(parts, held_by)
            at = end
        out = rows.drop_columns(["__page", "__role", "__on"])
        if texts:
            for name, new in (("text", texts), (ORIGINS, origins)):
                if new:
                    own = out.column(name).to_pylist()
                    for k, t in new.items():
                        own[k] = t
                    out = out.set_column(out.schema.get_field_index(name), out.schema.field(name), pa.array(own, out.schema.field(name).type))
            out = out.take(pa.array([k for k in range(len(keys)) if k not in gone], pa.int64()))
        return out

    held: list[pa.RecordBatch] = []  # rows of the section that is still open
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, section = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in SECTION)
        cut = batch.num_rows
        while cut and (doc[cut - 1], section[cut - 1]) == (doc[-1], section[-1]):
            cut -= 1
        first = held and tuple(held[0].column(held[0].schema.get_field_index(c))[0].as_py() for c in SECTION)
        if cut or (held and first != (doc[0], section[0])):
            yield from joined(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from joined(pa.Table.from_batches(held)).to_batches()


def merge_code(sections: DataFrame) -> DataFrame:
    """Split code blocks are joined, and what stood between them goes.

    Roles and the page-crossing test are columns. Whole rows stream through the fold once,
    in the order the window has put them in, so nothing is planned twice; only sections with
    two code blocks or more are looked at there.
    """
    # the fold needs whole sections in a task, whatever becomes of the window
    sections = sections.repartition(*SECTION)
    part = Window.partitionBy(*SECTION)
    before = F.last(F.when(F.col("elem_type") == "code_block", F.col("text")), ignorenulls=True).over(part.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = sections.withColumn("__page", F.col("page_number")).withColumn("__role", code_role(F.col("elem_type"), F.col("text"))).withColumn("__b", F.when(F.col("__role") == CODE, before))
    rows = rows.withColumn("__on", F.coalesce(T.only_if(F.col("__b").isNotNull(), T.continues(F.col("__b"), F.col("text"))), F.lit(False))).drop("__b")
    return rows.sortWithinPartitions(*SECTION, "pos").mapInArrow(_merged_runs, sections.schema)


# ------------------------------------------------------------------ W7


def merge_paragraphs(sections: DataFrame) -> DataFrame:
    """The first paragraph of a stretch takes in the later ones.

    Everything but paragraphs and links, annotations and page numbers ends a stretch. In it,
    what stands before the first paragraph stays; after it the separators and the tiny or
    artifact paragraphs go and the other paragraphs are joined to the first (C19). The first
    is never tested itself.
    """
    kind = F.col("elem_type")
    paragraph, between = kind == "paragraph", kind.isin("link", "annotation", "page_number")
    part = Window.partitionBy(*SECTION)
    seg = F.sum((~(paragraph | between)).cast("int")).over(part.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = sections.withColumn("__seg", seg)
    first = F.min(F.when(paragraph, F.col("pos"))).over(Window.partitionBy(*SECTION, "__seg"))
    rows = rows.withColumn("__first", first)
    later = paragraph & (F.col("pos") > F.col("__first"))
    kept = ~(paragraph | between) | F.col("__first").isNull() | (F.col("pos") <= F.col("__first"))
    taken = T.only_if(later, ~T.is_tiny(F.col("text")) & ~T.is_artifact_late(F.col("text")))
    rows = rows.withColumn("__t", F.coalesce(taken, F.lit(False))).where(kept | F.col("__t")).withColumn("__g", F.when(F.col("__t"), F.col("__first")).otherwise(F.col("pos")))
    # a kept row and the paragraphs it takes in are one group, dealt by section as the windows are
    traced = [ORIGINS] if ORIGINS in sections.columns else []
    own = F.first(F.when(~F.col("__t"), F.struct(*sections.columns)), ignorenulls=True)
    parts = F.array_sort(F.collect_list(F.when(F.col("__t"), F.struct("pos", "text", *traced))))
    out = rows.groupBy(*SECTION, "__g").agg(own.alias("__o"), parts.alias("__p"))
    some = F.size("__p") > 0
    new = {"text": F.aggregate("__p", T.rstrip(F.col("__o.text")), lambda a, x: T.joined(a, x["text"]))}
    if traced:
        base = T.rstrip(F.col("__o.text"))
        start = F.struct(base.alias("text"), cut_out(F.col(f"__o.{ORIGINS}"), F.lit(0), F.length(base), F.lit(0)).cast(ORIGIN).alias("o"))
        new[ORIGINS] = F.aggregate("__p", start, _traced, lambda s: s["o"])
    # the keys are taken from the groups: rows are known to be dealt by section still
    return out.select(*[F.when(some, new[c]).otherwise(F.col(f"__o.{c}")).alias(c) if c in new else F.col(c) if c in SECTION else F.col(f"__o.{c}").alias(c) for c in sections.columns])


def _traced(s: Column, x: Column) -> Column:
    """One more part joined (C19), with its origins."""
    ends = F.struct(T.rstrip(s["text"]).alias("a"), T.strip(x["text"]).alias("b"), T.rstrip(x["text"]).alias("c"))

    def lengths(e: Column) -> Column:
        kept = F.length(e["a"]) - F.when(e["a"].endswith("-"), 1).otherwise(0)
        to = kept + F.when((e["a"] == "") | e["a"].endswith("-"), 0).otherwise(1)
        return F.struct(e["a"].alias("a"), e["b"].alias("b"), kept.alias("kept"), to.alias("to"), (F.length(e["c"]) - F.length(e["b"])).alias("lead"), F.length(e["b"]).alias("n"))

    def told(e: Column) -> Column:
        both = F.concat(cut_out(s["o"], F.lit(0), e["kept"], F.lit(0)), cut_out(x[ORIGINS], e["lead"], e["n"], e["to"]))
        return F.struct(T.joined(e["a"], e["b"]).alias("text"), both.cast(ORIGIN).alias("o"))

    return T.let(T.let(ends, lengths), told)


# ------------------------------------------------------------------ W8, W9

TEXT_LIKE = ("heading", "paragraph", "list_item", "caption", "code_block")


def multi_column(kind: Column, x0: Column, part: Window) -> Column:
    """Whether the text of a page starts both far left and far right."""
    x = F.when(kind.isin(*TEXT_LIKE), x0)
    spread = F.max(x).over(part) - F.min(x).over(part)
    enough = F.count(x).over(part) >= 6
    sides = (F.count(F.when(x <= 0.45, 1)).over(part) >= 2) & (F.count(F.when(x >= 0.55, 1)).over(part) >= 2)
    return F.coalesce(enough & (spread >= 0.25) & sides, F.lit(False))


def reflow(sections: DataFrame) -> DataFrame:
    """Within a section page by page; a multi-column page is put in rows of 0.03 from the top, then from the left.

    Such a page's indices are rewritten from its least index on; other pages keep theirs and
    their order. pos is numbered anew within the section.
    """
    page = Window.partitionBy(*SECTION, "page_number")
    index = F.col("reading_order_index")
    rows = sections.withColumn("__m", multi_column(F.col("elem_type"), F.col("norm_bbox.x0"), page))
    row = F.when(F.col("__m"), F.rint(F.col("norm_bbox.y0") / 0.03)).otherwise(F.lit(0.0))
    left = F.when(F.col("__m"), F.col("norm_bbox.x0")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__rank", F.row_number().over(page.orderBy(row, left, index, "pos")))
    moved = F.when(F.col("__m"), F.min(index).over(page) + F.col("__rank") - 1).otherwise(index)
    order = Window.partitionBy(*SECTION).orderBy("page_number", "__rank")
    return rows.withColumn("reading_order_index", moved).withColumn("pos", F.row_number().over(order).cast("long")).select(*sections.columns)


def outline(sections: DataFrame) -> DataFrame:
    """(doc_id, section_number, page_number, heading) by the first heading of each section."""
    heading = F.col("elem_type") == "heading"
    first = F.min_by(F.struct("page_number", T.single_line(F.col("text")).alias("heading")), F.when(heading, F.col("pos")))
    return sections.where(heading).groupBy(*SECTION).agg(first.alias("f")).select(*SECTION, "f.page_number", "f.heading")


