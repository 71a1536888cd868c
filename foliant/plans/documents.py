"""The document flow: blocks to sections, in the order of its stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import elements as E
from foliant.operators import sections as S
from foliant.operators import sinks as K
from foliant.sources import blocks as B
from foliant.storage import written


def document_elements(docs: DataFrame) -> DataFrame:
    """Elements of the canonical adapter, in reading order.

    Last pages are written first: they tell the drawings, and the documents of more than one range of pages,
    whose texts alone are read twice.
    """
    made = lambda d, last: E.elements(B.blocks_from_documents(d), drawings=B.drawings_from_documents(d, last), ranged=True)
    last = written(B.last_pages(docs), "last-pages")
    long = written(last.where(F.col("last_page") > E.PAGES), "long-documents")
    return E.in_order(made(docs, last), several=made(docs.join(long, "doc_id", "left_semi"), long))


def ingest(ordered: DataFrame, ranges: Sequence[Sequence[int]] = ((15, 238),)) -> DataFrame:
    """Sections, selected, cleaned, merged and reflowed."""
    return worked(S.select_sections(S.detect_sections(ordered), ranges))


def worked(chosen: DataFrame) -> DataFrame:
    """Chosen sections, cleaned, merged and reflowed."""
    return S.reflow(S.merge_paragraphs(S.merge_code(S.demote_code(S.preclean(chosen)))))


def stored(ordered: DataFrame, ranges: Sequence[Sequence[int]] = ((15, 238),)) -> DataFrame:
    """Rows of ingest as the writer stores them, with images and resources.

    Sections get the writer's numbers before they are merged, so merges and writer go by one dealing of the rows.
    """
    chosen = K.renumbered(S.select_sections(S.detect_sections(ordered), ranges))
    return K.resources(K.with_images(worked(chosen)))


def section_outline(sections: DataFrame) -> DataFrame:
    """Per section: first page, heading, elements, paragraphs and characters."""
    heading = F.min_by("text", F.when(F.col("elem_type") == "heading", F.col("pos")))
    return sections.groupBy(*S.SECTION).agg(
        F.min_by("page_number", "pos").alias("first_page"),
        heading.alias("heading"),
        F.count(F.lit(1)).alias("n_elements"),
        F.count(F.when(F.col("elem_type") == "paragraph", 1)).alias("n_paragraphs"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"),
    )
