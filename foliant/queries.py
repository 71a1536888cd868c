"""Named queries over the tables of a data folder, one or more for each group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.operators import elements as E
from foliant.operators import layout as L
from foliant.operators import scenes as C
from foliant.operators import sections as S
from foliant.operators import sinks as K
from foliant.operators import tables as R
from foliant.plans import documents as D
from foliant.plans import figures as M
from foliant.session import importable, table
from foliant.sources import blocks as B
from foliant.sources import chunks as N
from foliant.sources import scenes as X
from foliant.storage import at_end, new_path, written
from foliant.streaming import scenes as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RANGES = ((2, 3), (6, 5))

#: Statements that repeat, paths of each kind, idle animations, waits, and names that are not there.
SCENE = """
ELEMENT GATE TYPE shape
    SHAPE rectangle SIZE 2 TEXT "Gate" POSITION (0.0,1.0) SIZE 1.25 FILL "#ff8800" SPAWN shape_popup 0.5 REMOVE shape_popout 0.75
END
ELEMENT LOGO TYPE image
    URL "pics/logo.png" POSITION (3.0,-1.0) SPAWN image_popup 0.25
END
ELEMENT WIRE TYPE arrow
    SHAPE bidirectional_dotted SPAWN bidirectional_dotted_spawn 1.5 IDLE dotted_bidirectional_idle 1
    MOVE straight PATH [(0.0,0.0), (1.0,1.0), (2.0,0.0)] DURATION 0 REMOVE no_such_removal 2
END
ELEMENT PULSE TYPE shape
    SHAPE circle SIZE 0.5 POSITION (1.0,1.0) MOVE bent TO (3.0,2.0) DURATION 0.5 REPEAT 2 REVERSE POSITION (9.0,9.0) SPAWN shape_popup 0.25
END
ELEMENT SWING TYPE shape
    SHAPE blob BORDER RED MOVE downwardsCurve TO (2.0,0.0) DURATION 0.75
END
SEQUENCE
    SPAWN GATE, LOGO WAIT 0.5 IDLE WIRE SPAWN WIRE WAIT 0.25 MOVE PULSE SPAWN PULSE, NOBODY MOVE PULSE
    MOVE SWING SPAWN SWING MOVE SWING CLOSE WIRE WAIT 0.125 CLOSE PULSE, GATE, LOGO CLOSE NOBODY
END
"""


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_elements(documents(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.preclean(S.detect_sections(ordered(spark, sf_dir)))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return E.elements(B.blocks_from_documents(docs), drawings=B.drawings_from_documents(docs), **B.scans_from_documents(docs))


def scene(spark: SparkSession) -> DataFrame:
    return importable(spark).createDataFrame([("flow", SCENE)], "scene_id string, text string")


def r6(c: Column | str) -> Column:
    """Six places by the value times 10^6, as SQL rounds a double; F.round goes by its decimal digits, which differs at 41 / 640."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


@query
def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.section_outline(cleaned(spark, sf_dir))


@query
def section_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outline(S.detect_sections(ordered(spark, sf_dir)))


@query
def outline_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_listing as SQL over a table function that is given a document at a time."""
    M.register(spark)
    # the function reads texts of headings alone, so no others are dealt by document
    rows = ordered(spark, sf_dir).select("doc_id", "pos", "page_number", "elem_type", F.when(F.col("elem_type") == "heading", F.col("text")).alias("text"))
    return spark.sql("SELECT * FROM outline_of(TABLE(SELECT * FROM {rows}) PARTITION BY doc_id ORDER BY pos)", rows=rows)


@query
def stage_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and characters of each stage of the flow, observed in one run through all of them."""
    figures = M.Figures()
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0))
    df = figures.stage("elements", ordered(spark, sf_dir), chars=chars)
    for name, step in (("sections", S.detect_sections), ("clean", S.preclean), ("demoted", S.demote_code), ("code", S.merge_code), ("paragraphs", S.merge_paragraphs)):
        df = figures.stage(name, step(df), chars=chars)
    with figures.timed("flow"):
        df.write.format("noop").mode("overwrite").save()
    rows = [(name, f["rows"], f["chars"]) for name, f in figures.counts().items()]  # one for each stage
    return spark.createDataFrame(rows, "stage string, n_rows long, n_chars long")


@query
def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = E.block_type(E.block_facts(B.blocks_from_documents(documents(spark, sf_dir))))
    return typed.select("doc_id", "page_number", "block_no", "elem_type", "is_number", "region", "body_size", "max_size", "text")


@query
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(spark, sf_dir).select("doc_id", "page_number", "reading_order_index", "type_ordinal", "elem_type", "pos", "image_index", "image_xref", "image_ext")


@query
def normalize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = E.block_facts(B.blocks_from_documents(documents(spark, sf_dir)))
    sides = ("x0", "y0", "x1", "y1", "width", "height")
    return facts.select("doc_id", "page_number", "block_no", *[r6(f"bbox.{s}").alias(s) for s in sides], *[r6(f"norm_bbox.{s}").alias(f"n_{s}") for s in sides])


@query
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.html_elements(table(spark, sf_dir, "pages"))


@query
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.marked_lines(documents(spark, sf_dir)).groupBy("doc_id").agg((F.floor(F.max("i") / 8) + 1).cast("int").alias("total_pages"))
    return B.page_ranges(pages, 3)


@query
def page_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = E.pages(ordered(spark, sf_dir))
    return pages.select("doc_id", "page", *[F.size(t).alias(f"n_{t}") for t in E.TYPES], F.array_join(F.transform("heading", lambda h: h["text"]), "|").alias("headings"))


@query
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scanned(spark, sf_dir).where(F.col("elem_type").isin("drawing", "table", "link", "annotation"))
    return found.select("doc_id", "page_number", "reading_order_index", "elem_type", *[F.col(f"bbox.{x}").alias(x) for x in G.SIDES], "row_count", "column_count", "item_count", "uri", "destination_page", "kind", "content")


@query
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scanned(spark, sf_dir).where(F.col("elem_type").isin("table", "link", "annotation"))
    rows = found.withColumn("section_number", F.lit(1)).withColumn("pos", F.col("reading_order_index").cast("long"))
    return K.resources(rows).select("doc_id", "page_number", "pos", K.element_line().alias("line"))


@query
def chunk_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pages = B.page_numbers(docs).groupBy("doc_id").agg(F.max("page_number").alias("total_pages"))
    found = B.read_ranges(B.blocks_from_documents(docs), B.page_ranges(pages, 3), 3)
    return found.groupBy("doc_id", "start_page", "end_page").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("page_number").alias("last_page"))


@query
def chunk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_read over files of page ranges, through the data source that opens a range at a time."""
    folder = new_path(spark, "chunks")
    N.write_chunks(B.blocks_from_documents(documents(spark, sf_dir)), 3, folder)
    at_end(spark, folder)
    found = N.read_chunks(spark, folder, ranges_per_task=256)
    return found.groupBy("doc_id", "start_page", "end_page").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("page_number").alias("last_page"))


@query
def crop_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = R.regions_from_documents(documents(spark, sf_dir))
    rows = crops.select(*R.PAGE, (F.col("base_no") * 10 + F.col("ordinal")).alias("base_no"), (F.col("bbox.x0") - 55).alias("x0"), (F.col("bbox.y0") - 40).alias("y0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"))
    sizes = crops.select(*R.PAGE).distinct().withColumns({"page_width": (500 + F.col("doc_id") % 3 * 50).cast("double"), "page_height": (90 + F.col("page_number") % 4 * 30).cast("double")})
    return R.clipped(rows, sizes)


@query
def code_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    e = table(spark, sf_dir, "events").where("event_id is not null").withColumn("ext", F.element_at(F.array(F.lit("json"), F.lit("sql"), F.lit("txt")), (F.col("event_id") % 3 + 1).cast("int")))
    text = F.when(F.col("ext") == "json", F.col("props")).when(F.col("ext") == "sql", F.concat(F.lit("  begin\nselect "), n, F.lit(";\n\ncommit"))).otherwise(F.concat(F.lit("f("), n, F.lit(") {\n  y;\n}")))
    return e.select("event_id", "ext", K.stored_code(text, F.col("ext")).alias("content"))


@query
def preclean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("doc_id", "section_number", "pos", "elem_type", "text")


@query
def section_range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = S.select_sections(S.detect_sections(ordered(spark, sf_dir)), RANGES)
    return K.renumbered(chosen.withColumn("old", F.col("section_number"))).groupBy("doc_id", "section_number", "old").agg(F.count(F.lit(1)).alias("n"))


@query
def chosen_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by ranges from a table: an event chooses some sections of the document that has its user's number."""
    low = F.col("event_id") % 7 + 1
    ranges = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (low + F.floor("value").cast("long") % 3).alias("low"), low.alias("high"))
    chosen = S.select_by_table(S.detect_sections(ordered(spark, sf_dir)), ranges)
    return chosen.groupBy("doc_id", "section_number", "kept_number").agg(F.count(F.lit(1)).alias("n"))


@query
def code_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    facts = E.block_facts(B.blocks_from_documents(documents(spark, sf_dir))).where("block_type = 0")
    return facts.select(
        "doc_id", "page_number", "block_no",
        r6(T.density(t, T.SYMBOLS_WIDE)).alias("wide"), r6(T.density(t, T.SYMBOLS_NARROW)).alias("narrow"), r6(T.indent_ratio(t)).alias("indent"), r6(T.short_line_ratio(t)).alias("short"),
        T.sql_hits(t).cast("long").alias("sql_hits"), T.line_count(t).cast("long").alias("n_lines"), T.is_monospace(F.col("fonts")).alias("mono"), r6(T.numeric_ratio(t)).alias("numeric"), r6(T.punctuation_ratio(t)).alias("punctuation"),
    )


@query
def code_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaned(spark, sf_dir).where("elem_type = 'code_block'")
    return S.demote_code(found).select("doc_id", "section_number", "pos", "elem_type", "text")


@query
def code_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_code(S.demote_code(cleaned(spark, sf_dir))).select("doc_id", "section_number", "pos", "page_number", "elem_type", "text")


@query
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_paragraphs(S.demote_code(cleaned(spark, sf_dir))).select("doc_id", "section_number", "pos", "page_number", "elem_type", "text")


@query
def merge_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both merges with the origins of their texts, held against the sources: every character is accounted for."""
    # both sides of the test and both of its sums read these: without tables the whole flow ran for each
    sources = written(S.demote_code(cleaned(spark, sf_dir)).select(*S.SECTION, "pos", "page_number", "elem_type", "text"), "merge-sources")
    merged = written(S.merge_paragraphs(S.merge_code(S.with_origins(sources))), "merged")
    return S.untold(merged, sources)


@query
def column_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reflow(S.detect_sections(ordered(spark, sf_dir))).select("doc_id", "section_number", "page_number", "pos", "reading_order_index", "elem_type")


@query
def line_cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.marked_lines(documents(spark, sf_dir)).groupBy("doc_id").agg(F.collect_list(F.length("line").cast("double")).alias("xs"))
    return lines.select("doc_id", G.clusters(F.col("xs")).cast("long").alias("clusters"))


def _regions(docs: DataFrame) -> DataFrame:
    return R.regions_from_documents(docs).withColumn("region_no", F.col("base_no") * 1000 + F.col("ordinal"))


def _scored(docs: DataFrame) -> DataFrame:
    regions = _regions(docs).select("doc_id", "page_number", "region_no", "bbox")
    lined = R.numbered(R.region_words(docs, regions))
    return R.table_score(R.region_metrics(lined, regions, B.drawings_from_documents(docs), B.WIDTH))


@query
def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(documents(spark, sf_dir))
    plain = ["line_count", "word_count", "same_left", "grid_lines", "is_table", "score"]
    rounded = ["width_ratio", "punctuation_ratio", "word_count_variance", "row_spacing_variance", "numeric_ratio", "bbox_density"]
    return s.select("doc_id", "page_number", "region_no", *plain, *[F.col(c).cast("long").alias(c) for c in ("aligned_columns", "right_clusters")], *[r6(c).alias(c) for c in rounded], F.array_join("reasons", ",").alias("reasons"))


@query
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.detected_tables(R.words_from_documents(documents(spark, sf_dir)))
    return found.select("doc_id", "page_number", "position", *[F.col(f"bbox.{s}").alias(s) for s in G.SIDES], "row_count", "column_count")


@query
def recurring_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = E.block_facts(B.blocks_from_documents(documents(spark, sf_dir))).where("block_type = 0")
    return L.recurring_texts(facts.select("doc_id", "page_number", "block_no", "bbox", "text"), least_pages=2)


@query
def crop_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    best = R.best_crop(_scored(docs))
    return best.select("doc_id", "page_number", "base_no", "ordinal", *[F.col(f"bbox.{s}").alias(s) for s in G.SIDES])


@query
def table_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    crops = R.regions_from_documents(docs)
    base = crops.where("ordinal = 0").select(*R.PAGE, "base_no", F.col("bbox").alias("base"))
    largest = crops.where("ordinal = 1").join(base, [*R.PAGE, "base_no"])
    regions = largest.select("doc_id", "page_number", F.col("base_no").alias("region_no"), "bbox")
    return R.trimmed(largest, R.numbered(R.region_words(docs, regions)))


@query
def spatial_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return R.spatial_exists(_regions(docs).select("doc_id", "page_number", "region_no", "bbox"), B.drawings_from_documents(docs)).select("doc_id", "page_number", "region_no", "hit")


@query
def resource_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = K.resources(K.with_images(S.demote_code(cleaned(spark, sf_dir))))
    return stored.where("resource_kind is not null").select("doc_id", "section_number", "pos", "resource_kind", "resource_no", "resource_path")


@query
def image_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the sections with the bytes that a reader extracted under their numbers."""
    n = F.col("i")
    lines = B.marked_lines(documents(spark, sf_dir)).where(n % 3 != 0)
    extracted = lines.select("doc_id", n.cast("int").alias("image_xref"), F.concat(F.lit("img"), "line").cast("binary").alias("bytes"), F.when(n % 2 == 0, "JPG").otherwise("Gif").alias("ext"))
    found = K.with_images(cleaned(spark, sf_dir).where("elem_type = 'image'"), extracted)
    return found.select("doc_id", "section_number", "pos", "image_xref", "image_ext", F.md5("image_bytes").alias("md5"))


@query
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.section_texts(K.resources(K.with_images(S.demote_code(cleaned(spark, sf_dir)))))


@query
def indent_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = cleaned(spark, sf_dir).where("elem_type = 'code_block'")
    return code.select("doc_id", "pos", T.indent_sql(F.col("text")).alias("as_sql"), T.indent_braces(F.col("text")).alias("as_braces"))


@query
def document_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.section_texts(D.stored(ordered(spark, sf_dir)))


@query
def section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_flow as files, read back: section texts by their digest, resources by their paths."""
    place = F.regexp_extract("path", r"^(-?\d+)/(.+)$", 1).cast("long")
    path = F.regexp_extract("path", r"^(-?\d+)/(.+)$", 2)
    told = lambda files: files.select(place.alias("doc_id"), path.alias("path"), F.when(path.startswith("section_"), F.md5("content")).alias("md5"))
    # texts, resources and folders are taken from the table, and then the names of the folders
    return K.files_read_back(written(D.stored(ordered(spark, sf_dir)), "stored"), told)


@query
def scene_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.scene_elements(C.statements(scene(spark)))
    points = lambda c: F.to_json(c)
    return e.select("name", "type", "shape", "url", "text", points("position").alias("position"), points("from").alias("from_position"), points("to").alias("to_position"), "size", "fill_color", F.col("spawn_animation.type").alias("spawn"), F.col("idle_animation.type").alias("idle"), points("movement.path").alias("path"), F.col("movement.repeat").alias("repeat"))


@query
def scene_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scene_steps(C.statements(scene(spark))).select("step_no", "action", "target", F.array_join("targets", ",").alias("targets"), "duration")


@query
def scene_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmts = C.statements(scene(spark))
    t = C.timeline(C.resolved(C.scene_elements(stmts)), C.scene_steps(stmts))
    return t.select("step_no", "action", r6("run_s").alias("run_s"), r6("wall_s").alias("wall_s"), r6("start_s").alias("start_s"))


@query
def scene_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.scene_json(C.compiled(scene(spark)))


def _event_elements(elements: DataFrame) -> DataFrame:
    missing = {"shape": "string", "url": "string", "text": "string", "position": "array<double>", "from": "array<double>", "to": "array<double>", "path": "array<array<double>>", "size": "double", "fill_color": "string", "border_color": "string"}
    return C.resolved(elements.select("*", *[F.lit(None).cast(t).alias(c) for c, t in missing.items()]))


@query
def scene_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, steps = X.scene_from_events(table(spark, sf_dir, "events"))
    t = C.timeline(_event_elements(elements), steps)
    return t.select("scene_id", "step_no", "action", r6("run_s").alias("run_s"), r6("wall_s").alias("wall_s"), F.round("start_s", 4).alias("start_s"), "played", "active_idle")


@query
def scene_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_timeline over the events as a stream: stopped after what is there, gone on with when the end is known."""
    # as a pattern the path may be one file or a folder of files
    events, folder = f"{sf_dir}/{{events}}.parquet", new_path(spark, "stream")
    elements = written(_event_elements(X.scene_from_events(table(spark, sf_dir, "events"))[0]), "stream-elements")
    marks, out = f"{folder}/marks", f"{folder}/out"
    table(spark, sf_dir, "events").limit(0).write.parquet(marks)
    for last in (False, True):
        if last:
            P.ended(spark, events, marks)
        P.play_events(spark, events, marks, elements, out, f"{folder}/checkpoint", per_batch=None).awaitTermination()
    at_end(spark, folder)
    t = spark.read.schema(P.PLAYED).parquet(out)
    return t.select("scene_id", "step_no", "action", r6("run_s").alias("run_s"), r6("wall_s").alias("wall_s"), F.round("start_s", 4).alias("start_s"), "played", "active_idle")


@query
def movement_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _ = X.scene_from_events(table(spark, sf_dir, "events"))
    legs = C.movement_paths(_event_elements(elements))
    p = legs.select("scene_id", "name", "path_no", "duration", F.posexplode("path").alias("k", "p"))
    return p.select("scene_id", "name", F.col("path_no").cast("long").alias("path_no"), "duration", F.col("k").cast("long").alias("k"), r6(F.col("p")[0]).alias("x"), r6(F.col("p")[1]).alias("y"))


@query
def element_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.resolved(C.scene_elements(C.statements(scene(spark))))
    return e.select("name", "drawable", "width", "height", "text", "border_color", r6("angle").alias("angle"), F.col("spawn.name").alias("spawn"), F.col("spawn.duration").alias("spawn_s"), F.col("idle.name").alias("idle"), F.col("remove.name").alias("remove"), r6(C.move_duration(F.col("movement"))).alias("move_s"))


@query
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    token = F.when(F.col("event_id") % 4 == 0, F.lit(" Yes")).when(F.col("event_id") % 4 == 1, F.lit("off")).when(F.col("event_id") % 4 == 2, k)
    return table(spark, sf_dir, "events").select("event_id", T.number(k, 0.45).alias("number"), T.integer(F.when(F.col("event_id") % 3 > 0, k).otherwise(F.lit("x"))).cast("long").alias("whole"), T.to_bool(token, False).alias("flag"), T.unquoted(F.concat(F.lit('"'), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit('"')).otherwise(F.lit("")))).alias("plain"))
