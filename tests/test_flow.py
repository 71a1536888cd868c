"""Blocks in, sections out: sources, tables, sinks and the streamed flow."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import elements as E
from foliant.operators import sinks as K
from foliant.operators import tables as R
from foliant.plans import documents as D
from foliant.sources import blocks as B
from foliant.streaming.documents import section_stream


def block(no, *lines, kind=0, font="Serif", size=10.0, y=100.0, doc=1, page=1, **more):
    spans = [{"spans": [{"text": t, "font": font, "size": size}]} for t in lines]
    return {"doc_id": doc, "page_number": page, "page_width": 100.0, "page_height": 1000.0, "block_no": no, "block_type": kind, "bbox": {"x0": 10.0, "y0": y, "x1": 60.0, "y1": y + 50}, "lines": spans if kind == 0 else None} | more


@pytest.fixture
def made(spark, tmp_path):
    rows = [
        block(0, "Title", size=12.5),
        block(1, "7", y=940.0),
        block(2, "  "),
        block(3, kind=1, xref="5", ext=" JPG"),
        block(4, kind=3),
        block(5, "x = [1];", "y = {};", "z();", font="Courier"),
        block(6, "plain words that say something", size=10.0),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    return B.read_blocks(spark, str(tmp_path / "in"))


def test_elements(spark, made):
    links = spark.createDataFrame([(1, 1, 0, (1.0, 1.0, 2.0, 2.0), "http://x", None)], "doc_id long, page_number int, position int, bbox struct<x0:double,y0:double,x1:double,y1:double>, uri string, destination_page int")
    found = [(r["reading_order_index"], r["elem_type"]) for r in E.in_order(E.elements(made, links=links)).orderBy("pos").collect()]
    assert found == [(0, "heading"), (1, "paragraph"), (1, "header_footer"), (1, "page_number"), (3, "image"), (5, "code_block"), (6, "paragraph"), (7, "link")]
    image = E.in_order(E.elements(made)).where("elem_type = 'image'").first()
    assert (image["image_index"], image["image_xref"], image["image_ext"]) == (1, 5, "jpg")


def test_geometry_of_empty_pages(spark):
    df = spark.createDataFrame([((0.0, 0.0, 5.0, -1.0), 0.0, -2.0)], "b struct<x0:double,y0:double,x1:double,y1:double>, w double, h double")
    from foliant.functions import geometry as G

    r = df.select(G.normal(F.col("b"), F.col("w"), F.col("h")).alias("n")).first()["n"]
    assert (r["x1"], r["width"], r["height"]) == (5.0, 5.0, 0.0)


def test_sink(spark, made, tmp_path):
    sections = D.ingest(E.in_order(E.elements(made)))
    extracted = spark.createDataFrame([(1, 5, bytearray(b"img"), "PNG")], "doc_id long, image_xref int, bytes binary, ext string")
    stored = K.resources(K.with_images(K.renumbered(sections), extracted))
    K.write_sections(stored, str(tmp_path / "out"))
    out = tmp_path / "out" / "1"
    assert (out / "section_1.txt").read_text() == "section_number: 1\n\npage_number: 1\n\nHEADING Title\nIMAGE resources/images/1_1_images_1.png\nCODE_BLOCK resources/code_blocks/1_1_code_blocks_1.txt\nPARAGRAPH plain words that say something\n"
    assert (out / "resources/code_blocks/1_1_code_blocks_1.txt").read_text() == "x = [1];\ny = {};\nz();" and (out / "resources/images/1_1_images_1.png").read_bytes() == b"img"
    assert sorted(p.name for p in (out / "resources").iterdir()) == ["code_blocks", "drawings", "images", "tables"]
    plain = K.resources(K.with_images(K.renumbered(sections))).where("elem_type = 'image'")
    assert plain.select("resource_path").first()[0].endswith("images_1.txt") and plain.select(K.described()).first()[0].startswith("image_index=1\nxref=5\nbbox={'x0': 10.0")


def test_stream(spark, made, tmp_path):
    q = section_stream(spark, str(tmp_path / "in"), str(tmp_path / "live"), str(tmp_path / "check"))
    q.awaitTermination(120)
    live = spark.read.parquet(str(tmp_path / "live"))
    assert live.count() == 1 and live.first()["content"].startswith("section_number: 1\n\npage_number: 1\n\nHEADING Title\n")


def test_ranges(spark):
    df = spark.createDataFrame([(1, 7), (2, 0), (3, 3)], "doc_id long, total_pages int")
    assert sorted(map(tuple, B.page_ranges(df, 3).collect())) == [(1, 1, 3), (1, 4, 6), (1, 7, 7), (3, 1, 3)]
    pages = spark.createDataFrame([(p,) for p in (1, 2, 2, 4)], "page_number int")
    assert B.read_range(pages, 2, 4).count() == 3 and B.read_range(pages, 5, 6, 7).count() == 0
    for start, end, total in ((4, 3, None), (0, 1, None), (1, 5, None), (1, 8, 7)):
        with pytest.raises(ValueError):
            B.read_range(pages, start, end, total)


def test_stored_code_follows_its_language(spark, tmp_path, monkeypatch):
    """The file is named .txt, the content is formatted as what the lexer takes it for."""
    monkeypatch.setattr(K, "guessed_extension", lambda c: F.when(c.startswith("begin"), "sql").when(c.startswith("{"), "json").otherwise("txt"))
    rows = [(1, 1, i, 1, "code_block", t) for i, t in enumerate(["begin\nselect 1;\ncommit", '{"a": 1}', "f(\nx\n)"])]
    df = spark.createDataFrame(rows, "doc_id long, section_number int, pos long, page_number int, elem_type string, text string")
    missing = ("image_index int", "image_xref int", "image_ext string", "image_bytes binary", "row_count int", "column_count int", "item_count int", "uri string", "destination_page int", "kind string", "content string", "bbox struct<x0:double,y0:double,x1:double,y1:double,width:double,height:double>", "norm_bbox struct<x0:double,y0:double,x1:double,y1:double,width:double,height:double>")
    df = df.select("*", *[F.lit(None).cast(m.split(" ", 1)[1]).alias(m.split(" ", 1)[0]) for m in missing])
    K.write_sections(K.resources(df), str(tmp_path / "out"))
    kept = {p.name[-5:]: p.read_text() for p in (tmp_path / "out/1/resources/code_blocks").iterdir()}
    assert kept == {"1.txt": "begin\n    select 1;\ncommit", "2.txt": '{\n  "a": 1\n}', "3.txt": "f(\n    x\n)"}


def test_table_crop(spark):
    """The best candidate is cut below its last table row and kept within the page."""
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    words = [(1, 1, r * 3 + c, 10.0 + 100 * c, 20.0 * r, 40.0 + 100 * c + 20 * (r % 2), 20.0 * r + 10, "12") for r in range(5) for c in range(3)]
    words = spark.createDataFrame(words, "doc_id long, page_number int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    candidates = spark.createDataFrame([(1, 1, 1, 0, (0.0, 0.0, 400.0, 35.0)), (1, 1, 1, 1, (0.0, 0.0, 400.0, 300.0))], f"doc_id long, page_number int, base_no int, ordinal int, bbox {box}")
    regions = candidates.withColumn("region_no", F.col("base_no") * 1000 + F.col("ordinal"))
    scored = R.table_score(R.region_metrics(R.grouped_lines(R.words_in(words, regions.select("doc_id", "page_number", "region_no", "bbox"))), regions.select("doc_id", "page_number", "region_no", "bbox"), None, 612.0))
    sizes = spark.createDataFrame([(1, 1, 300.0, 1000.0)], "doc_id long, page_number int, page_width double, page_height double")
    r = R.table_crop(words, scored, sizes).first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (0.0, 0.0, 300.0, 94.0)


def test_lines_join_the_first_that_is_near(spark):
    """Words at centres 0, 2.5, 4, 1: the second joins the first line (mean 1.25), so does 4 (2.75 away), and 1."""
    ys = [0.0, 2.5, 4.0, 1.0, 20.0]
    df = spark.createDataFrame([(1, 1, 1, i, float(i * 10), y, float(i * 10 + 5), y, f"w{i}") for i, y in enumerate(ys)], "doc_id long, page_number int, region_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")

    def plain():
        lines = []
        for y, i in sorted((y, i) for i, y in enumerate(ys)):
            hit = next((x for x in lines if abs(y - sum(v for v, _ in x) / len(x)) <= 3.0), None)
            hit.append((y, i)) if hit else lines.append([(y, i)])
        return {i: k + 1 for k, x in enumerate(lines) for _, i in x}

    assert {r["word_no"]: r["line_no"] for r in R.grouped_lines(df).collect()} == plain()


def test_table_score(spark):
    """Four even rows in three columns with a drawing: 3 + 2 + 1 + 4, no penalty but for the single left edge."""
    words = [(1, 1, r * 3 + c, 10.0 + 100 * c + (30 * (r % 2) if c == 0 else 0), 20.0 * r, 40.0 + 100 * c + 20 * (r % 2), 20.0 * r + 10, "ab") for r in range(4) for c in range(3)]
    words = spark.createDataFrame(words, "doc_id long, page_number int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    regions = spark.createDataFrame([(1, 1, 1, (0.0, 0.0, 400.0, 100.0)), (1, 1, 2, (0.0, 0.0, 400.0, 35.0)), (1, 1, 3, (0.0, 500.0, 1.0, 501.0))], f"doc_id long, page_number int, region_no int, bbox {box}")
    drawings = spark.createDataFrame([(1, 1, (0.0, 0.0, 50.0, 50.0))], f"doc_id long, page_number int, bbox {box}")
    scored = {r["region_no"]: r for r in R.table_score(R.region_metrics(R.grouped_lines(R.words_in(words, regions)), regions, drawings, 612.0)).collect()}
    assert (scored[1]["score"], scored[1]["is_table"], scored[1]["same_left"]) == (10.0, True, False)
    assert (scored[2]["score"], scored[2]["reasons"]) == (-1.0, ["insufficient_rows"])
    assert scored[3]["reasons"] == ["insufficient_columns", "insufficient_rows"]


def test_stored_code(spark):
    df = spark.createDataFrame([('{"a": [1]}', "json"), ("{broken", "json"), ("BEGIN\nx\nCOMMIT", "sql"), ("f(\nx\n)", "txt")], "t string, e string")
    assert [r[0] for r in df.select(K.stored_code(F.col("t"), F.col("e"))).collect()] == ['{\n  "a": [\n    1\n  ]\n}', "{broken", "BEGIN\n    x\nCOMMIT", "f(\n    x\n)"]
    assert df.select(K.guessed_extension(F.col("t"))).count() == 4


def test_origins_run_the_flow_once(spark, sf_dir):
    """merge_origins reads written tables: its plan held the whole flow three times."""
    from foliant import queries

    told = queries.merge_origins(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(split" not in told and "MapInArrow" not in told


def test_texts_are_dealt_once_by_pages_and_once_by_sections(spark, sf_dir):
    """Texts were shuffled by page, by page range and up to five times by section."""
    from foliant import queries

    def shuffles(q):
        plan = getattr(queries, q)(spark, sf_dir)._jdf.queryExecution().executedPlan()
        seen, todo = 0, [plan]
        while todo:
            p = todo.pop()
            if p.nodeName() == "AdaptiveSparkPlan":
                p = p.initialPlan()
            # a text by its own name, or in the one struct that merged rows are kept in
            seen += p.nodeName() == "Exchange" and any(a.split("#")[0] in ("text", "__o", "__lines") for a in p.output().mkString("|").split("|"))
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return seen

    assert shuffles("reading_order") == 0 and shuffles("preclean") == 1
    assert shuffles("section_lines") == 2 and shuffles("document_flow") == 3


def test_ranged_elements_come_in_the_same_order(spark):
    """Elements that stay in their tasks are counted as those that are dealt anew, over ranges, doubtful pages and scans."""
    rows = [block(n, f"Words of {p}", size=16.0 if (p + n) % 3 == 0 else 10.0, y=500.0, doc=d, page=p) | {"page_width": 100.0 + n} for d in (1, 2) for p in (-3, 0, 1, 127, 128, 129, 130, 256, 257, 400) for n in range(3)]
    made = spark.createDataFrame([r | {"xref": None, "ext": None, "image": None} for r in rows], B.BLOCKS)
    box = "bbox struct<x0:double,y0:double,x1:double,y1:double>"
    drawings = spark.createDataFrame([(1, p, 0, (10.0, 10.0, 51.0, 500.0), 4) for p in (1, 128, 129, 999)], f"doc_id long, page_number int, position int, {box}, item_count int")
    plain = sorted(map(str, E.in_order(E.elements(made, drawings=drawings)).collect()))
    assert sorted(map(str, E.in_order(E.elements(made, drawings=drawings, ranged=True)).collect())) == plain
    found = {r["page_number"]: r["norm_bbox"]["x1"] for r in E.elements(made, drawings=drawings).where("elem_type = 'drawing'").collect()}
    assert found == {1: 0.5, 128: 0.5, 129: 0.5, 999: 51.0}  # 102 is the widest block of each page; a page without blocks counts as 1 by 1


def test_pages_are_counted_by_their_texts(spark):
    """One row for each page of a doc_id, also where it comes twice, is null or has no text; no page is shuffled."""
    docs = spark.createDataFrame([(1, "a\n" * 8), (1, "a"), (2, None), (3, "\n" * 15 + "x"), (None, "x\n" * 20)], "doc_id long, text string")
    pages = B.page_numbers(docs)
    assert sorted(map(tuple, pages.collect())) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]
    assert "page_number" not in pages._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1].split("\n", 1)[0]


def test_short_documents_are_read_once(spark):
    """Every text was taken apart a second time to count what stands before a range of pages; now those of several ranges are."""
    text = lambda n: "\n".join(f"Words of line {i}" if i % 5 else "" for i in range(n))
    # 1024 lines are one range; a doc_id may come twice, its pages end with its longest text
    docs = spark.createDataFrame([(1, text(1024)), (2, text(1025)), (2, text(30)), (3, None), (4, text(9)), (12, text(2100))], "doc_id long, text string")
    plain = E.in_order(E.elements(B.blocks_from_documents(docs), drawings=B.drawings_from_documents(docs), ranged=True))
    got = D.document_elements(docs)
    key = ["doc_id", "pos", "elem_type", "text", "image_index", "headings", "headings_total"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, plain.select(key).collect()))
    beforehand = got._jdf.queryExecution().optimizedPlan().toString()
    assert beforehand.count("Generate posexplode(split") == 2 and beforehand.count("Join LeftSemi") == 1
