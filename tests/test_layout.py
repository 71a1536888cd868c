"""Table regions, recurring texts, ranges from tables and origins of merges, on small inputs and at random."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import layout as L
from foliant.operators import sections as S
from tests.test_sections import rows

WORDS = "doc_id long, page_number int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"


def page(r, n=25):
    out = []
    for k in range(n):
        x, y = r.randrange(0, 400, 5), r.choice([10, 24, 38, 52, 66, 70, 84, 98])
        out.append((k, float(x), float(y), float(x + r.randrange(5, 60)), float(y + 10), "w"))
    return out


def plain_tables(words, gap=12.0, least=3):
    """Bands of words, then runs of bands that leave a white column."""
    bands, reach = [], None
    for _, x0, y0, x1, y1, _ in sorted(words, key=lambda w: (w[2], w[4], w[1], w[3])):
        if reach is None or y0 >= reach:
            bands.append([])
        bands[-1].append((x0, y0, x1, y1))
        reach = max(y1, reach if reach is not None else y1)

    def white(band):
        out, right = [], None
        for x0, _, x1, _ in sorted(band, key=lambda w: (w[0], w[2])):
            if right is not None and x0 - right >= gap:
                out.append((right, x0))
            right = x1 if right is None else max(right, x1)
        return out

    found, run, left = [], [], []
    for band in [*bands, None]:
        own = white(band) if band else []
        both = [(max(a, c), min(b, d)) for a, b in left for c, d in own]
        kept = [w for w in both if w[1] - w[0] >= gap]
        if run and kept:
            run.append(band)
            left = kept
            continue
        if len(run) >= least:
            every = [w for b in run for w in b]
            found.append((min(w[0] for w in every), min(w[1] for w in every), max(w[2] for w in every), max(w[3] for w in every), len(run), len(left) + 1))
        run, left = ([band], own) if own else ([], [])
    return found


def test_tables_as_found_by_hand(spark):
    r = random.Random(6)
    pages = {(d, p): page(r) for d in range(6) for p in (1, 2)}
    pages[9, 1] = [(k, 100.0 * (k % 3), 20.0 * (k // 3), 100.0 * (k % 3) + 40, 20.0 * (k // 3) + 10, "c") for k in range(12)]
    df = spark.createDataFrame([(d, p, *w) for (d, p), ws in pages.items() for w in ws], WORDS)
    got = {}
    for x in L.detected_tables(df).orderBy("doc_id", "page_number", "position").collect():
        got.setdefault((x["doc_id"], x["page_number"]), []).append((*x["bbox"], x["row_count"], x["column_count"]))
    assert got == {k: t for k, ws in pages.items() if (t := plain_tables(ws))}
    assert got[9, 1] == [(0.0, 0.0, 240.0, 70.0, 4, 3)]
    scored = L.scored_tables(df.where("doc_id = 9"), None, 612.0).first()
    assert scored["row_count"] == 4 and scored["score"] is not None and isinstance(scored["is_table"], bool)


def test_recurring_texts(spark):
    box = "bbox struct<x0:double,y0:double,x1:double,y1:double>"
    page = lambda p, *texts: [(1, p, k, (0.0, 10.0 * k, 1.0, 10.0 * k + 5), t) for k, t in enumerate(texts)]
    data = [b for p in range(1, 7) for b in page(p, f"Chapter {p // 4}  of it", f"only {chr(96 + p)}", "body", f"item {p * p}", f"Page {p + 10}")]
    df = spark.createDataFrame([*data, *page(7, "  ", None)], f"doc_id long, page_number int, block_no int, {box}, text string")
    got = {(r["band"], r["place"], r["text"]): (r["n_pages"], r["first_page"], r["last_page"], r["shift"]) for r in L.recurring_texts(df).collect()}
    assert got == {("top", 1, "Chapter # of it"): (6, 1, 6, None), ("bottom", 1, "Page #"): (6, 1, 6, 10)}


def test_ranges_from_a_table(spark):
    r = random.Random(9)
    kinds = [("heading", "H")] * 30
    one = S.detect_sections(rows(spark, kinds).drop("section_number"))
    docs = one.select(*[F.col(c) for c in one.columns if c != "doc_id"]).crossJoin(spark.range(12).withColumnRenamed("id", "doc_id"))
    ranges = {d: [(r.randrange(-3, 40), r.randrange(-3, 40)) for _ in range(r.randrange(1, 4))] for d in range(10)} | {10: [(50, 60)], 11: []}
    table = spark.createDataFrame([(d, a, b) for d, rs in ranges.items() for a, b in rs] + [(None, 1, 2), (11, None, 3)], "doc_id long, low long, high long")
    got = {}
    for x in S.select_by_table(docs, table).collect():
        got.setdefault(x["doc_id"], {})[x["section_number"]] = x["kept_number"]
    for d, rs in ranges.items():
        hit = [n for n in range(1, 31) if any(min(a, b) <= n <= max(a, b) for a, b in rs)] or list(range(1, 31))
        assert got[d] == {n: k for k, n in enumerate(hit, 1)}
        same = {x["section_number"]: x["kept_number"] for x in S.select_sections(docs.where(F.col("doc_id") == d), rs).collect()} if d < 3 else got[d]
        assert got[d] == same


@pytest.mark.parametrize("seed", range(3))
def test_origins_rebuild_merged_texts(spark, seed):
    r = random.Random(seed)
    texts = ["  a long line of words-", "x = [1];\n\n", "f(\n", "tail that says something more  ", "-", "one more paragraph with words", "", "y"]
    items = [(r.choice(["code_block", "code_block", "paragraph", "paragraph", "link", "heading", "list_item"]), r.choice(texts), 1 + k // 9) for k in range(40)]
    sources = rows(spark, items)
    merged = S.merge_paragraphs(S.merge_code(S.with_origins(sources)))
    by = {x["pos"]: x["text"] for x in sources.collect()}
    for x in merged.collect():
        for o in x["origins"]:
            assert x["text"][o["at"] : o["at"] + o["length"]] == by[o["pos"]][o["start"] : o["start"] + o["length"]]
    plain = S.merge_paragraphs(S.merge_code(sources))
    assert sorted(map(str, merged.drop("origins").collect())) == sorted(map(str, plain.collect()))
    told = S.untold(merged, sources).first()
    assert (told["n_wrong"], told["n_unaccounted"], told["n_lost"]) == (0, 0, 0)
    broken = merged.withColumn("origins", F.transform("origins", lambda o: o.withField("start", o["start"] + 1)))
    assert S.untold(broken, sources).first()["n_wrong"] > 0


def test_lines_as_a_scan_of_all_lines_gives_them():
    from foliant.operators.tables import line_numbers

    def plain(ys, tolerance):
        sums, counts, at = [], [], []
        for y in ys:
            k = next((i for i, (s, n) in enumerate(zip(sums, counts)) if abs(y - s / n) <= tolerance), len(sums))
            if k == len(sums):
                sums.append(0.0)
                counts.append(0)
            sums[k] += y
            counts[k] += 1
            at.append(k + 1)
        return at

    r = random.Random(1)
    for tolerance in (0.0, 0.5, 3.0, 40.0):
        for _ in range(40):
            ys = [r.choice([float(r.randrange(-60, 60)), r.uniform(-60, 60)]) for _ in range(r.randrange(120))]
            assert line_numbers(ys, tolerance) == plain(ys, tolerance)
    import time

    took = []
    for n in (20_000, 100_000):
        began = time.process_time()
        line_numbers([7.0 * k for k in range(n)], 3.0)
        took.append(time.process_time() - began)
    assert took[1] < 15 * took[0] + 0.2


def test_figures(spark):
    from foliant.plans.figures import Figures

    f = Figures()
    even = f.stage("even", spark.range(100).where("id % 2 = 0"), total=F.sum("id"))
    few = f.stage("few", even.where("id < 10"))
    with pytest.raises(ValueError):
        f.stage("few", few)
    with f.timed("run"):
        assert few.count() == 5
    assert f.counts() == {"even": {"rows": 50, "total": 2450}, "few": {"rows": 5}} and f.seconds["run"] > 0


def test_white_of_a_band_grows_with_its_words(spark):
    """Common white is found by a sorted pass: as a pair of every two intervals, 4,000 with 4,000 made 16 million."""
    from pyspark.sql import functions as F

    rows = spark.range(1).select(*[F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.struct((i * 80.0 + shift).alias("a"), (i * 80.0 + 30.0 + shift).alias("b"))).alias(n) for n, shift in (("a", 0.0), ("b", 10.0))])
    got = rows.select(L.common_white(F.col("a"), F.col("b"), 12.0).alias("w"))
    assert "flatten" not in got._jdf.queryExecution().optimizedPlan().toString()
    w = got.first()["w"]
    assert [tuple(x) for x in w] == [(i * 80.0 + 10.0, i * 80.0 + 30.0) for i in range(4000)]


def test_common_white_is_that_of_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    r, rows = random.Random(3), []
    for _ in range(300):
        two = []
        for _ in range(2):
            at, own = 0.0, []
            for _ in range(r.randrange(7)):
                a = at + r.randrange(1, 30)
                at = a + r.randrange(12, 60)
                own.append((float(a), float(at)))
            two.append(own)
        rows.append(tuple(two))
    df = spark.createDataFrame(rows, "a array<struct<a:double,b:double>>, b array<struct<a:double,b:double>>")
    for x in df.select("*", L.common_white(F.col("a"), F.col("b"), 12.0).alias("w")).collect():
        want = [(max(p.a, q.a), min(p.b, q.b)) for p in x.a for q in x.b if min(p.b, q.b) - max(p.a, q.a) >= 12.0]
        assert [tuple(w) for w in x.w] == sorted(want)
