"""Text expressions case by case; expected values are written by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


CASES = [
    (T.is_list_item, {"1. a": False, "10. a": True, "10) a": True, "- a": True, "-a": False, "• x": True}),
    (T.is_caption, {"Figure 3 x": True, "Figures x": False, "fig. 1": True, "Table of": True}),
    (T.is_late_caption, {"tablespoon of salt": True, "a table": False}),
    (T.is_page_number, {"123": True, "12345": False, " 7 ": True, "7a": False}),
    (T.mend_hyphens, {"exam-\nple": "example", "co-  op": "coop", "co-op": "co-op", "é-\n é": "éé"}),
    (T.is_artifact_early, {"Storage | 81": True, "81 | Storage": True, "Chapter 3: X": True, "": True, "A plain line": False, "x" * 101 + " | 8": False}),
    (T.is_artifact_late, {"short": True, "page 12": True, "[4] A reference": True, "a longer line": False}),
    (T.is_prose_in_code, {"The following query returns:": True, "BEGIN TRANSACTION;\nx;\nCOMMIT;": False, "[4] A B: x doi:10.1000/x": True, "": False}),
    (T.is_tiny, {"": True, "a": True, "a\nb": False, "x" * 41: False}),
    (T.normalized, {"a  \nb \n": "a\nb", "  a": "a"}),
    (T.single_line, {" a\n\tb ": "a b"}),
    (T.indent_braces, {"f(){\nx;\n}": "f(){\n    x;\n}", "": ""}),
    (T.indent_sql, {"BEGIN\nSELECT 1;\nCOMMIT": "BEGIN\n    SELECT 1;\nCOMMIT"}),
    (T.unquoted, {'"a"': "a", '"': '"', "a": "a"}),
    (T.sql_hits, {"select a from b where c": 3, "none": 0}),
    (lambda c: T.to_bool(c, True), {"no": False, "x": True, " ON ": True}),
    (lambda c: T.number(c, 0.45), {"1.5": 1.5, "x": 0.45}),
    (lambda c: T.integer(c), {"3": 3, "-2": 1, "x": 1}),
]


@pytest.mark.parametrize("f, text, want", [(f, t, w) for f, cases in CASES for t, w in cases.items()])
def test_cases(spark, f, text, want):
    assert value(spark, text, f) == want


def test_dead_arm_of_explanations(spark):
    prose = "It works well because of the index that was made there.\nTherefore it is fast for all of the readers of it."
    assert value(spark, prose, T.is_explanation) is False
    assert value(spark, prose, lambda c: T.is_explanation(c, fixed=True)) is True


def test_joined(spark):
    df = spark.createDataFrame([("abc-", " def"), ("", "x"), ("a.", "b")], "a string, b string")
    assert [r[0] for r in df.select(T.joined(F.col("a"), F.col("b"))).collect()] == ["abcdef", "x", "a. b"]


def test_clusters(spark):
    import random
    from statistics import mean

    def plain(xs, tol=8.0):
        found = []
        for x in sorted(xs):
            near = next((c for c in found if abs(x - mean(c)) <= tol), None)
            near.append(x) if near else found.append([x])
        return len(found)

    rng = random.Random(3)
    lists = [[10.0, 12.0, 15.0, 40.0, 41.0, 90.0], [], *[[float(rng.randrange(100)) for _ in range(rng.randrange(12))] for _ in range(60)]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, xs array<double>").select("i", G.clusters(F.col("xs")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in got} == {i: plain(x) for i, x in enumerate(lists)}


def test_white_space_is_that_of_unicode(spark):
    every = "".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    assert sorted(set(every) - set(value(spark, every, lambda c: F.regexp_replace(c, r"(?U)\s", "")))) == sorted(T.WHITE)


@pytest.mark.parametrize("f, most", [(lambda c: T.is_code(c, F.array(F.lit("Serif"))), 1), (T.is_tiny, 1), (T.is_prose_in_code, 5), (lambda c: T.joined(c, c), 0)])
def test_a_text_is_taken_apart_once(spark, f, most):
    """Long texts: each test cuts its text in lines and strips it once, not once for each time it names the result."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(f(F.col("t")).alias("v"))
    told = plan._jdf.queryExecution().optimizedPlan().toString().lower()
    assert told.count("split(") <= most + told.count(r"split(lambda x") and "regexp_replace(cast" not in told


def test_other_tests_wait_for_the_kind_of_element(spark):
    """Only code blocks are looked at for prose; with `&` Spark computed the common parts for all rows."""
    from foliant.operators import sections as S

    told = S.demote_code(spark.createDataFrame([(1, "paragraph", "x")], "doc_id long, elem_type string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (elem_type" in told and "(elem_type" + "#" not in told.split("CASE WHEN")[0]


def test_tests_from_the_left_are_those_of_stripped_texts(spark):
    """A trim from the right visits a whole text; what asks for its beginning alone does without."""
    texts = ["", " ", "\u3000\t", "a", " a ", "\x85" * 70, "b" * 60 + " \u2003", "b" * 61, " " * 9 + "c" * 60, "d" + " " * 70, "d" + " " * 70 + "e", "é" * 60 + "\xa0", "é" * 40 + "\n", "é" * 41]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(T.has_text(t), T.at_most(t, 60), T.at_most(t, 40), T.strip(t)).collect()
    assert [tuple(r)[:3] for r in got] == [(r[3] != "", len(r[3]) <= 60, len(r[3]) <= 40) for r in got]
    assert [r[3] for r in got] == [x.strip(T.WHITE) for x in texts]


def test_no_text_meets_on_its_page_where_none_is_asked_for(spark, sf_dir):
    """Types were found after blocks had met on their page, so each reading shuffled all texts."""
    from foliant.queries import QUERIES

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    plan = QUERIES["reading_order"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    pages = [n.output().mkString(" ") for n in nodes(plan) if n.nodeName() == "Window" and "collect_list(sizes" in n.toString().split("\n")[0]]
    assert len(pages) == 2 and not any(x.split("#")[0] in ("text", "fonts", "__h") for p in pages for x in p.split())


def test_breaks_are_searched_as_bytes(spark):
    """is_code matched a pattern against every whole text to see whether it is one line."""
    df = spark.createDataFrame([(f"a{chr(n)}b",) for n in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]] + [("",), ("\u2028",), (None,)], "t string")
    t = F.col("t")
    assert df.where(~T.has_break(t).eqNullSafe(t.rlike(T.ANY_BREAK))).count() == 0
    assert df.where(T.has_break(t)).count() == len(T.BREAKS) + 1
    told = df.select(T.is_code(t, F.array(F.lit("Serif"))))._jdf.queryExecution().optimizedPlan().toString()
    assert T.ANY_BREAK not in told.split("CASE WHEN", 1)[1].split("THEN", 1)[0]
