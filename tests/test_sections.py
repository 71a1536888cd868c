"""Sections: merging, selection, reflow, on small inputs and at random."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from foliant.operators import sections as S
from foliant.operators.sinks import extension_of

SCHEMA = "doc_id long, section_number int, pos long, page_number int, elem_type string, text string, reading_order_index long, norm_bbox struct<x0:double,y0:double,x1:double,y1:double,width:double,height:double>, item_count int"


def rows(spark, items):
    """items: (type, text[, page[, x0, y0]])."""
    out = []
    for i, item in enumerate(items):
        kind, text, page, x, y = (*item, *(None, None, 1, 0.1, 0.1)[len(item) :])
        out.append((1, 1, i + 1, page, kind, text, 100 + i, (x, y, x + 0.1, y + 0.05, 0.1, 0.05), 9))
    return spark.createDataFrame(out, SCHEMA)


def shown(df):
    return [(r["elem_type"], r["text"]) for r in df.orderBy("doc_id", "section_number", "pos").collect()]


def test_paragraph_merge(spark):
    long = "def ghi jkl mno pqr stu vwx yza bcd efg hij"
    got = shown(S.merge_paragraphs(rows(spark, [("paragraph", "abc-"), ("link", None), ("paragraph", "…"), ("paragraph", long), ("heading", "H"), ("paragraph", "P3 stays as it is")])))
    assert got == [("paragraph", "abc" + long), ("heading", "H"), ("paragraph", "P3 stays as it is")]
    same = [("paragraph", "one two three four"), ("list_item", "- x"), ("paragraph", "five six seven")]
    assert shown(S.merge_paragraphs(rows(spark, same))) == same


@pytest.mark.parametrize(
    "items, want",
    [
        ([("code_block", "a"), ("link", None), ("code_block", "b")], [("code_block", "a\nb")]),
        ([("code_block", "a"), ("link", None), ("heading", "H")], [("code_block", "a"), ("link", None), ("heading", "H")]),
        ([("code_block", "a"), ("paragraph", "tiny"), ("code_block", "b")], [("code_block", "a\nb")]),
        ([("code_block", "f(", 1), ("code_block", "x", 2)], [("code_block", "f(\nx")]),
        ([("code_block", "plain words", 1), ("code_block", "a=b;c=d;{}", 2)], [("code_block", "plain words"), ("code_block", "a=b;c=d;{}")]),
        ([("code_block", "a"), ("code_block", "b"), ("link", None), ("paragraph", "a long paragraph that is no separator at all, is it")], [("code_block", "a\nb"), ("paragraph", "a long paragraph that is no separator at all, is it")]),
    ],
)
def test_code_merge(spark, items, want):
    assert shown(S.merge_code(rows(spark, items))) == want


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(range(5)), st.integers(1, 3), st.booleans()), max_size=14))
def test_code_runs_keep_order(items):
    roles, pages, on = ([x[k] for x in items] for k in range(3))
    last = 0
    for *run, stop in S.code_runs(roles, pages, on):
        assert run == sorted(set(run)) and run[0] >= last and run[-1] < stop <= len(roles)
        assert all(roles[i] == S.CODE for i in run) and S.HARD not in roles[run[0] : stop] and S.OTHER not in roles[run[0] : stop]
        last = stop


def test_sections_and_selection(spark):
    kinds = ["paragraph", "heading", "paragraph", "paragraph", "heading", "heading", "paragraph"]
    found = S.detect_sections(rows(spark, [(k, k) for k in kinds]).drop("section_number"))
    assert [r["count"] for r in found.groupBy("section_number").count().orderBy("section_number").collect()] == [3, 1, 2]
    many = S.detect_sections(rows(spark, [("heading", str(i)) for i in range(20)]).drop("section_number"))
    assert sorted(r["section_number"] for r in S.select_sections(many, [(18, 15)]).collect()) == [15, 16, 17, 18]
    assert S.select_sections(many, [(21, 30), ("x", 1)]).count() == 20


def test_reflow(spark):
    two = rows(spark, [("paragraph", str(i), 1, 0.1 if i % 2 else 0.6, 0.1 + 0.1 * (i // 2)) for i in range(6)])
    assert [t for _, t in shown(S.reflow(two))] == ["1", "0", "3", "2", "5", "4"]
    assert [r["reading_order_index"] for r in S.reflow(two).orderBy("pos").collect()] == list(range(100, 106))
    five = rows(spark, [("paragraph", str(i), 1, 0.1 if i % 2 else 0.6, 0.1) for i in range(5)])
    assert [t for _, t in shown(S.reflow(five))] == list("01234")


def test_partitioning_changes_nothing(spark):
    rng = random.Random(5)
    items = [(rng.choice(["paragraph", "code_block", "link", "heading"]), rng.choice(["tiny", "call(x);", "a longer sentence that says a thing or two"]), rng.randrange(1, 4)) for _ in range(60)]
    df = rows(spark, items)
    one = shown(S.merge_paragraphs(S.merge_code(df)))
    assert one == shown(S.merge_paragraphs(S.merge_code(df.repartition(7))))
    assert len(one) <= len(items)


def test_extensions():
    assert extension_of(["nope", "golang"]) == "go" and extension_of([], "JSON") == "json" and extension_of([]) == "txt"
