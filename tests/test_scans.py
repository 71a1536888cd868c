"""Running sums and latest values in blocks are those of one window."""

import random

import pytest

from pyspark.sql import functions as F

from foliant.operators import scans


def rows(n=400, seed=3, reach=3000):
    r = random.Random(seed)
    return [(r.choice("ab"), at, r.randrange(9), r.choice([None, r.randrange(99)])) for at in r.sample(range(-reach, reach), n)]


def plain(data, upto):
    out = []
    for by, at, x, y in data:
        seen = sorted((r for r in data if r[0] == by and (r[1] < at or upto and r[1] == at)), key=lambda r: r[1])
        out.append((by, at, sum(r[2] for r in seen), next((r[3] for r in reversed(seen) if r[3] is not None), None)))
    return sorted(out)


@pytest.mark.parametrize("bits", [4, 13])
@pytest.mark.parametrize("upto", [False, True])
def test_any_cut_into_blocks_gives_the_same_rows(spark, bits, upto):
    data = rows(120)
    df = spark.createDataFrame(data, "k string, at long, x long, y long")
    got = scans.running(df, "at", ["k"], sums={"s": df.x}, lasts={"l": df.y}, bits=bits, upto=upto)
    assert sorted(tuple(r) for r in got.select("k", "at", "s", "l").collect()) == plain(data, upto)


def test_ties_empty_and_one_row(spark):
    df = spark.createDataFrame([(5, 2, 1), (5, 1, 10), (900, 0, 100)], "at long, t int, x long")
    got = scans.running(df, "at", sums={"s": df.x}, lasts={"l": df.x}, ties=["t"], bits=2)
    assert sorted(map(tuple, got.select("at", "t", "s", "l").collect())) == [(5, 1, 0, None), (5, 2, 10, 10), (900, 0, 11, 1)]
    assert scans.running(df.where("false"), "at", sums={"s": df.x}).collect() == []
    assert [tuple(r) for r in scans.running(df.where("at = 900"), "at", sums={"s": df.x}).collect()] == [(900, 0, 100, 0)]


def test_levels():
    assert [scans.levels(n, 10) for n in (0, 1, 1024, 1025, 1 << 20, 1 << 40)] == [0, 0, 0, 1, 1, 3]


@pytest.mark.parametrize("span", [1, 16, 10_000])
def test_two_levels(spark, span):
    data = [("a" if i % 3 else "b", i, i % 5, i if i % 4 == 0 else None) for i in range(90)]
    df = spark.createDataFrame(data, "k string, at long, x long, y long")
    got = scans.two_level(df, ["k"], F.floor(df.at / span), ["at"], {"s": df.x}, {"l": df.y})
    want = []
    for k, at, x, y in data:
        own = [r for r in data if r[0] == k]
        want.append((k, at, sum(r[2] for r in own if r[1] <= at), sum(r[2] for r in own), next((r[3] for r in reversed(own) if r[3] is not None and r[1] < at), None)))
    assert sorted(map(tuple, got.select("k", "at", "s", "s_total", "l").collect())) == sorted(want)


def test_one_document_is_dealt_by_page_ranges(spark, request):
    from foliant.operators import elements as E
    from foliant.operators import sections as S

    def elems(pages):
        n = spark.range(pages * 4)
        box = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double,width:double,height:double>")
        kind = F.when(F.col("id") % 7 == 0, "heading").when(F.col("id") % 7 == 1, "image").otherwise("paragraph")
        return E.shaped(n.select(F.lit(1).cast("long").alias("doc_id"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("page_number"), (F.col("id") % 4).cast("int").alias("reading_order_index"), kind.alias("elem_type"), box.alias("bbox"), box.alias("norm_bbox"), F.lit("t").alias("text")))

    for key, value in {"spark.sql.shuffle.partitions": 64, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": -1}.items():
        spark.conf.set(key, value)
    request.addfinalizer(lambda: [spark.conf.set(k, v) for k, v in (("spark.sql.shuffle.partitions", 4), ("spark.sql.adaptive.coalescePartitions.enabled", "true"), ("spark.sql.autoBroadcastJoinThreshold", 10 << 20))])
    for pages in (40, 400):
        rows = E.in_order(elems(pages), pages=10)
        got = S.detect_sections(rows).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(1, pages * 4 + 1))
        assert [r["section_number"] for r in got] == [i // 7 + 1 for i in range(pages * 4)]
        assert [r["image_index"] for r in got if r["elem_type"] == "image"] == list(range(1, sum(i % 7 == 1 for i in range(pages * 4)) + 1))
        assert {r["sections_total"] for r in got} == {(pages * 4 + 6) // 7}
        dealt = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert dealt <= 7 * 40  # some ranges of 40 rows to a task, however many pages there are


def test_only_sequences_of_several_blocks_are_counted_beforehand(spark):
    """Where these are told, the others' sums are those of their one block; rows are the same."""
    data = [(k, i, i % 5, i if i % 4 == 0 else None) for k, n in (("a", 40), ("b", 16), ("c", 1), ("d", 17)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, at long, x long, y long")
    got = lambda d, several: sorted(map(str, scans.two_level(d, ["k"], F.floor(F.col("at") / 16), ["at"], {"s": F.col("x")}, {"l": F.col("y")}, several=several).collect()))
    assert got(df, df.where("k in ('a', 'd')")) == got(df, None)
    short = df.where("k in ('b', 'c')")
    assert got(short, df.where("false")) == got(short, None)
