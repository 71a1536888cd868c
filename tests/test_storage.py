"""What intermediate tables leave on disk."""

import os
import random

from pyspark.sql import functions as F

from foliant import queries as Q
from foliant.llm.line_dedup import fuzzy_lines
from foliant.operators import sinks as K
from foliant.operators import tables as R
from foliant.plans import documents as D
from foliant.sources import trees
from foliant.storage import CLEANUP, discard, shared_dir, written


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in files.mkString("\n").split("\n") if "shuffle_" in x}


def tables(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("foliant-")} if os.path.isdir(folder) else set()


def test_written_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    found = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sevens")
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP) == setting
    assert sorted(found.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_only_written_tables_are_discarded(spark, tmp_path):
    folder, before = str(tmp_path / "foliant-data" / "t.parquet"), tables(spark)
    spark.range(5).write.parquet(folder)
    discard(spark.read.parquet(folder).unionByName(written(spark.range(3), "three")))
    assert tables(spark) == before and spark.read.parquet(folder).count() == 5


def test_line_dedup_keeps_only_tables_that_its_rows_come_from(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank {}"
    docs = spark.createDataFrame([(i, "\n".join([base.format(i % 3), "same line in every one of them", f"{i} alone {i * 7919}"])) for i in range(20)], "doc_id long, text string")
    before = tables(spark)
    found = fuzzy_lines(docs)
    assert sorted(x.split("-")[1] for x in tables(spark) - before) == ["best", "places"]
    kept = {tuple(r) for r in found.select("doc_id", "line_no").where("keep").collect()}
    assert kept == {(0, 0), (0, 1)} | {(i, 2) for i in range(20)}


def test_words_of_regions_are_those_of_their_pages(spark):
    """Lists of words by region: a doc_id may come twice, be null or have no text, and lines may be blank."""
    docs = spark.createDataFrame([(1, "a b\tc\n\n  d " * 9), (1, "x y"), (2, None), (3, "one two three\n" * 20), (None, "lost words"), (4, "")], "doc_id long, text string")
    regions = Q._regions(docs).select(*R.REGION, "bbox")
    plain = R.words_in(R.words_from_documents(docs), regions)
    word = ("y0", "x0", "word_no", "x1", "y1", "text")
    lists = R.region_words(docs, regions)
    got = sorted((*r[:3], *r["w"]) for r in lists.select(*R.REGION, F.explode("ws").alias("w")).collect())
    assert got == sorted(tuple(r) for r in plain.select(*R.REGION, *word).collect()) and len(got) > 100
    lined = [sorted(map(tuple, x.collect())) for x in (R.line_facts(R.numbered(lists)), R.line_facts(R.grouped_lines(plain)))]
    assert lined[0] == lined[1]


def test_scoring_tables_shuffles_no_words(spark):
    """a word with its box and region took ten times the bytes of its text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts = [(i, "\n".join(" ".join(word() for _ in range(400)) for _ in range(16))) for i in range(1, 9)]
    before = shuffle_files(spark)
    Q._scored(spark.createDataFrame(texts, "doc_id long, text string")).write.format("noop").mode("overwrite").save()
    shuffled = sum(os.path.getsize(x) for x in shuffle_files(spark) - before if x.endswith(".data"))
    assert 0 < shuffled < 2 * sum(len(t) for _, t in texts)


def test_deviation_is_that_of_stddev_pop(spark):
    rows = [(i, [float((i * k * 37) % 11) / 3 for k in range(i)]) for i in range(2, 40)]
    df = spark.createDataFrame(rows, "i long, xs array<double>")
    want = {r["i"]: r["d"] for r in df.select("i", F.explode("xs").alias("x")).groupBy("i").agg(F.stddev_pop("x").alias("d")).collect()}
    got = {r["i"]: r["d"] for r in df.select("i", R.deviation(F.col("xs")).alias("d")).collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert spark.createDataFrame([([],), ([4.0],)], "xs array<double>").select(R.deviation(F.col("xs"))).collect() == [(0.0,), (0.0,)]


def test_section_files_stand_in_parts(spark, monkeypatch):
    """all files and folders of the table stood on disk at once."""
    text = "\n".join(f"Words of line {i} and more of them" for i in range(400))
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    made = lambda: written(D.stored(D.document_elements(docs)), "stored")
    told = lambda files: files.select("path", F.md5("content").alias("md5"))
    before, most, real = tables(spark), [], trees.read_tree

    def read(folders, root):
        standing = [x for x in tables(spark) - before if x.startswith("foliant-sections")]
        most.append((len(standing), len(os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{standing[0]}"))))
        return real(folders, root)

    monkeypatch.setattr(K, "read_tree", read)
    whole = sorted(map(tuple, K.files_read_back(made(), told).collect()))
    assert most == [(1, 30)]
    parts = sorted(map(tuple, K.files_read_back(made(), told, at_once=8).collect()))
    assert parts == whole and len({p.split("/")[0] for p, _ in parts}) == 30
    assert len(most) == 5 and all(n == 1 for n, _ in most) and sum(d for _, d in most[1:]) == 30
    assert {x.split("-")[1] for x in tables(spark) - before} <= {"files", "last", "long"}
