"""Every query that has SQL gives DuckDB's rows; native operators stay out of Python."""

import glob
import os

import pytest

import __spark_entry__ as entry
from foliant.oracle import ORACLE
from foliant.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
PYTHON = ("code_merge", "code_resources", "document_flow", "scene_elements", "scene_steps", "scene_play", "scene_json", "element_defaults", "table_score", "crop_best", "table_trim", "merge_origins", "outline_sql", "stage_figures", "scene_stream", "chunk_source", "section_files")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(PYTHON)))
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInArrow", "MapInPandas"))


def test_columns_are_pruned(spark, sf_dir):
    plan = QUERIES["section_outline"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_rounding_is_that_of_sql(spark):
    """Ties of doubles: 41 / 640 is rounded down by SQL, and was rounded up."""
    import duckdb
    from foliant.queries import r6

    pairs = [(41, 640), (82, 1280), (323, 640), (333, 640), (1, 128), (3, 640), (1, 3)]
    got = [x.v for x in spark.createDataFrame(pairs, "k int, d int").selectExpr("k / d as v").select(r6("v").alias("v")).collect()]
    assert got == [duckdb.sql(f"SELECT round({k}::DOUBLE / {d}, 6)").fetchall()[0][0] for k, d in pairs]
