"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Every stage takes the rows its predecessor kept and returns the columns of documents (the
last adds shard and slot); run() writes each stage as Parquet and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, jaccard_join, langid, mixing, sharding
from foliant.llm.common import bounded, written
from foliant.session import table


def aside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs alone; own columns named as those that work adds are kept aside meanwhile."""
    own = {c: f"__own_{c}" for c in names if c in docs.columns}
    renamed = docs.withColumnsRenamed(own)
    return work(renamed).select(*renamed.columns).withColumnsRenamed({v: k for k, v in own.items()})


KEY = "__row"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, a hash of doc_id and text: rows share one only if they repeat each other."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of keyed() whose key is not among keys."""
    return rows.join(bounded(keys), KEY, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: null, without letters, or below the calibrated threshold.

    Rows are decided each by its whole text, however long; repeated rows are decided alike, and an
    empty table gives no rows.
    """
    model = langid.train(docs)
    return aside(docs, ("lang_pred", "score", "accepted"), lambda d: langid.identify(d, model).where("accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the least doc_id (null last); five-word shingles, similarity 0.8.

    Rows are told apart by doc_id and text: unlike texts under one doc_id are decided each on its own,
    and rows without a doc_id take part by their texts. Of rows that repeat each other wholly in both
    one stays. Null and empty texts and those without words are in no group and stay. Texts of any
    length are taken whole; an empty table gives no rows.
    """
    rows = keyed(docs)
    found = jaccard_join.jaccard_components(rows.select(F.col(KEY).alias("doc_id"), "text"), size=5, percent=80)
    groups = written(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias(KEY), "component_id").agg(F.count(F.lit(1)).alias("n")), "groups")
    many = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    # only groups of several texts or ids are looked into
    inside = written(groups.join(bounded(many), "component_id").select(KEY, "component_id").join(rows.select(KEY, "doc_id"), KEY).select(KEY, "component_id", "doc_id"), "grouped")
    first = inside.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(KEY).alias("first"))).alias("x")).select("component_id", "x.first")
    gone = inside.join(bounded(first), "component_id").where(F.col(KEY) != F.col("first")).select(KEY).distinct()
    return one_each(without(rows, gone), groups.where("n > 1").select(KEY)).drop(KEY)


def one_each(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of rows with one of the repeated keys one stays."""
    if repeated.isEmpty():
        return rows
    repeated = bounded(repeated)
    return rows.join(repeated, KEY, "left_anti").unionByName(rows.join(repeated, KEY, "left_semi").dropDuplicates([KEY]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows are decided each by its own text, whatever their doc_id, null or repeated. Null and empty texts
    hold no item and stay. Texts of any length are taken whole; an empty table gives no rows.
    """
    rows = keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col(KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, found.select(F.col("doc_id").alias(KEY)).distinct()).drop(KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks: the rows repeat.

    A null source is one of its own. Null and empty texts have no words: they stay as often as the
    others of their source, or go where their source has none. Equal rows are decided alike. The
    words of a text are counted whatever its length; an empty table gives no rows.
    """
    return aside(docs, ("size", "source_size", "target", "copies"), lambda d: mixing.emit(mixing.mix_sources(d)))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with shard and slot, 24 shards of near equal bytes; own columns of these names are replaced.

    Null and empty texts count 8 bytes. Equal texts share a shard, unless no shard can hold them all
    within 1.02 of the mean; then they are dealt by doc_id, null first. Texts of any length go whole; an
    empty table gives no rows.
    """
    docs = docs.drop("shard", "slot")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    keyed = docs.withColumn("__key", sharding.shard_key(F.col("text"))).withColumn("__size", size)
    return sharding.shard(keyed, key="__key", size="__size").select(*docs.columns, "shard", "slot")


STAGES = [("language id", language), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("mixing", mix), ("sharding", shard)]

#: Language ID is a trained model, which SQL cannot express; tests hold each stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
