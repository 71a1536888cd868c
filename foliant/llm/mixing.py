"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import bounded, offsets, partitions, range_of, sampled_splitters, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """Adds `rank` (from 0) by code point, null last, without one task that sees every row."""
    named = sources.where(F.col(key).isNotNull())
    cuts = sampled_splitters(named.select(key, F.lit(1).alias("one")), [key], "one", partitions(sources.sparkSession))
    dealt = named.withColumn("__r", range_of([F.col(key)], cuts))
    start = offsets(dealt.groupBy("__r").agg(F.count(F.lit(1)).alias("__n")), "__r", ["__n"])
    place = F.row_number().over(Window.partitionBy("__r").orderBy(key)) - 1
    total = named.agg(F.count(F.lit(1))).first()[0]
    out = dealt.join(F.broadcast(start), "__r").withColumn("rank", place + F.col("__n")).drop("__r", "__n")
    return out.unionByName(sources.where(F.col(key).isNull()).withColumn("rank", F.lit(total).cast("long")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0, key: str = "source", size: str = "source_size") -> DataFrame:
    """(key, size, weight, target) from one row per source.

    Sources by code point (null last) weigh `weights` in turn and share the sum of all
    sizes; no target passes `cap` times its source's size, and the excess is dealt again
    by weight. The level L with sum(min(cap * size, L * weight)) = total is found by a
    few aggregations: each round fixes every source whose cap is below its share, which
    never has to be undone. An empty source gets 0.
    """
    spark = sizes.sparkSession
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked(sizes.select(key, size), key).select(key, size, w.alias("weight"), (F.lit(cap) * F.col(size)).alias("__cap"))
    total = sizes.agg(F.sum(size)).first()[0] or 0
    level, full = 0.0, -1
    while True:
        free, fixed, n = t.agg(
            F.sum(F.when(F.col("__cap") > level * F.col("weight"), F.col("weight"))),
            F.sum(F.when(F.col("__cap") <= level * F.col("weight"), F.col("__cap"))),
            F.count(F.when(F.col("__cap") <= level * F.col("weight"), 1)),
        ).first()
        if not free or n == full:
            break
        level, full = max(level, (total - (fixed or 0.0)) / free), n
    return t.select(key, size, "weight", F.round(F.least(F.col("__cap"), F.lit(level) * F.col("weight")), 6).alias("target"))


BITS = 12  # of a draw that one histogram looks at
DRAWS = 48  # bits of a draw


def draw_of(seed: str, doc_id: Column, text: Column) -> Column:
    """A number of 48 bits by MD5 of seed, doc_id and text; null counts as empty."""
    name = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, DRAWS // 4), 16, 10).cast("long")


def last_draws(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, last): per source the greatest draw whose copy is still taken; slim: __s, size, draw, wanted: __s, extra.

    In the order of their draws documents are taken until their words reach `extra`; the
    one that crosses it is taken if its middle word lies before (equal draws count as one). The
    crossing is looked for in histograms of 2^12 cells per source, each over the cell
    in which the one before found it, so no source is ever sorted as a whole.
    """
    open_ = wanted.where("extra > 0").select("__s", "extra", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"))
    for low in range(DRAWS - BITS, -1, -BITS):
        at = F.shiftright("draw", low)
        cells = slim.select("__s", "size", "draw").join(bounded(open_.select(F.col("__s").alias("__o"), F.col("cell").alias("__c"), "extra", "before")), F.col("__s").eqNullSafe(F.col("__o")) & (F.shiftright("draw", low + BITS) == F.col("__c")))
        cells = cells.groupBy("__s", at.alias("cell"), "extra", "before").agg(F.sum("size").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("__s").orderBy("cell"))
        # the cell where the middle passes `extra`, or the last one
        ranked = cells.withColumn("upto", upto)
        if low:
            over = F.struct((F.col("upto") < F.col("extra")).alias("later"), F.when(F.col("upto") < F.col("extra"), -F.col("cell")).otherwise(F.col("cell")).alias("at"))
            open_ = ranked.groupBy("__s").agg(F.min_by(F.struct("extra", "cell", (F.col("upto") - F.col("n")).alias("before")), over).alias("x")).select("__s", "x.*")
            open_ = written(open_, "cells")
        else:
            taken = F.max(F.when(F.col("upto") - F.col("n") / 2 < F.col("extra"), F.col("cell")))
            first = F.min("cell")
            return written(ranked.groupBy("__s").agg(F.coalesce(taken, first - 1).alias("last")), "draws")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0, seed: str = "mix-1", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs plus size, source_size, target and copies (how often the mix takes the document).

    rate = target / source_size; a document is taken floor(rate) times, and once more if its
    hash-seeded draw is at most its source's last one. That is the draw at which the words of
    the extra copies come to what the target asks (`last_draws`): the fraction rate - floor(rate)
    of the draws where sources are large, so a document's copy has that probability, and in small
    sources the words still end within half of one document of the target. Draws are an MD5
    of seed, doc_id and text, so reruns agree, and no document exceeds ceil(cap) copies.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null doc_id
    hashes as empty. Empty texts may be taken but add nothing. Equal rows are decided alike. An
    empty table gives an empty table. Columns of docs named like the four new ones are replaced.
    """
    named = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col(text)))
    slim = written(named.select(F.col(source).alias("__s"), "size", draw_of(seed, F.col(doc_id), F.col(text)).alias("draw")), "draws")
    totals = written(slim.groupBy("__s").agg(F.sum("size").alias("source_size")), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = source_targets(totals, weights, cap, key="__s").select("__s", "source_size", "target").withColumn("__rate", rate)
    goals = written(goals.withColumn("extra", (F.col("__rate") - F.floor("__rate")) * F.col("source_size")), "goals")
    last = last_draws(slim, goals.select("__s", "extra"))
    goals = goals.join(last.withColumnRenamed("__s", "__l"), F.col("__s").eqNullSafe(F.col("__l")), "left").select("__s", "source_size", "target", "__rate", F.coalesce("last", F.lit(-1)).alias("__last"))
    joined = named.join(bounded(goals), named[source].eqNullSafe(F.col("__s")))
    copies = F.floor("__rate") + (draw_of(seed, named[doc_id], named[text]) <= F.col("__last")).cast("long")
    return joined.select(*[named[c] for c in named.columns], "source_size", "target", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Every row as many times as `copies` says; rows with 0 copies go."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__copy")
