"""Transaction log reassembly: what a log's commits leave in a store, and what its rollbacks and aborts undo.

A record is a change of a key, a savepoint, a rollback, a commit or an abort of the running
transaction of its stream. Within a stream every record has a height: a change 2 s + 1 and a
rollback 2 s, where s is the number of savepoints before it, and what ends a transaction -1.
The first later record with a lower height is a change's undoer, or the commit that keeps it:
a rollback is lower than what was changed since the latest savepoint, and than nothing before it.

It is searched in a tree of blocks of 2^BITS places. A block's task builds a sparse table of range
minima over its heights and finds the first lower one by binary lifting. What is not found goes up
to the block's parent, whose task does the same over the minima of its blocks, and comes down again
into the block that was found. After a block only two heights can matter, that of its last savepoint
and that of ends, so at most two searches leave a block and no task grows with the log.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written
from foliant.operators.scans import levels, running, span

#: 2^BITS places to a block, and as many blocks to a parent.
BITS = 12
KEYS = 30_000
PER_EPOCH = 64
RECORD = ["at", "stream", "kind", "key", "value"]


# ------------------------------------------------------------------ the log


def log_records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as log records: (at, stream, kind, key, value) by ascending doc_id.

    With h = crc32 of the decimal doc_id, h mod 17 is 0 or 1 for commit, 2 abort, 3 or 4
    savepoint, 5 or 6 rollback, else a change of key floor(h / 100) mod KEYS. Its value is the
    crc32 of `key:text`, or null where the text is null or toxic 1 in labels: a deletion. A null
    source is a stream of its own, an empty text is a value. Rows without a doc_id have no place
    in the log and give no record; rows that repeat a doc_id are one record, that with the
    least (stream, value), deletions first. Texts are read where they are and never moved.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    key = F.floor(h / 100) % KEYS
    value = F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary"))
    stream = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("at"), F.struct(stream.alias("stream"), value.alias("value")).alias("record"), F.lit(0).alias("gone"))
    toxic = labels.where("doc_id is not null and toxic = 1").select(F.col("doc_id").cast("long").alias("at"), F.lit(None).cast("struct<stream:string,value:bigint>").alias("record"), F.lit(1).alias("gone"))
    rows = rows.unionByName(toxic).groupBy("at").agg(F.min("record").alias("record"), F.max("gone").alias("gone")).where("record is not null")
    h = F.crc32(F.col("at").cast("string").cast("binary"))
    m = h % 17
    kind = F.when(m <= 1, "commit").when(m == 2, "abort").when(m <= 4, "savepoint").when(m <= 6, "rollback").otherwise("change")
    change = kind == "change"
    return rows.select("at", "record.stream", kind.alias("kind"), F.when(change, F.floor(h / 100) % KEYS).alias("key"), F.when(change & (F.col("gone") == 0), F.col("record.value")).alias("value"))


# ------------------------------------------------------------------ first later lower height


def minima(heights: np.ndarray) -> list[np.ndarray]:
    """Sparse table: entry k at i is the least of the 2^k heights from i on."""
    table = [heights]
    while 2 << len(table) - 1 <= len(heights):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def first_lower(heights: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each search the first place from start on with a height below bound, else len(heights); by binary lifting."""
    at = start.astype(np.int64)
    for k, low in reversed(list(enumerate(minima(heights)))):
        fits = at + (1 << k) <= len(heights)
        stays = fits & (low[np.minimum(at, len(low) - 1)] >= bound)
        at = np.where(stays, at + (1 << k), at)
    return at


def _in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """The changes of one block with what undoes or keeps them, as far as that is in the block, else the height to search above."""
    rows = rows.sort_values("at", kind="stable")
    heights, change = rows["height"].to_numpy(np.int64), (rows["kind"] == "change").to_numpy()
    own = np.flatnonzero(change)
    found = first_lower(heights, own + 1, heights[own])
    there = found < len(heights)
    out = rows.loc[change, ["stream", "block", "at", "key", "value"]].copy()
    place = np.minimum(found, len(heights) - 1)
    out["by"] = pd.array(np.where(there, rows["at"].to_numpy(np.int64)[place], 0), dtype="Int64")
    out["by_kind"] = np.where(there, rows["kind"].to_numpy(object)[place], None)
    # after the block nothing but an end is lower than what stands before the last savepoint
    last = int(rows["last"].iloc[-1])
    bound = np.where(heights[own] > 2 * last, heights[own], 0)
    out["bound"] = pd.array(np.where(there, 0, bound), dtype="Int64")
    out.loc[~there, "by"] = pd.NA
    out.loc[there, "bound"] = pd.NA
    return out


def _among_blocks(first: bool) -> Callable:
    """Searches among the blocks of one parent: from after their own block, or (first) from the parent's first one."""

    def search(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("block", kind="stable")
        blocks, low = nodes["block"].to_numpy(np.int64), nodes["low"].to_numpy(np.int64)
        out = queries[["stream", "from_block", "bound"]].copy()
        start = np.zeros(len(queries), np.int64) if first else np.searchsorted(blocks, queries["block"].to_numpy(np.int64), side="right")
        found = first_lower(low, start, queries["bound"].to_numpy(np.int64)) if len(blocks) else start
        there = found < len(blocks)
        out["block"] = pd.array(np.where(there, blocks[np.minimum(found, max(len(blocks) - 1, 0))] if len(blocks) else 0, 0), dtype="Int64")
        out.loc[~there, "block"] = pd.NA
        if len(queries):
            last = int(nodes["last"].iloc[-1]) if len(blocks) else 0
            out["above"] = np.where(queries["bound"].to_numpy(np.int64) > 2 * last, queries["bound"].to_numpy(np.int64), 0)
        else:
            out["above"] = pd.Series(dtype="int64")
        return out

    return search


FOUND = "stream string, from_block long, bound long, block long, above long"


def _later_block(queries: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(stream, from_block, bound, block): for searches that left from_block the first later one whose least height is below bound.

    nodes are all blocks of this level with their least height and the savepoints before their end.
    """
    up = lambda df: df.withColumn("parent", F.shiftright("block", BITS))
    by = ["stream", "parent"]
    asked = up(queries.withColumn("from_block", F.col("block")))
    out = asked.groupBy(*by).cogroup(up(nodes).groupBy(*by)).applyInPandas(_among_blocks(False), FOUND)
    if depth == 1:
        return out.where("block is not null").drop("above")
    out = written(out, "log-search")
    parents = up(nodes).groupBy(*by).agg(F.min("low").alias("low"), F.max("last").alias("last")).withColumnRenamed("parent", "block")
    missed = out.where("block is null").select("stream", "from_block", "bound", F.shiftright("from_block", BITS).alias("parent"), "above")
    above = _later_block(missed.select("stream", F.col("parent").alias("block"), F.col("above").alias("bound")).distinct(), parents, depth - 1)
    # down again: in the parent that was found, the first block that is low enough
    above = above.withColumnsRenamed({"from_block": "parent", "bound": "above", "block": "into"})
    down = missed.join(above, ["stream", "parent", "above"]).select("stream", "from_block", "bound", F.col("into").alias("parent"), F.lit(0).cast("long").alias("block"))
    below = down.groupBy(*by).cogroup(up(nodes).groupBy(*by)).applyInPandas(_among_blocks(True), FOUND).where("block is not null")
    return out.where("block is not null").unionByName(below).drop("above")


def _first_of_block(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The record of a block that the searches which came to it find."""
    rows = rows.sort_values("at", kind="stable")
    heights, out = rows["height"].to_numpy(np.int64), queries[["stream", "from_block", "bound"]].copy()
    if not len(queries):
        return out.assign(by=pd.Series(dtype="int64"), by_kind=pd.Series(dtype=object))
    found = first_lower(heights, np.zeros(len(queries), np.int64), queries["bound"].to_numpy(np.int64))
    return out.assign(by=rows["at"].to_numpy(np.int64)[found], by_kind=rows["kind"].to_numpy(object)[found])


def resolved(log: DataFrame) -> DataFrame:
    """Changes (at, key, value, by, by_kind): what undoes or keeps each, both null where the log ends first.

    log has the columns of RECORD with unique `at` and no null stream, written to a table.
    """
    low, high = span(log, "at")
    low, high = (0, 0) if low is None else (low, high)
    marks = running(log, "at", ["stream"], sums={"saved": (F.col("kind") == "savepoint").cast("long")}, within=(low, high), bits=BITS)
    height = F.when(F.col("kind") == "change", 2 * F.col("saved") + 1).when(F.col("kind") == "rollback", 2 * F.col("saved")).otherwise(F.lit(-1))
    block = F.shiftright(F.col("at") - F.lit(low), BITS)
    rows = written(marks.where("kind <> 'savepoint'").withColumns({"height": height.cast("long"), "block": block, "last": F.col("saved")}), "log-heights")
    first = rows.groupBy("stream", "block").applyInPandas(_in_block, "stream string, block long, at long, key long, value long, by long, by_kind string, bound long")
    depth = levels(high - low + 1, BITS)
    if depth == 0:
        return first.select("at", "key", "value", "by", "by_kind")
    first = written(first, "log-blocks")
    open_ = first.where("bound is not null").select("stream", "block", "bound").distinct()
    nodes = rows.groupBy("stream", "block").agg(F.min("height").alias("low"), F.max("last").alias("last"))
    there = _later_block(open_, nodes, depth)
    found = there.groupBy("stream", "block").cogroup(rows.groupBy("stream", "block")).applyInPandas(_first_of_block, "stream string, from_block long, bound long, by long, by_kind string")
    later = found.select("stream", F.col("from_block").alias("block"), "bound", F.col("by").alias("later"), F.col("by_kind").alias("later_kind"))
    both = first.join(later, ["stream", "block", "bound"], "left")
    return both.select("at", "key", "value", F.coalesce("by", "later").alias("by"), F.coalesce("by_kind", "later_kind").alias("by_kind"))


# ------------------------------------------------------------------ the store


def commit_epochs(log: DataFrame, within: tuple[int | None, int | None], per_epoch: int = PER_EPOCH) -> DataFrame:
    """(by, epoch) of every commit: per_epoch commits of all streams to an epoch, the last one has the rest."""
    commits = log.where("kind = 'commit'").select(F.col("at").alias("by"))
    ranked = running(commits, "by", sums={"rank": F.lit(1).cast("long")}, within=within, bits=BITS)
    return ranked.select("by", (F.floor(F.col("rank") / per_epoch) + 1).alias("epoch"))


def epoch_states(kept: DataFrame, epochs: DataFrame) -> DataFrame:
    """(epoch, n, total): keys stored after each epoch and the sum of their values.

    kept are changes with their commit in `by`. What an epoch leaves of a key is the last change
    of its last commit; against what stood before it gives a difference, and differences are
    summed over the epochs.
    """
    applied = kept.join(epochs, "by").groupBy("key", "epoch").agg(F.max(F.struct("by", "at", "value")).alias("m")).select("key", "epoch", F.coalesce("m.value", F.lit(-1)).alias("now"))
    applied = written(applied, "log-applied")
    last = (epochs.agg(F.max("epoch")).first()[0]) or 1
    was = running(applied, "epoch", ["key"], lasts={"was": F.col("now")}, within=(1, last), bits=BITS)
    was = was.withColumn("was", F.coalesce("was", F.lit(-1)))
    size = lambda c: (F.col(c) >= 0).cast("long")
    change = was.select("epoch", (size("now") - size("was")).alias("n"), (F.greatest("now", F.lit(0)) - F.greatest("was", F.lit(0))).alias("total"))
    change = change.unionByName(epochs.select("epoch", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total")))
    change = written(change.groupBy("epoch").agg(F.sum("n").alias("dn"), F.sum("total").alias("dt")), "log-epochs")
    return running(change, "epoch", sums={"n": F.col("dn"), "total": F.col("dt")}, within=(1, last), bits=BITS, upto=True).select("epoch", "n", "total")


def reassemble(log: DataFrame, per_epoch: int = PER_EPOCH) -> DataFrame:
    """(kind, id, n, value): `state` rows of every epoch, and a row for every change that is undone.

    state: the epoch from 1, the count of stored keys and the sum of their values. rollback and
    abort: the change's place, that of its undoer (null: the log ended) and its key. A log
    without commits has no epochs; an empty one gives no rows.
    """
    log = written(log.select(*RECORD), "log")
    changes = written(resolved(log), "log-changes")
    epochs = written(commit_epochs(log, span(log, "at"), per_epoch), "log-commits")
    states = epoch_states(changes.where("by_kind = 'commit'"), epochs)
    undone = changes.where("by_kind is null or by_kind <> 'commit'")
    kind: Column = F.when(F.col("by_kind") == "rollback", "rollback").otherwise("abort")
    return states.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value")).unionByName(undone.select(kind.alias("kind"), F.col("at").alias("id"), F.col("by").alias("n"), F.col("key").alias("value")))
