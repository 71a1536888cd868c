"""Exact dedup by deterministic block naming.

Every text is cut into blocks of SIZE bytes (the last may be shorter; an empty text is one
empty block). The distinct blocks are sorted and named by integers, then adjacent pairs of names are
sorted and named, until each document has one name. Equal texts get one name, and unlike
texts get two, as names stand for contents and not for hashes of them.

A block is looked up under two 64-bit hashes so that its bytes need not be shuffled a second time.
That the blocks with one such key are all equal is proved on the sorted blocks themselves; where two
unlike blocks met under one key, all is done again with the next seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import bound, written

SIZE = 4096
#: Ranges in which names are dealt: a name is 2^40 times its range plus its place in it.
RANGES = 4096


def blocks(text: Column, size: int = SIZE) -> Column:
    """The text's UTF-8 bytes in blocks; null counts as empty."""
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(b) - 1) / size).cast("int"))), lambda i: F.substring(b, i * size + 1, F.lit(size)))
    return bound(F.coalesce(text, F.lit("")).cast("binary"), cut)


def block_key(block: Column, seed: int, bits: int = 64) -> Column:
    """Two seeded hashes of a block, each cut to so many bits (fewer only in tests)."""
    part = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + k), block), 64 - bits)
    return F.struct(part(0).alias("a"), part(1).alias("b"))


def named(distinct: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """distinct rows with `name`: by `keys` they are dealt to ranges, in which their place by `order` counts."""
    spread = distinct.withColumn("__range", F.pmod(F.xxhash64(F.lit("range"), *keys), F.lit(RANGES)))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)).cast("long")
    return spread.withColumn("name", F.shiftleft(F.col("__range"), 40) + place).drop("__range")


def first_names(docs: DataFrame, size: int, seed: int, bits: int) -> DataFrame | None:
    """(a, b, name) of every distinct block; None if two unlike blocks have one key."""
    every = docs.select(F.explode(blocks(F.col("text"), size)).alias("block")).distinct()
    keyed = every.withColumn("key", block_key(F.col("block"), seed, bits)).select("key.a", "key.b", "block")
    names = written(named(keyed, ["a", "b"], ["block"]).drop("block"), "names")
    return None if not names.groupBy("a", "b").count().where("count > 1").isEmpty() else names


def identities(docs: DataFrame, size: int = SIZE, bits: int = 64) -> DataFrame:
    """(row, doc_id, text_sha256, level, name) of every row of docs: equal (level, name) means equal texts, and the other way round.

    row numbers the rows, so that those without a doc_id or with a repeated one stay apart.
    """
    seed = 0
    while (names := first_names(docs, size, seed, bits)) is None:
        seed += 1
    keys = F.transform(blocks(F.col("text"), size), lambda b: block_key(b, seed, bits))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), keys.alias("keys")), "block-keys")
    now = rows.select("row", F.posexplode("keys").alias("pos", "key"), F.size("keys").alias("left")).select("row", F.col("pos").cast("long"), "left", "key.a", "key.b")
    now = written(now.join(names, ["a", "b"]).select("row", "pos", "left", "name"), "block-names")
    done, level = [now.where("left = 1").select("row", F.lit(0).alias("level"), "name")], 0
    while not (more := now.where("left > 1")).isEmpty():
        level += 1
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = more.groupBy("row", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("left") + 1, 1).alias("left")).agg(side(0).alias("x"), F.coalesce(side(1), F.lit(0)).alias("y"))
        pairs = written(pairs, "block-pairs")
        now = written(pairs.join(named(pairs.select("x", "y").distinct(), ["x", "y"], ["x", "y"]), ["x", "y"]).select("row", "pos", "left", "name"), "block-names")
        done.append(now.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
    one = done[0]
    for d in done[1:]:
        one = one.unionByName(d)
    return rows.select("row", "doc_id", "text_sha256").join(one, "row")


def exact_groups(docs: DataFrame, size: int = SIZE, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs.

    Of equal texts the row with the largest doc_id stays, any of them where rows repeat it; rows
    without a doc_id stay only in groups that have none. Null counts as an empty text and is equal to
    it; texts are taken whole, whatever their length, and no letter is changed. An empty table gives no
    rows; columns beside doc_id and text are not looked at. A group's rows are summed before they are
    shuffled, and its rows meet the sums in a join that Spark splits where a group is large.
    """
    rows = written(identities(docs.select("doc_id", "text"), size, bits), "identities")
    last = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))
    # written, so that the join below reads both sides from a shuffle of their own and can be split
    groups = written(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), last.alias("last")), "groups")
    return rows.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("last")).alias("kept"), "text_sha256")
