"""Sharding by sampled splitters."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import bounded, offsets, range_of, sampled_splitters, unit, written


def shard_key(text):
    """The first 60 bits of the text's MD5: equal texts get equal keys; -1 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1).cast("long"))


def homes(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[int]]:
    """Shards of large groups (key, bytes), and the bytes each shard then holds.

    From the largest on, a group goes to the shard that holds least (ties: the first), if that stays
    within 1.02 of the mean; else no shard can hold it and it gets -1: it is split.
    """
    held = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        least, s = held[0]
        if (least + size) * shards * 100 <= 102 * total:
            heapq.heapreplace(held, (least + size, s))
            out[key] = s
        else:
            out[key] = -1
    return out, [b for b, _ in sorted(held, key=lambda x: x[1])]


def in_ranges(rows: DataFrame, keys: list[str], size: str, range_bytes: int, least: int, total: int, coarse: int = 1024, draws: int = 32) -> DataFrame:
    """rows with __range: ranges of the keys in ascending order, of about range_bytes each.

    Quantiles of a size-weighted sample give up to `coarse` ranges. What each really holds is then
    summed, and those that prove overfull are subdivided by quantiles of a sample of their own, of
    `draws` rows for each range that is to come out of one. So the sample that one task or the driver
    sees stays small however many ranges there are, and the plan holds only the coarse boundaries.
    """
    parts = min(coarse, max(least, int(total // range_bytes)))
    dealt = rows.withColumn("__coarse", range_of([F.col(k) for k in keys], sampled_splitters(rows, keys, size, parts)))
    full = dealt.groupBy("__coarse").agg(F.sum(size).alias("__held")).where(F.col("__held") > 2 * range_bytes)
    if full.isEmpty():
        return dealt.withColumn("__range", F.struct(F.col("__coarse").alias("c"), F.lit(0).alias("f"))).drop("__coarse")
    inside = dealt.join(F.broadcast(full), "__coarse")  # at most as many rows as there are coarse ranges
    want = F.ceil(F.col("__held") / range_bytes)
    chance = F.least(F.lit(1.0), F.lit(draws) * want * F.col(size) / F.col("__held"))
    key = F.struct(*keys)
    drawn = inside.where(unit(F.lit(11), *keys) < chance).groupBy("__coarse").agg(F.array_sort(F.collect_set(key)).alias("__drawn"), F.first(want).alias("__want"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__want") - 1)), lambda i: F.floor(i * F.size("__drawn") / F.col("__want")).cast("int"))
    cuts = drawn.select("__coarse", F.array_distinct(F.filter(F.transform(at, lambda i: F.get("__drawn", i)), lambda c: c.isNotNull())).alias("__cuts"))
    found = dealt.join(bounded(cuts), "__coarse", "left")

    def halve(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        mid = F.shiftright(lo + hi, 1)
        right = F.get("__cuts", mid) <= key
        return F.when(lo >= hi, s).otherwise(F.struct(F.when(right, mid + 1).otherwise(lo).alias("lo"), F.when(right, hi).otherwise(mid).alias("hi")))

    n = F.coalesce(F.size("__cuts"), F.lit(0))
    fine = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])
    return found.withColumn("__range", F.struct(F.col("__coarse").alias("c"), F.when(n > 0, fine).otherwise(0).alias("f"))).drop("__coarse", "__cuts")


def shard(rows: DataFrame, shards: int = 24, ranges_per_shard: int = 8, range_bytes: int = 256 << 20, overfull: float = 0.02, key: str = "key", size: str = "size", row_id: str = "doc_id") -> DataFrame:
    """rows plus shard (0 to shards - 1) and slot (gapless from 0); shards get near equal bytes, groups of one key stay together.

    Records are range-partitioned by sampled splitters of (key, sub), and ranges that prove overfull are
    subdivided. Keys with more than `overfull` of a shard, or than a range holds, are placed first, from the
    largest on, each in the shard with the most room; sub is their row id, so that their rows can lie in many
    ranges. Only a key that no shard can hold is split, by row id. Ranges get their place by a prefix sum over
    their totals, and every other group goes to the shard in which its middle byte falls, when
    these are laid out over the room that is left. Thus shards differ from the mean by about `overfull` of a
    shard, or one record, at either end.

    rows needs a non-null key (long), a positive size (long) and an id, which may be null
    or repeated (equal ids of a split key stay together). Sizes are those of whole texts, however
    long. No rows give no rows; other columns pass through, and any named shard or slot is replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    total = rows.agg(F.sum(size)).first()[0] or 0
    if not total:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    limit = max(1.0, min(overfull * total / shards, range_bytes))
    # as many as fit into all shards at that size: a number that parameters and ranges bound
    large = rows.groupBy(key).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > limit).collect()
    home, held = homes([(r[key], r["bytes"]) for r in large], shards, total)
    fixed = spark.createDataFrame(list(home.items()), "__k long, __home int")
    own = F.col(row_id) if dict(rows.dtypes)[row_id] in ("bigint", "int") else F.when(F.col(row_id).isNotNull(), F.xxhash64(row_id))
    sub = F.when(F.col("__k").isNotNull(), F.coalesce(own, F.lit(0))).otherwise(F.lit(0)).cast("long")
    keyed = rows.join(bounded(fixed), F.col(key) == F.col("__k"), "left").withColumn("__sub", sub).withColumn("__home", F.coalesce("__home", F.lit(-1))).drop("__k")
    dealt = in_ranges(keyed, [key, "__sub"], size, range_bytes, shards * ranges_per_shard, total)
    loose = F.when(F.col("__home") < 0, F.col(size)).otherwise(F.lit(0))
    start = written(offsets(dealt.groupBy("__range").agg(F.sum(loose).alias("__bytes")), "__range", ["__bytes"]), "shard-ranges")
    # the room of each shard, and where the loose bytes that fill it end
    room = [max(0, total - shards * h) for h in held]
    rest = total - sum(r["bytes"] for r in large if home[r[key]] >= 0)
    ends = [float(rest) * sum(room[: s + 1]) / max(1, sum(room)) for s in range(shards - 1)]
    group = Window.partitionBy("__range").orderBy(key, "__sub").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("__range", key, "__sub")
    middle = F.sum(loose).over(group) + F.col("__bytes") - F.sum(loose).over(before) / 2
    falls = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("__mid"))) if ends else F.lit(0)
    placed = dealt.join(bounded(start), "__range").withColumn("__mid", middle).withColumn("shard", F.when(F.col("__home") >= 0, F.col("__home")).otherwise(falls).cast("int"))
    placed = written(placed.select(*rows.columns, "__sub", "__range", "shard"), "shard-places")
    counts = placed.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"))
    order = Window.partitionBy("shard", "__range").orderBy(key, "__sub", row_id)
    slot = F.row_number().over(order) - 1 + F.col("__first")
    return placed.join(bounded(first), ["shard", "__range"]).withColumn("slot", slot.cast("long")).select(*rows.columns, "shard", "slot")
