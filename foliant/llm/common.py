"""What several training-data operators share: sampled splitters, checked broadcasts and
distributed connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.storage import at_end, discard, new_path, remove, shared_dir, tidied, written  # noqa: F401

#: Rows and bytes with which a side may be broadcast after it has been counted and measured.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes: strings, binaries and arrays by their length, all else 8."""
    size = lambda c, t: F.octet_length(c) if t in ("string", "binary") else F.size(c) * 8 if t.startswith("array<") else F.lit(8)
    return sum((F.coalesce(size(F.col(f"`{c}`"), t), F.lit(0)).cast("long") for c, t in df.dtypes), F.lit(16).cast("long"))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; both are summed where the rows are, none is moved."""
    with tidied(df.sparkSession):
        n, most = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return n <= rows and (most or 0) <= size


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted and measured to be small, else unchanged (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows) else df


def bound(value: Column, use) -> Column:
    """use(value) with value computed once per row, however often use's lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(*cols: Column) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


# ------------------------------------------------------------------ sampled splitters


def pick_splitters(sample: list[tuple], weights: list[float], parts: int) -> list[tuple]:
    """At most parts - 1 ascending boundaries that cut the weighted sample in equal shares."""
    order = sorted(range(len(sample)), key=lambda i: sample[i])
    total, out, run, want = sum(weights), [], 0.0, 1
    for i in order:
        if run >= total * want / parts and (not out or sample[i] > out[-1]):
            out.append(sample[i])
            want = int(run * parts / total) + 1
        run += weights[i]
    return out


def sampled_splitters(df: DataFrame, keys: Sequence[str], size: str, parts: int, draws: int = 20_000, seed: int = 7) -> list[tuple]:
    """Quantile boundaries of non-null keys from a sample whose chance grows with `size`.

    About `draws` rows come to the driver, however many there are. The boundaries only
    spread the work: no result depends on which rows were drawn.
    """
    total = df.agg(F.sum(F.col(size).cast("double"))).first()[0] or 0.0
    if total <= 0:
        return []
    chance = F.least(F.lit(1.0), F.lit(draws / total) * F.col(size))
    drawn = df.select(*keys, chance.alias("__p"), (F.col(size) / chance).alias("__w")).where(unit(F.lit(seed), *keys) < F.col("__p")).collect()
    return pick_splitters([tuple(r[k] for k in keys) for r in drawn], [float(r["__w"]) for r in drawn], parts)


def range_of(keys: Sequence[Column], splitters: list[tuple]) -> Column:
    """How many splitters are at or below the keys: a binary search inside the plan."""
    if not splitters:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    key = F.struct(*[c.alias(n) for c, n in zip(keys, names)])
    bounds = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, names)]) for s in splitters])

    def halve(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        mid = F.shiftright(lo + hi, 1)
        right = F.get(bounds, mid) <= key
        return F.when(lo >= hi, s).otherwise(F.struct(F.when(right, mid + 1).otherwise(lo).alias("lo"), F.when(right, hi).otherwise(mid).alias("hi")))

    steps = len(splitters).bit_length() + 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi")), halve, lambda s: s["lo"])


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Distributed union-find by alternating large stars and small stars; each round is
    a combinable minimum per node and one join, and is written to the shared folder.
    Nodes without an edge do not appear; null ends are dropped. A node with very
    many edges is combined map-side, and AQE splits its part of the join.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("high"), F.lit(0).alias("low")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("high"), F.lit(1).alias("low")))
        if ends.groupBy("node").agg(F.sum("high").alias("high"), F.max("low").alias("low")).where("high > 1 or (high = 1 and low = 1)").isEmpty():
            break  # every node hangs on one root, and no root on another
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small, "edges")
        for path in {f.rsplit("/", 1)[0] for f in now.inputFiles()}:
            remove(spark, path)
        now = new
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def offsets(counts: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums of a table whose row count a parameter bounds (ranges or shards)."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(by, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values])
