"""Running sums and latest values over sequences of any length, no task holding more than a block of one.

The places of a sequence are the leaves of a radix tree: a block holds 2^bits places, and its
parent 2^bits blocks. A window runs inside each block; blocks are summed up, their sums run in
the same way one level higher, and every row adds what stands before its block. The summary of
a block (sums, latest values) is associative, so any cut into blocks gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 10
BLOCK, AT = "__block", "__at"


def levels(places: int, bits: int) -> int:
    """How many levels of blocks stand below the one block that holds places 0 to places - 1."""
    n = 0
    while places > 1 << bits:
        places, n = (places - 1 >> bits) + 1, n + 1
    return n


def span(df: DataFrame, at: str) -> tuple[int | None, int | None]:
    return tuple(df.agg(F.min(at), F.max(at)).first())


def running(
    df: DataFrame,
    at: str,
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    ties: Sequence[str] = (),
    within: tuple[int | None, int | None] | None = None,
    bits: int = BITS,
    upto: bool = False,
) -> DataFrame:
    """df with, for every row, the sums and the latest non-null values of the rows before it.

    A row is before another if it has the same `by` (columns without nulls) and a smaller
    (at, *ties); at is a whole number without nulls, and rows of one block with one at are few.
    sums gives 0 and lasts null where nothing is before. upto counts the row itself too.
    within are the least and the greatest at, if they are known, else they are read from df.
    An empty df gives an empty result. Columns of df named as the results are replaced.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    low, high = within if within is not None else span(df, at)
    low, high = (low, high) if low is not None else (0, 0)
    return _run(df, at, low, list(by), sums, lasts, list(ties), levels(high - low + 1, bits), bits, upto)


def _run(df: DataFrame, at: str, low: int, by: list[str], sums: dict, lasts: dict, ties: list[str], depth: int, bits: int, upto: bool) -> DataFrame:
    block = F.shiftright(F.col(at).cast("long") - F.lit(low), bits)
    own = Window.partitionBy(*by, BLOCK).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
    here = df.withColumn(BLOCK, block)
    local = {k: F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()} | {k: F.last(c, ignorenulls=True).over(own) for k, c in lasts.items()}
    if depth == 0:
        return here.withColumns(local).drop(BLOCK)
    order = F.struct(at, *ties) if ties else F.col(at)
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), order)).alias(k) for k, c in lasts.items()]
    totals = here.groupBy(*by, BLOCK).agg(*total)
    names = [*sums, *lasts]
    before = _run(totals.withColumnRenamed(BLOCK, AT), AT, 0, by, {k: F.col(k) for k in sums}, {k: F.col(k) for k in lasts}, [], depth - 1, bits, False)
    before = before.withColumnsRenamed({AT: BLOCK} | {k: f"__{k}" for k in names})
    joined = here.withColumns(local).join(before, [*by, BLOCK])
    joined = joined.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums} | {k: F.coalesce(k, f"__{k}") for k in lasts})
    return joined.select(*[c for c in df.columns if c not in names], *names)


def two_level(df: DataFrame, by: Sequence[str], block: Column | None, order: Sequence[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, several: DataFrame | None = None) -> DataFrame:
    """df with running columns over sequences that are cut in blocks; no action runs.

    A sequence has one value of `by` and is ordered by block and then `order`. For each of sums: the sum
    up to and with the row (name) and of the whole sequence (name + "_total"); for each of lasts: the
    latest non-null value before the row. Rows are dealt by (by, block), so a task holds blocks and not
    sequences. What a block comes to is added up where the rows are and shuffled as one small row each,
    in order, for which df is read a second time with only the columns that this needs. Without a block df
    has it as a column (BLOCK, whole and never null, which goes) and may be dealt by it already.

    several has the rows of all sequences that lie in more than one block, with df's columns and no nulls in
    `by`; where it is given, it is read a second time and not df: one block is the whole of any other sequence.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    # a block that is never null needs no filter before the join
    blocked = lambda d: d if block is None else d.withColumn(BLOCK, F.coalesce(block.cast("long"), F.lit(0).cast("long")))
    rows, parts = blocked(df), blocked(df if several is None else several)
    place = F.struct(*order)
    totals = parts.groupBy(*by, BLOCK).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__{k}") for k, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"__{k}") for k, c in lasts.items()])
    whole = Window.partitionBy(*by)
    before = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, BLOCK,
        *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums],
        *[F.sum(f"__{k}").over(whole).alias(f"{k}_total") for k in sums],
        *[F.last(f"__{k}", ignorenulls=True).over(before).alias(f"__{k}") for k in lasts],
    )
    own = Window.partitionBy(*by, BLOCK).orderBy(*order)
    upto, earlier = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumns({k: F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()} | {k: F.last(c, ignorenulls=True).over(earlier) for k, c in lasts.items()})
    if several is None:
        out = here.join(starts, [*by, BLOCK])
    else:
        # the sums of a block that is the whole sequence are at hand where its rows are
        everything = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        here = here.withColumns({f"__all_{k}": F.coalesce(F.sum(c).over(everything), F.lit(0)) for k, c in sums.items()})
        out = here.join(starts, [*by, BLOCK], "left").withColumns({f"{k}_total": F.coalesce(f"{k}_total", f"__all_{k}") for k in sums} | {f"__{k}": F.coalesce(f"__{k}", F.lit(0)) for k in sums})
    kept = [c for c in df.columns if c not in {BLOCK, *sums, *lasts}]
    return out.select(*kept, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in sums], *[f"{k}_total" for k in sums], *[F.coalesce(k, f"__{k}").alias(k) for k in lasts])
