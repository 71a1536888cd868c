"""Geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(c: Column) -> Column:
    """Four doubles from an array of at least four numbers, else zeros."""
    return F.struct(*[F.when(F.size(c) >= 4, c[i].cast("double")).otherwise(F.lit(0.0)).alias(s) for i, s in enumerate(SIDES)])


def with_size(b: Column) -> Column:
    """A box with its width and height, which are never negative."""
    zero = F.lit(0.0)
    return F.struct(*[b[s].alias(s) for s in SIDES], F.greatest(zero, b["x1"] - b["x0"]).alias("width"), F.greatest(zero, b["y1"] - b["y0"]).alias("height"))


def normal(b: Column, width: Column, height: Column) -> Column:
    """A box in parts of the page; a page size of 0 or less counts as 1."""
    w, h = (F.when(s > 0, s).otherwise(F.lit(1.0)) for s in (width, height))
    return with_size(F.struct((b["x0"] / w).alias("x0"), (b["y0"] / h).alias("y0"), (b["x1"] / w).alias("x1"), (b["y1"] / h).alias("y1")))


def region(norm: Column) -> Column:
    """Header or footer band, else null."""
    return F.when(norm["y0"] <= 0.08, "header").when(norm["y1"] >= 0.92, "footer")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common width over the lesser width (at least 1)."""
    common = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return common / F.greatest(F.lit(1.0), F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]))


def intersects(a: Column, b: Column) -> Column:
    """Whether two boxes have a common area; empty boxes have none."""
    full = lambda r: (r["x1"] > r["x0"]) & (r["y1"] > r["y0"])
    return full(a) & full(b) & (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def inside(word: Column, b: Column) -> Column:
    """A5: all four sides within the box, borders included."""
    return (word["x0"] >= b["x0"]) & (word["y0"] >= b["y0"]) & (word["x1"] <= b["x1"]) & (word["y1"] <= b["y1"])


def clusters(values: Column, tolerance: float = 8.0) -> Column:
    """E5: how many clusters the sorted values make, each value joining one whose running mean is within the tolerance.

    On sorted values only the last cluster can match, so a fold with its sum and count will do.
    """
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("k"))

    def step(a: Column, x: Column) -> Column:
        near = (a["n"] > 0) & (F.abs(x - a["s"] / F.greatest(a["n"], F.lit(1))) <= tolerance)
        return F.when(near, F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"), a["k"].alias("k"))).otherwise(F.struct(x.alias("s"), F.lit(1).alias("n"), (a["k"] + 1).alias("k")))

    return F.aggregate(F.array_sort(values), start, step, lambda a: a["k"])
