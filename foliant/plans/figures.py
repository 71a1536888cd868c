"""Figures of a flow's stages, and operators as table functions: how the flow is measured and extended."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from foliant.session import importable


class Figures:
    """Counts of stages, taken while an action runs through them, and the seconds of actions.

    A stage is observed where its rows pass, so nothing is computed again to count it. Its figures can be
    read after the first action over it; reading before that waits for one. Each stage has a name of its own.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def stage(self, name: str, df: DataFrame, **figures: Column) -> DataFrame:
        """df, with its rows and further sums counted under a name."""
        if name in self.seen:
            raise ValueError(f"{name} is observed already")
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()])

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Adds the seconds of what runs inside, also if it fails."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began

    def counts(self) -> dict[str, dict]:
        return {name: dict(o.get) for name, o in self.seen.items()}


@udtf(returnType="doc_id long, section_number int, page_number int, heading string")
class Outline:
    """B11, E14 as a table function over elements (doc_id, page_number, elem_type, text) in reading order, one document a partition.

    Elements pass one by one; what stays is a number.
    """

    def __init__(self) -> None:
        self.sections = 0

    def eval(self, row: Row):
        if row["elem_type"] == "heading":
            self.sections += 1
            yield row["doc_id"], self.sections, row["page_number"], " ".join((row["text"] or "").split())


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    importable(spark).udtf.register("outline_of", Outline)
