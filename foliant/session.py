"""Session defaults and small helpers every part of the engine shares."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Puts the repository on the path of Python workers that share the driver's files.

    On a cluster that does not, the package is shipped with --py-files.
    """
    own = spark.sparkContext.environment
    if ROOT not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, own.get("PYTHONPATH")) if x)
    return spark


def local_session(name: str = "foliant", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return importable(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FOLIANT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder; any path Spark can read."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
