"""The document flow over a folder that keeps receiving block files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import elements as E
from foliant.operators import sinks as K
from foliant.plans.documents import stored
from foliant.sources.blocks import BLOCKS


def section_stream(spark: SparkSession, blocks: str, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes the sections of every newly arrived file of block rows (JSON lines) as Parquet, one folder a batch.

    Sections need whole documents, so a document's blocks must arrive in one file. A batch
    that runs again after a failure overwrites its own folder, so nothing is written twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        K.section_texts(stored(E.in_order(E.elements(rows)))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(BLOCKS).json(blocks)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
