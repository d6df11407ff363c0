"""A campaign over a folder that questions keep arriving in.

Each micro-batch is answered and upserted into the store by natural key, so a
batch that runs twice after a failure leaves the same rows; the checkpoint
folder resumes a stopped stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def start(
    spark: SparkSession, source: str, schema: str, answer: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str,
    table: str = "predictions", once: bool = False,
) -> StreamingQuery:
    """Answer questions of ``source`` (Parquet) as they come; with ``once``, those that are there, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, _epoch: int) -> None:
        if not rows.isEmpty():
            store.upsert(table, answer(rows))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
