"""Sinks of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def accumulate(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream's rows to a table under ``folder``, exactly once.

    Each micro-batch writes the part that its id names, and overwrites it if it is delivered again, so a replay after a failure changes
    nothing. ``spark.read.parquet(folder)`` reads the parts as one table with the column ``batch``.
    """
    query = stream.writeStream.foreachBatch(batch_writer(folder)).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def batch_writer(folder: str):
    """What ``accumulate`` does with a micro-batch and its id."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write
