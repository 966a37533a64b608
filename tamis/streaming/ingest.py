"""Streams into an index: every micro-batch is one commit, made once even if Spark repeats the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tamis.operators.engine import Engine


def ingest_stream(stream: DataFrame, engine: Engine, checkpoint: str, name: str = "ingest", json_column: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that stores the stream's rows. json_column: rows are JSON objects in this column.

    name tells apart the streams that write into one index. trigger: of DataStreamWriter.trigger; the default takes a
    micro-batch every max_buffered_seconds.
    """

    def store(df: DataFrame, number: int) -> None:
        batch = (name, number)
        if json_column is None:
            engine.ingest(df, batch)
        else:
            engine.ingest_json(df, json_column, batch)

    every = trigger or {"processingTime": f"{engine.config.max_buffered_seconds} seconds"}
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**every).start()
