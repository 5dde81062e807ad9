"""Streams: pooling by time windows, and a resumable log fed from a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pool_windows(events: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(key, start, n, mean) by tumbling windows; on a stream, state goes once the watermark has passed a window."""
    source = events.withColumn(ts, F.col(ts).cast("timestamp"))
    source = source.withWatermark(ts, late) if source.isStreaming else source
    pooled = source.groupBy(key, F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return pooled.select(key, F.col("w.start").alias("start"), "n", "mean")


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet log, each batch once, and stop when the input is read; restarts resume."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
