"""Windowed telemetry over a stream.

Readings are grouped per device and tumbling (or sliding) window; the watermark bounds the
state and drops readings that arrive later than the allowed delay; append mode emits a window
once the watermark has passed its end, so the output holds closed windows only.
Structured Streaming requires a ``TIMESTAMP`` event time, so ``TIMESTAMP_NTZ`` columns are cast
first (session time zone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed_readings(stream: DataFrame, ts_col: str = "ts", device_col: str = "gpu_id",
                      mem_col: str = "memory_used_mb", window: str = "6 hours", slide: str | None = None,
                      watermark: str = "1 hour", decimals: int = 6) -> DataFrame:
    """Streaming (or batch) DataFrame of ``(window_start, window_end, device, snapshots, peak_mb, avg_mb)``."""
    ts = stream.withColumn("__ts", F.col(ts_col).cast("timestamp")).withWatermark("__ts", watermark)
    w = F.window("__ts", window, slide) if slide else F.window("__ts", window)
    return (ts.groupBy(w.alias("w"), F.col(device_col))
            .agg(F.count(F.lit(1)).alias("snapshots"), F.max(mem_col).alias("peak_mb"),
                 F.round(F.avg(mem_col), decimals).alias("avg_mb"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    device_col, "snapshots", "peak_mb", "avg_mb"))


def run_windows_available_now(spark: SparkSession, source_path: str, schema: T.StructType, sink_path: str,
                              checkpoint: str, fmt: str = "parquet", glob: str | None = None, **kw) -> str:
    """Process everything present under ``source_path`` (checkpointed, restartable) and append
    the closed windows to a Parquet sink."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    src = reader.load(source_path)
    prep = kw.pop("prepare", None)
    if prep is not None:
        src = prep(src)
    q = (windowed_readings(src, **kw).writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink_path
