"""Device telemetry and resource statistics (A6-A8, V12, S15, K8, T1 batch form).

Telemetry is a long table ``(ts, gpu_id, memory_used_mb, ...)``; every statistic is a
grouped aggregate, so any number of devices and runs is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .percentiles import exact_percentiles, same_group

SNAPSHOT_SCHEMA = ("timestamp double, gpu_id string, memory_used_mb double, memory_total_mb double, "
                   "memory_percent double, gpu_util_percent double, temperature double")


def peak_memory(t: DataFrame, device_col: str = "gpu_id", mem_col: str = "memory_used_mb") -> DataFrame:
    """Max memory per device."""
    return t.groupBy(device_col).agg(F.max(mem_col).alias("peak_mb"))


def average_memory(t: DataFrame, device_col: str = "gpu_id", mem_col: str = "memory_used_mb",
                   decimals: int = 6) -> DataFrame:
    """Mean memory per device."""
    return t.groupBy(device_col).agg(F.round(F.avg(mem_col), decimals).alias("avg_mb"))


def telemetry_summary(t: DataFrame, device_col: str = "gpu_id", mem_col: str = "memory_used_mb",
                      group_cols: list[str] | None = None, decimals: int = 6, device_maps: bool = False) -> DataFrame:
    """Devices, snapshot count, peak and average per device, then the max over devices
    (0 when there is no snapshot).  Two-level aggregate: devices first, then the run.
    ``device_maps`` adds the peak and the average per device as maps."""
    g = list(group_cols or [])
    per_dev = t.groupBy(*g, device_col).agg(F.count(F.lit(1)).alias("n"), F.max(mem_col).alias("peak"),
                                            F.avg(mem_col).alias("avg"))
    agg = per_dev.groupBy(*g).agg(
        F.array_sort(F.collect_set(device_col)).alias("devices"),
        F.sum("n").cast("bigint").alias("snapshots"),
        F.coalesce(F.max("peak"), F.lit(0.0)).alias("max_peak_mb"),
        F.coalesce(F.round(F.max("avg"), decimals), F.lit(0.0)).alias("max_avg_mb"),
        *([F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(device_col).cast("string"), v)))).alias(n)
           for n, v in (("peak_by_device", F.col("peak")), ("avg_by_device", F.round("avg", decimals)))] if device_maps else []))
    return agg


def resource_summary(metrics: DataFrame, group_cols: list[str] = ("system", "metric"), value_col: str = "value",
                     decimals: int = 6, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Avg / max / p95 per (system, metric) of a long metrics table; the exact p95 is picked
    from range-sorted value counts, ``approx=True`` uses a fixed-size sketch."""
    stats = [F.count(F.lit(1)).alias("samples"), F.round(F.avg(value_col), decimals).alias("avg"), F.max(value_col).alias("max")]
    if approx:
        return metrics.groupBy(*group_cols).agg(*stats, F.round(F.percentile_approx(value_col, 0.95, accuracy), decimals).alias("p95"))
    plain = metrics.groupBy(*group_cols).agg(*stats)
    pct = exact_percentiles(metrics, list(group_cols), F.col(value_col), [0.95])
    return (plain.join(pct, same_group(plain, pct, list(group_cols)), "left")
            .select(*[plain[c] for c in plain.columns], F.round("p0", decimals).alias("p95")))


def resource_wide(summary: DataFrame, metrics: list[str], stat: str = "avg") -> DataFrame:
    """V12 wide form: one column per metric (pivot with a fixed value list: no extra job)."""
    return summary.groupBy("system").pivot("metric", metrics).agg(F.first(stat))


def telemetry_windows(t: DataFrame, ts_col: str = "ts", device_col: str = "gpu_id",
                      mem_col: str = "memory_used_mb", window: str = "1 hour", slide: str | None = None,
                      decimals: int = 6) -> DataFrame:
    """T1 batch form: peak / average per device per tumbling (or sliding) window.  The window
    keeps the event-time type (``TIMESTAMP_NTZ`` windows are wall-clock, no time zone)."""
    w = F.window(F.col(ts_col), window, slide) if slide else F.window(F.col(ts_col), window)
    return (t.groupBy(w.alias("w"), F.col(device_col))
            .agg(F.count(F.lit(1)).alias("snapshots"), F.max(mem_col).alias("peak_mb"),
                 F.round(F.avg(mem_col), decimals).alias("avg_mb"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    device_col, "snapshots", "peak_mb", "avg_mb"))


def write_telemetry_document(t: DataFrame, path: str, run_col: str, device_col: str = "gpu_id", mem_col: str = "memory_used_mb") -> str:
    """K8, document form: per run one ``{"summary": {...}, "snapshots": [...]}`` object, a line of a
    JSON file.  A document holds all of its run's snapshots, so a run must fit in a row."""
    summary = telemetry_summary(t, device_col, mem_col, [run_col], device_maps=True)
    fields = [c.split()[0] for c in SNAPSHOT_SCHEMA.split(", ")]
    snapshots = t.groupBy(run_col).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in fields if c in t.columns]))).alias("snapshots"))
    packed = summary.select(run_col, F.struct(*[c for c in summary.columns if c != run_col]).alias("summary"))
    (packed.join(snapshots, run_col).select(run_col, "summary", "snapshots")
     .write.mode("errorifexists").json(path))
    return path


def write_telemetry(t: DataFrame, path: str, device_col: str = "gpu_id") -> str:
    """K8: snapshots as JSON lines partitioned by device (see also the document form)."""
    t.write.mode("errorifexists").partitionBy(device_col).json(path)
    return path


def read_telemetry(spark: SparkSession, path: str, fmt: str = "lines", schema: str | None = None, multiline: bool = False) -> DataFrame:
    """``lines`` reads what K8 wrote (with ``schema``, default the snapshot's); ``document`` reads
    ``{summary, snapshots: [...]}`` objects, one per line or, with ``multiline``, one per file."""
    if fmt == "lines":
        return spark.read.schema(schema or SNAPSHOT_SCHEMA).json(path)
    fields = SNAPSHOT_SCHEMA.replace(" double", ": double").replace(" string", ": string")
    doc = spark.read.schema(f"snapshots array<struct<{fields}>>").option("multiLine", str(multiline).lower()).json(path)
    return doc.select(F.inline("snapshots"))
