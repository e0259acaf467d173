"""Benchmark statistics over measurement tables.

Every function is a grouped aggregation or a window over a long table of observations,
so one call covers any number of models, runs or systems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_count
from .percentiles import exact_percentiles, same_group
from ..functions.units import seconds_to_hours, seconds_to_minutes

PERCENTILES = (0.5, 0.9, 0.95, 0.99)
# extrapolation scales of the embedding benchmark (vectors)
EXTRAPOLATION_SCALES = (5_000_000, 10_000_000, 50_000_000, 100_000_000)


def latency_summary(obs: DataFrame, group_cols: list[str], latency_col: str = "latency_s",
                    ok_col: str | None = "ok", scale: float = 1000.0, decimals: int = 6,
                    approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """A3: mean, population std, min, max and exact (linearly interpolated) percentiles, in ms.

    The exact percentiles are picked from range-sorted value counts (``percentiles``), so a group
    of any size is spread over the tasks; ``approx=True`` uses a fixed-size sketch instead."""
    src = obs.filter(F.col(ok_col)) if ok_col else obs
    x = F.col(latency_col) * F.lit(scale)
    probs = F.array(*[F.lit(p) for p in PERCENTILES])
    stats = [F.count(F.lit(1)).alias("samples"), F.avg(x).alias("mean_ms"), F.stddev_pop(x).alias("std_ms"),
             F.min(x).alias("min_ms"), F.max(x).alias("max_ms")]
    if approx:
        agg = src.groupBy(*group_cols).agg(*stats, F.percentile_approx(x, probs, accuracy).alias("__p"))
    else:
        plain = src.groupBy(*group_cols).agg(*stats)
        pct = exact_percentiles(src, group_cols, x, list(PERCENTILES))
        agg = (plain.join(pct, same_group(plain, pct, group_cols), "left")
               .select(*[plain[c] for c in plain.columns], F.array(*[F.col(f"p{i}") for i in range(len(PERCENTILES))]).alias("__p")))
    names = ["p50_ms", "p90_ms", "p95_ms", "p99_ms"]
    return agg.select(*group_cols, "samples",
                      *[F.round(c, decimals).alias(c) for c in ("mean_ms", "std_ms", "min_ms", "max_ms")],
                      *[F.round(F.col("__p")[i], decimals).alias(n) for i, n in enumerate(names)])


def throughput_summary(obs: DataFrame, model_col: str = "model", batch_col: str = "batch_size",
                       latency_col: str = "latency_s", ok_col: str = "ok", decimals: int = 6) -> DataFrame:
    """A4: per model and batch size: latency avg/std/min/max (s) of successful calls and
    ``throughput = batch_size / avg_latency``; failed calls are excluded, not counted fast."""
    ok = F.col(ok_col)
    lat = F.when(ok, F.col(latency_col))
    agg = obs.groupBy(model_col, batch_col).agg(
        F.count_if(ok).alias("calls_ok"), F.count_if(~ok).alias("calls_failed"),
        F.avg(lat).alias("avg_latency"), F.stddev_pop(lat).alias("std_latency"),
        F.min(lat).alias("min_latency"), F.max(lat).alias("max_latency"))
    return agg.select(model_col, batch_col, "calls_ok", "calls_failed",
                      *[F.round(c, decimals).alias(c) for c in ("avg_latency", "std_latency", "min_latency",
                                                                "max_latency")],
                      F.round(F.col(batch_col) / F.col("avg_latency"), decimals).alias("throughput"))


def tune_batch_size(thr: DataFrame, model_col: str = "model", batch_col: str = "batch_size",
                    thr_col: str = "throughput", start_size: int = 64, max_size: int = 2048,
                    n_texts: int | None = None, ok_col: str | None = "calls_ok",
                    degrade: float = 0.9) -> DataFrame:
    """O3: walk the doubling ladder from ``start_size``; stop at the first size whose throughput
    falls below ``degrade`` x the previous one (or that has no successful call); the best is the
    highest throughput before the stop, the smaller size on ties.  A model with nothing
    measured gets ``(start_size, 0.0)``."""
    bs = F.col(batch_col)
    ladder = (bs >= start_size) & (bs <= max_size) & ((bs % start_size) == 0) & \
             ((F.log2(bs / F.lit(start_size)) % 1) == 0)
    if n_texts is not None:
        ladder = ladder & (bs <= n_texts)
    m = thr.filter(ladder)
    w = Window.partitionBy(model_col).orderBy(batch_col)
    prev = F.lag(thr_col).over(w)
    failed = (F.col(ok_col) == 0) if ok_col else F.lit(False)
    bad = failed | (prev.isNotNull() & (prev > 0) & (F.col(thr_col) < prev * F.lit(degrade)))
    cum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = m.withColumn("__bad", bad.cast("int")).withColumn("__stop", F.max("__bad").over(cum))
    kept = flagged.filter(F.col("__stop") == 0)
    best = kept.groupBy(model_col).agg(
        F.max_by(F.col(batch_col), F.struct(F.col(thr_col), -F.col(batch_col))).alias("optimal_batch_size"),
        F.max(thr_col).alias("optimal_throughput"))
    models = thr.select(model_col).distinct()
    return (models.join(best, model_col, "left")
            .select(model_col,
                    F.coalesce(F.col("optimal_batch_size"), F.lit(start_size)).alias("optimal_batch_size"),
                    F.coalesce(F.col("optimal_throughput"), F.lit(0.0)).alias("optimal_throughput")))


def pick_optimal(thr: DataFrame, model_col: str = "model", batch_col: str = "batch_size",
                 thr_col: str = "throughput") -> DataFrame:
    """The measured size with the highest throughput (smaller size on ties)."""
    return thr.filter(F.col(thr_col).isNotNull()).groupBy(model_col).agg(
        F.max_by(F.col(batch_col), F.struct(F.col(thr_col), -F.col(batch_col))).alias("optimal_batch_size"),
        F.max(thr_col).alias("optimal_throughput"))


def token_summary(df: DataFrame, text_col: str = "text", group_cols: list[str] | None = None,
                  mode: str = "chars", seconds: float | None = None) -> DataFrame:
    """A5: total tokens, average per document (0 when empty) and, with ``seconds``, the rate."""
    t = token_count(text_col, mode)
    g = df.groupBy(*(group_cols or []))
    out = g.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias("total_tokens"))
    out = out.withColumn("avg_tokens_per_doc",
                         F.coalesce(F.round(F.try_divide(F.col("total_tokens"), F.col("documents")), 6), F.lit(0.0)))
    if seconds is not None:
        out = out.withColumn("tokens_per_second",
                             F.coalesce(F.try_divide(F.col("total_tokens"), F.lit(float(seconds))), F.lit(0.0)))
    return out


def rate(num, den) -> Column:
    """Zero-safe division."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def run_rates(runs: DataFrame, decimals: int = 6, keep_all: bool = False) -> DataFrame:
    """Per run: docs/s, vectors/s, tokens/s over the total time, tokens / embedding time
    (``keep_all`` keeps the run's own columns next to the rates)."""
    return runs.select(
        "*" if keep_all else "run_id",
        F.round(rate("total_documents", "total_time_seconds"), decimals).alias("docs_per_second"),
        F.round(rate("total_vectors", "total_time_seconds"), decimals).alias("vectors_per_second"),
        F.round(rate("total_tokens", "total_time_seconds"), decimals).alias("tokens_per_second"),
        F.round(rate("total_tokens", "vectorization_time"), decimals).alias("token_throughput"),
        F.round(rate("total_tokens", "total_documents"), decimals).alias("avg_tokens_per_doc"))


STAGES = ("pdf_extraction_time", "expansion_time", "token_count_time", "vectorization_time", "export_time")


def stage_breakdown(runs: DataFrame, stages: tuple[str, ...] = STAGES, decimals: int = 6) -> DataFrame:
    """Seconds per stage and its share of the run's stage total (unpivot + window sum)."""
    long = runs.unpivot(["run_id"], list(stages), "stage", "seconds")
    w = Window.partitionBy("run_id")
    return long.select("run_id", "stage", F.round("seconds", decimals).alias("seconds"),
                       F.round(rate(F.col("seconds"), F.sum("seconds").over(w)), decimals).alias("share"))


def extrapolate(df: DataFrame, throughput_col: str, scales=EXTRAPOLATION_SCALES) -> DataFrame:
    """Every row x every scale (fanned out by ``explode`` of a fixed literal list):
    ``seconds = scale / throughput`` plus minutes and hours."""
    sc = F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in scales])).alias("scale")
    out = df.select("*", sc)
    secs = F.try_divide(F.col("scale").cast("double"), F.col(throughput_col))
    return (out.withColumn("seconds", secs).withColumn("minutes", seconds_to_minutes(secs))
            .withColumn("hours", seconds_to_hours(secs)))
