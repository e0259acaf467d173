"""Incremental corpus ingest into a vector store.

New collection files -> S1 parsing -> de-duplication by id -> embedding -> append to the store.
Each micro-batch is written to its own directory ``batch=<id>`` with overwrite, so a replayed batch
(after a failure between the write and the checkpoint commit) replaces its own output instead
of duplicating it; positions continue after the last position of all earlier batches, read
from a one-row-per-batch ledger (also overwritten per batch).

Exact de-duplication keeps no streaming state: the ids of every batch are written beside its
vectors in ``BUCKETS`` folders by hash, and a batch drops the ids that earlier batches have by an
anti join with the folders of its own ids.  With a horizon, ids are compared within an
ingest-time watermark instead, whose state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import embed
from ..operators.ordinals import dense_id
from ..session import cut_lineage, path_exists
from ..sources.corpus import parse_collection


#: folders of known ids
BUCKETS = 64


def stream_store_path(root: str) -> str:
    return f"{root.rstrip('/')}/stream"


def read_stream_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(stream_store_path(root)).select("pos", "id", "vector", "batch")


def incremental_ingest(spark: SparkSession, source_dir: str, store_root: str, factory, dim: int,
                       checkpoint: str, min_length: int = 10, max_length: int = 512,
                       dedupe_horizon: str | None = None, available_now: bool = True):
    """Start (and with ``available_now`` run to completion) the ingest query."""
    lines = spark.readStream.format("text").load(source_dir)
    coll = parse_collection(lines, min_length, max_length).select("id", "text")
    if dedupe_horizon:
        coll = (coll.withColumn("__ingest", F.current_timestamp()).withWatermark("__ingest", dedupe_horizon)
                .dropDuplicatesWithinWatermark(["id"]).drop("__ingest"))
    out_root = stream_store_path(store_root)

    ledger, known = (f"{store_root.rstrip('/')}/{name}" for name in ("_ledger", "_ids"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def write(batch: DataFrame, batch_id: int):
        sp = batch.sparkSession
        # the ledger holds one tiny row per committed batch (first position, rows), so the
        # next start position never requires scanning the stored vectors
        prev = None
        if path_exists(sp, ledger):  # else the first batch; a ledger that can't be read fails the batch
            prev = (sp.read.parquet(ledger).filter(F.col("batch") < batch_id)
                    .agg(F.max(F.col("first_pos") + F.col("rows"))).first()[0])
        start = 0 if prev is None else int(prev)
        if not dedupe_horizon:
            batch = batch.dropDuplicates(["id"])
            if path_exists(sp, known):
                own = [r["bucket"] for r in batch.select(bucket).distinct().collect()]  # at most BUCKETS
                # a replayed batch doesn't meet its own ids
                old = sp.read.schema("id string, batch bigint, bucket int").parquet(known).where((F.col("batch") < batch_id) & F.col("bucket").isin(own))
                batch = batch.join(old.select("id"), "id", "left_anti")
        vec = cut_lineage(embed(batch, factory, dim=dim, on_error="null").select("id", "vector"))
        numbered = dense_id(vec, "id", name="__o")
        (numbered.select((F.col("__o") + F.lit(start)).alias("pos"), "id", "vector")
         .write.mode("overwrite").parquet(f"{out_root}/batch={batch_id}"))
        if not dedupe_horizon:
            vec.select("id", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{known}/batch={batch_id}")
        rows = vec.count()
        (sp.createDataFrame([(start, rows)], "first_pos long, rows long")
         .write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}"))

    w = coll.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
