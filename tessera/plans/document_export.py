"""Pages -> chunks -> expansion -> tokens -> embeddings -> bulk file, with run statistics.

Each stage's output is materialised once (reliable checkpoint) because two later branches
read it (token statistics and embedding; the count check and the export), which also gives a
wall time per stage.  The result is one run-statistics row (M15) that the rate and
stage-breakdown operators (A14, A15) consume.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import chunk_rows
from ..operators.embed import embed
from ..operators.expand import expand_documents
from ..operators.metrics import token_summary
from ..session import cut_lineage
from ..sinks.bulk import attach_vectors, write_bulk_ndjson
from ..sources.pages import assemble_pages

RUN_SCHEMA = ("total_documents long, total_vectors long, total_time_seconds double, pdf_extraction_time double, "
              "expansion_time double, token_count_time double, vectorization_time double, export_time double, "
              "total_tokens long")


def export_documents(spark: SparkSession, pages: DataFrame, out_path: str, factory, dim: int, *,
                     target_count: int = 100_000, target_factor: float | None = None, strategy: str = "repeat", index_name: str = "pdf_vectors",
                     token_mode: str = "chars", latin_sentences: bool = False, batch_size: int = 128,
                     run_id: str = "run") -> DataFrame:
    """``pages`` is ``(source_file, page_no, page_text)``; returns the run-statistics row.
    ``target_factor`` sets the target as a multiple of the number of chunks."""
    t0 = time.time()
    chunks = cut_lineage(chunk_rows(assemble_pages(pages), latin_sentences=latin_sentences))
    t1 = time.time()
    if target_factor is not None:
        target_count = int(chunks.count() * target_factor)
    expanded = expand_documents(chunks, target_count, ["source_file", "chunk_id"], strategy=strategy, materialize=False)
    expanded = cut_lineage(expanded)
    n_docs = expanded.count()
    t2 = time.time()
    tok = token_summary(expanded, "text", mode=token_mode).first()
    t3 = time.time()
    vectors = cut_lineage(embed(expanded, factory, dim=dim, batch_size=batch_size, on_error="fail")
                          .select("id", "vector"))
    n_vec = vectors.count()
    t4 = time.time()
    joined = attach_vectors(expanded, vectors, on="id", on_missing="error")
    write_bulk_ndjson(joined, out_path, index_name, order_by=["source_file", "chunk_id", "repeat_id"])
    t5 = time.time()
    row = (int(n_docs), int(n_vec), t5 - t0, t1 - t0, t2 - t1, t3 - t2, t4 - t3, t5 - t4, int(tok["total_tokens"]))
    return spark.createDataFrame([row], RUN_SCHEMA).select(F.lit(run_id).alias("run_id"), "*")
