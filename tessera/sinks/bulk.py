"""Bulk NDJSON export.

Each row becomes two adjacent lines — ``{"index":{"_index":…,"_id":…}}`` and the document
``{"text":…,"vector":[…],<other columns>}`` — produced by ``explode`` inside the row, so the
pair can never be separated by partitioning.  Non-ASCII text is written as is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CountMismatch(ValueError):
    pass


def attachment_report(docs: DataFrame, vectors: DataFrame, on: str = "id") -> DataFrame:
    """``(id, n_docs, n_vectors, problem)`` of every id that isn't in both inputs exactly once:
    ``missing vector``, ``missing document`` or ``duplicate``.  Each input is counted by id first
    (combinable, ids only), so neither texts nor vectors are moved."""
    def counts(df, name):
        return df.groupBy(F.col(on).alias("__on")).agg(F.count(F.lit(1)).alias(name))

    d, v = counts(docs, "n_docs"), counts(vectors, "n_vectors")
    n_docs, n_vectors = F.coalesce("n_docs", F.lit(0)), F.coalesce("n_vectors", F.lit(0))
    problem = (F.when(n_vectors == 0, "missing vector").when(n_docs == 0, "missing document")
               .when((n_docs > 1) | (n_vectors > 1), "duplicate"))
    return (d.join(v, d["__on"].eqNullSafe(v["__on"]), "full_outer")
            .select(F.coalesce(d["__on"], v["__on"]).alias(on), n_docs.alias("n_docs"), n_vectors.alias("n_vectors"), problem.alias("problem"))
            .where("problem is not null"))


def attach_vectors(docs: DataFrame, vectors: DataFrame, on: str = "id",
                   on_missing: str = "error", vector_col: str = "vector") -> DataFrame:
    """Document k with vector k, keyed by id (never by position).

    ``on_missing='error'`` raises unless every id stands once in either input (see
    :func:`attachment_report`); ``'drop'`` joins what there is."""
    v = vectors.select(F.col(on), F.col(vector_col).alias("vector"))
    if on_missing not in ("error", "drop"):
        raise ValueError("on_missing must be 'error' or 'drop'")
    if on_missing == "error":
        c = attachment_report(docs, v, on).agg(
            F.count(F.lit(1)).alias("ids"), *[F.count_if(F.col("problem") == p).alias(p) for p in ("missing vector", "missing document", "duplicate")]
        ).first()
        if c["ids"]:
            raise CountMismatch(f"Documents and vectors don't pair up: {c['missing vector']} ids without a vector, "
                                f"{c['missing document']} without a document, {c['duplicate']} given more than once")
    return docs.join(v, on, "inner")


def format_action(id_col: Column, index_name: str) -> Column:
    """The action line."""
    return F.to_json(F.struct(F.struct(F.lit(index_name).alias("_index"), id_col.alias("_id")).alias("index")))


def format_document(df: DataFrame, id_col: str = "id", text_col: str = "text",
                    vector_col: str = "vector") -> Column:
    """``text``, ``vector``, then every other non-id column (metadata keys overwrite)."""
    others = [c for c in df.columns if c not in (id_col, text_col, vector_col) and not c.startswith("__")]
    return F.to_json(F.struct(F.col(text_col).alias("text"),
                              F.col(vector_col).cast("array<double>").alias("vector"),
                              *[F.col(c) for c in others]))


def bulk_lines(df: DataFrame, index_name: str, id_col: str = "id", text_col: str = "text",
               vector_col: str = "vector") -> DataFrame:
    action = format_action(F.col(id_col).cast("string"), index_name)
    doc = format_document(df, id_col, text_col, vector_col)
    return df.select(F.explode(F.array(action, doc)).alias("value"))


def write_bulk_ndjson(df: DataFrame, path: str, index_name: str, order_by: list[str] | str | None = None,
                      id_col: str = "id", text_col: str = "text", vector_col: str = "vector",
                      mode: str = "errorifexists") -> str:
    """K5 (and K6, identical output).  With ``order_by`` the files follow that order
    (range-partitioned, sorted), otherwise the input partitioning is kept."""
    src = df
    if order_by:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        src = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    bulk_lines(src, index_name, id_col, text_col, vector_col).write.mode(mode).text(path)
    return path


write_ndjson = write_bulk_ndjson
