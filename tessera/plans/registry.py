"""Registered queries over the given tables, each with its DuckDB formulation.

Every query reads whole tables (or data Spark derives from them); nothing is capped,
sampled or subset to keep the check cheap.  A limit appears only where it is the operator
(top-k search, exact-k sampling, head/preview).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _dealt(df):
    """Rows dealt out over all shuffle partitions in front of a costly expression, for every size: a
    file may be one row group, which one task reads."""
    from ..operators.bounded import spread
    return spread(df, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _tasks(spark) -> int:
    """Tasks that share the corpus of a search: one per core, as each brings its own list per query."""
    return spark.sparkContext.defaultParallelism


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# ---------------------------------------------------------------------------- search

_KNN_SQL = """
SELECT qid, id, score, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS qid, c.vec_id AS id,
         round(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY
            round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) DESC,
            c.vec_id) AS rnk
  FROM embeddings q, embeddings c {where}
) WHERE rnk <= 10
"""


@query("knn_exact_top10", _KNN_SQL.format(where=""))
def knn_exact_top10(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.knn_exact(v.select(F.col("id").alias("qid"), "vector"), v, 10, partitions=_tasks(spark))


# ------------------------------------------------------------------ DuckDB helpers
# the strip class of Python's str.strip() written for RE2
_W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+\\z', '', 'g')"


def d_flatten(x: str) -> str:
    return d_strip(f"translate({x}, chr(10)||chr(9), '  ')")


def d_clean(x: str) -> str:
    collapsed = f"regexp_replace({x}, '{_W}+', ' ', 'g')"
    kept = f"regexp_replace({collapsed}, '[^一-龥a-zA-Z0-9 ，。！？；：、\"（）【】《》]', '', 'g')"
    return d_strip(kept)


def d_pieces(arr: str) -> str:
    return f"list_filter(list_transform({arr}, lambda x: {d_strip('x')}), lambda x: x <> '')"


def d_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def d_chunks(source_sql: str, key: str, text: str, cs: int = 512, mn: int = 10, mx: int = 512) -> str:
    """Chunk rows via a recursive CTE carrying (item index, current chunk) per document.
    ``source_sql`` yields columns ``{key}`` and ``{text}`` (already cleaned)."""
    sent = d_pieces("regexp_split_to_array(p, '[。！？\\n]')")
    return f"""
WITH RECURSIVE
src AS ({source_sql}),
paras AS (SELECT {key} AS k, {d_pieces(f"string_split({text}, chr(10)||chr(10))")} AS ps FROM src),
items0 AS (SELECT k, flatten(list_transform(ps, lambda p: CASE WHEN length(p) > {cs}
           THEN list_concat([{{'s': '', 't': 1}}], list_transform({sent}, lambda x: {{'s': x, 't': 2}}))
           ELSE [{{'s': p, 't': 0}}] END)) AS its FROM paras),
items AS (SELECT k, unnest(range(1, len(its) + 1)) AS i, unnest(its) AS it FROM items0),
rec(k, i, cur, emit) AS (
  SELECT k, 0, '', NULL::VARCHAR FROM items0
  UNION ALL
  SELECT r.k, r.i + 1,
    CASE WHEN m.it.t = 1 THEN ''
         WHEN length(r.cur) + length(m.it.s) + 1 <= {cs}
           THEN CASE WHEN r.cur = '' THEN m.it.s
                     ELSE r.cur || CASE WHEN m.it.t = 0 THEN chr(10) ELSE ' ' END || m.it.s END
         ELSE m.it.s END,
    CASE WHEN (m.it.t = 1 OR length(r.cur) + length(m.it.s) + 1 > {cs})
              AND r.cur <> '' AND length(r.cur) >= {mn} THEN substring(r.cur, 1, {mx}) END
  FROM rec r JOIN items m ON m.k = r.k AND m.i = r.i + 1
),
lastpos AS (SELECT k, len(its) AS n FROM items0),
emits AS (
  SELECT k, i, emit AS text FROM rec WHERE emit IS NOT NULL
  UNION ALL
  SELECT r.k, r.i + 1, substring(r.cur, 1, {mx}) FROM rec r JOIN lastpos l ON r.k = l.k AND r.i = l.n
  WHERE r.cur <> '' AND length(r.cur) >= {mn}
)
SELECT k, text, row_number() OVER (PARTITION BY k ORDER BY i) AS chunk_no FROM emits"""


# ---------------------------------------------------------------- text functions

@query("flatten_text", f"""
SELECT doc_id, {d_flatten('text')} AS flat_text,
       CAST(length({d_flatten('text')}) AS BIGINT) AS flat_chars,
       CASE WHEN length({d_flatten('text')}) > 80 THEN substring({d_flatten('text')}, 1, 80) || '...'
            ELSE {d_flatten('text')} END AS preview
FROM documents""")
def q_flatten_text(spark, sf_dir):
    from ..functions import text as tx
    d = read_table(spark, sf_dir, "documents")
    flat = tx.flatten_text("text")
    return d.select("doc_id", flat.alias("flat_text"), tx.char_length(flat).alias("flat_chars"),
                    tx.preview(flat, 80).alias("preview"))


@query("clean_text", f"SELECT doc_id, {d_clean('text')} AS cleaned FROM documents")
def q_clean_text(spark, sf_dir):
    from ..functions import text as tx
    return _dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.clean_text("text").alias("cleaned"))


@query("split_counts", f"""
SELECT doc_id,
  CAST(len({d_pieces("string_split(text, chr(10)||chr(10))")}) AS INTEGER) AS paragraphs,
  CAST(len({d_pieces("regexp_split_to_array(translate(text, '.!?', '。！？'), '[。！？\\n]')")}) AS INTEGER) AS sentences,
  CAST(len({d_tokens('text')}) AS BIGINT) AS words,
  CAST(length(text) AS BIGINT) AS chars
FROM documents""")
def q_split_counts(spark, sf_dir):
    from ..functions import text as tx
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tx.split_paragraphs("text")).alias("paragraphs"),
                    F.size(tx.split_sentences(tx.sentence_marks_to_cjk(F.col("text")))).alias("sentences"),
                    tx.token_count("text", "words").alias("words"),
                    tx.token_count("text", "chars").alias("chars"))


# ------------------------------------------------------------------------- corpus

_CORPUS_SQL = f"""
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS IDTYPE) AS id, t AS text FROM (
  SELECT doc_id, {d_flatten("coalesce(text, 'None')")} AS t FROM documents)
WHERE length(t) BETWEEN 10 AND 512"""


@query("convert_parquet_corpus", _CORPUS_SQL.replace("IDTYPE", "VARCHAR"))
def q_convert_parquet_corpus(spark, sf_dir):
    """S4 -> P1 -> F1 -> O1 -> K1 (TSV written to the checkpoint folder) -> S1 read back."""
    from ..session import scratch_path
    from ..sinks.corpus import write_collection
    from ..sources import corpus
    accepted = corpus.read_parquet_text(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    path = write_collection(accepted, scratch_path(spark, "collection"), "doc_id")
    return corpus.read_collection(spark, path)


@query("convert_json_corpus", _CORPUS_SQL.replace("IDTYPE", "BIGINT"))
def q_convert_json_corpus(spark, sf_dir):
    """JSON lines written from the table, read back by S3, numbered in line order (O1)."""
    from ..operators.ordinals import dense_id
    from ..session import scratch_path
    from ..sources import corpus
    path = scratch_path(spark, "jsonl")
    (read_table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .select(F.to_json(F.struct("text")).alias("value")).write.text(path))
    texts = corpus.read_json_text(corpus.read_lines(spark, path))
    return dense_id(texts, corpus.LINE_ORDER, name="id", bucket_prefix=2).select("id", "text")


@query("corpus_head_100", f"""
SELECT doc_id, t AS text FROM (SELECT doc_id, {d_flatten('text')} AS t FROM documents)
WHERE length(t) BETWEEN 10 AND 512 ORDER BY doc_id LIMIT 100""")
def q_corpus_head(spark, sf_dir):
    """S5 (text under ``content`` only) + X2/X4: first 100 accepted rows."""
    from ..operators.sample import load_head
    from ..sources import corpus
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return load_head(corpus.read_text_with_fallback(d, "text"), 100, "doc_id").select("doc_id", "text")


def _collection(spark, sf_dir):
    from ..sources import corpus
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return corpus.read_parquet_text(d)


@query("sample_documents", f"""
SELECT id, text FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {d_flatten('text')} AS text FROM documents)
WHERE length(text) BETWEEN 10 AND 512 ORDER BY md5(id || ':42'), id LIMIT 100""")
def q_sample_documents(spark, sf_dir):
    from ..operators.sample import sample_documents
    return sample_documents(_collection(spark, sf_dir), 100, seed=42)


@query("sample_half", f"""
WITH c AS (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {d_flatten('text')} AS text FROM documents)
           WHERE length(text) BETWEEN 10 AND 512)
SELECT id, text FROM (SELECT *, row_number() OVER (ORDER BY md5(id || ':7'), id) AS rn FROM c)
WHERE rn <= (SELECT count(*) // 2 FROM c)""")
def q_sample_half(spark, sf_dir):
    """X3 with a k that grows with the corpus."""
    from ..operators.sample import sample_documents
    coll = _collection(spark, sf_dir)
    return sample_documents(coll, coll.count() // 2, seed=7)


def _raw_lines(spark, sf_dir):
    """The table written as a raw TSV keyed by ``source``: embedded newlines make extra lines."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.concat_ws("\t", "source", "text"), "\n"))
                    .alias("pos", "value"))


_RAW_LINES_SQL = """SELECT doc_id, unnest(range(0, len(string_split(source || chr(9) || text, chr(10))))) AS pos,
  unnest(string_split(source || chr(9) || text, chr(10))) AS value FROM documents"""


def _d_classify(v: str) -> str:
    s = d_strip(v)
    return (f"CASE WHEN {s} = '' THEN 'blank' WHEN len(string_split({s}, chr(9))) <> 2 THEN 'malformed' "
            f"ELSE 'valid' END")


@query("validate_collection", f"""
WITH l AS ({_RAW_LINES_SQL}),
c AS (SELECT {_d_classify('value')} AS kind, string_split({d_strip('value')}, chr(9)) AS p FROM l)
SELECT count(*) AS total_lines, CAST(count_if(kind = 'valid') AS BIGINT) AS valid_lines,
  CAST(count_if(kind = 'blank') AS BIGINT) AS empty_lines,
  CAST(count_if(kind = 'malformed') AS BIGINT) AS malformed_lines,
  count(DISTINCT CASE WHEN kind = 'valid' THEN p[1] END) AS unique_ids,
  round(avg(CASE WHEN kind = 'valid' THEN length(p[2]) END), 6) AS avg_length,
  CAST(min(CASE WHEN kind = 'valid' THEN length(p[2]) END) AS BIGINT) AS min_length,
  CAST(max(CASE WHEN kind = 'valid' THEN length(p[2]) END) AS BIGINT) AS max_length,
  CAST(count_if(kind = 'valid' AND octet_length(encode(p[1])) > 64) AS BIGINT) AS ids_over_64_bytes,
  CAST(count_if(kind = 'valid') - count(DISTINCT CASE WHEN kind = 'valid' THEN p[1] END) AS BIGINT) AS duplicate_ids,
  count_if(kind = 'malformed') = 0 AND count_if(kind = 'valid') > 0 AS passed
FROM c""")
def q_validate_collection(spark, sf_dir):
    from ..operators.validate import validate_collection
    return validate_collection(_raw_lines(spark, sf_dir))


@query("duplicate_ids", f"""
WITH l AS ({_RAW_LINES_SQL}),
c AS (SELECT doc_id, pos, {_d_classify('value')} AS kind, string_split({d_strip('value')}, chr(9))[1] AS id FROM l)
SELECT id, doc_id, pos, occurrence FROM (
  SELECT id, doc_id, pos, row_number() OVER (PARTITION BY id ORDER BY doc_id, pos) AS occurrence
  FROM c WHERE kind = 'valid') WHERE occurrence > 1""")
def q_duplicate_ids(spark, sf_dir):
    from ..operators.validate import duplicate_id_lines
    dup = duplicate_id_lines(_raw_lines(spark, sf_dir), ["doc_id", "pos"])
    return dup.select("id", "doc_id", F.col("pos").cast("bigint").alias("pos"),
                      F.col("occurrence").cast("bigint").alias("occurrence"))


@query("first_malformed_lines", f"""
WITH l AS ({_RAW_LINES_SQL}),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS line_no FROM l)
SELECT line_no, CASE WHEN length(value) > 60 THEN substring(value, 1, 60) || '...' ELSE value END AS preview
FROM n WHERE {_d_classify('value')} = 'malformed' ORDER BY line_no LIMIT 5""")
def q_first_malformed(spark, sf_dir):
    from ..functions.text import preview
    from ..operators.validate import numbered_errors
    found = numbered_errors(_raw_lines(spark, sf_dir), ["doc_id", "pos"], 5)
    return found.select("line_no", preview("value", 60).alias("preview"))


@query("head_preview", f"""
SELECT id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS preview FROM (
  SELECT CAST(doc_id AS VARCHAR) AS id, {d_flatten('text')} AS text, doc_id FROM documents)
WHERE length(text) BETWEEN 10 AND 512 ORDER BY doc_id LIMIT 3""")
def q_head_preview(spark, sf_dir):
    from ..operators.validate import head_preview
    c = _collection(spark, sf_dir).withColumn("__k", F.col("id").cast("bigint"))
    return head_preview(c, ["__k"], 3, 80)


# ----------------------------------------------------------------------- chunking

_LATIN_TO_CJK = "translate(text, '.!?', '。！？')"
_DOC_CHUNK_SRC = f"SELECT doc_id, {d_clean(_LATIN_TO_CJK)} AS t FROM documents"


@query("chunk_documents", f"""
SELECT 'doc_' || k || '_chunk_' || chunk_no AS id, text, 'doc_' || k AS source_file,
       CAST(chunk_no AS INTEGER) AS chunk_id
FROM ({d_chunks(_DOC_CHUNK_SRC, 'doc_id', 't')})""")
def q_chunk_documents(spark, sf_dir):
    from ..operators.chunk import chunk_rows
    d = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), "text")
    return chunk_rows(_dealt(d), latin_sentences=True)


_CONV_SRC = f"""SELECT conv_id, {d_clean("translate(string_agg(text || chr(10) || chr(10), '' ORDER BY turn), '.!?', '。！？')")} AS t
FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id"""


@query("assemble_and_chunk_pages", f"""
SELECT 'conv_' || k || '_chunk_' || chunk_no AS id, text, 'conv_' || k || '.pdf' AS source_file,
       CAST(chunk_no AS INTEGER) AS chunk_id
FROM ({d_chunks(_CONV_SRC, 'conv_id', 't')})""")
def q_assemble_pages(spark, sf_dir):
    """S7 over the conversation turns as pages, then P3/P7/P8."""
    from ..operators.chunk import chunk_rows
    from ..sources.pages import assemble_pages
    c = read_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("source_file"),
        F.col("turn").alias("page_no"), F.col("text").alias("page_text"))
    return chunk_rows(assemble_pages(c), latin_sentences=True)


# ----------------------------------------------------------------------- expansion

@query("expand_chunks_fuzzy", f"""
WITH ch AS (SELECT k AS doc_id, 'doc_' || k || '_chunk_' || chunk_no AS id, text, 'doc_' || k AS source_file,
                   CAST(chunk_no AS INTEGER) AS chunk_id FROM ({d_chunks(_DOC_CHUNK_SRC, 'doc_id', 't')})),
n AS (SELECT count(*) AS n, (5 * count(*)) // 2 AS target, CAST(ceil(((5 * count(*)) // 2) / count(*)) AS BIGINT) AS f FROM ch),
o AS (SELECT ch.*, row_number() OVER (ORDER BY doc_id, chunk_id) AS rn FROM ch),
copies AS (
  SELECT o.*, unnest(range(0, n.f - 1)) AS rep FROM o, n
  UNION ALL
  SELECT o.*, n.f - 1 AS rep FROM o, n WHERE o.rn <= n.target - n.n * (n.f - 1))
SELECT id || '_fuzzy_' || rep AS id, '[副本' || (rep + 1) || '] ' || text AS text, source_file, chunk_id,
       CAST(rep AS INTEGER) AS repeat_id
FROM copies""")
def q_expand_chunks(spark, sf_dir):
    """P7/P8 chunks expanded to five halves of their number with the fuzzy strategy."""
    from ..session import cut_lineage
    from ..operators.chunk import chunk_rows
    from ..operators.expand import expand_documents
    d = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), "text", "doc_id")
    ch = cut_lineage(chunk_rows(_dealt(d), latin_sentences=True, keep=["doc_id"]))
    return (expand_documents(ch, 5 * ch.count() // 2, ["doc_id", "chunk_id"], strategy="fuzzy", materialize=False)
            .select("id", "text", "source_file", "chunk_id", "repeat_id"))


# ---------------------------------------------------------------------- vector store

def _store_with_overwrite(spark, sf_dir):
    """K2 create, K3 write all, K3 overwrite the upper half with negated vectors."""
    from ..session import scratch_path
    from ..sinks.store import create_store, write_batch
    from ..sources.store import read_store
    root = scratch_path(spark, "store")
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"),
                                                       F.col("embedding").alias("vector"), "vec_id")
    create_store(spark, root, total_vectors=None, vector_dim=64, metadata={"model_name": "given-embeddings"})
    write_batch(spark, root, v, start_idx=0, order_by="vec_id")
    stored = read_store(spark, root)
    half = stored.count() // 2
    upper = stored.filter(F.col("pos") >= half).select(
        "id", "pos", F.transform("vector", lambda x: -x).alias("vector"))
    write_batch(spark, root, upper, start_idx=half, order_by="pos")
    return root, half


_STORE_SQL = """
WITH s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, CAST(vec_id AS VARCHAR) AS id, embedding
           FROM embeddings), h AS (SELECT count(*) // 2 AS h FROM embeddings)
SELECT pos, id, CAST(len(embedding) AS INTEGER) AS dims,
  CASE WHEN pos >= h.h THEN -round(list_sum(embedding::DOUBLE[]), 6) ELSE round(list_sum(embedding::DOUBLE[]), 6) END
  AS vector_sum
FROM s, h"""


@query("vector_store_roundtrip", _STORE_SQL)
def q_vector_store_roundtrip(spark, sf_dir):
    from ..sources.store import read_ids, read_vectors
    root, _ = _store_with_overwrite(spark, sf_dir)
    vec = read_vectors(spark, root)
    ids = read_ids(spark, root)
    return vec.join(ids, "pos").select(
        "pos", "id", F.size("vector").cast("int").alias("dims"),
        F.round(F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 6)
        .alias("vector_sum"))


@query("vector_store_slice", """
WITH s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, CAST(vec_id AS VARCHAR) AS id FROM embeddings),
n AS (SELECT count(*) AS n FROM embeddings)
SELECT pos, id FROM s, n WHERE pos >= n.n // 4 AND pos < 3 * n.n // 4""")
def q_vector_store_slice(spark, sf_dir):
    """Ids of the position slice [N/4, 3N/4)."""
    from ..sources.store import read_ids
    root, half = _store_with_overwrite(spark, sf_dir)
    n = half * 2 + (1 if read_ids(spark, root).count() % 2 else 0)
    return read_ids(spark, root, n // 4, 3 * n // 4)


@query("vector_store_info", """
SELECT count(*) AS total_vectors, count(*) AS stored_vectors, CAST(max(len(embedding)) AS INTEGER) AS vector_dim,
  'float32' AS dtype, 'given-embeddings' AS model_name, 2 AS version, true AS has_bytes,
  round(count(*) * max(len(embedding)) * 4 / 1024.0 / 1024.0 * 0.7, 6) AS estimated_mb
FROM embeddings""")
def q_vector_store_info(spark, sf_dir):
    """S11/S12 and the P16 estimate for the same shape."""
    from ..sinks.store import estimate_store_size
    from ..sources.store import store_info
    root, _ = _store_with_overwrite(spark, sf_dir)
    info = store_info(spark, root)
    return info.select("total_vectors", "stored_vectors", "vector_dim", "dtype", "model_name", "version",
                       (F.col("size_mb") > 0).alias("has_bytes"),
                       F.round(estimate_store_size("stored_vectors", "vector_dim", "float32"), 6)
                       .alias("estimated_mb"))


# ------------------------------------------------------------------------ embedding

def d_cells(source_sql: str, key: str, text: str, dim: int = 64) -> str:
    return f"""
WITH src AS ({source_sql}),
t AS (SELECT {key} AS k, unnest({d_tokens(text)}) AS tok FROM src),
c AS (SELECT k, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS INTEGER) AS bucket,
             CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER < 8 THEN 1 ELSE -1 END AS s FROM t),
w AS (SELECT k, bucket, sum(s) AS w FROM c GROUP BY k, bucket HAVING sum(s) <> 0)
SELECT k, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS value FROM w"""


@query("hash_embed_cells", f"""
SELECT k AS doc_id, bucket, round(value, 6) AS value
FROM ({d_cells('SELECT doc_id, text FROM documents', 'doc_id', 'text')})""")
def q_hash_embed_cells(spark, sf_dir):
    from ..operators.embed import hash_embed_cells
    d = _dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    cells = hash_embed_cells(d, 64, id_col="doc_id")
    return cells.select("doc_id", "bucket", F.round("value", 6).alias("value"))


def _vec_summary(vec):
    return [F.size(F.filter(vec, lambda x: x != 0)).cast("bigint").alias("nonzero"),
            F.round(F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"),
                                       lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm")]


_EMBED_SQL = """
WITH cells AS ({cells})
SELECT d.doc_id, CAST(count(c.bucket) AS BIGINT) AS nonzero, round(coalesce(sqrt(sum(c.value * c.value)), 0), 4) AS norm
  {extra}
FROM documents d LEFT JOIN cells c ON c.k = d.doc_id GROUP BY d.doc_id {group}"""


@query("embed_documents", _EMBED_SQL.format(
    cells=d_cells("SELECT doc_id, text FROM documents", "doc_id", "text"), extra="", group=""))
def q_embed_documents(spark, sf_dir):
    """The built-in hash embedder run through mapInPandas over Arrow batches."""
    from ..operators.embed import embed, hash_embedder_factory
    d = _dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    v = embed(d, hash_embedder_factory(64), id_col="doc_id", dim=64)
    return v.select("doc_id", *_vec_summary(F.col("vector")))


_TEMPLATE = "Represent this sentence for searching relevant passages: {text}"
_TPL_HEAD = _TEMPLATE.split("{text}")[0]


@query("embed_with_instruction", _EMBED_SQL.format(
    cells=d_cells(f"SELECT doc_id, '{_TPL_HEAD}' || text AS text FROM documents", "doc_id", "text"),
    extra=f", CAST(length('{_TPL_HEAD}' || any_value(d.text)) AS BIGINT) AS wrapped_chars", group=""))
def q_embed_with_instruction(spark, sf_dir):
    """P9 wrapping, then E1."""
    from ..functions.text import wrap_instruction
    from ..operators.embed import embed_with_instruction, hash_embedder_factory
    d = _dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn(
        "wrapped_chars", F.length(wrap_instruction("text", _TEMPLATE)).cast("bigint"))
    v = embed_with_instruction(d, hash_embedder_factory(64), _TEMPLATE, id_col="doc_id", dim=64,
                               keep=["wrapped_chars"])
    return v.select("doc_id", *_vec_summary(F.col("vector")), "wrapped_chars")


@query("generate_and_store")
def q_generate_and_store(spark, sf_dir):
    """S4 -> X3 (half of them) -> E1 -> K2/K3; run statistics."""
    from ..operators.embed import generate_and_store, hash_embedder_factory
    from ..operators.sample import sample_documents
    from ..session import scratch_path
    coll = _collection(spark, sf_dir)
    sampled = sample_documents(coll, coll.count() // 2, seed=42).withColumn("__k", F.col("id").cast("bigint"))
    return generate_and_store(sampled, hash_embedder_factory(64), scratch_path(spark, "e4store"),
                              order_by="__k", dim=64)


# ----------------------------------------------------------------------------- bulk


@query("attachment_report", """
WITH d AS (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 17 = 4),
v AS (SELECT vec_id AS id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 23 = 9),
c AS (SELECT coalesce(d.id, v.id) AS id, coalesce(nd, 0) AS n_docs, coalesce(nv, 0) AS n_vectors
      FROM (SELECT id, count(*) AS nd FROM d GROUP BY id) d FULL JOIN (SELECT id, count(*) AS nv FROM v GROUP BY id) v ON d.id = v.id)
SELECT *, CASE WHEN n_vectors = 0 THEN 'missing vector' WHEN n_docs = 0 THEN 'missing document' ELSE 'duplicate' END AS problem
FROM c WHERE n_docs <> 1 OR n_vectors <> 1""")
def q_attachment_report(spark, sf_dir):
    """J1's report: documents and vectors of equal ids, with some rows given twice."""
    from ..sinks.bulk import attachment_report
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return attachment_report(d.unionByName(d.where("id % 17 = 4")), v.unionByName(v.where("id % 23 = 9")))


_BULK_DOC_SCHEMA = "text string, vector array<double>, source_file string, lang string"


def _bulk_roundtrip(spark, sf_dir):
    from ..operators.embed import embed, hash_embedder_factory
    from ..session import cut_lineage, scratch_path
    from ..sinks.bulk import attach_vectors, write_bulk_ndjson
    from ..sources.bulk import read_bulk_ndjson
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("source_file"), "lang",
        F.col("doc_id").alias("__k"))
    # written once: the check of J1 and the export both read the vectors
    vecs = cut_lineage(embed(_dealt(docs.select("id", "text")), hash_embedder_factory(64), dim=64).select("id", "vector"))
    joined = attach_vectors(docs, vecs, on="id", on_missing="error")
    path = write_bulk_ndjson(joined, scratch_path(spark, "bulk"), "pdf_vectors", order_by="__k")
    return read_bulk_ndjson(spark, path, _BULK_DOC_SCHEMA)


@query("bulk_export_roundtrip", f"""
WITH cells AS ({d_cells("SELECT doc_id, text FROM documents", "doc_id", "text")})
SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS pos, 'pdf_vectors' AS _index, CAST(d.doc_id AS VARCHAR) AS _id,
  any_value(d.text) AS text, any_value(d.source) AS source_file, any_value(d.lang) AS lang,
  CAST(64 AS INTEGER) AS dims, CAST(count(c.bucket) AS BIGINT) AS nonzero
FROM documents d LEFT JOIN cells c ON c.k = d.doc_id GROUP BY d.doc_id""")
def q_bulk_export_roundtrip(spark, sf_dir):
    """J1 -> K5 -> S13: documents with hash vectors through a bulk file and back."""
    b = _bulk_roundtrip(spark, sf_dir)
    return b.select("pos", "_index", "_id", F.col("doc.text").alias("text"),
                    F.col("doc.source_file").alias("source_file"), F.col("doc.lang").alias("lang"),
                    F.size("doc.vector").cast("int").alias("dims"),
                    F.size(F.filter("doc.vector", lambda x: x != 0)).cast("bigint").alias("nonzero"))


@query("bulk_import_summary", f"""
WITH cells AS ({d_cells("SELECT doc_id, text FROM documents", "doc_id", "text")}),
nz AS (SELECT d.doc_id, count(c.bucket) AS nonzero FROM documents d LEFT JOIN cells c ON c.k = d.doc_id
       GROUP BY d.doc_id),
p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, nonzero FROM nz)
SELECT CAST(pos // 500 AS BIGINT) AS batch_no, CAST(count(*) AS BIGINT) AS indexed,
       CAST(count_if(nonzero = 0) AS BIGINT) AS errors
FROM p GROUP BY ROLLUP (pos // 500)""")
def q_bulk_import_summary(spark, sf_dir):
    """K9 + O5: per 500-item request, items and rejected zero vectors (cosine needs a norm)."""
    from ..sources.bulk import bulk_import_summary
    b = _bulk_roundtrip(spark, sf_dir)
    items = b.select("pos", F.when(F.size(F.filter("doc.vector", lambda x: x != 0)) == 0,
                                   F.lit("zero_vector")).alias("error"))
    return bulk_import_summary(items, 500)


# -------------------------------------------------------- metrics over a request log
# ``events`` as a request log: model = event_type, batch size from props.k, latency = value ms,
# a call over 350 ms counts as failed (timeout).

def _requests(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_type").alias("model"), F.call_function("shiftleft", F.lit(16), k % 6).alias("batch_size"),
                    (F.col("value") / 1000).alias("latency_s"), (F.col("value") <= 350).alias("ok"),
                    "ts", "user_id", "event_id", k.alias("k"), "value", "props", "event_type")


_REQ = ("SELECT event_type AS model, 16 << (CAST(json_extract(props, '$.k') AS INTEGER) % 6) AS batch_size, "
        "value / 1000 AS latency_s, value <= 350 AS ok, ts, user_id, event_id, "
        "CAST(json_extract(props, '$.k') AS INTEGER) AS k, value, props, event_type FROM events")


def d_latency(src: str, keys: str) -> str:
    x = "latency_s * 1000"
    return f"""SELECT {keys}, count(*) AS samples, round(avg({x}), 6) AS mean_ms, round(stddev_pop({x}), 6) AS std_ms,
  round(min({x}), 6) AS min_ms, round(max({x}), 6) AS max_ms,
  round(quantile_cont({x}, 0.5), 6) AS p50_ms, round(quantile_cont({x}, 0.9), 6) AS p90_ms,
  round(quantile_cont({x}, 0.95), 6) AS p95_ms, round(quantile_cont({x}, 0.99), 6) AS p99_ms
FROM ({src}) WHERE ok GROUP BY {keys}"""


_THR = f"""SELECT model, batch_size, CAST(count_if(ok) AS BIGINT) AS calls_ok,
  CAST(count_if(NOT ok) AS BIGINT) AS calls_failed,
  round(avg(CASE WHEN ok THEN latency_s END), 6) AS avg_latency,
  round(stddev_pop(CASE WHEN ok THEN latency_s END), 6) AS std_latency,
  round(min(CASE WHEN ok THEN latency_s END), 6) AS min_latency,
  round(max(CASE WHEN ok THEN latency_s END), 6) AS max_latency,
  round(batch_size / avg(CASE WHEN ok THEN latency_s END), 6) AS throughput
FROM ({_REQ}) GROUP BY model, batch_size"""

_OPT = f"""SELECT model, first(batch_size ORDER BY throughput DESC, batch_size) AS optimal_batch_size,
  max(throughput) AS optimal_throughput FROM ({_THR}) WHERE throughput IS NOT NULL GROUP BY model"""


@query("latency_summary", d_latency(_REQ, "model"))
def q_latency_summary(spark, sf_dir):
    from ..operators.metrics import latency_summary
    return latency_summary(_requests(spark, sf_dir), ["model"])


@query("throughput_summary", _THR)
def q_throughput_summary(spark, sf_dir):
    from ..operators.metrics import throughput_summary
    return throughput_summary(_requests(spark, sf_dir))


@query("tune_batch_size", f"""
WITH thr AS ({_THR}),
l AS (SELECT *, lag(throughput) OVER (PARTITION BY model ORDER BY batch_size) AS prev FROM thr
      WHERE batch_size BETWEEN 16 AND 1000),
f AS (SELECT *, max(CASE WHEN calls_ok = 0 OR (prev IS NOT NULL AND prev > 0 AND throughput < prev * 0.9)
                    THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY batch_size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM l),
b AS (SELECT model, first(batch_size ORDER BY throughput DESC, batch_size) AS bs, max(throughput) AS t
      FROM f WHERE stop = 0 GROUP BY model)
SELECT m.model, coalesce(b.bs, 16) AS optimal_batch_size, coalesce(b.t, 0.0) AS optimal_throughput
FROM (SELECT DISTINCT model FROM thr) m LEFT JOIN b ON b.model = m.model""")
def q_tune_batch_size(spark, sf_dir):
    """O3 on the doubling ladder from 16 (max 2048, at most 1,000 probe texts)."""
    from ..operators.metrics import throughput_summary, tune_batch_size
    return tune_batch_size(throughput_summary(_requests(spark, sf_dir)), start_size=16, max_size=2048,
                           n_texts=1000)


@query("pick_optimal", _OPT)
def q_pick_optimal(spark, sf_dir):
    from ..operators.metrics import pick_optimal, throughput_summary
    return pick_optimal(throughput_summary(_requests(spark, sf_dir)))


# results document: A3 + A4 + O4 + device peak (A6) + generation totals per model
_GEN = f"""SELECT model, count(*) AS total_vectors, sum(CASE WHEN ok THEN latency_s END) AS generation_seconds,
  count(*) / sum(CASE WHEN ok THEN latency_s END) AS gthr FROM ({_REQ}) GROUP BY model"""
_MODELS = f"""SELECT g.model, row_number() OVER (ORDER BY g.model) - 1 AS ordinal, g.total_vectors, g.generation_seconds,
  g.gthr, l.p99_ms, o.optimal_batch_size, o.optimal_throughput, p.peak_mb
FROM ({_GEN}) g LEFT JOIN ({d_latency(_REQ, "model")}) l ON l.model = g.model
LEFT JOIN ({_OPT}) o ON o.model = g.model
LEFT JOIN (SELECT event_type AS model, max(value) AS peak_mb FROM events GROUP BY event_type) p ON p.model = g.model"""


def _results_models(spark, sf_dir):
    """K7 write + S14 read of the results document built from the request log."""
    from ..operators.metrics import latency_summary, pick_optimal, throughput_summary
    from ..operators.report import model_results, read_results, write_results
    from ..operators.telemetry import peak_memory
    from ..session import scratch_path
    r = _requests(spark, sf_dir)
    thr = throughput_summary(r)
    gen = r.groupBy("model").agg(F.count(F.lit(1)).alias("total_vectors"),
                                 F.sum(F.when(F.col("ok"), F.col("latency_s"))).alias("generation_seconds"))
    peaks = peak_memory(r.select(F.col("model").alias("gpu_id"), F.col("value").alias("memory_used_mb"))) \
        .withColumnRenamed("gpu_id", "model")
    models = model_results(latency_summary(r, ["model"]), thr, pick_optimal(thr), peaks, gen, vector_dim=64)
    path = write_results(models, scratch_path(spark, "results"))
    return read_results(spark, path)


@query("run_summary", f"""
SELECT model AS model_name, round(optimal_throughput, 6) AS throughput, round(p99_ms, 6) AS p99_ms,
  CAST(optimal_batch_size AS INTEGER) AS optimal_batch_size, round(peak_mb, 6) AS peak_memory_mb,
  round(generation_seconds / 3600, 6) AS run_hours, round(100000000.0 / gthr / 3600, 6) AS hours_100m
FROM ({_MODELS})""")
def q_run_summary(spark, sf_dir):
    from ..operators.report import run_summary
    return run_summary(_results_models(spark, sf_dir))


@query("model_leaders", f"""
SELECT first(model ORDER BY generation_seconds, ordinal) AS fastest_model,
  first(model ORDER BY generation_seconds DESC, ordinal) AS slowest_model,
  first(model ORDER BY peak_mb, ordinal) AS lowest_memory_model FROM ({_MODELS})""")
def q_model_leaders(spark, sf_dir):
    from ..operators.report import model_leaders
    return model_leaders(_results_models(spark, sf_dir))


@query("comparison_table", f"""
SELECT model AS model_name, 64 AS vector_dim, CAST(optimal_batch_size AS INTEGER) AS optimal_batch_size,
  round(5000000.0 / gthr / 3600, 6) AS hours_5m, round(10000000.0 / gthr / 3600, 6) AS hours_10m,
  round(50000000.0 / gthr / 3600, 6) AS hours_50m, round(100000000.0 / gthr / 3600, 6) AS hours_100m
FROM ({_MODELS})""")
def q_comparison_table(spark, sf_dir):
    from ..operators.report import comparison_table
    return comparison_table(_results_models(spark, sf_dir))


@query("report_totals", f"""
SELECT count(*) AS models, round(sum(generation_seconds) / 3600, 6) AS total_hours,
  first(total_vectors ORDER BY ordinal) AS total_vectors FROM ({_MODELS})""")
def q_report_totals(spark, sf_dir):
    from ..operators.report import report_totals
    return report_totals(_results_models(spark, sf_dir))


@query("batch_curve", f"SELECT model AS model_name, batch_size, throughput FROM ({_THR})")
def q_batch_curve(spark, sf_dir):
    from ..operators.report import batch_curve
    return batch_curve(_results_models(spark, sf_dir))


@query("extrapolation", f"""
SELECT model, round(gthr, 6) AS generation_throughput, scale, round(scale / gthr, 6) AS seconds,
  round(scale / gthr / 60, 6) AS minutes, round(scale / gthr / 3600, 6) AS hours
FROM ({_GEN}), (SELECT unnest([5000000, 10000000, 50000000, 100000000]::BIGINT[]) AS scale)""")
def q_extrapolation(spark, sf_dir):
    """A16 generation throughput per model x J3 scales."""
    from ..operators.metrics import extrapolate, rate
    r = _requests(spark, sf_dir)
    gen = r.groupBy("model").agg(rate(F.count(F.lit(1)), F.sum(F.when(F.col("ok"), F.col("latency_s"))))
                                 .alias("gthr"))
    e = extrapolate(gen, "gthr")
    return e.select("model", F.round("gthr", 6).alias("generation_throughput"), "scale",
                    F.round("seconds", 6).alias("seconds"), F.round("minutes", 6).alias("minutes"),
                    F.round("hours", 6).alias("hours"))


@query("token_summary", f"""
SELECT role, count(*) AS documents, CAST(coalesce(sum(len({d_tokens('text')})), 0) AS BIGINT) AS total_tokens,
  coalesce(round(CAST(coalesce(sum(len({d_tokens('text')})), 0) AS BIGINT) / count(*), 6), 0.0) AS avg_tokens_per_doc
FROM conversations GROUP BY role""")
def q_token_summary(spark, sf_dir):
    """A5/P12 per conversation role, word tokens."""
    from ..operators.metrics import token_summary
    return token_summary(read_table(spark, sf_dir, "conversations"), "text", ["role"], mode="words")


# run statistics (M15) per day of the log; stages from event types
_STAGE_OF = {"view": "pdf_extraction_time", "click": "expansion_time", "signup": "token_count_time",
             "purchase": "vectorization_time", "error": "export_time"}


def _runs(spark, sf_dir):
    r = _requests(spark, sf_dir)
    stage_cols = [F.coalesce(F.sum(F.when(F.col("event_type") == et, F.col("latency_s"))), F.lit(0.0)).alias(st)
                  for et, st in _STAGE_OF.items()]
    return r.groupBy(F.to_date("ts").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_documents"), F.count_if("ok").alias("total_vectors"),
        F.sum("k").cast("bigint").alias("total_tokens"), F.sum("latency_s").alias("total_time_seconds"),
        *stage_cols)


_RUNS = f"""SELECT CAST(ts AS DATE) AS run_id, count(*) AS total_documents, count_if(ok) AS total_vectors,
  CAST(sum(k) AS BIGINT) AS total_tokens, sum(latency_s) AS total_time_seconds,
  {", ".join(f"coalesce(sum(CASE WHEN event_type = '{et}' THEN latency_s END), 0.0) AS {st}" for et, st in _STAGE_OF.items())}
FROM ({_REQ}) GROUP BY CAST(ts AS DATE)"""


@query("run_rates", f"""
SELECT run_id, round(total_documents / total_time_seconds, 6) AS docs_per_second,
  round(total_vectors / total_time_seconds, 6) AS vectors_per_second,
  round(total_tokens / total_time_seconds, 6) AS tokens_per_second,
  round(total_tokens / vectorization_time, 6) AS token_throughput,
  round(total_tokens / total_documents, 6) AS avg_tokens_per_doc
FROM ({_RUNS})""")
def q_run_rates(spark, sf_dir):
    from ..operators.metrics import run_rates
    return run_rates(_runs(spark, sf_dir))


@query("stage_breakdown", f"""
SELECT run_id, stage, round(seconds, 6) AS seconds, round(seconds / sum(seconds) OVER (PARTITION BY run_id), 6) AS share
FROM (UNPIVOT ({_RUNS}) ON {", ".join(_STAGE_OF.values())} INTO NAME stage VALUE seconds)""")
def q_stage_breakdown(spark, sf_dir):
    from ..operators.metrics import stage_breakdown
    return stage_breakdown(_runs(spark, sf_dir))


# ---------------------------------------------------------------------- telemetry
# ``events`` as device telemetry: device = event_type, reading = value (MB)

def _telemetry(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("gpu_id"), F.col("value").alias("memory_used_mb"))


@query("telemetry_peak", "SELECT event_type AS gpu_id, max(value) AS peak_mb FROM events GROUP BY event_type")
def q_telemetry_peak(spark, sf_dir):
    from ..operators.telemetry import peak_memory
    return peak_memory(_telemetry(spark, sf_dir))


@query("telemetry_average", "SELECT event_type AS gpu_id, round(avg(value), 6) AS avg_mb FROM events GROUP BY event_type")
def q_telemetry_average(spark, sf_dir):
    from ..operators.telemetry import average_memory
    return average_memory(_telemetry(spark, sf_dir))


@query("telemetry_summary", """
SELECT CAST(ts AS DATE) AS run_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS devices,
  count(*) AS snapshots, max(value) AS max_peak_mb,
  round(max(a), 6) AS max_avg_mb
FROM (SELECT ts, event_type, value, avg(value) OVER (PARTITION BY CAST(ts AS DATE), event_type) AS a FROM events)
GROUP BY CAST(ts AS DATE)""")
def q_telemetry_summary(spark, sf_dir):
    """A8 per day (a run per day)."""
    from ..operators.telemetry import telemetry_summary
    t = _telemetry(spark, sf_dir).withColumn("run_id", F.to_date("ts"))
    s = telemetry_summary(t, group_cols=["run_id"])
    return s.select("run_id", F.array_join("devices", ",").alias("devices"), "snapshots", "max_peak_mb", "max_avg_mb")


@query("telemetry_windows", """
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
  event_type AS gpu_id, count(*) AS snapshots, max(value) AS peak_mb, round(avg(value), 6) AS avg_mb
FROM events GROUP BY ALL""")
def q_telemetry_windows(spark, sf_dir):
    """T1 batch form: 6-hour tumbling windows per device."""
    from ..operators.telemetry import telemetry_windows
    return telemetry_windows(_telemetry(spark, sf_dir), window="6 hours")


@query("resource_summary", f"""
SELECT system, metric, count(*) AS samples, round(avg(v), 6) AS avg, max(v) AS max, round(quantile_cont(v, 0.95), 6) AS p95
FROM (SELECT event_type AS system, 'latency_ms' AS metric, value AS v FROM events
      UNION ALL SELECT event_type, 'payload_k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events)
GROUP BY system, metric""")
def q_resource_summary(spark, sf_dir):
    """V12 over a long metrics table built from the log."""
    from ..operators.telemetry import resource_summary
    r = _requests(spark, sf_dir)
    long = r.select(F.col("event_type").alias("system"),
                    F.inline(F.array(F.struct(F.lit("latency_ms").alias("metric"), F.col("value").alias("value")),
                                     F.struct(F.lit("payload_k").alias("metric"), F.col("k").cast("double").alias("value")))))
    return resource_summary(long)


@query("resource_wide", """
SELECT event_type AS system, round(avg(value), 6) AS latency_ms, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS payload_k
FROM events GROUP BY event_type""")
def q_resource_wide(spark, sf_dir):
    """V12 wide form: one column per metric."""
    from ..operators.telemetry import resource_wide
    return resource_wide(q_resource_summary(spark, sf_dir), ["latency_ms", "payload_k"])


@query("telemetry_windows_sliding", """
WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * unnest(range(0, 3)) AS window_start, event_type, value FROM events)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type AS gpu_id, count(*) AS snapshots,
  max(value) AS peak_mb, round(avg(value), 6) AS avg_mb FROM w GROUP BY ALL""")
def q_telemetry_windows_sliding(spark, sf_dir):
    """T1 with overlapping windows: 6 hours, one every 2 hours."""
    from ..operators.telemetry import telemetry_windows
    return telemetry_windows(_telemetry(spark, sf_dir), window="6 hours", slide="2 hours")


@query("telemetry_document", """
SELECT event_type AS gpu_id, count(*) AS snapshots, max(value) AS peak_mb, round(avg(value), 6) AS avg_mb,
  CAST(floor(min(epoch(ts))) AS BIGINT) AS first_second FROM events GROUP BY event_type""")
def q_telemetry_document(spark, sf_dir):
    """K8 and S15, document form: a run per user, each written as one document and read back."""
    from ..operators.telemetry import read_telemetry, write_telemetry_document
    from ..session import scratch_path
    t = read_table(spark, sf_dir, "events").select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"), F.col("event_type").alias("gpu_id"),
        F.col("value").alias("memory_used_mb"), *[F.lit(None).cast("double").alias(c) for c in (
            "memory_total_mb", "memory_percent", "gpu_util_percent", "temperature")], F.col("user_id").alias("run"))
    path = write_telemetry_document(t, scratch_path(spark, "telemetry-documents"), "run")
    return read_telemetry(spark, path, "document").groupBy("gpu_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.max("memory_used_mb").alias("peak_mb"), F.round(F.avg("memory_used_mb"), 6).alias("avg_mb"),
        F.min("timestamp").cast("bigint").alias("first_second"))


@query("corpus_max_samples", f"""
SELECT doc_id, t AS text FROM (SELECT doc_id, {d_flatten("coalesce(text, 'None')")} AS t FROM documents)
WHERE length(t) BETWEEN 10 AND 512 ORDER BY doc_id LIMIT 40""")
def q_corpus_max_samples(spark, sf_dir):
    """The Parquet reader's first 40 accepted texts in file order."""
    from ..session import scratch_path
    from ..sources.corpus import read_corpus
    path = scratch_path(spark, "ordered")
    read_table(spark, sf_dir, "documents").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return read_corpus(spark, path, "parquet", max_samples=40).select("doc_id", "text")


@query("scan_page_files", """
SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages WHERE html IS NOT NULL""")
def q_scan_page_files(spark, sf_dir):
    """Pages written as files of several pages each, listed by both globs and cut into pages
    by an extractor."""
    from ..session import scratch_path
    from ..sources.pages import scan_document_dir
    path = scratch_path(spark, "page-files")
    # a page's line: its id and its text as JSON, so no line break stands inside
    (read_table(spark, sf_dir, "pages").where("html is not null").select(F.to_json(F.struct("page_id", "html")).alias("value"))
     .write.option("maxRecordsPerFile", 1000).text(path))  # a file is read whole, so its size is bounded

    def extract(content: bytes):
        return content.decode().split("\n")[:-1]
    found = scan_document_dir(spark, path, extract, glob="*.{txt,TXT}")
    row = F.from_json("page_text", "page_id bigint, html string")
    return found.select(row.alias("r")).select("r.page_id", F.length("r.html").alias("n_chars"), F.md5("r.html").alias("digest"))


@query("store_paired_write", """
SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS pos, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS weighted
FROM embeddings WHERE vec_id < (SELECT count(*) // 2 FROM embeddings)""")
def q_store_paired_write(spark, sf_dir):
    """K4: vectors paired with a shorter list of ids by position; writing stops at the shorter one."""
    from ..session import scratch_path
    from ..sinks.store import create_store, write_vectors_iter
    from ..sources.store import read_store
    root = scratch_path(spark, "paired")
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    ids = v.where(F.col("pos") < v.count() // 2).select("pos", F.col("pos").cast("string").alias("id"))
    create_store(spark, root, total_vectors=None, vector_dim=64, metadata={"model_name": "paired"})
    write_vectors_iter(spark, root, v, ids)
    weighted = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return read_store(spark, root).select("id", "pos", F.round(weighted, 4).alias("weighted"))


@query("embed_failed_batches", """
SELECT doc_id, length(text) >= 40 AS ok, CASE WHEN length(text) < 40 THEN 'ValueError: text too short' END AS error FROM documents""")
def q_embed_failed_batches(spark, sf_dir):
    """batches of one text; the model refuses short ones, whose rows stay with the reason."""
    from ..operators.embed import embed

    def factory():
        import numpy as np

        def model(texts):
            if min(map(len, texts)) < 40:
                raise ValueError("text too short")
            return np.ones((len(texts), 4))
        return model
    d = read_table(spark, sf_dir, "documents")
    return embed(d, factory, id_col="doc_id", dim=4, batch_size=1, on_error="null").select("doc_id", "ok", "error")


@query("generate_and_store_counts", f"""
SELECT count(*) // 2 AS total_vectors, CAST(0 AS BIGINT) AS failed_vectors, true AS measured FROM (
  SELECT {d_flatten("coalesce(text, 'None')")} AS t FROM documents) WHERE length(t) BETWEEN 10 AND 512""")
def q_generate_and_store_counts(spark, sf_dir):
    """E4's counts apart from its timings."""
    return q_generate_and_store(spark, sf_dir).select("total_vectors", "failed_vectors",
                                                      ((F.col("seconds") > 0) & (F.col("vectors_per_second") > 0)).alias("measured"))


@query("document_export_counts", f"""
SELECT count(*) * 5 // 2 AS total_documents, count(*) * 5 // 2 AS total_vectors, true AS measured
FROM ({d_chunks(_CONV_SRC, 'conv_id', 't')})""")
def q_document_export_counts(spark, sf_dir):
    """The export flow's counts apart from its timings."""
    return q_document_export_run(spark, sf_dir).select("total_documents", "total_vectors", (F.col("total_time_seconds") > 0).alias("measured"))


# ------------------------------------------------------------------ search family

def _queries_from(v):
    return v.select(F.col("id").alias("qid"), "vector", "label")


@query("knn_filtered", _KNN_SQL.format(where="WHERE c.label < 5"))
def q_knn_filtered(spark, sf_dir):
    """V2: vector search restricted by a scalar predicate (pushed to the Parquet scan)."""
    v = _vectors(spark, sf_dir)
    return search.knn_filtered(_queries_from(v), v, F.col("label") < 5, 10, partitions=_tasks(spark))


@query("knn_partitioned", _KNN_SQL.format(where="WHERE q.label = c.label"))
def q_knn_partitioned(spark, sf_dir):
    """V8: search inside the query's own partition (label)."""
    v = _vectors(spark, sf_dir)
    return search.knn_partitioned(_queries_from(v), v, "label", 10, partitions=_tasks(spark))


@query("knn_scenario_scopes", " UNION ALL ".join(
    f"SELECT '{name}' AS scope, * FROM ({_KNN_SQL.format(where=where)})"
    for name, where in (("personal", "WHERE c.label = 0"), ("team", "WHERE c.label < 5"), ("data_lake", ""))))
def q_knn_scopes(spark, sf_dir):
    """The same queries at three owner-scope selectivities."""
    v = _vectors(spark, sf_dir)
    q = _queries_from(v)
    out = None
    for name, pred in (("personal", F.col("label") == 0), ("team", F.col("label") < 5), ("data_lake", F.lit(True))):
        r = search.knn_filtered(q, v, pred, 10, partitions=_tasks(spark)).select(F.lit(name).alias("scope"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def d_codes(vec: str) -> str:
    return (f"CAST(list_sum(list_transform({vec}, lambda x, i: CASE WHEN x > 0 THEN "
            f"CASE WHEN i = 64 THEN -9223372036854775808 ELSE (CAST(1 AS BIGINT) << (i - 1)) END ELSE 0 END)) AS BIGINT)")


@query("binary_codes", f"""
SELECT vec_id AS id, {d_codes('embedding')} AS code, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS bits
FROM embeddings""")
def q_binary_codes(spark, sf_dir):
    """V5: one sign-bit word per 64 dimensions."""
    from ..operators.quantize import binary_codes
    v = _vectors(spark, sf_dir)
    c = binary_codes("vector", 64)
    return v.select("id", F.get(c, 0).alias("code"), F.bit_count(F.get(c, 0)).cast("int").alias("bits"))


_QUANT_SQL = f"""
WITH c AS (SELECT vec_id, embedding, {d_codes('embedding')} AS code FROM embeddings),
p AS (SELECT q.vec_id AS qid, d.vec_id AS id, bit_count(xor(q.code, d.code)) AS hamming,
        round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 12) AS score FROM c q, c d),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hamming, id) AS sr FROM p) WHERE sr <= 40)
SELECT qid, id, CAST(hamming AS BIGINT) AS hamming, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


@query("knn_quantized", _QUANT_SQL)
def q_knn_quantized(spark, sf_dir):
    """V6: Hamming shortlist (k x 4) and exact rescoring."""
    from ..operators.quantize import knn_quantized
    v = _vectors(spark, sf_dir)
    return knn_quantized(_queries_from(v), v, 10, oversample=4, partitions=_tasks(spark))


@query("recall_quantized", f"""
WITH a AS ({_QUANT_SQL}), e AS ({_KNN_SQL.format(where="")}),
per AS (SELECT e.qid, count(a.id) / 10.0 AS recall FROM e LEFT JOIN a ON a.qid = e.qid AND a.id = e.id GROUP BY e.qid)
SELECT round(avg(recall), 6) AS mean_recall, count(*) AS queries FROM per""")
def q_recall_quantized(spark, sf_dir):
    """V9: recall@10 of the quantised search against the exact one."""
    from ..operators.quantize import knn_quantized
    v = _vectors(spark, sf_dir)
    q = _queries_from(v)
    return search.mean_recall(search.recall_at_k(knn_quantized(q, v, 10, partitions=_tasks(spark)), search.knn_exact(q, v, 10, partitions=_tasks(spark)), 10))


_GAPS = """(SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN NULL
  WHEN vec_id % 11 = 5 THEN list_transform(embedding, lambda x: 0.0::FLOAT) ELSE embedding END AS embedding FROM embeddings)"""


def _with_gaps(spark, sf_dir):
    """The vector table with null and zero vectors mixed in."""
    v = _vectors(spark, sf_dir)
    return v.withColumn("vector", F.when(F.col("id") % 7 == 3, F.lit(None)).when(
        F.col("id") % 11 == 5, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vector")))


_NOT_EMPTY = "len(list_filter({0}.embedding, lambda x: x <> 0)) > 0"


@query("knn_exact_with_gaps", _KNN_SQL.format(where=f"WHERE {_NOT_EMPTY.format('q')} AND {_NOT_EMPTY.format('c')}").replace(
    "FROM embeddings q, embeddings c", f"FROM {_GAPS} q, {_GAPS} c"))
def q_knn_with_gaps(spark, sf_dir):
    """V1 on vectors with nulls and zeros: neither is found, neither asks."""
    v = _with_gaps(spark, sf_dir)
    return search.knn_exact(_queries_from(v), v, 10, partitions=_tasks(spark))


@query("knn_quantized_with_gaps", _QUANT_SQL.replace("FROM embeddings)", f"FROM {_GAPS} g WHERE {_NOT_EMPTY.format('g')})"))
def q_knn_quantized_with_gaps(spark, sf_dir):
    """V6 on the same: null and zero vectors take no place in a shortlist."""
    from ..operators.quantize import knn_quantized
    v = _with_gaps(spark, sf_dir)
    return knn_quantized(_queries_from(v), v, 10, oversample=4, partitions=_tasks(spark))


@query("knn_ivf_by_label", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM v) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS m FROM x GROUP BY label),
p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(e, m), 12) DESC, label) AS near
      FROM (SELECT v.vec_id, v.e, c.label, c.m FROM v, c)),
s AS (SELECT q.vec_id AS qid, d.vec_id AS id, round(list_cosine_similarity(qv.e, dv.e), 12) AS score
      FROM p q JOIN p d ON q.label = d.label AND q.near <= 3 AND d.near = 1
      JOIN v qv ON qv.vec_id = q.vec_id JOIN v dv ON dv.vec_id = d.vec_id)
SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def q_knn_ivf_by_label(spark, sf_dir):
    """V7 with given cells: the mean vector of each label is its centroid, three cells are probed."""
    from ..operators.ann import cell_means, knn_ivf
    v = _vectors(spark, sf_dir)
    return knn_ivf(_queries_from(v), v, 10, nprobe=3, centroids=cell_means(v, "label"), partitions=_tasks(spark))


@query("knn_lsh_recall")
def q_knn_lsh_recall(spark, sf_dir):
    """V7 + V9, LSH form: recall@10 of the candidates within a wide radius (random projections)."""
    from ..operators.ann import knn_lsh
    v = _vectors(spark, sf_dir)
    q = _queries_from(v)
    return search.mean_recall(search.recall_at_k(knn_lsh(q, v, 10, threshold=1.5, bucket_length=2.0, partitions=_tasks(spark)),
                                                 search.knn_exact(q, v, 10, partitions=_tasks(spark)), 10))


@query("knn_ivf_recall")
def q_knn_ivf_recall(spark, sf_dir):
    """V7 + V9: probe search over 16 KMeans cells (4 probed) and its recall@10 (iterative
    training: no SQL oracle)."""
    from ..operators.ann import knn_ivf
    v = _vectors(spark, sf_dir)
    q = _queries_from(v)
    return search.mean_recall(search.recall_at_k(knn_ivf(q, v, 10, cells=16, nprobe=4, partitions=_tasks(spark)),
                                                 search.knn_exact(q, v, 10, partitions=_tasks(spark)), 10))


_BM25_TMPL = f"""
WITH d AS (SELECT doc_id, {d_tokens('text')} AS toks FROM DOCS),
sd AS (SELECT doc_id, {d_tokens('text')} AS toks FROM STATDOCS),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM sd),
q AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest({d_tokens('text')}) AS term FROM benchmark)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY doc_id, term),
dl AS (SELECT doc_id, len(toks) AS dl FROM d),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS term FROM sd)
       WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT q.qid, tf.doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2
        / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl))), 12) AS score
      FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = tf.doc_id, st
      GROUP BY q.qid, tf.doc_id)
SELECT qid, doc_id AS id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= DEPTH"""
_BM25_SQL = _BM25_TMPL.replace("DEPTH", "10").replace("STATDOCS", "documents").replace("DOCS", "documents")


def _bm25(spark, sf_dir):
    from ..operators.bm25 import bm25_search
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    qs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return bm25_search(docs, qs, 10)


@query("bm25_search", _BM25_SQL)
def q_bm25_search(spark, sf_dir):
    """V3: benchmark texts as queries over the documents."""
    return _bm25(spark, sf_dir)


#: rows of each list that are fused into the hybrid top 10
_RANK_WINDOW = 100
_HYBRID_TMPL = f"""
WITH bm AS ({_BM25_TMPL.replace("DEPTH", str(_RANK_WINDOW))}),
dc AS ({d_cells('SELECT doc_id, text FROM DOCS', 'doc_id', 'text')}),
qc AS ({d_cells('SELECT item_id, text FROM benchmark', 'item_id', 'text')}),
vs AS (SELECT qc.k AS qid, dc.k AS id, round(sum(qc.value * dc.value), 12) AS score FROM qc JOIN dc ON qc.bucket = dc.bucket
       GROUP BY qc.k, dc.k),
vk AS (SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs)
       WHERE rank <= {_RANK_WINDOW}),
u AS (SELECT qid, id, 1.0 / (60 + rank) AS rrf FROM bm UNION ALL SELECT qid, id, 1.0 / (60 + rank) FROM vk),
f AS (SELECT qid, id, round(sum(rrf), 12) AS score, count(*) AS lists FROM u GROUP BY qid, id)
SELECT qid, id, round(score, 6) AS score, lists, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"""
_HYBRID_SQL = _HYBRID_TMPL.replace("STATDOCS", "documents").replace("DOCS", "documents")


_WEIGHTED_SQL = f"""
WITH bm AS ({_BM25_TMPL.replace("DEPTH", str(_RANK_WINDOW))}),
dc AS ({d_cells('SELECT doc_id, text FROM DOCS', 'doc_id', 'text')}),
qc AS ({d_cells('SELECT item_id, text FROM benchmark', 'item_id', 'text')}),
common AS (SELECT qc.k AS qid, dc.k AS id, sum(qc.value * dc.value) AS score FROM qc JOIN dc ON qc.bucket = dc.bucket GROUP BY qc.k, dc.k),
vs AS (SELECT q.k AS qid, d.k AS id, round(coalesce(score, 0), 12) AS score FROM (SELECT DISTINCT k FROM qc) q CROSS JOIN (SELECT DISTINCT k FROM dc) d
       LEFT JOIN common ON common.qid = q.k AND common.id = d.k),
vk AS (SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs)
       WHERE rank <= {_RANK_WINDOW}),
b AS (SELECT 0.3 AS w, qid, id, score FROM bm UNION ALL SELECT 0.7, qid, id, score FROM vk),
n AS (SELECT *, min(score) OVER (PARTITION BY w, qid) AS lo, max(score) OVER (PARTITION BY w, qid) AS hi FROM b),
f AS (SELECT qid, id, round(sum(w * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END), 12) AS score, count(*) AS lists
      FROM n GROUP BY qid, id)
SELECT qid, id, round(score, 6) AS score, lists, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"""


@query("hybrid_search_weighted", _WEIGHTED_SQL.replace("STATDOCS", "documents").replace("DOCS", "documents"))
def q_hybrid_search_weighted(spark, sf_dir):
    """V4 by weighted, scaled scores: 0.3 BM25, 0.7 vectors."""
    from ..operators.bm25 import bm25_search, weighted_fusion
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    qs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    vec = search.knn_exact(_cell_vectors(qs, "qid"), _cell_vectors(docs, "id"), _RANK_WINDOW)
    fused = weighted_fusion([bm25_search(docs, qs, _RANK_WINDOW), vec], [0.3, 0.7], 10)
    return fused.select("qid", "id", "score", "lists", F.col("rank").cast("int").alias("rank"))


def _cell_vectors(df, id_col, dim=64):
    """Hash-embedder vectors in float64 through the map-only embedder (no shuffle); equal to
    the SQL cells of ``hash_embed_cells``."""
    from ..operators.embed import embed, hash_embedder_factory
    return embed(_dealt(df.select(id_col, "text")), hash_embedder_factory(dim), id_col=id_col, dim=dim, vector_type="double") \
        .select(id_col, "vector")


@query("hybrid_search", _HYBRID_SQL)
def q_hybrid_search(spark, sf_dir):
    """V4: the first 100 of BM25 and of the hash vectors fused by reciprocal rank (c = 60), top 10."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return _hybrid(spark, sf_dir, docs)


def _hybrid(spark, sf_dir, docs, stats_docs=None):
    from ..operators.bm25 import bm25_search, reciprocal_rank_fusion
    qs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    dv = _cell_vectors(docs, "id")
    qv = _cell_vectors(qs, "qid")
    vec = search.knn_exact(qv, dv, _RANK_WINDOW)
    fused = reciprocal_rank_fusion([bm25_search(docs, qs, _RANK_WINDOW, stats_corpus=stats_docs), vec], 10)
    return fused.select("qid", "id", "score", "lists", F.col("rank").cast("int").alias("rank"))


_CLEAN_DOCS = ("(SELECT * FROM documents WHERE doc_id IN "
               "(SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0))")


@query("hybrid_search_filtered", _HYBRID_TMPL.replace("STATDOCS", "documents").replace("DOCS", _CLEAN_DOCS))
def q_hybrid_search_filtered(spark, sf_dir):
    """V4 with a scalar filter in the same query: only documents labelled good quality and
    non-toxic match (semi join with the label table; broadcast only below a measured size).
    As in a search engine, the filter restricts matches but not the term statistics, which
    come from the whole corpus."""
    from ..operators.bounded import broadcast_if_small
    ok = read_table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0)) \
        .select(F.col("doc_id").alias("id"))
    all_docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = all_docs.join(broadcast_if_small(ok, row_bytes=16), "id", "left_semi")
    return _hybrid(spark, sf_dir, docs, stats_docs=all_docs)


@query("bm25_index_search", _BM25_SQL)
def q_bm25_index_search(spark, sf_dir):
    """V3 over a stored index: built once, then searched without reading any text."""
    from ..operators.text_index import build_text_index, search_text_index
    from ..session import scratch_path
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    qs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return search_text_index(qs, build_text_index(_dealt(docs), scratch_path(spark, "text-index")), 10)


@query("hybrid_index_search", _HYBRID_SQL)
def q_hybrid_index_search(spark, sf_dir):
    """V4 over stored indexes: postings, and the documents' vectors embedded once."""
    from ..operators.bm25 import reciprocal_rank_fusion
    from ..operators.text_index import build_text_index, search_text_index
    from ..session import cut_lineage, scratch_path
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    qs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    root = build_text_index(_dealt(docs), scratch_path(spark, "text-index"))
    vec = search.knn_exact(cut_lineage(_cell_vectors(qs, "qid")), cut_lineage(_cell_vectors(docs, "id")), _RANK_WINDOW)
    fused = reciprocal_rank_fusion([search_text_index(qs, root, _RANK_WINDOW), vec], 10)
    return fused.select("qid", "id", "score", "lists", F.col("rank").cast("int").alias("rank"))


#: the queries of the searches over stored vectors: rows whose id is divisible by 100
_CELLS_SQL = ORACLE["knn_ivf_by_label"].replace("JOIN v qv ON qv.vec_id = q.vec_id", "JOIN v qv ON qv.vec_id = q.vec_id AND q.vec_id % 100 = 0")


@query("knn_cells_stored", _CELLS_SQL)
def q_knn_cells_stored(spark, sf_dir):
    """V7 over stored cells (given centroids, three probed): only the probed folders are read."""
    from ..operators.ann import cell_means
    from ..operators.vector_index import build_cells, search_cells
    from ..session import scratch_path
    v = _vectors(spark, sf_dir)
    root = build_cells(v, scratch_path(spark, "cells"), centroids=cell_means(v, "label"))
    return search_cells(_queries_from(v).where("qid % 100 = 0"), root, 10, nprobe=3)


_REACHED_SQL = "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0"


@query("knn_cells_recall", _REACHED_SQL)
def q_knn_cells_recall(spark, sf_dir):
    """V7 + V9: KMeans cells, as many probed as a recall@10 of 0.9 takes by measurement."""
    from ..operators.vector_index import build_cells, choose_nprobe, search_cells
    from ..session import scratch_path
    v = _vectors(spark, sf_dir)
    q = _queries_from(v).where("qid % 100 = 0")
    root = build_cells(v, scratch_path(spark, "cells"), cells=16)
    found = search_cells(q, root, 10, nprobe=choose_nprobe(q, root, 10, 0.9))
    return search.mean_recall(search.recall_at_k(found, search.knn_exact(q, v, 10), 10)).select("queries", (F.col("mean_recall") >= 0.9).alias("reached"))


@query("knn_codes_stored", _QUANT_SQL.replace("FROM c q, c d)", "FROM c q, c d WHERE q.vec_id % 100 = 0)"))
def q_knn_codes_stored(spark, sf_dir):
    """V6 over stored codes: they alone are scanned for the shortlists, then their vectors are read."""
    from ..operators.vector_index import build_codes, search_codes
    from ..session import scratch_path
    v = _vectors(spark, sf_dir)
    return search_codes(_queries_from(v).where("qid % 100 = 0"), build_codes(v, scratch_path(spark, "codes")), 10, oversample=4)


@query("knn_codes_recall", _REACHED_SQL)
def q_knn_codes_recall(spark, sf_dir):
    """V6 + V9: the shortlist grows until the recall@10 is 0.9."""
    from ..operators.vector_index import build_codes, choose_oversample, search_codes
    from ..session import scratch_path
    v = _vectors(spark, sf_dir)
    q = _queries_from(v).where("qid % 100 = 0")
    root = build_codes(v, scratch_path(spark, "codes"))
    found = search_codes(q, root, 10, choose_oversample(q, root, 10, 0.9))
    return search.mean_recall(search.recall_at_k(found, search.knn_exact(q, v, 10), 10)).select("queries", (F.col("mean_recall") >= 0.9).alias("reached"))


@query("usage_top_terms", f"""
SELECT term, count(*) AS count FROM (SELECT unnest({d_tokens('text')}) AS term FROM documents)
GROUP BY term ORDER BY count DESC, term LIMIT 20""")
def q_usage_top_terms(spark, sf_dir):
    """Hot terms of the corpus (top 20)."""
    from ..operators.analytics import top_terms
    return top_terms(read_table(spark, sf_dir, "documents"), "text", 20)


@query("usage_top_users", """
SELECT user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, user_id LIMIT 10""")
def q_usage_top_users(spark, sf_dir):
    """Most active users of the event log (top 10)."""
    from ..operators.analytics import top_values
    return top_values(read_table(spark, sf_dir, "events"), "user_id", 10)


@query("usage_top_users_sketched", ORACLE["usage_top_users"])
def q_usage_top_users_sketched(spark, sf_dir):
    """V19 by one sketch a day, combined."""
    from ..operators.analytics import top_values_sketched
    return top_values_sketched(read_table(spark, sf_dir, "events"), "user_id", F.to_date("ts"), 10)


# -------------------------------------------------------- search-benchmark analytics
# ``events`` as a query log: system = event_type, query = user_id, latency = value ms

def _qlog(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("system"), F.col("user_id").alias("query_id"), "user_id", "ts", "event_id",
        (F.col("value") / 1000).alias("latency_s"),
        (F.octet_length("props") + F.octet_length("event_type") + 32).alias("bytes"))


_QLOG = ("SELECT event_type AS system, user_id AS query_id, user_id, ts, event_id, value / 1000 AS latency_s, "
         "strlen(props) + strlen(event_type) + 32 AS bytes, true AS ok FROM events")


@query("search_latency", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY ts, query_id) AS seq,
                  row_number() OVER (PARTITION BY system, query_id ORDER BY ts) AS occ FROM ({_QLOG})),
p AS (SELECT system, CASE WHEN occ = 1 THEN 'cold' ELSE 'hot' END AS phase, latency_s, ok FROM s WHERE seq > 100)
{d_latency('SELECT * FROM p', 'system, phase')}""")
def q_search_latency(spark, sf_dir):
    """Warm-up 100 dropped, cold vs hot percentiles per system."""
    from ..operators.analytics import search_latency
    return search_latency(_qlog(spark, sf_dir), warmup=100)


@query("search_throughput", """
WITH l AS (SELECT event_type AS system, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
r AS (SELECT system, sec // 60 AS run, count(DISTINCT user_id) AS clients,
             count_if(sec - (sec // 60) * 60 >= 5) AS measured FROM l GROUP BY system, sec // 60),
p AS (SELECT *, CASE WHEN clients >= 100 THEN 100 WHEN clients >= 50 THEN 50 WHEN clients >= 10 THEN 10 ELSE 1 END
             AS client_level, measured / 55.0 AS qps FROM r)
SELECT system, client_level, count(*) AS runs, CAST(sum(measured) AS BIGINT) AS requests,
       round(avg(qps), 6) AS qps_mean, round(max(qps), 6) AS qps_max FROM p GROUP BY system, client_level""")
def q_search_throughput(spark, sf_dir):
    """60 s runs, 5 s ramp-up excluded, QPS per client level."""
    from ..operators.analytics import search_throughput
    return search_throughput(_qlog(spark, sf_dir), duration_s=60, ramp_up_s=5)


@query("import_summary", """
WITH p AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, ts FROM events),
b AS (SELECT pos // 1000 AS batch_no, count(*) AS rows, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds
      FROM p GROUP BY pos // 1000)
SELECT batch_no, rows, round(seconds, 6) AS seconds, round(rows / seconds, 6) AS rows_per_second,
  CAST(sum(rows) OVER (ORDER BY batch_no) AS BIGINT) AS rows_total,
  CAST(floor((sum(rows) OVER (ORDER BY batch_no) - rows) / 1000000) AS BIGINT) AS checkpoint_no FROM b""")
def q_import_summary(spark, sf_dir):
    """The log as an import stream: 1,000-row batches, checkpoint every 1M rows."""
    from ..operators.analytics import import_summary
    return import_summary(_qlog(spark, sf_dir), ["ts", "event_id"], batch_size=1000, checkpoint_every=1_000_000)


def _with_now(spark, sf_dir):
    q = _qlog(spark, sf_dir)
    now = q.agg(F.max("ts")).first()[0]
    return q.withColumn("__now", F.lit(now))


_TIER_DAYS = f"""SELECT system, date_diff('day', CAST(ts AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) AS age_days,
  latency_s, bytes FROM ({_QLOG})"""


@query("tier_by_age", f"""
WITH d AS (SELECT age_days, count(*) AS rows, sum(bytes) AS bytes FROM ({_TIER_DAYS}) GROUP BY age_days),
s AS (SELECT * FROM (VALUES ('hot_only', 1), ('hot_warm', 15), ('hot_warm_cold', 60)) v(scenario, max_age))
SELECT scenario, CASE WHEN age_days < 7 THEN 'hot' WHEN age_days < 30 THEN 'warm' ELSE 'cold' END AS tier,
  CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes
FROM d JOIN s ON d.age_days < s.max_age GROUP BY ALL""")
def q_tier_by_age(spark, sf_dir):
    """Hot < 7 d, warm < 30 d, cold; per scenario 1 / 15 / 60 days of data."""
    from ..operators.analytics import tier_by_age
    return tier_by_age(_with_now(spark, sf_dir), "ts", "bytes")


def _usage(spark, sf_dir):
    from ..operators.analytics import HOT_DAYS
    q = _with_now(spark, sf_dir)
    age = F.datediff(F.col("__now").cast("date"), F.col("ts").cast("date"))
    wide = q.groupBy("system").agg(
        (F.sum("latency_s") / 3600).alias("compute_hours"),
        (F.sum(F.when(age < HOT_DAYS, F.col("bytes")).otherwise(0)) / 1e9).alias("storage_ssd_gb"),
        (F.sum(F.when(age >= HOT_DAYS, F.col("bytes")).otherwise(0)) / 1e9).alias("storage_hdd_gb"),
        (F.sum("bytes") / 1e9).alias("network_gb"))
    return wide.unpivot(["system"], ["compute_hours", "storage_ssd_gb", "storage_hdd_gb", "network_gb"],
                        "resource", "quantity")


_USAGE = f"""SELECT system, sum(latency_s) / 3600 AS compute_hours,
  sum(CASE WHEN age_days < 7 THEN bytes ELSE 0 END) / 1e9 AS storage_ssd_gb,
  sum(CASE WHEN age_days >= 7 THEN bytes ELSE 0 END) / 1e9 AS storage_hdd_gb, sum(bytes) / 1e9 AS network_gb
FROM ({_TIER_DAYS}) GROUP BY system"""
_COST = f"""SELECT system, round(compute_hours * 0.5 + storage_ssd_gb * 0.1 + storage_hdd_gb * 0.03 + network_gb * 0.09, 6)
  AS cost, CAST(0 AS BIGINT) AS unpriced_items FROM ({_USAGE})"""


@query("cost_model", _COST)
def q_cost_model(spark, sf_dir):
    """Usage x unit prices per system."""
    from ..operators.analytics import cost_model
    return cost_model(_usage(spark, sf_dir))


@query("scale_projection", f"""
WITH m AS (SELECT system, count(*) AS rows, sum(latency_s) AS seconds, sum(bytes) AS bytes FROM ({_QLOG}) GROUP BY system),
s AS (SELECT unnest([100000000, 500000000, 1000000000]::BIGINT[]) AS scale)
SELECT system, scale, round(seconds * (scale / rows), 6) AS seconds_projected,
  CAST(round(bytes * (scale / rows), 0) AS BIGINT) AS bytes_projected FROM m, s""")
def q_scale_projection(spark, sf_dir):
    """Per system, time and bytes projected linearly to 100M / 500M / 1B."""
    from ..operators.analytics import scale_projection
    m = _qlog(spark, sf_dir).groupBy("system").agg(F.count(F.lit(1)).alias("rows"),
                                                   F.sum("latency_s").alias("seconds"),
                                                   F.sum("bytes").cast("double").alias("bytes"))
    return scale_projection(m, "rows", ["seconds", "bytes"], integral_cols=("bytes",))


@query("system_comparison", f"""
WITH lat AS ({d_latency(_QLOG, 'system')}),
thr AS (SELECT system, count(*) / sum(latency_s) AS v FROM ({_QLOG}) GROUP BY system),
cost AS ({_COST}),
m AS (SELECT system, 'p99_ms' AS metric, p99_ms AS value FROM lat
      UNION ALL SELECT system, 'throughput_qps', round(v, 6) FROM thr
      UNION ALL SELECT system, 'cost', cost FROM cost)
SELECT system, metric, value, CAST(rank() OVER (PARTITION BY metric ORDER BY
  CASE WHEN metric = 'throughput_qps' THEN -value ELSE value END) AS INTEGER) AS rank FROM m""")
def q_system_comparison(spark, sf_dir):
    """Rank systems per metric (p99 and cost lower is better, throughput higher)."""
    from ..operators.analytics import cost_model
    from ..operators.metrics import latency_summary
    from ..operators.report import rank_systems
    log = _qlog(spark, sf_dir)
    lat = latency_summary(log, ["system"], ok_col=None).select("system", F.lit("p99_ms").alias("metric"),
                                                               F.col("p99_ms").alias("value"))
    thr = log.groupBy("system").agg(F.round(F.count(F.lit(1)) / F.sum("latency_s"), 6).alias("value")) \
        .select("system", F.lit("throughput_qps").alias("metric"), "value")
    cost = cost_model(_usage(spark, sf_dir)).select("system", F.lit("cost").alias("metric"),
                                                    F.col("cost").alias("value"))
    r = rank_systems(lat.unionByName(thr).unionByName(cost),
                     {"p99_ms": True, "throughput_qps": False, "cost": True})
    return r.select("system", "metric", "value", F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------------- streaming

@query("telemetry_stream_windows", """
SELECT * FROM (
  SELECT ws AS window_start, ws + INTERVAL 6 HOUR AS window_end, gpu_id, count(*) AS snapshots, max(value) AS peak_mb,
         round(avg(value), 6) AS avg_mb
  FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS ws, event_type AS gpu_id, value FROM events) GROUP BY ws, gpu_id)
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_telemetry_stream_windows(spark, sf_dir):
    """The table replayed as a stream (available-now trigger, checkpointed); append mode
    emits the windows the 1-hour watermark has closed."""
    from ..session import scratch_path
    from ..streaming.telemetry import run_windows_available_now
    # event time must be TIMESTAMP for a watermark; the table's TIMESTAMP_NTZ values are UTC
    # wall-clock times, so the conversion (and the one back) is pinned to UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = read_table(spark, sf_dir, "events").schema
    sink = run_windows_available_now(
        spark, sf_dir, schema, scratch_path(spark, "t1sink"), scratch_path(spark, "t1ckpt"), glob="events.parquet",
        prepare=lambda s: s.select("ts", F.col("event_type").alias("gpu_id"), F.col("value").alias("memory_used_mb")),
        window="6 hours", watermark="1 hour")
    out = spark.read.parquet(sink)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "gpu_id", "snapshots", "peak_mb", "avg_mb")


@query("incremental_ingest", f"""
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, CAST(64 AS INTEGER) AS dims FROM (
  SELECT doc_id, {d_flatten('text')} AS t FROM documents) WHERE length(t) BETWEEN 10 AND 512""")
def q_incremental_ingest(spark, sf_dir):
    """The collection arrives twice (two file drops); the stream de-duplicates by id, embeds
    and appends to the store."""
    from ..operators.embed import hash_embedder_factory
    from ..session import scratch_path
    from ..sources import corpus
    from ..streaming.ingest import incremental_ingest, read_stream_store
    src = scratch_path(spark, "t2src")
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__k"),
                                                      F.col("doc_id").cast("string").alias("doc"), "text")
    accepted = corpus.read_parquet_text(d)
    # two drops of the same collection, keyed by the document id
    for part in ("drop1", "drop2"):
        (accepted.select(F.concat_ws("\t", "doc", "text").alias("value"))
         .write.text(f"{src}/{part}"))
    store = scratch_path(spark, "t2store")
    incremental_ingest(spark, f"{src}/*", store, hash_embedder_factory(64), 64, scratch_path(spark, "t2ckpt"))
    return read_stream_store(spark, store).select("id", F.size("vector").cast("int").alias("dims"))


# ------------------------------------------------------------- files and catalogs

@query("dataset_catalog", f"""
SELECT lang, count(*) AS lines,
  CAST(sum(strlen(CAST(doc_id AS VARCHAR) || chr(9) || {d_flatten('text')}) + 1) AS BIGINT) AS size_bytes,
  true AS valid_utf8
FROM documents GROUP BY lang""")
def q_dataset_catalog(spark, sf_dir):
    """S16 + A2: a TSV written per language, then catalogued (lines, bytes) and UTF-8 checked."""
    from ..functions.text import flatten_text
    from ..session import scratch_path
    from ..sources.corpus import dataset_catalog, utf8_check_files
    path = scratch_path(spark, "catalog")
    d = read_table(spark, sf_dir, "documents")
    (d.select("lang", F.concat_ws("\t", F.col("doc_id").cast("string"), flatten_text("text")).alias("value"))
     .write.partitionBy("lang").text(path))
    cat = dataset_catalog(spark, path, "*.txt")
    ok = utf8_check_files(spark, path, "*.txt")
    j = cat.join(ok, cat.file_path == ok.path, "left").withColumn("lang", F.regexp_extract("file_path", "lang=([^/]+)", 1))
    return j.groupBy("lang").agg(F.sum("lines").cast("bigint").alias("lines"),
                                 F.sum("size_bytes").cast("bigint").alias("size_bytes"),
                                 F.bool_and(F.coalesce("valid_utf8", F.lit(True))).alias("valid_utf8"))


@query("telemetry_roundtrip", """
SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS devices, count(*) AS snapshots,
  max(value) AS max_peak_mb, round(max(a), 6) AS max_avg_mb
FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS a FROM events)""")
def q_telemetry_roundtrip(spark, sf_dir):
    """K8 -> S15 -> A8: snapshots written as JSON per device and summarised after reading back."""
    from ..session import scratch_path
    from ..operators.telemetry import read_telemetry, telemetry_summary, write_telemetry
    path = write_telemetry(_telemetry(spark, sf_dir), scratch_path(spark, "telemetry"))
    t = read_telemetry(spark, path)
    s = telemetry_summary(t)
    return s.select(F.array_join("devices", ",").alias("devices"), "snapshots", "max_peak_mb", "max_avg_mb")


@query("repeat_with_noise", """
WITH n AS (SELECT vec_id, r, embedding, list_transform(embedding, lambda x, i: x::DOUBLE + 0.01
    * sqrt(-2 * ln((('0x' || substr(md5(vec_id || ':' || r || ':' || (i - 1) || ':42'), 1, 8))::BIGINT + 0.5) / 4294967296.0))
    * cos(2 * pi() * ((('0x' || substr(md5(vec_id || ':' || r || ':' || (i - 1) || ':42'), 9, 8))::BIGINT + 0.5) / 4294967296.0))) AS v
  FROM embeddings, (SELECT unnest([0, 1]) AS r)),
u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM n)
SELECT CAST(vec_id AS VARCHAR) || '_repeat_' || r AS id, CAST(r AS INTEGER) AS repeat_id,
  CAST(len(embedding) AS INTEGER) AS dims, CAST(1.0 AS DOUBLE) AS norm,
  round(list_sum(list_transform(v, lambda x, i: (x / norm)::FLOAT::DOUBLE * i)), 3) AS weighted
FROM u""")
def q_repeat_with_noise(spark, sf_dir):
    """The vector table grown to twice its size with reproducible noise, re-normalised."""
    from ..operators.expand import repeat_with_noise
    v = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "vec_id")
    n = v.count()
    r = repeat_with_noise(v, 2 * n, "vec_id", sigma=0.01)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    weighted = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return r.select("id", "repeat_id", F.size("vector").cast("int").alias("dims"), F.round(norm, 4).alias("norm"),
                    F.round(weighted, 3).alias("weighted"))


# ---------------------------------------------------------------------- synthetic

def _d_synth(lang_expr_en: str) -> str:
    from ..functions.synth import EN_TEMPLATES, EN_WORDS, ZH_TEMPLATES, ZH_WORDS

    def arr(xs):
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

    def piece(rep, tpls, words):
        h = f"md5('42:' || doc_id || ':' || {rep})"
        return (f"replace({arr(tpls)}[(doc_id % {len(tpls)}) + 1], '{{}}', "
                f"{arr(words)}[(('0x' || substr({h}, 1, 8))::BIGINT % {len(words)}) + 1])")

    def grown(tpls, words):
        return (f"list_reduce(range(1, 3), lambda acc, r: CASE WHEN length(acc) < 50 THEN acc || ' ' || "
                f"{piece('r', tpls, words)} ELSE acc END, {piece('0', tpls, words)})")

    return (f"CASE WHEN {lang_expr_en} THEN {d_strip('substring(' + grown(EN_TEMPLATES, EN_WORDS) + ', 1, 200)')} "
            f"ELSE {d_strip('substring(' + grown(ZH_TEMPLATES, ZH_WORDS) + ', 1, 200)')} END")


@query("synth_corpus", f"SELECT doc_id, lang, {_d_synth("lang = 'en'")} AS text FROM documents")
def q_synth_corpus(spark, sf_dir):
    """One synthetic text per document id (English for ``en`` rows, Chinese otherwise)."""
    from ..functions.synth import synth_text
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.select("doc_id", "lang", F.when(F.col("lang") == "en", synth_text("doc_id", "en"))
                    .otherwise(synth_text("doc_id", "zh")).alias("text"))


# ------------------------------------------------------------------ end-to-end flows

@query("prepare_collection", f"""
WITH a AS (SELECT t FROM (SELECT {d_flatten("coalesce(text, 'None')")} AS t FROM documents)
           WHERE length(t) BETWEEN 10 AND 512)
SELECT count(*) AS total_lines, count(*) AS valid_lines, CAST(0 AS BIGINT) AS empty_lines,
  CAST(0 AS BIGINT) AS malformed_lines, count(*) AS unique_ids, round(avg(length(t)), 6) AS avg_length,
  CAST(min(length(t)) AS BIGINT) AS min_length, CAST(max(length(t)) AS BIGINT) AS max_length,
  CAST(0 AS BIGINT) AS ids_over_64_bytes, CAST(0 AS BIGINT) AS duplicate_ids, count(*) > 0 AS passed FROM a""")
def q_prepare_collection(spark, sf_dir):
    """Raw table -> accepted texts -> dense ids -> TSV -> validation of the written files."""
    from ..session import scratch_path
    from ..sources import corpus
    from .corpus_preparation import prepare_collection
    accepted = corpus.read_parquet_text(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prepare_collection(spark, accepted, scratch_path(spark, "prepared"), "doc_id").drop("path")


@query("document_export_run")
def q_document_export_run(spark, sf_dir):
    """Conversation turns as pages through the whole export flow; run statistics and their
    rates (timings: rows-only check)."""
    from ..operators.embed import hash_embedder_factory
    from ..operators.metrics import run_rates
    from ..session import scratch_path
    from .document_export import export_documents
    pages = read_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("source_file"),
        F.col("turn").cast("int").alias("page_no"), F.col("text").alias("page_text"))
    run = export_documents(spark, pages, scratch_path(spark, "export"), hash_embedder_factory(64), 64,
                           target_factor=2.5, latin_sentences=True)
    return run_rates(run, keep_all=True)
