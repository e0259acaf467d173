"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_path
from . import collocations, mixing, packing, quality, secret_scan, setsketch, simhash, suffix, token_files, topk, toxicity, warc, whitening
from .common import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


@query("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3, max_distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).withColumnRenamed("id", "doc_id")


@query("op3_secret_scan")
def op3(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit_markov(secret_scan.labelled_samples(docs)))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("markov").alias("n_markov"))


#: the mix of the query and of the pipeline: a domain is the source's number modulo 4; sources
#: not listed weigh 1; three fifths of the table's tokens, each leaf at most twice
MIX_LEVELS = {"domain": "concat('domain', try_cast(regexp_extract(source, '[0-9]+$', 0) as bigint) % 4)",
              "language": "lang", "origin": "source"}
MIX_WEIGHTS = {**{(f"domain{i}",): 4 - i for i in range(4)},
               **{(f"domain{i}", lang): w for i in range(4) for lang, w in (("en", 3), ("de", 3), ("fr", 2), ("es", 2))}}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = (3, 5), 2, 17


def _mix_sql() -> str:
    names = list(MIX_LEVELS)
    given = ", ".join(f"({len(p)}, " + ", ".join(f"'{p[i]}'" if i < len(p) else "NULL" for i in range(3)) + f", {w})"
                      for p, w in MIX_WEIGHTS.items())
    parts = [f"""
u AS (SELECT coalesce('domain' || (TRY_CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 4), '(none)') AS domain,
       coalesce(nullif(lang, ''), '(none)') AS language, coalesce(nullif(source, ''), '(none)') AS origin, doc_id AS id,
       count(*) AS rows, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::BIGINT AS tokens
      FROM documents GROUP BY ALL)""",
             f"given(depth, domain, language, origin, w) AS (VALUES {given})",
             f"""c3 AS (SELECT *, CASE WHEN w > 0 THEN supply * {MIX_EPOCHS} ELSE 0 END AS cap FROM (
       SELECT s.*, coalesce(g.w, 1) AS w FROM (SELECT domain, language, origin, sum(tokens)::BIGINT AS supply FROM u GROUP BY ALL) s
       LEFT JOIN given g ON g.depth = 3 AND g.domain = s.domain AND g.language = s.language AND g.origin = s.origin))"""]
    for d in (2, 1):
        cols = ", ".join(names[:d])
        on = " AND ".join(f"g.{c} = s.{c}" for c in names[:d])
        parts.append(f"""c{d} AS (SELECT s.*, coalesce(g.w, 1) AS w, CASE WHEN coalesce(g.w, 1) > 0 THEN s.cap0 ELSE 0 END AS cap
       FROM (SELECT {cols}, sum(cap)::BIGINT AS cap0 FROM c{d + 1} GROUP BY ALL) s LEFT JOIN given g ON g.depth = {d} AND {on})""")
    for d in (1, 2, 3):
        parent = ", ".join(names[: d - 1])
        by = f"PARTITION BY {parent}" if parent else ""
        up = f"({by} ORDER BY cap / w, {', '.join(names[:d])} ROWS UNBOUNDED PRECEDING)"
        source = (f"(SELECT *, (SELECT sum(tokens) * {MIX_BUDGET[0]} // {MIX_BUDGET[1]} FROM u)::HUGEINT AS b FROM c1)" if d == 1 else
                  f"(SELECT c.*, p.g::HUGEINT AS b FROM c{d} c JOIN (SELECT {parent}, g FROM b{d - 1}) p USING ({parent}))")
        parts.append(f"""b{d} AS (SELECT *, (CASE WHEN met THEN cap ELSE (upto * remains) // opens - ((upto - open) * remains) // opens END)::BIGINT AS g
       FROM (SELECT *, b - sum(taken) OVER ({by}) AS remains, sum(open) OVER ({by}) AS opens, sum(open) OVER {up} AS upto
       FROM (SELECT *, CASE WHEN met THEN cap ELSE 0 END AS taken, CASE WHEN met THEN 0 ELSE w END AS open
       FROM (SELECT *, cap * (sum(w) OVER ({by}) - sum(w) OVER {up} + w) <= w * (b - (sum(cap) OVER {up} - cap)) AS met
       FROM {source} WHERE cap > 0))))""")
    key = f"md5('{MIX_SEED}:' || epochs || ':' || coalesce('=' || id, 'null'))"
    parts.append("l AS (SELECT domain, language, origin, g // supply AS epochs, g % supply AS part FROM b3 WHERE g > 0)")
    parts.append(f"""k AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY {key} ROWS UNBOUNDED PRECEDING) - tokens AS start
       FROM u JOIN l USING (domain, language, origin))""")
    return "WITH " + ",\n".join(parts) + """
SELECT domain, language, origin, id AS doc_id, epoch::INTEGER AS epoch, rows, tokens,
       (CASE WHEN epoch = epochs THEN least(tokens, part - start) ELSE tokens END)::BIGINT AS take
FROM (SELECT *, unnest(range(0, epochs + CASE WHEN start < part THEN 1 ELSE 0 END)) AS epoch FROM k)"""


@query("op1_mix_sources", _mix_sql())
def op1(spark, sf_dir):
    units, plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"), MIX_LEVELS, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)
    return mixing.mixed_units(units, plan, list(MIX_LEVELS), MIX_SEED).withColumnRenamed("id", "doc_id")


PACK_LENGTHS = [512, 1024, 2048, 4096]


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), PACK_LENGTHS).withColumnRenamed("id", "doc_id")


@query("op8_exact_top_k", """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5""")
def op8(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.exact_top_k(rows.where("id % 50 = 0"), rows, k=5).withColumnRenamed("id", "vec_id")


def _quality_sql() -> str:
    rules = quality.RULES  # their conditions read the same in both dialects
    least, most = quality.PRIOR
    counts = ", ".join(f"sum(({c})::INT) AS f_{r}" for r, c in rules.items())
    sums = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, sum(f_{r}::DOUBLE * f_{r} / n) - sum(f_{r}) * (sum(f_{r}) / sum(n)) AS s_{r}" for r in rules)
    rhos = ", ".join(f"""CASE WHEN m_{r} > 0 AND m_{r} < 1 AND room > 0 THEN (s_{r} / (m_{r} * (1 - m_{r})) - (k - 1)) / room ELSE 0 END AS rho_{r}"""
                     for r in rules)
    sizes = ", ".join(f"least(greatest(CASE WHEN rho_{r} > 0 THEN (1 - rho_{r}) / rho_{r} ELSE {most} END, {least}), {most}) AS z_{r}" for r in rules)
    bad = " OR ".join(f"(f_{r} + m_{r} * z_{r}) / (n + z_{r}) > {quality.MAX_RATE}" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT rid, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram,
    unnest(range(1, len(w) - 3)) AS pos FROM d),
r AS (SELECT rid, count(DISTINCT pos + step) AS n_repeat_words FROM
    (SELECT rid, pos, unnest(range(0, 5)) AS step FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS times FROM g) WHERE times > 1)
    GROUP BY rid),
m AS (SELECT doc_id, source AS host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (rid)),
h AS (SELECT host, count(*) AS n, {counts} FROM m GROUP BY host),
p AS (SELECT count(*) AS k, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room, {sums} FROM h),
q AS (SELECT *, {sizes} FROM (SELECT *, {rhos} FROM p)),
b AS (SELECT host, {bad} AS host_failed FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {rules["base"]} AS base_failed,
    NOT ({rules["base"]}) AND NOT host_failed AS kept, host_failed
FROM m JOIN b ON m.host IS NOT DISTINCT FROM b.host"""


@query("op2_quality_rules", _quality_sql())
def op2(spark, sf_dir):
    return quality.judge(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


@query("op4_token_files")
def op4(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = scratch_path(spark, "token-files")
    encoded = materialise(token_files.encode_words(read_table(spark, sf_dir, "documents"), tokenizer, end_id=1), "token-ids")
    token_files.write_token_files(encoded, path)
    return token_files.read_checksums(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


@query("op6_warc_fixity", """
WITH t AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
b AS (SELECT *, CASE WHEN page_id % 389 = 7 THEN left(html, length(html) // 2)
                     WHEN page_id % 97 = 13 AND html <> '' THEN 'X' || substr(html, 2) ELSE html END AS html_b FROM t),
r AS (SELECT page_id, html, html_b,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
  chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM b),
s AS (SELECT page_id, head || octet_length(encode(html)) || gap || html || gap AS ra, head || octet_length(encode(html_b)) || gap || html_b || gap AS rb FROM r),
h AS (SELECT page_id, octet_length(encode(ra)) AS la, sha256(ra) AS da, octet_length(encode(rb)) AS lb, sha256(rb) AS db FROM s),
n AS (SELECT *, (row_number() OVER (ORDER BY page_id NULLS FIRST, da) - 1) // 1000 AS file FROM h),
i AS (SELECT *, (sum(la) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, da ROWS UNBOUNDED PRECEDING) - la)::BIGINT AS "offset" FROM n)
SELECT file, "offset", CASE WHEN page_id % 577 = 5 THEN 'missing' ELSE 'changed' END AS status, la || ':' || da || ':1' AS expected,
  CASE WHEN page_id % 577 = 5 THEN NULL ELSE lb || ':' || db || ':1' END AS found, page_id
FROM i WHERE da <> db OR page_id % 577 = 5""")
def op6(spark, sf_dir):
    """The archive of ``pages`` against a replica of it in which some records are altered, cut
    short or lost: every such record is to be located."""
    html, page = F.coalesce(F.col("html"), F.lit("")), F.col("page_id")
    damaged = (F.when(page % 389 == 7, F.left(html, F.expr("int(length(coalesce(html, '')) div 2)")))
               .when((page % 97 == 13) & (html != ""), F.concat(F.lit("X"), F.substring(html, 2, 2**31 - 1))).otherwise(html))
    records = read_table(spark, sf_dir, "pages").select(
        "page_id", *warc.digest_of(warc.warc_record(page, F.col("url"), html)),
        F.struct(*warc.digest_of(warc.warc_record(page, F.col("url"), damaged))).alias("replica"))
    index = materialise(warc.archive_index(records, "page_id"), "warc-index")
    replica = index.where("page_id is null or page_id % 577 <> 5").select("file", "offset", "replica.*")
    return warc.audit(index, replica).join(index.select("file", "offset", "page_id"), ["file", "offset"], "left")


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    found = suffix.repeated_passages(read_table(spark, sf_dir, "documents"), min_words=50)
    return found.select(F.col("id").alias("doc_id"), F.col("begin").alias("first_word"), F.col("stop").alias("end_word"),
                        (F.col("stop") - F.col("begin")).alias("n_words"), F.col("others").alias("other_doc_ids"))


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found, model = whitening.whiten(rows, components=4)
    n, trace, variances = (model.n, model.trace, model.variances) if model else (0, 1.0, [])
    explained = F.element_at(F.array(*[F.lit(float(e / trace)) for e in variances]), F.col("component")) if len(variances) else F.lit(None)
    return found.select(F.col("id").alias("vec_id"), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        explained.cast("double").alias("explained"),
                        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))


@query("op12_phrase_collocations", r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM w, (VALUES (1), (2), (3)) t(size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT *, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM c WHERE size = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""")
def op12(spark, sf_dir):
    return collocations.collocations(read_table(spark, sf_dir, "documents"), max_words=3, min_count=10, keep=2000, cover=50)


@query("op13_minhash_near_dedup", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
c AS (SELECT g, min(doc_id) AS c, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
k AS (SELECT c, n, unnest(g) AS shingle FROM c),
e AS (SELECT a, b FROM (SELECT x.c AS a, y.c AS b, x.n + y.n AS total, count(*) AS common FROM k x JOIN k y ON x.shingle = y.shingle AND x.c <> y.c
    AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL) WHERE 100 * common >= 85 * (total - common)),
r(node, root) AS (SELECT c, c FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(m.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN m ON m.node = c.c""")
def op13(spark, sf_dir):
    return setsketch.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=5, percent=85).withColumnRenamed("id", "doc_id")
