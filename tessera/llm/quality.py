"""Host-level quality rules.

Each document is measured by a set of rules; the failures of a rule are counted per host, and a
host's failure rate is shrunk towards the rate over all hosts with a beta prior estimated from
the hosts themselves (method of moments on the between-host variance).  A host fails when a
shrunk rate exceeds ``MAX_RATE``; its documents aren't kept, nor are documents that fail the
base rules.  A small host thus needs many failures before it falls with its documents.

Everything is DataFrame code; repeated five-word windows are found by their 64-bit hashes
within a document (no shuffle; two different windows of one document would have to share a
hash to be mistaken for each other).  Per host only counts are moved.

Defined cases: null texts have no words (and fail the base rules); null hosts are one host;
repeated rows count each; a single host, or rules that all hosts fail alike, get the widest
prior (``PRIOR`` documents); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, small

WINDOW = 5
MAX_RATE = 0.5
#: documents that the prior weighs, least and most
PRIOR = (1.0, 10_000.0)
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # each step names what the next refers to more than once, so nothing is computed twice
    step = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"),
                       F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
                       F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD))).alias("lines"))
    window = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, WINDOW)]))
    step = step.select("id", "host", F.size("words").cast("bigint").alias("n_words"),
                       F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                       (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                       F.size("lines").cast("bigint").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                       F.slice(window, 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))).alias("hashes"))
    rest = [c for c in step.columns if c != "hashes"]
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    step = step.select(*rest, F.when(repeats, F.sort_array(F.transform(
        "hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    twice = F.filter("sorted", lambda x, i: F.coalesce(x["h"] == F.get("sorted", i - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get("sorted", i + 1)["h"], F.lit(False)))
    step = step.select(*rest, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))),
                          F.lit(0).cast("bigint"), lambda a, b: a + b)
    return step.select(*rest, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

#: the rules whose failures are counted per host, as SQL conditions on the measures
RULES: dict[str, str] = {
    "base": BASE_FAILED,
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


def beta_prior(hosts: int, documents: float, squares: float, failures: float, weighed: float) -> tuple[float, float]:
    """(alpha, beta) from the number of hosts, and the sums over hosts of documents, their
    squares, failures f and f*f/n: the between-host correlation by the method of moments."""
    if not documents:
        return PRIOR[1] / 2, PRIOR[1] / 2
    mean = failures / documents
    spread, expected = weighed - failures * mean, hosts - 1
    room = documents - squares / documents - expected
    rho = ((spread / (mean * (1 - mean)) - expected) / room) if 0 < mean < 1 and room > 0 else 0.0
    size = min(max((1 - rho) / rho if rho > 0 else PRIOR[1], PRIOR[0]), PRIOR[1])
    return mean * size, (1 - mean) * size


def host_rates(measured: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(host, n, rate_<rule>...): the shrunk failure rates per host (null host included)."""
    rules = rules or RULES
    hosts = materialise(measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.expr(c).cast("int")).alias(f"f_{r}") for r, c in rules.items()]),
                        "quality-hosts")
    sums = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
                     *[x for r in rules for x in (F.sum(f"f_{r}").alias(f"f_{r}"),
                                                  F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n")).alias(f"w_{r}"))]).first()
    rates = []
    for r in rules:
        a, b = beta_prior(sums["k"], sums["n"] or 0, sums["nn"] or 0, sums[f"f_{r}"] or 0, sums[f"w_{r}"] or 0)
        rates.append(((F.col(f"f_{r}") + a) / (F.col("n") + a + b)).alias(f"rate_{r}"))
    return hosts.select("host", "n", *rates)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures of every row, with base_failed, host_failed and kept."""
    measured = materialise(measures(docs, id_col, text_col, host_col), "quality-measures")
    rates = host_rates(measured)
    failed = materialise(rates.where(F.greatest(*[F.col(c) for c in rates.columns if c.startswith("rate_")], F.lit(0.0)) > MAX_RATE)
                         .select(F.coalesce(F.concat(F.lit("="), "host"), F.lit("null")).alias("key"), F.lit(True).alias("bad")), "quality-failed")
    return (measured.withColumn("key", F.coalesce(F.concat(F.lit("="), "host"), F.lit("null"))).join(small(failed), "key", "left")
            .withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("host_failed", F.coalesce("bad", F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("key", "bad"))
