"""Corpus pipeline: toxicity, near duplicates, secrets, source mix, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread
as the next stage's ``docs``.  All but the last return the columns of ``documents``:

* toxicity: documents whose expected severity reaches the mark go;
* near duplicates: one row of each SimHash component stays, null and repeated ids included;
* secrets: every span found is replaced by a mark, so the secrets don't reach training;
* mix: documents of the seeded epochs that fill each source's budget (a document drawn for
  a second epoch comes twice; a prefix's last document stays whole);
* packing: the place of every piece of every document in sequences of the permitted lengths.

The columns of ``documents`` may hold nulls; each operator's docstring defines what they mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, packing, secret_scan, simhash, toxicity
from tessera.llm.common import materialise
from tessera.llm.queries import MIX_BUDGET, MIX_EPOCHS, MIX_LEVELS, MIX_SEED, MIX_WEIGHTS, PACK_LENGTHS
from tessera.session import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle_words=3, max_distance=2, null_ids_stay=False)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, plan = mixing.mix_plan(docs, MIX_LEVELS, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED, by_row=True)
    return mixing.mix_documents(docs, plan, MIX_LEVELS, MIX_SEED, by_row=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, PACK_LENGTHS).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", mask_secrets),
          ("mix", mix), ("packing", pack)]

#: the severity model and the character models are fitted in Python: no SQL states run()'s rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
