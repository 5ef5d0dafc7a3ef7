"""The training-data pipeline: five operators of ``triagekit.llm`` in a row.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read back as the next stage's ``docs``.  All but the last return the
columns of ``documents``; the last adds each row's shard and slot.

* quality_rules: rows that the base rule or the outlier test rejects go.
* near_dedup: one document of each group of near-duplicates stays (that of the
  smallest id), and every document without words.
* decontamination: hit spans are cut out of the text (``n_chars`` follows); documents
  without a hit stay as they are.
* mixing: one row per epoch a document is taken in, whole documents.
* sharding: 40 shards whose row counts are at most one apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from triagekit.llm.common import drop_scratch, scratch_tables
from triagekit.session import checkpoint_dir
from triagekit.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontamination.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return out
    kind = dict(docs.dtypes)["n_chars"]
    return out.select(*[F.coalesce(F.char_length("text"), F.lit(0)).cast(kind).alias(c) if c == "n_chars"
                        else F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Signatures, covariance estimates and hashes have no SQL form; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        others = scratch_tables(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_scratch(spark, keep=others)  # the stage's own, as its result is written
    return docs
