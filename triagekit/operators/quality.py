"""Declarative data-quality suite evaluated as Spark aggregates.

A suite is data: a list of ``{"expectation_type": ..., "kwargs": {...}}``.
All not-null checks share one aggregate pass; all uniqueness checks share
one hash-count shuffle (columns unpivoted to (column, hash) and counted
together, map-side partial counts) plus an exact recount of the rows whose
hash repeats.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import maybe_broadcast

# The issue-table suite.
ISSUE_SUITE = [
    {"expectation_type": "expect_table_row_count_to_be_between",
     "kwargs": {"max_value": 10000, "min_value": 1}},
    {"expectation_type": "expect_table_columns_to_match_set",
     "kwargs": {"column_set": ["TITLE", "CREATED_BY", "ISSUE_URL", "ID", "BODY", "STATE",
                               "UPDATED_AT", "REPO_NAME", "ISSUE_NUMBER", "REPO_OWNER"]}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "ID"}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "ISSUE_URL"}},
] + [
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": c}}
    for c in ["ID", "ISSUE_URL", "REPO_OWNER", "REPO_NAME", "ISSUE_NUMBER", "CREATED_BY",
              "TITLE", "STATE", "UPDATED_AT"]
]

RESULT_SCHEMA = T.StructType([
    T.StructField("expectation_type", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("element_count", T.LongType()),
    T.StructField("unexpected_count", T.LongType()),
    T.StructField("observed", T.StringType()),
])

EXTRACT_COLUMNS = ["ID", "ISSUE_URL", "REPO_OWNER", "REPO_NAME", "ISSUE_NUMBER",
                   "CREATED_BY", "TITLE", "BODY", "STATE", "UPDATED_AT"]


def dq_extract(issues: DataFrame) -> DataFrame:
    """The ten-column projection the suite validates (pruned at the scan)."""
    return issues.select(*[F.col(c.lower()).alias(c) for c in EXTRACT_COLUMNS])


def _unpivot(df: DataFrame, columns: list[str], value_expr) -> DataFrame:
    pairs = ", ".join(f"'{c}', {value_expr(c)}" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, value)")


def _table_pass(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate over the table: row count and null count per column."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.sum(F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0)).alias(f"_n{i}")
        for i, c in enumerate(columns)]
    return df.agg(*aggs)


def not_null_results(df: DataFrame, columns: list[str], one: DataFrame | None = None) -> DataFrame:
    """Null count of each column from one aggregate pass (``one`` if given)."""
    if one is None:
        one = _table_pass(df, columns)
    long_ = one.selectExpr(
        "_rows", "stack({n}, {p}) AS (column, nulls)".format(
            n=len(columns), p=", ".join(f"'{c}', _n{i}" for i, c in enumerate(columns))))
    return long_.select(
        F.lit("expect_column_values_to_not_be_null").alias("expectation_type"), "column",
        (F.coalesce(F.col("nulls"), F.lit(0)) == 0).alias("success"),
        F.col("_rows").cast("long").alias("element_count"),
        F.coalesce(F.col("nulls"), F.lit(0)).cast("long").alias("unexpected_count"),
        F.lit(None).cast("string").alias("observed"))


def unique_results(df: DataFrame, columns: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Rows whose non-null value occurs more than once, per column — exact.

    Phase 1 counts 64-bit hashes per (column, hash): only hashes are shuffled,
    however long the values (issue bodies).  Phase 2 counts exact values, but
    only for rows whose hash occurs more than once (true duplicates plus rare
    collisions), so hash collisions cannot change the result.  The repeated
    hashes are broadcast when small; when they are many, both sides shuffle on the
    hash.  Both aggregations combine map-side, so a hot value is cheap.
    """
    if rows is None:
        rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    vals = _unpivot(df, columns, lambda c: f"CAST(`{c}` AS STRING)").where(F.col("value").isNotNull())
    hashed = vals.withColumn("_h", F.xxhash64("column", "value"))
    dup_h = (hashed.groupBy("column", "_h").agg(F.count(F.lit(1)).alias("_c"))
             .where(F.col("_c") > 1).select("column", "_h"))
    cand = hashed.join(maybe_broadcast(dup_h, materialize=True), ["column", "_h"], "left_semi")
    per_value = cand.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per_col = per_value.groupBy("column").agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("long").alias("unexpected_count"))
    cols = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    per_col = cols.join(per_col, "column", "left")
    return per_col.select(
        F.lit("expect_column_values_to_be_unique").alias("expectation_type"), "column",
        (F.coalesce(F.col("unexpected_count"), F.lit(0)) == 0).alias("success"),
        rows.select(F.col("_rows").cast("long")).scalar().alias("element_count"),
        F.coalesce(F.col("unexpected_count"), F.lit(0)).cast("long").alias("unexpected_count"),
        F.lit(None).cast("string").alias("observed"))


def run_suite(df: DataFrame, suite: list[dict] = ISSUE_SUITE) -> DataFrame:
    """Evaluate a suite; one result row per expectation, never raises on failure."""
    spark = df.sparkSession
    parts: list[DataFrame] = []
    uniq = [e["kwargs"]["column"] for e in suite
            if e["expectation_type"] == "expect_column_values_to_be_unique"]
    nn = [e["kwargs"]["column"] for e in suite
          if e["expectation_type"] == "expect_column_values_to_not_be_null"]
    # Row count and every null count come from one scan; the branches below
    # read that single-row result (its exchange is reused, not recomputed).
    have = set(df.columns)
    for kind, names in (("expect_column_values_to_be_unique", uniq), ("expect_column_values_to_not_be_null", nn)):
        absent = [c for c in names if c not in have]
        if absent:  # an expectation on a column that is not there fails
            parts.append(spark.createDataFrame(
                [(kind, c, False, None, None, "column not found") for c in absent], RESULT_SCHEMA))
    uniq, nn = ([c for c in names if c in have] for names in (uniq, nn))
    one = _table_pass(df, nn)
    if uniq:
        parts.append(unique_results(df, uniq, one))
    if nn:
        parts.append(not_null_results(df, nn, one))
    for e in suite:
        t, kw = e["expectation_type"], e["kwargs"]
        if t == "expect_table_row_count_to_be_between":
            n = F.col("_rows")
            ok = F.lit(True)
            if kw.get("min_value") is not None:
                ok = ok & (n >= kw["min_value"])
            if kw.get("max_value") is not None:
                ok = ok & (n <= kw["max_value"])
            parts.append(one.select(
                F.lit(t).alias("expectation_type"), F.lit(None).cast("string").alias("column"),
                ok.alias("success"), n.cast("long").alias("element_count"),
                F.lit(None).cast("long").alias("unexpected_count"),
                n.cast("string").alias("observed")))
        elif t == "expect_table_columns_to_match_set":
            ok = set(kw["column_set"]) == set(df.columns)
            parts.append(spark.createDataFrame(
                [(t, None, ok, None, None, ", ".join(sorted(df.columns)))], RESULT_SCHEMA))
        elif t not in ("expect_column_values_to_be_unique", "expect_column_values_to_not_be_null"):
            raise ValueError(f"unsupported expectation {t}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_run_name(results: DataFrame, run_time: dt.datetime | None = None) -> DataFrame:
    """Tag results with the checkpoint's run name (``%Y%m%d-%H%M%S``)."""
    run_time = run_time or dt.datetime.now(dt.timezone.utc)
    return results.withColumn("run_name", F.lit(run_time.strftime("%Y%m%d-%H%M%S")))


def store_results(results: DataFrame, path: str) -> None:
    """Append a validation run to the result store (Parquet, by run name)."""
    results.write.mode("append").partitionBy("run_name").parquet(path)


def read_results(spark, path: str, run_name: str | None = None) -> DataFrame:
    """The result store; with ``run_name`` only that run's folder is read."""
    stored = spark.read.schema(T.StructType([*RESULT_SCHEMA.fields, T.StructField("run_name", T.StringType())])).parquet(path)
    return stored if run_name is None else stored.where(F.col("run_name") == run_name)
