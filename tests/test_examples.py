"""The example programs run end to end on driver-table inputs."""

import importlib.util
import os

from pyspark.sql import functions as F

from triagekit.sources import fixtures as fx
from conftest import ROOT, SF_SMALL


def _load(name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, "examples", f"{name}.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_daily_refresh_then_search(spark, tmp_dir):
    from triagekit.operators.ingest import flatten_issues
    raw = fx.raw_issues_fx(spark, SF_SMALL)
    flatten_issues(raw).write.parquet(f"{tmp_dir}/issues")
    newer = raw.where("id % 4 = 1").withColumn("updated_at", F.lit("2030-01-01T00:00:00Z"))
    newer.write.json(f"{tmp_dir}/landed")
    fx.vectors_fx(spark, SF_SMALL).where("pk < 0").write.parquet(f"{tmp_dir}/vectors")  # empty store
    res = _load("daily_refresh").refresh(spark, f"{tmp_dir}/issues", f"{tmp_dir}/landed",
                                         f"{tmp_dir}/vectors", f"{tmp_dir}/out")
    assert res["fresh"] == newer.count() and res["issues"] == raw.count()
    assert res["vectors"] == newer.count()
    assert spark.read.parquet(f"{tmp_dir}/out/quality").count() == 13
    # search with the texts of some stored issues: each finds itself
    spark.read.parquet(f"{tmp_dir}/out/issues").where("id % 4 = 1").select(
        F.col("id").alias("query_id"), F.col("body").alias("text")).write.parquet(f"{tmp_dir}/queries")
    out = _load("search").search(spark, f"{tmp_dir}/out/issues", f"{tmp_dir}/out/vectors",
                                 f"{tmp_dir}/queries", f"{tmp_dir}/res")
    m = spark.read.parquet(f"{tmp_dir}/res/matches")
    closed = {r["id"] for r in spark.read.parquet(f"{tmp_dir}/out/issues").where("state = 'closed'").collect()}
    selfs = {r["query_id"] for r in m.where("query_id = id and similarity = 100.0").collect()}
    queried = {r["query_id"] for r in spark.read.parquet(f"{tmp_dir}/queries").collect()}
    assert selfs == queried & closed
    assert out["prompts"] + len({r["query_id"] for r in m.collect()}) == len(queried)
