"""Issue-table reads: point lookups in batch, pagination, registry pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast

# REST page sizes.
UI_PAGE_SIZE = 10
INGEST_PAGE_SIZE = 100
HIGH_WATER_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def lookup_closed(issues: DataFrame, lookups: DataFrame) -> DataFrame:
    """Batch form of the closed-issue lookup by id with optional owner/repo.

    ``lookups``: ``id`` and nullable ``owner, repo`` (null or "" = any).
    Every lookup row is returned, with ``issue_url, title`` null when no
    closed issue matches.  A plain equi-join on id plus residual filters.
    """
    # Semi-join reduction: only issues whose id is looked up reach the outer
    # join; with a small lookup batch the issue table is filtered by a
    # broadcast semi join and never shuffled.
    ids = maybe_broadcast(lookups.select(F.col("id").alias("_id")).distinct())
    closed = issues.where(F.col("state") == "closed").select(
        F.col("id").alias("_id"), "issue_url", "title",
        F.col("repo_owner").alias("_o"), F.col("repo_name").alias("_r")).join(ids, "_id", "left_semi")
    own = F.coalesce(F.col("owner"), F.lit(""))
    rep = F.coalesce(F.col("repo"), F.lit(""))
    cond = ((F.col("id") == F.col("_id")) & ((own == "") | (own == F.col("_o")))
            & ((rep == "") | (rep == F.col("_r"))))
    return lookups.join(closed, cond, "left").drop("_id", "_o", "_r")


def open_issues_page(issues: DataFrame, page: int, per_page: int = UI_PAGE_SIZE) -> DataFrame:
    """Page ``page`` (1-based) of each repo's open issues, newest id first.

    ``row_number <= page * per_page`` lets Catalyst insert a partial
    WindowGroupLimit before the shuffle, so even a repo holding most of the
    table ships only page*per_page rows per task.
    """
    w = Window.partitionBy("repo_owner", "repo_name").orderBy(F.col("id").desc())
    lo, hi = (page - 1) * per_page, page * per_page
    ranked = (issues.where(F.col("state") == "open")
              .select("repo_owner", "repo_name", "id", "title", "issue_url")
              .withColumn("rank", F.row_number().over(w)))
    return ranked.where(F.col("rank") <= hi).where(F.col("rank") > lo)


def repo_pairs(df: DataFrame) -> DataFrame:
    """Distinct (owner, name) pairs."""
    return df.select("repo_owner", "repo_name").distinct()


def owner_repos(df: DataFrame) -> DataFrame:
    """Owner → sorted distinct repo names (array)."""
    return (repo_pairs(df).groupBy("repo_owner")
            .agg(F.array_sort(F.collect_list("repo_name")).alias("repos")))


def high_water(issues: DataFrame) -> DataFrame:
    """Per repo: max(updated_at) and the next pull's ``since`` (max + 1 s, ISO Z)."""
    hw = issues.groupBy("repo_owner", "repo_name").agg(F.max("updated_at").alias("high_water"))
    return hw.withColumn(
        "since", F.date_format(F.col("high_water") + F.expr("INTERVAL 1 SECOND"), HIGH_WATER_FORMAT))


def merge_high_water(previous: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Roll per-repo high-water marks forward with a batch of upserted rows.

    Equals :func:`high_water` of the table after the upsert as long as rows
    only move forward in time, but reads only the batch and the small
    high-water table, not the whole issue table.
    """
    key = ["repo_owner", "repo_name"]
    b = batch.groupBy(*key).agg(F.max("updated_at").alias("high_water"))
    if previous is not None:
        b = previous.select(*key, "high_water").unionByName(b).groupBy(*key).agg(
            F.max("high_water").alias("high_water"))
    return b.withColumn(
        "since", F.date_format(F.col("high_water") + F.expr("INTERVAL 1 SECOND"), HIGH_WATER_FORMAT))
