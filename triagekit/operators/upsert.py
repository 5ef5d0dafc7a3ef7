"""Idempotent upserts by key (MERGE without a lakehouse format).

``merge_by_key``: target rows whose key is absent from the batch, plus the
batch (after a last-wins dedupe).  Matched rows are overwritten, unmatched
inserted, nothing deleted.  Result goes to a *new* snapshot directory; the
path being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, maybe_broadcast


def dedupe_last_wins(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep, per key, the row that is last in ``order`` (ascending columns).

    An aggregate (``max_by`` on the order struct) rather than a window: it
    is combined map-side, so a key repeated in a third of the batch costs one
    partial row per task instead of one giant window partition.
    """
    rest = [c for c in batch.columns if c not in key]
    picked = batch.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*batch.columns)


def merge_by_key(target: DataFrame, batch: DataFrame, key: list[str],
                 order: list[str] | None = None) -> DataFrame:
    """Upsert ``batch`` into ``target`` on ``key``; returns the merged table.

    When the batch keys are proven small they are broadcast and the target
    is only scanned; otherwise both sides shuffle once on the key (AQE splits
    skewed key partitions).
    """
    # One row per key in any case: without an order the row with the largest values.
    # Read three times below (count, keys, rows): materialise it once.
    if order:
        batch = dedupe_last_wins(batch, key, order)
    else:
        # (Maps have no order; rows that differ in maps only are alike here.)
        rest = [f.name for f in batch.schema.fields
                if f.name not in key and "map<" not in f.dataType.simpleString()]
        batch = dedupe_last_wins(batch, key, rest or key)
    batch = cut_lineage(batch.select(*target.columns))
    # Batch keys proven small are broadcast, so the target is never shuffled.
    kept = target.join(maybe_broadcast(batch.select(*key)), key, "left_anti")
    return kept.unionByName(batch)


def register_repos(registry: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert-if-absent for (owner, name) pairs.

    Returns ``(to_insert, already_present)``; appending ``to_insert`` to the
    registry is idempotent.
    """
    key = ["repo_owner", "repo_name"]
    req = requests.select(*key).where(F.col("repo_owner").isNotNull() & F.col("repo_name").isNotNull()).distinct()
    reg = registry.select(*key).distinct()
    return req.join(reg, key, "left_anti"), req.join(reg, key, "left_semi")


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a new table snapshot (fails if the path already exists)."""
    df.write.mode("errorifexists").parquet(path)
