"""Dense sequential ids without funnelling rows through one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written

#: Rows of one window of a prefix scan; a chunk with more is split by rows.
CHUNK_ROWS = 100_000


def with_sequential_index(df: DataFrame, order_by: list, name: str = "seq",
                          start: int = 0) -> DataFrame:
    """Add ``name`` = start + 0-based position of the row in ``order_by`` order.

    Range-partitioned sort, then each row's position is the row count of all
    earlier partitions plus its offset inside its own partition.  The sorted,
    tagged rows are checkpointed first so a recomputation after an executor
    loss cannot reassign partitions.  Only one row per partition reaches the
    offset window, so no data row is funnelled through a single task.
    """
    tagged = (df.orderBy(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a global window over it is bounded by the
    # partition count, not by the data.
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.lit(start).cast("long") + F.col("_off") + local)
            .drop("_pid", "_mono", "_off"))


def split_chunks(df: DataFrame, group: list[str], order: list, chunk, max_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` (a value that does not fall along ``order`` inside a group) and
    ``_part``: (group, _chunk, _part) holds about ``max_rows`` rows at most and follows
    ``order``, however many rows share one chunk, or one instant.

    Chunks are counted first, combined map-side.  Only rows of chunks above the bound are
    range-partitioned along the order (their number is at most rows / ``max_rows``, so they
    meet the rows in a broadcast); a partition's number is the part.  Those rows are
    written, so that a recomputation cannot cut them elsewhere.
    """
    d = df.withColumn("_chunk", chunk)
    key = [*group, "_chunk"]
    hot = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    hot = cut_lineage(hot)
    rows = hot.agg(F.sum("_n")).first()[0]
    if not rows:
        return d.withColumn("_part", F.lit(0))
    # Twice as many ranges as needed: their borders come from a sample.
    marked = d.join(F.broadcast(hot.select(*key, F.lit(True).alias("_hot"))), key, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").withColumn("_part", F.lit(0))
    many = marked.where(F.col("_hot")).drop("_hot").repartitionByRange(-(-2 * rows // max_rows), *group, *order)
    many = written(many.withColumn("_part", F.spark_partition_id() + 1), "ranges")
    return cold.unionByName(many.select(*cold.columns))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str,
                chunk, name: str = "running", max_rows: int = CHUNK_ROWS) -> DataFrame:
    """Inclusive running sum of ``value`` per group, as a two-level prefix scan.

    ``chunk`` must be non-decreasing along ``order`` inside a group (a time bucket, for
    instance).  Group columns must be non-null: the offsets are joined back with plain
    equality so the join reuses the window's hash partitioning instead of shuffling the
    rows again.  Rows are summed inside (group, chunk, part) windows of a bounded number of
    rows (:func:`split_chunks`) and shifted by the totals of earlier parts, which come from
    one summary row per part; a group holding a large share of the data is thus spread over
    many tasks, even if all its rows share one chunk.
    """
    d = split_chunks(df, group, order, chunk, max_rows)
    key = [*group, "_chunk", "_part"]
    w = (Window.partitionBy(*key).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_local", F.sum(value).over(w))
    tot = d.groupBy(*key).agg(F.sum(value).alias("_tot"))
    before = Window.partitionBy(*group).orderBy("_chunk", "_part").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_tot").over(before), F.lit(0)))
    j = d.join(tot.select(*key, "_off"), key)
    return j.withColumn(name, F.col("_off") + F.col("_local")).drop("_chunk", "_part", "_local", "_off")
