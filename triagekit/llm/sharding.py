"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into 65,536 equal cells; every shard stands at ``vnodes`` points of
it and owns the cells up to each of its points.  A row's key falls into one cell.  A
shard takes at most its load bound; keys over it continue clockwise to the next
virtual node whose shard has room.  With the bounds summing to the number of rows
(one more row for the first ``rows mod shards`` shards) the counts end at most one
apart, and only overflowing keys leave the shard the plain ring gives them.

Only counts per cell reach the driver (at most 65,536 rows however large the table);
rows are ranked inside their cell, so no task holds more than a 65,536th of the
keys, and the placements come back as a broadcast table of at most
``cells + vnodes * shards + shards`` rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring_owners(spark, n_shards: int, vnodes: int) -> list[tuple[int, int, int]]:
    """Virtual nodes in ring order: (shard, first cell, last cell); a last cell below
    the first is an empty arc.  The last node's arc wraps, so it also ends the list."""
    points = (spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
              .select("shard", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
              .select("shard", F.xxhash64(F.lit("vnode"), "shard", "v").alias("h")).collect())
    # One point per entry: at most n_shards * vnodes rows, a parameter.
    at = sorted(((r.h & 0xFFFFFFFFFFFFFFFF) >> (64 - CELL_BITS), r.h, r.shard) for r in points)
    arcs, first = [], 0
    for cell, _, shard in at:
        arcs.append((shard, first, cell))
        first = max(first, cell + 1)
    arcs.append((at[0][2], first, CELLS - 1))  # beyond the last point: the first node again
    return arcs


def place(counts: dict[int, int], arcs: list[tuple[int, int, int]], n_shards: int
          ) -> list[tuple[int, int, int, int, int]]:
    """(cell, rank from, rank to, shard, first slot) for all counted rows."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    filled = [0] * n_shards
    nodes = len(arcs)
    node_of_shard = defaultdict(list)
    for i, (s, _, _) in enumerate(arcs):
        node_of_shard[s].append(i)
    after = list(range(nodes + 1))  # next node at or after i whose shard may have room

    def find(i: int) -> int:
        root = i
        while after[root] != root:
            root = after[root]
        while after[i] != root:
            after[i], i = root, after[i]
        return root

    out: list[tuple[int, int, int, int, int]] = []

    def put(shard: int, cell: int, lo: int, want: int) -> int:
        take = min(want, room[shard] - filled[shard])
        if take:
            out.append((cell, lo, lo + take, shard, filled[shard]))
            filled[shard] += take
            if filled[shard] == room[shard]:
                for i in node_of_shard[shard]:
                    after[i] = i + 1
        return take

    over: list[tuple[int, int, int, int]] = []  # node, cell, rank, rows left
    for i, (shard, first, last) in enumerate(arcs):
        for cell in range(first, last + 1):
            n = counts.get(cell, 0)
            if n and (took := put(shard, cell, 0, n)) < n:
                over.append((i, cell, took, n - took))
    for s in range(n_shards):
        if room[s] == 0:
            for i in node_of_shard[s]:
                after[i] = i + 1
    for i, cell, lo, left in over:  # clockwise from the home node
        while left:
            j = find(i)
            if j == nodes:
                j = find(0)
            took = put(arcs[j][0], cell, lo, left)
            lo, left, i = lo + took, left - took, j
    return out


def shard_documents(docs: DataFrame, n_shards: int = 40, vnodes: int = 128, id_col: str = "doc_id",
                    text_col: str = "text", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (0 to n-1) and ``slot`` (gapless from 0).

    The key is the id and the checksum of the text, so rows of one id with
    different texts spread too; nulls hash like any value; repeated rows are
    interchangeable and each gets a slot of its own.  An empty table gives an empty
    result.  Input columns with the result's names are replaced; others may have any name.
    """
    spark = docs.sparkSession
    cols = [c for c in docs.columns if c not in (shard_col, slot_col)]
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{id_col}`").alias("__id"),
                    crc.alias("__crc"))
    d = d.withColumn("__h", F.xxhash64(F.lit("key"), F.coalesce(F.col("__id").cast("string"), F.lit("")), "__crc"))
    cell = F.shiftrightunsigned("__h", 64 - CELL_BITS).cast("int")
    d = d.withColumn("__cell", cell)
    counts = {r["__cell"]: r["count"] for r in d.groupBy("__cell").count().collect()}  # at most CELLS rows
    plan = place(counts, ring_owners(spark, n_shards, vnodes), n_shards)
    moves = spark.createDataFrame(plan, "__c int, __lo long, __hi long, __shard int, __first long")
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy("__h", "__id", "__crc")) - 1
    placed = d.withColumn("__rank", rank.cast("long")).join(
        F.broadcast(moves), (F.col("__cell") == F.col("__c")) & (F.col("__rank") >= F.col("__lo"))
        & (F.col("__rank") < F.col("__hi")))
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in cols], F.col("__shard").alias(shard_col),
                         (F.col("__first") + F.col("__rank") - F.col("__lo")).alias(slot_col))


def shard_digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Narrow first: only the id, size and checksum of each text reach the shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_documents(narrow.withColumn("__key", F.col("text_crc32").cast("string")), n_shards,
                          text_col="__key")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
