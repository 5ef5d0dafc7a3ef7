"""Exact L2 nearest-neighbour search: top-k vectors per query.

Plan shape::

    queries ─ packed by block ┐
                              ├ Exchange (block) ─ mapInArrow (top-k per query, final)
    vectors ─ packed, × blocks┘

A block of queries is one task's, and all vectors pass it, see :mod:`.blocks`.  The corpus
crosses the network once a block; of candidates only the final ``queries × k`` rows leave a
task.  Query batches over ``max_query_bytes`` take the cell-pruned path in
:mod:`triagekit.operators.ivf`, which sends a block only the cells that may serve it.

Distances are squared L2 by default (what an L2 vector index reports) and
are accumulated dimension by dimension in double, the same left fold as
the SQL form :func:`l2_distance`, so both give bit-identical values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread, written
from .blocks import PAIR_BYTES, block_count, pack, search

DEFAULT_MAX_QUERY_BYTES = 64 << 20
# Above queries × k best pairs, search in two passes (see knn_l2).
DEFAULT_MAX_CANDIDATE_ROWS = 20_000_000
#: (distance, id) pairs a task holds for all queries of a block, while it sorts them.
DEFAULT_MAX_HEAP_BYTES = 128 << 20


def l2_distance(a: Column | str, b: Column | str, squared: bool = True) -> Column:
    """Column expression: (squared) L2 distance of two float arrays, in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    diff2 = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                       * (x.cast("double") - y.cast("double")))
    d = F.aggregate(diff2, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return d if squared else F.sqrt(d)


def check_queries(queries: DataFrame, id_col: str, vec_col: str) -> tuple[int, int]:
    """(rows, dim) of a query batch, from one aggregate; the same check for every path.

    Ids must be unique and not null, and vectors of one dimension (a null vector has no
    hits).
    """
    size = F.when(F.col(vec_col).isNotNull(), F.size(vec_col))
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"),
                      F.max(size).alias("dim"), F.min(size).alias("low")).first()
    if row["n"] != row["ids"]:
        raise ValueError(f"{row['n']} queries have {row['ids']} distinct ids")
    if row["dim"] != row["low"]:
        raise ValueError(f"query vectors have dimensions {row['low']} to {row['dim']}")
    return int(row["n"]), int(row["dim"] or 0)


def knn_l2(vectors: DataFrame, queries: DataFrame, k: int, *,
           pk_col: str = "pk", vec_col: str = "embeddings",
           query_id_col: str = "query_id", query_vec_col: str = "embedding",
           squared: bool = True,
           max_query_bytes: int = DEFAULT_MAX_QUERY_BYTES,
           max_candidate_rows: int = DEFAULT_MAX_CANDIDATE_ROWS,
           max_heap_bytes: int = DEFAULT_MAX_HEAP_BYTES) -> DataFrame:
    """Top-k nearest vectors per query, ascending distance, ties by pk.

    Returns ``(query_id, pk, distance, rank)``; ``rank`` starts at 1.
    Exact: every vector is scored against every query of the batch.

    A task holds a block of queries, whose best pairs take up to ``max_heap_bytes``, and
    every packed chunk of the corpus is sent to every block; what leaves a task is final.
    A batch of more than ``max_candidate_rows`` best pairs is searched in two passes: the
    first scores every eighth chunk, and the k-th distance found there (it is k real
    distances) bounds what the second, over all chunks, keeps.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    ship_package(vectors.sparkSession)  # workers import this module
    n, dim = check_queries(queries, query_id_col, query_vec_col)
    if n * max(dim, 1) * 8 > max_query_bytes:
        from .ivf import knn_l2_cells  # a batch so large may be worth an index
        return knn_l2_cells(vectors, queries, k, pk_col=pk_col, vec_col=vec_col,
                            query_id_col=query_id_col, query_vec_col=query_vec_col,
                            squared=squared)
    blocks = block_count(n, max_heap_bytes // (PAIR_BYTES * k), vectors.sparkSession.sparkContext.defaultParallelism)
    q = queries.select(F.pmod(F.xxhash64(query_id_col), F.lit(blocks)).cast("int").alias("part"),
                       F.col(query_id_col).cast("long").alias("id"), F.col(query_vec_col).alias("vec"))
    q = pack(q, dim)
    corpus = spread(vectors.select(F.lit(0).alias("part"), F.col(pk_col).cast("long").alias("id"), F.col(vec_col).alias("vec")))
    corpus = pack(corpus if dim else corpus.where(F.size("vec") == 0), dim)  # dim 0: no query has a value
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    if n * k > max_candidate_rows:
        # The chunk's own bytes choose it: the same in every run.
        some = corpus.where(F.pmod(F.xxhash64("ids"), F.lit(8)) == 0)
        q = written(search(q, some.select(every, F.lit(0).alias("cell"), "ids", "mat"), blocks, k, dim, first_pass=True), "bounds")
    out = search(q, corpus.select(every, F.lit(0).alias("cell"), "ids", "mat"), blocks, k, dim)
    if not squared:
        out = out.withColumn("distance", F.sqrt("distance"))
    return out.withColumnRenamed("query_id", query_id_col) if query_id_col != "query_id" else out
