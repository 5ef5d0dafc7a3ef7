"""Inverted-file (IVF) cells over the vector collection, and exact search on them.

Cells: each vector is assigned to its nearest centroid.  The index is a
Parquet table partitioned by cell.  Centroids are few (``nlist``), so
shipping them to tasks is bounded by ``nlist × dim`` whatever the corpus.

Exact cell-pruned search (the path for very large query batches): with ``R_c`` the largest distance of a member of cell ``c`` to
its centroid, no member of ``c`` is closer to ``q`` than
``max(0, |q - c| - R_c)``.  Pass 1 probes each query's nearest cells until
they hold ``k`` vectors and takes the k-th distance ``U`` as an upper bound;
pass 2 probes every cell whose lower bound is ≤ ``U``.  A task holds a block
of queries, and the packed members of the cells it probes pass by (see
:mod:`.blocks`); the result equals the brute-force top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, spread, written
from .blocks import PAIR_BYTES, block_count, pack, search, unpacked

DEFAULT_NLIST = 128
_EPS = 1e-9
#: (query, cell) distances of one block of queries.
_PROBES = 8 << 20


def label_centroids(vectors: DataFrame, label_col: str, vec_col: str = "embeddings") -> DataFrame:
    """Centroid per label: mean vector (double), as (cell, centroid array).

    ``Summarizer.mean`` aggregates whole vectors on the JVM (partial
    aggregation per task), instead of exploding every vector into ``dim``
    rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    feats = vectors.select(F.col(label_col).alias("cell"),
                           array_to_vector(F.col(vec_col).cast("array<double>")).alias("_f"))
    m = feats.groupBy("cell").agg(Summarizer.mean(F.col("_f")).alias("_m"))
    return m.select("cell", vector_to_array("_m").alias("centroid"))


def kmeans_centroids(vectors: DataFrame, nlist: int = DEFAULT_NLIST, vec_col: str = "embeddings",
                     seed: int = 7, max_iter: int = 20) -> DataFrame:
    """Centroids trained with Spark ML k-means over the whole collection."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = vectors.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(feats)
    spark = vectors.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cell int, centroid array<double>")


def _centroid_matrix(centroids: DataFrame, max_bytes: int = 256 << 20):
    # Bounded by ``max_bytes``: an index needs centroids that fit one broadcast.
    n, dim = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if n * (dim or 0) * 8 > max_bytes:
        raise ValueError(f"{n} centroids of dim {dim} exceed the broadcast bound")
    rows = sorted(centroids.select("cell", "centroid").collect(), key=lambda r: r[0])
    return (np.array([r[0] for r in rows], dtype=np.int64),
            np.array([r[1] for r in rows], dtype=np.float64))


_BLOCK_ELEMS = 4_000_000


def _sq_dist_to(mat: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """(n_vecs, n_rows) squared distances, folded over dims in order.

    Computed in row blocks so the temporaries stay near ``_BLOCK_ELEMS``
    doubles however many centroids there are.
    """
    out = np.empty((vecs.shape[0], mat.shape[0]))
    step = max(1, _BLOCK_ELEMS // max(mat.shape[0], 1))
    for s in range(0, vecs.shape[0], step):
        v = vecs[s:s + step]
        d = np.zeros((v.shape[0], mat.shape[0]))
        for j in range(mat.shape[1]):
            diff = v[:, j:j + 1] - mat[None, :, j]
            d += diff * diff
        out[s:s + step] = d
    return out


def assign_cells(vectors: DataFrame, centroids, pk_col: str = "pk",
                 vec_col: str = "embeddings") -> DataFrame:
    """(pk, embeddings, cell, radius): nearest centroid (ties → lower cell id).

    ``centroids``: a (cell, centroid) DataFrame or an already collected
    ``(cell ids, matrix)`` pair.
    """
    spark = vectors.sparkSession
    ship_package(spark)  # workers import this module
    cells, cmat = centroids if isinstance(centroids, tuple) else _centroid_matrix(centroids)
    bc = spark.sparkContext.broadcast((cells, cmat))
    schema = T.StructType([
        T.StructField(pk_col, T.LongType()),
        T.StructField(vec_col, vectors.schema[vec_col].dataType),
        T.StructField("cell", T.IntegerType()),
        T.StructField("radius", T.DoubleType())])

    def run(batches):
        ids, mat = bc.value
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            if len(pdf) == 0:
                continue
            v = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            d = _sq_dist_to(mat, v)
            best = np.argmin(d, axis=1)  # first minimum = lowest cell id (ids sorted)
            yield pd.DataFrame({pk_col: pdf[pk_col].astype("int64").to_numpy(),
                                vec_col: pdf[vec_col].to_numpy(),
                                "cell": ids[best].astype("int32"),
                                "radius": np.sqrt(d[np.arange(len(best)), best])})

    return vectors.select(pk_col, vec_col).mapInPandas(run, schema)


def write_index(assigned: DataFrame, centroids: DataFrame, path: str) -> None:
    """Persist an index: vectors by cell, and the centroids that assigned them."""
    assigned.write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/vectors")
    centroids.write.mode("errorifexists").parquet(f"{path}/centroids")


def create_index(vectors: DataFrame, path: str, nlist: int = DEFAULT_NLIST,
                 vec_col: str = "embeddings") -> None:
    """Train the centroids, assign every vector, write the index (the only training)."""
    from .indexing import cut_lineage
    centroids = cut_lineage(kmeans_centroids(vectors, nlist, vec_col))
    write_index(assign_cells(vectors, centroids, vec_col=vec_col), centroids, path)


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(assigned vectors, centroids) of a stored index."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids")


def search_index(spark, path: str, queries: DataFrame, k: int, **options) -> DataFrame:
    """Exact top-k per query from a stored index: nothing is trained or copied."""
    assigned, centroids = read_index(spark, path)
    return knn_l2_cells(assigned, queries, k, centroids=centroids, assigned=assigned, **options)


def misplaced(spark, path: str) -> DataFrame:
    """One row: vectors of a stored index, and those whose stored cell is not the nearest."""
    assigned, centroids = read_index(spark, path)
    again = assign_cells(assigned.select("pk", "embeddings"), centroids).select("pk", F.col("cell").alias("_now"))
    return assigned.select("pk", "cell").join(again, "pk").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.coalesce(F.sum((F.col("cell") != F.col("_now")).cast("long")), F.lit(0)).alias("n_misplaced"))


def _first_probes(bc, k: int, dim: int):
    """mapInArrow body over packed queries: per block the cells nearest to a query of it,
    until these hold ``k`` vectors."""
    def run(batches):
        ids, mat, counts, _ = bc.value
        for batch in batches:
            for part, q, m in zip(*(batch.column(c) for c in ("part", "ids", "mat")), strict=True):
                order = np.argsort(_sq_dist_to(mat, unpacked(q.as_py(), m.as_py(), dim)[1]), axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1)
                near = np.unique(order[held - counts[order] < k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), part.as_py(), np.int32)),
                                                  pa.array(ids[near].astype(np.int32))], ["block", "cell"])
    return run


def _may_serve(dist: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether a cell at plain distance ``dist`` may hold a vector within a squared ``bound``."""
    return np.maximum(dist - radius, 0.0) <= np.sqrt(bound) * (1 + _EPS) + _EPS


def _next_probes(bc, dim: int):
    """mapInArrow body over packed queries with bounds: per block the cells that the triangle
    inequality does not rule out for all its queries."""
    def run(batches):
        ids, mat, counts, radii = bc.value
        for batch in batches:
            for part, q, m, b in zip(*(batch.column(c) for c in ("part", "ids", "mat", "bound")), strict=True):
                dist = np.sqrt(_sq_dist_to(mat, unpacked(q.as_py(), m.as_py(), dim)[1]))
                may = _may_serve(dist, radii[None, :], np.frombuffer(b.as_py())[:, None]).any(0) & (counts > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(may.sum()), part.as_py(), np.int32)),
                                                  pa.array(ids[may].astype(np.int32))], ["block", "cell"])
    return run


def _prune(bc):
    """Per block: the queries that a cell may still serve; None for all."""
    def built(qmat):
        ids, mat, _, radii = bc.value
        dist = np.sqrt(_sq_dist_to(mat, qmat)).T.copy()  # (cells, queries)
        place = {int(c): i for i, c in enumerate(ids)}

        def may(cell, limit):
            i = place[cell]
            rows = np.flatnonzero(_may_serve(dist[i], radii[i], limit))
            return None if len(rows) == len(limit) else rows
        return may
    return built


def knn_l2_cells(vectors: DataFrame, queries: DataFrame, k: int, *, centroids: DataFrame | None = None,
                 pk_col: str = "pk", vec_col: str = "embeddings", query_id_col: str = "query_id",
                 query_vec_col: str = "embedding", squared: bool = True,
                 nlist: int = DEFAULT_NLIST, assigned: DataFrame | None = None,
                 max_block_bytes: int = 64 << 20) -> DataFrame:
    """Exact top-k per query via IVF cells, for query batches of any size.

    Same output as :func:`triagekit.operators.knn.knn_l2`.  Queries of near cells make a
    block of bounded size (their vectors, their k best pairs and their distances to the
    cells), one task's.  The cells nearest to its queries, until these hold k vectors, are
    sent to a block first; the k-th distance found bounds each query, and a second pass
    sends the block the cells that the triangle inequality does not rule out for all its
    queries, and scores each for those it may serve.  Only final rows leave a task.
    ``assigned`` (with its ``centroids``) is a stored index, see :func:`search_index`.
    """
    from .knn import DEFAULT_MAX_HEAP_BYTES, check_queries
    spark = vectors.sparkSession
    total, dim = check_queries(queries, query_id_col, query_vec_col)
    if centroids is None:
        centroids = kmeans_centroids(vectors, nlist, vec_col)
    cells, cmat = _centroid_matrix(centroids)  # bounded by nlist × dim
    if assigned is None:
        assigned = written(assign_cells(spread(vectors), (cells, cmat), pk_col, vec_col), "cells")
    cell_stats = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r"))
    # One row per cell: bounded by nlist.
    stats = {r["cell"]: (r["n"], r["r"]) for r in cell_stats.collect()}
    counts = np.array([stats.get(int(c), (0, 0.0))[0] for c in cells], dtype=np.int64)
    radii = np.nan_to_num([stats.get(int(c), (0, 0.0))[1] for c in cells], nan=np.inf, posinf=np.inf)
    bc = spark.sparkContext.broadcast((cells, cmat, counts, radii))
    per_block = min(DEFAULT_MAX_HEAP_BYTES // (PAIR_BYTES * k), max_block_bytes // (8 * max(dim, 1)),
                    _PROBES // max(len(cells), 1))
    blocks = block_count(total, per_block, spark.sparkContext.defaultParallelism)
    asked = spread(queries.select(F.col(query_id_col).cast("long").alias("id"), F.col(query_vec_col).alias("vec")))
    if dim:  # dim 0: no query has a value
        asked = written(assign_cells(asked, (cells, cmat), "id", "vec").drop("radius"), "queries")
    else:
        asked = asked.limit(0).withColumn("cell", F.lit(0))
    # A cell's queries stand together; blocks are runs of that order.  One row per cell.
    own = sorted((r["cell"], r["count"]) for r in asked.groupBy("cell").count().collect())
    start = np.cumsum([0, *(n for _, n in own)]).tolist()
    size = max(1, -(-start[-1] // blocks))
    begin = spark.createDataFrame([(int(c), int(a), int(n)) for (c, n), a in zip(own, start, strict=False)],
                                  "cell int, _a long, _n long")
    part = ((F.col("_a") + F.pmod(F.xxhash64("id"), F.col("_n"))) / F.lit(size)).cast("int")
    q = pack(asked.join(F.broadcast(begin), "cell").select(part.alias("part"), "id", "vec"), dim)
    members = assigned.select(F.col("cell").alias("part"), F.col(pk_col).cast("long").alias("id"),
                              F.col(vec_col).alias("vec")).sortWithinPartitions("part")
    chunks = pack(members, dim) if dim else pack(members.limit(0), dim)

    def sent(probes: DataFrame) -> DataFrame:
        # A row a cell, with at most all blocks.
        to = probes.groupBy("cell").agg(F.collect_set("block").alias("to"))
        j = chunks.join(F.broadcast(to), chunks["part"] == to["cell"])
        return j.select(F.explode("to").alias("block"), "cell", "ids", "mat")

    pairs = "block int, cell int"
    bounded = written(search(q, sent(q.mapInArrow(_first_probes(bc, k, dim), pairs)), blocks, k, dim, first_pass=True), "bounds")
    out = search(bounded, sent(bounded.mapInArrow(_next_probes(bc, dim), pairs)), blocks, k, dim, prune=_prune(bc))
    if not squared:
        out = out.withColumn("distance", F.sqrt("distance"))
    return out.withColumnRenamed("query_id", query_id_col) if query_id_col != "query_id" else out
