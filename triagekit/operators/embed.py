"""Issue embeddings: tokens → vocabulary ids (:mod:`.vocabulary`) → chunks → vectors → mean.

The default model is a hashed bag of tokens: each chunk's vector holds, per
bucket ``md5(token)[0:4] mod dim``, the share of the chunk's tokens that
fall in the bucket.  It is computed inside the document's row, without a
shuffle.  A neural model plugs
in through :func:`embed_chunks_with_model` (Arrow batches, model loaded once
per Python worker).  Either way the document vector is the unweighted mean
of its chunk vectors, and a document without tokens gets the zero vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import CHUNK_SIZE, chunk_array, clean_tokens, n_chunks
from ..session import ship_package, spread

# Fixed-point scale used when exact integer weights are requested.
FIXED_POINT = 1_000_000


def chunk_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = CHUNK_SIZE) -> DataFrame:
    """(id, chunk_no, n_tokens) per chunk — arithmetic on the token count, no shuffle."""
    n = F.size(clean_tokens(F.col("_text")))
    base = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))).select(
        "id", n.alias("_n"))
    k = n_chunks(F.col("_n"), size)
    # No filter on the derived count (it would be pushed below the projection
    # and re-run the regex); an empty sequence explodes to nothing instead.
    chunks = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    return base.select("id", F.explode(chunks).alias("chunk_no"), "_n").select(
        "id", "chunk_no",
        F.least(F.lit(size), F.col("_n") - F.col("chunk_no") * size).cast("long").alias("n_tokens"))


def bucket_of(token: Column, dim: int) -> Column:
    """Hash bucket of a token: first four hex digits of md5, modulo dim."""
    return (F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % F.lit(dim)).cast("int")


def chunk_bag_weights(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text",
                      size: int = CHUNK_SIZE, fixed_point: bool = False) -> DataFrame:
    """Sparse chunk vectors: (id, chunk_no, n_chunks, bucket, weight).

    weight = bucket count / chunk tokens, or ``count * 1e6 div n`` (bigint)
    when ``fixed_point``.  The text is tokenised once and nothing is shuffled.
    """
    c = chunk_counts(docs, dim, id_col, text_col, size)
    # Outer generators and filters after them: a filter on the arrays' sizes would be
    # inferred otherwise and pushed to the scan, where it tokenises the texts again.
    c = c.select("id", F.size("chunks").alias("n_chunks"), F.posexplode_outer("chunks").alias("chunk_no", "c"))
    c = c.select("id", "chunk_no", "n_chunks", F.col("c.n").alias("n_tokens"),
                 F.posexplode_outer("c.counts").alias("bucket", "cnt")).where(F.col("cnt") > 0)
    return c.select("id", "chunk_no", "n_chunks", "bucket",
                    _weight(F.col("cnt"), F.col("n_tokens"), fixed_point).alias("weight"))


def _weight(cnt: Column, n: Column, fixed_point: bool) -> Column:
    return F.floor(cnt * F.lit(FIXED_POINT) / n).cast("long") if fixed_point else (cnt / n).cast("double")


def chunk_counts(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text",
                 size: int = CHUNK_SIZE) -> DataFrame:
    """(id, chunks): per chunk its tokens ``n`` and the ``counts`` of all buckets.

    All inside the row, so nothing is shuffled: a chunk's buckets are sorted, and a
    bucket's count is the distance between where it begins and where the next begins.
    """
    base = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))).select(
        "id", clean_tokens(F.col("_text")).alias("_t"))
    base = base.select("id", F.transform(chunk_array("_t", size), lambda c: F.array_sort(
        F.transform(c, lambda t: bucket_of(t, dim)))).alias("_c"))
    found = F.transform("_c", lambda s: F.struct(s.alias("s"), F.array_distinct(s).alias("d")))
    base = base.select("id", F.transform(found, lambda e: F.struct(
        F.size(e["s"]).cast("long").alias("n"), e["d"].alias("d"),
        F.transform(e["d"], lambda b: F.array_position(e["s"], b)).alias("p"))).alias("_c"))
    counts = F.transform("_c", lambda e: F.struct(
        e["n"].alias("n"), F.map_from_arrays(e["d"], F.zip_with(
            e["p"], F.concat(F.slice(e["p"], 2, dim), F.array(e["n"] + 1)), lambda a, b: b - a)).alias("m")))
    base = base.select("id", counts.alias("_c"))
    buckets = F.sequence(F.lit(0), F.lit(dim - 1))
    return base.select("id", F.transform("_c", lambda e: F.struct(
        e["n"].alias("n"), F.transform(buckets, lambda i: F.coalesce(F.element_at(e["m"], i), F.lit(0).cast("long")))
        .alias("counts"))).alias("chunks"))


def pooled_vectors(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text",
                   fixed_point: bool = False) -> DataFrame:
    """(id, n_chunks, vector, present): mean of the chunk vectors, computed inside the row.

    ``present`` marks buckets that some token of the document falls in.
    """
    c = chunk_counts(docs, dim, id_col, text_col)
    zero = F.lit(0).cast("long") if fixed_point else F.lit(0.0)
    zeros = F.array_repeat(zero, dim)
    total = F.aggregate("chunks", zeros, lambda acc, e: F.zip_with(
        acc, e["counts"], lambda a, x: a + _weight(x, e["n"], fixed_point)))
    seen = F.aggregate("chunks", F.array_repeat(F.lit(False), dim), lambda acc, e: F.zip_with(
        acc, e["counts"], lambda a, x: a | (x > 0)))
    n = F.size("chunks").cast("long")
    mean = F.when(n > 0, F.transform(total, lambda s: F.floor(s / n).cast("long") if fixed_point else s / n)).otherwise(zeros)
    return c.select("id", n.alias("n_chunks"), mean.alias("vector"), seen.alias("present"))


def pooled_rows(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text",
                fixed_point: bool = False) -> DataFrame:
    """Sparse document vectors: (id, n_chunks, bucket, value) of the buckets present."""
    p = pooled_vectors(docs, dim, id_col, text_col, fixed_point)
    return p.select("id", "n_chunks", F.posexplode_outer(F.arrays_zip("vector", "present")).alias("bucket", "e")).where(
        "e.present").select("id", "n_chunks", "bucket", F.col("e.vector").alias("value"))


def issue_embeddings(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text",
                     fixed_point: bool = False) -> DataFrame:
    """Dense document vectors of the bag model (C4): (id, n_chunks, vector)."""
    return pooled_vectors(docs, dim, id_col, text_col, fixed_point).drop("present")


#: Fills the chunks of a document's last, shorter run of tokens; no vocabulary id.
PAD_ID = -1


def linear_model(dim: int, scale: int = 1000) -> Callable[[], Callable]:
    """A deterministic stand-in for a neural encoder: the floor of the mean of fixed token
    weights, in units of 1 / ``scale``.  Like any model it is built once per worker."""
    def make():
        def weights(ids: np.ndarray) -> np.ndarray:
            return (ids[..., None] * 31 + np.arange(dim) * 17 + 7) % 97

        def predict(chunks: np.ndarray) -> np.ndarray:
            ids = np.asarray(chunks, dtype=np.int64)
            real = ids != PAD_ID
            total = (weights(ids) * real[..., None]).sum(1) * scale
            return (total // np.maximum(real.sum(1), 1)[:, None]).astype(np.float64)
        return predict
    return make


def embed_chunks_with_model(chunks: DataFrame, make_predict: Callable[[], Callable], size: int = CHUNK_SIZE,
                            batch_size: int = 64) -> DataFrame:
    """Pluggable model over token-id chunks: (id, chunk_no, token_ids) → vector.

    ``make_predict`` loads the model, once per Python worker, and returns a function from
    an (n, ``size``) integer array to an (n, dim) array; chunks shorter than ``size`` end
    in ``PAD_ID``.  Chunks travel as Arrow batches, ``batch_size`` to a call; only that call
    leaves the JVM.
    """
    from pyspark.ml.functions import predict_batch_udf
    ship_package(chunks.sparkSession)  # workers import this module
    model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                              input_tensor_shapes=[[size]])
    short = F.greatest(F.lit(size) - F.size("token_ids"), F.lit(0))
    padded = F.concat("token_ids", F.array_repeat(F.lit(PAD_ID).cast("long"), short))
    return chunks.select("id", "chunk_no", model(padded).alias("vector"))


def document_vectors(docs: DataFrame, make_predict: Callable[[], Callable], dim: int, id_col: str = "doc_id",
                     text_col: str = "text", vocab: DataFrame | None = None) -> DataFrame:
    """The whole chain: texts → tokens → vocabulary ids → chunks → model → mean.

    (id, n_chunks, vector) per document; without tokens the zero vector and no chunk.
    ``vocab`` (token, n_docs, token_id) is that of the documents themselves if None.
    """
    from . import vocabulary
    arrays = vocabulary.token_arrays(docs, id_col, text_col)
    vocab = vocabulary.build_vocabulary(arrays) if vocab is None else vocab
    chunks = vocabulary.chunk_token_ids(vocabulary.encode_arrays(arrays, vocab))
    return mean_of_vectors(embed_chunks_with_model(chunks, make_predict), arrays, dim)


def mean_of_vectors(chunk_vectors: DataFrame, ids: DataFrame, dim: int) -> DataFrame:
    """Unweighted mean of chunk vectors per id; zero vector when none.

    Whole vectors are averaged on the JVM (``Summarizer.mean``), without
    exploding each into ``dim`` rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    feats = chunk_vectors.select("id", array_to_vector("vector").alias("_v"))
    pooled = feats.groupBy("id").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_m"),
                                     F.count(F.lit(1)).alias("n_chunks"))
    j = ids.select("id").join(pooled, "id", "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return j.select("id", F.coalesce(F.col("n_chunks"), F.lit(0)).cast("long").alias("n_chunks"),
                    F.coalesce(F.col("_m"), zero).alias("vector"))
