"""Vocabulary ids of whole documents, without a shuffle per token.

A document is tokenised once, into one array that is written to the shared folder.  The
vocabulary counts each token once a document.  Encoding goes document by document: the
most frequent part of the vocabulary, bounded in bytes, travels to the tasks, which
replace the tokens of whole Arrow batches by array lookups.  Tokens beyond that bound are
few per document: each stands in the ids as the negative number of its kind in the document,
the distinct (document, token) pairs meet the rest of the vocabulary in a join, and the ids
found take the numbers' places inside the document's row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import CHUNK_SIZE, chunk_array, clean_tokens
from ..session import ship_package, spread, written
from .indexing import with_sequential_index

UNK_ID = 0
#: Vocabulary that travels to every task.
BROADCAST_BYTES = 64 << 20


def token_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, tokens) per document, whole texts, written once; ``row`` names the row
    (ids may be null or repeat)."""
    d = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")))
    return written(d.select(F.monotonically_increasing_id().alias("row"), "id", clean_tokens(F.col("_text")).alias("tokens")),
                   "tokens")


def build_vocabulary(arrays: DataFrame) -> DataFrame:
    """(token, n_docs, token_id): distinct tokens with dense ids 1..V in token (binary)
    order; 0 is UNK.  A token counts once a document, so a document sends it once."""
    each = arrays.select(F.explode_outer(F.array_distinct("tokens")).alias("token")).where(F.col("token").isNotNull())
    return with_sequential_index(each.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs")), ["token"],
                                 name="token_id", start=1)


def frequent_threshold(vocab: DataFrame, max_bytes: int) -> int:
    """Smallest power of two such that the tokens of at least so many documents fit into
    ``max_bytes``; 1 if all do."""
    # One row per power of two.
    level = F.floor(F.log2("n_docs")).cast("int")
    sizes = vocab.groupBy(level.alias("level")).agg(F.sum(F.octet_length("token") + F.lit(16)).alias("b")).collect()
    left = max_bytes
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if r["b"] > left:
            return 1 << (r["level"] + 1)
        left -= r["b"]
    return 1


def _lookup(words: pa.Array, ids: pa.Array, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(id per token, -1 if absent; list borders; the tokens in a row)."""
    flat = tokens.flatten().cast(pa.large_string())
    border = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))])
    kinds = flat.dictionary_encode()
    at = pc.index_in(kinds.dictionary, value_set=words)
    found = pc.fill_null(pc.take(ids, at), -1).to_numpy(zero_copy_only=False)
    return found[kinds.indices.to_numpy(zero_copy_only=False)], border, flat


def _encode(vocabulary, complete: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(vocabulary.value).read_all().combine_chunks()
        words = table.column("token").cast(pa.large_string()).combine_chunks()
        ids = table.column("token_id").combine_chunks()
        for batch in batches:
            got, border, flat = _lookup(words, ids, batch.column("tokens"))
            rare = []
            for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                miss = np.flatnonzero(got[a:b] < 0) if not complete else ()
                if not len(miss):
                    rare.append([])
                    continue
                kinds = flat.slice(a, b - a).take(pa.array(miss)).dictionary_encode()
                got[a + miss] = -1 - kinds.indices.to_numpy(zero_copy_only=False)
                rare.append(kinds.dictionary.to_pylist())
            if complete:
                got = np.where(got < 0, UNK_ID, got)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.ListArray.from_arrays(border.astype(np.int32), pa.array(got)),
                 pa.array(rare, pa.list_(pa.string()))], ["row", "id", "token_ids", "rare"])
    return run


def encode_arrays(arrays: DataFrame, vocab: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, token_ids) per row of :func:`token_arrays`, in token order; unknown tokens are UNK.

    Documents stay where they are as long as the vocabulary is within ``max_bytes``;
    beyond it only (row, distinct rare token) pairs, and the ids of the rows that hold such
    tokens, are shuffled.
    """
    spark: SparkSession = arrays.sparkSession
    ship_package(spark)  # workers import this module
    kind = dict(arrays.dtypes)["id"]
    least = frequent_threshold(vocab, max_bytes)
    frequent = vocab.where(F.col("n_docs") >= least).select("token", "token_id").toArrow()  # at most ``max_bytes``
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frequent.schema) as w:
        w.write_table(frequent)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    first = arrays.mapInArrow(_encode(sent, least == 1), f"row long, id {kind}, token_ids array<long>, rare array<string>")
    if least == 1:
        return first.select("id", "token_ids")
    first = written(first, "frequent")
    rest = vocab.where(F.col("n_docs") < least).select("token", "token_id")
    asked = first.select("row", F.posexplode("rare").alias("place", "token"))
    found = asked.join(rest, "token", "left").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "place", F.coalesce("token_id", F.lit(UNK_ID).cast("long")).alias("token_id")))), lambda p: p["token_id"]).alias("found"))
    some = F.size("rare") > 0
    # Only rows with a rare token meet their ids; the tokens themselves are not moved again.
    mended = first.where(some).select("row", "id", "token_ids").join(found, "row").select("id", F.transform(
        "token_ids", lambda t: F.when(t < 0, F.element_at("found", (-t).cast("int"))).otherwise(t)).alias("token_ids"))
    return first.where(~some).select("id", "token_ids").unionByName(mended)


def encoded_rows(encoded: DataFrame) -> DataFrame:
    """(id, pos, token_id): one row per token."""
    return encoded.select("id", F.posexplode_outer("token_ids").alias("pos", "token_id")).where(F.col("pos").isNotNull())


def chunk_token_ids(encoded: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """(id, chunk_no, token_ids): runs of ``size`` ids as a model takes them, cut inside
    the document's row."""
    c = encoded.select("id", F.posexplode_outer(chunk_array("token_ids", size)).alias("chunk_no", "token_ids"))
    return c.where(F.col("chunk_no").isNotNull())
