"""Suffix-array dedup: bytes covered by a 400-byte string that starts anywhere else.

A suffix sort of the whole corpus cannot be spread over tasks, so the strings are:

1. Every 400-byte window has a smallest 128-byte hash inside it.  Consecutive windows
   with the same one form a run (one per 137 bytes of text), and equal windows fall
   into runs of equal smallest hash, wherever they stand.  Only hashes of runs are
   shuffled.
2. A run whose smallest hash no other run has, and that has it once, repeats nothing.
   A run whose whole text another run has too is a repeat in all its windows.
3. What remains (the edges of repeated passages) goes by smallest hash to tasks that
   build the Burrows-Wheeler transform of their run texts and expand intervals
   backwards, breadth first, deriving common prefixes by increasing value up to 400:
   windows that share one are repeats (:func:`.fmindex.long_prefix`).  Only one of
   equal run texts goes.
4. Repeated windows become byte spans, merged per text.

A smallest hash shared by more than ``MAX_GROUP`` different run texts would be one
large task; its windows are counted by their own hashes instead, spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .common import bound_batches, mix64, rounds, shared_table, span_hashes
from .fmindex import long_prefix, suffix_array

LENGTH = 400
SEED_LENGTH = 128
MAX_GROUP = 20_000
#: Bytes of one round of window hashes (about 150 bytes of arrays per byte of text).
ROUND = 1 << 20
#: Run texts of one transform.
TASK_BYTES = 1 << 20


def _minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive keys, by block minima from both sides."""
    n = len(keys)
    pad = -n % width
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    a = np.concatenate([keys, np.full(pad, top, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    behind = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def text_runs(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED_LENGTH
              ) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest hash: (text number, first window, windows,
    smallest hash, hash of the run's text, whether the smallest hash occurs again in it)."""
    n, width = len(flat), length - seed + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    start = np.arange(n - seed + 1)
    h = span_hashes(flat, start, start + seed)
    bits = np.uint64(max(1, int(n).bit_length()))
    # High bits of the hash, then the place: the first smallest one, also where hashes tie.
    at = (_minima((h >> bits << bits) | start.astype(np.uint64), width) & ((np.uint64(1) << bits) - np.uint64(1))
          ).astype(np.int64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    first = np.maximum(size - length + 1, 0)
    p = np.arange(len(owner)) - np.repeat(np.cumsum(first) - first, first) + offsets[owner]  # window places
    if not len(p):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    place = at[p]
    low = h[place]
    new = np.ones(len(p), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(p)))
    p0 = p[begin]
    moved = np.zeros(len(p), np.int64)
    moved[1:] = (place[1:] != place[:-1]) & ~new[1:]
    moves = np.concatenate([[0], np.cumsum(moved)])
    again = moves[begin + count] > moves[begin]
    body = mix64(span_hashes(flat, p0, p0 + count - 1 + length) + count.astype(np.uint64))
    return owner[begin], p0 - offsets[owner[begin]], count, low[begin], body, again


def text_key(text: Column) -> list[Column]:
    """Two columns that name a text: rows of equal texts share all results."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t"), F.crc32(t.cast("binary")).alias("u")]


def _runs(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, "text", ROUND):
                owner, p0, count, low, body, again = text_runs(flat, offsets, length, seed)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("t").take(take), rows.column("u").take(take), pa.array(p0), pa.array(count, pa.int32()),
                     pa.array(low.view(np.int64)), pa.array(body.view(np.int64)), pa.array(again)],
                    ["t", "u", "p0", "n", "low", "body", "again"])
    return run


def _slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, "text", ROUND):
                data = flat.tobytes()
                low, body, piece = [], [], []
                for i, pieces in enumerate(rows.column("pieces").to_pylist()):
                    for x in pieces:
                        a = int(offsets[i]) + x["p0"]
                        low.append(x["low"])
                        body.append(x["body"])
                        piece.append(data[a:a + x["n"] - 1 + length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low, pa.int64()), pa.array(body, pa.int64()), pa.array(piece, pa.binary())],
                    ["low", "body", "piece"])
    return run


def repeated_windows(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per piece the ranges [b, e) of windows that occur elsewhere in the pieces."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(x) for x in pieces])
    used = np.zeros(256, np.int64)
    used[np.unique(data)] = 1
    dense = np.cumsum(used) * used  # 1.. for the bytes that occur, 0 ends a piece
    sigma = int(used.sum()) + 1
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(len(data) + len(pieces), np.uint8 if sigma <= 256 else np.uint16)
    text[np.arange(len(data)) + np.repeat(np.arange(len(pieces)), size)] = dense[data]
    sa = suffix_array(text, length)
    shared = long_prefix(sa, text, sigma, length)
    twice = shared.copy()
    twice[:-1] |= shared[1:]
    mark = np.zeros(len(text) + 1, np.int8)
    mark[sa[twice]] = 1
    out = []
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        edge = np.diff(mark[b:b + max(0, n - length + 1)], prepend=0, append=0)
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)))
    return out


def _expand(length: int, task_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            found = repeated_windows([r[2] for r in rows], length)
            flat = [(r[0], r[1], b, e) for r, f in zip(rows, found, strict=True) for b, e in f]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in flat], pa.int64()) for i in range(4)], ["low", "body", "b", "e"])

        for batch in batches:  # sorted by low, body
            for low, body, piece in zip(batch.column("low").to_pylist(), batch.column("body").to_pylist(),
                                        batch.column("piece").to_pylist(), strict=True):
                if held and (low, body) == held[-1][:2]:
                    continue
                if held and size > task_bytes and low != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append((low, body, piece))
                size += len(piece)
        if held:
            yield flush(held)
    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, "piece", ROUND):
                n = np.diff(offsets) - length + 1
                owner = np.repeat(np.arange(len(n)), n)
                b = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                at = b + offsets[owner]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("low").take(take), rows.column("body").take(take), pa.array(b),
                     pa.array(span_hashes(flat, at, at + length).view(np.int64))], ["low", "body", "b", "w"])
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED_LENGTH, max_group: int = MAX_GROUP,
                   task_bytes: int = TASK_BYTES, text_col: str = "text") -> DataFrame:
    """(t, u, spans): byte spans [b, e), to be merged, of every text that has repeats."""
    bound_batches(docs.sparkSession)
    d = docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)
    runs = shared_table(d.mapInArrow(
        _runs(length, seed), "t long, u long, p0 long, n int, low long, body long, again boolean"), "runs")
    groups = runs.groupBy("low").agg(F.count(F.lit(1)).alias("runs"), F.min("body").alias("b0"),
                                     F.max("body").alias("b1"), F.max("again").alias("any_again"))
    groups = groups.where("runs > 1 or any_again").select("low", (
        (F.col("b0") != F.col("b1")) | F.col("any_again")).alias("mixed"))
    groups = shared_table(groups, "groups")
    hits = shared_table(runs.join(maybe_broadcast(groups), "low"), "hits")
    whole = hits.where("not mixed").select("t", "u", "p0", F.lit(0).cast("long").alias("b"), F.col("n").cast("long").alias("e"))

    mixed = hits.where("mixed")
    bodies = mixed.groupBy("low", "body").agg(
        F.count(F.lit(1)).alias("copies"), F.max("again").alias("again"),
        F.min(F.struct("t", "u", "p0", "n")).alias("one"))
    bodies = shared_table(bodies, "bodies")
    # A group whose runs all have copies is settled; the others need their texts.
    settled = bodies.groupBy("low").agg(F.min("copies").alias("least"), F.count(F.lit(1)).alias("bodies"))
    todo = settled.where("least < 2").select("low", "bodies")
    pieces = bodies.join(todo, "low").select("low", "body", "one.*", "bodies")
    per_text = pieces.groupBy("t", "u").agg(F.collect_list(F.struct("low", "body", "p0", "n")).alias("pieces"))
    per_text = shared_table(per_text, "pieces")
    texts = d.join(maybe_broadcast(per_text), ["t", "u"]).select("text", "pieces")
    texts = shared_table(texts.mapInArrow(_slices(length), "low long, body long, piece binary"), "texts")
    large = todo.where(F.col("bodies") > max_group).select("low")
    large = shared_table(large, "large")
    normal = texts.join(large, "low", "left_anti").repartition("low").sortWithinPartitions("low", "body")
    found = normal.mapInArrow(_expand(length, task_bytes), "low long, body long, b long, e long")
    if large.limit(1).count():
        w = texts.join(large, "low", "left_semi").dropDuplicates(["low", "body"])
        w = w.mapInArrow(_window_hashes(length), "low long, body long, b long, w long")
        twice = w.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
        w = w.join(twice, "w").select("low", "body", "b", (F.col("b") + 1).alias("e"))
        found = found.unionByName(w)
    copied = bodies.where("copies > 1").select("low", "body", F.lit(0).cast("long").alias("b"),
                                               F.col("one.n").cast("long").alias("e"))
    found = shared_table(found.unionByName(copied), "found")
    part = mixed.join(found, ["low", "body"]).select("t", "u", "p0", "b", "e")
    spans = whole.unionByName(part).select(
        "t", "u", F.struct((F.col("p0") + F.col("b")).alias("b"), (F.col("p0") + F.col("e") - 1 + length).alias("e")).alias("s"))
    # At most one span a window of the text, and copies of a text add none.
    return spans.groupBy("t", "u").agg(F.collect_set("s").alias("spans"))


def merge_spans(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted((s["b"], s["e"]) for s in spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, pos = [], 0
    for b, e in spans:
        out.append(data[pos:b])
        pos = e
    out.append(data[pos:])
    return b"".join(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, flat, offsets in rounds(batch, "text", ROUND):
            data = flat.tobytes()
            removed, count, sha = [], [], []
            for i, s in enumerate(rows.column("spans").to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                s = merge_spans(s or [])
                removed.append(sum(e - b for b, e in s))
                count.append(len(s))
                sha.append(hashlib.sha256(kept_bytes(text, s)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_digest(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A null text counts as empty; texts under 400 bytes lose nothing; repeated rows are
    copies of each other, so both lose everything from 400 bytes on; ids may be null or
    repeat; an empty table gives an empty result.  Only doc_id and text are read.
    """
    spans = shared_table(repeated_spans(docs, **options), "spans")
    d = docs.select("doc_id", F.col("text"), *text_key(F.col("text")))
    d = d.join(maybe_broadcast(spans), ["t", "u"], "left").select("doc_id", "text", "spans")
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
