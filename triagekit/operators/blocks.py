"""Exact top-k of blocks of queries: the scoring that all searches share.

A task holds one block of queries and its best pairs, and the vectors pass by in packed
chunks.  One matrix product in single precision scores a chunk against a tile of queries;
what it cannot rule out within its rounding error is scored again exactly, by the same left
fold over the dimensions as the SQL form.  A query meets all its vectors in one task, so its
limit tightens over all of them, and only final rows leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a pair that a task holds while it sorts, queries of a block (numbered in 16 bits),
#: rows and bytes of a packed chunk, pairs of a tile, survivors scored at once.
PAIR_BYTES, MAX_QUERIES, _CHUNK, _CHUNK_BYTES, _TILE, _EXACT = 48, 32768, 2048, 1 << 20, 1 << 20, 1 << 14
_EPS = 1e-9
PACKED = "part int, ids binary, mat binary, bound binary"
HITS = "query_id long, pk long, distance double, rank int"


def pack(rows: DataFrame, dim: int) -> DataFrame:
    """(part, id, vec[, bound]) rows as ``PACKED`` chunks of one part each.  Without a vector,
    or with a value that is not finite, a row is in no result and left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths != dim).any():
                raise ValueError(f"vector dim {int(lengths[lengths != dim][0])} != query dim {dim}")
            mat = pc.fill_null(vec.flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(len(lengths), dim)
            part, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "id"))
            good = np.flatnonzero(np.isfinite(mat).all(1))
            good = good[np.argsort(part[good], kind="stable")]
            edge = np.flatnonzero(np.diff(part[good], prepend=-1, append=-1)) if len(good) else np.zeros(0, int)
            step = max(1, min(_CHUNK, _CHUNK_BYTES // max(1, mat.itemsize * dim)))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                for a in range(lo, hi, step):
                    at = good[a:min(a + step, hi)]
                    yield _packed(int(part[at[0]]), ids[at].astype(np.int64), mat[at].astype(np.float64), None)

    return rows.where("id is not null and vec is not null").mapInArrow(run, PACKED)


def _packed(part: int, ids: np.ndarray, mat: np.ndarray, bound: np.ndarray | None) -> pa.RecordBatch:
    single = mat.astype(np.float32)
    small = single if np.array_equal(single, mat) else mat  # single precision where it is exact
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary()),
         pa.array([None if bound is None else bound.tobytes()], pa.binary())], ["part", "ids", "mat", "bound"])


def unpacked(ids: bytes, mat: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = np.float64 if len(mat) == len(ids) * dim * 8 else np.float32
    return ids, np.frombuffer(mat, kind).reshape(len(ids), dim).astype(np.float64)


class Block:
    """The k best (distance, pk) pairs of a block of queries."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.mat, self.k = ids, mat, k
        self.limit, self.limit_pk = bound.copy(), np.full(len(ids), np.iinfo(np.int64).max)
        self.mean = mat.mean(0)  # distances stay, norms and so rounding errors shrink
        centred = mat - self.mean
        self.norm = (centred * centred).sum(1)
        self.left = np.concatenate([-2.0 * centred, np.ones((len(ids), 1)), np.zeros((len(ids), 1))], axis=1)
        self.left32 = self.left.astype(np.float32)
        self.pool = [np.empty(0, np.uint16), np.empty(0), np.empty(0, np.int64)]  # query, distance, pk
        self.waiting, self.size = [], 0

    def add(self, pks: np.ndarray, vecs: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Score a chunk of vectors against all queries, or those in ``rows``."""
        m, dim = vecs.shape
        centred = vecs - self.mean
        norm = (centred * centred).sum(1)
        scale = self.norm + norm.max()  # no |q|² + |v|² of the chunk is larger
        safe = 1e-20 < scale.min() and scale.max() < 1e30
        # Eight times the rounding error of a product of ``dim`` + 2 terms in single precision.
        slack = (dim + 8) * 2.0 ** -21 * scale + 1e-12 * (self.mean * self.mean).sum()
        kind, left = (np.float32, self.left32) if safe else (np.float64, self.left)
        right = np.concatenate([centred.T, norm[None, :], np.ones((1, m))]).astype(kind)
        top = 4.0 * scale + slack  # beyond every distance of the chunk
        rows = np.arange(len(self.ids)) if rows is None else rows
        step = max(1, _TILE // m)
        for a in range(0, len(rows), step):
            own = slice(rows[a], rows[a] + step) if len(rows) == len(self.ids) else rows[a:a + step]
            tile = left[own].copy()
            limit = np.minimum(self.limit[own], top[own])
            tile[:, -1] = self.norm[own] - limit - slack[own]
            t = tile @ right
            if m > self.k and np.isinf(self.limit[own]).any():
                # The k-th of the chunk, up to rounding, bounds the k-th of all.
                kth = np.partition(t, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) + limit + 2.0 * slack[own]
                self.limit[own] = np.minimum(self.limit[own], kth)
                near = t <= (np.minimum(limit, self.limit[own]) - limit + slack[own])[:, None]
            else:
                near = t <= 0
            at = np.flatnonzero(near)
            if len(at):
                self._exact(rows[a + at // m], at % m, pks, vecs)
        if self.size >= max(1 << 18, len(self.ids) * self.k):
            self.compact()

    def _exact(self, qi: np.ndarray, ci: np.ndarray, pks: np.ndarray, vecs: np.ndarray) -> None:
        for s in range(0, len(qi), _EXACT):
            q, c = qi[s:s + _EXACT], ci[s:s + _EXACT]
            diff = self.mat[q] - vecs[c]
            diff *= diff
            d = np.add.accumulate(diff, axis=1)[:, -1] if diff.shape[1] else np.zeros(len(q))  # left fold
            p = pks[c]
            keep = (d < self.limit[q]) | ((d == self.limit[q]) & (p <= self.limit_pk[q]))
            keep &= np.isfinite(d)
            self.waiting.append((q[keep].astype(np.uint16), d[keep], p[keep]))
            self.size += int(keep.sum())
        if self.size > max(1 << 20, 4 * len(self.ids) * self.k):  # many equal vectors
            self.compact()

    def compact(self) -> None:
        qi, d, pk = (np.concatenate(x) for x in zip(self.pool, *self.waiting, strict=True))
        order = np.argsort(d)
        order = order[np.argsort(qi[order], kind="stable")]  # 16 bits: a radix sort
        qi, d, pk = qi[order], d[order], pk[order]
        same = np.flatnonzero((qi[1:] == qi[:-1]) & (d[1:] == d[:-1]))
        if len(same):  # equal distances: by pk
            tied = np.zeros(len(qi), bool)
            tied[same] = tied[same + 1] = True
            tied = np.flatnonzero(tied)
            pk[tied] = pk[tied][np.lexsort((pk[tied], d[tied], qi[tied]))]
        place = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(self.ids)))[qi]
        last = place == self.k - 1
        self.limit[qi[last]], self.limit_pk[qi[last]] = d[last], pk[last]
        best = place < self.k
        self.pool, self.waiting, self.size = [x[best] for x in (qi, d, pk)], [], 0

    def hits(self) -> Iterator[pa.RecordBatch]:
        self.compact()
        qi, d, pk = self.pool
        rank = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(self.ids)))[qi] + 1
        for a in range(0, len(qi), 1 << 16):
            s = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[qi[s]]), pa.array(pk[s]), pa.array(d[s]), pa.array(rank[s].astype(np.int32))],
                ["query_id", "pk", "distance", "rank"])

    def bounds(self, part: int) -> Iterator[pa.RecordBatch]:
        """The queries again, with the k-th distance found as their bound."""
        self.compact()
        n = np.bincount(self.pool[0].astype(np.int64), minlength=len(self.ids))
        bound = np.where(n >= self.k, self.limit, np.inf)
        for a in range(0, len(self.ids), _CHUNK):
            s = slice(a, a + _CHUNK)
            yield _packed(part, self.ids[s], self.mat[s], bound[s])


def block_count(n: int, per_block: int, cores: int) -> int:
    """Blocks for ``n`` queries: about ``per_block`` in each, and work for all cores."""
    return max(1, min(n, max(cores, -(-n // max(1, min(per_block, MAX_QUERIES))))))


def search(queries: DataFrame, chunks: DataFrame, blocks: int, k: int, dim: int, first_pass: bool = False,
           prune: Callable | None = None) -> DataFrame:
    """Top-k of packed ``queries`` (part: their block) over (block, cell, ids, mat) ``chunks``.

    ``HITS``, or after a first pass the queries with their bounds, packed.  ``prune`` is
    built once a block from its queries and says which of them a cell may still serve.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got, block, may = None, [], None, None

        def started():
            ids, mat, bound = (np.concatenate(x) for x in zip(*got, strict=True))
            own = Block(ids, mat, bound, k)
            return own, prune(mat) if prune else None

        def finished(block):
            if block is None and got:
                block, _ = started()
            if block is not None:
                yield from block.bounds(part) if first_pass else block.hits()

        for batch in batches:
            for i in range(batch.num_rows):
                p, cell = batch.column("block")[i].as_py(), batch.column("cell")[i].as_py()
                if p != part:
                    yield from finished(block)
                    part, got, block, may = p, [], None, None
                ids, vecs = unpacked(batch.column("ids")[i].as_py(), batch.column("mat")[i].as_py(), dim)
                if cell is None:  # queries come first
                    bound = batch.column("bound")[i].as_py()
                    got.append((ids, vecs, np.full(len(ids), np.inf) if bound is None else np.frombuffer(bound)))
                elif got:
                    if block is None:
                        block, may = started()
                    block.add(ids, vecs, may(cell, block.limit) if may else None)
        yield from finished(block)

    rows = queries.select(F.col("part").alias("block"), F.lit(None).cast("int").alias("cell"), "ids", "mat", "bound").unionByName(
        chunks.select("block", "cell", "ids", "mat", F.lit(None).cast("binary").alias("bound")))
    rows = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", F.col("cell").asc_nulls_first())
    return rows.mapInArrow(run, PACKED if first_pass else HITS)
