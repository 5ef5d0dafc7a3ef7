"""Patched frame-of-reference file image of a run of token ids (numpy).

Layout, little-endian: magic ``PFR1``; u64 number of ids, of documents; u32 ids a
block, number of blocks; per document i64 id, u8 null flag, u64 ids with its end; u64
byte position of every block (and of the end); then the blocks: u32 minimum, u8 width,
u8 number of exceptions, the values minus the minimum packed at ``width`` bits, and per
exception u8 place and u32 value minus minimum.  The width holds the block's
``PERCENTILE`` smallest values; those above are the exceptions.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 90


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode(ids: np.ndarray, doc_ids: np.ndarray, is_null: np.ndarray, lengths: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    v = padded.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    cut = np.partition(v, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100] if blocks else low
    width = _bit_length(cut)
    over = (v >> width[:, None].astype(np.uint64)) > 0
    exceptions = over.sum(axis=1)
    size = 6 + width * (BLOCK // 8) + exceptions * 5
    start = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(int(start[-1]), np.uint8)
    at = start[:-1, None]
    if blocks:
        body[at + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
        body[start[:-1] + 4] = width
        body[start[:-1] + 5] = exceptions
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(v[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4),
                                 axis=2, count=int(w), bitorder="little")
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            body[at[rows] + 6 + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        to = start[row] + 6 + width[row] * (BLOCK // 8) + nth * 5
        body[to] = place
        body[to[:, None] + 1 + np.arange(4)] = v[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = [MAGIC, np.array([n, len(doc_ids)], "<u8").tobytes(), np.array([BLOCK, blocks], "<u4").tobytes(),
            doc_ids.astype("<i8").tobytes(), is_null.astype(np.uint8).tobytes(), lengths.astype("<u8").tobytes()]
    base = sum(map(len, head)) + 8 * (blocks + 1)
    return b"".join([*head, (start + base).astype("<u8").tobytes(), body.tobytes()])


class Image:
    """Reader of one file image; ``ids(a, b)`` decodes only the blocks that hold them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.raw = np.frombuffer(data, np.uint8)
        self.n, docs = (int(x) for x in np.frombuffer(data, "<u8", 2, 4))
        self.block, self.blocks = (int(x) for x in np.frombuffer(data, "<u4", 2, 20))
        p = 28
        self.doc_ids = np.frombuffer(data, "<i8", docs, p)
        self.is_null = np.frombuffer(data, np.uint8, docs, p + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(data, "<u8", docs, p + 9 * docs).astype(np.int64)
        self.start = np.frombuffer(data, "<u8", self.blocks + 1, p + 17 * docs).astype(np.int64)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n if last is None else last
        b0, b1 = first // self.block, -(-last // self.block)
        if b1 <= b0:
            return np.zeros(0, np.uint32)
        start = self.start[b0:b1]
        head = self.raw[start[:, None] + np.arange(6)]
        low = head[:, :4].copy().view("<u4").ravel()
        width, exceptions = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
        out = np.zeros((b1 - b0, self.block), np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                packed = self.raw[start[rows, None] + 6 + np.arange(w * self.block // 8)]
                bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), self.block, int(w))
                full = np.zeros((len(rows), self.block, 32), np.uint8)
                full[:, :, :w] = bits
                out[rows] = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
        if exceptions.any():
            row = np.repeat(np.arange(len(start)), exceptions)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
            at = start[row] + 6 + width[row] * (self.block // 8) + nth * 5
            value = self.raw[at[:, None] + 1 + np.arange(4)].copy().view("<u4").ravel()
            out[row, self.raw[at]] = value
        out += low[:, None]
        return out.ravel()[first - b0 * self.block:last - b0 * self.block]
