"""Benchmark decontamination with an FM-index per shard of training text.

Test phrases are windows of ten words of an item (the whole item if it has fewer).
A shard is a bounded run of documents inside a task.  Its words are numbered by the
phrases' vocabulary; any other word can be in no phrase, so such words become
separators, and runs of words shorter than the shortest phrase are left out of the
index, which changes no answer.  The index (Burrows-Wheeler transform, wavelet-matrix
ranks, sampled suffix positions) answers all phrases at once by backward search; the
occurrences found are located and merged into removal spans.

The test set goes to the tasks in blocks of bounded size, one pass over the documents
for each block; spans and items of earlier blocks travel with the row, so that a test
set of any size gives whole results without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, rounds
from .fmindex import FMIndex

WINDOW = 10
#: Text of one shard (a longer text is a shard of its own) and of one block of items.
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
# Word bytes after folding A-Z: 0-9, a-z and everything beyond ASCII; others separate.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
               else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPANS = "array<struct<b:int,e:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Phrases:
    """Distinct windows of one block of items, numbered words, and who holds which window."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]      # one (n, m) array per window length m
    holders: list[list[list[str]]]  # item ids per window, aligned with ``windows``
    shortest: int


def build_phrases(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    held: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_of((text or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            ids = held.setdefault(tuple(w[i:i + window]), set())
            if item is not None:
                ids.add(item)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for k in held for w in k}))}
    windows, holders = [], []
    for m in sorted({len(k) for k in held}):
        keys = sorted(k for k in held if len(k) == m)
        windows.append(np.array([[vocabulary[w] for w in k] for k in keys], np.int64))
        holders.append([sorted(held[k]) for k in keys])
    return Phrases(vocabulary, windows, holders, windows[0].shape[1] if windows else 0)


def runs_of(ids: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words inside one text and of at least ``shortest`` words: [b, e)."""
    known = np.concatenate([[False], ids > 0, [False]])
    border = np.zeros(len(ids) + 1, bool)
    border[first] = True
    inside = known[1:-1]
    b = np.flatnonzero(inside & (~known[:-2] | border[:-1]))
    e = np.flatnonzero(inside & (~known[2:] | border[1:])) + 1
    keep = e - b >= shortest
    return b[keep], e[keep]


def search_shard(ids: np.ndarray, first: np.ndarray, phrases: Phrases
                 ) -> tuple[np.ndarray, dict[int, set[str]]]:
    """(hit words of the shard, item ids by row) for numbered words and text borders."""
    hit = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[str]] = {}
    b, e = runs_of(ids, first, phrases.shortest) if phrases.windows else (first[:0], first[:0])
    if len(b):
        size = e - b
        place = np.repeat(b - np.cumsum(size) + size, size) + np.arange(size.sum())  # word of each run symbol
        text = np.zeros(len(place) + len(b) + 1, np.int64)  # a separator before each run and at the end
        to = np.arange(len(place)) + np.repeat(np.arange(1, len(b) + 1), size)
        text[to] = ids[place]
        word_at = np.full(len(text), -1, np.int64)
        word_at[to] = place
        index = FMIndex(text, len(phrases.vocabulary) + 1)
        for windows, holders in zip(phrases.windows, phrases.holders, strict=True):
            lo, hi = index.search(windows)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            if not len(which):
                continue
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
            word = word_at[index.locate(at)]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + windows.shape[1], -1)
            row = np.searchsorted(first, word, "right") - 1
            pairs = np.unique(row * np.int64(len(n)) + which)
            for p in pairs.tolist():
                items.setdefault(p // len(n), set()).update(holders[p % len(n)])
    return np.cumsum(hit)[:len(ids)] > 0, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what lies between the words of one span."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    out, pos = [], 0
    for b, e in spans:
        out.append(data[pos:at[b][0]])
        pos = at[e - 1][1]
    out.append(data[pos:])
    return b"".join(out).decode()


def _cut(text: pa.Array, spans: list[list[dict]]) -> pa.Array:
    hit = [i for i, s in enumerate(spans) if s]
    if not hit:  # texts without a hit stay the very bytes they were
        return text
    texts = text.to_pylist()
    for i in hit:
        texts[i] = remove_words(texts[i], [(s["b"], s["e"]) for s in spans[i]])
    return pa.array(texts, text.type)


def _search(phrases: Phrases, text_col: str, cut: bool = False):
    """Spans and items of the phrases' hits beside those of earlier blocks; ``cut`` (for the
    last block) also removes all spans from the texts, in the same pass."""
    get = phrases.vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, text_col, SHARD_BYTES):
                numbers, first = [], np.zeros(rows.num_rows + 1, np.int64)
                data = flat.tobytes()
                for i in range(rows.num_rows):
                    ids = [get(w, 0) for w in words_of(data[offsets[i]:offsets[i + 1]])]
                    numbers.append(np.array(ids, np.int64))
                    first[i + 1] = first[i] + len(ids)
                ids = np.concatenate(numbers)
                hit, items = search_shard(ids, first, phrases)
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans = rows.column("__spans").to_pylist()
                held = rows.column("__items").to_pylist()
                for i in items:
                    held[i] = sorted({*held[i], *items[i]})
                found: dict[int, list[tuple[int, int]]] = {}
                row = np.searchsorted(first, begin, "right") - 1
                for i, b, e in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
                    while e > first[i + 1]:  # hits of neighbouring texts touch
                        found.setdefault(i, []).append((b - int(first[i]), int(first[i + 1] - first[i])))
                        b = int(first[i + 1])
                        i = int(np.searchsorted(first, b, "right") - 1)
                    found.setdefault(i, []).append((b - int(first[i]), e - int(first[i])))
                for i, s in found.items():
                    s = _merge(s + [(x["b"], x["e"]) for x in spans[i]])
                    spans[i] = [{"b": b, "e": e} for b, e in s]
                text = rows.column(text_col)
                if cut:
                    text = _cut(text, spans)
                put = {text_col: text, "__n_words": pa.array(np.diff(first)), "__items": pa.array(held, pa.list_(pa.string())),
                       "__spans": pa.array(spans, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())])))}
                yield pa.RecordBatch.from_arrays(
                    [put.get(n, rows.column(n)) for n in rows.schema.names], names=rows.schema.names)
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``found``: n_words, items (ids, as sorted strings)
    and spans (merged runs of hit words, [b, e) in word numbers).

    A null or empty text has no words and no hits; a null or wordless item has no
    phrase; items with a null id hit words but are not listed; repeated rows of either
    side change nothing; empty tables give empty or clean results.  A column of the
    input called ``found`` is replaced; others may have any name.
    """
    d = _search_all(docs, benchmark, text_col, block_bytes)
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c != "found"]
    return d.select(*keep, F.struct(F.col("__n_words").alias("n_words"), F.col("__items").alias("items"),
                                      F.col("__spans").alias("spans")).alias("found"))


def _search_all(docs: DataFrame, benchmark: DataFrame, text_col: str, block_bytes: int, cut: bool = False) -> DataFrame:
    bound_batches(docs.sparkSession, 4000, 2 * SHARD_BYTES)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("__text"),
                    F.lit(0).cast("long").alias("__n_words"), F.array().cast("array<string>").alias("__items"),
                    F.array().cast(_SPANS).alias("__spans"))
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text"))
    total = b.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        # One block of items at a time on the driver: about ``block_bytes`` of text.
        block = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in d.schema])
        d = d.mapInArrow(_search(build_phrases([(r.item, r.text) for r in block]), "__text", cut and k == blocks - 1), schema)
    return d


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    d = find_contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["b"])
    return d.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"),
                    F.size("found.items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", F.array_sort("found.items")).cast("binary"), 256).alias("items_sha256"),
                    (n_hit > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every hit span cut out of its text; untouched texts stay as they are,
    byte for byte.  Edge cases as in :func:`find_contamination`; no row is dropped."""
    d = _search_all(docs, benchmark, text_col, BLOCK_BYTES, cut=True)
    return d.select(*[F.col("__text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])
