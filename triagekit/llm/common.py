"""Helpers shared by the operators: inputs, shared scratch tables, byte-array words.

The word helpers work on whole Arrow batches: one flat byte array, one offset
array, no Python object per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

#: Bytes of text that one round of array work holds; a longer text is a round of its own.
ROUND_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would fold all of Unicode)."""
    return F.translate(c, UPPER, LOWER)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, in columns and compressed; a lost
    executor loses nothing of it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/triagekit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Scratch tables written, by application.
_SCRATCH: dict[str, list[str]] = {}


def scratch_tables(spark) -> list[str]:
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark, keep: list[str] = ()) -> int:
    """Delete the scratch tables of this application but those in ``keep`` (as
    :func:`scratch_tables` gave them before a job); for when that job's result is written.

    Frames that read them are of no use afterwards.  Returns the number of tables.
    """
    app = spark.sparkContext.applicationId
    paths = [p for p in scratch_tables(spark) if p not in keep]
    _SCRATCH[app] = [p for p in scratch_tables(spark) if p in keep]
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    flat = flat[offsets[0]:offsets[-1]] if len(offsets) else flat[:0]
    return flat, offsets - (offsets[0] if len(offsets) else 0)


def rounds(batch: pa.RecordBatch, column: str, limit: int = ROUND_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` bytes: (rows, bytes, offsets)."""
    flat, offsets = flat_text(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo), flat[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


#: White space of the word rule ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Span hashes are two polynomials, each modulo a prime of its own: modulo a power of two
#: every base has fixed words of equal value (Thue-Morse words).
_FIELDS = ((2147483647, 1103515245), (2147483629, 1664525323))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
        k += m
    return out


def _powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i < n, kept per worker up to one round."""
    have = _POWERS.get(prime)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = _table(base, prime, size), _table(pow(base, -1, prime), prime, size)
        if size <= ROUND_BYTES + 1:  # of a longer text: used once, not kept
            _POWERS[prime] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_spans(flat: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = IS_SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (len + 1)."""
    n = len(flat)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~is_gap[flat]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span's bytes: differences of prefix polynomials modulo two
    primes.  Alike in all workers; different spans may share one by chance alone."""
    parts = []
    x = flat.astype(np.uint64) + np.uint64(1)
    prefix = np.zeros(len(flat) + 1, np.uint64)
    for prime, base in _FIELDS:
        power, inverse = _powers(prime, base, len(flat) + 1)
        p = np.uint64(prime)
        terms = x * power[:len(flat)]
        np.cumsum(terms if len(flat) < 1 << 24 else terms % p, out=prefix[1:])
        parts.append((prefix[ends] - prefix[starts]) % p * inverse[starts] % p)
    size = (ends - starts).astype(np.uint64)
    return mix64((parts[0] | parts[1] << np.uint64(32)) + size * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (across text borders too)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix64(total)


def bound_batches(spark, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bound the Arrow batches that tasks exchange with Python, in rows and in bytes; the
    workers get the package, whoever built the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
