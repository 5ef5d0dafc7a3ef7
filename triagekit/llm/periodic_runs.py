"""Periodic runs of words: online sparse diagonal dynamic programming.

A run of period q is a stretch in which every word equals the word q places before it,
that is, a diagonal of matches at lag q in the text's comparison with itself.  Going
through the words, each word's earlier occurrences carry on the diagonals of their lags;
a diagonal that ends after enough matches emits its run at once.

The diagonals are kept sparse in two exact steps, so that a word which is every second
word of a text costs no more than any other.

* An occurrence counts with its context: the words from it on, as wide as periods of its
  scale need (16 words for periods below 16, then 32 for 16 to 31, and so on).  A run of
  ``max(24, 3 q)`` words holds such a context on its diagonal at least once.  Contexts are
  named exactly, by doubling: the name of 2 m words is the rank of a pair of names.
* Of the earlier occurrences of a context only the latest carries on a diagonal.  Inside a
  run whose smallest period is q, a context of q words or more recurs exactly q places
  later and never sooner (two periods p and q of p + q words have their greatest common
  divisor as a period too), so the latest occurrence lies on the run's own diagonal for as
  long as the run lasts, and no multiple of the period can be mistaken for it.

Words, names and diagonals are arrays of one bounded round of texts; a text is never
split, and a text needs memory in proportion to its own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, bound_batches, mix64, rounds, word_spans

#: Shortest run in words, and in periods.
MIN_WORDS = 24
MIN_PERIODS = 3
#: Context of the smallest scale: at most ``MIN_WORDS * (MIN_PERIODS - 1) / MIN_PERIODS``
#: words, so that every run holds one on its diagonal.
CONTEXT = 16

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
                      T.StructField("collapsed", T.StringType())])


def word_numbers(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of every word, the words): equal numbers are equal bytes."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat[~IS_SPACE[flat]]))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), words


def with_repeated_context(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts in which some context of the smallest scale may stand twice.

    By hashes, so texts may be named that have none; none that has one is left out.
    """
    h = mix64(numbers.astype(np.uint64))
    width = 1
    while width < CONTEXT:
        h = mix64(h[:max(len(h) - width, 0)] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
        width *= 2
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(h)]
    inside = np.flatnonzero(np.arange(len(h)) + CONTEXT <= first[text + 1])
    key = h[inside] + text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return np.unique(text[inside[order[1:][same]]])


def latest_lags(names: np.ndarray) -> np.ndarray:
    """Distance of every place to the latest earlier place of one name; 0 if there is none."""
    order = np.argsort(names, kind="stable")
    out = np.zeros(len(names), np.int64)
    same = names[order[1:]] == names[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(numbers: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of one text's word numbers, by start and period."""
    n, out = len(numbers), []
    names, width = numbers, 1
    while len(names) and (width <= CONTEXT or width // 2 * MIN_PERIODS <= n):
        if width >= CONTEXT:
            lags = latest_lags(names)
            if not lags.any():  # no context of this width stands twice, so no wider one does
                break
            lags[(lags < (1 if width == CONTEXT else width // 2)) | (lags >= width)] = 0
            # A diagonal lives as long as the lag stays; one that ends long enough is a run.
            edge = np.flatnonzero(np.diff(lags, prepend=0, append=0))
            begin, end = edge[:-1][lags[edge[:-1]] > 0], edge[1:][lags[edge[:-1]] > 0]
            period = lags[begin]
            length = end + width - 1 - begin + period
            keep = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
            out.append(np.stack([begin - period, length, period], 1)[keep])
        left, right = names[:max(len(names) - width, 0)], names[width:]
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1]
        width *= 2
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeated_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Mask of the words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, flat, offsets in rounds(batch, "__text"):
            starts, ends, first = word_spans(flat, offsets)
            numbers, words = word_numbers(flat, starts, ends)
            stay = np.ones(len(numbers), bool)
            per_text, found = np.zeros(rows.num_rows + 1, np.int64), []
            for i in with_repeated_context(numbers, first).tolist():
                runs = runs_of(numbers[first[i]:first[i + 1]])
                stay[first[i]:first[i + 1]] &= ~repeated_words(int(first[i + 1] - first[i]), runs)
                per_text[i + 1] = len(runs)
                found.append(runs)
            runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            before = np.zeros(len(stay) + 1, np.int64)
            np.cumsum(stay, out=before[1:])
            kept = pa.LargeListArray.from_arrays(before[first], words.filter(pa.array(stay)))
            collapsed = pc.binary_join(kept, pa.scalar(b" ", pa.large_binary()))
            listed = pa.ListArray.from_arrays(
                np.cumsum(per_text).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(c) for c in runs.T.copy()], ["start", "length", "period"]))
            put = pa.StructArray.from_arrays(
                [pa.array(np.diff(first)), listed, collapsed.cast(pa.string())], ["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([rows.column("row"), put], ["row", "found"])


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``found``: n_words, runs (start, length and period in
    words, by start and period) and collapsed (the words outside the repetitions, joined by
    one space).

    A null, empty or blank text has no words, no runs and an empty ``collapsed``; repeated
    rows and ids each get their own result; an empty table gives an empty result.  A column
    of the input called ``found`` is replaced; others may have any name.
    """
    bound_batches(docs.sparkSession, 2000, 8 << 20)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([d.schema["row"], T.StructField("found", FOUND)])
    out = d.mapInArrow(_find, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "found"], "found")


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every run reduced to its first period; texts without runs stay as
    they are, byte for byte.  Edge cases as in :func:`find_runs`."""
    found = find_runs(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                  F.col(f"`{text_col}`").alias("text")))
    text = F.when(F.size("found.runs") > 0, F.col("found.collapsed")).otherwise(F.col("text"))
    return found.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def repeat_from(text: Column, begin: Column, period: Column, n: Column, words: Column) -> Column:
    """``text`` with its words from ``begin`` on replaced by repetitions of the ``period``
    words that stand there; array functions only."""
    rest = n - begin
    cycle = F.flatten(F.array_repeat(F.slice(words, begin + 1, period), F.ceil(rest / period).cast("int")))
    return F.array_join(F.concat(F.slice(words, F.lit(1), begin), F.slice(cycle, F.lit(1), rest)), " ")


def run_digest(docs: DataFrame) -> DataFrame:
    """The digest of :func:`find_runs` per document, over texts of which the ids' checksums
    choose a tenth to be made periodic first (test data for the operator; see
    ``repeat_from``).  A null id has no checksum, so its text stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    d = docs.select("doc_id", "text", (h / 10).cast("long").alias("g"),
                    F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("w"))
    d = d.withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    text = F.when(F.col("n") > 0, repeat_from(F.col("text"), F.col("a"), F.col("p"), F.col("n"), F.col("w"))
                  ).otherwise(F.col("text"))
    found = find_runs(d.select("doc_id", text.alias("text")))

    def better(x: Column, y: Column) -> Column:  # exact fractions; the list is by start and period
        return y["length"] * x["period"] > x["length"] * y["period"]
    runs = F.col("found.runs")
    best = F.aggregate(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)),
                       lambda x, y: F.when(better(x, y), y).otherwise(x))
    listing = F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(listing.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256")))
