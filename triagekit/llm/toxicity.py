"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

Features of a whole text: density and number of lexicon words and lexicon stems, words
that meet the lexicon only once look-alike characters are undone, share of hits near a
second-person word, capitals, exclamation marks, punctuation, words with digits or
symbols inside, length.  The lexicon is learned: words and byte stems that are far
commoner in documents labelled toxic, by a likelihood-ratio test corrected for the
number of candidates.

Lexicon, trees and calibration are fitted on a bounded sample of the labelled training
documents (``TOXIC`` and ``CLEAN`` documents, ``CHARS`` characters of each), weighted
back to the corpus' shares; calibration uses documents the trees did not see.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FOLD, bound_batches, mix64, rounds, shared_table, span_hashes, word_spans
from .langid import held_out
from .textstats import PUNCT, UPPER, per_text

TOXIC, CLEAN = 2000, 8000
STEMS = (4, 5, 6)
MIN_ODDS = 3.0     # natural log of how much likelier in toxic documents
MAX_LEXICON = 5000
NEAR = 5           # words
TREES, DEPTH = 20, 3
THRESHOLD = 0.3
FEATURES = 11

#: Second-person words, English, German, French, Spanish.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine ihr euch euer "
                 "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros").split()

#: A word byte of the lexicon rule: ASCII letters and digits and everything beyond.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Look-alikes undone: digits and symbols that stand for letters.
_LOOKS = FOLD.copy()
for _a, _b in zip(b"01345789@$|+", b"oieastbgasit", strict=True):
    _LOOKS[_a] = _b
_LOOK_GAP = _GAP.copy()
_LOOK_GAP[[ord(c) for c in "@$|+*"]] = False
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARK = np.zeros(256, np.int64)
_MARK[ord("!")] = 1
_LETTERS = _IS_LETTER.astype(np.int64)
_ODD = (~_GAP & ~_IS_LETTER) | (_LOOK_GAP != _GAP)


def _hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    flat = np.frombuffer(data, np.uint8)
    a, b, _ = word_spans(flat, np.array([0, len(flat)]), _GAP)
    return np.sort(span_hashes(FOLD[flat], a, b))


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def _stem_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words long enough, hash of their first k bytes) for each stem length."""
    out = []
    for k in STEMS:
        at = np.flatnonzero(ends - starts > k)
        out.append((at, mix64(span_hashes(flat, starts[at], starts[at] + k) + np.uint64(k))))
    return out


class Lexicon:
    def __init__(self, words: np.ndarray, stems: np.ndarray):
        self.words, self.stems = np.sort(words), np.sort(stems)
        self.second = _hash_words(SECOND_PERSON)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def features(flat: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = len(offsets) - 1
    folded = FOLD[flat]
    starts, ends, first = word_spans(flat, offsets, _GAP)
    words = span_hashes(folded, starts, ends)
    hit = _member(lexicon.words, words)
    stem = np.zeros(len(words), bool)
    for at, h in _stem_hashes(folded, starts, ends):
        stem[at] |= _member(lexicon.stems, h)
    either = hit | stem
    # Near a second-person word of the same text.
    you = np.concatenate([[0], np.cumsum(_member(lexicon.second, words))])
    owner = np.repeat(np.arange(n), np.diff(first))
    place = np.arange(len(words))
    lo = np.maximum(place - NEAR, first[owner])
    hi = np.minimum(place + NEAR + 1, first[owner + 1])
    near = either & (you[hi] - you[lo] > 0)
    # Words with characters that stand for letters.
    looks = _LOOKS[flat]
    s2, e2, f2 = word_spans(flat, offsets, _LOOK_GAP)
    odd = np.concatenate([[0], np.cumsum(_ODD[flat])])
    letters = np.concatenate([[0], np.cumsum(_IS_LETTER[flat])])
    mixed = (odd[e2] > odd[s2]) & (letters[e2] > letters[s2])
    m = np.flatnonzero(mixed)
    undone = np.zeros(len(s2), bool)
    if len(m):
        undone[m] = _member(lexicon.words, span_hashes(looks, s2[m], e2[m]))
        for at, h in _stem_hashes(looks, s2[m], e2[m]):
            undone[m[at]] |= _member(lexicon.stems, h)
    count = np.maximum(np.diff(first), 1).astype(float)
    n_hit, n_stem, n_both = _sums(hit, first), _sums(stem, first), _sums(either, first)
    n_letters = np.maximum(per_text(_LETTERS, flat, offsets), 1)
    size = np.maximum(np.diff(offsets), 1)
    return np.column_stack([
        n_hit / count, n_stem / count, np.log1p(n_hit), np.log1p(n_stem), _sums(undone, f2) / count,
        _sums(near, first) / np.maximum(n_both, 1), per_text(UPPER, flat, offsets) / n_letters,
        per_text(_MARK, flat, offsets) / count, per_text(PUNCT, flat, offsets) / size,
        _sums(mixed, f2) / count, np.log(count)])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words (kind 0) and stems (kind 1) of every sampled text, by hash."""
    for batch in batches:
        for rows, flat, offsets in rounds(batch, "text", 1 << 20):
            folded = FOLD[flat]
            starts, ends, first = word_spans(flat, offsets, _GAP)
            words, stems = span_hashes(folded, starts, ends), _stem_hashes(folded, starts, ends)
            toxic = rows.column("toxic").to_pylist()
            for i in range(rows.num_rows):
                w = np.unique(words[first[i]:first[i + 1]])
                s = np.unique(np.concatenate([h[np.searchsorted(at, first[i]):np.searchsorted(at, first[i + 1])]
                                              for at, h in stems]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [len(w), len(s)]), pa.int32()),
                     pa.array(np.concatenate([w, s]).view(np.int64)),
                     pa.array(np.full(len(w) + len(s), toxic[i], np.int32))], ["kind", "token", "toxic"])


def _score_rows(lexicon: Lexicon, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, "text", 1 << 20):
                x = features(flat, offsets, lexicon)
                border = np.arange(0, x.size + 1, FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in carried],
                     pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(x.reshape(-1)))],
                    names=[*carried, "x"])
    return run


def text_features(docs: DataFrame, lexicon: Lexicon, carried: list[str]) -> DataFrame:
    d = docs.select(*carried, "text")
    schema = ", ".join([f"{c} {t}" for c, t in d.dtypes if c != "text"] + ["x array<double>"])
    return d.mapInArrow(_score_rows(lexicon, carried), schema)


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(text, toxic, weight, fold): at most ``toxic`` + ``clean`` rows, whole texts."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    h = F.xxhash64(F.lit("toxicity"), "doc_id")
    most = F.when(F.col("toxic") == 1, toxic).otherwise(clean)
    total = F.when(F.col("toxic") == 1, counts.get(1, 0)).otherwise(counts.get(0, 0))
    picked = known.withColumn("h", h).where(F.pmod("h", F.lit(1 << 32)) * total < most * 2.0 * (1 << 32))
    n = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    picked = picked.withColumn("n", n).where(F.col("n") <= most)
    weight = total / F.least(total, most)
    picked = picked.select("doc_id", "toxic", weight.alias("weight"), (F.pmod("h", F.lit(10)) < 3).cast("int").alias("fold"))
    # At most toxic + clean ids, so the broadcast is bounded.
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.join(F.broadcast(shared_table(picked, "sample-ids")), "doc_id")
    return shared_table(d.groupBy("doc_id", "toxic", "weight", "fold").agg(F.min("text").alias("text")), "sample")


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Significant words and stems: at most ``MAX_LEXICON``, the most telling first."""
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    A, B = n.get(1, 0), n.get(0, 0)
    if not A or not B:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    t = sample.select("text", "toxic").mapInArrow(_candidates, "kind int, token long, toxic int")
    t = t.groupBy("kind", "token").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    t = shared_table(t.where("a + b > 1"), "lexicon")
    kinds = max(2, t.count())
    a, b = F.col("a") * 1.0, F.col("b") * 1.0
    ea, eb = (a + b) * A / (A + B), (a + b) * B / (A + B)
    g2 = 2 * (F.when(a > 0, a * F.log(a / ea)).otherwise(0.0) + F.when(b > 0, b * F.log(b / eb)).otherwise(0.0))
    odds = F.log((a + 0.1) / A) - F.log((b + 0.1) / B)
    best = t.where((odds >= MIN_ODDS) & (g2 >= 2 * (math.log(kinds) + 3))).orderBy(g2.desc(), "token").limit(MAX_LEXICON)
    rows = best.select("kind", "token").collect()
    pick = [np.array([r.token for r in rows if r.kind == k], np.int64).view(np.uint64) for k in (0, 1)]
    return Lexicon(*pick)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    Null and empty texts get the score of a text without words; null ids belong to the
    training part but are never sampled; repeated rows score alike; without labels of
    both classes every score is the share of toxic labels (0 if none).  Only text
    reaches the features.
    """
    # Here, not above: the tasks' Python workers have no use for these modules.
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    bound_batches(docs.sparkSession, 1000, 8 << 20)
    sample = training_sample(docs, labels)
    lexicon = learn_lexicon(sample)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = text_features(d, lexicon, ["doc_id", "held_out"])
    classes = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        score = F.lit(1.0 if classes.get(1) else 0.0)
    else:
        train = text_features(sample.select("toxic", "weight", "fold", "text"), lexicon, ["toxic", "weight", "fold"])
        train = train.select(array_to_vector("x").alias("x"), F.col("toxic").cast("double").alias("label"),
                             "weight", "fold")
        train = shared_table(train.coalesce(2), "features")
        # Too small a sample for a fold of its own calibrates on all of it.
        folds = {(r.label, r.fold) for r in train.select("label", "fold").distinct().collect()}
        fit, check = (train.where("fold = 0"), train.where("fold = 1")) if len(folds) == 4 else (train, train)
        model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                              stepSize=0.3, seed=7).fit(fit)
        raw = vector_to_array("probability")[1]
        check = model.transform(check).select(raw.alias("raw1"), "label", "weight")
        iso = IsotonicRegression(featuresCol="raw1", labelCol="label", weightCol="weight", predictionCol="iso").fit(check)
        out = model.transform(out.withColumn("x", array_to_vector("x"))).withColumn("raw1", raw)
        out = iso.transform(out)
        # The step function ties many texts; the trees' own order breaks ties within 0.001.
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("iso") * 0.999 + F.col("raw1") * 0.001))
    out = out.withColumn("score", score)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
