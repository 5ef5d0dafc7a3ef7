"""Language ID by prediction by partial matching over bytes.

Per language a context tree of the last ``ORDER`` bytes: a byte seen in its context is
coded with its count, one not seen costs an escape and is looked up in the next shorter
context, down to a uniform byte.  The counts are frozen after training, so the code
length of a text is a sum over its byte windows, exact and independent of order.
Texts get the language with the shortest code.

The trees of all languages are stored jointly: sorted contexts and windows of each
length with one cost per language, already resolved through all escapes.  A text is
scored from its distinct windows and their counts.

Every label gets a model, from a bounded sample of its documents: at most ``DOCS`` whole
texts, picked by a hash of the id.  Tasks count the windows of those texts and Spark adds
the counts, so no text reaches the driver.  Trees of ``LANG_BLOCK`` languages are stored
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FOLD, bound_batches, rounds, shared_table

ORDER = 3
DOCS = 300
#: Languages whose trees share one table of contexts.
LANG_BLOCK = 32
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows(flat: np.ndarray, width: int) -> np.ndarray:
    """Value of the last ``width`` bytes at every place; before the text stand zeros."""
    v = np.zeros(len(flat), np.uint32)
    for back in range(width):
        part = np.zeros(len(flat), np.uint32)
        part[back:] = flat[:max(0, len(flat) - back)]
        v |= part << np.uint32(8 * back)
    return v


class ContextTrees:
    """Frozen PPM models of several languages."""

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int = ORDER):
        """``counts``: per language and order its windows, ascending, and how often each is found."""
        self.langs, self.order = sorted(counts), order
        n_lang = len(self.langs)
        self.keys: list[np.ndarray] = []      # per order: windows seen in any language
        self.costs: list[np.ndarray] = []     # bits of the last byte, per language
        self.contexts: list[np.ndarray] = []  # per order: contexts seen in any language
        self.escapes: list[np.ndarray] = []   # bits of leaving the context
        for k in range(order + 1):
            seen = [counts[lang][k] for lang in self.langs]
            keys = np.unique(np.concatenate([s[0] for s in seen]))
            contexts = np.unique(keys >> np.uint32(8))
            escapes = np.zeros((len(contexts), n_lang))
            lower = self._cost(keys & np.uint32((1 << (8 * k)) - 1), k - 1)
            costs = np.empty((len(keys), n_lang))
            for j, (w, c) in enumerate(seen):
                at = np.searchsorted(contexts, w >> np.uint32(8))
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    # Method C: an escape counts once for each byte the context has seen.
                    escapes[:, j] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                here = np.searchsorted(contexts, keys >> np.uint32(8))
                costs[:, j] = escapes[here, j] + lower[:, j]
                costs[np.searchsorted(keys, w), j] = -np.log2(c / (total + kinds)[at])
            self.keys.append(keys)
            self.costs.append(costs)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    def _cost(self, w: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each (k + 1)-byte window, per language."""
        if k < 0:
            return np.full((len(w), len(self.langs)), 8.0)
        if not len(self.keys[k]):
            return self._cost(w & np.uint32((1 << (8 * k)) - 1), k - 1)
        at = np.minimum(np.searchsorted(self.keys[k], w), len(self.keys[k]) - 1)
        out = self.costs[k][at]
        miss = np.flatnonzero(self.keys[k][at] != w)
        if len(miss):
            m = w[miss]
            c = np.minimum(np.searchsorted(self.contexts[k], m >> np.uint32(8)), len(self.contexts[k]) - 1)
            known = self.contexts[k][c] == m >> np.uint32(8)
            out[miss] = np.where(known[:, None], self.escapes[k][c], 0.0) + self._cost(
                m & np.uint32((1 << (8 * k)) - 1), k - 1)
        return out

    def bits(self, flat: np.ndarray) -> np.ndarray:
        """Code length of one text under each language."""
        w, n = np.unique(windows(flat, self.order + 1), return_counts=True)
        return n @ self._cost(w, self.order)


def count_windows(texts: list[np.ndarray], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order the windows of some texts and their counts."""
    return [np.unique(np.concatenate([windows(t, k + 1) for t in texts]) if texts else np.zeros(0, np.uint32),
                      return_counts=True) for k in range(order + 1)]


def _fold(flat: np.ndarray) -> np.ndarray:
    return FOLD[flat]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each language in a round of texts: (lang, k, w, n)."""
    for batch in batches:
        for rows, flat, offsets in rounds(batch, "text"):
            flat, own = _fold(flat), {}
            for i, lang in enumerate(rows.column("lang").to_pylist()):
                own.setdefault(lang, []).append(flat[offsets[i]:offsets[i + 1]])
            for lang, texts in own.items():
                for k, (w, n) in enumerate(count_windows(texts)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(w), pa.string()), pa.array(np.full(len(w), k, np.int32)),
                         pa.array(w.astype(np.int64)), pa.array(n)], ["lang", "k", "w", "n"])


def _predict(blocks: list[ContextTrees]):
    langs = [x for trees in blocks for x in trees.langs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, "text"):
                flat, lang, score = _fold(flat), [], []
                texts = rows.column("text")
                for i in range(rows.num_rows):
                    text = texts[i].as_py()
                    if not langs or not _LETTER.search(text or ""):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    own = flat[offsets[i]:offsets[i + 1]]
                    bits = np.concatenate([trees.bits(own) for trees in blocks])
                    best = int(bits.argmin())
                    lang.append(langs[best])
                    # Posterior of the best language with equal priors.
                    score.append(float(1.0 / np.exp2(-np.minimum(bits - bits[best], 1000.0)).sum()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(lang, pa.string()),
                     pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def held_out(doc_id) -> F.Column:
    """A quarter of the ids, by checksum of their text form (null: the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, per_lang: int = DOCS) -> list[ContextTrees]:
    """Models of all labels, in blocks of languages, from at most ``per_lang`` texts each."""
    known = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    totals = shared_table(known.groupBy("lang").agg(F.count(F.lit(1)).alias("total")), "langs")  # a row a language
    # By hash of the id: a share that holds twice the wanted number, then the first of it.
    h = F.xxhash64(F.lit("langid"), "doc_id")
    share = F.pmod(h, F.lit(1 << 32)) * F.col("total") < 2.0 * per_lang * (1 << 32)
    picked = (known.join(F.broadcast(totals), "lang").where(share)
              .groupBy("lang", h.alias("h")).agg(F.min("text").alias("text")))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    texts = picked.withColumn("n", n).where(F.col("n") <= per_lang).select("lang", "text")
    counted = texts.mapInArrow(_count, "lang string, k int, w long, n long").groupBy("lang", "k", "w").agg(
        F.sum("n").alias("n"))
    # The models themselves: windows of up to four bytes.
    table = counted.orderBy("lang", "k", "w").toArrow()
    lang, k = table.column("lang").to_pylist(), table.column("k").to_numpy()
    w, n = table.column("w").to_numpy().astype(np.uint32), table.column("n").to_numpy()
    names = sorted({r.lang for r in totals.select("lang").collect()})
    code = {x: i for i, x in enumerate(names)}
    at = np.fromiter((code[x] for x in lang), np.int64, len(lang)) * (ORDER + 1) + k
    order = np.argsort(at, kind="stable")  # by language and order; windows stay ascending
    at, w, n = at[order], w[order], n[order]
    edge = np.searchsorted(at, np.arange(len(names) * (ORDER + 1) + 1))
    counts = {x: [(w[edge[j]:edge[j + 1]], n[edge[j]:edge[j + 1]]) for j in range(i * (ORDER + 1), (i + 1) * (ORDER + 1))]
              for i, x in enumerate(names)}
    return [ContextTrees({x: counts[x] for x in names[i:i + LANG_BLOCK]}) for i in range(0, len(names), LANG_BLOCK)]


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (posterior of the prediction).

    ``und`` with score 0 for a null text, one without letters, or where no document is
    labelled.  Repeated rows are predicted alike; null ids belong to the training part;
    an empty table gives an empty result.  Only doc_id and text reach the prediction.
    """
    bound_batches(docs.sparkSession)
    trees = train(docs)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(_predict(trees), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
