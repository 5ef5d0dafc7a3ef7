"""Quality rules: base counts, then robust multivariate outliers per language and source.

Texts that pass the base rule become vectors of transformed statistics.  For every
(language, source) the minimum-covariance-determinant estimate of centre and scatter
comes from concentration steps over all its documents: distances under the current
estimate, the half of the rows (``SUBSET``) with the smallest ones, their mean and
covariance, and again.  Half a group may be junk without moving it; as the half's
scatter is too narrow for a long-tailed group, a last step takes the moments of all rows
below ``REWEIGHT`` (the reweighted estimate).  A document whose Mahalanobis distance to its group's estimate
is above the cut is rejected.  Groups with too few documents use their language's
estimate, or that of all.

Every step is a grouped aggregate over the narrow vector table (histograms and sums,
combined before the shuffle), so a source holding a third of all rows is no single
task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import maybe_broadcast
from .common import bound_batches, rounds, shared_table
from .textstats import statistics

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: log words, log distinct words, log mean word length, root symbols a word, root
#: punctuation a word, log words a line.
DIMS = 6
#: Least standard deviation of each of them; keeps near-constant statistics (no symbols
#: at all in clean text) from turning any difference into an outlier.
FLOOR = (0.1, 0.02, 0.02, 0.05, 0.03, 0.1)
SUBSET = 0.5
STEPS = 5
#: Squared distance (scaled) below which rows enter the reweighting step: the chi-square
#: law's 0.99999 quantile.
REWEIGHT = 33.1
#: Documents a group needs for an estimate of its own.
MIN_GROUP = 200
#: Squared distance (scaled to the chi-square law by its median) above which a text is
#: rejected; a text of n words counts n / (n + SHORT) of its distance, as the
#: statistics of short texts scatter more.
CUT = 100.0
SHORT = 20.0
#: Median of the chi-square law with DIMS degrees of freedom.
CHI_MEDIAN = DIMS * (1 - 2 / (9 * DIMS)) ** 3
#: Groups whose estimates are broadcast (more are joined by shuffle).
MAX_BROADCAST = 20_000
#: Histogram cells per unit (values) and per octave (distances).
GRID = 512
OCTAVE = 64

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_distinct", "n_punct")


def _stats(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, "text"):
                s = statistics(flat, offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in carried] + [pa.array(s[c]) for c in _BASE + _MORE],
                    names=[*carried, *_BASE, *_MORE])
    return run


def text_statistics(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns of ``docs`` plus the statistics of its ``text``."""
    bound_batches(docs.sparkSession)
    d = docs.select(*carried, "text")
    schema = ", ".join([f"`{c}` {t}" for c, t in d.dtypes if c != "text"] + [f"{c} long" for c in _BASE + _MORE])
    return d.mapInArrow(_stats(carried), schema)


def _vector() -> Column:
    n = F.col("n_words")
    return F.array(F.log(n), F.log("n_distinct"), F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n),
                   F.sqrt(F.col("n_punct") / n), F.log(n / F.col("n_lines")))


#: Pairs of statistics, once each: the entries of a symmetric matrix.
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _squared(center: str, precision: str) -> tuple[Column, Column]:
    """(x - center, its quadratic form); ``precision`` holds the matrix row by row, ``d`` the first."""
    d = F.zip_with("x", center, lambda a, b: a - b)
    inner = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.aggregate(
        F.zip_with("d", F.slice(precision, i * DIMS + 1, F.lit(DIMS)), lambda a, b: a * b),
        F.lit(0.0), lambda s, v: s + v))
    return d, F.greatest(F.aggregate(F.zip_with("d", inner, lambda a, b: a * b), F.lit(0.0),
                                     lambda s, v: s + v), F.lit(0.0))


def _with_distance(df: DataFrame, center: str, precision: str) -> DataFrame:
    d, squared = _squared(center, precision)
    return df.withColumn("d", d).withColumn("d", squared)


def _quantiles(cells: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, cell) rows -> per key the first cell at which each share of rows is reached.

    Cells are counted before the shuffle; a key's window holds its distinct cells only.
    """
    h = cells.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    h = h.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    return h.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("cell"))).alias(f"q{i}")
                                  for i, q in enumerate(qs)])


def _distance_cell() -> Column:
    return F.round(F.log2(F.col("d") + 1e-6) * OCTAVE).cast("int")


def _precision(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of each group's subset -> centre and inverse scatter (with the floors)."""
    for f in batches:
        if not f.num_rows:
            continue
        n = f.column("n").to_numpy().astype(float)[:, None]
        m = np.array(f.column("s").to_pylist()) / n
        moments = np.array(f.column("ss").to_pylist()) / n
        second = np.empty((f.num_rows, DIMS, DIMS))
        for k, (i, j) in enumerate(PAIRS):
            second[:, i, j] = second[:, j, i] = moments[:, k]
        cov = second - m[:, :, None] * m[:, None, :] + np.diag(np.square(FLOOR))
        p = np.linalg.inv(cov).reshape(-1, DIMS * DIMS)
        yield pa.RecordBatch.from_arrays([f.column("grp"), pa.array(m.tolist(), pa.list_(pa.float64())),
                                          pa.array(p.tolist(), pa.list_(pa.float64()))], ["grp", "center", "precision"])


def _groups() -> list[Column]:
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    return [F.concat(F.lit("0"), F.to_json(F.array(lang, source))), F.concat(F.lit("1"), lang), F.lit("2")]


def robust_estimates(vectors: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, x) -> (grp, center, precision, scale) for every group of enough rows."""
    g = vectors.select(F.explode(F.array(*_groups())).alias("grp"), "x")
    large = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_group).select("grp")
    large = shared_table(large, "groups")
    # Estimates take about 500 bytes a group: with few groups the rows stay where they are.
    few = large.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    g = g.join(side(large), "grp")
    # Start: medians and quartile ranges of each statistic.
    cells = g.select("grp", F.posexplode("x").alias("dim", "v")).select(
        "grp", "dim", F.round(F.col("v") * GRID).cast("int").alias("cell"))
    q = _quantiles(cells, ["grp", "dim"], [0.25, 0.5, 0.75])
    floor = F.element_at(F.array(*[F.lit(x) for x in FLOOR]), F.col("dim") + 1)
    sd = F.greatest((F.col("q2") - F.col("q0")) / (GRID * 1.349), floor)
    q = q.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(  # DIMS entries a group
        "dim", (F.col("q1") / GRID).alias("m"), (F.lit(1.0) / (sd * sd)).alias("p")))).alias("a"))
    diagonal = F.flatten(F.transform("a", lambda e: F.transform(
        F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda j: F.when(j == e["dim"], e["p"]).otherwise(0.0))))
    est = shared_table(q.select("grp", F.col("a.m").alias("center"), diagonal.alias("precision")), "mcd")
    wide = round(math.log2(REWEIGHT / CHI_MEDIAN) * OCTAVE)  # in cells above the median's
    for step in range(STEPS + 2):
        d = _with_distance(g.join(side(est), "grp"), "center", "precision")
        cells = d.select("grp", _distance_cell().alias("cell"))
        cut = _quantiles(cells, ["grp"], [SUBSET, 0.5])
        if step > STEPS:
            scale = F.lit(CHI_MEDIAN) / F.pow(F.lit(2.0), F.col("q1") / OCTAVE)
            return shared_table(est.join(cut, "grp").select("grp", "center", "precision", scale.alias("scale")), "mcd")
        top = F.col("q1") + wide if step == STEPS else F.col("q0")
        inner = d.join(side(cut), "grp").where(_distance_cell() <= top)
        sums = inner.groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(DIMS)]).alias("s"),
            F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS]).alias("ss"))
        est = shared_table(sums.mapInArrow(_precision, "grp string, center array<double>, precision array<double>"),
                           "mcd")


def judge(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Rows with statistics, lang and source -> plus base_failed, distance and kept.

    A null, empty or blank text has no words and fails the base rule; null languages
    and sources are groups of their own; repeated rows count each; with fewer than
    ``min_group`` documents in all there is no estimate and the base rule decides.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    s = stats.withColumn("base_failed", failed)
    vectors = s.where("not base_failed").select("lang", "source", _vector().alias("x"))
    est = robust_estimates(shared_table(vectors, "vectors"), min_group)
    est = est.select("grp", F.struct("center", "precision", "scale").alias("e"))
    small = est.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    for i, c in enumerate(_groups()):
        side = est.select(F.col("grp").alias(f"__g{i}"), F.col("e").alias(f"__e{i}"))
        s = s.join(F.broadcast(side) if small else side, c == F.col(f"__g{i}"), "left")
    s = s.withColumn("__e", F.coalesce("__e0", "__e1", "__e2")).withColumn(
        "x", F.when(~F.col("base_failed"), _vector()))
    share = F.col("n_words") / (F.col("n_words") + SHORT)
    s = _with_distance(s, "__e.center", "__e.precision").withColumn(
        "distance", F.col("d") * F.col("__e.scale") * share)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return s.withColumn("kept", kept).drop("__e", "x", "d", *[f"__{c}{i}" for c in "ge" for i in range(3)])


def quality_digest(docs: DataFrame) -> DataFrame:
    stats = shared_table(text_statistics(docs.select("doc_id", "lang", "source", "text"),
                                         ["doc_id", "lang", "source"]), "stats")
    return judge(stats).select("doc_id", *_BASE, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; rows are matched by what the verdict depends on.

    Null, empty, blank and short texts go; null languages and sources are groups of their
    own; repeated rows share a verdict; an empty table stays empty; columns may have any
    name.
    """
    key = [F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("lang", "source", "text")]),
           F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    d = docs.select("lang", "source", "text", key[0].alias("__k"), key[1].alias("__c"))
    stats = shared_table(text_statistics(d, ["lang", "source", "__k", "__c"]), "stats")
    bad = shared_table(judge(stats).where("not kept").select("__k", "__c").distinct(), "rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key[0].alias("k"), key[1].alias("c"))
    kept = rows.join(maybe_broadcast(bad), (F.col("k") == F.col("__k")) & (F.col("c") == F.col("__c")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
