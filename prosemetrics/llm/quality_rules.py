"""Quality rules: fixed limits on text statistics, then robust multivariate outliers.

Statistics are transformed to a vector for each document.  For each language and source the
minimum covariance determinant gives a centre and a covariance that junk cannot pull: start from
medians with two measures of spread, concentrate a few times on the nearer half of the documents by
Mahalanobis distance, and take the start that ends with the smaller determinant.  Equal vectors,
such as copies have, count once.  A document far from its group's centre is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemetrics.llm.shared import stored
from prosemetrics.llm.textstats import NAMES, with_stats
from prosemetrics.session import sized_broadcast

CONCENTRATIONS = 4
# The last estimates rest on documents within this quantile of the distance, taken so often.
WITHIN, REWEIGHTS = 0.975, 2
# A group's estimate counts as many times as it has different vectors, that of its language (and
# the language's, that of all documents) so many times.
POOL_ROWS = 200
# A typical document lies beyond the cutoff once in so many.
CUTOFF_ODDS = 1000
# The vector, and below what spread a component does not count as spread at all: a rate that is
# the same in nearly every document would otherwise make its least change an outlier.
SPREAD = {
    "word_length": 0.08,
    "symbols": 0.1,
    "upper": 0.1,
    "bangs": 0.12,
    "dup_lines": 0.25,
    "repeats": 0.2,
}
DIMS = len(SPREAD)
# Distances are grouped by their logarithm, in bins of 1/16 of a doubling.
BINS = 16


def vector() -> Column:
    """Roots and logarithms of rates, so that their spread does not depend on their size."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return F.array(
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_upper") / chars),
        F.sqrt(F.col("n_bangs") / words),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi2_cdf(x: float, dims: int) -> float:
    """The chi-squared distribution for an even number of dimensions."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(dims // 2))


def chi2_quantile(share: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dims) < share else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal data is too small by."""
    return share / chi2_cdf(chi2_quantile(share, DIMS), DIMS + 2) if share < 1 else 1.0


KEY = ("group_lang", "group_source")


def _matched(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` with their group's model; the models are few, and their number is checked."""
    models = sized_broadcast(models).select(*[F.col(k).alias(f"m_{k}") for k in KEY], "centre", "inverse")
    same = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in KEY]
    return rows.join(models, same, "left").drop(*[f"m_{k}" for k in KEY])


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``centre``, written out term by term."""
    off = [F.col("x")[i] - F.col("centre")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(i, DIMS):
            total = total + off[i] * off[j] * F.col("inverse")[i * DIMS + j] * F.lit(1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


MODEL = "group_lang string, group_source string, centre array<double>, inverse array<double>, volume double"
COLUMNS = ["group_lang", "group_source", "centre", "inverse", "volume"]


def _model(keys, centre: np.ndarray, covariance: np.ndarray):
    floor = np.diag(np.array(list(SPREAD.values())) ** 2)
    whole = covariance + floor
    return (*keys, centre.tolist(), np.linalg.inv(whole).ravel().tolist(), float(np.linalg.slogdet(whole)[1]))


def _start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A model for each group from its medians and spreads."""
    for frame in batches:
        out = [
            _model((lang, source), np.array(middle), np.diag(np.array(spread) ** 2))
            for lang, source, middle, spread in frame.itertuples(index=False)
        ]
        yield pd.DataFrame(out, columns=COLUMNS)


def _estimate(share: float | None):
    """Mean and covariance of each group from its counts and sums; they rest on the nearest ``share``
    of typical documents, by default on the share of rows that is summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for lang, source, chosen, rows, sums, products in frame.itertuples(index=False):
                mean = np.array(sums) / chosen
                upper = np.zeros((DIMS, DIMS))
                upper[np.triu_indices(DIMS)] = np.array(products) / chosen
                second = upper + np.triu(upper, 1).T
                covariance = (second - np.outer(mean, mean)) * consistency(share or chosen / rows)
                out.append(_model((lang, source), mean, covariance))
            yield pd.DataFrame(out, columns=COLUMNS)

    return run


def _concentrate(rows: DataFrame, models: DataFrame, share: float | None) -> DataFrame:
    """New models from the nearest rows of each group: the nearer half of them, or those within the
    quantile ``share`` of the distance.

    Sums are made for each group and bin of distances, before the shuffle; bins are taken from the
    nearest on until the share is reached, so no group is sorted and none comes together.
    """
    measured = _matched(rows, models).withColumn("d2", distance())
    bin_ = F.floor(F.log2(F.col("d2") + F.lit(1e-9)) * BINS).cast("int")
    x = [F.col("x")[i] for i in range(DIMS)]
    pairs = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    bins = measured.withColumn("bin", bin_).groupBy(*KEY, "bin").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    nearest = Window.partitionBy(*KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEY)
    bins = bins.withColumn("nearer", F.coalesce(F.sum("n").over(nearest), F.lit(0))).withColumn("rows", F.sum("n").over(whole))
    if share is None:
        bins = bins.filter(F.col("nearer") < F.least("rows", F.floor((F.col("rows") + DIMS + 1) / 2)))
    else:
        within = chi2_quantile(share, DIMS)
        bins = bins.filter((F.col("bin") <= math.floor(math.log2(within) * BINS)) | (F.col("nearer") == 0))
    summed = bins.groupBy(*KEY).agg(
        F.sum("n").alias("chosen"),
        F.max("rows").alias("rows"),
        F.array(*[F.sum(f"s{i}") for i in range(DIMS)]).alias("sums"),
        F.array(*[F.sum(f"p{i}_{j}") for i, j in pairs]).alias("products"),
    )
    return stored(summed.mapInPandas(_estimate(share), MODEL), "mcd")


def mcd_models(rows: DataFrame) -> DataFrame:
    """Robust centre and inverse covariance for each group of ``rows`` (group columns and ``x``).

    The number of documents, not of groups, is what grows; groups have one small row each.
    """
    rows = stored(rows.select(*KEY, "x").distinct(), "distinct")
    fine = lambda c: F.round(c * 1024) / 1024
    quartiles = [F.percentile(fine(F.col("x")[i]), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q{i}") for i in range(DIMS)]
    marks = stored(rows.groupBy(*KEY).agg(*quartiles), "quartiles")
    middle = F.array(*[F.col(f"q{i}")[1] for i in range(DIMS)])
    between = F.array(*[(F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in range(DIMS)])
    centres = marks.select(*KEY, middle.alias("centre"), between.alias("inverse"))
    off = [F.percentile(fine(F.abs(F.col("x")[i] - F.col("centre")[i])), F.lit(0.5)) * 1.4826 for i in range(DIMS)]
    spreads = _matched(rows, centres).groupBy(*KEY, "centre").agg(F.array(*off).alias("spread"))
    starts = [spreads.select(*KEY, "centre", "spread"), centres.select(*KEY, "centre", "inverse")]
    ends = []
    for start in starts:
        models = stored(start.mapInPandas(_start, MODEL), "mcd")
        for _ in range(CONCENTRATIONS):
            models = _concentrate(rows, models, None)
        ends.append(models)
    both = ends[0].unionByName(ends[1]).groupBy(*KEY)
    models = stored(both.agg(F.min_by(F.struct(*COLUMNS[2:]), "volume").alias("m")).select(*KEY, "m.*"), "mcd")
    for _ in range(REWEIGHTS):
        models = _concentrate(rows, models, WITHIN)
    return models


def _blend(one, weight: float, other):
    """Centre and covariance of a mixture of two groups."""
    (a, x), (b, y) = one, other
    off = a - b
    return weight * a + (1 - weight) * b, weight * x + (1 - weight) * y + weight * (1 - weight) * np.outer(off, off)


def _shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def read(centre, inverse):
        return np.array(centre), np.linalg.inv(np.array(inverse).reshape(DIMS, DIMS))

    for frame in batches:
        out = []
        for lang, source, *parts in frame.itertuples(index=False):
            (n, *own), (n_lang, *of_lang), (_, *of_all) = parts[:3], parts[3:6], parts[6:]
            pool = _blend(read(*of_lang), n_lang / (n_lang + POOL_ROWS), read(*of_all))
            centre, covariance = _blend(read(*own), n / (n + POOL_ROWS), pool)
            out.append((lang, source, centre.tolist(), np.linalg.inv(covariance).ravel().tolist()))
        yield pd.DataFrame(out, columns=COLUMNS[:4])


def shrunk_models(rows: DataFrame) -> DataFrame:
    """``group_lang, group_source, centre, inverse`` for each language and source of ``rows`` (``lang``, ``source``, ``x``).

    A group's robust estimate is blended with its language's, and that with the estimate of all, by the number of
    different vectors each rests on.  So nothing jumps at any size, and a large group speaks for itself.
    """
    none = F.lit(None).cast("string")
    levels = [("lang", "source"), ("lang", none), (none, none)]
    keys = [F.struct(*[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in zip(KEY, level)]) for level in levels]
    rows = stored(rows.select(F.explode(F.array(*keys)).alias("k"), "x").select("k.*", "x").distinct(), "levels")
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    models = mcd_models(rows).join(sizes.select(*[F.col(k).alias(f"s_{k}") for k in KEY], "n"), [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in KEY])
    models = stored(models.select(*KEY, "n", "centre", "inverse"), "level-models")

    def level(name: str, filled: int) -> DataFrame:
        has = [F.col(k).isNotNull() == (i < filled) for i, k in enumerate(KEY)]
        keys = [F.col(k).alias(k if name == "own" else f"{name}_{k}") for k in KEY[:filled]]
        return models.filter(has[0] & has[1]).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("n", "centre", "inverse")])

    joined = level("own", 2).join(level("lang", 1), F.col("group_lang") == F.col("lang_group_lang")).drop("lang_group_lang")
    joined = joined.join(F.broadcast(level("all", 0)))  # one row
    return stored(joined.mapInPandas(_shrunk, MODEL.rsplit(",", 1)[0]), "shrunk")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``distance``: one row for every row.

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows.  Of
    the others those are kept whose squared distance from their group's robust centre is within the
    cutoff.  Estimates rest on all documents that the base rules pass; equal vectors, as copies
    have, count once, and no component's spread counts as less than ``SPREAD`` says.

    Defined cases: a null text is an empty one (and fails); a null language or source is a group of
    its own, as is the empty string; a small group is judged mostly by its language's estimate
    (:func:`shrunk_models`); ``distance`` is null where the base rules fail; null and repeated ids stay as they
    are; other columns are not read; an empty table gives no rows.
    """
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("lang"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
        F.col(text_col).alias("text"),
    )
    counted = with_stats(slim, list(NAMES), drop_text=True).withColumn("x", vector()).withColumn("base_failed", base_failed())
    counted = stored(counted, "rules")
    passed = counted.filter("not base_failed")
    models = shrunk_models(passed.select("lang", "source", "x"))
    failed = counted.filter("base_failed").withColumns({"d2": F.lit(None).cast("double")})
    judged = _matched(passed.withColumns({"group_lang": F.col("lang"), "group_source": F.col("source")}), models).withColumn("d2", distance())
    columns = ["id", *NAMES[:5], "base_failed", "d2"]
    cutoff = chi2_quantile(1 - 1 / CUTOFF_ODDS, DIMS)
    return (
        judged.select(*columns)
        .unionByName(failed.select(*columns))
        .select(
            F.col("id").alias(id_col),
            *NAMES[:5],
            "base_failed",
            F.coalesce(F.col("d2") <= cutoff, F.lit(False)).alias("kept"),
            F.col("d2").alias("distance"),
        )
    )
