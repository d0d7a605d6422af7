"""Document quality by histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.boosting import Trees, fit
from prosemetrics.llm.shared import free_name, stored
from prosemetrics.llm.textstats import NAMES, with_stats

# Labelled rows that the trees are fitted on, at most: those with the smallest hashes of their id.
TRAINING_ROWS = 20_000
MODULUS, HELD_OUT = 3, 1


def held_out(id_column):
    """Whether a label is never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % MODULUS == HELD_OUT, F.lit(False))


def features(stats: np.ndarray) -> np.ndarray:
    """Rates from the statistics in the order of ``NAMES``; none depends on how long a text is but
    for its logarithm."""
    s = dict(zip(NAMES, stats.astype(np.float64).reshape(-1, len(NAMES)).T))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_upper"] / chars,
            s["n_bangs"] / words,
            s["n_digits"] / chars,
            s["n_stops"] / words,
            s["n_repeat_words"] / words,
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            s["n_lines"] / words,
            s["n_distinct"] / words,
        ],
        axis=1,
    )


def train(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str = "quality") -> Trees:
    """Fit on labelled rows outside the held-out third; ``stats`` has the id and ``NAMES``.

    Labels of a repeated id must agree: ids with two different labels are left out.  The bounded
    sample is the only thing that comes to the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    known = known.filter("low = high").orderBy(F.xxhash64("label_id"), "label_id").limit(TRAINING_ROWS)
    sample = stats.join(known, F.col(id_col) == F.col("label_id")).select("label_id", "low", *NAMES)
    # Of documents that share an id one is learnt from: the first by its statistics.
    first = sample.groupBy("label_id").agg(F.min(F.struct("low", *NAMES)).alias("r")).select("r.*")
    table = first.toPandas().sort_values(["low", *NAMES]).to_numpy(dtype=np.float64).reshape(-1, len(NAMES) + 1)
    return fit(features(table[:, 1:]), table[:, 0])


def add_score(frame: DataFrame, stats: list[str], model: Trees, name: str) -> DataFrame:
    """``frame`` with the model's score of the statistics in its columns ``stats``."""
    places = [frame.columns.index(c) for c in stats]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in places], axis=1)
            scores = model.score(features(table))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    schema = frame.withColumn(name, F.lit(0.0)).schema
    for field in schema:
        field.nullable = True
    return frame.mapInArrow(add, schema)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row for every row of ``docs``.

    ``score`` (0 to 1) says how likely label 1 is, from the text's statistics alone; ``predicted``
    is 1 from 0.5 on.

    Defined cases: a null text is an empty one and gets a score; a null id is never held out and
    never learnt from; repeated rows are scored alike; without labels, or with one label only, all
    scores are the same constant; other columns are not read; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    stats = stored(with_stats(slim, list(NAMES), drop_text=True), "quality")
    model = train(stats, labels.select(F.col(id_col), F.col(label_col)), id_col, label_col)
    scored = add_score(stats, list(NAMES), model, "score")
    return scored.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Cases are defined as in :func:`quality_scores`; where all scores are one constant because no
    label tells documents apart, all rows are kept.
    """
    names = []
    for name in NAMES:
        names.append(free_name([*docs.columns, *names], name))
    score = free_name([*docs.columns, *names], "score")
    # Statistics are counted twice, to train and to judge: texts are neither stored nor moved.
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    stats = stored(with_stats(slim, list(NAMES), drop_text=True), "quality")
    model = train(stats, labels.select(F.col(id_col), F.col(label_col)), id_col, label_col)
    if not len(model.roots):
        return docs
    scored = add_score(with_stats(docs, names, text_col), names, model, score)
    return scored.filter(F.col(score) >= 0.5).select(*docs.columns)
