"""Hard negatives: other-label vectors that score close to, and not above, an anchor's positives.

Vectors are kept in blocks of bounded size, with their labels.  Every block of anchors meets every
block of candidates, in lanes over all tasks; a task has one pair of blocks at a time.

1. Positives: each pair of blocks gives the best same-label rows of its anchors; the best five of
   those over all blocks are an anchor's positives.
2. Negatives: a positive's score sets the range of scores in which its negatives lie.  Each pair of
   blocks gives the best other-label rows in each range; the best ten over all blocks stay.

In both, the summaries of vector segments (:mod:`.segments`) bound the scores, coarse segments
first; pairs that the bounds do not decide are refined, and only the rest are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemetrics.llm import segments
from prosemetrics.llm.shared import stored

CANDIDATES, ANCHORS = 4096, 128
BLOCK = "block long, dims int, ids binary, labels binary, vectors binary"


def _blocks(scale: float, size: int):
    """Packs rows (id, label, vector) of equal dimension into blocks; invalid ones are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(dims)
            made += 1
            ids, labels = (np.array([r[i] for r in rows], dtype=np.int64).tobytes() for i in (0, 1))
            vectors = np.array([r[2] for r in rows], dtype=np.float64).tobytes()
            return pa.RecordBatch.from_pydict(
                {"block": [base + made], "dims": pa.array([dims], pa.int32()), "ids": [ids], "labels": [labels], "vectors": [vectors]}
            )

        for batch in batches:
            ids, labels = (batch.column(i).to_pylist() for i in (0, 1))
            for row_id, label, values in zip(ids, labels, batch.column(2)):
                if row_id is None or label is None or not values.is_valid or values.values.null_count:
                    continue
                vector = np.floor(values.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not np.isfinite(vector).all():
                    continue
                held.setdefault(len(vector), []).append((row_id, label, vector))
                if len(held[len(vector)]) == size:
                    yield flush(len(vector))
        for dims in list(held):
            yield flush(dims)

    return pack


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, segments.Summaries]:
    ids, labels = (np.frombuffer(row[prefix + c], dtype=np.int64) for c in ("ids", "labels"))
    vectors = np.frombuffer(row[prefix + "vectors"], dtype=np.float64).reshape(len(ids), row["dims"])
    return ids, labels, segments.Summaries(vectors)


def _positives(row: dict, k: int) -> list[np.ndarray]:
    anchors, own, a = _read(row, "a_")
    ids, labels, b = _read(row)
    allowed = (own[:, None] == labels) & (anchors[:, None] != ids)
    n = len(anchors)
    query, place, score = segments.best_pairs(a, b, allowed, np.arange(n), [-np.inf] * n, [np.inf] * n, k)
    keep = _first(query, score, ids[place], k)
    return [anchors[query[keep]], own[query[keep]], ids[place[keep]], score[keep]]


def _negatives(row: dict, k: int, least: int, most: int) -> list[np.ndarray]:
    anchors, own, a = _read(row, "a_")
    ids, labels, b = _read(row)
    owner, positive, wanted = np.frombuffer(row["ranges"], dtype=np.int64).reshape(-1, 3).T
    allowed = (own[:, None] != labels) & (anchors[:, None] != ids)
    # The least and the greatest whole score of each range.
    low, high = [-((-least * s) // 100) for s in wanted.tolist()], [(most * s) // 100 for s in wanted.tolist()]
    query, place, score = segments.best_pairs(a, b, allowed, owner, low, high, k)
    keep = _first(query, score, ids[place], k)
    query, place, score = query[keep], place[keep], score[keep]
    return [anchors[owner[query]], positive[query], ids[place], wanted[query], score]


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query by score, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return order[rank < k]


def _each(work, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in work(row)], names=schema)

    return run


def _pairs(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of candidates of its dimension, dealt over all tasks.

    Each candidate block belongs to one lane, each block of anchors goes to all lanes.
    """
    lanes = max(1, anchors.sparkSession.sparkContext.defaultParallelism * 4)
    left = candidates.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    right = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    return left.join(right, ["lane", "dims"])


def _with_ranges(asked: DataFrame, positives: DataFrame) -> DataFrame:
    """Each block of anchors with ``ranges``: place of the anchor, id and score of each positive."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"a_block": [block] * len(ids), "place": np.arange(len(ids)), "anchor_id": ids})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(sorted(tuple(x.values()) for x in r), dtype=np.int64).tobytes() for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["a_block", "ranges"])

    places = asked.select("a_block", "a_ids").mapInArrow(numbers, "a_block long, place long, anchor_id long")
    listed = places.join(positives, "anchor_id").groupBy("a_block").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("list"))
    return asked.join(listed.mapInArrow(gather, "a_block long, ranges binary"), "a_block")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components are scaled and rounded down; scores are inner products.  An anchor's positives are its
    ``positives`` best other rows of the same ``label``; the negatives of a positive with score p are
    the best ``negatives`` rows of other labels whose score n has least * p <= 100 * n <= most * p.

    Defined cases: a row with a null id or label, or a vector that is null or holds a null or
    non-finite component, takes no part; vectors are compared with those of equal dimension; ties go
    to the smaller id; rows with the anchor's own id are neither its positives nor its negatives; an
    anchor id that repeats is asked once (with its least label and vector), and a positive that
    repeats counts once for each row but has its negatives once for each different score; a positive
    without a negative in range gives no row; no rows give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), is_anchor.alias("asked"))
    candidates = stored(rows.select("id", "label", "v").mapInArrow(_blocks(scale, CANDIDATES), BLOCK), "negatives")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = rows.filter(F.col("asked") & F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    anchors = valid.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    asked = anchors.mapInArrow(_blocks(scale, ANCHORS), BLOCK)
    asked = stored(asked.select("dims", *[F.col(c).alias(f"a_{c}") for c in ("block", "ids", "labels", "vectors")]), "anchors")

    names = ["anchor_id", "label", "positive_id", "positive_score"]
    found = _pairs(asked, candidates).mapInArrow(_each(lambda r: _positives(r, positives), names), ", ".join(f"{n} long" for n in names))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives)
    chosen = stored(chosen.select("anchor_id", "positive_id", "positive_score").distinct(), "positives")

    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    work = _each(lambda r: _negatives(r, negatives, least, most), names)
    found = _pairs(_with_ranges(asked, chosen), candidates).mapInArrow(work, ", ".join(f"{n} long" for n in names))
    best = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
