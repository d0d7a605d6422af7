"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's dimensions are cut into ``LISTS`` runs; a run's partial score of every candidate is one
*score list* of a query.  Candidates are kept in blocks of bounded size, queries too, and a task
has one pair of blocks at a time.

1. Gather: each list of a block gives its best entries; their whole scores are worked out, and the
   k-th of them is a score the block can vouch for.  The greatest of those over all blocks, for
   each query, is a safe cutoff: at least k candidates reach it.
2. Collect: the cutoff goes to all blocks.  A candidate that reaches a cutoff t has a partial score
   of t / LISTS or more in some list, so each list gives its entries from there on (the uniform
   threshold) and no others are needed.
3. Resolve: the whole scores of the collected candidates are worked out where their vectors are;
   those that reach the cutoff go on, and the best k of them by score and id are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemetrics.llm.shared import stored

LISTS = 4
# Rows of a block; a pair of blocks is one matrix of scores.
CANDIDATES, QUERIES = 4096, 512
# Below these, sums of products are exact as doubles and as 64-bit integers.
DOUBLE_EXACT, LONG_EXACT = 2.0**53, 2.0**63

BLOCK = "block long, dims int, ids binary, vectors binary"


def _blocks(id_index: int, vector_index: int, scale: float, size: int):
    """A function that packs rows of equal dimension into blocks; invalid vectors are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        open_blocks: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal made
            rows = open_blocks.pop(dims)
            made += 1
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            data = np.array([r[1] for r in rows], dtype=np.float64)
            columns = [[base + made], [dims], [ids.tobytes()], [data.tobytes()]]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["block", "dims", "ids", "vectors"]
            )

        for batch in batches:
            for row_id, values in zip(batch.column(id_index).to_pylist(), batch.column(vector_index)):
                if row_id is None or not values.is_valid or values.values.null_count:
                    continue
                vector = np.floor(values.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not np.isfinite(vector).all():
                    continue
                open_blocks.setdefault(len(vector), []).append((row_id, vector))
                if len(open_blocks[len(vector)]) == size:
                    yield flush(len(vector))
        for dims in list(open_blocks):
            yield flush(dims)

    return pack


def _unpack(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, dtype=np.int64)
    return numbers, np.frombuffer(vectors, dtype=np.float64).reshape(len(numbers), dims)


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Whole-number products of rows; exact, or an error where a score may not fit a long."""
    if bound < DOUBLE_EXACT:
        return a @ b.T
    if bound >= LONG_EXACT:
        raise OverflowError("inner products of these vectors may not fit 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _pair(row: dict, k: int, cutoffs: np.ndarray | None):
    """For one pair of blocks: per query, either the k-th whole score the block vouches for or
    (given cutoffs) the entries that reach them."""
    dims = row["dims"]
    q_ids, q = _unpack(row["q_ids"], row["q_vectors"], dims)
    c_ids, c = _unpack(row["ids"], row["vectors"], dims)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dims, 1)
    runs = [r for r in np.array_split(np.arange(dims), LISTS) if len(r)] or [np.arange(0)]
    lists = [_products(q[:, r], c[:, r], bound) for r in runs]
    whole = sum(lists[1:], lists[0])
    for i, query in enumerate(q_ids.tolist()):
        others = c_ids != query
        if cutoffs is None:
            n = len(c_ids)
            m = min(n, k + int(n - others.sum()))
            seen = np.unique(np.concatenate([np.argpartition(-part[i], m - 1)[:m] for part in lists]))
            seen = seen[others[seen]]
            scores = np.sort(whole[i, seen])[::-1]
            if len(scores) >= k:
                yield query, None, int(scores[k - 1])
            continue
        threshold = cutoffs[i]
        if np.isnan(threshold):  # no block has k candidates: all are needed
            collected = others
        else:
            collected = np.zeros(len(c_ids), dtype=bool)
            for part in lists:
                collected |= part[i] * len(lists) >= threshold
            collected &= others
        at = np.flatnonzero(collected)
        scores = whole[i, at]
        if not np.isnan(threshold):
            at, scores = at[scores >= threshold], scores[scores >= threshold]
        for j in _best(scores, c_ids[at], k):
            yield query, int(c_ids[at[j]]), int(scores[j])


def _run(k: int, with_cutoffs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cutoffs = np.frombuffer(row["cutoffs"], dtype=np.float64) if with_cutoffs else None
                out = list(_pair(row, k, cutoffs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    scale: float = 1024.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates with the highest scores for each query.

    Components are scaled and rounded down first.  ``is_query`` is a condition on rows; all rows
    are candidates of all queries of their dimension, except those with the query's own id.

    Defined cases: a row with a null id, or a vector that is null or holds a null or non-finite
    component, takes no part; ties go to the smaller id; of repeated rows each is a candidate, and
    a query id that repeats is asked once, with one of its vectors (the greatest, component by
    component); fewer than k candidates are all returned; no rows give no rows.  Scores that might
    exceed 64 bits raise an error.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    candidates = stored(rows.select("id", "v").mapInArrow(_blocks(0, 1, scale, CANDIDATES), BLOCK), "topk")
    # Rows that take no part must not stand for an id that has a valid vector too.
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = rows.filter(F.col("q") & F.col("v").isNotNull() & finite).groupBy("id").agg(F.max("v").alias("v"))
    asked = asked.mapInArrow(_blocks(0, 1, scale, QUERIES), BLOCK)
    asked = stored(asked.select("dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "topk-queries")

    def pairs(queries: DataFrame) -> DataFrame:
        """Every block of queries beside every block of candidates, dealt over all tasks.

        Each candidate block belongs to one lane, each query block goes to all lanes.
        """
        lanes = max(1, vectors.sparkSession.sparkContext.defaultParallelism * 4)
        left = candidates.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
        right = queries.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        return left.join(right, ["lane", "dims"])

    schema = "query_id long, vec_id long, score long"
    vouched = pairs(asked).mapInArrow(_run(k, False), schema)
    cutoff = vouched.groupBy("query_id").agg(F.max("score").alias("cutoff"))
    with_cutoffs = _attach(asked, cutoff)
    entries = pairs(with_cutoffs).mapInArrow(_run(k, True), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        entries.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _attach(asked: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Each query block with the cutoffs of its queries, in their order; NaN where there is none."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers = np.frombuffer(row["q_ids"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]] * len(numbers), pa.int64()), pa.array(np.arange(len(numbers))), pa.array(numbers)],
                    names=["q_block", "at", "query_id"],
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            packed = [np.array([np.nan if x["cutoff"] is None else x["cutoff"] for x in sorted(r["list"], key=lambda x: x["at"])], dtype=np.float64).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["q_block", "cutoffs"])

    flat = asked.select("q_block", "q_ids").mapInArrow(ids, "q_block long, at long, query_id long")
    lists = flat.join(cutoff, "query_id", "left").groupBy("q_block").agg(F.collect_list(F.struct("at", "cutoff")).alias("list"))
    return asked.join(lists.mapInArrow(gather, "q_block long, cutoffs binary"), "q_block")
