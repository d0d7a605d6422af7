from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemetrics.llm import hard_negatives as mining
from prosemetrics.llm import segments
from prosemetrics.llm.oracles import hard_negatives_sql
from prosemetrics.llm.queries import op13_hard_negatives

from .conftest import SF


def plain(rows, positives=5, negatives=10, least=30, most=90, scale=256):
    """Rows (id, label, vector, asked) to all result rows, as they are defined."""
    whole = [
        (i, c, [int(np.floor(scale * x)) for x in v], q)
        for i, c, v, q in rows
        if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    asked = {}
    for i, c, v, q in whole:
        if q:
            asked[i] = min(asked.get(i, (c, v)), (c, v))
    out = []
    for anchor, (label, vector) in asked.items():
        scored = [(-sum(a * b for a, b in zip(vector, v)), i, c) for i, c, v, _ in whole if i != anchor and len(v) == len(vector)]
        found = sorted((s, i) for s, i, c in scored if c == label)[:positives]
        for p, positive in sorted(set(found)):
            fit = sorted((s, i) for s, i, c in scored if c != label and least * -p <= 100 * -s <= most * -p)
            out += [(anchor, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(fit[:negatives])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, asked boolean")


def mined(frame, **more):
    return sorted(map(tuple, mining.hard_negatives(frame, F.col("asked"), F.col("label"), **more).collect()))


def test_query_equals_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = db.sql(hard_negatives_sql()).fetchall()
    assert sorted(map(tuple, op13_hard_negatives(spark, SF).collect())) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_any_size_and_ties(spark, monkeypatch, seed):
    monkeypatch.setattr(mining, "CANDIDATES", 16)
    monkeypatch.setattr(mining, "ANCHORS", 3)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, 10))
    rows = []
    for i in range(220):
        v = centres[i % 6] + rng.normal(0, 0.5, 10) * (i % 4 > 0)  # a fourth are copies: many ties
        rows.append((i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v], i % 20 == 0))
    assert mined(table(spark, rows)) == plain(rows)
    assert mined(table(spark, rows), positives=3, negatives=2, least=-50, most=100) == plain(rows, 3, 2, -50, 100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0], True), (0, 1, [nan, 0.0], True), (0, 2, [0.5, 0.5], True), (1, 1, [1.0, 1.5], False), (2, 2, [0.5, 0.75], False)]
    rows += [(3, 1, None, True), (4, None, [1.0, 1.0], True), (None, 1, [1.0, 1.0], True), (5, 1, [inf, 1.0], False), (6, 2, [None, 1.0], False)]
    rows += [(7, 1, [1.0, 1.5], False), (7, 1, [1.0, 1.5], False), (8, 2, [0.5, 0.75], False), (8, 2, [0.5, 0.75], False), (9, 3, [1.0], True), (10, 1, [], True)]
    got = mined(table(spark, rows))
    assert got == plain(rows) and {r[0] for r in got} == {0}
    assert mined(table(spark, []).limit(0)) == []
    clash = table(spark, rows).withColumns({c: F.lit("x") for c in ("id", "v", "dims", "block", "rank", "lane")})
    assert mined(clash) == got


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    for scale in (2.0**20, 2.0**22):  # scores below and beyond what doubles hold exactly
        rows = [(i, i % 2, [float(np.float32(x)) for x in rng.uniform(0.4, 1, 6) * scale], i % 10 == 0) for i in range(40)]
        assert mined(table(spark, rows)) == plain(rows)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(4)
    a, b = (segments.Summaries(np.floor(rng.normal(0, 300, (n, 64)).cumsum(axis=1))) for n in (30, 50))
    places = np.arange(50)
    scores = segments.exact(a, b, places, np.ones((30, 50), dtype=bool))
    assert (scores == a.vectors @ b.vectors.T).all()
    one_by_one = np.zeros((30, 50), dtype=bool)
    one_by_one[3, 4] = True
    assert segments.exact(a, b, places, one_by_one)[3, 4] == scores[3, 4]
    width = np.inf
    for level in range(len(segments.LEVELS)):
        low, high = segments.bounds(a, b, level, places)
        assert (low <= scores).all() and (scores <= high).all()
        assert (high - low).mean() < width
        width = (high - low).mean()


def test_bounds_save_scores(monkeypatch):
    """Of smooth vectors, most pairs are decided by segment summaries."""
    rng = np.random.default_rng(5)
    vectors = np.floor(np.repeat(rng.normal(0, 200, (400, 16)), 4, axis=1) + rng.normal(0, 5, (400, 64)))
    a, b, seen = segments.Summaries(vectors[:20]), segments.Summaries(vectors), []
    whole = segments.exact
    monkeypatch.setattr(segments, "exact", lambda a, b, p, needed: seen.append(needed.sum()) or whole(a, b, p, needed))
    n = np.arange(20)
    segments.best_pairs(a, b, np.ones((20, 400), dtype=bool), n, np.full(20, -np.inf), np.full(20, np.inf), 5)
    assert sum(seen) < 20 * 400 / 10
