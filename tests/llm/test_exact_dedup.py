from __future__ import annotations

import re
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from prosemetrics.llm import exact_dedup as dedup
from prosemetrics.llm.marks import marked_rows, row_marks
from prosemetrics.llm.queries import op11_exact_dedup

from .conftest import SF


def plain(rows):
    """Rows (id, text) to (id, keep_id, group_size, kept, digest), as they are defined."""
    groups = defaultdict(list)
    for row_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(row_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = sha256(text.encode()).hexdigest()
        out += [(row_id, ids[0], len(ids), n == 0, digest) for n, row_id in enumerate(ids)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[4], r[0] is None, r[0] or 0, not r[3]))


def over(spark, frame, folder, files=1, **more):
    frame.repartition(files).write.parquet(str(folder))
    docs = spark.read.parquet(str(folder))
    return dedup.exact_duplicates(docs, dedup.text_stream(spark, str(folder), docs.schema), **more)


def test_query_matches_brute_force(spark, texts):
    assert ordered(map(tuple, op11_exact_dedup(spark, SF).collect())) == ordered(plain(texts))


def test_odd_rows_and_no_rows(spark, odd, none, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert ordered(map(tuple, over(spark, odd, tmp_path / "odd", 3).collect())) == ordered(plain(rows))
    assert over(spark, none, tmp_path / "none").count() == 0


def test_bytes_decide_where_digests_agree(spark, tmp_path):
    """With digests that nearly always collide the groups are those of equal texts."""
    rows = [(i, ["a b", "a  b", "cd", "", None, "e\tf", "long " * (i % 3)][i % 7]) for i in range(60)] + [(3, "cd"), (None, "cd")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = over(spark, frame, tmp_path / "t", 4, digest=lambda t: (F.length(t) % 2).cast("string").cast("binary"))
    want = [r[:4] for r in plain(rows)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted(want, key=key)


def test_entries_outlive_runs(spark, tmp_path):
    """What arrives later meets the state of earlier runs; a smaller id takes an entry over."""
    data, folder = str(tmp_path / "data"), str(tmp_path / "folder")
    schema = "doc_id long, text string"
    batches = [[(5, "x y"), (6, "z")], [(2, "x\ny"), (9, "z"), (7, "new")], [(1, "x y")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(data)
        dedup.run_streams(dedup.text_stream(spark, data, schema), folder, "doc_id", "text")
    held = {r["first"].id: r["rows"] for r in dedup.state(spark, folder, "bigint").collect()}
    assert held == {1: 3, 6: 2, 7: 1}
    got = dedup.outcomes(spark.read.parquet(data), folder).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (1, 1, 3, True), (2, 1, 3, False), (5, 1, 3, False), (6, 6, 2, True), (7, 7, 1, True), (9, 6, 2, False),
    ]


def test_settings_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in dedup.STATE}
    with pytest.raises(ValueError), dedup._settings(spark, dedup.STATE):
        raise ValueError
    assert {k: spark.conf.get(k, None) for k in dedup.STATE} == before


def test_bitmap_keeps_every_mark(spark):
    places = spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.col("id").alias("row"))
    some = places.filter("row % 9 = 0")
    marks = row_marks(some, ["file", "row"])
    kept = marked_rows(places, marks, ["file", "row"])
    assert some.join(kept, ["file", "row"], "left_anti").count() == 0
    assert kept.count() < some.count() + 10
    rest = marked_rows(places, marks, ["file", "row"], False)
    assert rest.count() + kept.count() == places.count() and rest.join(some, ["file", "row"]).count() == 0
