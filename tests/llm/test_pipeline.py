from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from prosemetrics.llm.shared import release

from .conftest import SF
from .test_near_copies import similarity


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and result of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        result = spark.read.parquet(str(folder / name))
        out.append((name, docs, result))
        docs = result
    return {name: (a, b) for name, a, b in out}


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "deduplication", "privacy", "mixing", "packing"]


def test_all_but_the_last_return_documents(steps):
    for name, (before, after) in steps.items():
        if name != "packing":
            assert [f.name for f in after.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
            assert after.dtypes == before.dtypes
            assert after.join(before, "doc_id", "left_anti").count() == 0


def test_quality_drops_junk_and_keeps_good(spark, steps):
    before, after = steps["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = labels.join(after, "doc_id", "left_semi")
    assert kept.filter("quality = 1").count() >= 0.95 * labels.filter("quality = 1").count()
    assert kept.filter("quality = 0").count() <= 0.3 * labels.filter("quality = 0").count()
    assert after.count() < before.count()


def test_one_document_of_each_group_stays(steps):
    """Against shingle similarity itself: copies go, and what goes has a copy among what stays or goes."""
    before, after = steps["deduplication"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    kept = {r.doc_id for r in after.collect()}
    close = {i: [] for i, _ in rows}
    for n, (i, t) in enumerate(rows):
        for j, u in rows[:n]:
            s = similarity(t, u)
            if s >= 0.8:
                close[i].append((j, s))
                close[j].append((i, s))
    for i, _ in rows:
        if i not in kept:
            assert close[i]
        if any(j < i and s >= 0.9 for j, s in close[i]):
            assert i not in kept


def test_privacy_changes_only_spans(steps):
    before, after = steps["privacy"]
    old = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text)
        assert "@" not in r.text or r.text == old[r.doc_id].text
    assert after.count() == before.count()


def test_mixing_takes_its_share(steps):
    before, after = steps["mixing"]
    words = lambda frame: sum(len(r.text.encode().split()) for r in frame.collect())
    assert 0.88 * words(before) <= words(after) < words(before)


def test_packing_places_every_document(steps):
    before, after = steps["packing"]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run_equals_its_stages(spark, steps):
    want = steps["packing"][1].count()
    assert pipeline.run(spark, SF).count() == want
    release(spark)
