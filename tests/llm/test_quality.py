from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from prosemetrics.llm import quality_rules as rules
from prosemetrics.llm.boosting import fit
from prosemetrics.llm.queries import op2_quality_rules, op3_quality_model
from prosemetrics.llm.quality_model import keep_good, quality_scores

from .conftest import SF


def plain(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


def test_rules_match_plain_counts(spark, texts):
    rows = {r.doc_id: r for r in op2_quality_rules(spark, SF).collect()}
    assert len(rows) == len(texts)
    for i, t in texts:
        r, want = rows[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_documents(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = [r for r in op2_quality_rules(spark, sf).collect() if r.doc_id in quality and not r.base_failed]
    good = [r.kept for r in rows if quality[r.doc_id] == 1]
    bad = [r.kept for r in rows if quality[r.doc_id] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.2


def test_estimates_ignore_junk(spark):
    """A fifth of far-off rows moves neither centre nor spread."""
    rng = np.random.default_rng(1)
    clean = rng.normal(0, 0.3, (800, rules.DIMS))
    junk = rng.normal(5, 0.3, (200, rules.DIMS))
    rows = [("en", "s", x.tolist()) for x in np.concatenate([clean, junk])]
    frame = spark.createDataFrame(rows, "group_lang string, group_source string, x array<double>")
    model = rules.mcd_models(frame).collect()[0]
    assert np.abs(np.array(model.centre)).max() < 0.1
    spread = np.linalg.inv(np.array(model.inverse).reshape(rules.DIMS, -1)) - np.diag(np.array(list(rules.SPREAD.values())) ** 2)
    assert np.allclose(np.sqrt(np.diag(spread)), 0.3, atol=0.06)


def test_chi2():
    assert rules.chi2_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert rules.chi2_quantile(0.999, 6) == pytest.approx(22.458, abs=1e-2)


def test_rules_odd_rows(odd, none):
    rows = rules.quality_rules(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words == 0)
    assert rules.quality_rules(none).count() == 0


def test_scores_on_held_out_rows(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = op3_quality_model(spark, sf).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [r for r in rows if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in known]) >= 0.95


def test_labels_of_the_held_out_third_are_never_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality")
    a = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality_scores(docs, turned).collect()}
    assert a == b


def test_boosting_walks_flat_trees():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2000, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97
    assert len(fit(x[:0], y[:0]).roots) == 0


def test_model_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (None, 1), (7, None), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(none, labels).count() == 0
    assert keep_good(odd, labels).columns == odd.columns
    assert keep_good(odd, labels.limit(0)).count() == odd.count()
