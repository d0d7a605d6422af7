"""Registered queries against their SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
CHECKED = (
    "front_matter", "tokens", "masked_text", "marker_hits", "touched", "name_case", "name_typos",
    "spelling_variants_strict", "case_variants", "section_bodies", "duplicate_ids", "corpus_split",
    "author_scores", "fitted_norms", "selected_attempts", "audit",
    "guessed_lemmas", "inflected_names", "observed_gate", "echo_indexed", "quality_gate", "name_dashes",
    "advice_conflicts", "declared_counts", "score_calibration", "severity_windows",
)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def test_every_query_has_its_sql():
    from workloads.oracles import ORACLES
    from workloads.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, duck, name):
    from workloads.check import normal

    got = entry_point.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry_point.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
