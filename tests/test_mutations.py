"""A clean text has no findings; each copy with one error has exactly that one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosemetrics.packs import russian
from prosemetrics.plans.audit import audit, findings_of
from tests.conftest import CLEAN

RULES = russian.RULES

MUTATIONS = {
    "cards.apostrophe": CLEAN.replace("Железный щит", "АлАкир"),
    "cards.dash": CLEAN.replace("Железный щит", "Кузнец - мастер клинков"),
    "consistency.variants": CLEAN.replace(
        "одна:", "одна, этот матч-ап похож на другой матчап и на третий матчап:"
    ),
    "structure.missing.mulligan": CLEAN.replace("Общие правила муллигана\n", ""),
    "markers.kancelarit-svyazka": CLEAN.replace(
        "Колода молодая, но", "Колода является молодой, но"
    ),
    "markers.chat-ostatki": CLEAN.replace(
        "Матчапы\n", "Матчапы\nНадеюсь, это помогло разобраться.\n"
    ),
    "consistency.advice": CLEAN.replace(
        "быстрых соперников.", "быстрых соперников. В зеркале сбрасывайте Стража портала."
    ),
    "structure.matchups": CLEAN.replace("Жреца, ", ""),
}


@pytest.fixture(scope="module")
def reports(spark, names):
    rows = [("clean", CLEAN), *MUTATIONS.items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn(
        "choice", F.lit("constructed-guide")
    )
    return {r.doc_id: r for r in audit(docs, RULES, names, "choice").collect()}


def test_clean_text_is_clean(reports):
    report = reports["clean"]
    assert report.findings == []
    assert report.summary == {"error": 0, "likely": 0, "review": 0, "info": 0}
    assert report.analyzers_skipped == []
    assert report.notes[0].startswith("текст короче минимума профиля")


@pytest.mark.parametrize("expected", sorted(MUTATIONS))
def test_one_error_gives_one_kind_of_finding(reports, expected):
    assert {f["id"] for f in reports[expected].findings} == {expected}


def test_name_errors_are_exact(reports):
    finding = reports["cards.apostrophe"].findings[0]
    assert finding["severity"] == "error"
    assert (finding["evidence"], finding["suggestion"]) == ("АлАкир", "Ал'Акир")
    assert finding["meta"] == {"count": 1}


def test_advice_is_a_signal_not_a_verdict(reports):
    finding = reports["consistency.advice"].findings[0]
    assert finding["severity"] == "review" and finding["confidence"] < 0.6


def test_missing_section_carries_its_corpus_share(reports):
    finding = reports["structure.missing.mulligan"].findings[0]
    assert finding["meta"] == {"corpus_share": 100}


def test_coverage_names_what_is_missing(reports):
    assert reports["structure.matchups"].findings[0]["evidence"] == "Жрец"


def test_other_profile_asks_for_its_own_sections(spark):
    docs = spark.createDataFrame([("1", CLEAN, "battlegrounds-guide")], "doc_id string, text string, choice string")
    found = findings_of(audit(docs, RULES, None, "choice"))
    assert [r.id for r in found.collect()] == [
        "structure.missing.curve",
        "structure.missing.idea",
        "structure.missing.minions",
    ]


def test_no_finding_is_an_error_except_names(reports):
    for report in reports.values():
        for f in report.findings:
            assert (f["severity"] == "error") == f["id"].startswith("cards.")
