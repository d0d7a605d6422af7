from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import measures
from prosemetrics.packs import russian
from tests.conftest import CLEAN

LANG = russian.LANGUAGE


def test_clean_text_by_hand(docs):
    row = measures.measure(docs(CLEAN), LANG).first()
    lengths = [len(s.split()) for s in split_sentences(CLEAN)]
    assert row["words"] == len(CLEAN.split()) == sum(lengths)
    assert row["rhythm"]["ratio"] == pytest.approx(
        statistics.pstdev(lengths) / statistics.mean(lengths)
    )
    counts = {name: row["voice"][name]["n"] for name in measures.SIGNALS}
    assert counts == {
        "address": 2,
        "imperative": 5,
        "concession": 2,
        "short_sentence": sum(1 < n < 8 for n in lengths),
        "parenthesis": 1,
    }


def split_sentences(text: str) -> list[str]:
    out, now = [], []
    for word in text.split():
        now.append(word)
        if word[-1] in ".!?…":
            out.append(" ".join(now))
            now = []
    return out + ([" ".join(now)] if now else [])


@pytest.mark.parametrize("text", ["", "   ", "слово"])
def test_tiny_texts_have_no_rhythm(docs, text):
    row = measures.measure(docs(text), LANG).first()
    assert row["rhythm"] is None
    assert (row["voice"] is None) == (not text.strip())


def test_nouns_that_look_like_imperatives_are_not_counted(docs):
    row = measures.measure(docs("Дело в лимите. Речь об элите. Держите стол."), LANG).first()
    assert row["voice"]["imperative"]["n"] == 1


def test_borrowed_norms_carry_a_caveat(spark):
    games = spark.createDataFrame([("hearthstone",), ("wow",)], "game string")
    rows = {r.game: r for r in measures.norm_compare(games, russian.RULES).collect()}
    assert rows["hearthstone"].caveat is None
    assert "заимствовано" in rows["wow"].caveat


def test_published_score_panel(spark):
    """The one published panel: 1.9 / 4.2 / 10 / 10 / 10 / 3.0 make 5.4."""
    weights = russian.PROFILES["constructed-guide"].weights
    row = spark.createDataFrame(
        [(9.6, 29.4, 0.33, 0.51, 1, 5, 6, 11, 0.0, 0, 0, weights)],
        "voice_per_1k double, voice_norm double, rhythm_ratio double, rhythm_norm double, "
        "sections_found int, required int, entities int, entity_total int, "
        "marker_per_1k double, name_errors int, variants int, weights map<string,double>",
    )
    out = measures.author_score(row, LANG).first()
    assert round(out.score_voice, 1) == 1.9
    assert round(out.score_rhythm, 1) == 4.2
    assert round(out.score_structure, 1) == 3.0
    assert round(out.score, 1) == 5.4


def test_no_score_without_a_norm(spark):
    row = spark.createDataFrame(
        [(9.6, None, 0.33, 0.51, 1, 5, 6, 11, 0.0, 0, 0, {"живое": 0.5, "ритм": 0.5})],
        "voice_per_1k double, voice_norm double, rhythm_ratio double, rhythm_norm double, "
        "sections_found int, required int, entities int, entity_total int, "
        "marker_per_1k double, name_errors int, variants int, weights map<string,double>",
    )
    assert measures.author_score(row, LANG).first().score is None


def test_hints_have_addresses(docs):
    text = "Раз.\nЗдесь приходится думать над каждым ходом очень долго.\nВсё."
    row = measures.tighten_hints(docs(text), LANG).first()
    assert (row.longest_sentence_no, row.longest_words) == (2, 8)
    assert (row.impersonal_line, row.impersonal_phrase) == (2, "приходится")


def test_profile_weights_sum_to_one():
    for profile in russian.PROFILES.values():
        assert sum(profile.weights.values()) == pytest.approx(1.0), profile.id


def test_alarm_lines(spark, docs):
    flat = "Колода берёт карты и ходит дальше. " * 6
    measured = measures.measure(docs(flat), LANG).withColumn("game", F.lit("hearthstone"))
    row = measures.alarms(measures.norm_compare(measured, russian.RULES)).first()
    assert row.rhythm_alarm and not row.voice_alarm


def test_hints_count_each_sentence_once(spark):
    """Looking each sentence's length up in an array made the work a square of a text's sentences."""
    from prosemetrics.operators import measures
    from prosemetrics.packs import russian

    docs = spark.createDataFrame([(1, "Раз два. Три четыре пять. Шесть.")], "doc_id long, text string")
    hints = measures.tighten_hints(docs, russian.LANGUAGE)
    assert (hints.first()["longest_words"], hints.first()["longest_sentence_no"]) == (3, 2)
    plan = hints._jdf.queryExecution().optimizedPlan().toString()
    inside = plan[plan.index("lambdafunction(struct(words") :].split("minus_no")[0]
    assert "transform(" not in inside
