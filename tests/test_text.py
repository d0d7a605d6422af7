from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosemetrics.functions import arrays, units
from prosemetrics.functions import text as T
from prosemetrics.packs import russian

LANG = russian.LANGUAGE


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text,words", [("", 0), ("  \n ", 0), ("слово", 1), ("а б в\n г ", 4)]
)
def test_word_count_uses_unicode_spaces(spark, text, words):
    assert value(spark, T.word_count(F.col("t")), t=text) == words


def test_line_of_counts_newlines_before_the_offset(spark):
    text = "ab\ncd\nef"
    lines = [value(spark, T.line_of(F.col("t"), F.lit(p)), t=text) for p in (0, 2, 3, 7)]
    assert lines == [1, 1, 2, 3]


def test_newlines_are_normalised(spark):
    assert value(spark, T.normalize_newlines(F.col("t")), t="a\r\nb\rc\n") == "a\nb\nc\n"


def test_sentences_join_lines_and_keep_headings_glued(spark):
    got = value(spark, T.sentences(F.col("t")), t="Заголовок\nРаз два. Три!\nЧетыре… пять")
    assert got == ["Заголовок Раз два.", "Три!", "Четыре…", "пять"]


def test_segments_split_on_adversatives_and_drop_them(spark):
    def cut(s):
        return value(spark, T.segments(F.col("t"), list(LANG.adversatives)), t=s)

    assert cut("Берите щит, но сбрасывайте меч") == ["Берите щит", "сбрасывайте меч"]
    assert cut("Берите щит всегда") == ["Берите щит всегда"]


def test_segments_keep_digits_at_their_ends(spark):
    def cut(s):
        return value(spark, T.segments(F.col("t"), list(LANG.adversatives)), t=s)

    assert cut("0 щитов и 10") == ["0 щитов и 10"]
    assert cut("0 щитов, но 1 меч из 11") == ["0 щитов", "1 меч из 11"]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("```\nтекст\n```", "текст"),
        ("```markdown\nтекст\n```", "текст"),
        (" обычный текст\n", "обычный текст"),
        ("```\nа ``` б\n```", "а ``` б"),
    ],
)
def test_fence_is_removed(spark, raw, clean):
    assert value(spark, T.strip_fence(F.col("t")), t=raw) == clean


def test_mask_keeps_every_offset(spark):
    text = 'Муллиган\nБерите «Щит» и "меч" всегда, ОТК.\n'
    masked = value(spark, T.mask_protected(F.col("t"), 6, ["ОТК"]), t=text)
    assert len(masked) == len(text)
    assert masked.split() == ["Берите", "и", "всегда,", "."]
    assert masked.index("всегда") == text.index("всегда")


def test_term_pattern_covers_inflected_forms(spark):
    pattern = F.lit(T.term_pattern("сетап"))
    assert value(spark, F.regexp_count(F.col("t"), pattern), t="Сетапы, сетапом; пресетап") == 2


def test_headings_are_short_lines_without_final_punctuation(docs):
    text = "# Муллиган\nДержите щит.\nМатч-апы\nи ещё строка без точки, но со строчной"
    got = [(r.line, r.title) for r in units.heading_rows(docs(text), LANG).collect()]
    assert got == [(1, "Муллиган"), (3, "Матч-апы")]


def test_token_offsets_point_at_the_tokens(docs):
    text = "Ёлка, 12 шт.\n(да)"
    rows = units.token_rows(docs(text)).collect()
    assert [r.token for r in rows] == ["Ёлка", "12", "шт", "да"]
    assert all(text[r.start : r.start + len(r.token)] == r.token for r in rows)


def test_all_lemmas_are_returned(spark):
    tokens = spark.createDataFrame([("1", "Стали")], "doc_id string, token string")
    lemmas = spark.createDataFrame(
        [("стали", "стать"), ("стали", "сталь")], "form string, lemma string"
    )
    got = {r.lemma for r in units.lemma_rows(tokens, lemmas, LANG).collect()}
    assert got == {"стать", "сталь"}


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    left=st.lists(st.sampled_from(["a", "b", "в", "", "a:1"]), max_size=12),
    right=st.lists(st.sampled_from(["a", "b", "в", "", "a:1"]), max_size=12),
)
def test_multisets_match_counters(spark, left, right):
    frame = spark.createDataFrame([(left, right)], "l array<string>, r array<string>")
    row = frame.select(
        arrays.runs(F.col("l")).alias("runs"),
        arrays.multiset_except(F.col("l"), F.col("r")).alias("lost"),
    ).first()
    assert {r["value"]: r["n"] for r in row["runs"]} == dict(Counter(left))
    assert row["lost"] == sorted(Counter(left) - Counter(right))
