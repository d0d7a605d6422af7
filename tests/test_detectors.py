from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import consistency, markers, names as N, structure
from prosemetrics.packs import russian

RULES, LANG = russian.RULES, russian.LANGUAGE
WEAK = "Сильный архетип. Важен один матч-ап, а другой матчап проще."
STRONG = "Важны все матч-апы. Тяжёлым матч-апам помогает темп, в матчапе с Магом иначе."


def seen(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    return set(frame.select(structure.entities_seen(F.col("text"), RULES).alias("s")).first().s)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Против Охотника на демонов играем быстро.", {"Охотник на демонов"}),
        ("Против Охотника держим стол.", {"Охотник"}),
        ("С Охотником держим, с Охотником на демонов спешим.", {"Охотник", "Охотник на демонов"}),
        ("Тяжело против Охотников на демонов", {"Охотник на демонов"}),
        ("Поможет Рыцарю смерти", {"Рыцарь смерти"}),
        ("Играем с Жрецом, Мага бьём", {"Жрец", "Маг"}),
        ("Магия тут ни при чём", set()),
    ],
)
def test_longest_name_wins(spark, text, expected):
    assert seen(spark, text) == expected


def test_advice_stays_in_its_clause(docs, names):
    texts = docs(
        mixed="Оставляйте Стража портала, но сбрасывайте Железный щит.\nСтраж портала хорош, держите его.",
        real="Оставляйте Стража портала против агро.\nПротив контроля сбрасывайте Стража портала, он медленный.",
    )
    got = consistency.advice_conflicts(texts, names, RULES).collect()
    assert [(r.doc_id, r.finding["message"]) for r in got] == [
        ("real", "советы по карте «Страж портала» расходятся")
    ]


def test_strict_shows_at_least_as_much(docs):
    texts = docs(weak=WEAK, strong=STRONG)
    normal = {r.doc_id for r in consistency.spelling_variants(texts, RULES).collect()}
    strict = {r.doc_id for r in consistency.spelling_variants(texts, RULES, True).collect()}
    assert normal == {"strong"} and strict == {"weak", "strong"}


def test_mixed_capitals_in_two_word_names(docs):
    text = "Тут силён Пират Воин, там Пират воин, и снова Пират Воин."
    row = consistency.spelling_variants(docs(text), RULES).first()
    assert row.evidence == "Пират Воин ×2, Пират воин ×1"


def test_headings_and_quotations_are_not_prose(docs):
    text = "Матч-апы\nОн сказал «матч-ап и матч-ап». Пишем матчап и матчап."
    assert consistency.spelling_variants(docs(text), RULES).count() == 0


def test_typo_leaves_most_of_the_word(docs, names):
    found = N.typo_candidates(docs("Наш Громоверджец и Кузнеца, а также Гномовержец."), names, LANG)
    assert sorted((r.was, r.official, r.edits) for r in found.collect()) == [
        ("Гномовержец", "громовержец", 1),
        ("Громоверджец", "громовержец", 1),
    ]


def test_case_errors_spare_sentence_openings(docs, names):
    wrong = N.case_errors(docs("Железный щит тут. Берём Железный Щит и железный щит."), names)
    assert {r.was for r in wrong.collect()} == {"Железный Щит", "железный щит"}


def test_short_names_skip_common_words(spark, docs, names):
    texts = docs("Монетку тратьте рано. Щит и портал.", "Портал там.", "Порталы тут.")
    common = N.common_words(texts, LANG, 1.0)
    got = N.short_names(texts, names, common, LANG).collect()
    assert {(r.was, r.official) for r in got} == {
        ("Монетку", "Медная монетка"),
        ("Щит", "Железный щит"),
    }


def test_name_matching_without_broadcast(docs, names, monkeypatch):
    """Past the size bound the dictionary is joined by shuffle, with the same result."""
    import prosemetrics.operators.names as module

    text = docs("Видим АлАкир и Кузнец - мастер клинков.")
    expected = sorted(map(tuple, N.apostrophe_errors(text, names).collect()))
    monkeypatch.setattr(module, "sized_broadcast", lambda dim, max_rows=0: dim)
    assert sorted(map(tuple, N.apostrophe_errors(text, names).collect())) == expected
    assert [r.official for r in N.dash_errors(text, names).collect()] == ["Кузнец – мастер клинков"]


def shuffled_rows(df):
    """How many rows the shuffles of a frame that was collected have written."""

    def of(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        below = [plan.plan()] if kind.endswith("QueryStageExec") else []
        children = plan.children()
        return own + sum(map(of, below + [children.apply(i) for i in range(children.size())]))

    return of(df._jdf.queryExecution().executedPlan())


def test_large_dictionary_moves_few_words(spark, docs, names, monkeypatch):
    """Past the size bound only what the dictionary probably has is shuffled, not every word of the corpus."""
    words = "Берём железный щит и старый меч, АлАкир и Кузнец - мастер клинков ждёт. "
    text = docs(words + " ".join(f"слово{i} ещё{i}" for i in range(2000)))
    kinds = ("apostrophe", "dash", "case")
    expected = sorted(map(tuple, N.name_hits(text, names, kinds).collect()))
    monkeypatch.setattr(N, "sized_broadcast", lambda dim, max_bytes=0: dim)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = N.name_hits(text, names, kinds)
        assert sorted(map(tuple, found.collect())) == expected
        assert [r[1:4] for r in expected] == [
            ("apostrophe", "АлАкир", "Ал'Акир"),
            ("case", "железный щит", "Железный щит"),
            ("dash", "Кузнец - мастер клинков", "Кузнец – мастер клинков"),
        ]
        assert shuffled_rows(found) < 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_probable_keeps_every_key_of_the_table(spark):
    from prosemetrics.operators.marks import probable

    table = spark.range(0, 30000, 3).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("a").alias("kind"))
    rows = spark.range(60000).select("id", F.concat(F.lit("k"), "id").alias("k"), F.lit("a").alias("kind"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, "a")], "id long, k string, kind string"))
    kept = {r.id for r in probable(rows, table, ["kind", "k"]).select("id").collect()}
    assert set(range(0, 30000, 3)) <= kept and len(kept) < 10000 + 500
    assert probable(rows, table.limit(0), ["kind", "k"]).count() == 0


@pytest.mark.parametrize("wanted", [None, N.DASHES])
def test_sequences_equal_plain_ones(spark, wanted):
    text = "Один два-три. Четыре - пять, шесть! семь … восемь девять «десять» — да"
    words = spark.createDataFrame([(text,)], "t string").select(N.name_words(F.col("t")).alias("w")).first().w
    expected = []
    for i in range(len(words)):
        for a in (1, 3):
            part = words[i : i + a]
            if len(part) < a or {".", ","} & set(part) or (wanted and not any(c in w for w in part for c in "-–—−")):
                continue
            expected.append((N.OPENING if i == 0 or words[i - 1] == "." else "") + " ".join(part))
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(N.sequences(F.col("t"), [1, 3], wanted))
    assert [r[0] for r in row.collect()] == [expected, [], None]


def test_mentions_are_the_same_by_every_join(spark, tmp_path, monkeypatch):
    from workloads import tables as W

    docs = [(1, "one"), (2, "two"), (2, "two again"), (3, None), (None, "no id"), (9, "nine")]
    part = [(1, "red bolt"), (2, "old gear"), (2, "hot ring"), (3, "big plate"), (None, "cold"), (7, "blue gear"), (9, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(part, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    expected = [
        (1, "one\nSee red bolt"), (2, "two again\nSee hot ring"), (2, "two again\nSee old gear"), (2, "two\nSee hot ring"),
        (2, "two\nSee old gear"), (3, None), (9, "nine"), (None, "no id"),
    ]
    for answers in ([True], [False, True], [False, False]):
        left = iter(answers)
        monkeypatch.setattr(W, "fits_broadcast", lambda dim: next(left))  # noqa: B023
        found = W.mentions(spark, str(tmp_path), F.concat(F.lit("See "), "p_name")).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_declared_count(docs):
    text = "В колоде 3 карты:\n- Одна\n- Две\nконец\nЕщё 1 карта\n1. Три"
    row = consistency.declared_counts(docs(text), RULES).collect()
    assert [(r.line, r.message) for r in row] == [(1, "заявлено карт: 3, перечислено: 2")]


def test_profile_detection(docs):
    texts = docs(
        bg="Идея стратегии\nЖдём в таверне тройку существ.\nВ лобби решают аксессуары.",
        deck="Муллиган\nКолода играет через размен, матч-апы ровные.",
        none="Просто текст.",
    )
    got = {r.doc_id: (r.profile, r.confidence) for r in structure.detect_profile(texts, RULES).collect()}
    assert got["bg"] == ("battlegrounds-guide", 1.0)
    assert got["deck"] == ("constructed-guide", 1.0)
    assert got["none"] == ("constructed-guide", 0.0)


def test_section_order(docs):
    text = "Муллиган\nСтрока тут.\nСборки\nЕщё строка.\nМатч-апы\nКонец."
    profiled = structure.with_profile(
        docs(text).withColumn("p", F.lit("constructed-guide")), RULES, "p"
    )
    assert [r.id for r in structure.section_order(profiled, RULES).collect()] == [
        "structure.order.builds"
    ]


def test_extraction_residue(docs):
    text = "Слово раз-\nрыв.\n  Ответить \n12/03/2021, 10:15\nНичего."
    got = markers.extraction_artifacts(docs(text), RULES).collect()
    assert {(r.evidence, r.meta["count"]) for r in got} == {
        ("разрыв слова переносом", 1),
        ("блок комментариев", 1),
        ("колонтитул печати", 1),
    }


def test_only_replaceable_words_get_a_suggestion(docs):
    got = {r.id: r.suggestion for r in markers.term_hits(docs("Дека и винрейт."), RULES).collect()}
    assert got == {"term.deck": "колода", "term.winrate": ""}


def test_typography(docs):
    got = markers.typography_hits(docs("Ещё «кавычки» и 2–3 хода, 54 процента."), RULES).collect()
    assert {(r.id, r.meta["count"]) for r in got} == {
        ("typography.yo", 1),
        ("typography.quotes", 2),
        ("typography.range", 1),
        ("typography.percent", 1),
    }


def test_thirty_markers_with_known_levels():
    assert len(RULES.markers) == 30
    assert {m.action for m in RULES.markers} == {"remove", "rewrite", "review"}


def test_typos_are_found_wherever_they_sit(spark, docs):
    names = spark.createDataFrame([("Grand Wizard",), ("Ox",)], "official string")
    found = N.typo_candidates(docs("A vizard, a wzard, a wizzard, wizards, a wiazrd and an ax."), names, LANG)
    assert {(r.was, r.official) for r in found.collect()} == {
        ("vizard", "wizard"), ("wzard", "wizard"), ("wizzard", "wizard"), ("wizards", "wizard"),
    }


def test_official_forms_are_never_errors(spark, docs):
    names = spark.createDataFrame(
        [("O'ren",), ("Or'en",), ("Ze'll",), ("Zell",), ("Alpha – beta",), ("Alpha - beta",), ("Big Cat",), ("Big cat",)],
        "official string",
    )
    right = docs("We saw O'ren, Or'en and Zell. We saw Alpha - beta, Big cat and Big Cat.")
    assert N.apostrophe_errors(right, names).count() == 0
    assert N.dash_errors(right, names).count() == 0
    assert N.case_errors(right, names).count() == 0
    wrong = N.apostrophe_errors(docs("We saw Oren."), names).collect()
    assert {r.official for r in wrong} == {"O'ren", "Or'en"}
