from __future__ import annotations

import pytest

from prosemetrics.operators import gate
from prosemetrics.packs import russian

RULES = russian.RULES
LIVE = (
    "Оставляйте Железный щит в каждом матч-апе. Но не тратьте его слишком рано. "
    "Хотя соблазн есть, вы отдадите темп. Усиливайте роботов (особенно против Мага). "
)
DRY = (
    "Архетип применяет обычный набор карт и следует привычной схеме размена на столе. "
    "Список сложился давно и с тех пор почти не менялся, что заметно по статистике. "
)


def pairs(spark, **cases):
    rows = [(k, b, a) for k, (b, a) in cases.items()]
    return spark.createDataFrame(rows, "pair_id string, before string, after string")


def states(spark, before, after):
    from pyspark.sql import functions as F

    row = gate.measured(pairs(spark, x=(before, after)), RULES)
    cols = [
        gate.classify(
            F.col(f"b_voice.{s}.n"), F.col(f"a_voice.{s}.n"), F.col("b_words"), F.col("a_words")
        ).alias(s)
        for s in gate.SIGNALS
    ]
    return set(row.select(*cols).first())


def test_expansion_is_not_loss(spark):
    assert states(spark, LIVE * 8, LIVE * 8 + DRY * 20) == {"kept"}


def test_removal_is_caught_at_any_length(spark):
    assert "removed" in states(spark, LIVE * 8, DRY * 20)
    assert "removed" in states(spark, LIVE * 2, DRY * 2)


def test_shrinking_does_not_hide_removal(spark):
    assert "removed" in states(spark, LIVE * 16 + DRY * 40, LIVE * 8)


def test_small_equal_samples_get_no_verdict(spark):
    assert states(spark, LIVE, LIVE) == {"insufficient"}


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = pairs(
        spark,
        flat=(LIVE * 2, DRY * 2),
        same=(LIVE, LIVE),
        letter=(LIVE, LIVE.replace("темп", "тэмп")),
        numbers=("Щит стоит 3 маны и даёт 4/5 сразу.\n", "Щит стоит маны и даёт тело сразу.\n"),
        fixed=("Колода собирает ОТК к ходу.\n", "Колода собирает бой к ходу.\n"),
        code=("Код:\nAAECAZabcdefGH12+/=\n", "Код:\nнету его здесь совсем никак\n"),
        empty=(LIVE, ""),
    )
    return {r.pair_id: r for r in gate.validate_edits(cases, RULES).collect()}


def kinds(verdict):
    return {(v["kind"], v["signal"]) for v in verdict.violations}


def test_flattened_text_is_rejected_for_voice(verdicts):
    assert not verdicts["flat"].accepted
    assert sum(v["kind"] == "voice_lost" for v in verdicts["flat"].violations) >= 3


@pytest.mark.parametrize("case", ["same", "letter"])
def test_harmless_edits_pass(verdicts, case):
    assert verdicts[case].accepted and verdicts[case].violations == []


def test_protected_items(verdicts):
    assert {("protected_lost", "числа"), ("protected_lost", "статы")} <= kinds(verdicts["numbers"])
    assert kinds(verdicts["fixed"]) == {("protected_lost", "ОТК")}
    assert ("protected_lost", "коды колод") in kinds(verdicts["code"])


def test_emptied_text_loses_everything(verdicts):
    lost = kinds(verdicts["empty"])
    assert {s for k, s in lost if k == "voice_lost"} == set(
        RULES.language.signal_labels.values()
    )
    assert ("text_shrunk", None) in lost


def test_repeated_item_counts_as_often_as_it_occurs(spark):
    cases = pairs(spark, x=("2 и 2 и 3 раза", "2 и 3 и три раза"))
    row = gate.validate_edits(cases, RULES).first()
    assert [v["message"] for v in row.violations] == ["пропало защищённое (числа): 2"]


def test_games_protect_their_own_words(spark):
    rows = [("a", "Здесь ГКД важен.", "Здесь они важны.", g) for g in ("hearthstone", "wow")]
    frame = spark.createDataFrame(
        rows, "pair_id string, before string, after string, game string"
    )
    got = {r.game: kinds(r) for r in gate.validate_edits(frame, RULES).collect()}
    assert ("protected_lost", "ГКД") in got["wow"]
    assert ("protected_lost", "ГКД") not in got["hearthstone"]


@pytest.fixture(scope="module")
def choices(spark):
    docs = spark.createDataFrame(
        [("second", LIVE), ("never", LIVE), ("none", LIVE)], "doc_id string, text string"
    )
    attempts = spark.createDataFrame(
        [
            ("second", 1, DRY),
            ("second", 2, f"```\n{LIVE}\n```"),
            ("second", 3, DRY),
            ("never", 1, DRY),
            ("never", 2, DRY),
            ("never", 3, LIVE),
        ],
        "doc_id string, n int, text string",
    )
    return {r.doc_id: r for r in gate.select_attempt(docs, attempts, RULES, 2).collect()}


def test_first_accepted_attempt_wins(choices):
    row = choices["second"]
    assert row.accepted and row.accepted_n == 2 and row.text == LIVE.strip()
    assert [a["n"] for a in row.attempts] == [1, 2] and row.caveat is None


def test_original_returns_when_the_cap_is_reached(choices):
    row = choices["never"]
    assert not row.accepted and row.text == LIVE and len(row.attempts) == 2
    assert "возвращён исходный текст" in row.caveat


def test_document_without_attempts_keeps_its_text(choices):
    assert choices["none"].text == LIVE and choices["none"].attempts == []


def test_gate_has_no_shuffle(spark):
    frame = gate.validate_edits(pairs(spark, x=(LIVE, DRY)), RULES)
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_games_share_one_set_of_checks(spark):
    """The plan hardly grows with the number of games, and each game keeps its own words."""
    from dataclasses import replace

    base = RULES.games[RULES.default_game]
    more = {f"g{i}": replace(base, id=f"g{i}", protected=("щит",) if i % 2 else ()) for i in range(20)}
    rows = [(g, "Наш щит.", "Наш меч.", g) for g in ("g0", "g1", RULES.default_game, "other", None)]
    pairs = spark.createDataFrame(rows, "pair_id string, before string, after string, game string")

    def verdicts(games):
        return gate.validate_edits(pairs, replace(RULES, games=games))

    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    few, many = {**RULES.games, "g1": more["g1"]}, {**RULES.games, **more}
    assert size(verdicts(many)) < 1.5 * size(verdicts(few))
    lost = {r.pair_id for r in verdicts(many).collect() if any(v.signal == "щит" for v in r.violations)}
    assert lost == {"g1"}


def test_documents_that_share_an_id_or_have_none(spark):
    """Each row comes out once, judged by its own text."""
    docs = spark.createDataFrame([("a", LIVE), ("a", DRY), (None, LIVE), ("b", LIVE), ("b", LIVE), ("c", DRY)], "doc_id string, text string")
    tries = spark.createDataFrame(
        [("a", 1, DRY), ("a", 2, LIVE.replace("темп", "тэмп")), (None, 1, LIVE.replace("темп", "ритм")), ("b", 1, DRY)],
        "doc_id string, n int, text string",
    )
    got = sorted(((r.doc_id or "", r.accepted_n, r.text, len(r.attempts)) for r in gate.select_attempt(docs, tries, RULES).collect()), key=str)
    want = [
        ("", 1, LIVE.replace("темп", "ритм").strip(), 1),
        ("a", 1, DRY.strip(), 1),  # the dry document keeps its own words
        ("a", 2, LIVE.replace("темп", "тэмп").strip(), 2),
        ("b", None, LIVE, 1),
        ("b", None, LIVE, 1),
        ("c", None, DRY, 0),
    ]
    assert got == sorted(want, key=str)


def test_a_marker_over_a_line_break_is_none_anywhere(spark):
    from prosemetrics.operators import markers
    from prosemetrics.plans.scoring import score_inputs
    from prosemetrics.operators.structure import with_profile

    whole, broken = "Стоит отметить это.", "Стоит\nотметить это."
    docs = spark.createDataFrame([("w", whole), ("b", broken)], "doc_id string, text string")
    found = {r.doc_id for r in markers.markers(docs, RULES).collect()}
    sides = {r.pair_id: (r.b_markers, r.a_markers) for r in gate.measured(pairs(spark, x=(whole, broken)), RULES).collect()}
    scored = {r.doc_id: r.markers for r in score_inputs(with_profile(docs, RULES), RULES).collect()}
    assert found == {"w"} and sides == {"x": (1, 0)} and scored == {"w": 1, "b": 0}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_kind_measures_only_what_it_needs(spark):
    given = pairs(spark, a=(LIVE * 8, LIVE * 4), b=(LIVE, LIVE))
    shrunk = gate.validate_edits(given, RULES, ("text_shrunk",)).select("pair_id", "violations")
    assert RULES.language.address not in plan_of(shrunk) and r"\S+" not in plan_of(shrunk)
    whole = {r.pair_id: r.violations for r in gate.validate_edits(given, RULES).collect()}
    for kind in gate.KINDS:
        for row in gate.validate_edits(given, RULES, (kind,)).collect():
            assert row.violations == [v for v in whole[row.pair_id] if v.kind == kind]


def test_text_measured_before_it_is_multiplied_gives_the_same(spark):
    from pyspark.sql import functions as F

    given = pairs(spark, a=(LIVE * 8, LIVE * 4), b=(LIVE, LIVE), c=(DRY, ""), d=(None, LIVE), e=(None, None), f=(LIVE, None))
    plain = gate.measured(given, RULES)
    early = gate.measured(gate.measured_before(given, RULES), RULES)
    assert early.columns == plain.columns
    assert sorted(early.collect(), key=repr) == sorted(plain.collect(), key=repr)
    edits = gate.measured_before(given, RULES).withColumn("after", F.explode(F.array("after", F.upper("after"))))
    # the before side's patterns stand below the explode, the after side's above: once each
    plan = plan_of(gate.validate_edits(edits, RULES, ("voice_lost",)).select("pair_id", "violations"))
    assert plan.count(RULES.language.address) == 2
    verdicts = gate.validate_edits(gate.measured_before(given, RULES), RULES)
    assert verdicts.columns == gate.validate_edits(given, RULES).columns
    assert sorted(verdicts.collect(), key=repr) == sorted(gate.validate_edits(given, RULES).collect(), key=repr)


def test_stream_query_measures_a_document_once(spark, monkeypatch):
    """The text before is measured ahead of its edits, not once for each of them."""
    from prosemetrics.streaming import jobs
    from workloads import queries

    seen = []
    monkeypatch.setattr(jobs, "verdict_stream", lambda pairs, rules: seen.append(pairs) or pairs)
    monkeypatch.setattr(queries, "_drained", lambda spark, rows: spark.createDataFrame([], "edit string, accepted boolean"))
    queries.verdict_stream(spark, "/root/testdata/sf0.001")
    assert {f"b_{m}" for m in gate.MEASURES} <= set(seen[0].columns)


def test_items_that_were_not_there_are_not_looked_for(spark):
    """Only a kind that the text before has can be lost; the other kinds cost no search in each edit."""
    from prosemetrics.operators.gate import protected_losses
    from pyspark.sql import functions as F

    given = pairs(spark, gain=("Слова.", "Слова 12 и 3/4."), loss=("Слова 12 и ОТК.", "Слова 12."), d=(None, "12"), e=("12", None))
    rows = gate.measured(given, RULES).withColumn("lost", protected_losses(F.col("b_items"), F.col("a_items"), RULES))
    got = {r.pair_id: r for r in rows.collect()}
    assert not any(got["gain"].a_items) and got["gain"].lost == []
    assert got["loss"].a_items[0] == ["1:12"] and [(k.kind, list(k["items"])) for k in got["loss"].lost] == [("ОТК", ["ОТК"])]


def test_attempts_are_shuffled_once(spark):
    """The text of the accepted attempt comes from the shuffle that its verdict was made from."""
    docs = spark.createDataFrame([("a", LIVE), (None, DRY)], "doc_id string, text string").repartition(3)
    tries = spark.createDataFrame([("a", 1, LIVE), ("a", -(2**31), DRY)], "doc_id string, n int, text string").repartition(3)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = gate.select_attempt(docs, tries, RULES)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: (r.accepted_n, r.text) for r in out.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert any("ReusedExchange [_id" in line for line in plan.split("\n"))
    assert got == {"a": (1, LIVE.strip()), None: (None, DRY)}
