from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosemetrics.functions import findings as FN
from prosemetrics.operators import integrity, reporting, rulecheck
from prosemetrics.packs import russian
from prosemetrics.packs.base import Term
from prosemetrics.plans.corpus_checks import validate_corpus
from prosemetrics.sources import corpus, rules as rule_source

RULES = russian.RULES
HEAD = """---
id: {id}
title: "О щитах: разбор"
published_at: unknown
updated_at: unknown
game_mode: {mode}
genre: {genre}
patch: unknown
source_url: unknown
extraction_source: pdf
clean_status: reviewed
---
{body}"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")

    def put(name, **kw):
        fields = {"id": name, "mode": "standard", "genre": "news", "body": "Текст.\r\nЕщё.\n", **kw}
        (root / f"{name}.md").write_text(HEAD.format(**fields), encoding="utf-8", newline="")

    put("a-good")
    put("b-copy", id="a-good")
    put("c-copy", id="a-good")
    put("d-genre", genre="эссе", mode="пляж")
    put("e-empty", body="  \n")
    put("f-copy-of-empty", id="e-empty")
    (root / "g-bare.md").write_text("Без шапки.\n", encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return corpus.read_corpus(spark, folder).cache()


def test_header_never_reaches_the_text(loaded):
    rows = {r.path: r for r in loaded.collect()}
    good = rows["a-good.md"]
    assert good.text == "Текст.\nЕщё.\n"
    assert good.meta["title"] == "О щитах: разбор" and len(good.meta) == 10
    assert rows["g-bare.md"].doc_id == "g-bare" and rows["g-bare.md"].meta == {}


def test_validation(loaded):
    got = {(r.path, r.id, r.severity) for r in validate_corpus(loaded, RULES).collect()}
    assert ("b-copy.md", "corpus.duplicate-id", "error") in got
    assert ("c-copy.md", "corpus.duplicate-id", "error") in got
    assert ("d-genre.md", "corpus.unknown-genre", "error") in got
    assert ("d-genre.md", "corpus.unknown-mode", "likely") in got
    assert {g for g in got if g[0] == "e-empty.md"} == {
        ("e-empty.md", "corpus.empty-file", "error")
    }
    # a blank document does not hold its id
    assert not {g for g in got if g[0] == "f-copy-of-empty.md"}
    assert sum(g[:2] == ("g-bare.md", "corpus.missing-field") for g in got) == 1
    bare = validate_corpus(loaded, RULES).where("path = 'g-bare.md'").count()
    assert bare == 10


def test_each_repeat_names_the_previous_holder(loaded):
    got = {r.path: r.previous for r in integrity.duplicate_ids(loaded, RULES).collect()}
    assert got == {"b-copy.md": "a-good.md", "c-copy.md": "b-copy.md"}


def test_hot_id_spans_partitions(spark):
    """One id holding most rows is chained right across partition borders."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 < 3, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.format_string("p%05d", "id").alias("path"),
    )
    got = integrity.previous_in_order(rows.repartition(7), "k", "path")
    hot = [(r.path, r.previous) for r in got.where("k = 'hot'").orderBy("path").collect()]
    assert hot[0][1] is None
    assert all(hot[i][1] == hot[i - 1][0] for i in range(1, len(hot)))
    assert got.where("k <> 'hot' AND previous IS NOT NULL").count() == 0


def test_empty_corpus(spark, loaded):
    found = validate_corpus(loaded.limit(0), RULES).collect()
    assert [(r.id, r.severity) for r in found] == [("corpus.empty-corpus", "error")]


def test_statistics(loaded):
    rows = {(r.level, r.value): r for r in integrity.corpus_stats(loaded).collect()}
    assert rows["all", ""].documents == 7
    assert rows["genre", "—"].documents == 1
    assert rows["mode", "standard"].documents == 5
    assert rows["all", ""].unknown_values == 6 * 4


@pytest.mark.parametrize("share,holdout", [(0.2, 10), (0.5, 25), (0.0, 0)])
def test_split_is_disjoint_complete_and_stable(spark, share, holdout):
    ids = spark.range(49).select(F.format_string("guide-%03d", F.col("id") + 1).alias("id"))
    first = {r.id: r.part for r in integrity.split_corpus(ids.repartition(5), share).collect()}
    again = {r.id: r.part for r in integrity.split_corpus(ids.repartition(3), share).collect()}
    assert first == again and len(first) == 49
    step = max(2, int(1 / share)) if share else 0
    expected = {n for i, n in enumerate(sorted(first)) if step and i % step == 0}
    assert {k for k, v in first.items() if v == "holdout"} == expected
    assert len(expected) == holdout


def test_repeated_id_stays_on_one_side(spark):
    ids = ["a", "b", "c", "c", "c", "c", "d", "e"]
    got = integrity.split_corpus(spark.createDataFrame([(i,) for i in ids], "id string"), 0.25)
    assert {r.id: r.part for r in got.collect()} == {
        "a": "holdout", "b": "calibration", "c": "holdout", "d": "calibration", "e": "calibration",
    }


def test_archive_audit_searches_once(spark):
    """Pairs are listed and totalled from one search of the corpus."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def written(i):
        calls.add(1)
        return None if i == 0 else f"w{i % 3}"

    hits = spark.range(0, 12, numPartitions=2).select(
        F.lit("dash").alias("kind"), written("id").alias("was"), F.lit("o").alias("official"),
        F.lit(2).cast("long").alias("n"), (F.col("id") == 11).alias("from_artifact"),
    )
    got = sorted(map(tuple, reporting.archive_audit(hits).select("from_artifact", "was", "official", "n", "pairs").collect()), key=repr)
    assert calls.value == 12
    assert got == sorted(
        [(False, None, "o", 2, None), (False, "w0", "o", 6, None), (False, "w1", "o", 8, None), (False, "w2", "o", 6, None),
         (True, "w2", "o", 2, None), (False, None, None, 22, 4)], key=repr,
    )


def test_percentiles_are_exact(spark):
    values = [0.1 * i for i in range(1, 12)]
    frame = spark.createDataFrame([(v,) for v in values], "score double")
    row = reporting.calibration(frame).first()
    assert (row.minimum, row.p25, row.p50, row.p75) == pytest.approx((0.1, 0.35, 0.6, 0.85))


def test_findings_model(spark, loaded):
    raw = loaded.select(
        "path",
        F.explode(
            F.array(
                *[
                    FN.finding(id=i, analyzer="t", category="c", severity=s, confidence=c, message="m")
                    for i, s, c in (("a", "review", 0.4), ("b", "grave", 0.4), ("c", "info", 1.5))
                ]
            )
        ).alias("f"),
    ).select("path", "f.*")
    good, bad = FN.quarantine(raw)
    assert {r.id for r in good.collect()} == {"a"}
    assert {r.id for r in bad.collect()} == {"b", "c"}
    with pytest.raises(Exception, match="bad severity"):
        raw.select(FN.checked(FN.packed(raw))).collect()
    json = good.select(FN.compact_json(FN.packed(good)).alias("j")).first().j
    assert json == (
        '{"id":"a","analyzer":"t","category":"c","severity":"review","confidence":0.4,"message":"m"}'
    )


def test_gate_threshold(spark):
    docs = spark.createDataFrame([("x",), ("y",)], "doc_id string")
    found = spark.createDataFrame([("x", "review")], "doc_id string, severity string")

    def code(level):
        return {r.doc_id: r.exit_code for r in reporting.quality_gate(found, docs, level).collect()}

    assert code("error") == {"x": 0, "y": 0}
    assert code("review") == {"x": 1, "y": 0}
    with pytest.raises(ValueError):
        reporting.quality_gate(found, docs, "grave")


def conflicts(spark, *terms, **typography):
    decisions = {**RULES.typography_decisions, **typography}
    frame = rulecheck.rule_conflicts(
        rulecheck.terms_table(spark, terms or RULES.terms),
        rulecheck.typography_table(spark, RULES.typography, decisions),
    )
    return {(r.problem, r.subject) for r in frame.collect()}


def test_published_rules_do_not_conflict(spark):
    assert conflicts(spark) == set()


def test_conflicts_are_found(spark):
    a = Term("t.a", "allowed", slang="сетап")
    b = Term("t.a", "auto_replace", slang="Сетап", preferred="подготовка",
             corpus={"slang": 68, "preferred": 17})
    c = Term("t.c", "auto_replace", slang="дека")
    d = Term("t.d", "allowed", slang="пыль", preferred="прах")
    assert conflicts(spark, a, b, c, d) == {
        ("duplicate-id", "t.a"),
        ("contradictory-decisions", "сетап"),
        ("replacement-rarer", "t.a"),
        ("replacement-missing", "t.c"),
        ("replacement-unexpected", "t.d"),
    }
    assert conflicts(spark, yo="maybe", keep_hyphen_in="ничего") == {
        ("unknown-decision", "typography.yo"),
        ("hyphen-not-kept", "typography.dashes"),
    }


def test_rule_records_are_checked():
    with pytest.raises(ValueError, match="without an id"):
        rule_source.terms_from_records([{"decision": "allowed"}])
    with pytest.raises(ValueError, match="decision must be"):
        rule_source.terms_from_records([{"id": "x", "decision": "sometimes"}])
    with pytest.raises(ValueError, match="number 1 is without an id.*x: word has the wrong type"):
        rule_source.terms_from_records([{"decision": "allowed"}, {"id": "x", "decision": "allowed", "word": 3}])


def test_yaml_rules(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "profiles").mkdir()
    (tmp_path / "games").mkdir()
    (tmp_path / "profiles" / "note.yaml").write_text(
        "id: note\nmin_words: 5\nsections:\n  required:\n    - {id: a, title: Альфа}\n"
        "  optional:\n    - {id: b, title: Бета, variants: [Бета, Вторая]}\n"
        "analyzers: {rhythm: false}\nhints: ['\\bноты\\b']\n", encoding="utf-8",
    )
    (tmp_path / "games" / "chess.yaml").write_text(
        "id: chess\nnames: {asset: null, note: нет списка}\nprofiles: [note]\n", encoding="utf-8"
    )
    (tmp_path / "terminology.yaml").write_text(
        "rules:\n  - {id: t, decision: allowed, word: ход}\n", encoding="utf-8"
    )
    (tmp_path / "typography.yaml").write_text(
        "yo: {decision: keep, corpus: {with: 3}}\nnumbers:\n  range: {decision: hyphen}\n"
        "dashes: {keep_hyphen_in: [матч-ап]}\n", encoding="utf-8"
    )
    got = rule_source.read_yaml_rules(str(tmp_path), RULES)
    note = got.profiles["note"]
    assert note.sections[0].variants == ("альфа",) and note.sections[1].variants == ("бета", "вторая")
    assert note.analyzers == {"rhythm": False}
    assert got.hints == {"note": (r"\bноты\b",)}
    assert got.typography_decisions == {"yo": "keep", "range": "hyphen", "keep_hyphen_in": "матч-ап"}
    assert got.games["chess"].provisional and not got.games["chess"].has_names
    assert [t.subject for t in got.terms] == ["ход"]


def test_absent_decisions_are_reported(spark):
    assert ("unknown-decision", "typography.yo") in conflicts(spark, yo=None)
    assert ("unknown-decision", "typography.quotes") in conflicts(spark, quotes=None)


def test_equal_file_names_in_two_folders(spark, tmp_path):
    for folder in ("a", "b c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.md").write_text(f"Текст {folder}", encoding="utf-8")
    rows = {r.doc_id: (r.path, r.text) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a/x": ("a/x.md", "Текст a"), "b c/x": ("b c/x.md", "Текст b c")}


@pytest.mark.parametrize(
    ("value", "digits", "want"),
    [(5 / 8, 2, 0.62), (-6.25, 1, -6.2), (6.35, 1, 6.3), (12.5, 0, 12.0), (13.5, 0, 14.0), (2.675, 2, 2.67), (2.45, 1, 2.5)],
)
def test_rounding_judges_the_binary_value(spark, value, digits, want):
    from pyspark.sql import functions as F

    from prosemetrics.functions.numbers import rounded

    assert round(value, digits) == want
    assert spark.range(1).select(rounded(F.lit(value), digits)).first()[0] == want
