from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from prosemetrics.functions.findings import finding, one_if
from prosemetrics.operators.reporting import report_json
from prosemetrics.operators import retrieval, rulecheck
from prosemetrics.packs import russian
from prosemetrics.plans import audit as A
from prosemetrics.sources import sinks
from prosemetrics.streaming import jobs
from tests.conftest import CLEAN

RULES = russian.RULES


def test_report_json_has_stable_keys(docs, names):
    text = CLEAN.replace("Железный щит", "АлАкир")
    reports = A.audit(docs(text), RULES, names)
    report = json.loads(report_json(reports).first().report)
    assert list(report) == [
        "schema_version", "document", "profile", "summary", "metrics", "findings",
        "analyzers_skipped", "notes",
    ]
    assert report["summary"] == {"error": 1, "likely": 0, "review": 0, "info": 0}
    assert report["metrics"]["words"] == len(text.split())
    assert report["metrics"]["voice_norm"] == 29.4
    assert list(report["findings"][0]) == [
        "id", "analyzer", "category", "severity", "confidence", "message", "suggestion",
        "evidence", "profile", "meta",
    ]
    assert report["notes"][0].startswith("профиль определён автоматически: constructed-guide")


def test_news_skips_noisy_analyzers(docs):
    frame = docs("Коротко о патче.").withColumn("p", F.lit("news"))
    report = A.audit(frame, RULES, None, "p").first()
    assert report.analyzers_skipped == ["structure", "rhythm", "soul"]
    assert set(report.metrics) == {"words"}


def test_service_says_what_is_borrowed_and_what_is_off(docs, names):
    frame = docs(CLEAN).withColumn("game", F.lit("wow"))
    report = A.analyze(frame, RULES, names).first()
    assert report.profile == "wow-guide" and report.norms_provisional
    assert report.analyzers_skipped == ["cards"]
    assert report.notes[0].startswith("нормы предварительные")
    assert report.notes[1].startswith("сверка имён отключена")
    assert {f["id"] for f in report.findings} == {
        "structure.missing.rotation", "structure.missing.talents", "structure.missing.stats",
    }


@pytest.mark.parametrize("text", ["", " \n ", "слово"])
def test_edge_texts_pass_through_the_audit(docs, names, text):
    report = A.audit(docs(text), RULES, names).first()
    assert "rhythm_ratio" not in report.metrics
    assert {f["id"].split(".")[0] for f in report.findings} <= {"structure"}


def test_own_analyzer_joins_the_audit(docs):
    A.register(
        "shout",
        lambda rules, options: one_if(
            F.col("text").contains("!"),
            finding(id="own.shout", analyzer="shout", category="own", severity="info", message="!"),
        ),
    )
    try:
        reports = A.audit(docs("Тише!", "Тихо."), RULES, options=A.Options(extra=("shout",)))
        found = {r.doc_id: [f["id"] for f in r.findings if f["id"] == "own.shout"] for r in reports.collect()}
        assert found == {"0": ["own.shout"], "1": []}
        with pytest.raises(ValueError):
            A.register("markers", lambda rules, options: None)
    finally:
        del A.EXTRA_ANALYZERS["shout"]


def test_custom_function_runs_on_batches(docs):
    def lengths(batches):
        for pdf in batches:
            yield pdf.assign(n=pdf["text"].str.len())[["doc_id", "n"]]

    got = A.with_custom_function(docs("да", "нет"), lengths, "doc_id string, n long")
    assert {r.doc_id: r.n for r in got.collect()} == {"0": 2, "1": 3}


def test_single_document_checks_do_not_shuffle(docs):
    plan = A.audit(docs(CLEAN), RULES)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert shuffles == []


def test_sinks_write_what_they_are_given(spark, docs, names, tmp_path):
    reports = A.audit(docs(CLEAN.replace("Железный щит", "АлАкир"), CLEAN), RULES, names)
    sinks.write_reports(reports, str(tmp_path / "r"))
    sinks.write_findings(A.findings_of(reports), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2
    assert [r.analyzer for r in spark.read.parquet(str(tmp_path / "f")).collect()] == ["cards"]


def test_stream_gives_the_rows_of_the_batch(spark, docs, names, tmp_path):
    texts = docs(CLEAN, CLEAN.replace("Железный щит", "АлАкир"), "Надеюсь, это поможет.")
    texts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.document_stream(spark, str(tmp_path / "in"), "doc_id string, text string", 1)

    run = jobs.start_append(
        jobs.findings_stream(stream, RULES), str(tmp_path / "o"), str(tmp_path / "c"), True
    )
    run.awaitTermination()
    key = ("doc_id", "id", "line", "evidence")
    batch = A.findings_of(A.audit(texts, RULES)).select(*key).collect()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "o")).select(*key).collect())) == sorted(
        map(str, batch)
    )

    full = jobs.start_audit(
        stream, RULES, names, str(tmp_path / "o2"), str(tmp_path / "c2"), available_now=True
    )
    full.awaitTermination()
    batch = A.findings_of(A.audit(texts, RULES, names)).select(*key).collect()
    streamed = spark.read.parquet(str(tmp_path / "o2")).select(*key).collect()
    assert sorted(map(str, streamed)) == sorted(map(str, batch))


def test_rules_resolve_per_game_and_profile(spark):
    rows = {(r.game, r.profile): r for r in rulecheck.resolved_rules(spark, RULES).collect()}
    assert len(rows) == 7
    row = rows["hearthstone", "constructed-guide"]
    assert [tuple(p) for p in row.replace] == [
        ("дека", "колода"), ("статы", "характеристики"), ("сетап", "подготовка")
    ]
    assert "винрейт" in row.keep and "миньон" not in row.keep
    assert row.sections_required == ["Сборки", "Декбилдинг", "Муллиган", "Стратегия", "Матч-апы"]


def brute_echo(drafts, archive, max_df, min_shared):
    """Compare every pair of paragraphs directly."""
    df = {}
    for words in archive.values():
        for w in words:
            df[w] = df.get(w, 0) + 1
    out = {}
    for d, dw in drafts.items():
        for a, aw in archive.items():
            shared = {w for w in dw & aw if df[w] <= max_df}
            if len(shared) >= min_shared and d[0] != a[0]:
                out[d, a] = len(shared)
    return out


@pytest.mark.parametrize("hot_rows", [200_000, 2])
def test_echo_matches_brute_force_with_and_without_salting(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(retrieval, "HOT_ROWS", hot_rows)
    words = "галакронд монолит некросити ярость колода карта темп щит разлом осколок".split()
    archive = {("a%d" % (i // 2), i % 2 + 1): {words[i % 10], words[(i * 3 + 1) % 10], "колода"} for i in range(12)}
    drafts = {("d%d" % i, 1): {words[i % 10], words[(i + 1) % 10], words[(i + 3) % 10], "колода"} for i in range(9)}

    def frame(side):
        return spark.createDataFrame(
            [(d, p, " ".join(sorted(w))) for (d, p), w in side.items()],
            "doc_id string, paragraph_no int, paragraph string",
        )

    from dataclasses import replace

    rules = replace(RULES, language=replace(RULES.language, inflection="$^"))
    got = retrieval.echo(frame(drafts), frame(archive), rules, max_df=3, min_shared=2)
    assert {
        ((r.draft_id, r.draft_paragraph), (r.doc_id, r.paragraph_no)): r.shared for r in got.collect()
    } == brute_echo(drafts, archive, 3, 2)


def test_precedent_is_neutral_about_absent_words(spark, docs):
    texts = docs("Темп решает. Темп и ещё раз темп.", "Держите темп.")
    words = spark.createDataFrame([("темп",), ("криптовалюта",)], "word string")
    rows = {
        r.word: r
        for r in retrieval.precedent(texts, words, 2, RULES.messages["precedent_absent"]).collect()
    }
    assert (rows["темп"].occurrences, rows["темп"].sentences) == (4, 3)
    assert [e["sentence"] for e in rows["темп"].examples] == ["Темп решает.", "Темп и ещё раз темп."]
    assert rows["криптовалюта"].occurrences == 0
    assert rows["криптовалюта"].note == "в корпусе не встречается"
    assert retrieval.precedent(texts, words, 0, "-").count() == 2


def test_precedent_looks_only_at_the_first_documents_of_a_word(spark):
    """Examples are the first by id and place, null ids before others; later documents are not sorted."""
    texts = [(i, f"Wort {'selten ' if i % 90 == 7 else ''}hier. Und Wort da.") for i in range(400)] + [(3, "Auch Wort."), (None, "Ein Wort.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    words = spark.createDataFrame([("wort",), ("selten",)], "word string")
    out = retrieval.precedent(docs, words, 3, "-")
    got = {r.word: r for r in out.collect()}
    assert (got["wort"].occurrences, got["wort"].sentences, got["selten"].occurrences) == (802, 802, 5)
    assert [(e.doc_id, e.sentence_no) for e in got["wort"].examples] == [(None, 1), (0, 1), (0, 2)]
    assert [e.doc_id for e in got["selten"].examples] == [7, 97, 187]
    assert "_bound" in out._jdf.queryExecution().optimizedPlan().toString()


def test_documents_with_one_id_keep_their_own_findings(spark, names):
    from prosemetrics.packs.russian import RULES as RUSSIAN
    from prosemetrics.plans.audit import audit

    docs = spark.createDataFrame(
        [("d", "Видим АлАкир сегодня."), ("d", "Видим Ал'Акир сегодня."), ("e", "Видим АлАкир."), ("e", "Видим АлАкир.")],
        "doc_id string, text string",
    )
    got = sorted((r.doc_id, [f.meta["count"] for f in r.findings if f.id == "cards.apostrophe"]) for r in audit(docs, RUSSIAN, names).collect())
    assert got == [("d", []), ("d", [1]), ("e", [1]), ("e", [1])]


def test_unknown_profile_is_said(spark):
    from prosemetrics.packs.russian import RULES as RUSSIAN
    from prosemetrics.plans.audit import audit

    docs = spark.createDataFrame([("d", "Текст.", "нет-такого")], "doc_id string, text string, p string")
    notes = audit(docs, RUSSIAN, explicit="p").first().notes
    assert any("нет-такого" in n for n in notes)


def test_windows_leave_the_state(spark, tmp_path):
    """Once the watermark has passed a window, it is no longer kept; its last count stays on disk."""
    schema = "doc_id string, text string, ts timestamp"
    for hour, name in ((0, "a"), (1, "b"), (40, "c"), (80, "d")):
        rows = spark.createDataFrame([(name, "Надеюсь, это поможет.", None)], schema).withColumn("ts", F.timestamp_seconds(F.lit(hour * 3600)))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.document_stream(spark, str(tmp_path / "in"), schema, 1)
    counts = jobs.severity_windows(stream, RULES)
    run = jobs.start_summary(counts, str(tmp_path / "o"), str(tmp_path / "c"), True)
    run.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    got = jobs.read_summary(counts, str(tmp_path / "o"), "window_start", "severity")
    assert got.count() >= 4
    assert kept[-1] < got.count()


def test_all_name_checks_can_be_chosen(spark, docs, names):
    checks = ("apostrophe", "dash", "case", "typo", "short")
    text = docs("Берём железный щит и АлАкир. Наш Громоверджец и Монетка тут.", "Другой текст.")
    options = A.Options(name_checks=checks, common_share=1.0)
    found = {f.id: f.severity for r in A.audit(text, RULES, names, None, options).collect() for f in r.findings if f.analyzer == "cards"}
    assert found == {"cards.apostrophe": "error", "cards.case": "error", "cards.typo": "likely", "cards.short": "info"}


def test_the_audit_reads_the_text_three_times_at_most(spark, docs, names, tmp_path):
    """The row pass, the name candidates and the advice; the latter two only with a dictionary."""
    docs(CLEAN).write.parquet(str(tmp_path / "d"))
    frame = spark.read.parquet(str(tmp_path / "d"))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(A.audit(frame, RULES)) == 1
    assert scans(A.audit(frame, RULES, names, options=A.Options(advice=False))) == 2
    assert scans(A.audit(frame, RULES, names)) == 3
