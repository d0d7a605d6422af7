"""The audit jobs: documents in; findings, metrics, notes and reports out.

One projection computes every single-document detector and measure, and drops
the text.  Only dictionary hits, which are few, are grouped by document and
joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions.findings import finding, flat, no_findings, ordered
from prosemetrics.functions.numbers import rounded
from prosemetrics.functions.text import evidence_trim, normalize_newlines
from prosemetrics.functions.units import with_units
from prosemetrics.operators import consistency, markers, measures, names as N, structure
from prosemetrics.operators.markers import _template
from prosemetrics.operators.reporting import summary_of
from prosemetrics.operators.rulecheck import games_table
from prosemetrics.packs.base import Rules


@dataclass(frozen=True)
class Options:
    """Switches of an audit run."""

    strict: bool = False
    advice: bool = True
    coverage: bool = True
    shares: bool = True
    short_note: bool = True
    extra: tuple[str, ...] = ()
    # Dictionary checks: of apostrophe, dash, case, typo and short.
    name_checks: tuple[str, ...] = ("apostrophe", "dash")
    # A word in this share of the documents or more names nothing (short).
    common_share: float = 0.05


# The service neither judges advice and coverage nor warns about short texts.
SERVICE = Options(advice=False, coverage=False, shares=False, short_note=False)

RowAnalyzer = Callable[[Rules, Options], Column]


def _markers(rules: Rules, options: Options) -> Column:
    return markers.marker_findings(F.col("text"), F.col("lines"), rules)


def _consistency(rules: Rules, options: Options) -> Column:
    return consistency.variant_findings(F.col("text"), rules, options.strict)


def _structure(rules: Rules, options: Options) -> Column:
    found = structure.missing_section_findings(
        F.col("headings"), F.col("sections"), rules, options.shares
    )
    if options.coverage:
        found = F.concat(
            found,
            structure.coverage_findings(
                F.col("lines"),
                F.col("headings"),
                F.col("sections"),
                F.col("require_entities"),
                rules,
            ),
        )
    return found


# Analyzers that need one document only: (rules, options) -> array of findings,
# over the columns text, lines, sentences, headings, sections, require_entities.
ROW_ANALYZERS: dict[str, RowAnalyzer] = {
    "markers": _markers,
    "consistency": _consistency,
    "structure": _structure,
}
# Off unless named in Options.extra.
EXTRA_ANALYZERS: dict[str, RowAnalyzer] = {
    "terms": lambda rules, options: markers.term_findings(F.col("text"), F.col("lines"), rules),
    "typography": lambda rules, options: markers.typography_findings(F.col("text"), rules),
    "artifacts": lambda rules, options: markers.artifact_findings(F.col("text"), rules),
    "section_order": lambda rules, options: structure.section_order_findings(
        F.col("headings"), F.col("sections"), rules
    ),
    "declared_count": lambda rules, options: consistency.declared_count_findings(
        F.col("lines"), rules
    ),
}
# Analyzers a profile can switch off, in report order.
SWITCHES = ("markers", "cards", "consistency", "structure", "rhythm", "soul")


def register(name: str, analyzer: RowAnalyzer) -> None:
    """Add an analyzer of single documents; it returns findings, it does not print."""
    if name in ROW_ANALYZERS or name in EXTRA_ANALYZERS:
        raise ValueError(f"analyzer {name} is already registered")
    EXTRA_ANALYZERS[name] = analyzer


def with_custom_function(docs: DataFrame, function, schema: str) -> DataFrame:
    """Hook for code that has no column form, such as a morphological parser.

    ``function`` maps an iterator of pandas frames to one of pandas frames and
    runs on Arrow batches in the tasks.
    """
    return docs.mapInPandas(function, schema)


def _on(analyzer: str) -> Column:
    return F.coalesce(F.try_element_at("analyzers", F.lit(analyzer)), F.lit(True))


def _narrow(profiled: DataFrame, rules: Rules, options: Options, keep: list) -> DataFrame:
    """The one pass over the text: row findings and metrics per document."""
    lang = rules.language
    units = with_units(profiled, lang)
    found = [
        F.when(_on(name), build(rules, options)).otherwise(no_findings())
        for name, build in ROW_ANALYZERS.items()
    ]
    found += [
        F.when(_on(name), EXTRA_ANALYZERS[name](rules, options)).otherwise(no_findings())
        for name in options.extra
    ]
    return units.select(
        *keep,
        "words",
        F.when(_on("rhythm"), measures.rhythm(F.col("sentence_words"))).alias("rhythm"),
        F.when(
            _on("soul"),
            measures.voice(
                F.col("text"), F.col("sentences"), F.col("sentence_words"), F.col("words"), lang
            ),
        ).alias("voice"),
        F.concat(*found).alias("row_findings"),
    )


def _row_key() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("hash"))


def _dictionary_hits(
    docs: DataFrame, names: DataFrame, rules: Rules, options: Options
) -> DataFrame | None:
    """(_row, hits): dictionary findings of a document, in a fixed order.

    ``_row`` is the id and the text's hash: documents that share an id keep
    their own findings, and equal documents have equal ones.  Profiles are not
    looked at here, so they are guessed in one place only; what a profile
    switches off is dropped when the report is put together.
    """
    docs = docs.select(_row_key().alias("doc_id"), "text")
    kinds = tuple(k for k in options.name_checks if k in ("apostrophe", "dash", "case"))
    parts = [N.name_hits(docs, names, kinds, copies=True)] if kinds else []
    once = docs.dropDuplicates(["doc_id"])
    if "typo" in options.name_checks:
        parts.append(N.typo_candidates(once, names, rules.language).withColumn("kind", F.lit("typo")))
    if "short" in options.name_checks:
        common = N.common_words(docs, rules.language, options.common_share)
        short = N.short_names(once, names, common, rules.language)
        parts.append(short.withColumn("kind", F.lit("short")))
    columns = ["doc_id", "kind", "was", "official", F.col("n").cast("int").alias("n")]
    hits = None
    for part in parts:
        part = part.select(*columns)
        hits = part if hits is None else hits.unionByName(part)
    if options.advice:
        lang = rules.language
        # a conflict needs both stances somewhere in the text
        stanced = docs.where(
            F.col("text").rlike(lang.keep_stance) & F.col("text").rlike(lang.discard_stance)
        )
        advice = (
            consistency.advice_rows(stanced, names, lang)
            .where(F.col("kept") & F.col("discarded"))
            .select(
                "doc_id",
                F.lit("advice").alias("kind"),
                evidence_trim(F.col("keep_clause")).alias("was"),
                "official",
                F.lit(None).cast("int").alias("n"),
            )
        )
        hits = advice if hits is None else hits.unionByName(advice)
    if hits is None:
        return None
    return hits.groupBy(F.col("doc_id").alias("_row")).agg(
        F.array_sort(F.collect_set(F.struct("kind", "was", "official", "n"))).alias("hits")
    )


def _hit_findings(rules: Rules, names_kind: Column | None) -> Column:
    def build(h: Column) -> Column:
        advice = h["kind"] == "advice"
        message = F.lit(rules.messages["apostrophe"])
        for kind in ("dash", "case", "typo", "short"):
            message = F.when(h["kind"] == kind, rules.messages[kind]).otherwise(message)
        heuristic = h["kind"].isin("typo", "short")
        if names_kind is not None:
            message = F.concat(
                F.regexp_replace(message, r" карты$", ""), F.lit(" ("), names_kind, F.lit(")")
            )
        return F.when(
            advice,
            finding(
                id="consistency.advice",
                analyzer="consistency",
                category="advice",
                severity="review",
                confidence=0.4,
                message=_template(rules.messages["advice"], h["official"]),
                evidence=h["was"],
                suggestion=rules.messages["advice_fix"],
            ),
        ).otherwise(
            finding(
                id=F.concat(F.lit("cards."), h["kind"]),
                analyzer="cards",
                category="localization",
                severity=F.when(h["kind"] == "typo", "likely").when(h["kind"] == "short", "info").otherwise("error"),
                confidence=F.when(heuristic, 0.5).otherwise(1.0),
                message=message,
                evidence=h["was"],
                suggestion=h["official"],
                meta=F.create_map(F.lit("count"), h["n"]),
            )
        )

    wanted = F.filter(
        "hits", lambda h: F.when(h["kind"] == "advice", _on("consistency")).otherwise(_on("cards"))
    )
    return F.coalesce(F.transform(wanted, build), no_findings())


def _assemble(
    base: DataFrame,
    hits: DataFrame | None,
    rules: Rules,
    notes: list[Column],
    options: Options,
    kind: Column | None = None,
) -> DataFrame:
    if hits is not None:
        base = base.join(hits, "_row", "left")
        found = F.concat("row_findings", _hit_findings(rules, kind))
    else:
        found = F.col("row_findings")
    stamped = F.transform(found, lambda f: f.withField("profile", F.col("profile")))
    rows = base.withColumn("_found", stamped)
    unknown = F.when(
        F.col("analyzers").isNull(),
        _template(rules.messages["unknown_profile"], F.coalesce("profile", F.lit("null"))),
    )
    notes = [*notes, unknown]
    if options.short_note:
        short = F.when(
            F.col("words") < F.col("min_words"),
            _template(rules.messages["short_document"], F.col("words"), F.col("min_words")),
        )
        notes = [*notes, short]
    return rows.withColumn("findings", ordered(F.col("_found"))).select(
        "doc_id",
        "profile",
        "words",
        "findings",
        summary_of(F.col("findings")).alias("summary"),
        F.map_filter(
            F.create_map(
                F.lit("rhythm_ratio"),
                rounded(F.col("rhythm.ratio"), 3),
                F.lit("sentence_mean"),
                rounded(F.col("rhythm.mean"), 1),
                F.lit("voice_per_1k"),
                rounded(measures.voice_total(F.col("voice")), 1),
                F.lit("voice_norm"),
                F.when(F.col("voice").isNotNull(), F.col("voice_norm")),
                F.lit("rhythm_norm"),
                F.when(F.col("rhythm").isNotNull(), F.col("rhythm_norm")),
                F.lit("words"),
                F.col("words").cast("double"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("metrics"),
        "analyzers_skipped",
        F.array_compact(F.array(*notes)).alias("notes"),
        *[c for c in ("game", "norms_provisional") if c in base.columns],
    )


def audit(
    docs: DataFrame,
    rules: Rules,
    names: DataFrame | None = None,
    explicit: str | None = None,
    options: Options = Options(),
) -> DataFrame:
    """One report row per document of ``docs(doc_id, text[, explicit])``.

    ``explicit`` names a column with the chosen profile; where it is null the
    profile is guessed and a note says so.  A note also says where the chosen
    profile does not exist, so that nothing of it was checked.  Without ``names`` the dictionary
    checks are left out.
    """
    clean = docs.withColumn("text", normalize_newlines(F.col("text")))
    profiled = structure.with_profile(clean, rules, explicit)
    keep = ["doc_id", "profile", "profile_confidence", "min_words", "analyzers"]
    keep.append(_row_key().alias("_row"))
    base = (
        _narrow(profiled, rules, options, keep)
        .withColumn("analyzers_skipped", structure.skipped_analyzers(F.col("analyzers"), SWITCHES))
        .withColumn(
            "voice_norm", F.lit(rules.games[rules.default_game].norms.get("voice_per_1k"))
        )
        .withColumn("rhythm_norm", F.lit(None).cast("double"))
    )
    hits = None if names is None else _dictionary_hits(clean, names, rules, options)
    guessed = F.when(
        F.col("profile_confidence").isNotNull(),
        _template(
            rules.messages["detected_profile"], F.col("profile"), F.col("profile_confidence")
        ),
    )
    return _assemble(base, hits, rules, [guessed], options)


def analyze(
    docs: DataFrame,
    rules: Rules,
    names: DataFrame | None = None,
    explicit: str | None = None,
    options: Options = SERVICE,
) -> DataFrame:
    """The service variant: documents carry a ``game`` that sets norms and names.

    No advice or coverage checks; borrowed norms and a missing dictionary are
    said in the notes.
    """
    spark = docs.sparkSession
    clean = docs.withColumn("text", normalize_newlines(F.col("text")))
    games = F.broadcast(games_table(spark, rules).drop("profiles", "protected"))
    profiled = structure.with_game_profile(clean, rules, explicit).join(games, "game", "left")
    keep = [
        "doc_id",
        "game",
        "profile",
        "min_words",
        "analyzers",
        "has_names",
        "names_kind",
        "names_note",
        "norms_source",
        F.col("provisional").alias("norms_provisional"),
        F.col("norm_voice_per_1k").alias("voice_norm"),
        F.col("norm_rhythm_ratio").alias("rhythm_norm"),
        _row_key().alias("_row"),
    ]
    base = _narrow(profiled, rules, options, keep)
    skipped = structure.skipped_analyzers(
        F.when(
            F.col("has_names"), F.col("analyzers")
        ).otherwise(
            F.map_concat(
                F.map_filter("analyzers", lambda k, v: k != "cards"),
                F.create_map(F.lit("cards"), F.lit(False)),
            )
        ),
        SWITCHES,
    )
    base = base.withColumn("analyzers_skipped", skipped)
    hits = None
    if names is not None:
        named = clean.join(games.select("game", "has_names"), "game").where("has_names")
        hits = _dictionary_hits(named, names, rules, options)
    notes = [
        measures.norm_caveat(rules, F.col("norms_source"), F.col("norms_provisional")),
        F.when(
            ~F.col("has_names"), _template(rules.messages["names_skipped"], F.col("names_note"))
        ),
    ]
    return _assemble(base, hits, rules, notes, options, F.col("names_kind"))


def findings_of(reports: DataFrame) -> DataFrame:
    """Flat findings table of a report frame."""
    return flat(reports, F.col("findings"))
