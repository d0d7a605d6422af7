"""Template phrases, rule words, typography and extraction residue.

Each is a literal pattern over the text, so all of them fit one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions.findings import (
    action_confidence_of,
    finding,
    flat,
    no_findings,
)
from prosemetrics.functions import text as T
from prosemetrics.packs.base import Marker, Rules, Term, TypographyRule


def catalogue_table(spark, markers: tuple[Marker, ...]) -> DataFrame:
    """The marker catalogue as rows, for reports."""
    return spark.createDataFrame(
        [(m.id, m.name, m.action, m.pattern, m.fix) for m in markers],
        "id string, name string, action string, pattern string, fix string",
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _occurs(text: Column, pattern: str, needed: dict[str, str]) -> Column:
    """Whether a pattern occurs in the text; one that needs a string is looked for behind it."""
    if pattern not in needed:
        return text.rlike(pattern)
    return text.contains(needed[pattern]) & text.rlike(pattern)


def line_hits(text: Column, lines: Column, patterns: list[str], needed: dict[str, str] = {}) -> Column:
    """``array<struct<rule, line, hit>>``: every match of every pattern.

    Lines are searched only for the patterns that occur in the text at all; ``needed`` has, for
    some patterns, a string that every match holds.
    Rules are referred to by position, so the expression stays small.
    """

    def one(i: int, pattern: str) -> Column:
        per_line = F.transform(
            lines,
            lambda x, n: F.transform(
                F.regexp_extract_all(x, F.lit(pattern), F.lit(0)),
                lambda hit: F.struct(
                    F.lit(i).alias("rule"), (n + 1).alias("line"), hit.alias("hit")
                ),
            ),
        )
        return F.when(_occurs(text, pattern, needed), F.flatten(per_line)).otherwise(
            F.array().cast("array<struct<rule:int,line:int,hit:string>>")
        )

    return F.concat(*[one(i, p) for i, p in enumerate(patterns)])


def hit_count(text: Column, lines: Column, patterns: list[str], needed: dict[str, str] = {}) -> Column:
    """How many hits :func:`line_hits` finds; a match never runs over a line break."""

    def one(pattern: str) -> Column:
        per_line = F.aggregate(lines, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(pattern)))
        return F.when(_occurs(text, pattern, needed), per_line).otherwise(F.lit(0))

    return sum((one(p) for p in patterns), F.lit(0))


def marker_findings(text: Column, lines: Column, rules: Rules) -> Column:
    """Every template-phrase hit of every marker, in catalogue order."""
    if not rules.markers:
        return no_findings()
    levels = [action_confidence_of(m.action) for m in rules.markers]
    ids = _strings([f"markers.{m.id}" for m in rules.markers])
    actions = _strings([m.action for m in rules.markers])
    names = _strings([m.name for m in rules.markers])
    fixes = _strings([m.fix for m in rules.markers])
    severities = _strings([severity for severity, _ in levels])
    confidences = F.array(*[F.lit(confidence) for _, confidence in levels])
    return F.transform(
        line_hits(text, lines, [m.pattern for m in rules.markers], rules.language.needed),
        lambda h: finding(
            id=F.get(ids, h["rule"]),
            analyzer="markers",
            category=F.get(actions, h["rule"]),
            severity=F.get(severities, h["rule"]),
            confidence=F.get(confidences, h["rule"]),
            message=F.get(names, h["rule"]),
            evidence=h["hit"],
            suggestion=F.get(fixes, h["rule"]),
            line=h["line"],
        ),
    )


def markers(docs: DataFrame, rules: Rules) -> DataFrame:
    return flat(
        docs.withColumn("lines", T.lines(F.col("text"))),
        marker_findings(F.col("text"), F.col("lines"), rules),
    )


def term_findings(text: Column, lines: Column, rules: Rules) -> Column:
    """Occurrences of rule words; only auto_replace words carry a replacement."""
    if not rules.terms:
        return no_findings()
    replacements = [
        t.preferred if t.decision == "auto_replace" and t.preferred else "" for t in rules.terms
    ]
    ids = _strings([t.id for t in rules.terms])
    decisions = _strings([t.decision for t in rules.terms])
    messages = _strings([rules.messages["term"].format(t.subject) for t in rules.terms])
    targets = _strings(replacements)
    return F.transform(
        line_hits(text, lines, [T.term_pattern(t.subject) for t in rules.terms]),
        lambda h: finding(
            id=F.get(ids, h["rule"]),
            analyzer="terms",
            category=F.get(decisions, h["rule"]),
            severity=F.when(F.get(targets, h["rule"]) != "", "likely").otherwise("info"),
            confidence=0.8,
            message=F.get(messages, h["rule"]),
            evidence=h["hit"],
            suggestion=F.get(targets, h["rule"]),
            line=h["line"],
        ),
    )


def term_hits(docs: DataFrame, rules: Rules) -> DataFrame:
    return flat(
        docs.withColumn("lines", T.lines(F.col("text"))),
        term_findings(F.col("text"), F.col("lines"), rules),
    )


def _counted(text: Column, patterns: list[str]) -> Column:
    """``array<struct<rule, n, first>>`` of the patterns that occur in the text."""
    counted = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                F.regexp_count(text, F.lit(p)).alias("n"),
                F.regexp_substr(text, F.lit(p)).alias("first"),
            )
            for i, p in enumerate(patterns)
        ]
    )
    return F.filter(counted, lambda c: c["n"] > 0)


def typography_findings(text: Column, rules: Rules) -> Column:
    """One finding per unwanted typographic variant, with its count."""
    unwanted = [r for r in rules.typography if not r.wanted]
    if not unwanted:
        return no_findings()
    ids = _strings([f"typography.{r.rule}" for r in unwanted])
    messages = _strings([rules.messages["typography"].format(r.variant) for r in unwanted])
    return F.transform(
        _counted(text, [r.pattern for r in unwanted]),
        lambda c: finding(
            id=F.get(ids, c["rule"]),
            analyzer="typography",
            category="typography",
            severity="likely",
            confidence=0.8,
            message=F.get(messages, c["rule"]),
            evidence=c["first"],
            meta=F.create_map(F.lit("count"), c["n"]),
        ),
    )


def typography_hits(docs: DataFrame, rules: Rules) -> DataFrame:
    return flat(docs, typography_findings(F.col("text"), rules))


def _template(message: str, *parts: Column) -> Column:
    """Fill the ``{}`` of a message with columns."""
    pieces = message.split("{}")
    out = [F.lit(pieces[0])]
    for part, tail in zip(parts, pieces[1:], strict=True):
        out += [part.cast("string"), F.lit(tail)]
    return F.concat(*out)


def artifact_findings(text: Column, rules: Rules) -> Column:
    """One review signal per kind of extraction residue, with its count."""
    if not rules.artifacts:
        return no_findings()
    labels = _strings([label for label, _ in rules.artifacts])
    return F.transform(
        _counted(text, [pattern for _, pattern in rules.artifacts]),
        lambda c: finding(
            id="corpus.extraction-artifact",
            analyzer="corpus",
            category="data",
            severity="review",
            message=_template(rules.messages["artifact"], F.get(labels, c["rule"]), c["n"]),
            evidence=F.get(labels, c["rule"]),
            meta=F.create_map(F.lit("count"), c["n"]),
        ),
    )


def extraction_artifacts(docs: DataFrame, rules: Rules) -> DataFrame:
    return flat(docs, artifact_findings(F.col("text"), rules))


def _long_counts(docs: DataFrame, labelled: list[tuple[tuple[str, ...], str]], names) -> DataFrame:
    """Corpus totals of many patterns: one narrow sum per pattern, then rows.

    The aggregate has a single row of partial sums per task, so its shuffle
    does not grow with the corpus.
    """
    sums = docs.agg(
        *[
            F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).alias(f"c{i}")
            for i, (_, p) in enumerate(labelled)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(k) for k, v in zip(names, label, strict=True)],
                F.col(f"c{i}").alias("n"),
            )
            for i, (label, _) in enumerate(labelled)
        ]
    )
    return sums.select(F.inline(rows))


def variant_counts(docs: DataFrame, terms: tuple[Term, ...]) -> DataFrame:
    """Corpus frequency of each rule word and of its rivals: (id, role, word, n)."""
    labelled = []
    for t in terms:
        roles = {
            "slang": t.slang,
            "word": t.word,
            "preferred": t.preferred,
            "alternative": t.alternative,
            "rejected": t.rejected_replacement,
        }
        for role, word in roles.items():
            if word:
                labelled.append(((t.id, role, word), T.term_pattern(word)))
    return _long_counts(docs, labelled, ("id", "role", "word"))


def typography_counts(docs: DataFrame, rules: tuple[TypographyRule, ...]) -> DataFrame:
    """Corpus frequency of every typographic variant: (rule, variant, n)."""
    return _long_counts(
        docs, [((r.rule, r.variant), r.pattern) for r in rules], ("rule", "variant")
    )
