"""Agreement of a text with itself: spellings, advice, announced counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions import text as T
from prosemetrics.functions.arrays import let, runs_by_key
from prosemetrics.functions.findings import finding, flat, no_findings
from prosemetrics.operators.markers import _template
from prosemetrics.operators.names import _strip_marks, name_words
from prosemetrics.packs.base import LanguagePack, Rules
from prosemetrics.session import sized_broadcast


def prose(text: Column, language: LanguagePack) -> Column:
    """The text whose spelling the author chose.

    Headings and quotations are masked; the first word of a sentence is
    replaced by a comma, since its capital is set by the language.
    """
    masked = T.mask_protected(text, language.heading_words, (), language.heading_opening)
    return F.regexp_replace(
        masked, r"(?U)(^|[.!?…]\s+)[^\p{L}\p{N}.!?…]*[\p{L}\p{N}][\p{L}\p{N}\-'’ʼ]*", "$1,"
    )


def spelling_groups(prose_text: Column, language: LanguagePack) -> Column:
    """``array<struct<key, forms: array<struct<form, n>>>>`` with two forms or more.

    Words agree when they differ only in hyphens; inflected forms of one
    spelling are the same form.  A text without hyphens has no groups and is not
    split into words at all.
    """

    def pair(w: Column) -> Column:
        return F.struct(
            T.stem(F.replace(w, F.lit("-"), F.lit("")), language.inflection).alias("key"),
            T.stem(w, language.inflection).alias("form"),
        )

    grouped = F.filter(
        runs_by_key(F.transform(T.tokens(prose_text), pair)),
        lambda g: F.size(g["forms"]) > 1,
    )
    return F.when(prose_text.contains("-"), grouped).otherwise(
        F.array().cast("array<struct<key:string,forms:array<struct<form:string,n:int>>>>")
    )


def case_groups(prose_text: Column, language: LanguagePack) -> Column:
    """Two-word names written with different capitals.

    Only pairs opened by a capital letter count: a single capital word or a
    sentence opening proves nothing.
    """
    words = name_words(prose_text)

    def pairs(w: Column) -> Column:
        both = F.transform(
            w,
            lambda x, i: F.when(
                x.rlike(r"^\p{Lu}\p{Ll}") & F.get(w, i + 1).rlike(r"^\p{L}\p{Ll}"),
                F.struct(
                    F.concat_ws(
                        " ",
                        T.stem(x, language.inflection),
                        T.stem(F.get(w, i + 1), language.inflection),
                    ).alias("key"),
                    F.concat_ws(
                        " ",
                        F.regexp_replace(x, language.inflection, ""),
                        F.regexp_replace(F.get(w, i + 1), language.inflection, ""),
                    ).alias("form"),
                ),
            ),
        )
        return F.filter(both, lambda p: p.isNotNull())

    return F.filter(
        runs_by_key(let(words, pairs)), lambda g: F.size(g["forms"]) > 1
    )


def variant_findings(
    text: Column,
    rules: Rules,
    strict: Column | bool = False,
    min_count: int = 2,
) -> Column:
    """One finding per word written in several ways.

    Normally some spelling must occur ``min_count`` times; strict mode also
    shows the weak cases, so it never shows less.
    """
    strict = strict if isinstance(strict, Column) else F.lit(strict)
    groups = let(
        prose(text, rules.language),
        lambda p: F.concat(spelling_groups(p, rules.language), case_groups(p, rules.language)),
    )
    shown = F.filter(groups, lambda g: strict | (F.get(g["forms"], F.lit(0))["n"] >= min_count))
    return F.coalesce(
        F.transform(
            shown,
            lambda g: finding(
                id="consistency.variants",
                analyzer="consistency",
                category="spelling",
                severity="likely",
                confidence=0.85,
                message=_template(rules.messages["variants"], g["key"]),
                evidence=F.array_join(
                    F.transform(
                        F.slice(g["forms"], 1, 4),
                        lambda f: F.concat(f["form"], F.lit(" ×"), f["n"].cast("string")),
                    ),
                    ", ",
                ),
                suggestion=rules.messages["variants_fix"],
            ),
        ),
        no_findings(),
    )


def spelling_variants(docs: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    return flat(docs, variant_findings(F.col("text"), rules, strict))


def _sequences(words: Column, lengths: list[int]) -> Column:
    """The distinct word sequences of the given lengths, joined by spaces."""

    def begin(x: Column, i: Column) -> Column:
        return F.array(
            *[
                F.when(F.size(words) >= i + n, F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
                for n in lengths
            ]
        )

    return F.array_distinct(F.array_compact(F.flatten(F.transform(words, begin))))


def advice_rows(docs: DataFrame, names: DataFrame, language: LanguagePack) -> DataFrame:
    """(doc_id, official, kept, discarded, first keep clause) per multi-word name.

    Advice belongs to the name in its own clause.  Only clauses that carry a
    stance are looked at, and names are compared by inflection stems.
    """

    def stems(words: Column) -> Column:
        return F.transform(
            words, lambda w: F.when(w.isin(".", ","), w).otherwise(T.stem(w, language.inflection))
        )

    dictionary = (
        names.select("official", stems(_strip_marks(name_words(F.col("official")))).alias("_w"))
        .where(F.size("_w") >= 2)
        .select("official", F.array_join("_w", " ").alias("_key"), F.size("_w").alias("_arity"))
        .distinct()
    )
    lengths = sorted(r[0] for r in dictionary.select("_arity").distinct().collect()) or [2]
    # only sentences with a stance are cut into clauses, and only clauses with
    # a stance become rows
    numbered = F.filter(
        F.transform(
            T.sentences(F.col("text")),
            lambda s, i: F.struct((i + 1).alias("sentence_no"), s.alias("sentence")),
        ),
        lambda x: x["sentence"].rlike(language.keep_stance)
        | x["sentence"].rlike(language.discard_stance),
    )
    clauses = F.flatten(
        F.transform(
            numbered,
            lambda x: F.transform(
                T.segments(x["sentence"], list(language.adversatives)),
                lambda p, j: F.struct(
                    x["sentence_no"].alias("sentence_no"),
                    (j + 1).alias("segment_no"),
                    p.alias("segment"),
                    p.rlike(language.keep_stance).alias("keep"),
                    p.rlike(language.discard_stance).alias("drop"),
                ),
            ),
        )
    )
    stance = docs.select(
        "doc_id", F.explode(F.filter(clauses, lambda c: c["keep"] | c["drop"])).alias("c")
    ).select("doc_id", "c.*")
    mentions = (
        stance
        .withColumn("_s", stems(name_words(F.col("segment"))))
        .select(
            "doc_id",
            "sentence_no",
            "segment_no",
            "segment",
            "keep",
            "drop",
            F.explode(_sequences(F.col("_s"), lengths)).alias("_key"),
        )
        .join(sized_broadcast(dictionary.drop("_arity")), "_key")
    )
    return mentions.groupBy("doc_id", "official").agg(
        F.bool_or("keep").alias("kept"),
        F.bool_or("drop").alias("discarded"),
        F.min(F.when(F.col("keep"), F.struct("sentence_no", "segment_no", "segment")))[
            "segment"
        ].alias("keep_clause"),
    )


def advice_conflicts(docs: DataFrame, names: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, finding): names advised both to keep and to discard."""
    return (
        advice_rows(docs, names, rules.language)
        .where(F.col("kept") & F.col("discarded"))
        .select(
            "doc_id",
            finding(
                id="consistency.advice",
                analyzer="consistency",
                category="advice",
                severity="review",
                confidence=0.4,
                message=_template(rules.messages["advice"], F.col("official")),
                evidence=T.evidence_trim(F.col("keep_clause")),
                suggestion=rules.messages["advice_fix"],
            ).alias("finding"),
        )
    )


def declared_count_findings(lines: Column, rules: Rules) -> Column:
    """Announced number of items against the list that follows the announcement.

    A list is the unbroken run of item lines right after the announcing line;
    an announcement without a list says nothing.
    """
    lang = rules.language
    if not lang.announced_count:
        return no_findings()
    breaks = F.filter(
        F.transform(lines, lambda x, i: F.when(~x.rlike(lang.list_item), i)),
        lambda i: i.isNotNull(),
    )

    def compare(b: Column) -> Column:
        checked = F.transform(
            b,
            lambda at, j: F.struct(
                F.try_to_number(
                    F.nullif(
                        F.regexp_extract(F.get(lines, at), lang.announced_count, 1), F.lit("")
                    ),
                    F.lit("999999999"),
                )
                .cast("int")
                .alias("announced"),
                (F.coalesce(F.get(b, j + 1), F.size(lines)) - at - 1).alias("listed"),
                (at + 1).alias("line"),
            ),
        )
        wrong = F.filter(
            checked,
            lambda c: c["announced"].isNotNull()
            & (c["listed"] > 0)
            & (c["listed"] != c["announced"]),
        )
        return F.transform(
            wrong,
            lambda c: finding(
                id="consistency.declared-count",
                analyzer="consistency",
                category="numbers",
                severity="review",
                confidence=0.5,
                message=_template(rules.messages["declared_count"], c["announced"], c["listed"]),
                line=c["line"],
            ),
        )

    return F.coalesce(let(breaks, compare), no_findings())


def declared_counts(docs: DataFrame, rules: Rules) -> DataFrame:
    with_lines = docs.withColumn("lines", T.lines(F.col("text")))
    return flat(with_lines, declared_count_findings(F.col("lines"), rules))
