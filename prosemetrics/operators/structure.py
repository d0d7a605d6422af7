"""Profiles, headings and sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions.numbers import rounded
from prosemetrics.functions.arrays import let
from prosemetrics.functions.findings import finding, flat, no_findings
from prosemetrics.functions.units import with_units
from prosemetrics.operators.markers import _template
from prosemetrics.packs.base import Rules

SECTION = "struct<id:string,title:string,variants:array<string>,required:boolean,corpus_share:int>"


def profile_table(spark, rules: Rules) -> DataFrame:
    """One row per profile with its sections, flags and weights."""
    rows = [
        (
            p.id,
            p.title,
            p.min_words,
            p.require_entities,
            [
                (s.id, s.title, [v.lower() for v in s.variants] or [s.title.lower()],
                 s.required, s.corpus_share)
                for s in p.sections
            ],
            {k: bool(v) for k, v in p.analyzers.items()},
            dict(p.weights),
        )
        for p in rules.profiles.values()
    ]
    return spark.createDataFrame(
        rows,
        "profile string, profile_title string, min_words int, require_entities boolean, "
        f"sections array<{SECTION}>, analyzers map<string,boolean>, weights map<string,double>",
    )


def profile_sections(spark, rules: Rules) -> DataFrame:
    """One row per heading spelling: (profile, section_id, title, required, variant)."""
    return (
        profile_table(spark, rules)
        .select("profile", F.explode("sections").alias("s"))
        .select(
            "profile",
            F.col("s.id").alias("section_id"),
            F.col("s.title").alias("title"),
            F.col("s.required").alias("required"),
            F.col("s.corpus_share").alias("corpus_share"),
            F.explode("s.variants").alias("variant"),
        )
    )


def detected(text: Column, rules: Rules) -> Column:
    """``struct<profile, confidence>`` guessed from the hint patterns.

    Ties go to the profile declared first; without hits, the default and 0.
    """
    scores = F.array(
        *[
            F.struct(
                sum(
                    (F.regexp_count(text, F.lit(f"(?iuU){p}")) for p in patterns), F.lit(0)
                ).alias("hits"),
                F.lit(-i).alias("priority"),
                F.lit(profile).alias("profile"),
            )
            for i, (profile, patterns) in enumerate(rules.hints.items())
        ]
    )

    def pick(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0), lambda a, x: a + x["hits"])
        best = F.array_max(s)
        return F.struct(
            F.when(best["hits"] > 0, best["profile"])
            .otherwise(rules.default_profile)
            .alias("profile"),
            F.when(best["hits"] > 0, rounded(best["hits"] / total, 2))
            .otherwise(0.0)
            .alias("confidence"),
        )

    return let(scores, pick)


def detect_profile(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, profile, confidence)."""
    return docs.select("doc_id", detected(F.col("text"), rules).alias("d")).select(
        "doc_id", "d.*"
    )


def with_profile(docs: DataFrame, rules: Rules, explicit: str | None = None) -> DataFrame:
    """Attach each document's profile row: the explicit choice, else the guess.

    ``explicit`` names a column holding a profile id or null.  The profile
    table is a fixed handful of rows, so it is broadcast.
    """
    guess = detected(F.col("text"), rules)
    if explicit:
        docs = docs.withColumn(
            "_guess", F.when(F.col(explicit).isNull(), guess)
        ).withColumn("profile", F.coalesce(F.col(explicit), F.col("_guess.profile")))
    else:
        docs = docs.withColumn("_guess", guess).withColumn("profile", F.col("_guess.profile"))
    return (
        docs.withColumn("profile_confidence", F.col("_guess.confidence"))
        .drop("_guess")
        .join(F.broadcast(profile_table(docs.sparkSession, rules)), "profile", "left")
    )


def with_game_profile(docs: DataFrame, rules: Rules, explicit: str | None = None) -> DataFrame:
    """Attach the profile for a game: the explicit one, else the game's first."""
    spark = docs.sparkSession
    firsts = spark.createDataFrame(
        [(g.id, g.profiles[0] if g.profiles else rules.default_profile)
         for g in rules.games.values()],
        "game string, _first string",
    )
    chosen = F.coalesce(F.col(explicit), F.col("_first")) if explicit else F.col("_first")
    return (
        docs.join(F.broadcast(firsts), "game", "left")
        .withColumn("profile", chosen)
        .drop("_first")
        .join(F.broadcast(profile_table(spark, rules)), "profile", "left")
    )


def _titles(headings: Column) -> Column:
    return F.transform(headings, lambda h: F.lower(h["title"]))


def missing_section_findings(
    headings: Column, sections: Column, rules: Rules, shares: bool = True
) -> Column:
    """Required sections none of whose spellings is a heading of the document.

    ``shares`` adds how often the corpus has the section.
    """
    absent = F.filter(
        sections,
        lambda s: s["required"] & ~F.arrays_overlap(s["variants"], _titles(headings)),
    )
    return F.coalesce(
        F.transform(
            absent,
            lambda s: finding(
                id=F.concat(F.lit("structure.missing."), s["id"]),
                analyzer="structure",
                category="structure",
                severity="likely",
                confidence=0.7,
                message=_template(rules.messages["missing_section"], s["title"]),
                suggestion=F.array_join(F.slice(s["variants"], 1, 3), "; "),
                meta=F.create_map(F.lit("corpus_share"), s["corpus_share"]) if shares else None,
            ),
        ),
        no_findings(),
    )


def missing_sections(docs: DataFrame, rules: Rules) -> DataFrame:
    """``docs`` carry text and sections (see with_profile)."""
    units = with_units(docs, rules.language)
    return flat(
        units, missing_section_findings(F.col("headings"), F.col("sections"), rules)
    )


def section_positions(headings: Column, sections: Column) -> Column:
    """``array<struct<line, index, id, title>>``: known headings in text order."""
    return F.filter(
        F.flatten(
            F.transform(
                headings,
                lambda h: F.transform(
                    F.filter(
                        F.transform(
                            sections,
                            lambda s, i: F.struct(
                                i.alias("index"),
                                s["id"].alias("id"),
                                s["title"].alias("title"),
                                s["variants"].alias("variants"),
                            ),
                        ),
                        lambda s: F.array_contains(s["variants"], F.lower(h["title"])),
                    ),
                    lambda s: F.struct(
                        h["line"].alias("line"),
                        s["index"].alias("index"),
                        s["id"].alias("id"),
                        s["title"].alias("title"),
                    ),
                ),
            )
        ),
        lambda s: s["line"].isNotNull(),
    )


def section_order_findings(headings: Column, sections: Column, rules: Rules) -> Column:
    """A section heading that comes right after one the profile puts later."""

    def misplaced(p: Column) -> Column:
        marked = F.transform(
            p,
            lambda s, i: F.when(
                (i > 0) & (F.get(p, F.greatest(i - 1, F.lit(0)))["index"] > s["index"]),
                finding(
                    id=F.concat(F.lit("structure.order."), s["id"]),
                    analyzer="structure",
                    category="structure",
                    severity="review",
                    confidence=0.5,
                    message=_template(rules.messages["section_order"], s["title"]),
                    line=s["line"],
                ),
            ),
        )
        return F.filter(marked, lambda f: f.isNotNull())

    return F.coalesce(let(section_positions(headings, sections), misplaced), no_findings())


def section_order(docs: DataFrame, rules: Rules) -> DataFrame:
    units = with_units(docs, rules.language)
    return flat(units, section_order_findings(F.col("headings"), F.col("sections"), rules))


def section_bodies(lines: Column, headings: Column, sections: Column) -> Column:
    """``array<struct<id, line, body>>``: text from a known heading to the next."""
    return let(
        section_positions(headings, sections),
        lambda p: F.transform(
            p,
            lambda s, i: F.struct(
                s["id"].alias("id"),
                s["line"].alias("line"),
                F.array_join(
                    F.slice(
                        lines,
                        s["line"] + 1,
                        F.coalesce(F.get(p, i + 1)["line"], F.size(lines) + 1)
                        - s["line"]
                        - 1,
                    ),
                    "\n",
                ).alias("body"),
            ),
        ),
    )


def section_body_rows(docs: DataFrame, rules: Rules) -> DataFrame:
    units = with_units(docs, rules.language)
    return units.select(
        "doc_id",
        F.explode(
            section_bodies(F.col("lines"), F.col("headings"), F.col("sections"))
        ).alias("b"),
    ).select("doc_id", "b.*")


def entities_seen(text: Column, rules: Rules) -> Column:
    """Listed entities mentioned in the text; the longest name wins.

    Names are tried longest first at each place, so a compound name is not
    also counted as its shorter part.  Separators are doubled beforehand, so
    neighbouring names do not compete for the space between them.
    """
    lang = rules.language
    by_length = sorted(lang.entities, key=lambda e: (-len(e), e))

    def form(entity: str) -> str:
        first, *rest = entity.split(" ")
        stem = first
        if lang.entity_endings and first[-1:] in "ьй":
            stem = first[:-1]
        tail = "".join(r"\s+" + re.escape(w) for w in rest)
        return re.escape(stem) + lang.entity_endings + tail

    spaced = F.concat(
        F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", "  "), F.lit(" ")
    )
    alternation = "|".join(form(e) for e in by_length)
    found = F.array_distinct(
        F.regexp_extract_all(spaced, F.lit(rf"(?iu) ({alternation}) "), F.lit(1))
    )

    def which(hit: Column) -> Column:
        out = None
        for e in by_length:
            test = hit.rlike(rf"(?iu)^(?:{form(e)})$")
            out = F.when(test, e) if out is None else out.when(test, e)
        return out

    return F.array_distinct(F.transform(found, which))


def coverage_findings(
    lines: Column, headings: Column, sections: Column, required: Column, rules: Rules
) -> Column:
    """Entities the coverage section does not mention; silent without the section."""
    lang = rules.language
    bodies = F.filter(
        section_bodies(lines, headings, sections), lambda b: b["id"] == lang.entity_section
    )

    def check(b: Column) -> Column:
        whole = F.array_join(F.transform(b, lambda x: x["body"]), "\n")
        missing = F.array_except(
            F.array(*[F.lit(e) for e in lang.entities]), entities_seen(whole, rules)
        )
        return let(
            missing,
            lambda m: F.when(
                (F.size(b) > 0) & (F.size(m) > 0),
                F.array(
                    finding(
                        id="structure.matchups",
                        analyzer="structure",
                        category="coverage",
                        severity="review",
                        confidence=0.8,
                        message=_template(rules.messages["coverage"], F.size(m)),
                        evidence=F.array_join(m, ", "),
                    )
                ),
            ).otherwise(no_findings()),
        )

    if not lang.entities:
        return no_findings()
    return F.when(required, F.coalesce(let(bodies, check), no_findings())).otherwise(
        no_findings()
    )


def entity_coverage(docs: DataFrame, rules: Rules) -> DataFrame:
    units = with_units(docs, rules.language)
    return flat(
        units,
        coverage_findings(
            F.col("lines"),
            F.col("headings"),
            F.col("sections"),
            F.col("require_entities"),
            rules,
        ),
    )


def section_presence(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, profile, section_id, required, present) for every profile section."""
    units = with_units(docs, rules.language)
    return units.select(
        "doc_id",
        "profile",
        F.explode(
            F.transform(
                "sections",
                lambda s: F.struct(
                    s["id"].alias("section_id"),
                    s["required"].alias("required"),
                    F.arrays_overlap(s["variants"], _titles(F.col("headings"))).alias("present"),
                ),
            )
        ).alias("s"),
    ).select("doc_id", "profile", "s.*")


def section_share(docs: DataFrame, rules: Rules) -> DataFrame:
    """Percent of a profile's documents that have each section."""
    return (
        section_presence(docs, rules)
        .groupBy("profile", "section_id")
        .agg(
            F.count("*").alias("documents"),
            F.sum(F.col("present").cast("int")).alias("present"),
        )
        .withColumn("share_pct", F.col("present") * 100.0 / F.col("documents"))
    )


def heading_variant_share(docs: DataFrame, rules: Rules) -> DataFrame:
    """How often each spelling of a section heading is used."""
    units = with_units(docs, rules.language)
    used = units.select(
        "profile",
        "sections",
        F.explode(F.array_distinct(_titles(F.col("headings")))).alias("variant"),
    )
    return (
        used.select(
            "profile",
            "variant",
            F.explode(
                F.filter("sections", lambda s: F.array_contains(s["variants"], F.col("variant")))
            ).alias("s"),
        )
        .groupBy("profile", F.col("s.id").alias("section_id"), "variant")
        .agg(F.count("*").alias("documents"))
    )


def skipped_analyzers(analyzers: Column, names: tuple[str, ...]) -> Column:
    """Analyzers the profile switches off, in the given order."""
    return F.filter(
        F.array(*[F.lit(n) for n in names]),
        lambda n: ~F.coalesce(F.try_element_at(analyzers, n), F.lit(True)),
    )
