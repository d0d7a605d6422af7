"""Per-document score inputs, scores, and the corpus regression over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions.units import with_units
from prosemetrics.operators import consistency, measures, structure
from prosemetrics.operators.markers import hit_count
from prosemetrics.operators.reporting import regression
from prosemetrics.packs.base import Rules

# Corpus thresholds of the regression.
LIMITS = {
    "markers_per_10k": 20.0,
    "voice_per_1k": 20.0,
    "structure_pct": 90.0,
    "variants_per_doc": 1.0,
}


def score_inputs(
    profiled: DataFrame, rules: Rules, name_errors: DataFrame | None = None
) -> DataFrame:
    """One narrow pass over documents with their profile attached.

    ``name_errors(doc_id, n)`` come from the dictionary checks; without them
    no errors are assumed.
    """
    lang = rules.language
    norms = rules.games[rules.default_game].norms
    units = with_units(profiled, lang)
    sections = F.filter("sections", lambda s: s["required"])
    titles = structure._titles(F.col("headings"))
    bodies = F.filter(
        structure.section_bodies(F.col("lines"), F.col("headings"), F.col("sections")),
        lambda b: b["id"] == lang.entity_section,
    )
    covered = F.array_join(F.transform(bodies, lambda b: b["body"]), "\n")
    rows = units.select(
        "doc_id",
        "profile",
        "weights",
        "words",
        measures.rhythm(F.col("sentence_words")).alias("rhythm"),
        measures.voice(
            F.col("text"), F.col("sentences"), F.col("sentence_words"), F.col("words"), lang
        ).alias("voice"),
        hit_count(F.col("text"), F.col("lines"), [m.pattern for m in rules.markers], lang.needed).alias("markers"),
        F.size(
            F.filter(sections, lambda s: F.arrays_overlap(s["variants"], titles))
        ).alias("sections_found"),
        F.size(sections).alias("required"),
        F.when(
            F.col("require_entities"), F.size(structure.entities_seen(covered, rules))
        ).otherwise(0).alias("entities"),
        F.when(F.col("require_entities"), len(lang.entities)).otherwise(0).alias("entity_total"),
        F.size(consistency.variant_findings(F.col("text"), rules)).alias("variants"),
    )
    if name_errors is not None:
        per_doc = name_errors.groupBy("doc_id").agg(F.sum("n").alias("name_errors"))
        rows = rows.join(per_doc, "doc_id", "left").fillna(0, subset=["name_errors"])
    else:
        rows = rows.withColumn("name_errors", F.lit(0))
    return rows.withColumns(
        {
            "voice_per_1k": measures.voice_total(F.col("voice")),
            "voice_n": measures.voice_n(F.col("voice")),
            "rhythm_ratio": F.col("rhythm.ratio"),
            "marker_per_1k": F.try_divide(
                F.col("markers") * 1000.0, F.col("words").cast("double")
            ),
            "voice_norm": F.lit(norms.get("voice_per_1k")).cast("double"),
            "rhythm_norm": F.lit(norms.get("rhythm_ratio")).cast("double"),
        }
    )


def scores(
    profiled: DataFrame, rules: Rules, name_errors: DataFrame | None = None, **slopes
) -> DataFrame:
    return measures.author_score(
        score_inputs(profiled, rules, name_errors), rules.language, **slopes
    )


def corpus_regression(
    profiled: DataFrame, rules: Rules, limits: dict[str, float] | None = None
) -> DataFrame:
    """Rules must stay silent on published texts: corpus rates against limits.

    The structure of a document counts as recognised when at least half of
    its required sections are found.
    """
    rows = score_inputs(profiled, rules).withColumn(
        "structured", F.col("sections_found") * 2 >= F.col("required")
    )
    return regression(rows, limits or LIMITS)
