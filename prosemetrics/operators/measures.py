"""Rhythm, voice, norms, alarms, similarity score and addressable hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions import text as T
from prosemetrics.functions.arrays import let
from prosemetrics.functions.units import with_units
from prosemetrics.packs.base import NORMS, SIGNALS, LanguagePack, Rules


def rhythm(sentence_words: Column, min_sentences: int = 2) -> Column:
    """``struct<ratio, mean>`` of sentence lengths; null when too small.

    ratio is population deviation over mean.  Both come from two integer sums,
    so the value does not depend on the order of addition.
    """
    sums = F.struct(
        F.size(sentence_words).cast("long").alias("n"),
        F.aggregate(sentence_words, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"),
        F.aggregate(sentence_words, F.lit(0).cast("long"), lambda a, x: a + x * x).alias("q"),
    )
    return let(
        sums,
        lambda z: F.when(
            (z["n"] >= min_sentences) & (z["s"] > 0),
            F.struct(
                (F.sqrt((z["n"] * z["q"] - z["s"] * z["s"]).cast("double")) / z["s"]).alias(
                    "ratio"
                ),
                (z["s"] / z["n"]).alias("mean"),
            ),
        ),
    )


def voice_counts(
    text: Column, sentences: Column, sentence_words: Column, language: LanguagePack
) -> dict[str, Column]:
    if language.imperative_end:
        imperative = F.regexp_count(text, F.lit(language.imperative_end))
    elif language.imperative_stop:
        imperative = F.size(
            F.filter(
                F.regexp_extract_all(text, F.lit(language.imperative), F.lit(0)),
                lambda w: ~F.lower(w).isin(*language.imperative_stop),
            )
        )
    else:
        imperative = F.regexp_count(text, F.lit(language.imperative))
    bare = T.lacks(text, language.needed.get(language.parenthesis, ""))
    opening = F.size(F.filter(sentences, lambda s: s.rlike(language.concession_opening)))
    return {
        "address": F.regexp_count(text, F.lit(language.address)),
        "imperative": imperative,
        "concession": opening + F.regexp_count(text, F.lit(language.concession_inside)),
        "short_sentence": F.size(
            F.filter(sentence_words, lambda n: (n > 1) & (n < language.short_sentence))
        ),
        "parenthesis": F.when(bare, 0).otherwise(F.regexp_count(text, F.lit(language.parenthesis))),
    }


def voice(
    text: Column, sentences: Column, sentence_words: Column, words: Column, language: LanguagePack
) -> Column:
    """Struct of the five signals, each ``struct<n, per1k>``; null without words."""
    counts = voice_counts(text, sentences, sentence_words, language)
    # each count feeds two fields: evaluate the patterns once, in an array
    return F.when(
        words > 0,
        let(
            F.array(*counts.values()),
            lambda c: F.struct(
                *[
                    F.struct(
                        F.get(c, F.lit(i)).alias("n"),
                        F.try_divide(
                            F.get(c, F.lit(i)) * 1000.0, words.cast("double")
                        ).alias("per1k"),
                    ).alias(name)
                    for i, name in enumerate(counts)
                ]
            ),
        ),
    )


def voice_total(v: Column) -> Column:
    """Signals per 1000 words, summed over the five."""
    total = v[SIGNALS[0]]["per1k"]
    for name in SIGNALS[1:]:
        total = total + v[name]["per1k"]
    return total


def voice_n(v: Column) -> Column:
    total = v[SIGNALS[0]]["n"]
    for name in SIGNALS[1:]:
        total = total + v[name]["n"]
    return total


def measure(docs: DataFrame, language: LanguagePack) -> DataFrame:
    """Document metrics in one narrow pass; the text is not carried further."""
    keep = [c for c in docs.columns if c != "text"]
    units = with_units(docs, language)
    return units.select(
        *keep,
        "words",
        F.size("sentences").alias("sentence_count"),
        rhythm(F.col("sentence_words")).alias("rhythm"),
        voice(
            F.col("text"),
            F.col("sentences"),
            F.col("sentence_words"),
            F.col("words"),
            language,
        ).alias("voice"),
    )


def marker_density(docs_words: DataFrame, hits: DataFrame, *group: str) -> DataFrame:
    """Marker hits per 10 000 words.

    ``docs_words(doc_id, words, *group)``, ``hits(doc_id, ...)``.  Hits are
    counted per document before they meet the documents.
    """
    per_doc = hits.groupBy("doc_id").agg(F.count("*").alias("_hits"))
    return (
        docs_words.join(per_doc, "doc_id", "left")
        .groupBy(*group)
        .agg(
            F.sum(F.coalesce("_hits", F.lit(0))).alias("hits"),
            F.sum("words").alias("words"),
        )
        .withColumn("per_10k", F.try_divide(F.col("hits") * 10000.0, F.col("words").cast("double")))
    )


def norms_table(spark, rules: Rules) -> DataFrame:
    """One row per game with nullable norms."""
    schema = (
        "game string, norms_source string, provisional boolean, "
        + ", ".join(f"norm_{f} double" for f in NORMS)
    )
    rows = [
        (g.id, g.norms_source, g.provisional, *[g.norms.get(f) for f in NORMS])
        for g in rules.games.values()
    ]
    return spark.createDataFrame(rows, schema)


def norm_caveat(rules: Rules, source: Column, provisional: Column) -> Column:
    """Wording for borrowed norms; null when the norms are the corpus's own."""
    before, after = rules.messages["norm_caveat"].split("{}")
    return F.when(provisional, F.concat(F.lit(before), source, F.lit(after)))


def norm_compare(metrics: DataFrame, rules: Rules) -> DataFrame:
    """Each metric beside its norm.  ``metrics`` has game, rhythm and voice."""
    norms = F.broadcast(norms_table(metrics.sparkSession, rules))
    return metrics.join(norms, "game", "left").withColumn(
        "caveat", norm_caveat(rules, F.col("norms_source"), F.col("provisional"))
    )


def alarms(compared: DataFrame) -> DataFrame:
    """Documents whose rhythm or voice is under the alarm line of their game."""
    return (
        compared.withColumn("rhythm_ratio", F.col("rhythm.ratio"))
        .withColumn("voice_per_1k", voice_total(F.col("voice")))
        .withColumn("rhythm_alarm", F.col("rhythm_ratio") < F.col("norm_rhythm_alarm"))
        .withColumn("voice_alarm", F.col("voice_per_1k") < F.col("norm_voice_low"))
        .where(F.col("rhythm_alarm") | F.col("voice_alarm"))
    )


def _clamped(value: Column) -> Column:
    """Cut to [0, 10]; a missing value stays missing."""
    return F.when(value.isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(0.0), value)))


def score_components(
    voice_per_1k: Column,
    voice_norm: Column,
    rhythm_ratio: Column,
    rhythm_norm: Column,
    sections: Column,
    required: Column,
    entities: Column,
    entity_total: Column,
    marker_per_1k: Column,
    name_errors: Column,
    variants: Column,
    voice_floor: float = 5.0,
    rhythm_floor: float = 0.2,
    purity_slope: float = 1.0,
    name_slope: float = 1.0,
    variant_slope: float = 1.0,
) -> dict[str, Column]:
    """Six components, each 0 to 10.  Likeness to the corpus, not quality.

    The slopes of purity, names and consistency are parameters: points lost
    per marker in 1000 words, per wrong name, per mixed spelling.
    """
    share = F.when(required > 0, sections / required).otherwise(1.0)
    covered = F.when(entity_total > 0, entities / entity_total).otherwise(1.0)
    return {
        "voice": _clamped(10.0 * (voice_per_1k - voice_floor) / (voice_norm - voice_floor)),
        "rhythm": _clamped(10.0 * (rhythm_ratio - rhythm_floor) / (rhythm_norm - rhythm_floor)),
        "purity": _clamped(10.0 - purity_slope * marker_per_1k),
        "names": _clamped(10.0 - name_slope * name_errors),
        "consistency": _clamped(10.0 - variant_slope * variants),
        "structure": _clamped(10.0 * (0.7 * share + 0.3 * covered)),
    }


def author_score(rows: DataFrame, language: LanguagePack, **slopes) -> DataFrame:
    """Weighted 0-10 likeness score over the columns named in score_components.

    ``weights`` is the profile's map of weights.  There is no score where a
    measure or its norm is missing.
    """
    names = (
        "voice_per_1k",
        "voice_norm",
        "rhythm_ratio",
        "rhythm_norm",
        "sections_found",
        "required",
        "entities",
        "entity_total",
        "marker_per_1k",
        "name_errors",
        "variants",
    )
    parts = score_components(*[F.col(n) for n in names], **slopes)
    scored = rows.withColumns({f"score_{name}": part for name, part in parts.items()})

    def weighted(name: str) -> Column:
        label = language.score_labels.get(name, name)
        weight = F.coalesce(F.try_element_at("weights", F.lit(label)), F.lit(0.0))
        # an unweighted component may be missing without spoiling the score
        return F.when(weight > 0, weight * F.col(f"score_{name}")).otherwise(0.0)

    total = weighted("voice")
    for name in list(parts)[1:]:
        total = total + weighted(name)
    return scored.withColumn("score", total)


def tighten_hints(docs: DataFrame, language: LanguagePack) -> DataFrame:
    """Where to look: the longest sentence, the first impersonal phrase and,
    for documents that carry their profile's sections, the first required
    section that is missing.

    Every hint has an address in the text; documents without one get nulls.
    """
    # Each sentence is counted where it stands: a look into another array's expression from inside
    # the lambda would work out that whole array for every sentence.
    units = with_units(docs, language).withColumn(
        "_longest",
        F.array_max(
            F.transform(
                "sentences",
                lambda s, i: F.struct(
                    T.word_count(s).alias("words"),
                    (-i).alias("minus_no"),
                    s.alias("sentence"),
                ),
            )
        ),
    )
    with_line = units.withColumn(
        "_phrase",
        F.get(
            F.filter(
                F.transform(
                    "lines",
                    lambda x, i: F.struct(
                        (i + 1).alias("line"),
                        F.regexp_substr(x, F.lit(language.impersonal)).alias("phrase"),
                    ),
                ),
                lambda h: h["phrase"].isNotNull(),
            ),
            F.lit(0),
        ),
    )
    absent = []
    if "sections" in docs.columns:
        titles = F.transform("headings", lambda h: F.lower(h["title"]))
        missing = F.filter("sections", lambda s: s["required"] & ~F.arrays_overlap(s["variants"], titles))
        absent = [F.get(missing, F.lit(0))["title"].alias("missing_section")]
    return with_line.select(
        "doc_id",
        *absent,
        F.col("_longest.words").alias("longest_words"),
        (1 - F.col("_longest.minus_no")).alias("longest_sentence_no"),
        F.col("_longest.sentence").alias("longest_sentence"),
        F.col("_phrase.line").alias("impersonal_line"),
        F.col("_phrase.phrase").alias("impersonal_phrase"),
        F.regexp_count("text", F.lit(language.impersonal)).alias("impersonal_count"),
    )
