"""Rule tables resolved per game and profile, and conflicts inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.operators.measures import norms_table
from prosemetrics.operators.structure import profile_table
from prosemetrics.packs.base import Rules, Term, TypographyRule


def terms_table(spark, terms: tuple[Term, ...]) -> DataFrame:
    rows = [
        (
            t.id,
            t.decision,
            t.slang,
            t.word,
            t.subject,
            t.preferred,
            t.alternative,
            t.rejected_replacement,
            dict(t.corpus),
            t.note,
        )
        for t in terms
    ]
    return spark.createDataFrame(
        rows,
        "id string, decision string, slang string, word string, subject string, "
        "preferred string, alternative string, rejected_replacement string, "
        "corpus map<string,bigint>, note string",
    )


def typography_table(
    spark, typography: tuple[TypographyRule, ...], decisions: dict[str, str]
) -> DataFrame:
    """(rule, variant, count, decision); rules without counts have one row."""
    rows = [(r.rule, r.variant, r.count, decisions.get(r.rule)) for r in typography]
    known = {r.rule for r in typography}
    rows += [(rule, None, None, d) for rule, d in decisions.items() if rule not in known]
    return spark.createDataFrame(
        rows, "rule string, variant string, count bigint, decision string"
    )


def games_table(spark, rules: Rules) -> DataFrame:
    rows = [
        (
            g.id,
            g.has_names,
            g.names_kind,
            g.names_note or None,
            list(g.protected),
            list(g.profiles),
        )
        for g in rules.games.values()
    ]
    return spark.createDataFrame(
        rows,
        "game string, has_names boolean, names_kind string, names_note string, "
        "protected array<string>, profiles array<string>",
    ).join(norms_table(spark, rules), "game")


def resolved_rules(spark, rules: Rules) -> DataFrame:
    """One row per (game, profile): what an editor of such a text must follow."""
    replace = [(t.subject, t.preferred) for t in rules.terms
               if t.decision == "auto_replace" and t.preferred]
    keep = [t.subject for t in rules.terms if t.decision == "allowed"]
    pairs = F.array(
        *[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in replace]
    ).cast("array<struct<from:string,to:string>>")
    by_profile = profile_table(spark, rules).select(
        "profile",
        F.transform(
            F.filter("sections", lambda s: s["required"]), lambda s: s["title"]
        ).alias("sections_required"),
    )
    return (
        games_table(spark, rules)
        .withColumn("profile", F.explode("profiles"))
        .join(F.broadcast(by_profile), "profile")
        .select(
            "game",
            "profile",
            "protected",
            pairs.alias("replace"),
            F.array(*[F.lit(k) for k in keep]).cast("array<string>").alias("keep"),
            F.create_map(
                *[F.lit(x) for kv in rules.typography_decisions.items() for x in kv]
            ).alias("typography")
            if rules.typography_decisions
            else F.lit(None).cast("map<string,string>").alias("typography"),
            "sections_required",
            "norm_rhythm_ratio",
            "norm_voice_per_1k",
            "provisional",
        )
    )


def documents_with_rules(docs: DataFrame, rules: Rules) -> DataFrame:
    """Attach the resolved rule row by (game, profile); the table is a few rows."""
    return docs.join(
        F.broadcast(resolved_rules(docs.sparkSession, rules)), ["game", "profile"], "left"
    )


def rule_conflicts(
    terms: DataFrame, typography: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """(problem, subject, detail): contradictions in the rule tables.

    ``counts(id, role, n)`` are frequencies measured on a corpus; without them
    the counts stored with the rules are used.
    """
    none = F.lit(None).cast("string")
    duplicate = (
        terms.groupBy("id")
        .agg(F.count("*").alias("_n"))
        .where("_n > 1")
        .select(
            F.lit("duplicate-id").alias("problem"),
            F.col("id").alias("subject"),
            F.col("_n").cast("string").alias("detail"),
        )
    )
    contradictory = (
        terms.groupBy(F.lower("subject").alias("subject"))
        .agg(
            F.array_sort(F.collect_set("decision")).alias("_decisions"),
        )
        .where(F.size("_decisions") > 1)
        .select(
            F.lit("contradictory-decisions").alias("problem"),
            "subject",
            F.array_join("_decisions", ", ").alias("detail"),
        )
    )
    shape = terms.select(
        F.when(
            (F.col("decision") == "auto_replace") & F.col("preferred").isNull(),
            "replacement-missing",
        )
        .when(
            (F.col("decision") == "allowed") & F.col("preferred").isNotNull(),
            "replacement-unexpected",
        )
        .alias("problem"),
        F.col("id").alias("subject"),
        none.alias("detail"),
    ).where(F.col("problem").isNotNull())
    if counts is None:
        measured = terms.select(
            "id",
            F.try_element_at("corpus", F.lit("slang")).alias("_slang"),
            F.try_element_at("corpus", F.lit("preferred")).alias("_preferred"),
        )
    else:
        measured = counts.groupBy("id").agg(
            F.max(F.when(F.col("role").isin("slang", "word"), F.col("n"))).alias("_slang"),
            F.max(F.when(F.col("role") == "preferred", F.col("n"))).alias("_preferred"),
        )
    rarer = (
        terms.where(F.col("decision") == "auto_replace")
        .join(F.broadcast(measured), "id")
        .where(F.col("_slang") > F.col("_preferred"))
        .select(
            F.lit("replacement-rarer").alias("problem"),
            F.col("id").alias("subject"),
            F.concat_ws(" > ", F.col("_slang"), F.col("_preferred")).alias("detail"),
        )
    )
    # An absent decision is outside every domain, so it must not turn the test into null.
    decision = F.coalesce("decision", F.lit(""))
    bad_domain = F.when(
        (F.col("rule") == "yo") & ~decision.isin("remove", "keep", "as_written"), "unknown-decision"
    ).when(
        (F.col("rule") == "quotes") & ~decision.isin("straight", "guillemets", "as_written"),
        "unknown-decision",
    ).when(
        (F.col("rule") == "archetype_hyphen") & (decision == "space") & (F.col("count") > 0),
        "hyphen-in-use",
    )
    domains = typography.select(
        bad_domain.alias("problem"),
        F.concat(F.lit("typography."), "rule").alias("subject"),
        F.col("decision").alias("detail"),
    ).where(F.col("problem").isNotNull()).distinct()
    hyphen = typography.agg(
        F.max(F.when((F.col("rule") == "range") & (decision == "hyphen"), 1)).alias("_range"),
        F.max(
            F.when((F.col("rule") == "keep_hyphen_in") & decision.contains("матч-ап"), 1)
        ).alias("_kept"),
    ).where(F.col("_range").isNotNull() & F.col("_kept").isNull()).select(
        F.lit("hyphen-not-kept").alias("problem"),
        F.lit("typography.dashes").alias("subject"),
        none.alias("detail"),
    )
    return (
        duplicate.unionByName(contradictory)
        .unionByName(shape)
        .unionByName(rarer)
        .unionByName(domains)
        .unionByName(hyphen)
    )
