"""Summaries, gates and audits over findings tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemetrics.functions.findings import (
    SCHEMA_VERSION,
    SEVERITIES,
    compact_json,
    severity_rank,
)
from prosemetrics.session import sized_broadcast, stored


def severity_summary(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts at all four levels for every document, zeros included."""
    counted = findings.groupBy(key).pivot("severity", list(SEVERITIES)).count()
    return docs.select(key).join(counted, key, "left").fillna(0, subset=list(SEVERITIES))


def summary_of(findings: Column) -> Column:
    """The same counts from a findings array, inside the row."""

    def count(severity: str) -> Column:
        return F.size(F.filter(findings, lambda f: f["severity"] == severity))

    return F.map_from_arrays(
        F.array(*[F.lit(s) for s in SEVERITIES]),
        F.array(*[count(s) for s in SEVERITIES]),
    )


def worst_severity(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Gravest level per document; null without findings."""
    worst = findings.groupBy(key).agg(
        F.min_by("severity", severity_rank(F.col("severity"))).alias("worst")
    )
    return docs.select(key).join(worst, key, "left")


def worst_of(findings: Column) -> Column:
    return F.array_min(
        F.transform(
            findings,
            lambda f: F.struct(
                severity_rank(f["severity"]).alias("rank"), f["severity"].alias("severity")
            ),
        )
    )["severity"]


def quality_gates(
    findings: DataFrame, docs: DataFrame, levels: tuple[str, ...] = ("error",), key: str = "doc_id"
) -> DataFrame:
    """(key, fail_on, exit_code) for each of ``levels``: 1 when any finding is at or above it.

    A document's gravest rank answers for all levels, so findings are grouped once.
    """
    if unknown := set(levels) - set(SEVERITIES):
        raise ValueError(f"levels must be of {SEVERITIES}, not {sorted(unknown)}")
    worst = findings.groupBy(F.col(key).alias("_key")).agg(F.min(severity_rank(F.col("severity"))).alias("_worst"))
    joined = docs.select(key).join(worst, F.col(key).eqNullSafe(F.col("_key")), "left")
    code = [
        F.struct(
            F.lit(level).alias("fail_on"),
            F.coalesce(F.col("_worst") <= SEVERITIES.index(level), F.lit(False)).cast("int").alias("exit_code"),
        )
        for level in levels
    ]
    return joined.select(key, F.inline(F.array(*code)))


def quality_gate(
    findings: DataFrame, docs: DataFrame, fail_on: str = "error", key: str = "doc_id"
) -> DataFrame:
    """(key, exit_code): 1 when any finding is at or above the threshold.

    The default fails on errors only, so editorial signals never fail a run.
    """
    return quality_gates(findings, docs, (fail_on,), key).drop("fail_on")


def order_findings(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of a document in report order, with their position.

    Sorting is per document, never global.
    """
    w = Window.partitionBy(key).orderBy(
        severity_rank(F.col("severity")), F.coalesce("line", F.lit(0)), "id", "evidence"
    )
    return findings.withColumn("position", F.row_number().over(w))


def report_json(reports: DataFrame, document: str = "doc_id") -> DataFrame:
    """(doc_id, report): one versioned JSON report per document, stable keys."""
    summary = F.struct(
        *[F.try_element_at("summary", F.lit(s)).alias(s) for s in SEVERITIES]
    )
    parts = [
        F.concat(F.lit('{"schema_version":"'), F.lit(SCHEMA_VERSION), F.lit('","document":')),
        F.to_json(F.array(F.col(document).cast("string"))),
        F.lit(',"profile":'),
        F.to_json(F.array("profile")),
        F.lit(',"summary":'),
        F.to_json(summary),
        F.lit(',"metrics":'),
        # the word count is whole, though the metrics map holds doubles
        F.regexp_replace(F.to_json("metrics"), r'"words":(\d+)\.0', '"words":$1'),
        F.lit(',"findings":['),
        F.array_join(F.transform("findings", compact_json), ","),
        F.lit('],"analyzers_skipped":'),
        F.to_json("analyzers_skipped"),
        F.lit(',"notes":'),
        F.to_json("notes"),
        F.lit("}"),
    ]
    # to_json renders scalars only inside a container; drop its brackets
    for i in (1, 3):
        parts[i] = F.regexp_replace(parts[i], r"^\[|\]$", "")
    return reports.select(document, F.concat(*parts).alias("report"))


def archive_audit(hits: DataFrame) -> DataFrame:
    """Corpus-wide table of findings: kind, then each ``was -> official`` pair.

    ``hits`` has kind, was, official, n and from_artifact.  Hits caused by
    extraction are listed apart and have no kind total.  Rows without a pair
    are kind totals with the number of different pairs.
    """
    pairs = hits.groupBy("kind", "from_artifact", "was", "official").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, "audit-pairs")  # listed and totalled: the corpus is searched once
    totals = (
        pairs.where(~F.col("from_artifact"))
        .groupBy("kind", "from_artifact")
        .agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))
    )
    return pairs.withColumn("pairs", F.lit(None).cast("long")).unionByName(
        totals.withColumn("was", F.lit(None).cast("string")).withColumn(
            "official", F.lit(None).cast("string")
        )
    )


def regression(per_doc: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Corpus thresholds: (check, value, threshold, ok).

    ``per_doc`` has words, markers, voice_n, structured (boolean), variants.
    """
    total = per_doc.agg(
        F.count("*").alias("documents"),
        F.sum("words").alias("words"),
        F.sum("markers").alias("markers"),
        F.sum("voice_n").alias("voice"),
        F.sum(F.col("structured").cast("int")).alias("structured"),
        F.sum("variants").alias("variants"),
    )
    words = F.col("words").cast("double")
    docs = F.col("documents").cast("double")
    checks = {
        "markers_per_10k": (F.try_divide(F.col("markers") * 10000.0, words), "max"),
        "voice_per_1k": (F.try_divide(F.col("voice") * 1000.0, words), "min"),
        "structure_pct": (F.try_divide(F.col("structured") * 100.0, docs), "min"),
        "variants_per_doc": (F.try_divide(F.col("variants").cast("double"), docs), "max"),
    }
    rows = []
    for name, (value, side) in checks.items():
        limit = F.lit(float(limits[name]))
        ok = value <= limit if side == "max" else value >= limit
        rows.append(
            F.struct(
                F.lit(name).alias("check"),
                value.alias("value"),
                limit.alias("threshold"),
                ok.alias("ok"),
            )
        )
    return total.select(F.inline(F.array(*rows)))


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order; both zeros are one value, not-a-number is the greatest."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(2**63 - 1))


def _value_of(bits: Column) -> Column:
    plain = bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(2**63 - 1))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), plain).cast("double")


# Bits that one pass over the values decides.
PASS_BITS = 16


def percentiles(values: DataFrame, column: str, points: list[float], *group: str) -> DataFrame:
    """Exact percentiles of a measure: (*group, n, minimum, p..), interpolated between neighbours.

    Nothing is sorted and no group is collected.  The values' ordered bits are counted by their
    first 16; the bucket that holds a wanted rank is known from the counts, and the next pass counts
    only that bucket's values, by their next 16 bits.  After four passes the bits of the wanted values are
    whole.  A pass shuffles at most 65536 counts for each group, rank and task.

    Nulls are left out, and a group without values gives no row; a group key may be null.
    """
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    g = [f"_g{i}" for i in range(len(group))]
    slim = values.select(*keys, F.col(column).cast("double").alias("_v"))
    bits = F.when(F.col("_v").isNotNull(), ordered_bits(F.col("_v")))
    slim = stored(slim.select(*g, "_v", bits.alias("_bits")), "percentiles")
    # A filter before the store would be pushed below the measure's steps, and work all of them out once more.
    slim = slim.where(F.col("_v").isNotNull())
    sizes = slim.groupBy(*g).agg(F.count("*").alias("n"), F.min("_bits").alias("_least")).where("n > 0")
    sizes = stored(sizes, "percentile-sizes")

    def same(left: DataFrame, right: DataFrame, *more: str) -> Column:
        out = F.lit(True)
        for c in (*g, *more):
            out = out & left[c].eqNullSafe(right[c])
        return out

    def ranks(point: float) -> Column:
        exact = (F.col("n") - 1) * F.lit(float(point))
        return F.array(F.floor(exact), F.ceil(exact))

    wanted = F.array_distinct(F.concat(*[ranks(p) for p in points]))
    targets = sizes.select(*g, F.explode(wanted).alias("_rank")).select("*", F.col("_rank").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for shift in range(64 - PASS_BITS, -1, -PASS_BITS):
        # Values that share the decided bits with a target, counted by the next ones.
        decided = shift + PASS_BITS
        rows = slim.withColumn("_prefix", F.shiftright("_bits", decided) if decided < 64 else F.lit(0).cast("long"))
        rows = rows.withColumn("_next", F.shiftright("_bits", shift))
        buckets = targets.select(*g, "_prefix").distinct()
        rows = rows.join(sized_broadcast(buckets), same(rows, buckets, "_prefix"), "left_semi")
        counts = rows.groupBy(*g, "_prefix", "_next").agg(F.count("*").alias("_n"))
        upto = Window.partitionBy(*g, "_prefix").orderBy("_next")
        counts = counts.withColumn("_upto", F.sum("_n").over(upto))
        hit = same(targets, counts, "_prefix") & (targets["_left"] < counts["_upto"]) & (targets["_left"] >= counts["_upto"] - counts["_n"])
        found = targets.join(counts, hit).select(
            *[targets[c] for c in (*g, "_rank")],
            (targets["_left"] - counts["_upto"] + counts["_n"]).alias("_left"),
            counts["_next"].alias("_prefix"),
        )
        targets = stored(found, "percentile-targets")
    values_at = targets.select(*g, "_rank", _value_of(F.col("_prefix")).alias("_value"))
    known = values_at.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))

    def percentile(point: float) -> Column:
        exact = (F.col("n") - 1) * F.lit(float(point))
        low, share = F.floor(exact), exact - F.floor(exact)
        return F.element_at("_at", low) * (F.lit(1.0) - share) + F.element_at("_at", F.ceil(exact)) * share

    joined = sizes.join(known, same(sizes, known))
    return joined.select(
        *[sizes[c].alias(name) for c, name in zip(g, group)],
        "n",
        _value_of(F.col("_least")).alias("minimum"),
        *[percentile(p).alias(f"p{round(p * 100)}") for p in points],
    )


def calibration(scores: DataFrame, column: str = "score") -> DataFrame:
    """Median, quartiles and minimum of the scores."""
    return percentiles(scores, column, [0.25, 0.5, 0.75])


def fit_norms(metrics: DataFrame, *group: str) -> DataFrame:
    """Norms from measured documents: medians of every signal and of rhythm.

    ``metrics`` has rhythm and voice structs (see measures.measure).  Signals
    are stacked into rows, so the same passes serve all of them.
    """
    from prosemetrics.operators.measures import voice_total
    from prosemetrics.packs.base import SIGNALS

    stacked = metrics.select(
        *group,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("measure"), F.col(f"voice.{s}.per1k").alias("value")
                    )
                    for s in SIGNALS
                ],
                F.struct(
                    F.lit("voice_per_1k").alias("measure"),
                    voice_total(F.col("voice")).alias("value"),
                ),
                F.struct(
                    F.lit("rhythm_ratio").alias("measure"), F.col("rhythm.ratio").alias("value")
                ),
                F.struct(
                    F.lit("sentence_mean").alias("measure"), F.col("rhythm.mean").alias("value")
                ),
            )
        ),
    )
    return percentiles(stacked, "value", [0.5], *group, "measure")


def impact_report(pairs: DataFrame) -> DataFrame:
    """What an edit changed, side by side; needs the columns of gate.measured."""
    from prosemetrics.functions.text import length_change_pct, touched_tokens_pct
    from prosemetrics.operators.measures import voice_total

    return pairs.select(
        "pair_id",
        touched_tokens_pct(F.col("b_tokens"), F.col("a_tokens")).alias("touched_pct"),
        length_change_pct(F.col("before"), F.col("after")).alias("length_change_pct"),
        F.col("b_markers").alias("markers_before"),
        F.col("a_markers").alias("markers_after"),
        F.col("b_rhythm.ratio").alias("rhythm_before"),
        F.col("a_rhythm.ratio").alias("rhythm_after"),
        voice_total(F.col("b_voice")).alias("voice_before"),
        voice_total(F.col("a_voice")).alias("voice_after"),
    )
