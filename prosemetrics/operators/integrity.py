"""Corpus integrity: metadata, identifiers, statistics and the calibration split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from prosemetrics.functions.findings import finding, flat, one_if
from prosemetrics.functions.text import word_count
from prosemetrics.operators.markers import _template, artifact_findings
from prosemetrics.packs.base import Rules
from prosemetrics.session import cut_lineage, sized_broadcast, stored

# The metadata contract of a corpus document.
REQUIRED_FIELDS = (
    "id",
    "title",
    "published_at",
    "updated_at",
    "game_mode",
    "genre",
    "patch",
    "source_url",
    "extraction_source",
    "clean_status",
)
GAME_MODES = ("standard", "wild", "battlegrounds", "arena", "duels", "unknown")
CLEAN_STATUSES = ("raw", "cleaned", "reviewed", "unknown")


def _problem(kind: str, severity: str, message: Column, evidence: Column) -> Column:
    return finding(
        id=f"corpus.{kind}",
        analyzer="corpus",
        category="data",
        severity=severity,
        message=message,
        evidence=evidence,
    )


def _field(meta: Column, name: str) -> Column:
    """A metadata value; the empty string counts as absent, as null does."""
    return F.nullif(F.try_element_at(meta, F.lit(name)), F.lit(""))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def empty_document_findings(text: Column, path: Column, rules: Rules) -> Column:
    return one_if(
        is_blank(text),
        _problem("empty-file", "error", F.lit(rules.messages["empty_document"]), path),
    )


def missing_field_findings(meta: Column, path: Column, rules: Rules) -> Column:
    absent = F.array_except(F.array(*[F.lit(f) for f in REQUIRED_FIELDS]), F.map_keys(meta))
    return F.transform(
        absent,
        lambda name: _problem(
            "missing-field", "likely", _template(rules.messages["missing_field"], name), path
        ),
    )


def unknown_genre_findings(meta: Column, path: Column, rules: Rules) -> Column:
    known = sorted(rules.profiles)
    genre = _field(meta, "genre")
    return one_if(
        genre.isNotNull() & ~genre.isin(*known),
        _problem(
            "unknown-genre",
            "error",
            _template(rules.messages["unknown_genre"], genre, F.lit(", ".join(known))),
            path,
        ),
    )


def unknown_domain_findings(
    meta: Column,
    path: Column,
    rules: Rules,
    modes: tuple[str, ...] = GAME_MODES,
    statuses: tuple[str, ...] = CLEAN_STATUSES,
) -> Column:
    mode, status = _field(meta, "game_mode"), _field(meta, "clean_status")
    return F.concat(
        one_if(
            mode.isNotNull() & ~mode.isin(*modes),
            _problem(
                "unknown-mode", "likely", _template(rules.messages["unknown_mode"], mode), path
            ),
        ),
        one_if(
            status.isNotNull() & ~status.isin(*statuses),
            _problem(
                "unknown-status",
                "likely",
                _template(rules.messages["unknown_status"], status),
                path,
            ),
        ),
    )


def record_findings(docs: DataFrame, rules: Rules) -> DataFrame:
    """Every check that needs only one document: (path, finding columns).

    A blank document gets its one error and no further checks.
    """
    text, path, meta = F.col("text"), F.col("path"), F.col("meta")
    rest = F.concat(
        missing_field_findings(meta, path, rules),
        unknown_genre_findings(meta, path, rules),
        unknown_domain_findings(meta, path, rules),
        artifact_findings(text, rules),
    )
    found = F.when(is_blank(text), empty_document_findings(text, path, rules)).otherwise(rest)
    return flat(docs, found, "path")


def duplicate_ids(docs: DataFrame, rules: Rules) -> DataFrame:
    """(path, id, previous): every repeat names the holder just before it.

    Blank documents register nothing.  One id may be shared by any number of
    documents, so holders are not put into one window by id: paths are sorted
    across the cluster, neighbours are compared inside partitions, and the
    first row of a partition takes the last row of the one before.
    """
    holders = docs.where(~is_blank(F.col("text"))).select(
        _field(F.col("meta"), "id").alias("id"), "path"
    ).where(F.col("id").isNotNull())
    # Only ids held more than once take part in the sort.
    repeated = holders.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    repeated = stored(repeated, "repeated-ids")  # measured for the broadcast and joined
    sorted_rows = holders.join(sized_broadcast(repeated), "id", "left_semi")
    chained = previous_in_order(sorted_rows, "id", "path")
    before, middle, after = rules.messages["duplicate_id"].split("{}")
    return (
        chained.where(F.col("previous").isNotNull())
        .select("path", "id", "previous")
        .withColumn(
            "message",
            F.concat(F.lit(before), "id", F.lit(middle), "previous", F.lit(after)),
        )
    )


def previous_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``lag(order) over (partition by key order by order)`` without a task per key.

    Rows are range-partitioned by (key, order), so a hot key spans several
    partitions.  The placement is checkpointed: range bounds are sampled and
    a recomputation could draw others.
    """
    placed = cut_lineage(
        rows.select(key, order)
        .repartitionByRange(key, order)
        .withColumn("_part", F.spark_partition_id())
    )
    within = Window.partitionBy("_part").orderBy(key, order)
    local = (
        placed.withColumn("_key_before", F.lag(key).over(within))
        .withColumn("_order_before", F.lag(order).over(within))
        .withColumn(
            "previous", F.when(F.col("_key_before") == F.col(key), F.col("_order_before"))
        )
    )
    # One row per partition: its last key and order value, handed to the next one.
    ends = placed.groupBy("_part").agg(F.max(F.struct(key, order)).alias("_end"))
    chain = ends.select(
        F.lead("_part").over(Window.orderBy("_part")).alias("_part"),
        F.col(f"_end.{key}").alias("_end_key"),
        F.col(f"_end.{order}").alias("_end_order"),
    ).where(F.col("_part").isNotNull())
    return (
        local.join(F.broadcast(chain), "_part", "left")
        .withColumn(
            "previous",
            F.when(
                F.col("_key_before").isNull() & (F.col("_end_key") == F.col(key)),
                F.col("_end_order"),
            ).otherwise(F.col("previous")),
        )
        .select(key, order, "previous")
    )


def duplicate_findings(docs: DataFrame, rules: Rules) -> DataFrame:
    return duplicate_ids(docs, rules).select(
        "path", _problem("duplicate-id", "error", F.col("message"), F.col("path")).alias("f")
    ).select("path", "f.*")


def empty_corpus_findings(docs: DataFrame, rules: Rules) -> DataFrame:
    """One error when there is no document at all."""
    n = docs.agg(F.count("*").alias("n")).where("n = 0")
    return n.select(
        F.lit("").alias("path"),
        _problem("empty-corpus", "error", F.lit(rules.messages["empty_corpus"]), F.lit("")).alias(
            "f"
        ),
    ).select("path", "f.*")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents, words and unknown values: by genre, by mode and in total.

    One pass with grouping sets; ``level`` says which grouping a row is.
    """
    per_doc = docs.select(
        F.coalesce(F.try_element_at("meta", F.lit("genre")), F.lit("—")).alias("genre"),
        F.coalesce(F.try_element_at("meta", F.lit("game_mode")), F.lit("—")).alias("mode"),
        word_count(F.col("text")).alias("words"),
        F.size(
            F.filter(
                F.array(*[F.lit(f) for f in REQUIRED_FIELDS]),
                lambda f: F.coalesce(
                    F.try_element_at("meta", f) == "unknown", F.lit(False)
                ),
            )
        ).alias("unknown"),
    )
    return (
        per_doc.groupingSets([["genre"], ["mode"], []], "genre", "mode")
        .agg(
            F.when(F.grouping("genre") == 0, "genre")
            .when(F.grouping("mode") == 0, "mode")
            .otherwise("all")
            .alias("level"),
            F.count("*").alias("documents"),
            F.sum("words").alias("words"),
            F.sum("unknown").alias("unknown_values"),
        )
        .select(
            "level",
            F.coalesce("genre", "mode", F.lit("")).alias("value"),
            "documents",
            "words",
            "unknown_values",
        )
    )


def split_corpus(ids: DataFrame, share: float = 0.2) -> DataFrame:
    """(id, part): deterministic calibration / holdout split of column ``id``.

    Ids in sorted order, every ``step``-th one is holdout.  Repeats of an id
    count as positions but stay on one side.  The global position is a running
    sum inside each range partition plus the total of the partitions before
    it, so no task sees the whole corpus.
    """
    step = max(2, int(1 / share)) if share else 0
    counted = ids.groupBy("id").agg(F.count("*").alias("n"))
    if not step:
        return counted.select("id", F.lit("calibration").alias("part"))
    placed = cut_lineage(
        counted.repartitionByRange("id").withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part").agg(F.sum("n").alias("_n"))
    # one row per partition: bounded by the partition count, not by the data
    offsets = totals.select(
        "_part",
        (
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            )
        ).alias("_offset"),
    )
    running = Window.partitionBy("_part").orderBy("id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = placed.join(F.broadcast(offsets), "_part").select(
        "id",
        "n",
        (F.col("_offset") + F.sum("n").over(running) - F.col("n")).alias("_first"),
    )
    # positions first .. first+n-1 hold a multiple of step
    last = F.col("_first") + F.col("n") - 1
    hit = F.expr(f"(_first % {step} = 0)") | (
        F.floor(last / F.lit(step)) > F.floor(F.col("_first") / F.lit(step))
    )
    return ranked.select(
        "id", F.when(hit, "holdout").otherwise("calibration").alias("part")
    )


