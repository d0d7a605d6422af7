"""The audit and the edit gate over arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from prosemetrics.functions.findings import flat
from prosemetrics.operators import gate
from prosemetrics.packs.base import Rules
from prosemetrics.plans.audit import Options, audit, findings_of


def document_stream(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def findings_stream(stream: DataFrame, rules: Rules, options: Options = Options()) -> DataFrame:
    """Stateless findings of a document stream: same columns as the batch job."""
    return findings_of(audit(stream, rules, None, None, options))


def verdict_stream(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Stateless gate verdicts for a stream of edit pairs."""
    return gate.validate_edits(pairs, rules)


def severity_windows(
    stream: DataFrame,
    rules: Rules,
    window: str = "1 hour",
    lateness: str = "10 minutes",
    options: Options = Options(),
) -> DataFrame:
    """Findings per tumbling window and severity; ``stream`` also carries ``ts``.

    In update mode a window leaves the state once the watermark has passed it.
    """
    from prosemetrics.operators import markers
    from prosemetrics.functions.text import lines

    with_lines = stream.withWatermark("ts", lateness).withColumn("lines", lines(F.col("text")))
    found = flat(
        with_lines,
        markers.marker_findings(F.col("text"), F.col("lines"), rules),
        "doc_id",
        "ts",
    )
    return (
        found.groupBy(F.window("ts", window).alias("w"), "severity")
        .agg(F.count("*").alias("findings"))
        .select(F.col("w.start").alias("window_start"), "severity", "findings")
    )


def start_append(
    rows: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append a stream to a parquet folder with exactly-once file commits."""
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_summary(
    counts: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write the rows that a batch changed into a folder of their own.

    A replayed batch replaces only its own folder; ``read_summary`` gives the
    latest value of every row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_summary(counts: DataFrame, path: str, *key: str) -> DataFrame:
    """What ``start_summary`` has written: the latest row for each ``key``."""
    values = [c for c in counts.columns if c not in key]
    schema = StructType([*counts.schema.fields, StructField("batch_id", LongType())])
    rows = counts.sparkSession.read.schema(schema).parquet(path)
    latest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return rows.groupBy(*key).agg(latest).select(*[F.col(c if c in key else f"v.{c}") for c in counts.columns])


def start_audit(
    stream: DataFrame,
    rules: Rules,
    names: DataFrame,
    path: str,
    checkpoint: str,
    options: Options = Options(),
    available_now: bool = False,
) -> StreamingQuery:
    """The whole audit, dictionary checks included, per micro-batch.

    Each batch overwrites its own folder, so a replayed batch does not
    duplicate rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        findings_of(audit(batch, rules, names, None, options)).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
