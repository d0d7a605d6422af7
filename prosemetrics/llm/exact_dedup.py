"""Exact duplicates of a document stream by keyed state on disk.  Column functions only.

1. A stateless stream turns each arriving row into its narrow record: the digest of its normalised
   text, its id and its *locator* (file and place in it).  The text goes no further.
2. A stateful stream holds one entry for each digest, without expiry: the least id with its locator,
   and how many rows had the digest.  Spark keeps it in RocksDB stores that spill to disk, one for
   each shuffle partition, with change logs in the shared checkpoint folder; rows of one digest are
   summed up in every task before the shuffle, so a digest held by a third of all rows is no burden.
3. Every later hit is checked: the full bytes of its text against those of the entry's text, which
   its locator finds.  Only duplicated texts are read and moved for that.  Rows that share a digest
   and not the bytes are grouped by their bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemetrics.llm.marks import marked_rows, row_marks
from prosemetrics.llm.shared import stored
from prosemetrics.session import shared_folder

# Memory of all stores of an executor together; entries beyond it are on disk.
STATE_MB = 256
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # Many small stores: no disk is taken before it is needed, and a store leaves memory with its task.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
LOCATOR = ("file", "row")
PREFERRED = ("no_id", "id", *LOCATOR)


def normalised(text: Column) -> Column:
    """The text with every run of white space (space, U+0009 to U+000D) as one space; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def text_stream(spark: SparkSession, path: str, schema, mb_per_trigger: int = 16384) -> DataFrame:
    """Parquet files below ``path`` as they arrive (a glob may name a single file)."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", mb_per_trigger << 20).parquet(path)


def records(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``digest, no_id, id, file, row`` of rows that are read from Parquet files."""
    return docs.select(
        digest(normalised(F.col(text_col))).alias("digest"),
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def entries(narrow: DataFrame) -> DataFrame:
    """``digest, first, rows``: what the state holds for a digest (on a stream: as it changes)."""
    return narrow.groupBy("digest").agg(F.min(F.struct(*PREFERRED)).alias("first"), F.count(F.lit(1)).alias("rows"))


def run_streams(stream: DataFrame, folder: str, id_col: str, text_col: str, digest=sha256, narrow_mb: int = 1024) -> None:
    """Take in what has arrived since the last run with this ``folder``, and end.

    ``folder`` keeps both streams' progress, the narrow records and the changed entries of every
    batch.  A batch that is run again replaces its own entries.
    """
    spark = stream.sparkSession

    def finish(writer, name: str) -> None:
        writer.option("checkpointLocation", f"{folder}/progress-{name}").trigger(availableNow=True).start().awaitTermination()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/entries/batch={batch_id}")

    narrow = records(stream, id_col, text_col, digest)
    finish(narrow.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/records"), "records")
    again = text_stream(spark, f"{folder}/records", narrow.schema, narrow_mb)
    with _settings(spark, STATE):
        finish(entries(again).writeStream.outputMode("update").foreachBatch(write), "entries")


def state(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
    """``digest, first, rows`` as the state stands: an entry's id only falls and its count only grows."""
    first = f"first struct<no_id: boolean, id: {id_type}, file: string, row: bigint>"
    empty = spark.createDataFrame([], f"digest binary, {first}, rows bigint")
    empty.write.mode("overwrite").parquet(f"{folder}/entries/batch=-1")
    rows = spark.read.schema(f"digest binary, {first}, rows bigint").parquet(f"{folder}/entries")
    return rows.groupBy("digest").agg(F.min("first").alias("first"), F.max("rows").alias("rows"))


def outcomes(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` of all rows that the streams have taken in.

    ``docs`` is the table that was streamed, as a batch; only the texts of hits are kept from it.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    narrow = spark.read.schema(f"digest binary, no_id boolean, id {id_type}, file string, row bigint").parquet(f"{folder}/records")
    marked = stored(narrow.join(stored(state(spark, folder, id_type), "dedup-state"), "digest"), "dedup-rows")
    holder = F.struct(*LOCATOR) == F.struct("first.file", "first.row")
    out = [F.col("first.id").alias("keep_id"), F.col("rows").alias("group_size"), holder.alias("kept"), "digest"]

    # Full bytes of the hits against those of their entries.
    hits = marked.filter("rows > 1").select("digest", *LOCATOR, holder.alias("holds"))
    places = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(text_col).alias("text"))
    texts = marked_rows(places, row_marks(hits, LOCATOR), LOCATOR).join(hits.hint("shuffle_hash"), [*LOCATOR])
    texts = stored(texts.select("digest", *LOCATOR, "holds", normalised(F.col("text")).alias("text")), "dedup-hits")
    held_texts = texts.filter("holds").select("digest", F.col("text").alias("held_text"))
    differ = texts.filter("not holds").join(held_texts, "digest").filter("text <> held_text").select("digest", *LOCATOR, "text")
    differ = stored(differ, "dedup-collisions")
    if differ.isEmpty():
        return marked.select("id", *out)

    lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    same = marked.join(differ.select(*LOCATOR), [*LOCATOR], "left_anti").join(lost, "digest", "left")
    same = same.withColumn("rows", F.col("rows") - F.coalesce("lost", F.lit(0)))
    others = differ.join(marked.select("id", "no_id", *LOCATOR), [*LOCATOR])
    others = others.join(others.groupBy("digest", "text").agg(F.min(F.struct(*PREFERRED)).alias("first"), F.count(F.lit(1)).alias("rows")), ["digest", "text"])
    return same.select("id", *out).unionByName(others.select("id", *out))


def exact_duplicates(
    docs: DataFrame, stream: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for every row of a table of Parquet
    files, given as a batch and as a stream of the same files.

    Texts are equal when they are identical after each run of white space is made one space.  Of
    equal texts the row with the smallest id stays.

    Defined cases: a null text is an empty one; a null id comes after all others, and of rows with
    equal ids (or without any) the first by file and place stays, so that one row of each group does;
    other columns are not read; a table without rows gives none.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/dedup-{uuid.uuid4().hex}"
    run_streams(stream, folder, id_col, text_col, digest)
    return outcomes(docs, folder, id_col, text_col, digest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
