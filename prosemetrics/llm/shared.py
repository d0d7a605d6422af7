"""What the operators of this subpackage share: stored steps and free column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemetrics.session import release, steps_stored, stored

__all__ = ["free_name", "identified", "numbered", "release", "steps_stored", "stored"]


def identified(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """``df`` with new columns that tell its rows apart and stay the same when it is read again.

    A table as it stands in Parquet files has them already: the file and the row's place in it.
    Any other frame is stored with numbers.
    """
    file, row = free_name(df.columns, "file"), free_name(df.columns, "row_number")
    query = df._jdf.queryExecution()
    if query.analyzed().nodeName() == "LogicalRelation" and "parquet" in query.sparkPlan().toString().lower():
        return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), [file, row]
    return stored(df.withColumn(row, F.monotonically_increasing_id()), label), [row]


def numbered(df: DataFrame, by: str, name: str, label: str) -> DataFrame:
    """``df`` with the place of each row among the rows of its ``by``, from 0 and without a gap.

    Places follow no order, so none has to be made: each task sorts its rows by ``by`` and writes
    them once.  A small table (a row for each file and value) says how many rows of a value stand in
    earlier files.  However many rows share one value, no task gets them all.
    """
    file, row, shift = (free_name(df.columns, c) for c in ("file", "row", "shift"))
    kept = stored(df.sortWithinPartitions(by), label).select(
        "*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row)
    )
    runs = kept.groupBy(by, file).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(by).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")
    placed = kept.join(runs.select(by, file, before.alias(shift)), [by, file])
    return placed.withColumn(name, F.col(row) + F.col(shift)).select(*df.columns, name)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``taken`` has that name."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted
