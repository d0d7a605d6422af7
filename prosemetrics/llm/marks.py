"""Which rows of a large table may be among some of its rows: a bitmap of bounded size for a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.shared import free_name

# Bits of the map, and of one of its rows (fixed by Spark's bitmap functions).
MARKS, BUCKET = 1 << 24, 1 << 15


def _at(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(MARKS))


def row_marks(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``bucket, bits``: a bitmap of ``MARKS`` bits with a mark at each row's hashed key."""
    at = _at(key)
    return rows.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(BUCKET - 1)).alias("bits"))


def marked_rows(rows: DataFrame, marks: DataFrame, key: Sequence[str], wanted: bool = True) -> DataFrame:
    """The rows whose mark is set: all that made the bitmap, and a few more; or else the others.

    The bitmap has at most ``MARKS / BUCKET`` rows of 4 kB, whatever the table, so it is broadcast.
    """
    bucket, bit, bits = (free_name(rows.columns, c) for c in ("bucket", "bit", "bits"))
    at = _at(key)
    found = rows.withColumns({bucket: F.shiftright(at, 15), bit: at.bitwiseAND(BUCKET - 1)})
    found = found.join(F.broadcast(marks.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))), bucket, "left")
    byte = F.expr(f"conv(hex(substring({bits}, cast(shiftright({bit}, 3) + 1 as int), 1)), 16, 10)").cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} & 7 as int))")) > 0, F.lit(False))
    return found.filter(is_set if wanted else ~is_set).select(*rows.columns)
