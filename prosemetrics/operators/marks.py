"""Which rows of a large table may have a key of another one: marks of bounded size for a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A block has a word of 64 bits for each of a key's marks.
WORDS = 8
# Bits for each key while there are not more blocks than MOST_BLOCKS (32 MB of bits).
BITS_PER_KEY = 16
MOST_BLOCKS = 1 << 19


def _block(key: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.hash(*key), F.lit(blocks)).cast("long")


def _places(key: Sequence[str]) -> list[Column]:
    """The place of a key's mark in each word of its block, from 6 bits of its hash each."""
    hashed = F.xxhash64(*key)
    return [F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(63).cast("int") for i in range(WORDS)]


def probable(rows: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key is in ``table``, and a few in a thousand of the others.

    A key of the table marks a bit in each word of one block, so the marks are combined by a plain
    aggregate and broadcast; their size has a bound, whatever the table.  Beyond it more of the others
    stay, so a join must follow.  ``table`` is read twice.
    """
    blocks = min(MOST_BLOCKS, table.count() * BITS_PER_KEY // (64 * WORDS) + 1)
    one = F.lit(1).cast("long")
    marks = table.groupBy(_block(key, blocks).alias("_block")).agg(
        *[F.bit_or(F.call_function("shiftleft", one, at)).alias(f"_m{i}") for i, at in enumerate(_places(key))]
    )
    is_set = F.lit(True)
    for i, at in enumerate(_places(key)):
        is_set = is_set & (F.call_function("shiftrightunsigned", F.col(f"_m{i}"), at).bitwiseAND(1) == 1)
    return (
        rows.withColumn("_block", _block(key, blocks))
        .join(F.broadcast(marks), "_block")
        .where(is_set)
        .select(*rows.columns)
    )
