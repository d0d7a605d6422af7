"""Shards by jump consistent hashing, with gapless places inside each shard.  Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.shared import numbered

# Fixed value of jump consistent hashing: the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757
MASK16, MASK32 = 2**16 - 1, 2**32 - 1
# Steps that every key gets at first; about ln(shards) + 1 are needed on average.  Keys that need
# more get as many as there are shards, which is always enough.
FIRST_STEPS = 24


def _times(half: Column, factor: int) -> Column:
    """``half * factor`` modulo 2^32, up to a multiple of it; every product stays below 2^49."""
    high = (half * (factor >> 16)).bitwiseAND(MASK16)
    return half * (factor & MASK16) + F.shiftleft(high, 16)


def _step(shards: int):
    low_factor, high_factor = MULTIPLIER & MASK32, MULTIPLIER >> 32

    def advance(state: Column, _: Column) -> Column:
        high, low = state["high"], state["low"]
        upper = low * (low_factor >> 16)
        bottom = low * (low_factor & MASK16) + F.shiftleft(upper.bitwiseAND(MASK16), 16) + F.lit(1)
        carry = F.shiftright(bottom, 32) + F.shiftright(upper, 16)
        top = (carry + _times(high, low_factor) + _times(low, high_factor)).bitwiseAND(MASK32)
        drawn = F.shiftright(top, 1).cast("double") + F.lit(1.0)
        jump = F.floor((state["jump"] + 1).cast("double") * (F.lit(float(2**31)) / drawn)).cast("long")
        moved = F.struct(
            top.alias("high"), bottom.bitwiseAND(MASK32).alias("low"), state["jump"].alias("at"), jump.alias("jump")
        )
        return F.when(state["jump"] >= shards, state).otherwise(moved)

    return advance


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of a whole number among ``shards``, and among one more.

    The key's sequence of jumps does not depend on the number of shards, which only ends it: with
    one shard more, a key stays where it is or goes to the new shard, and 1 in ``shards + 1`` goes.
    A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(MASK32).alias("low"),
        zero.alias("at"),
        zero.alias("jump"),
    )
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_STEPS))), state, _step(shards))
    if shards > FIRST_STEPS:
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, _step(shards))
        state = F.when(state["jump"] < shards, rest).otherwise(state)
    at, jump = state["at"], state["jump"]
    return at.cast("int"), F.when(jump == shards, F.lit(shards)).otherwise(at).cast("int")


def shards(docs: DataFrame, count: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row for every row.

    ``law`` is ``key``: the id and the number of shards decide, whatever the text is, so rows with
    one id stay together.  An id that is no whole number is hashed first.  ``size`` is the text's
    UTF-8 bytes and one more.  ``slot`` numbers the rows of a shard without a gap, from 0.

    Places need no order of all rows (:func:`.shared.numbered`); the text is read once.

    Defined cases: a null text counts as empty (size 1, checksum 0), a null id as id 0; repeated
    rows get places of their own; other columns are not read; an empty table gives no rows.
    """
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col) if whole else F.xxhash64(F.col(id_col))
    at, grown = jump_hash(key, count)
    slim = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        at.alias("shard"),
        grown.alias("grown_shard"),
    )
    return numbered(slim, "shard", "slot", "shards").select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
