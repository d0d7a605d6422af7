"""Numbers as they are reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemetrics.functions.arrays import let

# Cuts a double into two halves of 26 bits, whose products are exact.
_SPLITTER = 2.0**27 + 1


def rounded(value: Column, digits: int) -> Column:
    """A double rounded to decimal digits, ties to even, judged by its exact binary value.

    0.625 gives 0.62 and 2.675, which is stored a little lower, 2.67.  The
    scaled value is kept as a product and its rounding error, so no tie is
    made or missed by the multiplication.
    """
    scale = float(10**digits)

    def judge(v: Column) -> Column:
        high = v * _SPLITTER - (v * _SPLITTER - v)
        product = v * scale
        error = (high * scale - product) + (v - high) * scale
        whole = F.floor(product).cast("double")
        rest = (product - whole) + error
        up = (rest > 0.5) | ((rest == 0.5) & (whole % 2 != 0))
        return (whole + F.when(up, 1.0).otherwise(0.0)) / scale

    return let(value.cast("double"), judge)
