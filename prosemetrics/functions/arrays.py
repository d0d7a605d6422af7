"""Linear-time array helpers built from higher-order functions.

They let per-document grouping happen inside the row, where a groupBy would
shuffle one record per word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column) -> Column:
    """``array<T> -> array<struct<value: T, n: int>>``, ordered by value.

    Sort, find where each run starts, subtract neighbouring starts.
    """

    def count(s: Column) -> Column:
        starts = F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    (i == 0) | (x != F.get(s, F.greatest(i - 1, F.lit(0)))), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda at, j: F.struct(
                    F.get(s, at).alias("value"),
                    (F.coalesce(F.get(b, j + 1), F.size(s)) - at).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(items), count)


def numbered(items: Column) -> Column:
    """Tag every copy of a string with its ordinal, so copies become distinct.

    Tagged items are strings, not structs: set functions hash strings but
    compare structs pair by pair.
    """
    return F.flatten(
        F.transform(
            runs(items),
            lambda r: F.transform(
                F.sequence(F.lit(1), r["n"]),
                lambda k: F.concat(k.cast("string"), F.lit(":"), r["value"]),
            ),
        )
    )


def multiset_except(left: Column, right: Column) -> Column:
    """Distinct strings of ``left`` that occur there more often than in ``right``."""
    return numbered_except(numbered(left), numbered(right))


def numbered_except(left: Column, right: Column) -> Column:
    """The same of arrays that are numbered already."""
    lost = F.array_except(left, right)
    return F.sort_array(
        F.array_distinct(F.transform(lost, lambda t: F.regexp_replace(t, r"^\d+:", "")))
    )


def runs_by_key(pairs: Column) -> Column:
    """``array<struct<key, form>>`` to one entry per key with its counted forms.

    Result: ``array<struct<key, forms: array<struct<form, n>>>>``, forms ordered
    by falling count and then by form.
    """

    def group(r: Column) -> Column:
        starts = F.filter(
            F.transform(
                r,
                lambda x, i: F.when(
                    (i == 0)
                    | (x["value"]["key"] != F.get(r, F.greatest(i - 1, F.lit(0)))["value"]["key"]),
                    i,
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda at, j: F.struct(
                    F.get(r, at)["value"]["key"].alias("key"),
                    F.transform(
                        F.sort_array(
                            F.transform(
                                F.slice(
                                    r,
                                    at + 1,
                                    F.coalesce(F.get(b, j + 1), F.size(r)) - at,
                                ),
                                lambda e: F.struct(
                                    (-e["n"]).alias("minus_n"),
                                    e["value"]["form"].alias("form"),
                                ),
                            )
                        ),
                        lambda e: F.struct(e["form"].alias("form"), (-e["minus_n"]).alias("n")),
                    ).alias("forms"),
                ),
            ),
        )

    return let(runs(pairs), group)
