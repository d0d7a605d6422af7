"""Statistics of whole texts, counted in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_upper",
    "n_bangs",
    "n_digits",
    "n_stops",
    "n_lines",
    "n_distinct",
    "n_wide",
)

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_STOPS = b".,;:?"
_WIDE = bytes(range(0x80, 0x100))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a three-word window found twice or more, and distinct words."""
    n = len(words)
    known: dict[bytes, int] = {}
    first = np.fromiter(map(known.setdefault, words, range(n)), dtype=np.int64, count=n)
    if n < 4:
        return 0, len(known)
    pairs = first[:-1] * n + first[1:]
    if n > 2_000_000:  # three numbers would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * n + first[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum()), len(known)


def count_stats(text: str | None) -> tuple[int, ...]:
    """The statistics named in ``NAMES``; all zero for a null or empty text (but for one line)."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    size = len(raw)
    without = lambda some: size - len(raw.translate(None, some))
    repeats, distinct = repeated_words(words)
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    twice = 0
    for line in lines:
        if line in seen:
            twice += 1
        elif line.strip():
            seen.add(line)
    return (
        len(words),
        len(text) - without(_SPACES),
        without(_SYMBOLS),
        twice,
        repeats,
        without(_UPPER),
        raw.count(b"!"),
        without(_DIGITS),
        without(_STOPS),
        len(lines),
        distinct,
        without(_WIDE),
    )


def with_stats(docs: DataFrame, names: list[str], text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with the statistics as long columns ``names`` (in the order of ``NAMES``)."""
    kept = [c for c in docs.columns if not (drop_text and c == text_col)]
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = np.array([count_stats(t.as_py()) for t in batch.column(at)], dtype=np.int64).reshape(-1, len(NAMES))
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            columns += [pa.array(np.ascontiguousarray(counted[:, i])) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    schema = docs.select(*kept, *[F.lit(0).cast("long").alias(n) for n in names]).schema
    for field in schema:
        field.nullable = True
    return docs.mapInArrow(add, schema)
