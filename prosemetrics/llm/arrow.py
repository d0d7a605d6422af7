"""Texts of Arrow batches as plain byte buffers of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Before such a space every byte-level tokenizer cuts, and nothing behind it changes the cut.
_SAFE = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, end to end, and the offsets of its texts (null: empty)."""
    plain = pc.fill_null(column.cast(pa.large_string()), "")
    plain = pa.concat_arrays([plain])
    _, offsets, data = plain.buffers()
    if not len(plain):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slabs(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``rows, bytes, offsets`` of consecutive texts, about ``most`` bytes at a time.

    A text longer than that is cut before a space between two ASCII letters or digits, so that
    several pieces name the same row.  Without such a space it stays whole.
    """
    data, offsets = text_buffer(column)
    rows, ends = [], [0]
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while high - low > most:
            found = _SAFE.search(data[low + most : high].tobytes())
            if not found:
                break
            cut = low + most + found.start()
            rows.append(row)
            ends.append(cut - int(offsets[0]))
            low = cut
        rows.append(row)
        ends.append(high - int(offsets[0]))
    data = data[int(offsets[0]) :]
    all_rows, all_ends = np.array(rows, dtype=np.int64), np.array(ends, dtype=np.int64)
    i = 0
    while i < len(all_rows):
        j = max(i + 1, int(np.searchsorted(all_ends, all_ends[i] + most, side="right")) - 1)
        base = all_ends[i]
        yield all_rows[i:j], data[base : all_ends[j]], all_ends[i : j + 1] - base
        i = j
