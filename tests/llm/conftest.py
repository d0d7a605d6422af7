from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Mail me: a.b@c.org, card 4111 1111 1111 1111, +1 (743) 555-3824, 10.0.0.1",
    "word " * 30_000,
    "naïve 日本語 😀 don't　stop<|endoftext|> now",
    "x" * 30_000,
]


@pytest.fixture(scope="session")
def texts():
    """All documents of the smallest data set, as (id, text)."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank and long texts, null ids, languages and sources, repeated rows, and columns whose names
    operators might use themselves."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "no id", "en", "s", 5), (None, None, None, None, None)]
    clash = ["id", "fp", "row", "row_number", "found", "chosen", "score", "n_words", "file", "length", "place", "x"]
    frame = spark.createDataFrame([(*r, *["clash"] * len(clash)) for r in rows], SCHEMA + "".join(f", {c} string" for c in clash))
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
