"""Readers for document corpora and name dictionaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemetrics.functions.text import normalize_newlines

_FRONT_MATTER = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?\z"


def front_matter(content: Column) -> Column:
    """``struct<meta: map<string,string>, text>``; text without the header block.

    The header is ``key: value`` lines; outer quotes are removed and a
    repeated key keeps its last value.
    """
    header = F.regexp_extract(content, _FRONT_MATTER, 1)
    has_header = content.rlike(_FRONT_MATTER)
    entries = F.filter(
        F.transform(
            F.split(header, "\n"),
            lambda x: F.struct(
                F.regexp_extract(x, r"^([\p{L}\p{N}_\-]+)[ \t]*:", 1).alias("key"),
                F.regexp_replace(
                    F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)),
                    r"""^(["'])(.*)\1$""",
                    "$2",
                ).alias("value"),
            ),
        ),
        lambda e: e["key"] != "",
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
            lambda later: later["key"] == e["key"],
        ),
    )
    return F.struct(
        F.when(has_header, F.map_from_entries(last))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("meta"),
        F.when(has_header, F.regexp_extract(content, _FRONT_MATTER, 2))
        .otherwise(content)
        .alias("text"),
    )


def parse_documents(raw: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(doc_id, path, meta, text) from whole files; line ends are normalised first."""
    parsed = raw.select(
        F.col(path).alias("path"), front_matter(normalize_newlines(F.col(content))).alias("d")
    )
    stem = F.regexp_replace(F.col("path"), r"\.[^.]*$", "")
    return parsed.select(
        F.coalesce(F.nullif(F.try_element_at("d.meta", F.lit("id")), F.lit("")), stem).alias(
            "doc_id"
        ),
        "path",
        F.col("d.meta").alias("meta"),
        F.col("d.text").alias("text"),
    )


def read_corpus(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Read text files with optional front matter, one document per file.

    ``path`` is a file's place below ``path``, folders included, so files of
    equal names in two folders stay two documents.
    """
    root = re.escape(re.sub(r"^[a-z][a-z0-9+.-]*:/+", "/", path).rstrip("/"))
    raw = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(
            F.col("value").alias("content"),
            F.regexp_replace(
                F.url_decode("_metadata.file_path"), rf"^(?:[a-z][a-z0-9+.-]*:/*)?{root}/+|^.*{root}/+", ""
            ).alias("path"),
        )
    )
    return parse_documents(raw)


def read_table(
    spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", fmt: str = "parquet"
) -> DataFrame:
    """Documents from a columnar table; the scan reads only the two columns."""
    return spark.read.format(fmt).load(path).select(
        F.col(doc_id).alias("doc_id"), normalize_newlines(F.col(text)).alias("text")
    )


def read_names(spark: SparkSession, path: str, field: str = "official") -> DataFrame:
    """(official, snapshot) from a JSON-lines or parquet dictionary."""
    fmt = "json" if path.rstrip("/").endswith((".json", ".jsonl")) else "parquet"
    table = spark.read.format(fmt).load(path)
    snapshot = (
        F.to_date("snapshot") if "snapshot" in table.columns else F.lit(None).cast("date")
    )
    return table.select(F.col(field).alias("official"), snapshot.alias("snapshot"))
