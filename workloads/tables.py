"""Input frames of the registered queries: the given tables and views on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemetrics.packs.latin import RULES
from prosemetrics.session import configure, fits_broadcast, spread, stored

LANGUAGE = RULES.language


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the full stop at line ends removed, so short lines are headings."""
    text = F.replace(F.concat("text", F.lit("\n")), F.lit(".\n"), F.lit("\n"))
    return documents(spark, sf_dir).withColumn("text", text)


def hyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where words before an article got a hyphen, so spellings differ."""
    text = F.regexp_replace(
        "text", r"([a-z]{3})(tion|ing|ment) (of|the|la|de) ", "$1-$2 $3 "
    )
    return documents(spark, sf_dir).withColumn("text", text)


def mentions(spark: SparkSession, sf_dir: str, sentence: Column) -> DataFrame:
    """Documents closed by a line about the part with the same number, if there is one.

    Texts stay where they are while the documents' parts can be broadcast.  Beyond that they are
    shuffled, which deals them over all cores, and not sorted.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    numbered = F.col("doc_id") == F.col("p_partkey")
    small = fits_broadcast(part)
    if not small:
        part = stored(part.join(docs.select("doc_id"), numbered, "left_semi"), "mentioned-parts")
        small = fits_broadcast(part)
    if small:
        joined = spread(docs).join(F.broadcast(part), numbered, "left")
    else:
        joined = docs.join(part.hint("shuffle_hash"), numbered, "left")
    line = F.when(F.col("p_name").isNotNull(), F.concat(F.lit("\n"), sentence)).otherwise("")
    return joined.select("doc_id", F.concat("text", line).alias("text"))


def names(spark: SparkSession, sf_dir: str, official: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select(official.alias("official")).distinct()


# Edits of a text, from mild to harsh; each is one expression over the text.
EDITS = {
    "digits": lambda t: F.regexp_replace(t, "[0-9]+", ""),
    "parentheses": lambda t: F.regexp_replace(t, r" \([^)]*\)", ""),
    "merged": lambda t: F.replace(t, F.lit(". "), F.lit(", ")),
    "articles": lambda t: F.regexp_replace(t, " (the|der|die|le|les|el|los) ", " "),
}


def edit_pairs(spark: SparkSession, sf_dir: str, prepared=lambda texts: texts) -> DataFrame:
    """(pair_id, doc_id, edit, before, after): every document under every edit.

    ``prepared`` may add columns to the documents (doc_id, before) before they are multiplied.
    """
    text = F.col("before")
    edits = F.array(
        *[
            F.struct(F.lit(name).alias("edit"), edit(text).alias("after"))
            for name, edit in EDITS.items()
        ]
    )
    texts = prepared(documents(spark, sf_dir).withColumnRenamed("text", "before"))
    added = [c for c in texts.columns if c not in ("doc_id", "before")]
    return (
        texts.select(*texts.columns, F.explode(edits).alias("e"))
        .select(
            F.concat_ws("-", "doc_id", "e.edit").alias("pair_id"),
            "doc_id",
            F.col("e.edit").alias("edit"),
            "before",
            F.col("e.after").alias("after"),
            *added,
        )
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n, text): three tries per document, the second one fenced."""
    text = F.col("text")
    tries = F.array(
        F.struct(F.lit(1).alias("n"), EDITS["articles"](text).alias("text")),
        F.struct(
            F.lit(2).alias("n"),
            F.concat(F.lit("```text\n"), EDITS["digits"](text), F.lit("\n```\n")).alias("text"),
        ),
        F.struct(F.lit(3).alias("n"), EDITS["merged"](text).alias("text")),
    )
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.explode(tries).alias("t"))
        .select("doc_id", "t.*")
    )


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus files with metadata, some of it missing or unknown.

    The identifier is a digest of the text, so copies share it.  Every 50th
    document is filed once more with a negative number and an empty text.
    """
    docs = table(spark, sf_dir, "documents")
    blank = docs.where("doc_id % 50 = 0").withColumns(
        {"doc_id": -1 - F.col("doc_id"), "text": F.lit(""), "n_chars": F.lit(0).cast("long")}
    )
    docs = spread(docs.unionByName(blank))

    def field(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.cast("string").alias("value"))

    fields = F.array(
        field(F.lit("id"), F.md5("text")),
        field(F.lit("title"), F.concat(F.lit("Title "), F.col("doc_id").cast("string"))),
        field(F.lit("published_at"), F.lit("unknown")),
        field(F.lit("updated_at"), F.when(F.col("n_chars") > 500, "unknown")),
        field(
            F.lit("game_mode"),
            F.when(F.col("source") == "src0", "standard")
            .when(F.col("source") == "src1", "wild")
            .when(F.col("source") == "src2", "unknown")
            .otherwise(F.col("source")),
        ),
        field(
            F.lit("genre"),
            F.when(F.col("lang") != "es", F.concat("lang", F.lit("-report"))).otherwise("essay"),
        ),
        field(F.lit("patch"), F.when(F.col("n_chars") > 300, "unknown")),
        field(F.lit("source_url"), F.concat(F.lit("https://"), F.col("source"))),
        field(F.lit("extraction_source"), F.lit("web")),
        field(
            F.lit("clean_status"), F.when(F.col("lang") == "de", "washed").otherwise("cleaned")
        ),
    )
    present = F.filter(fields, lambda f: f["value"].isNotNull())
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.format_string("doc-%09d.md", "doc_id").alias("path"),
        F.map_from_entries(present).alias("meta"),
        "text",
    )


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headed documents with their guessed profile attached."""
    from prosemetrics.operators.structure import with_profile

    return with_profile(headed(spark, sf_dir), RULES)
