"""Looking things up in the archive: echoes of a draft and word precedents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemetrics.functions import text as T
from prosemetrics.functions.arrays import runs
from prosemetrics.functions.units import sentence_rows
from prosemetrics.packs.base import Rules
from prosemetrics.session import sized_broadcast, stored

# A word with more occurrences than this is treated as a hot join key.
HOT_ROWS = 200_000


def paragraph_words(paragraph: Column, inflection: str) -> Column:
    """Distinct stems of a paragraph."""
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(paragraph, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)),
            lambda w: T.stem(w, inflection),
        )
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join on ``key`` that spreads hot keys of ``left`` over many tasks.

    ``hot`` is (key, n) for keys with many rows on the left.  Their left rows
    are dealt over ceil(n / HOT_ROWS) buckets and their right rows are copied
    into each bucket; all other keys stay in bucket 0.  The result is whole.
    """
    buckets = sized_broadcast(
        hot.select(key, F.ceil(F.col("n") / F.lit(HOT_ROWS)).cast("int").alias("_buckets"))
    )
    spread = (
        left.join(buckets, key, "left")
        .withColumn(
            "_salt",
            F.coalesce(
                F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), "_buckets"), F.lit(0)
            ).cast("int"),
        )
        .drop("_buckets")
    )
    copied = (
        right.join(buckets, key, "left")
        .withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_buckets", F.lit(1)) - 1))
        )
        .drop("_buckets")
    )
    return spread.join(copied, [key, "_salt"]).drop("_salt")


def echo(
    drafts: DataFrame,
    archive: DataFrame,
    rules: Rules,
    max_df: int,
    min_shared: int = 2,
) -> DataFrame:
    """Archive paragraphs that share rare words with draft paragraphs.

    Both sides are (doc_id, paragraph_no, paragraph).  ``max_df`` defines rare,
    as a number of archive paragraphs, whatever the archive's size: a word that
    more of them hold says nothing about where it comes from.  It also bounds
    the partners of one draft word; one shared word is chance, so
    ``min_shared`` are asked.  The archive's text is read once: its postings
    are stored, and counts and both kinds of words come from them.
    Result: (draft_id, draft_paragraph, doc_id, paragraph_no, shared, words).
    """
    inflection = rules.language.inflection
    archived = stored(postings(archive, inflection), "postings")
    drafted = stored(postings(drafts, inflection, "draft_id", "draft_paragraph"), "postings")
    # Counted once and kept: the hot words and the rare words both come from it.
    df = stored(archived.groupBy("word").agg(F.count("*").alias("df")), "words")
    return _echoes(drafted, archived, df, max_df, min_shared)


def postings(side: DataFrame, inflection: str, doc: str = "doc_id", par: str = "paragraph_no") -> DataFrame:
    """One row for each distinct stem of each paragraph."""
    return side.select(
        F.col("doc_id").alias(doc),
        F.col("paragraph_no").alias(par),
        F.explode(paragraph_words(F.col("paragraph"), inflection)).alias("word"),
    )


def _echoes(drafted: DataFrame, archived: DataFrame, df: DataFrame, max_df: int, min_shared: int) -> DataFrame:
    rare = df.where(F.col("df") <= max_df).select("word")
    frequent = df.where(F.col("df") > max(HOT_ROWS, max_df)).select("word")
    # Frequent words cannot be rare: they leave before the shuffle.
    rare_archive = archived.join(sized_broadcast(frequent), "word", "left_anti").join(
        rare, "word", "left_semi"
    )
    hot = (
        drafted.groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > HOT_ROWS)
        .join(rare, "word", "left_semi")
    )
    shared = salted_join(drafted, rare_archive, "word", hot)
    return (
        shared.where(F.col("draft_id") != F.col("doc_id"))
        .groupBy("draft_id", "draft_paragraph", "doc_id", "paragraph_no")
        .agg(
            F.count("*").alias("shared"),
            F.array_sort(F.collect_list("word")).alias("words"),
        )
        .where(F.col("shared") >= min_shared)
    )


INDEX_BUCKETS = 64


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def append_archive(
    archive: DataFrame, path: str, batch: str, rules: Rules, buckets: int = INDEX_BUCKETS
) -> None:
    """Add paragraphs to the archive index below ``path``.

    The index keeps postings in folders by batch and by a hash of the word, sorted by word, and how
    many paragraphs of the batch hold each word.  Earlier batches are neither read nor rewritten;
    appending a batch again replaces it.  An index has one number of buckets.
    """
    rows = postings(archive, rules.language.inflection).withColumn("bucket", _bucket(F.col("word"), buckets))
    target = f"{path}/postings/batch={batch}"
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = archive.sparkSession.read.schema(rows.schema).parquet(target)
    written.groupBy("bucket", "word").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/words/batch={batch}")


def echo_indexed(
    drafts: DataFrame, path: str, rules: Rules, max_df: int, min_shared: int = 2, buckets: int = INDEX_BUCKETS
) -> DataFrame:
    """As :func:`echo`, against the archive index below ``path``; no archive text is read.

    Only postings of words that the drafts hold are joined: a batch's word counts are added up, and
    words that are not asked for or not rare leave before the postings are looked at.
    """
    spark, key = drafts.sparkSession, dict(drafts.dtypes)
    drafted = postings(drafts, rules.language.inflection, "draft_id", "draft_paragraph")
    drafted = stored(drafted.withColumn("bucket", _bucket(F.col("word"), buckets)), "postings")
    asked = stored(drafted.select("bucket", "word").distinct(), "asked-words")
    counts = spark.read.schema("bucket int, word string, df bigint").parquet(f"{path}/words").select("bucket", "word", "df")
    df = counts.join(asked, ["bucket", "word"], "left_semi").groupBy("bucket", "word").agg(F.sum("df").alias("df"))
    df = stored(df, "words")
    schema = f"doc_id {key['doc_id']}, paragraph_no {key['paragraph_no']}, word string, bucket int, batch string"
    archived = spark.read.schema(schema).parquet(f"{path}/postings")
    rare = sized_broadcast(df.where(F.col("df") <= max_df).select("bucket", "word"))
    archived = archived.join(rare, ["bucket", "word"], "left_semi").select("doc_id", "paragraph_no", "word")
    return _echoes(drafted.drop("bucket"), archived, df.drop("bucket"), max_df, min_shared)


# Groups of documents for each example that is asked.
EXAMPLE_GROUPS = 8


def precedent(docs: DataFrame, words: DataFrame, examples: int, message: str) -> DataFrame:
    """How often each word occurs, with up to ``examples`` sentences and sources.

    Words that never occur stay, with a neutral note: absence from a corpus
    says nothing about the author.

    The examples are the first by document and place.  Documents are dealt into groups, and the
    least document of each word and group is known from the counts; the last wanted of these
    bounds the documents that are looked at, so neither sorting nor shuffling meets the others.
    """
    asked = words.select(F.lower("word").alias("word")).distinct()
    rows = (
        sentence_rows(docs)
        .select(
            "doc_id",
            "sentence_no",
            "sentence",
            F.explode(
                runs(
                    F.transform(
                        F.regexp_extract_all("sentence", F.lit(r"[\p{L}\p{N}\-]+"), F.lit(0)),
                        F.lower,
                    )
                )
            ).alias("r"),
        )
        .select(
            "doc_id",
            "sentence_no",
            "sentence",
            F.col("r.value").alias("word"),
            F.col("r.n").alias("n"),
        )
        .join(sized_broadcast(asked), "word")
    )
    group = F.pmod(F.xxhash64("doc_id"), F.lit(EXAMPLE_GROUPS * max(examples, 1)))
    # Spilled rows would be whole sentences: only numbers are aggregated here.
    parts = rows.groupBy("word", group.alias("_group")).agg(
        F.sum("n").alias("_n"), F.count("*").alias("_sentences"), F.min("doc_id").alias("_least")
    )
    if examples > 0:
        parts = stored(parts, "precedent-counts")
    counts = parts.groupBy("word").agg(
        F.sum("_n").alias("occurrences"), F.sum("_sentences").alias("sentences")
    )
    out = asked.join(counts, "word", "left")
    if examples > 0:
        bounds = parts.groupBy("word").agg(
            F.get(F.array_sort(F.collect_list("_least")), F.lit(examples - 1)).alias("_bound")
        )
        # a word in fewer groups has no bound, and null ids come first
        early = F.col("_bound").isNull() | F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("_bound"))
        rows = rows.join(sized_broadcast(bounds), "word").where(early)
        order = Window.partitionBy("word").orderBy("doc_id", "sentence_no")
        top = (
            rows.withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= examples)
            .groupBy("word")
            .agg(
                F.array_sort(F.collect_list(F.struct("doc_id", "sentence_no", "sentence"))).alias(
                    "examples"
                )
            )
        )
        out = out.join(top, "word", "left")
    return out.select(
        "word",
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.coalesce("sentences", F.lit(0)).alias("sentences"),
        *(["examples"] if examples > 0 else []),
        F.when(F.col("occurrences").isNull(), message).alias("note"),
    )
