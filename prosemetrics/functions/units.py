"""Exploded text units, and the unit columns shared by the detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions import text as T
from prosemetrics.packs.base import LanguagePack


def with_units(docs: DataFrame, language: LanguagePack, text: str = "text") -> DataFrame:
    """Add the unit arrays every detector reads; unused ones are pruned.

    They are computed once per document, before any detector looks at them.
    """
    return (
        docs.withColumn("lines", T.lines(F.col(text)))
        .withColumn("sentences", T.sentences(F.col(text)))
        .withColumn("sentence_words", F.transform("sentences", T.sentence_length))
        # sentences end at spaces, so their words are those of the text
        .withColumn("words", F.aggregate("sentence_words", F.lit(0), lambda n, x: n + x))
        .withColumn(
            "headings",
            T.headings(F.col("lines"), language.heading_words, language.heading_opening),
        )
    )


def _explode(docs: DataFrame, array, unit: str, number: str, key: str) -> DataFrame:
    return docs.select(key, F.posexplode(array).alias("_pos", unit)).select(
        key, (F.col("_pos") + 1).alias(number), unit
    )


def line_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per line, numbered from 1."""
    return _explode(docs, T.lines(F.col("text")), "line", "line_no", key)


def sentence_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = _explode(docs, T.sentences(F.col("text")), "sentence", "sentence_no", key)
    return rows.withColumn("words", T.word_count(F.col("sentence")))


def paragraph_rows(docs: DataFrame, key: str = "doc_id", breaks: str = r"\n\s*\n") -> DataFrame:
    """One row per paragraph; ``breaks`` is the paragraph separator."""
    parts = F.filter(F.split("text", breaks), lambda p: p.rlike(r"(?U)\S"))
    return _explode(docs, parts, "paragraph", "paragraph_no", key)


def segment_rows(docs: DataFrame, language: LanguagePack, key: str = "doc_id") -> DataFrame:
    """One row per clause of each sentence."""
    per_sentence = F.transform(
        T.sentences(F.col("text")), lambda s: T.segments(s, list(language.adversatives))
    )
    clauses = F.flatten(
        F.transform(
            per_sentence,
            lambda parts, i: F.transform(
                parts,
                lambda p, j: F.struct(
                    (i + 1).alias("sentence_no"), (j + 1).alias("segment_no"), p.alias("segment")
                ),
            ),
        )
    )
    return docs.select(key, F.explode(clauses).alias("c")).select(key, "c.*")


def token_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per word with its 0-based character offset."""
    spans = T.token_spans(F.col("text"))
    return docs.select(key, F.posexplode(spans).alias("_pos", "t")).select(
        key, (F.col("_pos") + 1).alias("token_no"), "t.token", "t.start"
    )


def heading_rows(docs: DataFrame, language: LanguagePack, key: str = "doc_id") -> DataFrame:
    found = T.headings(
        T.lines(F.col("text")), language.heading_words, language.heading_opening
    )
    return docs.select(key, F.explode(found).alias("h")).select(key, "h.line", "h.title")


def lemma_rows(
    tokens: DataFrame, lemmas: DataFrame | None, language: LanguagePack, token: str = "token"
) -> DataFrame:
    """Every lemma of every token, not only the likeliest one.

    ``lemmas(form, lemma)`` is many to many.  A form missing from the table,
    or no table at all, falls back to the inflection stem.
    """
    from prosemetrics.session import sized_broadcast

    fallback = T.stem(F.col(token), language.inflection)
    if lemmas is None:
        return tokens.withColumn("lemma", fallback)
    table = lemmas.select(F.lower("form").alias("_form"), F.col("lemma").alias("_lemma"))
    return (
        tokens.join(sized_broadcast(table), F.lower(token) == F.col("_form"), "left")
        .withColumn("lemma", F.coalesce("_lemma", fallback))
        .drop("_form", "_lemma")
    )
