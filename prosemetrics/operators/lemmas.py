"""Lemmas of forms that the lemma table lacks, and names found under inflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions.units import lemma_rows
from prosemetrics.operators.names import name_words
from prosemetrics.packs.base import LanguagePack
from prosemetrics.session import sized_broadcast, stored

# What a guess leaves of a form at least, and the longest ending that is learnt.
MIN_STEM, LONGEST_ENDING = 2, 5


def _ending(form: Column, length: Column) -> Column:
    return F.substr(form, F.length(form) - length + 1, length)


def learn_endings(
    lemmas: DataFrame, min_forms: int = 2, longest: int = LONGEST_ENDING, min_stem: int = MIN_STEM
) -> DataFrame:
    """(ending, cut, add, forms): what forms with an ending lose and get on the way to a lemma.

    ``lemmas(form, lemma)`` is many to many.  What a form does not share with its lemma is its rewrite;
    it is learnt for that part of the form and for every longer ending up to ``longest`` letters,
    which makes a tree of endings.  A rewrite that fewer than ``min_forms`` forms with the ending
    have is no rule.
    """
    pairs = lemmas.select(F.lower("form").alias("form"), "lemma").dropna().distinct()
    common = F.size(
        F.filter(
            F.sequence(F.lit(0), F.least(F.length("form"), F.length("lemma"))),
            lambda i: F.substr("form", F.lit(1), i) == F.substr("lemma", F.lit(1), i),
        )
    )
    # prefixes of 0, 1, 2 ... letters agree up to the shared one, so their number less one is its length
    pairs = pairs.withColumn("shared", common - 1)
    cut = F.length("form") - F.col("shared")
    lengths = F.filter(F.sequence(F.lit(0), F.lit(longest)), lambda n: (n >= cut) & (n <= F.length("form") - min_stem))
    return (
        pairs.select(
            "form",
            cut.alias("cut"),
            F.substr("lemma", F.col("shared") + 1).alias("add"),
            F.explode(lengths).alias("n"),
        )
        .groupBy(_ending(F.col("form"), F.col("n")).alias("ending"), "cut", "add")
        .agg(F.count_distinct("form").alias("forms"))
        .where(F.col("forms") >= min_forms)
    )


def guessed_lemmas(
    forms: DataFrame, endings: DataFrame, longest: int = LONGEST_ENDING, min_stem: int = MIN_STEM
) -> DataFrame:
    """(form, lemma): all lemmas that the longest known ending of each form gives.

    A form without a known ending has no row; short forms keep ``min_stem`` letters.
    """
    lengths = F.filter(F.sequence(F.lit(0), F.lit(longest)), lambda n: n <= F.length("form") - min_stem)
    cases = forms.select(F.lower("form").alias("form")).dropna().distinct()
    cases = cases.select("form", F.explode(lengths).alias("n"))
    known = cases.withColumn("ending", _ending(F.col("form"), F.col("n"))).join(
        sized_broadcast(endings.select("ending", "cut", "add")), "ending"
    )
    # The rewrites of an ending are few: they come from the language, not from the corpus.
    per_ending = known.groupBy("form", "n").agg(F.collect_set(F.struct("cut", "add")).alias("rewrites"))
    best = per_ending.groupBy("form").agg(F.max_by("rewrites", "n").alias("rewrites"))
    lemma = F.concat(F.substr("form", F.lit(1), F.length("form") - F.col("r.cut")), F.col("r.add"))
    return best.select("form", F.explode("rewrites").alias("r")).select("form", lemma.alias("lemma")).distinct()


def all_lemmas(tokens: DataFrame, lemmas: DataFrame, endings: DataFrame, token: str = "token") -> DataFrame:
    """(form, lemma): the table's rows, and guesses for the forms of ``tokens`` that it lacks."""
    table = lemmas.select(F.lower("form").alias("form"), "lemma").distinct()
    unknown = tokens.select(F.lower(token).alias("form")).distinct().join(table, "form", "left_anti")
    return table.unionByName(guessed_lemmas(unknown, endings))


def _trie(names: DataFrame, lemmas: DataFrame | None, language: LanguagePack, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(node, lemma, child) and (node, official): names as a trie over words.

    A node is named by the words on its path as the names write them.  A word's lemmas are edges
    beside each other, so a name of n words has n nodes however many lemmas they have.
    """
    words = F.filter(name_words(F.col("official")), lambda w: ~w.isin(".", ","))
    path = lambda n: F.lower(F.array_join(F.slice("w", F.lit(1), n), " "))
    split = names.select("official", words.alias("w")).where(F.size("w") >= min_words).distinct()
    steps = split.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w")),
                lambda n: F.struct(
                    F.when(n > 1, path(n - 1)).otherwise("").alias("node"),
                    F.get("w", n - 1).alias("token"),
                    path(n).alias("child"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    edges = lemma_rows(steps, lemmas, language).select("node", "lemma", "child").distinct()
    return edges, split.select(path(F.size("w")).alias("node"), "official", F.size("w").alias("words")).distinct()


def inflected_names(
    texts: DataFrame,
    names: DataFrame,
    language: LanguagePack,
    lemmas: DataFrame | None = None,
    key: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    min_words: int = 2,
) -> DataFrame:
    """(*key, official, was, n): names of several words, in any forms of their words.

    Each place of a text has a set of lemmas (``lemmas(form, lemma)``, else the inflection stem).  The trie of
    names is walked over these sets: a place takes a node to a child when any of its lemmas labels the
    edge.  Alternatives never multiply, because what is carried on is the set of nodes reached.
    A name never runs over a punctuation mark.

    The corpus' words meet the edges once; only words that stand on some edge go on, and are joined
    place by place.  Rows with the same key and text are counted once.
    """
    edges, ends = _trie(names, lemmas, language, min_words)
    edges, ends = stored(edges, "name-edges"), stored(ends, "name-ends")
    most = ends.agg(F.max("words")).first()[0] or 0  # one number
    same = F.xxhash64(text).alias("_text")
    words = texts.select(*key, same, F.posexplode(name_words(F.col(text))).alias("_at", "token")).where(~F.col("token").isin(".", ","))
    hits = lemma_rows(words, lemmas, language).join(sized_broadcast(edges), "lemma")
    place = [*key, "_text", "_at"]
    hits = stored(hits.select(*place, "token", "node", "child").distinct(), "name-words")

    states = hits.where("node = ''").select(*place, F.col("_at").alias("_from"), F.col("child").alias("node"), F.col("token").alias("was"))
    found = None
    for n in range(1, most + 1):
        ended = states.join(sized_broadcast(ends.where(F.col("words") == n)), "node").select(*key, "official", "was")
        found = ended if found is None else found.unionByName(ended)
        if n < most:
            states = states.withColumn("_at", F.col("_at") + 1).join(hits, [*place, "node"])
            states = states.select(*place, "_from", F.col("child").alias("node"), F.concat_ws(" ", "was", "token").alias("was")).distinct()
    if found is None:
        found = hits.select(*key, F.col("token").alias("official"), F.col("token").alias("was")).limit(0)
    return found.groupBy(*key, "official", "was").agg(F.count("*").alias("n"))
