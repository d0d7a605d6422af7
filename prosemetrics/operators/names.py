"""Official-name checks against a dictionary table ``names(official)``.

A document's words, and its word sequences of the lengths that names have,
probe the dictionary by the whole folded form, so a common first word is no
hot key.  The
dictionary is broadcast when its size allows and joined by shuffle otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions import text as T
from prosemetrics.functions.arrays import let, runs
from prosemetrics.functions.findings import finding
from prosemetrics.functions.units import lemma_rows
from prosemetrics.operators.marks import probable
from prosemetrics.packs.base import LanguagePack, Rules
from prosemetrics.session import sized_broadcast, stored

APOSTROPHES = "'’ʼ`"
DASHES = r"[-–—−]"
NAME_WORD = rf"[\p{{L}}\p{{N}}]+(?:[{APOSTROPHES}\-–—−][\p{{L}}\p{{N}}]+)*"


def snapshot_status(names: DataFrame, today: Column | None = None, max_age: int = 45) -> DataFrame:
    """Age of the dictionary snapshot; ``names(official, snapshot date)``."""
    now = today if today is not None else F.current_date()
    return (
        names.groupBy("snapshot")
        .agg(F.count("*").alias("names"))
        .withColumn("age_days", F.datediff(now, "snapshot"))
        .withColumn("stale", F.col("age_days") > max_age)
    )


def name_words(text: Column) -> Column:
    """Words of a text or name, with ``.`` and ``,`` standing for punctuation.

    A sentence ender becomes ``.``, any other mark ``,``; dashes between spaces
    stay words of their own.  A name never matches across a mark.
    """
    ended = F.regexp_replace(text, r"[.!?…]+", " . ")
    marked = F.regexp_replace(
        ended, rf"[^\p{{L}}\p{{N}}\s.{APOSTROPHES}\-–—−]+", " , "
    )
    return F.filter(F.split(F.trim(marked), r"(?U)\s+"), lambda w: w != "")


def _is_word(w: Column) -> Column:
    return ~w.isin(".", ",")


def _strip_marks(words: Column) -> Column:
    return F.filter(words, _is_word)


def _folded_dash(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, DASHES, "-"))


def _folded_apostrophe(c: Column) -> Column:
    return F.lower(F.translate(c, APOSTROPHES, ""))


# Stands before a sequence of words that opens a sentence.
OPENING = "^"


def sequences(text: Column, arities: list[int], wanted: str | None = None) -> Column:
    """``array<string>``: the word sequences of the given lengths; with ``wanted``, those with a word that it matches.

    A sequence never runs over a punctuation mark.  One at a sentence start has
    ``OPENING`` before it.  Words are taken one by one: a slice would copy the whole
    text's words at each of them.
    """

    def of(w: Column, wants: Column | None) -> Column:
        def at(x: Column, i: Column) -> Column:
            opens = (i == 0) | (F.get(w, F.greatest(i - 1, F.lit(0))) == ".")
            mark = F.when(opens, F.lit(OPENING)).otherwise(F.lit(""))
            out = []
            for a in arities:
                places = [i + k for k in range(a)]
                whole = F.size(w) >= i + a
                if wants is not None:
                    whole = whole & reduce(or_, [F.get(wants, p) for p in places])
                whole = reduce(and_, [_is_word(F.get(w, p)) for p in places], whole)
                out.append(F.when(whole, F.concat(mark, F.concat_ws(" ", *[F.get(w, p) for p in places]))))
            return F.array(*out)

        return F.filter(F.flatten(F.transform(w, at)), lambda v: v.isNotNull())

    if wanted is None:
        return let(name_words(text), lambda w: of(w, None))
    return let(name_words(text), lambda w: let(F.transform(w, lambda x: x.rlike(wanted)), lambda wants: of(w, wants)))


def _dictionary(names: DataFrame, fold, min_words: int = 1) -> DataFrame:
    """(official, _plain, _key, _arity) of names, without punctuation marks."""
    w = _strip_marks(name_words(F.col("official")))
    return (
        names.select("official", w.alias("_w"))
        .where(F.size("_w") >= min_words)
        .select("official", F.array_join("_w", " ").alias("_plain"), F.size("_w").alias("_arity"))
        .withColumn("_key", fold(F.col("_plain")))
        .distinct()
    )


def _owners(names: DataFrame, kind: str) -> DataFrame:
    """(kind, _key, official): the forms that a folded written form may stand for."""
    if kind == "apostrophe":
        parts = names.select(F.explode(_strip_marks(name_words(F.col("official")))).alias("official"))
        owners = parts.distinct().where(F.col("official").rlike(f"[{APOSTROPHES}]"))
        owners = owners.withColumn("_key", _folded_apostrophe(F.col("official")))
    elif kind == "dash":
        owners = _dictionary(names.where(F.col("official").rlike(DASHES)), _folded_dash)
    else:
        owners = _dictionary(names, F.lower, 2)
    return owners.select(F.lit(kind).alias("kind"), "_key", "official")


def _right_forms(names: DataFrame, kind: str) -> DataFrame:
    """(kind, _form): written forms that are official as they stand."""
    if kind == "apostrophe":
        forms = names.select(F.explode(_strip_marks(name_words(F.col("official")))).alias("w")).select(F.lower("w").alias("_form"))
    elif kind == "dash":
        forms = _dictionary(names, F.lower).select(F.col("_key").alias("_form"))
    else:
        plain = _dictionary(names, F.lower, 2).select("_plain")
        opened = F.concat(F.lit(OPENING), F.upper(F.substring("_plain", 1, 1)), F.substr("_plain", F.lit(2)))
        as_is = F.concat(F.lit(OPENING), F.col("_plain"))
        forms = plain.select(F.explode(F.array("_plain", opened, as_is)).alias("_form"))
    return forms.select(F.lit(kind).alias("kind"), "_form").distinct()


def name_hits(
    docs: DataFrame, names: DataFrame, kinds: tuple[str, ...], copies: bool = False
) -> DataFrame:
    """(doc_id, kind, was, official, n) for each document row: names written wrong.

    ``kinds`` are of apostrophe, dash and case.  The text is read once: a row's
    words and word sequences become candidates of their kinds, and all of them
    probe one dictionary by kind and folded form; only the few hits are counted.  A form
    that is official as written is right, whatever else it resembles, and a
    wrong one is reported with every name it may stand for.  At a sentence
    start the first letter is capital by the rules of the language, so the
    check of capitals does not compare it there.

    Rows that share a ``doc_id`` are counted together, or once if they are
    known to be ``copies`` of each other.
    """
    lengths = names.select(
        F.size(_strip_marks(name_words(F.col("official")))).alias("n"),
        F.col("official").rlike(DASHES).alias("dashed"),
    ).where("n > 0").distinct().collect()
    text = F.col("text")
    dashed = sorted({r.n for r in lengths if r.dashed}) or [1]
    several = sorted({r.n for r in lengths if r.n >= 2}) or [2]
    none = F.array().cast("array<string>")
    found = {
        "apostrophe": F.regexp_extract_all(text, F.lit(NAME_WORD), F.lit(0)),
        "dash": F.when(text.rlike(DASHES), sequences(text, dashed, DASHES)).otherwise(none),
        "case": sequences(text, several),
    }
    fold = {"apostrophe": _folded_apostrophe, "dash": _folded_dash, "case": F.lower}
    exact = {"apostrophe": F.lower, "dash": F.lower, "case": lambda c: c}

    def of_kind(functions: dict, column: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in kinds:
            out = F.when(F.col("kind") == kind, functions[kind](column)).otherwise(out)
        return out

    def union(build) -> DataFrame:
        out = build(names, kinds[0])
        for kind in kinds[1:]:
            out = out.unionByName(build(names, kind))
        return out

    candidates = F.concat(*[F.transform(found[kind], _tagged(kind, fold[kind])) for kind in kinds])
    probe = docs.select("doc_id", F.posexplode(candidates).alias("_place", "c")).select(
        "doc_id",
        "_place",
        "c.kind",
        "c._key",
        F.col("c.value").alias("_written"),
    )
    owners = union(_owners)
    dictionary = sized_broadcast(owners)
    if dictionary is owners:
        # joined by shuffle: only words that are probably in the dictionary move, not the whole corpus
        dictionary = stored(owners, "name-owners")
        probe = probable(probe, dictionary, ["kind", "_key"])
    written = F.when(F.col("kind") == "case", F.col("_written")).otherwise(F.col("was"))
    wrong = (
        probe.join(dictionary, ["kind", "_key"])
        .withColumn("was", F.ltrim("_written", F.lit(OPENING)))
        .withColumn("_form", of_kind(exact, written))
        .join(sized_broadcast(union(_right_forms)), ["kind", "_form"], "left_anti")
    )
    if copies:
        wrong = wrong.select("doc_id", "_place", "kind", "was", "official").distinct()
    return wrong.groupBy("doc_id", "kind", "was", "official").agg(F.count("*").alias("n"))


def _tagged(kind: str, fold):
    """A candidate with its folded form, made here once: a filter that the join adds would make it again."""

    def tag(value: Column) -> Column:
        # only sequences have the mark of an opening before them
        bare = value if kind == "apostrophe" else F.ltrim(value, F.lit(OPENING))
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), fold(bare).alias("_key"))

    return tag


def apostrophe_errors(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, was, official, n): names written without or with another apostrophe."""
    return name_hits(docs, names, ("apostrophe",)).drop("kind")


def dash_errors(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, was, official, n): names whose dash is another sign."""
    return name_hits(docs, names, ("dash",)).drop("kind")


def case_errors(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, was, official, n): multi-word names written in another case."""
    return name_hits(docs, names, ("case",)).drop("kind")


def _segment(length: Column, edits: int, i: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of ``edits + 1`` nearly equal ones."""

    def size(j: int) -> Column:
        return F.floor((length + j) / (edits + 1)).cast("int")

    start = F.lit(0)
    for j in range(i):
        start = start + size(j)
    return start, size(i)


def _segment_key(edits: int, length: Column, i: int, segment: Column) -> Column:
    return F.concat(F.lit(f"{edits}:"), length.cast("string"), F.lit(f":{i}:"), segment)


def name_segments(word: Column, max_edits: int) -> Column:
    """The keys of a dictionary word: its segments, for each number of edits."""
    length, keys = F.length(word), []
    for edits in range(1, max_edits + 1):
        for i in range(edits + 1):
            start, size = _segment(length, edits, i)
            key = _segment_key(edits, length, i, F.substr(word, start + 1, size))
            keys.append(F.when(length > edits, key))
    return F.array_compact(F.array(*keys))


def probe_segments(word: Column, max_edits: int, allowed) -> Column:
    """The keys under which a written word finds every dictionary word within its edits.

    A word with at most ``edits`` edits keeps one of ``edits + 1`` segments whole.  Take the first
    segment before which there is one edit for each segment and not one more: it is shifted by as many letters at most,
    seen from the front, and by as many as there are segments behind it, seen from the end.  So a
    word has ``(edits^2 - d^2) / 2 + edits + 1`` keys or fewer for each difference of lengths d,
    however long it is.
    """
    own, keys = F.length(word), []
    for edits in range(1, max_edits + 1):
        for more in range(-edits, edits + 1):  # letters that the written word has more
            length = own - more
            fits = (length > edits) & (allowed(F.greatest(own, length)) == edits)
            for i in range(edits + 1):
                start, size = _segment(length, edits, i)
                for shift in range(max(-i, more - edits + i), min(i, more + edits - i) + 1):
                    at = start + shift
                    key = _segment_key(edits, length, i, F.substr(word, at + 1, size))
                    keys.append(F.when(fits & (at >= 0) & (at + size <= own), key))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def typo_candidates(
    docs: DataFrame,
    names: DataFrame,
    language: LanguagePack,
    max_edits: int = 2,
    letters_per_edit: int = 4,
) -> DataFrame:
    """(doc_id, was, official, edits, n): near misses of name words.

    One edit (a letter put in, left out or replaced) is allowed for every
    ``letters_per_edit`` letters of the longer word, ``max_edits`` (one or two)
    at most, so that most of the word is common; where the edits sit does not
    matter.  Inflected forms of a known word are not typos.

    A name word is cut into one segment more than it may have edits; a word within those edits holds
    one of the segments unchanged, at nearly the same place.  Segment, place and length are the join
    key, so a word has a fixed number of keys, however long it is.  Every distinct word of the corpus
    is matched once.
    """
    if max_edits not in (1, 2):
        raise ValueError("max_edits must be 1 or 2")
    inflection = language.inflection
    vocabulary = (
        names.select(F.explode(_strip_marks(name_words(F.col("official")))).alias("word"))
        .select(_folded_apostrophe(F.col("word")).alias("word"))
        .where(F.col("word").rlike(r"[\p{L}\p{N}]"))
        .distinct()
    )
    stems = vocabulary.select(T.stem(F.col("word"), inflection).alias("_stem")).distinct()

    def allowed(length: Column) -> Column:
        return F.least(F.lit(max_edits), F.floor(length / letters_per_edit).cast("int"))

    found = runs(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    words = (
        docs.select("doc_id", F.explode(found).alias("r"))
        .select("doc_id", F.col("r.value").alias("was"), F.col("r.n").cast("long").alias("n"))
        .withColumn("_low", F.lower("was"))
    )
    segments = vocabulary.select("word", F.explode(name_segments(F.col("word"), max_edits)).alias("_key"))
    probe = words.select("_low").distinct()
    probe = probe.select("_low", F.explode(probe_segments(F.col("_low"), max_edits, allowed)).alias("_key"))
    near = (
        probe.join(sized_broadcast(stored(segments, "name-segments")), "_key")
        .select("_low", "word")
        .distinct()
        .withColumn("edits", F.levenshtein("_low", "word", max_edits))
        .where((F.col("edits") >= 1) & (F.col("edits") <= allowed(F.greatest(F.length("_low"), F.length("word")))))
        .withColumn("_stem", T.stem(F.col("_low"), inflection))
        .join(sized_broadcast(stems), "_stem", "left_anti")
        .groupBy("_low")
        .agg(
            F.min_by("word", F.struct("edits", "word")).alias("official"),
            F.min("edits").alias("edits"),
        )
    )
    near = stored(near, "near-misses")  # measured for the broadcast and joined: computed once
    return (
        words.join(sized_broadcast(near), "_low")
        .groupBy("doc_id", "was", "official", "edits")
        .agg(F.sum("n").alias("n"))
        .select("doc_id", "was", "official", "edits", "n")
    )


def common_words(docs: DataFrame, language: LanguagePack, min_share: float) -> DataFrame:
    """(lemma, documents): words in so many documents that they name nothing.

    ``min_share`` is the share of all documents, so the result means the same
    at every size.  Each document contributes a word once: a plain count with
    map-side combination and no distinct.
    """
    stems = F.array_distinct(
        F.transform(
            F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))),
            lambda w: T.stem(w, language.inflection),
        )
    )
    total = docs.agg(F.count("*").alias("_all"))
    return (
        docs.select(F.explode(stems).alias("lemma"))
        .groupBy("lemma")
        .agg(F.count("*").alias("documents"))
        .join(F.broadcast(total), F.col("documents") >= F.col("_all") * min_share)
        .select("lemma", "documents")
    )


def short_names(
    docs: DataFrame,
    names: DataFrame,
    common: DataFrame,
    language: LanguagePack,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, was, official, n): one word standing for a longer official name.

    Common words are removed first, and a word belonging to several official
    names stays unresolved.  Information, not an error.
    """
    parts = (
        names.select("official", _strip_marks(name_words(F.col("official"))).alias("_w"))
        .where(F.size("_w") >= 2)
        .select("official", F.explode("_w").alias("token"))
    )
    keys = (
        lemma_rows(parts, lemmas, language)
        .groupBy("lemma")
        .agg(F.min("official").alias("official"), F.count_distinct("official").alias("_owners"))
        .where(F.col("_owners") == 1)
        .select("lemma", "official")
        .join(common.select("lemma"), "lemma", "left_anti")
    )
    keys = stored(keys, "short-names")  # measured for the broadcast and joined: computed once
    words = docs.select(
        "doc_id",
        F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token"),
    )
    return (
        lemma_rows(words, lemmas, language)
        .join(sized_broadcast(keys), "lemma")
        .groupBy("doc_id", F.col("token").alias("was"), "official")
        .agg(F.count("*").alias("n"))
    )


def name_findings(
    hits: DataFrame, kind: str, severity: str, rules: Rules, confidence: float = 1.0
) -> DataFrame:
    """Turn (doc_id, was, official, n) rows into (doc_id, finding)."""
    return hits.select(
        "doc_id",
        finding(
            id=f"cards.{kind}",
            analyzer="cards",
            category="localization",
            severity=severity,
            confidence=confidence,
            message=rules.messages[kind],
            evidence=F.col("was"),
            suggestion=F.col("official"),
            meta=F.create_map(F.lit("count"), F.col("n").cast("int")),
        ).alias("finding"),
    )
