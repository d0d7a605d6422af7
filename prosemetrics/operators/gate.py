"""The edit gate: what an edit did to voice, protected items, rhythm and length.

A pair is one row and every check stays inside it, so the gate has no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions import text as T
from prosemetrics.functions.arrays import numbered, numbered_except
from prosemetrics.functions.findings import flat
from prosemetrics.functions.numbers import rounded
from prosemetrics.operators.markers import _template, hit_count
from prosemetrics.operators.measures import rhythm, voice, voice_total
from prosemetrics.packs.base import SIGNALS, Rules

VIOLATION = "struct<kind:string,signal:string,was:int,now:int,message:string>"
MIN_WORDS = 150
RHYTHM_TOLERANCE = 0.03
MAX_SHRINK_PCT = 5.0


# What is measured of each side of a pair.
MEASURES = ("words", "rhythm", "voice", "markers", "items", "tokens")


def _protected_words(rules: Rules) -> list[str]:
    return list(dict.fromkeys(w for g in rules.games.values() for w in g.protected))


def _protected_patterns(rules: Rules) -> list[tuple[str, str]]:
    """(kind, pattern) of the shapes and fixed words that some game protects."""
    def whole(w: str) -> str:
        # the word is looked for before what stands around it
        return rf"(?iuU){w}(?<![\p{{L}}\p{{N}}]{w})(?![\p{{L}}\p{{N}}])"

    fixed = [(w, whole(re.escape(w))) for w in _protected_words(rules)]
    return [*rules.language.protected_patterns, *fixed]


def _items(text: Column, pattern: str, rules: Rules) -> Column:
    found = numbered(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    none = T.lacks(text, rules.language.needed.get(pattern, ""))
    return F.when(none, F.array().cast("array<string>")).otherwise(found)


def _measured(pairs: DataFrame, side: str, column: str, rules: Rules, known: str | None = None) -> DataFrame:
    """Add the measures of one side; where ``_same`` is true they are those of the side ``known``.

    Items of a kind that the side ``known`` has none of can't be lost and are not looked for.
    """
    text = F.col(column)

    def measure(name: str, value: Column) -> dict[str, Column]:
        if known:
            value = F.when(F.col("_same"), F.col(f"{known}_{name}")).otherwise(value)
        return {f"{side}_{name}": value}

    def new(value: Column) -> Column:
        return F.when(~F.col("_same"), value) if known else value

    sentences, lens, words = F.col("_sentences"), F.col("_lens"), F.col(f"{side}_words")
    def kind(i: int, pattern: str) -> Column:
        found = _items(text, pattern, rules)
        if known:
            none = F.size(F.get(F.col(f"{known}_items"), F.lit(i))) == 0
            found = F.when(none, F.array().cast("array<string>")).otherwise(found)
        return found

    items = F.array(*[kind(i, p) for i, (_, p) in enumerate(_protected_patterns(rules))])
    return (
        pairs.withColumn("_sentences", new(T.sentences(text)))
        .withColumn("_lens", F.transform("_sentences", T.sentence_length))
        # sentences end at spaces, so their words are those of the text
        .withColumns(measure("words", F.aggregate("_lens", F.lit(0), lambda n, x: n + x)))
        .withColumns(measure("rhythm", rhythm(lens)))
        .withColumns(measure("voice", voice(text, sentences, lens, words, rules.language)))
        .withColumns(measure("markers", hit_count(text, T.lines(text), [m.pattern for m in rules.markers], rules.language.needed)))
        .withColumns(measure("items", items))
        .withColumns(measure("tokens", numbered(T.words(text))))
        .drop("_sentences", "_lens")
    )


def measured_before(texts: DataFrame, rules: Rules) -> DataFrame:
    """Add ``b_*`` of the column ``before``.

    Texts that are edited several times are measured here before they are multiplied.
    """
    return _measured(texts, "b", "before", rules)


def measured(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Add the measures of both sides: ``b_*`` before, ``a_*`` after; ``b_*`` that are there already stay.

    An edit that changed nothing is not measured again.
    """
    out = pairs if "b_words" in pairs.columns else measured_before(pairs, rules)
    out = out.withColumn("_same", F.col("before").eqNullSafe(F.col("after")))
    return _measured(out, "a", "after", rules, "b").drop("_same")


def classify(
    was: Column,
    now: Column,
    words_before: Column,
    words_after: Column,
    tolerance: int = 0,
    min_words: int = MIN_WORDS,
) -> Column:
    """State of one signal: removed, insufficient or kept.

    A drop in the count is a fact and is decided first, at any length.
    Frequency never decides: it moves with the length of the text.
    """
    return (
        F.when(now < was - tolerance, "removed")
        .when(F.least(words_before, words_after) < min_words, "insufficient")
        .otherwise("kept")
    )


def _violation(kind: str, message: Column, signal=None, was=None, now=None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        (signal if isinstance(signal, Column) else F.lit(signal)).cast("string").alias("signal"),
        (was if isinstance(was, Column) else F.lit(was)).cast("int").alias("was"),
        (now if isinstance(now, Column) else F.lit(now)).cast("int").alias("now"),
        message.alias("message"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _signal(side: str, name: str) -> Column:
    """Count of a signal; an unmeasurable text has none."""
    return F.coalesce(F.col(f"{side}_voice")[name]["n"], F.lit(0))


def voice_lost(rules: Rules) -> Column:
    def one(name: str) -> Column:
        was, now = _signal("b", name), _signal("a", name)
        label = rules.language.signal_labels.get(name, name)
        state = classify(was, now, F.col("b_words"), F.col("a_words"))
        return F.when(
            state == "removed",
            F.array(
                _violation(
                    "voice_lost",
                    _template(rules.messages["voice_lost"], F.lit(label), was, now),
                    label,
                    was,
                    now,
                )
            ),
        ).otherwise(_none())

    return F.concat(*[one(name) for name in SIGNALS])


def protected_losses(before: Column, after: Column, rules: Rules, game: Column | None = None):
    """``array<struct<kind, items>>`` of items that occur less often after.

    ``before`` and ``after`` are the ``items`` of the two sides.
    An edit must keep shapes (numbers, codes) and the fixed words of its game.
    Every word that some game protects is compared once, however many games
    there are; ``game`` then says which of the words count.  A game that is
    not in the rules has the default game's words.
    """
    shapes = len(rules.language.protected_patterns)
    default = rules.games[rules.default_game].protected

    def counts(word: str) -> Column:
        having = [g.id for g in rules.games.values() if word in g.protected]
        known = game.isin(having)
        if rules.default_game in having:
            known = known | game.isNull() | ~game.isin(list(rules.games))
        return F.coalesce(known, F.lit(False))

    def kind(i: int, name: str, wanted: Column | None) -> Column:
        items = numbered_except(F.get(before, F.lit(i)), F.get(after, F.lit(i)))
        if wanted is not None:
            items = F.when(wanted, items).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(name).alias("kind"), items.alias("items"))

    kinds = [
        kind(i, name, None if game is None or i < shapes else counts(name))
        for i, (name, _) in enumerate(_protected_patterns(rules))
        if i < shapes or game is not None or name in default
    ]
    return F.filter(F.array(*kinds), lambda k: F.size(k["items"]) > 0)


def protected_lost(rules: Rules, game: Column | None = None) -> Column:
    return F.transform(
        protected_losses(F.col("b_items"), F.col("a_items"), rules, game),
        lambda k: _violation(
            "protected_lost",
            _template(
                rules.messages["protected_lost"],
                k["kind"],
                F.array_join(F.slice(k["items"], 1, 5), ", "),
            ),
            k["kind"],
        ),
    )


def rhythm_flattened(rules: Rules) -> Column:
    was, now = F.col("b_rhythm.ratio"), F.col("a_rhythm.ratio")
    return F.when(
        now < was - RHYTHM_TOLERANCE,
        F.array(
            _violation(
                "rhythm_flattened",
                _template(
                    rules.messages["rhythm_flattened"],
                    F.format_string("%.2f", rounded(was, 2)),
                    F.format_string("%.2f", rounded(now, 2)),
                ),
            )
        ),
    ).otherwise(_none())


def text_shrunk(rules: Rules) -> Column:
    delta = T.length_change_pct(F.col("before"), F.col("after"))
    return F.when(
        delta < -MAX_SHRINK_PCT,
        F.array(
            _violation(
                "text_shrunk",
                _template(rules.messages["text_shrunk"], F.format_string("%.0f", rounded(F.abs(delta), 0))),
            )
        ),
    ).otherwise(_none())


KINDS = ("voice_lost", "protected_lost", "rhythm_flattened", "text_shrunk")


def violations(rules: Rules, game: Column | None = None, kinds: tuple[str, ...] = KINDS) -> Column:
    found = {
        "voice_lost": voice_lost(rules),
        "protected_lost": protected_lost(rules, game),
        "rhythm_flattened": rhythm_flattened(rules),
        "text_shrunk": text_shrunk(rules),
    }
    return F.concat(*[found[k] for k in KINDS if k in kinds])


def validate_edits(pairs: DataFrame, rules: Rules, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Verdict per pair.  ``pairs(pair_id, before, after[, game])``.

    A game without a row in the rules falls back to the default game.  Only violations of ``kinds``
    are looked for, and only what they need is measured; all kinds make the gate.
    """
    keep = [c for c in pairs.columns if c not in ("before", "after", *[f"b_{m}" for m in MEASURES])]
    rows = measured(pairs, rules)
    provisional = F.lit(rules.games[rules.default_game].provisional)
    game = None
    if "game" in pairs.columns:
        game = F.col("game")
        for g in rules.games.values():
            if g.id != rules.default_game:
                provisional = F.when(game == g.id, F.lit(g.provisional)).otherwise(provisional)
    found = violations(rules, game, kinds)
    return rows.withColumn("violations", found).select(
        *keep,
        (F.size("violations") == 0).alias("accepted"),
        "violations",
        rounded(T.length_change_pct(F.col("before"), F.col("after")), 1).alias(
            "length_change_pct"
        ),
        rounded(F.col("b_rhythm.ratio"), 3).alias("rhythm_before"),
        rounded(F.col("a_rhythm.ratio"), 3).alias("rhythm_after"),
        rounded(voice_total(F.col("b_voice")), 1).alias("voice_before"),
        rounded(voice_total(F.col("a_voice")), 1).alias("voice_after"),
        provisional.alias("norms_provisional"),
    )


def violation_rows(verdicts: DataFrame, key: str = "pair_id") -> DataFrame:
    return flat(verdicts, F.col("violations"), key)


def select_attempt(
    docs: DataFrame, attempts: DataFrame, rules: Rules, max_attempts: int = 3
) -> DataFrame:
    """First accepted attempt within the cap, else the original text: a row for each of ``docs``.

    ``docs(doc_id, text)``, ``attempts(doc_id, n, text)``.  Attempts after the
    first accepted one were never made, so the history ends there.

    Documents that share an id are told apart by their texts: each is judged against all attempts
    of the id.  A null id is an id like any other.
    """
    tries = attempts.where(F.col("n") <= max_attempts).select(
        F.col("doc_id").alias("_id"), "n", T.strip_fence(F.col("text")).alias("after")
    )
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    rows = measured_before(marked.withColumnRenamed("text", "before"), rules).join(tries, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    verdicts = measured(rows, rules).select("doc_id", "_text", "n", violations(rules).alias("violations"))
    accepted = F.size("violations") == 0
    tried = F.col("n").isNotNull()
    # Only numbers and reasons are grouped; the one text of each document is fetched at the end.
    best = verdicts.groupBy(F.col("doc_id").alias("_of"), F.col("_text").alias("_of_text")).agg(
        F.min(F.when(tried & accepted, F.col("n"))).alias("_n"),
        # a set: copies of a document have the same history
        F.array_sort(
            F.collect_set(
                F.when(tried, F.struct("n", accepted.alias("accepted"), "violations"))
            )
        ).alias("_history"),
    )
    # A range is no join key: both joins with the attempts are dealt by id alone, so the attempts
    # are made and shuffled once.
    chosen = F.col("n").between(F.col("_n"), F.col("_n"))
    best = best.join(tries, F.col("_of").eqNullSafe(F.col("_id")) & chosen, "left")
    best = marked.join(best, F.col("doc_id").eqNullSafe(F.col("_of")) & F.col("_text").eqNullSafe(F.col("_of_text")))
    before, after = rules.messages["original_returned"].split("{}")
    return best.withColumn("accepted", F.col("_n").isNotNull()).select(
        "doc_id",
        "accepted",
        F.col("_n").alias("accepted_n"),
        F.coalesce("after", "text").alias("text"),
        F.filter(
            "_history",
            lambda h: F.col("_n").isNull() | (h["n"] <= F.col("_n")),
        ).alias("attempts"),
        F.when(
            F.col("_n").isNull(),
            F.concat(F.lit(before), F.lit(str(max_attempts)), F.lit(after)),
        ).alias("caveat"),
    )


def gate_summary(verdicts: DataFrame) -> DataFrame:
    """(kind, signal, pairs, pairs_total, rate_pct): what edits are rejected for.

    Every pair also adds to one total row, so the rate needs no second pass;
    the window runs over the few summary rows.
    """
    from pyspark.sql import Window

    reasons = F.array_distinct(
        F.transform(
            "violations",
            lambda v: F.struct(v["kind"].alias("kind"), v["signal"].alias("signal")),
        )
    )
    total = F.array(F.struct(F.lit("*").alias("kind"), F.lit(None).cast("string").alias("signal")))
    counted = (
        verdicts.select(F.explode_outer(F.concat(total, reasons)).alias("v"))
        .groupBy("v.kind", "v.signal")
        .agg(F.count("*").alias("pairs"))
    )
    everything = Window.partitionBy(F.lit(1))
    return (
        counted.withColumn(
            "pairs_total", F.max(F.when(F.col("kind") == "*", F.col("pairs"))).over(everything)
        )
        .where(F.col("kind") != "*")
        .withColumn("rate_pct", F.col("pairs") * 100.0 / F.col("pairs_total"))
    )
