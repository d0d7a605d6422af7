"""Text units and scalar text measures as column expressions.

All patterns use Unicode classes: Java's ``\\w`` and ``\\b`` are ASCII unless
``(?U)`` is set.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemetrics.functions.arrays import let, numbered

WORD = r"[\p{L}\p{N}]+(?:['’ʼ\-][\p{L}\p{N}]+)*"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated tokens; Unicode spaces count as spaces."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def sentence_length(sentence: Column) -> Column:
    """The same for a text with a word in it: every word becomes one letter, and no array is made."""
    return F.length(F.regexp_replace(sentence, r"(?U)\s*+\S++\s*+", "x"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def line_of(text: Column, pos: Column) -> Column:
    """1-based line number of a 0-based character offset."""
    before = F.substring(text, F.lit(1), pos)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def sentences(text: Column, enders: str = ".!?…") -> Column:
    """Lines joined by a space, cut after a sentence ender plus whitespace."""
    # the space is looked for first: it is a cheaper test than the one of what stands before it
    parts = F.split(
        F.replace(text, F.lit("\n"), F.lit(" ")), rf"(?U)\s(?<=[{re.escape(enders)}]\s)\s*+"
    )
    # only a text's first sentence can begin with a space, so one character mostly decides
    return F.filter(parts, lambda s: F.substring(s, 1, 1).rlike(r"(?U)\S") | s.rlike(r"(?U)\S"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(r"(?U)\S"))


def segments(sentence: Column, adversatives: list[str]) -> Column:
    """Clauses of a sentence; the adversative that joined them is dropped."""
    joint = "|".join(re.escape(w) for w in adversatives)
    parts = F.split(sentence, rf"(?iuU)[,;]?\s+(?:{joint})\s+")
    # a bare F.trim would get the position as the characters to trim
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def token_spans(text: Column) -> Column:
    """``array<struct<token, start>>`` with 0-based offsets, letters and digits only.

    A same-length mask of the text gives the positions where words begin; the
    words themselves come in the same order from the pattern match.
    """
    mask = F.regexp_replace(
        F.regexp_replace(text, r"[^\p{L}\p{N}]", "."), r"[\p{L}\p{N}]", "x"
    )
    starts = let(
        F.split(mask, ""),
        lambda ch: F.filter(
            F.transform(
                ch,
                lambda c, i: F.when(
                    (c == "x")
                    & ((i == 0) | (F.get(ch, F.greatest(i - 1, F.lit(0))) == ".")),
                    i,
                ),
            ),
            lambda i: i.isNotNull(),
        ),
    )
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return let(
        starts,
        lambda at: F.transform(
            found,
            lambda t, i: F.struct(t.alias("token"), F.get(at, i).alias("start")),
        ),
    )


def heading_title(line: Column, max_words: int, opening: str = r"\p{Lu}") -> Column:
    """Title when the line is a heading, else null.

    A heading is short, starts with ``opening``, has no final punctuation and
    no sentence break inside; leading ``#`` marks are optional.
    """
    return let(
        F.trim(F.regexp_replace(line, r"^\s*#+\s*", "")),
        lambda title: F.when(
            title.rlike(rf"^{opening}")
            & ~title.rlike(r"(?U)[.!?…:;,]$|[.!?…]\s")
            & (word_count(title) <= max_words),
            title,
        ),
    )


def short_title(line: Column, max_words: int, opening: str = r"\p{Lu}") -> Column:
    """The same as :func:`heading_title`; a line of too many words is not read to its end.

    The marks that open a heading are one word of the line at most.
    """
    short = line.rlike(rf"(?U)\A\s*+(?:\S++\s*+){{0,{max_words + 1}}}+\z")
    return F.when(short, heading_title(line, max_words, opening))


def headings(line_array: Column, max_words: int, opening: str = r"\p{Lu}") -> Column:
    """``array<struct<line, title>>`` of the heading lines."""
    return F.filter(
        F.transform(
            line_array,
            lambda x, i: F.struct(
                (i + 1).alias("line"), short_title(x, max_words, opening).alias("title")
            ),
        ),
        lambda h: h["title"].isNotNull(),
    )


def _blank(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]", " ")


def mask_protected(
    text: Column, max_heading_words: int, fixed: list[str] = (), opening: str = r"\p{Lu}"
) -> Column:
    """Blank headings, quotations and fixed words; every offset stays."""
    no_heads = F.array_join(
        F.transform(
            lines(text),
            lambda x: F.when(
                short_title(x, max_heading_words, opening).isNotNull(), _blank(x)
            ).otherwise(x),
        ),
        "\n",
    )
    spans = [r"«[^»\n]*»", r'"[^"\n]*"', r"“[^”\n]*”"]
    spans += [re.escape(w) for w in sorted(fixed, key=len, reverse=True)]
    protected = "|".join(spans)
    stops = "".join(sorted({re.escape(w[0]) for w in fixed} | {"«", '"', "“"}))
    pieces = F.regexp_extract_all(
        no_heads, F.lit(rf"(?:{protected})|[^{stops}]+|(?s:.)"), F.lit(0)
    )
    return F.array_join(
        F.transform(
            pieces, lambda p: F.when(p.rlike(rf"^(?:{protected})$"), _blank(p)).otherwise(p)
        ),
        "",
    )


def strip_fence(text: Column) -> Column:
    """Remove a surrounding triple-backtick block and outer whitespace."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_replace(
        F.regexp_replace(body, r"^```[^\n]*\n?", ""), r"(?s)```(?!.*```).*$", ""
    )
    return F.when(
        body.startswith("```"), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")
    ).otherwise(body)


def term_pattern(subject: str) -> str:
    """Pattern for a rule word in any inflected form, by its stem."""
    stem = subject[:-1] if len(subject) > 4 else subject
    return rf"(?iuU)\b{re.escape(stem)}\w*"


def action_severity(action: Column) -> Column:
    return F.when(action == "review", "review").when(
        action.isin("remove", "rewrite"), "likely"
    )


def action_confidence(action: Column) -> Column:
    return F.when(action == "review", 0.6).when(action.isin("remove", "rewrite"), 0.8)


def length_change_pct(before: Column, after: Column) -> Column:
    """Growth of the text in percent of its characters; negative when it shrank."""
    was = F.length(before)
    return 100.0 * (F.length(after) - was) / F.greatest(was, F.lit(1))


def touched_pct(before: Column, after: Column) -> Column:
    """Share of words an edit touched, in percent of the longer text.

    Words are compared as a multiset, so moving a word costs nothing.
    """
    return F.when(before.eqNullSafe(after), 0.0).otherwise(
        let(
            F.struct(numbered(words(before)).alias("a"), numbered(words(after)).alias("b")),
            lambda w: touched_tokens_pct(w["a"], w["b"]),
        )
    )


def touched_tokens_pct(before: Column, after: Column) -> Column:
    """The same from the numbered words of both sides."""
    most = F.greatest(F.size(before), F.size(after))
    share = F.size(F.array_intersect(before, after)) / most
    return F.when(most > 0, 100.0 * (1.0 - share)).otherwise(0.0)


def lacks(text: Column, needed: str) -> Column:
    """Whether a text can't have a match of a pattern all of whose matches hold ``needed``."""
    return ~text.contains(needed) if needed else F.lit(False)


def evidence_trim(text: Column, width: int = 90) -> Column:
    return F.substring(text, 1, width)


def stem(word: Column, inflection: str) -> Column:
    """Lower-case word without hyphens and without its inflectional ending."""
    return F.regexp_replace(F.lower(word), inflection, "")
