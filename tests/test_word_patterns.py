"""Patterns that look for cheap things first find the same as the plain ones."""

from pyspark.sql import functions as F

from prosemetrics.functions import text as T
from prosemetrics.functions.arrays import numbered
from prosemetrics.operators import gate, markers
from prosemetrics.packs import latin

ODD = [
    None, "", " ", "\n\t \n", "the", "The THE xthe thex the_ theé thé the-los el. le les less dıe dİe daſ, deŕ él",
    "  Lead.  And so… \n Et puis!  De. nothing  ", "a. b? c! . d . e", "no 12 x12 12x 1٣ 12, 0 ab" + "0f" * 14 + " " + "0f" * 14 + "g",
    "thing sing ring ing xing tion nation Nations NATIONS freundlich, moment-ing ḿing abtión aktıon",
    "by mit pour por By, pours pot bymit licensed LICENCE licences license Kelvin Keep keep, dropped drop droṕ",
    "a@b.c x @y a.b@ token = \"0af\" token = \"\" !! ! || License _token token tokens Token, 𝐀the the𝐀 𝐀 the",
    "# One two three four\n## One two three four five\nOne two three\n#One two three four five\n  # a b c d e\n#\n# # a b c d\nEnds here.\n",
]


def test_patterns_find_what_the_plain_ones_find(spark):
    lang, t = latin.LANGUAGE, F.col("text")
    plain = {
        lang.address: r"(?iuU)\b(?:the|der|die|das|le|les|el|los)\b",
        lang.imperative: r"(?iuU)\b\w{2,}(?:tion|ment|lich|ing)\b",
        lang.concession_inside: r"(?iuU)\b(?:by|mit|pour|por)\b",
        lang.keep_stance: r"(?iuU)\bkeep\b",
        lang.discard_stance: r"(?iuU)\bdrop\b",
        lang.protected_patterns[0][1]: r"(?<![\p{L}\p{N}])[0-9]+(?![\p{L}\p{N}])",
        lang.protected_patterns[1][1]: r"(?<![\p{L}\p{N}])[0-9a-f]{24,}(?![\p{L}\p{N}])",
    }
    hints = [r"\bthe\b", r"\band\b", r"\bder\b", r"\bund\b", r"\bles\b", r"\bdes\b", r"\bune\b", r"!!", r"\blicen[cs]ed?\b"]
    plain |= {f"(?iuU){p}": f"(?iuU){q}" for p, q in zip([p for ps in latin.HINTS.values() for p in ps], hints)}
    patterns = gate._protected_patterns(latin.RULES)
    plain |= {p: rf"(?iuU)(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])" for w, p in patterns[len(lang.protected_patterns):]}
    docs = spark.createDataFrame([(x,) for x in ODD], "text string")
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(0)).eqNullSafe(F.regexp_extract_all(t, F.lit(q), F.lit(0))) for p, q in plain.items()]
    assert all(all(row) for row in docs.select(*found).collect())


def test_units_are_those_of_the_plain_definitions(spark):
    t = F.col("text")
    docs = spark.createDataFrame([(x,) for x in ODD], "text string")
    split = F.filter(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), r"(?U)(?<=[.!?…])\s+"), lambda s: s.rlike(r"(?U)\S"))
    titles = F.filter(F.transform(T.lines(t), lambda x: T.heading_title(x, 4, r"\p{L}")), lambda x: x.isNotNull())
    row = docs.select(
        T.sentences(t).eqNullSafe(split),
        F.transform(T.sentences(t), T.sentence_length).eqNullSafe(F.transform(split, T.word_count)),
        F.transform(T.headings(T.lines(t), 4, r"\p{L}"), lambda h: h["title"]).eqNullSafe(titles),
    )
    assert all(all(r) for r in row.collect())


def test_a_text_without_the_needed_string_is_not_searched(spark):
    """Every hit is found all the same, and a text that can't have one costs no pattern."""
    t, rules = F.col("text"), latin.RULES
    docs = spark.createDataFrame([(x,) for x in ODD], "text string")
    patterns = [m.pattern for m in rules.markers]
    hits = [markers.line_hits(t, T.lines(t), patterns, needed) for needed in (rules.language.needed, {})]
    items = [
        gate._items(t, p, rules).eqNullSafe(numbered(F.regexp_extract_all(t, F.lit(p), F.lit(0))))
        for _, p in gate._protected_patterns(rules)
    ]
    assert all(all(row) for row in docs.select(hits[0].eqNullSafe(hits[1]), *items).collect())
    plan = docs.select(hits[0])._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains(text" in plan and needed in plan for needed in rules.language.needed.values())


def test_imperatives_counted_at_their_ends(spark):
    """One match for each imperative that is no stop word, in any spelling of its letters."""
    lang, t = latin.LANGUAGE, F.col("text")
    odd = [*ODD, "Thing THING thıng thİng xthing a-thing thing-y thinging _thing éthing thing", "sing\ning ming_ment ment xxment lichlich tion tionnation"]
    docs = spark.createDataFrame([(x,) for x in odd], "text string")
    words = F.regexp_extract_all(t, F.lit(lang.imperative), F.lit(0))
    kept = F.size(F.filter(words, lambda w: ~F.lower(w).isin(*lang.imperative_stop)))
    rows = docs.select(kept.alias("kept"), F.regexp_count(t, F.lit(lang.imperative_end)).alias("n")).collect()
    assert all(r.kept == r.n for r in rows) and sum(r.n or 0 for r in rows) > 10
