"""Personal data: candidates from generous patterns, boosted trees over format and context, a
calibrated threshold for each kind, spans and redaction.  Column functions only.

Labels are results of checksums and of tests of digit counts and ends of names; the trees see
neither, only what stands before a candidate and how it is cut into groups.

Patterns are written so that they run in linear time and without recursion on any text: repeats are
possessive, and a pattern begins only where a run of its first characters does, or where the match
before it ended (``\\G``).  Matches are those of the plain patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.functions.arrays import let
from prosemetrics.llm.boosting import Trees, fit
from prosemetrics.llm.shared import free_name, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)


@dataclass(frozen=True)
class Generator:
    """Proposes spans of one kind.  ``hint`` is a cheap condition that any match implies; matches of
    a ``base`` generator that pass the kind's test are always redacted, those of a ``wide`` one
    never: they only teach."""

    kind: int
    pattern: str
    hint: str
    base: bool
    wide: bool = False


GENERATORS = (
    Generator(EMAIL, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]", True),
    Generator(IP, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    # Only from where thirteen digits follow; shorter runs are no card numbers.
    Generator(CARD, r"(?<![0-9])(?=(?:[0-9][ -]?){12}[0-9])[0-9]++(?:[ -][0-9]++)*+", r"(?:[0-9][ -]?){12}[0-9]", True),
    Generator(PHONE, r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True),
    # Written around a filter: name [at] host [dot] org.
    Generator(
        EMAIL,
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({]dot[\])}] ?)[A-Za-z0-9-]++)++",
        r"[\[({]at[\])}]",
        False,
    ),
    # Numbers without a plus: a 00 prefix, or an area code in brackets.
    Generator(
        PHONE,
        r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4}|\([0-9]{3}\)[ -]?[0-9]{3}[ -][0-9]{4})(?![0-9])",
        r"00[1-9]|\([0-9]{3}\)",
        False,
    ),
    # Four groups of four with another separator.
    Generator(CARD, r"(?<![0-9._])[0-9]{4}([._])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"[0-9]{4}[._][0-9]{4}", False),
    # Groups of digits like those of phone numbers, but too few or too many of them for one.
    Generator(
        PHONE,
        r"(?<![0-9+.])(?<![0-9)][ -])[0-9]{2,5}(?:[ -][0-9]{2,4}){3,7}(?![0-9])",
        r"[0-9]{2}[ -][0-9]{2,4}[ -][0-9]{2}",
        False,
        True,
    ),
)

CONTEXT = 24
CUES_OF = {
    EMAIL: "e-?mail|mail|contact|kontakt|correo|courriel|addr",
    IP: "ip|host|addr",
    CARD: "card|karte|carte|tarjeta|visa",
    PHONE: "contact|kontakt|tel|phone|telefon|t[eé]l[eé]fono?|call|fax",
}
CUES = rf"\b(?:{'|'.join(CUES_OF.values())})"
# What has numbers that are no personal data; counts where no cue follows it.
OTHERS = (
    r"\b(?:version|release|build|rev(?:ision)?|serial(?:number)?|serien?-?(?:nummer|nr)|s[eé]rie|sku|isbn|issn|ean|part|model|modell?o|mod[eè]le"
    r"|article|artikel|art[ií]culo|order|bestell(?:ung|nummer)|commande|pedido|invoice|rechnung|factur[ea]|tracking|ticket|ref(?:erence|erenz)?)\b"
)

FEATURES = ("groups", "letters", "cue", "other", "joined")
# A labelled candidate also stands for so many (at most) wrong ones in a context of ``other`` things
# or joined to a word, so that a table without such cases does not allow them.
DOUBT = 4.0
TREES, DEPTH, RATE = 24, 3, 0.3
# What share of the labelled candidates above the threshold must be right.
PRECISION = 0.995
# Prefix sums are made in runs of this length, so that their cost does not grow as a square.
RUN = 64


def running_sum(lengths: Column) -> Column:
    """The sum of all elements before each element of an array of whole numbers."""

    def before(values: Column) -> Column:
        zero = F.lit(0).cast("long")
        start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            values,
            start,
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
        )["out"]

    def sums(values: Column) -> Column:
        last = F.greatest(F.ceil(F.size(values) / RUN).cast("int") - 1, F.lit(0))
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * RUN + 1, RUN))

        def joined(runs: Column) -> Column:
            totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda acc, x: acc + x))
            return F.flatten(F.zip_with(runs, before(totals), lambda r, base: F.transform(before(r), lambda x: x + base)))

        return let(runs, joined)

    return let(lengths, sums)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of a pattern's matches; offsets are code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def place(values: Column) -> Column:
        def among(gaps: Column) -> Column:
            size = lambda gap, value: F.length(gap).cast("long") + F.coalesce(F.length(value), F.lit(0))
            ahead = F.zip_with(running_sum(F.zip_with(gaps, values, size)), gaps, lambda at, gap: at + F.length(gap))
            return F.zip_with(
                values,
                F.slice(ahead, F.lit(1), F.size(values)),
                lambda value, at: F.struct(at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value")),
            )

        return let(F.split(text, pattern, -1), among)

    return let(found, lambda values: F.when(F.size(values) == 0, none).otherwise(place(values)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(
        F.reverse(F.split(digits, "")), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d))
    )
    return F.aggregate(terms, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def passes(kind: int, value: Column, base: bool) -> Column:
    """The test of a kind.  A prefix 00, for which a base phone number has no room, is no digit; an
    address written around filters must end like a host name."""
    if kind == EMAIL:
        return value.isNotNull() if base else value.rlike("[^A-Za-z][A-Za-z]{2,}$")
    if kind == IP:
        number = lambda part: F.ltrim(part, F.lit("0"))
        small = lambda n: (F.length(n) <= 2) | ((F.length(n) == 3) & (n <= "255"))
        return F.forall(F.split(value, r"\."), lambda part: small(number(part)))
    digits = digits_of(value)
    if kind == CARD:
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits if base else F.regexp_replace(digits, "^00", "")).between(9, 15)


CANDIDATE = "struct<kind:int,base:boolean,start:bigint,end:bigint,value:string,valid:boolean,label:int,before:string>"


def candidates(text: Column) -> Column:
    """``array<struct<kind, base, start, end, value, valid, label, before>>``: what the generators
    propose.  Spans of different generators may overlap.

    ``label``: the test's result on base spans and on card numbers, whose checksum decides.  Other
    added spans are labelled wrong when they fail and are open when they pass, and so are wide ones,
    but that lengths of card numbers (13 to 19) stay open, and that they are never ``valid``.
    """

    def label(g: Generator, value: Column, valid: Column) -> Column:
        if g.wide:
            return F.when(~F.length(digits_of(value)).between(9, 19), F.lit(0))
        return valid.cast("int") if g.base or g.kind == CARD else F.when(~valid, F.lit(0))

    def described(g: Generator):
        def describe(m: Column) -> Column:
            begin = F.greatest(m["start"] - CONTEXT, F.lit(0))
            valid = F.lit(False) if g.wide else passes(g.kind, m["value"], g.base)
            return F.struct(
                F.lit(g.kind).alias("kind"),
                F.lit(g.base).alias("base"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["value"].alias("value"),
                valid.alias("valid"),
                label(g, m["value"], valid).alias("label"),
                F.substring(text, (begin + 1).cast("int"), (m["start"] - begin).cast("int")).alias("before"),
            )

        return describe

    parts = []
    for g in GENERATORS:
        found = matches(text, g.pattern)
        none = F.array().cast(f"array<{CANDIDATE}>")
        parts.append(F.when(text.rlike(g.hint), F.transform(found, described(g))).otherwise(none))
    return F.concat(*parts)


def features(c: Column) -> list[Column]:
    """Small whole numbers that describe a candidate: its groups and what stands before it.  No
    label follows from them."""
    value, before = c["value"], c["before"]
    length_of = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    own = F.lit(False)
    for kind, words in CUES_OF.items():
        own = F.when(c["kind"] == kind, before.rlike(rf"(?iu)\b(?:{words})")).otherwise(own)
    return [
        F.least(F.length(F.regexp_replace(F.regexp_replace(value, "[^0-9]+", "."), "[0-9]+", "")), F.lit(6)),
        F.least(length_of("[^A-Za-z]"), F.lit(4)),
        own.cast("int"),
        before.rlike(f"(?ius){OTHERS}(?!.*{CUES})").cast("int"),
        before.rlike("[A-Za-z0-9]$").cast("int"),
    ]


def doubted(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each combination again, once among ``other`` things and once joined to a word, with its
    weight or ``DOUBT``: rows that are taken for wrong."""
    rows = []
    for name in ("other", "joined"):
        again = x.copy()
        again[:, FEATURES.index(name)] = 1
        rows.append(again)
    return np.concatenate(rows), np.tile(np.minimum(weight, DOUBT), len(rows))


Models = dict[int, tuple[Trees, float]]


def train(found: DataFrame, column: str) -> Models:
    """Trees and the threshold on their margin for each kind, from the labelled candidates of all
    documents.

    Features have few values each, so the candidates are counted for each combination; that table's
    size is bounded, and only it comes to the driver.  The threshold rests on labelled candidates
    alone; a kind that has none that are right has no model.
    """
    each = found.select(F.explode(column).alias("c")).filter("c.label IS NOT NULL")
    described = each.select("c.kind", *[f.alias(n) for n, f in zip(FEATURES, features(F.col("c")))], "c.label")
    counted = described.groupBy("kind", *FEATURES, "label").agg(F.count(F.lit(1)).alias("n")).collect()
    table = np.array(sorted(tuple(r) for r in counted), dtype=np.float64).reshape(-1, len(FEATURES) + 3)
    models = {}
    for kind in sorted({g.kind for g in GENERATORS if not (g.base or g.wide)}):
        rows = table[table[:, 0] == kind, 1:]
        x, y, weight = rows[:, :-2], rows[:, -2], rows[:, -1]
        if not y.any():
            continue
        more, share = doubted(x, weight)
        model = fit(
            np.concatenate([x, more]),
            np.concatenate([y, np.zeros(len(more))]),
            trees=TREES,
            depth=DEPTH,
            rate=RATE,
            bins=32,
            least_weight=2.0,
            weight=np.concatenate([weight, share]),
        )
        models[kind] = (model, calibrate(model.margin(x), y, weight))
    return models


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The least margin above which the labelled candidates are right to ``PRECISION``; at least
    even odds, and infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    right, total = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.append(margin[order][1:] < margin[order][:-1], True) if len(order) else np.zeros(0, dtype=bool)
    fit_for = np.flatnonzero(ends & (right >= PRECISION * total) & (margin[order] >= 0))
    return float(margin[order][fit_for[-1]]) if len(fit_for) else float("inf")


def margin_of(model: Trees, values: list[Column]) -> Column:
    """The model's margin as one expression over feature columns."""

    def grow(node: int) -> Column:
        if model.left[node] == node:
            return F.lit(float(model.value[node]))
        left = int(model.left[node])
        below = values[int(model.feature[node])] <= F.lit(float(model.threshold[node]))
        return F.when(below, grow(left)).otherwise(grow(left + 1))

    total = F.lit(float(model.base))
    for root in model.roots:
        total = total + grow(int(root))
    return total


def selected(found: Column, models: Models) -> Column:
    """``array<struct<kind, start, end>>``, sorted: the base spans that pass, and of the added ones that
    pass those above their kind's threshold that overlap no base span and no earlier chosen one."""
    bare = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.transform(F.filter(found, lambda c: c["base"] & c["valid"]), bare)
    models = {kind: m for kind, m in models.items() if np.isfinite(m[1])}
    if not models:
        return F.array_sort(base)

    def judged(c: Column, f: Column) -> Column:
        out = F.lit(False)
        for kind, (model, threshold) in models.items():
            above = margin_of(model, [f[i] for i in range(len(FEATURES))]) >= F.lit(threshold)
            out = F.when(c["kind"] == kind, above).otherwise(out)
        return out

    extra = F.filter(found, lambda c: ~c["base"] & c["valid"] & let(F.array(*features(c)), lambda f: judged(c, f)))
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def choose(sure: Column, more: Column) -> Column:
        free = F.filter(more, lambda e: ~F.exists(sure, lambda s: touches(s, e)))
        alone = F.aggregate(
            free,
            F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"),
            lambda acc, e: F.when(F.exists(acc, lambda s: touches(s, e)), acc).otherwise(F.concat(acc, F.array(e))),
        )
        return F.array_sort(F.concat(sure, alone))

    def with_extra(more: Column) -> Column:
        return F.when(F.size(more) == 0, F.array_sort(base)).otherwise(let(base, lambda sure: choose(sure, more)))

    return let(F.transform(extra, bare), with_extra)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: one row for every row.

    Counts and the checksum are of the base spans, ``spans`` has all.  The text is read once: what
    the generators find is stored (without the text), the trees are fitted on it and applied to it.
    The base patterns' spans that pass their tests are always there; added spans must also stand in
    a context that the trees accept.

    Defined cases: a null text is an empty one; a document without a match has zeros, the checksum
    of the empty string and an empty ``spans``; in a table without a labelled candidate of a kind that
    is right, that kind has base spans only; null and repeated ids stay as they are; other
    columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = stored(docs.select(F.col(id_col).alias("id"), candidates(text).alias("found")), "pii")
    models = train(found, "found")
    base = F.array_sort(
        F.transform(
            F.filter("found", lambda c: c["base"] & c["valid"]),
            lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
        )
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.withColumns({"base": base, "chosen": selected(F.col("found"), models)}).select(
        F.col("id").alias(id_col),
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("chosen")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the one
    that begins first counts, and the rest of the others is removed with it."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    cut = "struct<gap:bigint,start:bigint,kind:int>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{cut}>").alias("cuts"))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def take(acc: Column, s: Column) -> Column:
        new = F.struct(acc["at"].alias("gap"), s["start"].alias("start"), s["kind"].alias("kind"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["cuts"], F.array(new)).alias("cuts"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["cuts"].alias("cuts"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    def rewrite(done: Column) -> Column:
        piece = lambda low, high: F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))
        parts = F.transform(done["cuts"], lambda c: F.concat(piece(c["gap"], c["start"]), F.get(names, c["kind"])))
        return F.concat(F.array_join(parts, ""), piece(done["at"], F.length(text).cast("long")))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(by_place, start, take), rewrite))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data in its texts replaced; a column ``n_chars``, if there is one, gets
    the new length.  Null texts stay null.  Cases are defined as in :func:`personal_data`."""
    found, chosen = free_name(docs.columns, "found"), free_name(docs.columns, "chosen")
    marked = docs.withColumn(found, candidates(F.coalesce(F.col(text_col), F.lit(""))))
    # Stored without the texts to train on, and found again in the pass that rewrites them.
    models = train(stored(marked.select(found), "redact"), found)
    out = marked.withColumn(chosen, selected(F.col(found), models))
    out = out.withColumn(text_col, redacted(F.col(text_col), F.col(chosen)))
    if length_col in docs.columns:
        changed = F.size(chosen) > 0
        length = F.length(text_col).cast(dict(docs.dtypes)[length_col])
        out = out.withColumn(length_col, F.when(changed, length).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
