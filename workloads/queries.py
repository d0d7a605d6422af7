"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator.

Each calls the library on the given tables; results are projected to plain
columns so that they can be compared with SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemetrics.functions import findings as FN
from prosemetrics.functions import text as T
from prosemetrics.functions import units as U
from prosemetrics.operators import (
    consistency,
    gate,
    integrity,
    lemmas as L,
    markers,
    measures,
    names as N,
    reporting,
    retrieval,
    rulecheck,
    structure,
)
from prosemetrics.packs.base import SIGNALS
from prosemetrics.plans import audit as A
from prosemetrics.plans.corpus_checks import validate_corpus
from prosemetrics.session import shared_folder, stored
from prosemetrics.sources import corpus as C
from workloads import tables as W

RULES, LANG = W.RULES, W.LANGUAGE
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---------------------------------------------------------------- sources


@query
def front_matter(spark, sf):
    """Corpus files with a YAML header: header and body are told apart."""
    docs = W.table(spark, sf, "documents")
    content = F.concat(
        F.lit("---\r\nid: \"doc-"), F.col("doc_id").cast("string"),
        F.lit("\"\r\ngenre: "), F.col("lang"),
        F.lit("\r\nsource_url: https://x/"), F.col("source"),
        F.lit("\r\n---\r\n"), F.col("text"),
    )
    parsed = C.parse_documents(
        docs.select(content.alias("content"), F.concat("source", F.lit(".md")).alias("path"))
    )
    return parsed.select(
        "doc_id",
        "path",
        F.try_element_at("meta", F.lit("genre")).alias("genre"),
        F.try_element_at("meta", F.lit("source_url")).alias("source_url"),
        F.size(F.map_keys("meta")).cast("long").alias("fields"),
        T.word_count(F.col("text")).cast("long").alias("words"),
        F.md5("text").alias("body"),
    )


@query
def newlines(spark, sf):
    """Windows and old Mac line ends become one newline each."""
    docs = W.documents(spark, sf)
    mixed = F.replace(
        F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\r")
    )
    return docs.select("doc_id", F.md5(T.normalize_newlines(mixed)).alias("digest"))


@query
def section_spellings(spark, sf):
    """The rule table of section spellings against the headings of documents."""
    heads = U.heading_rows(W.headed(spark, sf), LANG)
    sections = F.broadcast(structure.profile_sections(spark, RULES))
    used = heads.select("doc_id", F.lower("title").alias("variant"))
    return (
        used.join(sections, "variant")
        .groupBy("profile", "section_id", "variant", "required")
        .agg(F.count_distinct("doc_id").alias("documents"))
    )


@query
def marker_catalogue(spark, sf):
    """Hits per catalogue entry; entries without hits stay with zero."""
    catalogue = markers.catalogue_table(spark, RULES.markers)
    hits = markers.markers(W.documents(spark, sf), RULES)
    counted = hits.groupBy(F.substring("id", 9, 100).alias("id")).agg(F.count("*").alias("hits"))
    return catalogue.join(counted, "id", "left").select(
        "id", "action", F.coalesce("hits", F.lit(0)).alias("hits")
    )


@query
def name_snapshot(spark, sf):
    """Age of dictionary snapshots on a fixed day."""
    part = W.table(spark, sf, "part").select(
        F.col("p_name").alias("official"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("snapshot"),
    )
    status = N.snapshot_status(part, F.lit("2024-03-01").cast("date"))
    return status.select(
        F.col("snapshot").cast("string").alias("snapshot"), "names", *_long("age_days"), "stale"
    )


# ------------------------------------------------------------- text units


@query
def word_count(spark, sf):
    return W.documents(spark, sf).select(
        "doc_id", T.word_count(F.col("text")).cast("long").alias("words")
    )


@query
def line_of(spark, sf):
    """Line of the first comma of each document; null without a comma."""
    at = F.instr("text", ",")
    line = F.when(at > 0, T.line_of(F.col("text"), at - 1))
    return W.documents(spark, sf).select("doc_id", line.cast("long").alias("line"))


@query
def lines(spark, sf):
    return U.line_rows(W.documents(spark, sf)).select("doc_id", *_long("line_no"), "line")


@query
def sentences(spark, sf):
    rows = U.sentence_rows(W.documents(spark, sf))
    return rows.select("doc_id", *_long("sentence_no", "words"), "sentence")


@query
def paragraphs(spark, sf):
    """Sentences ended by a line break open a new paragraph."""
    docs = W.documents(spark, sf).withColumn(
        "text", F.replace("text", F.lit(".\n"), F.lit(".\n \n"))
    )
    return U.paragraph_rows(docs).select("doc_id", *_long("paragraph_no"), "paragraph")


@query
def segments(spark, sf):
    docs = W.documents(spark, sf).withColumn(
        "text", F.replace("text", F.lit(" that "), F.lit(", but "))
    )
    return U.segment_rows(docs, LANG).select(
        "doc_id", *_long("sentence_no", "segment_no"), "segment"
    )


@query
def tokens(spark, sf):
    rows = U.token_rows(W.documents(spark, sf))
    return rows.select("doc_id", *_long("token_no", "start"), "token")


@query
def lemmas(spark, sf):
    """Every lemma of the words ending in s: with and without the ending."""
    docs = W.documents(spark, sf)
    words = docs.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token")
    )
    forms = words.select(F.lower("token").alias("form")).distinct().where(F.col("form").endswith("s"))
    table = forms.select(
        "form",
        F.explode(
            F.array_distinct(F.array(F.col("form"), F.regexp_replace("form", "s$", "")))
        ).alias("lemma"),
    )
    return (
        U.lemma_rows(words, table, LANG)
        .groupBy("doc_id", "lemma")
        .agg(F.count("*").alias("n"))
    )


@query
def guessed_lemmas(spark, sf):
    """Lemmas of a third of the word forms, guessed from the endings of the others."""
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    forms = W.documents(spark, sf).select(tokens.alias("form")).distinct()
    plain = F.regexp_replace("form", "(es|en|er|s|e)$", "")
    both = F.when(F.col("form").endswith("s"), F.array("form", plain)).otherwise(F.array(plain))
    table = forms.select("form", F.explode(both).alias("lemma"), (F.substring(F.md5("form"), 1, 1) < "5").alias("held_out"))
    table = stored(table, "lemma-table")
    endings = L.learn_endings(table.where("not held_out"))
    held_out = table.where("held_out")
    right = held_out.select("form", "lemma", F.lit(True).alias("right"))
    guesses = L.guessed_lemmas(held_out, endings).join(right, ["form", "lemma"], "full")
    return guesses.select("form", "lemma", F.coalesce("right", F.lit(False)).alias("right"))


@query
def inflected_names(spark, sf):
    """Part names with each word in another form, found by lemmas; some forms have two."""
    first, second = (F.element_at(F.split("p_name", " "), i) for i in (1, 2))
    docs = W.mentions(
        spark, sf, F.concat(F.lit("Use "), first, F.lit("s "), second, F.lit("es, or "), second, F.lit(" "), first, F.lit("."))
    )
    names = W.names(spark, sf, F.col("p_name"))
    words = names.select(F.explode(F.split("official", " ")).alias("w")).distinct()
    forms = [("w", "w"), ("s", "w"), ("es", "w"), ("s", "s")]
    form = {"w": F.col("w"), "s": F.concat("w", F.lit("s")), "es": F.concat("w", F.lit("es"))}
    pairs = F.array(*[F.struct(form[a].alias("form"), form[b].alias("lemma")) for a, b in forms])
    table = words.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    return L.inflected_names(docs, names, LANG, table)


@query
def headings(spark, sf):
    return U.heading_rows(W.headed(spark, sf), LANG).select("doc_id", *_long("line"), "title")


@query
def masked_text(spark, sf):
    """Headings, quotations and fixed words are blanked without moving anything."""
    docs = W.headed(spark, sf).withColumn(
        "text", F.regexp_replace("text", "(tion)( [a-z]+ )", '$1 "$2" ')
    )
    masked = T.mask_protected(F.col("text"), LANG.heading_words, ["token", "License"], LANG.heading_opening)
    return docs.select(
        "doc_id",
        F.length(masked).cast("long").alias("length"),
        (F.length("text") == F.length(masked)).alias("same_length"),
        F.md5(masked).alias("digest"),
    )


@query
def strip_fence(spark, sf):
    fenced = F.concat(F.lit("\n```text\n"), F.col("text"), F.lit("\n```\n"))
    docs = W.documents(spark, sf)
    return docs.select(
        "doc_id",
        F.md5(T.strip_fence(fenced)).alias("fenced"),
        F.md5(T.strip_fence(F.col("text"))).alias("plain"),
    )


# --------------------------------------------------------------- findings


@query
def compact_findings(spark, sf):
    """JSON of marker findings: empty fields are gone, severity stays."""
    hits = markers.markers(W.documents(spark, sf), RULES)
    out = FN.compact_json(FN.packed(hits))
    return hits.select(
        "doc_id",
        F.get_json_object(out, "$.id").alias("id"),
        F.get_json_object(out, "$.severity").alias("severity"),
        F.get_json_object(out, "$.evidence").alias("evidence"),
        F.get_json_object(out, "$.suggestion").alias("suggestion"),
        F.size(F.json_object_keys(out)).cast("long").alias("fields"),
    )


@query
def checked_findings(spark, sf):
    """Labels read as confidence: values outside [0, 1] go to quarantine."""
    labels = W.table(spark, sf, "labels")
    raw = labels.select(
        "doc_id",
        FN.finding(
            id="label",
            analyzer="labels",
            category="label",
            severity=F.when(F.col("toxic") == 1, "grave").otherwise("review"),
            confidence=F.col("quality") * 0.5 + F.col("toxic"),
            message="label",
        ).alias("f"),
    ).select("doc_id", "f.*")
    good, bad = FN.quarantine(raw)
    return good.withColumn("valid", F.lit(True)).unionByName(
        bad.withColumn("valid", F.lit(False))
    ).select("doc_id", "severity", "confidence", "valid")


@query
def marker_hits(spark, sf):
    hits = markers.markers(W.documents(spark, sf), RULES)
    return hits.select("doc_id", "id", "severity", "confidence", "evidence", *_long("line"))


@query
def length_change(spark, sf):
    pairs = W.edit_pairs(spark, sf)
    return pairs.select(
        "pair_id", T.length_change_pct(F.col("before"), F.col("after")).alias("length_change_pct")
    )


@query
def touched(spark, sf):
    pairs = W.edit_pairs(spark, sf)
    return pairs.select(
        "pair_id", F.round(T.touched_pct(F.col("before"), F.col("after")), 6).alias("touched_pct")
    )


@query
def norm_caveats(spark, sf):
    """Documents of a game with borrowed norms carry a caveat."""
    docs = W.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", "main").otherwise("side").alias("game")
    )
    out = measures.norm_compare(docs, RULES)
    return out.groupBy("game", "caveat").agg(F.count("*").alias("documents"))


@query
def short_documents(spark, sf):
    """The note about documents under the least length of their profile."""
    reports = A.audit(W.headed(spark, sf), RULES)
    return reports.select("doc_id", F.explode_outer("notes").alias("note")).where(
        F.col("note").rlike(r"^\d+ of \d+ words$")
    )


@query
def evidence(spark, sf):
    return W.documents(spark, sf).select(
        "doc_id", T.evidence_trim(F.col("text")).alias("evidence")
    )


# -------------------------------------------------------------- detectors


def _meta(name: str):
    return F.try_element_at("meta", F.lit(name)).cast("long")


def _apostrophes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Part names with an apostrophe, written right, wrong and without it."""
    official = F.concat(F.substring("p_name", 1, 2), F.lit("'"), F.substring("p_name", 3, 99))
    curly = F.replace(official, F.lit("'"), F.lit("’"))
    docs = W.mentions(
        spark,
        sf,
        F.concat(
            F.lit("A "), F.col("p_name"), F.lit(", a "), curly, F.lit(" and a "), official,
            F.lit(". One "), F.col("p_name"), F.lit(" more."),
        ),
    )
    return docs, W.names(spark, sf, official)


@query
def name_apostrophes(spark, sf):
    return N.apostrophe_errors(*_apostrophes(spark, sf))


@query
def name_twins(spark, sf):
    """Official names that differ in an apostrophe only, or lack one: none of them is an error."""
    at = lambda k: F.concat(F.substring("p_name", 1, k), F.lit("'"), F.substring("p_name", k + 1, 99))
    plain = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))
    forms = F.array_compact(F.array(at(2), at(3), plain))
    names = W.table(spark, sf, "part").select(F.explode(forms).alias("official")).distinct()
    docs = W.mentions(
        spark,
        sf,
        F.concat(F.lit("A "), at(2), F.lit(" and a "), at(3), F.lit(" or "), at(1), F.lit(" or "), F.col("p_name"), F.lit(".")),
    )
    return N.apostrophe_errors(docs, names)


@query
def audit_repeated_ids(spark, sf):
    """An audit of documents that share ids in pairs: each keeps its own findings."""
    docs, names = _audit_inputs(spark, sf)
    docs = docs.select((F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), "text")
    return A.audit(docs, RULES, names).select(
        "doc_id",
        "words",
        F.size(F.filter("findings", lambda f: f["analyzer"] == "cards")).cast("long").alias("names"),
        F.size("findings").cast("long").alias("findings"),
    )


@query
def name_dashes(spark, sf):
    """Part names with a spaced dash, written with three kinds of dash."""
    official = F.replace("p_name", F.lit(" "), F.lit(" – "))
    docs = W.mentions(
        spark,
        sf,
        F.concat(
            F.lit("Take "), F.replace("p_name", F.lit(" "), F.lit(" - ")),
            F.lit(" or "), F.replace("p_name", F.lit(" "), F.lit(" — ")),
            F.lit(" or "), official, F.lit("; not "), F.col("p_name"), F.lit("."),
        ),
    )
    return N.dash_errors(docs, W.names(spark, sf, official))


@query
def name_case(spark, sf):
    """Names of three words, one for each part, with wrong capitals inside and at a sentence start."""
    name = F.concat("p_name", F.lit(" k"), "p_partkey")
    official = F.initcap(name)
    docs = W.mentions(
        spark,
        sf,
        F.concat(
            F.lit("We use "), name, F.lit(" here. "),
            F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 99),
            F.lit(" opens. "), F.initcap(name), F.lit(" is right, "),
            F.upper(name), F.lit(" is loud."),
        ),
    )
    return N.case_errors(docs, W.names(spark, sf, official))


@query
def name_typos(spark, sf):
    """Part names with one letter too many, or with a wrong first letter."""
    docs = W.mentions(
        spark,
        sf,
        F.concat(
            F.lit("Use "), F.regexp_replace("p_name", "([a-z]{4})([a-z])", "$1x$2"),
            F.lit(" or z"), F.substring("p_name", 2, 99), F.lit("."),
        ),
    )
    out = N.typo_candidates(docs, W.names(spark, sf, F.col("p_name")), LANG)
    return out.select("doc_id", "was", "official", "n", *_long("edits"))


@query
def common_words(spark, sf):
    return N.common_words(W.documents(spark, sf), LANG, 0.05)


@query
def short_names(spark, sf):
    """One word of a name stands for the whole; common and shared words do not."""
    official = F.concat("p_name", F.lit(" k"), "p_partkey")
    docs = W.mentions(spark, sf, F.concat(F.lit("The k"), "p_partkey", F.lit(" and "), "p_name"))
    common = N.common_words(W.documents(spark, sf), LANG, 0.05)
    return N.short_names(docs, W.names(spark, sf, official), common, LANG)


@query
def spelling_variants(spark, sf):
    """Words spelled with and without a hyphen, two-word names in several cases."""
    found = consistency.spelling_variants(W.hyphenated(spark, sf), RULES)
    return found.select("doc_id", "message", "evidence", "severity", "confidence")


@query
def spelling_variants_strict(spark, sf):
    found = consistency.spelling_variants(W.hyphenated(spark, sf), RULES, True)
    return found.select("doc_id", "message", "evidence")


@query
def case_variants(spark, sf):
    """Two-word names with mixed capitals."""
    docs = W.mentions(
        spark,
        sf,
        F.concat(
            F.lit("See "), F.initcap("p_name"), F.lit(" and "), F.initcap("p_name"),
            F.lit(" or "), F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 99),
            F.lit(" now."),
        ),
    )
    groups = consistency.case_groups(consistency.prose(F.col("text"), LANG), LANG)
    return docs.select("doc_id", F.explode(groups).alias("g")).select(
        "doc_id",
        F.col("g.key").alias("key"),
        F.array_join(
            F.transform("g.forms", lambda f: F.concat_ws("=", f["form"], f["n"])), ";"
        ).alias("forms"),
    )


@query
def advice_conflicts(spark, sf):
    """A part both kept and dropped; advice stays within its own clause."""
    docs = W.mentions(
        spark,
        sf,
        F.concat(
            F.lit(". Keep the "), F.col("p_name"), F.lit(", but drop "), F.reverse("p_name"),
            F.lit(". Drop it all. "),
            F.when(F.length("p_name") > 9, F.concat(F.lit("Later drop "), "p_name")).otherwise(
                F.concat(F.lit("Later keep "), "p_name")
            ),
            F.lit("."),
        ),
    )
    out = consistency.advice_rows(docs, W.names(spark, sf, F.col("p_name")), LANG)
    return out.select("doc_id", "official", "kept", "discarded", "keep_clause")


@query
def declared_counts(spark, sf):
    """A list announced with a number of items that may be wrong."""
    docs = W.documents(spark, sf).withColumn(
        "text",
        F.concat(
            F.lit("Now 5 items:\n- "),
            F.replace("text", F.lit("\n"), F.lit("\n- ")),
            F.lit("\nAlso 2 items:\n1. one\n2) two\nend"),
        ),
    )
    out = consistency.declared_counts(docs, RULES)
    return out.select("doc_id", "severity", "message", *_long("line"))


@query
def profiles_detected(spark, sf):
    return structure.detect_profile(W.headed(spark, sf), RULES)


@query
def profiles_explicit(spark, sf):
    """An explicit profile wins over the guess, and then has no confidence."""
    docs = W.table(spark, sf, "documents").select(
        "doc_id", "text", F.when(F.col("lang") == "de", "brief").alias("choice")
    )
    out = structure.with_profile(docs, RULES, "choice")
    return out.select(
        "doc_id", "profile", "profile_confidence", *_long("min_words"), "require_entities",
        F.size("sections").cast("long").alias("sections"),
    )


@query
def missing_sections(spark, sf):
    out = structure.missing_sections(W.profiled(spark, sf), RULES)
    return out.select(
        "doc_id", "id", "severity", "confidence", "message", "evidence", "suggestion",
        F.coalesce(_meta("corpus_share"), F.lit(-1)).alias("corpus_share"),
    )


@query
def section_order(spark, sf):
    out = structure.section_order(W.profiled(spark, sf), RULES)
    return out.select("doc_id", "id", "severity", *_long("line"))


@query
def section_bodies(spark, sf):
    rows = structure.section_body_rows(W.profiled(spark, sf), RULES)
    return rows.select("doc_id", F.col("id").alias("section_id"), *_long("line"), F.md5("body").alias("body"))


@query
def entity_coverage(spark, sf):
    out = structure.entity_coverage(W.profiled(spark, sf), RULES)
    return out.select("doc_id", "id", "severity", "evidence")


@query
def extraction_artifacts(spark, sf):
    out = markers.extraction_artifacts(W.documents(spark, sf), RULES)
    return out.select("doc_id", F.col("evidence").alias("label"), "severity", _meta("count").alias("n"))


@query
def page_artifacts(spark, sf):
    """Residue left in web pages after their tags are stripped."""
    pages = W.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text")
    )
    out = markers.extraction_artifacts(pages, RULES)
    return out.select("doc_id", F.col("evidence").alias("label"), _meta("count").alias("n"))


@query
def conversation_voice(spark, sf):
    """Voice signals of the turns of a conversation, by speaker."""
    turns = W.table(spark, sf, "conversations").select("role", "text")
    measured = measures.measure(turns, LANG)
    return measured.groupBy("role").agg(
        F.count("*").alias("turns"),
        F.sum("words").alias("words"),
        *[F.sum(F.col(f"voice.{s}.n")).alias(s) for s in SIGNALS],
    )


@query
def term_hits(spark, sf):
    out = markers.term_hits(W.documents(spark, sf), RULES)
    return out.select("doc_id", "id", "category", "evidence", "suggestion", *_long("line"))


@query
def typography_hits(spark, sf):
    out = markers.typography_hits(W.documents(spark, sf), RULES)
    return out.select("doc_id", "id", "message", "evidence", _meta("count").alias("n"))


@query
def variant_counts(spark, sf):
    return markers.variant_counts(W.documents(spark, sf), RULES.terms)


@query
def typography_counts(spark, sf):
    return markers.typography_counts(W.documents(spark, sf), RULES.typography)


@query
def rule_conflicts(spark, sf):
    """Contradictions in the rules against frequencies measured on documents."""
    counts = markers.variant_counts(W.documents(spark, sf), RULES.terms)
    return rulecheck.rule_conflicts(
        rulecheck.terms_table(spark, RULES.terms),
        rulecheck.typography_table(spark, RULES.typography, RULES.typography_decisions),
        counts,
    )


# ------------------------------------------------------------ integrity


@query
def empty_documents(spark, sf):
    out = integrity.record_findings(W.filed(spark, sf), RULES)
    return out.where("id = 'corpus.empty-file'").select("path", "severity", "message")


@query
def missing_fields(spark, sf):
    out = integrity.record_findings(W.filed(spark, sf), RULES)
    return out.where("id = 'corpus.missing-field'").select("path", "severity", "message")


@query
def duplicate_ids(spark, sf):
    """Copies share an identifier: each repeat names the holder before it."""
    out = integrity.duplicate_ids(W.filed(spark, sf), RULES)
    return out.select("path", "id", "previous")


@query
def unknown_genres(spark, sf):
    out = integrity.record_findings(W.filed(spark, sf), RULES)
    return out.where("id = 'corpus.unknown-genre'").select("path", "severity", "message")


@query
def unknown_domains(spark, sf):
    out = integrity.record_findings(W.filed(spark, sf), RULES)
    return out.where("id IN ('corpus.unknown-mode', 'corpus.unknown-status')").select(
        "path", "id", "severity", "message"
    )


@query
def corpus_validation(spark, sf):
    """All integrity findings, counted by kind and severity."""
    return (
        validate_corpus(W.filed(spark, sf), RULES)
        .groupBy("id", "severity")
        .agg(F.count("*").alias("findings"), F.count_distinct("path").alias("documents"))
    )


@query
def corpus_stats(spark, sf):
    return integrity.corpus_stats(W.filed(spark, sf))


@query
def corpus_split(spark, sf):
    """Every fifth identifier in sorted order is held out."""
    ids = W.filed(spark, sf).select(F.try_element_at("meta", F.lit("id")).alias("id"))
    return integrity.split_corpus(ids, 0.2)


@query
def split_sizes(spark, sf):
    """Sizes of the two sides at three shares; no share leaves nothing out."""
    ids = W.table(spark, sf, "documents").select(F.concat("source", F.lit("-"), "lang").alias("id"))
    out = None
    for share in (0.0, 0.1, 0.5):
        part = (
            integrity.split_corpus(ids, share)
            .groupBy("part")
            .agg(F.count("*").alias("ids"))
            .withColumn("share", F.lit(share))
        )
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------- measures


@query
def rhythm(spark, sf):
    out = measures.measure(W.documents(spark, sf), LANG)
    return out.select(
        "doc_id",
        *_long("words", "sentence_count"),
        F.coalesce("rhythm.ratio", F.lit(-1.0)).alias("ratio"),
        F.coalesce("rhythm.mean", F.lit(-1.0)).alias("mean"),
    )


@query
def voice(spark, sf):
    out = measures.measure(W.documents(spark, sf), LANG)
    return out.select(
        "doc_id",
        *[F.col(f"voice.{s}.n").cast("long").alias(s) for s in SIGNALS],
        measures.voice_total(F.col("voice")).alias("voice_per_1k"),
    )


@query
def marker_density(spark, sf):
    """Marker hits per 10 000 words by language."""
    docs = W.table(spark, sf, "documents")
    hits = markers.markers(docs.select("doc_id", "text"), RULES)
    words = docs.select("doc_id", "lang", T.word_count(F.col("text")).alias("words"))
    return measures.marker_density(words, hits, "lang")


def _games(spark, sf) -> DataFrame:
    docs = W.table(spark, sf, "documents")
    return docs.select(
        "doc_id", "text", F.when(F.col("lang") == "en", "main").otherwise("side").alias("game")
    )


@query
def norm_comparison(spark, sf):
    """Mean measures of each game next to its norms."""
    measured = measures.measure(_games(spark, sf), LANG)
    out = measures.norm_compare(measured, RULES)
    return out.groupBy("game", "provisional", "norm_rhythm_ratio", "norm_voice_per_1k").agg(
        F.count("*").alias("documents"),
        F.sum(
            (F.col("rhythm.ratio") < F.col("norm_rhythm_ratio")).cast("long")
        ).alias("below_rhythm"),
        F.sum(
            (measures.voice_total(F.col("voice")) < F.col("norm_voice_per_1k")).cast("long")
        ).alias("below_voice"),
    )


@query
def alarms(spark, sf):
    measured = measures.measure(_games(spark, sf), LANG)
    out = measures.alarms(measures.norm_compare(measured, RULES))
    return out.select(
        "doc_id", "game", F.coalesce("rhythm_alarm", F.lit(False)).alias("rhythm_alarm"),
        F.coalesce("voice_alarm", F.lit(False)).alias("voice_alarm"),
    )


def _scores(spark, sf) -> DataFrame:
    from prosemetrics.plans.scoring import scores

    return scores(W.profiled(spark, sf), RULES)


@query
def author_scores(spark, sf):
    """Six components and the weighted likeness score of every document."""
    return _scores(spark, sf).select(
        "doc_id",
        "profile",
        *[
            F.round(F.coalesce(f"score_{p}", F.lit(-1.0)), 6).alias(p)
            for p in ("voice", "rhythm", "purity", "consistency", "structure")
        ],
        F.round(F.coalesce("score", F.lit(-1.0)), 6).alias("score"),
    )


@query
def score_calibration(spark, sf):
    """Quartiles and minimum of the scores of each profile."""
    scored = _scores(spark, sf).select("profile", "score")
    out = reporting.percentiles(scored, "score", [0.25, 0.5, 0.75], "profile")
    return out.select("profile", "n", *[F.round(c, 6).alias(c) for c in ("minimum", "p25", "p50", "p75")])


@query
def corpus_regression(spark, sf):
    from prosemetrics.plans.scoring import corpus_regression as run

    return run(W.profiled(spark, sf), RULES)


@query
def tighten_hints(spark, sf):
    out = measures.tighten_hints(W.documents(spark, sf), LANG)
    return out.select(
        "doc_id",
        *_long("longest_words", "longest_sentence_no", "impersonal_count"),
        F.md5("longest_sentence").alias("longest_sentence"),
        F.coalesce(F.col("impersonal_line").cast("long"), F.lit(-1)).alias("impersonal_line"),
        F.coalesce("impersonal_phrase", F.lit("")).alias("impersonal_phrase"),
    )


@query
def section_hints(spark, sf):
    """The first required section that a document of its profile lacks."""
    out = measures.tighten_hints(W.profiled(spark, sf), LANG)
    return out.select("doc_id", F.coalesce("missing_section", F.lit("")).alias("missing_section"))


@query
def name_scores(spark, sf):
    """The part of the score that names have: a point less for each wrong one."""
    from prosemetrics.operators.structure import with_profile
    from prosemetrics.plans.scoring import scores

    docs, names = _apostrophes(spark, sf)
    scored = scores(with_profile(docs, RULES), RULES, N.apostrophe_errors(docs, names))
    return scored.select("doc_id", "score_names")


# ---------------------------------------------------------- aggregations


def _small_audit(spark, sf) -> DataFrame:
    """Marker, artifact and section findings in one table."""
    profiled = W.profiled(spark, sf)
    return (
        markers.markers(profiled, RULES)
        .unionByName(markers.extraction_artifacts(profiled, RULES))
        .unionByName(structure.missing_sections(profiled, RULES))
    )


@query
def severity_summary(spark, sf):
    docs = W.documents(spark, sf)
    return reporting.severity_summary(_small_audit(spark, sf), docs)


@query
def worst_severity(spark, sf):
    docs = W.documents(spark, sf)
    out = reporting.worst_severity(_small_audit(spark, sf), docs)
    return out.select("doc_id", F.coalesce("worst", F.lit("")).alias("worst"))


@query
def quality_gate(spark, sf):
    """Exit codes at three thresholds."""
    docs, found = W.documents(spark, sf), _small_audit(spark, sf)
    out = reporting.quality_gates(found, docs, ("error", "likely", "review"))
    return out.select("fail_on", "doc_id", *_long("exit_code"))


@query
def observed_gate(spark, sf):
    """The gate of a whole run at each level, from counts made while findings are written."""
    from prosemetrics.sources import sinks

    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    counts = sinks.write_findings(_small_audit(spark, sf), path)
    rows = [(level, counts[level], sinks.exit_code(counts, level)) for level in FN.SEVERITIES]
    return spark.createDataFrame(rows, "severity string, findings long, exit_code long")


@query
def ordered_findings(spark, sf):
    """Report order: severity, line (missing first), id."""
    out = reporting.order_findings(_small_audit(spark, sf))
    return out.select(
        "doc_id", *_long("position"), "severity", "id",
        F.coalesce("line", F.lit(0)).cast("long").alias("line"),
    )


@query
def archive_audit(spark, sf):
    """Name errors of the whole corpus by kind and pair; some come from extraction."""
    hits = None
    for kind in ("name_apostrophes", "name_dashes", "name_case"):
        part = QUERIES[kind](spark, sf).select(
            F.lit(kind).alias("kind"), "was", "official", "n",
            (F.lit(kind == "name_case") & F.col("was").rlike("^[A-Z ]+$")).alias("from_artifact"),
        )
        hits = part if hits is None else hits.unionByName(part)
    out = reporting.archive_audit(hits)
    return out.select(
        "kind", "from_artifact", F.coalesce("was", F.lit("*")).alias("was"),
        F.coalesce("official", F.lit("*")).alias("official"), "n",
        F.coalesce("pairs", F.lit(-1)).alias("pairs"),
    )


@query
def fitted_norms(spark, sf):
    """Medians of every measure on the calibration and holdout sides."""
    docs = W.documents(spark, sf).withColumn("id", F.md5("text"))
    split = integrity.split_corpus(docs.select("id"))
    measured = measures.measure(docs, LANG).join(split, "id")
    return reporting.fit_norms(measured, "part").select(
        "part", "measure", "n", F.round("minimum", 6).alias("minimum"), F.round("p50", 6).alias("p50")
    )


@query
def labelled_measures(spark, sf):
    """Measures of documents by their quality label."""
    labels = W.table(spark, sf, "labels").select("doc_id", "quality")
    measured = measures.measure(W.documents(spark, sf), LANG)
    return measured.join(labels, "doc_id").groupBy("quality").agg(
        F.count("*").alias("documents"),
        F.sum("words").alias("words"),
        F.sum(measures.voice_n(F.col("voice"))).alias("voice_n"),
    )


@query
def section_share(spark, sf):
    return structure.section_share(W.profiled(spark, sf), RULES)


@query
def heading_variant_share(spark, sf):
    return structure.heading_variant_share(W.profiled(spark, sf), RULES)


@query
def precedent(spark, sf):
    """How documents use the words of the benchmark items, with one example each."""
    items = W.table(spark, sf, "benchmark")
    asked = items.select(F.explode(F.split("text", " ")).alias("word"))
    out = retrieval.precedent(W.documents(spark, sf), asked, 1, "absent")
    return out.select(
        "word", "occurrences", "sentences",
        F.coalesce(F.get("examples", F.lit(0))["doc_id"], F.lit(-1)).alias("example_doc"),
        F.coalesce(F.get("examples", F.lit(0))["sentence"], F.lit("")).alias("example"),
        F.coalesce("note", F.lit("")).alias("note"),
    )


@query
def precedent_counts(spark, sf):
    """No examples asked: counts only, and absent words stay."""
    names = W.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    asked = names.unionByName(W.table(spark, sf, "documents").select(F.col("lang").alias("word")))
    out = retrieval.precedent(W.documents(spark, sf), asked, 0, "absent")
    return out.select("word", "occurrences", F.coalesce("note", F.lit("")).alias("note"))


def _lines_as_paragraphs(docs: DataFrame) -> DataFrame:
    return U.paragraph_rows(docs, breaks="\n")


@query
def echo(spark, sf):
    """Paragraphs of conversations that share rare words with document paragraphs."""
    turns = W.table(spark, sf, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), "text"
    )
    archive = _lines_as_paragraphs(W.documents(spark, sf))
    out = retrieval.echo(_lines_as_paragraphs(turns), archive, RULES, max_df=3)
    return out.select(
        "draft_id", *_long("draft_paragraph", "paragraph_no"), "doc_id", "shared",
        F.array_join("words", " ").alias("words"),
    )


@query
def echo_indexed(spark, sf):
    """The same against an index that the archive was added to in two batches."""
    turns = W.table(spark, sf, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), "text"
    )
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    archive = _lines_as_paragraphs(W.documents(spark, sf))
    for part in (0, 1):
        retrieval.append_archive(archive.where(F.abs("doc_id") % 2 == part), path, f"part{part}", RULES)
    out = retrieval.echo_indexed(_lines_as_paragraphs(turns), path, RULES, max_df=3)
    return out.select(
        "draft_id", *_long("draft_paragraph", "paragraph_no"), "doc_id", "shared",
        F.array_join("words", " ").alias("words"),
    )


@query
def echo_within(spark, sf):
    """The archive against itself: paragraphs of other documents with rare words in common."""
    archive = _lines_as_paragraphs(W.documents(spark, sf))
    out = retrieval.echo(archive, archive, RULES, max_df=3)
    return out.select(
        "draft_id", *_long("draft_paragraph", "paragraph_no"), "doc_id", "shared",
    )


@query
def resolved_rules(spark, sf):
    """Documents with the rule row of their game and profile."""
    docs = W.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "main").otherwise("side").alias("game"),
        F.when(F.col("lang") == "fr", "fr-report").otherwise("brief").alias("profile"),
    )
    out = rulecheck.documents_with_rules(docs, RULES)
    return out.groupBy(
        "game", "profile", "provisional",
        F.array_join("protected", ",").alias("protected"),
        F.array_join(F.transform("replace", lambda r: F.concat_ws(">", r["from"], r["to"])), ",").alias("replace"),
        F.array_join("keep", ",").alias("keep"),
        F.array_join("sections_required", ",").alias("sections"),
        F.element_at("typography", "quotes").alias("quotes"),
    ).agg(F.count("*").alias("documents"))


@query
def skipped_analyzers(spark, sf):
    """What each profile leaves out, over the documents that have it."""
    docs = W.profiled(spark, sf)
    skipped = structure.skipped_analyzers(F.col("analyzers"), A.SWITCHES)
    return docs.groupBy("profile", F.array_join(skipped, ",").alias("skipped")).agg(
        F.count("*").alias("documents")
    )


# ------------------------------------------------------------- edit gate


def _edits(spark, sf) -> DataFrame:
    """Every document under every edit; a document is measured once for all of them."""
    return W.edit_pairs(spark, sf, lambda texts: gate.measured_before(texts, RULES))


def _verdicts(spark, sf, *kinds: str) -> DataFrame:
    return gate.validate_edits(_edits(spark, sf), RULES, kinds or gate.KINDS)


def _violations(spark, sf, kind: str) -> DataFrame:
    return gate.violation_rows(_verdicts(spark, sf, kind))


@query
def voice_lost(spark, sf):
    return _violations(spark, sf, "voice_lost").select("pair_id", "signal", *_long("was", "now"))


@query
def voice_states(spark, sf):
    """State of each signal under each edit: removed, insufficient or kept."""
    rows = gate.measured(_edits(spark, sf), RULES)
    states = F.array(
        *[
            F.struct(
                F.lit(s).alias("signal"),
                gate.classify(
                    F.coalesce(F.col(f"b_voice.{s}.n"), F.lit(0)),
                    F.coalesce(F.col(f"a_voice.{s}.n"), F.lit(0)),
                    F.col("b_words"),
                    F.col("a_words"),
                ).alias("state"),
            )
            for s in SIGNALS
        ]
    )
    return rows.select("edit", F.inline(states)).groupBy("edit", "signal", "state").agg(
        F.count("*").alias("pairs")
    )


@query
def protected_lost(spark, sf):
    return _violations(spark, sf, "protected_lost").select("pair_id", "signal", "message")


@query
def rhythm_flattened(spark, sf):
    return _violations(spark, sf, "rhythm_flattened").select("pair_id")


@query
def text_shrunk(spark, sf):
    return _violations(spark, sf, "text_shrunk").select("pair_id")


@query
def gate_verdicts(spark, sf):
    return _verdicts(spark, sf).select(
        "pair_id",
        "accepted",
        F.array_join(
            F.transform(
                "violations", lambda v: F.concat_ws("/", v["kind"], v["signal"], v["was"], v["now"])
            ),
            ";",
        ).alias("violations"),
        "length_change_pct",
        *[
            F.coalesce(c, F.lit(-1.0)).alias(c)
            for c in ("rhythm_before", "rhythm_after", "voice_before", "voice_after")
        ],
    )


@query
def gate_summary(spark, sf):
    out = gate.gate_summary(_verdicts(spark, sf))
    return out.withColumn("signal", F.coalesce("signal", F.lit("")))


@query
def selected_attempts(spark, sf):
    """First accepted of three edits, else the original with a caveat."""
    out = gate.select_attempt(W.documents(spark, sf), W.attempts(spark, sf), RULES, 3)
    return out.select(
        "doc_id", "accepted",
        F.coalesce("accepted_n", F.lit(0)).cast("long").alias("accepted_n"),
        F.md5("text").alias("text"),
        F.size("attempts").cast("long").alias("attempts"),
        F.coalesce("caveat", F.lit("")).alias("caveat"),
    )


@query
def edit_impact(spark, sf):
    out = reporting.impact_report(gate.measured(_edits(spark, sf), RULES))
    return out.select(
        "pair_id",
        F.round("touched_pct", 6).alias("touched_pct"),
        "length_change_pct",
        *_long("markers_before", "markers_after"),
        *[
            F.coalesce(c, F.lit(-1.0)).alias(c)
            for c in ("rhythm_before", "rhythm_after", "voice_before", "voice_after")
        ],
    )


# ------------------------------------------------------------------ jobs


def _audit_inputs(spark, sf, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Headed documents about a part, and part names with an apostrophe."""
    official = F.concat(F.substring("p_name", 1, 2), F.lit("'"), F.substring("p_name", 3, 99))
    part = W.table(spark, sf, "part").select("p_partkey", "p_name")
    advice = F.concat(
        F.lit(". Keep the "), official, F.lit(". Later drop the "), official,
        F.lit(" and the "), "p_name", F.lit("."),
    )
    docs = (
        (W.headed(spark, sf) if docs is None else docs)
        .join(part, F.col("doc_id") == F.col("p_partkey"), "left")
        .select("doc_id", F.concat("text", F.coalesce(advice, F.lit(""))).alias("text"))
    )
    return docs, W.names(spark, sf, official)


def _report_columns(reports: DataFrame, *extra) -> DataFrame:
    digest = F.transform(
        "findings",
        lambda f: F.concat_ws(
            ":", f["severity"], f["id"], F.coalesce(f["line"], F.lit(0)).cast("string")
        ),
    )
    return reports.select(
        "doc_id",
        "profile",
        *_long("words"),
        F.array_join(digest, "\n").alias("findings"),
        *[
            F.try_element_at("summary", F.lit(s)).cast("long").alias(s)
            for s in FN.SEVERITIES
        ],
        F.coalesce(F.try_element_at("metrics", F.lit("rhythm_ratio")), F.lit(-1.0)).alias("rhythm_ratio"),
        F.coalesce(F.try_element_at("metrics", F.lit("sentence_mean")), F.lit(-1.0)).alias("sentence_mean"),
        F.coalesce(F.try_element_at("metrics", F.lit("voice_per_1k")), F.lit(-1.0)).alias("voice_per_1k"),
        F.array_join("analyzers_skipped", ",").alias("skipped"),
        F.array_join("notes", "\n").alias("notes"),
        *extra,
    )


@query
def audit(spark, sf):
    """The whole audit with a guessed profile: one report row per document."""
    docs, names = _audit_inputs(spark, sf)
    return _report_columns(A.audit(docs, RULES, names))


@query
def analyze(spark, sf):
    """The service variant: a game sets norms, profile and dictionary."""
    docs, names = _audit_inputs(spark, sf)
    langs = W.table(spark, sf, "documents").select("doc_id", "lang")
    docs = docs.join(langs, "doc_id").withColumn(
        "game", F.when(F.col("lang") == "en", "main").otherwise("side")
    )
    return _report_columns(A.analyze(docs, RULES, names), "game", "norms_provisional")


@query
def report_json(spark, sf):
    """Versioned JSON reports, written as text and read back."""
    from prosemetrics.sources.sinks import write_reports
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    docs, names = _audit_inputs(spark, sf)
    write_reports(A.audit(docs, RULES, names), path)
    r = F.col("value")
    return spark.read.text(path).select(
        F.get_json_object(r, "$.schema_version").alias("schema_version"),
        F.get_json_object(r, "$.document").cast("long").alias("doc_id"),
        F.get_json_object(r, "$.profile").alias("profile"),
        F.get_json_object(r, "$.summary.likely").cast("long").alias("likely"),
        F.get_json_object(r, "$.metrics.words").cast("long").alias("words"),
        F.json_array_length(F.get_json_object(r, "$.findings")).cast("long").alias("findings"),
        F.array_join(F.json_object_keys(r), ",").alias("keys"),
    )


@query
def findings_table(spark, sf):
    """Flat findings, written by analyzer and read back."""
    from prosemetrics.sources.sinks import write_findings
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    docs, names = _audit_inputs(spark, sf)
    write_findings(A.findings_of(A.audit(docs, RULES, names)), path)
    return spark.read.parquet(path).groupBy("analyzer", "id", "severity").agg(
        F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents")
    )


def _stream(spark, sf) -> DataFrame:
    from prosemetrics.streaming import jobs

    schema = W.table(spark, sf, "documents").schema
    arriving = jobs.document_stream(spark, f"{sf}/documents.parque[t]", schema)
    return arriving.repartition(spark.sparkContext.defaultParallelism)


def _drained(spark, rows: DataFrame) -> DataFrame:
    """Run a stream over everything that has arrived and read its sink."""
    from prosemetrics.streaming import jobs
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = jobs.start_append(rows, f"{path}/rows", f"{path}/state", available_now=True)
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query
def audit_stream(spark, sf):
    """Documents arriving as files: the same findings as the batch audit."""
    from prosemetrics.streaming import jobs

    text = F.replace(F.concat("text", F.lit("\n")), F.lit(".\n"), F.lit("\n"))
    docs = _stream(spark, sf).select("doc_id", text.alias("text"))
    found = _drained(spark, jobs.findings_stream(docs, RULES))
    return found.select(
        "doc_id", "id", "severity", F.coalesce("line", F.lit(0)).cast("long").alias("line")
    )


@query
def audit_stream_names(spark, sf):
    """Documents arriving as files, with the dictionary: the whole batch audit."""
    from prosemetrics.streaming import jobs
    text = F.replace(F.concat("text", F.lit("\n")), F.lit(".\n"), F.lit("\n"))
    docs, names = _audit_inputs(spark, sf, _stream(spark, sf).select("doc_id", text.alias("text")))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = jobs.start_audit(docs, RULES, names, f"{path}/rows", f"{path}/state", available_now=True)
    run.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(
        "doc_id", "id", "severity", F.coalesce("line", F.lit(0)).cast("long").alias("line")
    )


@query
def verdict_stream(spark, sf):
    """Edit pairs arriving as a stream: verdicts counted by edit.

    A document is measured once for all of its edits.
    """
    from prosemetrics.streaming import jobs

    text = F.col("before")
    edits = F.array(
        *[
            F.struct(F.lit(n).alias("edit"), edit(text).alias("after"))
            for n, edit in W.EDITS.items()
        ]
    )
    texts = gate.measured_before(_stream(spark, sf).select("doc_id", F.col("text").alias("before")), RULES)
    added = [c for c in texts.columns if c not in ("doc_id", "before")]
    pairs = texts.select("*", F.explode(edits).alias("e")).select(
        F.concat_ws("-", "doc_id", "e.edit").alias("pair_id"),
        F.col("e.edit").alias("edit"), "before", F.col("e.after").alias("after"), *added,
    )
    verdicts = _drained(spark, jobs.verdict_stream(pairs, RULES).drop("violations"))
    return verdicts.groupBy("edit", "accepted").agg(F.count("*").alias("pairs"))


@query
def severity_windows(spark, sf):
    """Findings per hour of arrival: tumbling windows under a watermark.

    A finished table is drained, in whatever order its files come: no row of it counts as late.
    """
    from prosemetrics.streaming import jobs

    docs = _stream(spark, sf).select(
        "doc_id", "text", F.timestamp_seconds(F.col("doc_id") * 60).alias("ts")
    )
    ids = W.table(spark, sf, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    span = (ids[1] or 0) - (ids[0] or 0)
    counts = jobs.severity_windows(docs, RULES, lateness=f"{span + 60} minutes")
    path = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    jobs.start_summary(counts, f"{path}/rows", f"{path}/state", True).awaitTermination()
    latest = jobs.read_summary(counts, f"{path}/rows", "window_start", "severity")
    return latest.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "severity",
        "findings",
    )
