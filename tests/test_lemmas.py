"""Guessed lemmas, names under inflection, near misses, percentiles: against plain versions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import lemmas as L
from prosemetrics.operators import names as N
from prosemetrics.operators import reporting
from prosemetrics.packs import latin, russian

TABLE = [
    ("бранном", "бранный"), ("бранном", "бранном"), ("славном", "славный"), ("дивном", "дивный"),
    ("мастера", "мастер"), ("мастера", "мастера"), ("щита", "щит"), ("брони", "броня"), ("броня", "броня"),
    ("ярость", "ярость"), ("боевую", "боевой"), ("боевая", "боевой"), ("чиста", "чистый"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE, "form string, lemma string")


def test_all_lemmas_of_the_longest_known_ending(spark, table):
    """An unknown form gets every rewrite that its longest ending is known for."""
    endings = L.learn_endings(table)
    forms = spark.createDataFrame([("Главном",), ("ном",), ("сом",), ("xyz",), (None,)], "form string")
    got = {(r.form, r.lemma) for r in L.guessed_lemmas(forms, endings).collect()}
    # the root of the tree, the empty ending, knows forms that are their own lemmas
    assert got == {("главном", "главный"), ("ном", "ном"), ("сом", "сом"), ("xyz", "xyz")}
    learnt = {(r.ending, r.cut, r["add"]): r.forms for r in endings.collect()}
    assert learnt[("ном", 2, "ый")] == 3 and ("чиста", 1, "ый") not in learnt


def plain_guess(table, form, least=2, longest=5, stem=2):
    rules: dict = {}
    for f, lemma in set(table):
        shared = max(i for i in range(min(len(f), len(lemma)) + 1) if f[:i] == lemma[:i])
        for n in range(len(f) - shared, longest + 1):
            if n <= len(f) - stem:
                rules.setdefault((f[len(f) - n :], len(f) - shared, lemma[shared:]), set()).add(f)
    for n in range(min(longest, len(form) - stem), -1, -1):
        found = {form[: len(form) - cut] + add for (e, cut, add), fs in rules.items() if e == form[len(form) - n :] and len(fs) >= least and len(e) == n}
        if found:
            return found
    return set()


def test_guesses_equal_a_plain_version(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        stem = "".join(rng.choices("abcdr", k=rng.randint(1, 6)))
        form, lemma = rng.choice([("ing", ""), ("ing", "e"), ("ies", "y"), ("s", ""), ("s", "s"), ("er", "er"), ("est", "")])
        pairs.append((stem + form, stem + lemma))
    known, unknown = pairs[:200], sorted({f for f, _ in pairs[200:]} | {"a", "as", "ing"})
    endings = L.learn_endings(spark.createDataFrame(known, "form string, lemma string"))
    got: dict = {}
    for r in L.guessed_lemmas(spark.createDataFrame([(f,) for f in unknown], "form string"), endings).collect():
        got.setdefault(r.form, set()).add(r.lemma)
    assert {f: got.get(f, set()) for f in unknown} == {f: plain_guess(known, f) for f in unknown}


def test_held_out_forms(spark):
    """Recall of a third of a regular table that the endings were not learnt from."""
    stems = ["".join(p) for p in itertools.product("bdgkmprt", "aeiou", "dgkmpt")]
    rows = [(s + e, s + "ar") for s in stems for e in ("o", "as", "amos", "aban")] + [(s + "as", s + "a") for s in stems]
    frame = spark.createDataFrame(rows, "form string, lemma string").withColumn("out", F.crc32("form") % 3 == 0)
    guesses = L.guessed_lemmas(frame.where("out"), L.learn_endings(frame.where("not out")))
    truth = frame.where("out").select("form", "lemma")
    assert guesses.join(truth, ["form", "lemma"]).count() == truth.count() == guesses.count()


def test_known_and_guessed_together(spark, table):
    tokens = spark.createDataFrame([("Щита",), ("Главном",)], "token string")
    rows = {(r.form, r.lemma) for r in L.all_lemmas(tokens, table, L.learn_endings(table)).collect()}
    assert {("щита", "щит"), ("главном", "главный")} <= rows


NAMES = ["Мастер брони", "Боевая ярость", "Щит", "Мастер", "Мастер брони севера"]


def test_names_in_mixed_cases(spark, table, docs):
    names = spark.createDataFrame([(n,) for n in NAMES], "official string")
    texts = docs(
        "Оставляйте Мастера брони, но сбрасывайте Боевую ярость.",
        "Мастера, брони нет. Боевую. Ярость брони мастера",
        "МАСТЕРА брони севера и мастера брони мастера брони",
        "",
        None,
    )
    got = {(r.doc_id, r.official, r.was, r.n) for r in L.inflected_names(texts, names, russian.RULES.language, table).collect()}
    assert got == {
        ("0", "Мастер брони", "Мастера брони", 1), ("0", "Боевая ярость", "Боевую ярость", 1),
        ("2", "Мастер брони", "МАСТЕРА брони", 1), ("2", "Мастер брони", "мастера брони", 2),
        ("2", "Мастер брони севера", "МАСТЕРА брони севера", 1),
    }
    none = names.limit(0)
    assert L.inflected_names(texts, none, russian.RULES.language, table).count() == 0


def test_alternatives_do_not_multiply(spark, docs):
    """Ten words of four lemmas each: a million readings, one path."""
    words = [f"w{i}" for i in range(10)]
    table = spark.createDataFrame([(f"{w}x", f"{w}{c}") for w in words for c in ("", "a", "b", "c")] + [(w, f"{w}{c}") for w in words for c in ("", "a", "b", "c")], "form string, lemma string")
    names = spark.createDataFrame([(" ".join(words),)], "official string")
    got = L.inflected_names(docs(" ".join(f"{w}x" for w in words)), names, latin.RULES.language, table).collect()
    assert [(r.official, r.n) for r in got] == [(" ".join(words), 1)]


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_segments_miss_no_near_word(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("ab", k=rng.randint(2, 11))) for _ in range(160)}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    allowed = lambda n: F.least(F.lit(most), F.floor(n / 4).cast("int"))
    left = frame.select(F.col("w").alias("a"), F.explode(N.probe_segments(F.col("w"), most, allowed)).alias("k"))
    right = frame.select(F.col("w").alias("b"), F.explode(N.name_segments(F.col("w"), most)).alias("k"))
    found = {(r.a, r.b) for r in left.join(right, "k").select("a", "b").distinct().collect()}
    near = {(a, b) for a in words for b in words if a != b and edits(a, b) <= min(most, max(len(a), len(b)) // 4)}
    assert near and near <= found


def test_keys_do_not_grow_with_the_word(spark):
    frame = spark.createDataFrame([("abcdefghij" * k,) for k in (1, 10, 100)], "w string")
    allowed = lambda n: F.least(F.lit(2), F.floor(n / 4).cast("int"))
    sizes = [r[0] for r in frame.select(F.size(N.probe_segments(F.col("w"), 2, allowed))).collect()]
    assert max(sizes) <= 19


def plain_percentile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, share = math.floor(at), at - math.floor(at)
    return values[low] * (1 - share) + values[math.ceil(at)] * share


def test_percentiles_equal_sorting(spark):
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(0, 1, 501).tolist(),
        "wide": (10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400)).tolist(),
        "near": (1 + np.arange(100) * 2.0**-52).tolist(),
        "equal": [0.1] * 50,
        "zeros": [0.0, -0.0, 5e-324, -5e-324],
        "one": [7.25],
        None: [1.0, 2.0, 4.0],
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("nulls", None)]
    points = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r for r in reporting.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", points, "g").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        row = got[g]
        assert (row.n, row.minimum) == (len(values), min(values))
        assert [row[f"p{round(100 * p)}"] for p in points] == [plain_percentile(values, p) for p in points]


def test_percentiles_of_nothing(spark):
    assert reporting.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_percentiles_work_a_measure_out_once(spark):
    """The filter of nulls must not be pushed below the measure's steps, which would run once more for it."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measure(i):
        calls.add(1)
        return None if i % 4 == 3 else float(i)

    rows = spark.range(0, 40, numPartitions=2).select((F.col("id") % 2).alias("g"), measure("id").alias("v"))
    got = {r.g: r for r in reporting.percentiles(rows, "v", [0.5], "g").collect()}
    assert calls.value == 40
    assert [(got[g].n, got[g].minimum, got[g].p50) for g in (0, 1)] == [(20, 0.0, 19.0), (10, 1.0, 19.0)]


def test_bits_keep_the_order(spark):
    values = [-math.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf, math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bits = [r.b for r in rows.select("i", reporting.ordered_bits(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bits == sorted(bits) and len(set(bits)) == len(bits)


def test_few_files_are_dealt_over_all_tasks(spark, tmp_path):
    """One row group in one file: no task may get it whole, whatever a union does to the splits."""
    from workloads import tables as W

    spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"),
        F.lit("src0").alias("source"), F.lit(9).cast("long").alias("n_chars"),
    ).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = W.filed(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(rows) == cores and max(r["count"] for r in rows) < 2 * 2040 / cores
