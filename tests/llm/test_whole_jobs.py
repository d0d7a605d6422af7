"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np
import pytest

from prosemetrics.llm import pii, quality_rules as rules


def test_context_refuses_valid_formats(spark):
    texts = [(i, f"mail u{i}@h.org card 4111 1111 1111 1111 tel +1 (743) 555-38{i:02d}") for i in range(40)]
    wrong = {
        100: "see serial number: 001-2024-0512-1031 on the box",
        101: "the order 4111.1111.1111.1111 was sent",
        102: "part (743) 555-3824 fits",
    }
    right = {
        200: ("call 0044 20 7946 0958 now", "phone:5:22"),
        201: ("write to jo [at] host [dot] org", "email:9:31"),
        202: ("my card 4111.1111.1111.1111 is", "card:8:27"),
        203: ("order by phone 0044 20 7946 0958", "phone:15:32"),
    }
    rows = [*texts, *wrong.items(), *((i, t) for i, (t, _) in right.items())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    assert {i: got[i] for i in wrong} == dict.fromkeys(wrong, "")
    assert {i: got[i] for i in right} == {i: spans for i, (_, spans) in right.items()}
    out = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert {i: out[i] for i in wrong} == wrong


def test_contexts_are_learnt_from_checksums(spark):
    """Dotted numbers in brackets mostly fail the card checksum; one that passes is still none."""
    texts = [(i, f"card 4111 1111 1111 1111 or 4111.1111.1111.1111 {i}") for i in range(40)]
    texts += [(100 + i, f"lot x4111.1111.1111.11{i:02d} of grain") for i in range(12, 52)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    assert all(rows[i].count("card") == 2 for i in range(40))
    assert all(rows[100 + i] == "" for i in range(12, 52))


def test_no_host_no_address(spark):
    frame = spark.createDataFrame([(1, "a@b.org"), (2, "we met (at) 5.30")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.personal_data(frame).collect()} == {1: "email:0:7", 2: ""}


def test_no_label_no_added_span(spark):
    frame = spark.createDataFrame([(1, "call 0044 20 7946 0958"), (2, "jo [at] host [dot] org")], "doc_id long, text string")
    assert {r.spans for r in pii.personal_data(frame).collect()} == {""}


@pytest.mark.parametrize(("share", "spread"), [(0.35, 0.3), (0.45, 0.3), (1 / 3, 0.0)])
def test_much_junk_and_copies_do_not_move_estimates(spark, share, spread):
    rng = np.random.default_rng(7)
    n = int(2000 * share)
    x = np.concatenate([rng.normal(0, 0.3, (2000 - n, rules.DIMS)), 5 + rng.normal(0, 1, (n, rules.DIMS)) * spread])
    frame = spark.createDataFrame([("en", "s", r.tolist()) for r in x], "group_lang string, group_source string, x array<double>")
    model = rules.mcd_models(frame).collect()[0]
    off = x - np.array(model.centre)
    d2 = np.einsum("ij,jk,ik->i", off, np.array(model.inverse).reshape(rules.DIMS, -1), off)
    cutoff = rules.chi2_quantile(1 - 1 / rules.CUTOFF_ODDS, rules.DIMS)
    assert (d2[-n:] > cutoff).all() and (d2[:-n] <= cutoff).mean() > 0.99


def test_no_jump_at_any_group_size(spark):
    """A row more changes an estimate by little, wherever the group's size stands."""
    rng = np.random.default_rng(11)
    other = rng.normal(0, 0.3, (900, rules.DIMS))
    own = rng.normal(1, 0.2, (201, rules.DIMS))
    centres = {}
    for n in (1, 2, 199, 200, 201):
        rows = [("en", "big", x.tolist()) for x in other] + [("en", "own", x.tolist()) for x in own[:n]]
        frame = spark.createDataFrame(rows, "lang string, source string, x array<double>")
        models = {r.group_source: r for r in rules.shrunk_models(frame).collect()}
        centres[n] = np.array(models["own"].centre)
        assert np.abs(np.array(models["big"].centre)).max() < 0.15
    assert np.abs(centres[200] - centres[199]).max() < 0.02 and np.abs(centres[201] - centres[200]).max() < 0.02
    assert np.abs(centres[1]).max() < 0.2 and 0.4 < centres[200].mean() < 0.9


def test_invalid_rows_do_not_stand_for_an_id(spark):
    from pyspark.sql import functions as F

    from prosemetrics.llm import topk

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [nan, 0.0]), (0, [inf, 0.0]), (0, None), (0, [None, 9.0]), (1, [3.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") == 0, 10, scale=1.0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 5)]
    clash = frame.withColumns({c: F.lit("x") for c in ("id", "v", "q", "block", "lane", "score")})
    assert topk.top_k(clash, F.col("vec_id") == 0, 10, scale=1.0).count() == 1


def test_rows_of_one_id_lie_apart(spark):
    """Ten thousand rows without an id, or of one, fall into many parts of their leaf's order."""
    from pyspark.sql import functions as F

    from prosemetrics.llm import mixing

    mixture = mixing.Mixture(domains={}, domain_weights={}, lang_weights={}, source_weights={}, share_pct=50, epochs=1, seed=1)
    rows = spark.range(10_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"),
    )
    slim = mixing.described(rows, mixture, F.monotonically_increasing_id(), "doc_id", "text", "lang", "source")
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_hash"))
    part = F.substring(mixing._place(1, F.lit(1), key), 1, mixing.PART_DIGITS)
    largest = slim.groupBy(part).count().agg(F.max("count")).first()[0]
    assert largest < 20
    assert mixing.mixed_ids(rows, mixture).count() == 5000
