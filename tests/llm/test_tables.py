"""URL filter, shards, search, personal data and mixing."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemetrics.llm import pii, topk
from prosemetrics.llm.mixing import Mixture, mix, mixed_ids
from prosemetrics.llm.queries import (
    MIXTURE,
    ORACLES,
    QUERIES,
    URL_POLICY,
    op6_sharding,
    op9_personal_data,
)
from prosemetrics.llm.sharding import jump_hash, shards
from prosemetrics.llm.url_filter import Vocabulary, term_counter, url_verdicts

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    twin = con.sql(ORACLES[name])
    rows = QUERIES[name](spark, SF).select(*twin.columns).collect()
    as_text = lambda r: tuple(map(str, r))
    assert sorted(map(as_text, rows)) == sorted(map(as_text, twin.fetchall()))


# -- URLs --------------------------------------------------------------------------------------


def test_terms_need_boundaries():
    count = term_counter(Vocabulary(strict=("casino", "win-big"), soft=("ads", "free")))
    assert count("http://Casino.example/") == (1, 0)
    assert count("http://casinos.example/x-ads_free/ads") == (0, 2)
    assert count("http://a/win-big") == (1, 0)
    assert count("http://loads.example/freed") == (0, 0)
    assert count(None) == (0, 0)


def test_url_rules(spark):
    urls = {
        "HTTP://WWW.Example.NET/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/en": ("example.net", "/en", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://planet/": ("planet", "/", None, "allow"),
        "http://a.example.com/de/x?y": ("a.example.com", "/de/x", "example.com/de/", "block"),
        "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"),
        "http://casino.org/fr/#z": ("casino.org", "/fr/", "org/fr/", "allow"),
        "http://casino.org/es/": ("casino.org", "/es/", None, "block"),
        "http://a.org/cheap/ads": ("a.org", "/cheap/ads", None, "block"),
        "http://a.org/cheap/cheap": ("a.org", "/cheap/cheap", None, "allow"),
        "http://a.org?x=http://b.net/": ("a.org", "", None, "allow"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x\ny://h/\np": ("h", "/\np", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(None, None, "c")], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_verdicts(pages, URL_POLICY).collect()}
    for i, want in enumerate(urls.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == want
    assert None in rows
    assert url_verdicts(pages.limit(0), URL_POLICY).count() == 0


# -- Shards ------------------------------------------------------------------------------------


def jump(key: int, n: int) -> int:
    key, at, after = key % 2**64, -1, 0
    while after < n:
        at = after
        key = (key * 2862933555777941757 + 1) % 2**64
        after = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_jump_hash(spark):
    rnd = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rnd.randrange(-(2**63), 2**63) for _ in range(300))]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 23, 24, 25, 1000):
        at, grown = jump_hash(F.col("k"), n)
        for r in frame.select("k", at.alias("at"), grown.alias("grown")).collect():
            assert (r["at"], r["grown"]) == (jump(r.k, n), jump(r.k, n + 1))
    with pytest.raises(ValueError):
        jump_hash(F.col("k"), 0)


def full_shards(rows) -> bool:
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_query(spark, texts):
    rows = op6_sharding(spark, SF).collect()
    assert full_shards(rows) and len(rows) == len(texts)
    text_of = dict(texts)
    for r in rows:
        raw = text_of[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9))


def test_sharding_odd_rows(spark, odd, none):
    rows = shards(odd).collect()
    assert len(rows) == odd.count() and full_shards(rows)
    assert all((r.size, r.text_crc32) == (1, 0) for r in rows if r.doc_id == 0)
    assert shards(none).count() == 0
    names = shards(spark.createDataFrame([("a", "x"), (None, None)], "doc_id string, text string"))
    assert full_shards(names.collect())


# -- Search ------------------------------------------------------------------------------------


def test_search_in_small_blocks(spark, monkeypatch):
    """Ties, repeated ids, invalid rows and mixed dimensions, over many blocks."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(400)]
    rows += [(400, None), (500, [1.0, None] * 3), (600, [float("nan")] * 6), (700, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(800, [1.0, 2.0]), (801, [3.0, 4.0]), (7, rows[7][1]), (900, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    got: dict = {}
    for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, 10, scale=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    valid = [(i, v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, v in valid:
        if q % 100:
            continue
        scored = sorted((-int(np.dot(v, w)), i) for i, w in valid if i != q and len(w) == len(v))[:10]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert set(got) == {0, 100, 200, 300, 800}
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        topk._products(np.array([[2.0**40]]), np.array([[2.0**40]]), 2.0**80)
    exact = topk._products(np.array([[2.0**30 + 1]]), np.array([[2.0**30 + 1]]), 2.0**61)
    assert int(exact[0, 0]) == (2**30 + 1) ** 2


# -- Personal data -----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def allowed(kind: str, value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def base_spans(text: str | None) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if allowed(k, m[0])]


def same_base(rows, texts) -> None:
    for i, t in texts:
        want, r = base_spans(t), rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_personal_data_query(spark, texts):
    rows = {r.doc_id: r for r in op9_personal_data(spark, SF).collect()}
    assert len(rows) == len(texts)
    same_base(rows, texts)
    assert all(r.spans == "" for i, r in rows.items() if not re.search(r"[0-9@]", dict(texts)[i]))


def test_personal_data_on_strange_texts(spark):
    parts = [*"ab1234567890.@- +_%()é😀", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "a@b.c", "+1 (23) 456-7890", "[at]", "0044 20 7946 0958"]
    rnd = random.Random(9)
    texts = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(50)))) for i in range(1200)]
    texts += [(1200, None), (1201, "5 " * 20_000), (1202, "1.1.1.1 " * 800), (1203, "a@b.c, " * 800)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    same_base({r.doc_id: r for r in pii.personal_data(frame).collect()}, texts)


def test_trees_add_spans(spark):
    texts = [(i, f"mail u{i}@h.org ip 10.0.0.{i} card 4111 1111 1111 1111 tel +1 (743) 555-38{i:02d}") for i in range(40)]
    texts += [(100 + i, f"no 4111 1111 1111 11{i:02d} and 300.1.1.{i}") for i in range(2, 40)]
    texts += [(200, "write to jo [at] host [dot] org or (743) 555-3824"), (201, "a clean text of 12 words, 3.5 percent, 2020-10-11")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    assert rows[200] == "email:9:31,phone:35:49" and rows[201] == ""
    assert rows[5].count(",") == 3
    out = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert out[200] == "write to <email> or <phone>" and out[201] == texts[-1][1]
    assert out[5] == "mail <email> ip <ip> card <card> tel <phone>"


def test_personal_data_odd_rows(odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count()
    assert [r.spans.count(",") for r in rows if r.doc_id == 4] == [3, 3, 3]
    out = pii.redact(odd)
    assert out.columns == odd.columns
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[0].text is None and by_id[4].text == "Mail me: <email>, card <card>, <phone>, <ip>" and by_id[4].n_chars == 44
    assert pii.personal_data(none).count() == 0 and pii.redact(none).count() == 0


# -- Mixing ------------------------------------------------------------------------------------


def test_shortage_goes_to_siblings_first(spark):
    rows = []
    for source, lang, n in (("a", "en", 10), ("b", "en", 400), ("c", "de", 400), ("d", "en", 400)):
        rows += [(len(rows) + k, "w", lang, source, 1) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixture = Mixture(domains={"a": "x", "b": "x", "c": "x", "d": "y"}, share_pct=50, epochs=1)
    got = {r.source: r.leaf_budget for r in mixed_ids(docs, mixture).select("source", "leaf_budget").distinct().collect()}
    # 605 tokens: 302 for each domain, 151 for each language of x; a has 10, so b gets what a lacks.
    assert got == {"a": 10, "b": 141, "c": 151, "d": 302}
    taken = Counter(r.source for r in mixed_ids(docs, mixture).collect())
    assert taken == got


def test_epochs_repeat_and_order_is_seeded(spark):
    docs = spark.createDataFrame([(i, "a b", "en", "s", 3) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    more = mixed_ids(docs, Mixture(share_pct=150, epochs=2)).collect()
    assert Counter(r.epoch for r in more) == {1: 50, 2: 25}
    pick = lambda seed: {r.doc_id for r in mixed_ids(docs, Mixture(share_pct=50, epochs=1, seed=seed)).collect()}
    assert pick(1) == pick(1) and len(pick(1)) == 25 and pick(1) != pick(2)


def test_mix_returns_rows(odd, none):
    out = mix(odd, Mixture(share_pct=100, epochs=1))
    assert out.columns == odd.columns
    key = lambda r: str(r)
    assert set(map(key, out.collect())) <= set(map(key, odd.collect()))
    assert mix(none, MIXTURE).count() == 0 and mixed_ids(none, MIXTURE).count() == 0
    assert mixed_ids(odd, Mixture(share_pct=0)).count() == 0
