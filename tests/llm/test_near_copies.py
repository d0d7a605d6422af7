from __future__ import annotations

import random

import numpy as np
import pytest

from prosemetrics.llm import near_copies as near
from prosemetrics.llm.near_copies import keep_one

from .conftest import SF


def shingles(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def altered(text: str, rng: random.Random, target: float) -> str:
    """The text with words replaced, one here and one there, until it is no more similar than ``target``."""
    words = text.split()
    places = list(range(len(words)))
    rng.shuffle(places)
    for place in places:
        if similarity(text, " ".join(words)) <= target:
            break
        words[place] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def pairs(spark, texts):
    """Whole texts of 60 words or more, each with an altered copy, and its true similarity."""
    rng = random.Random(7)
    whole = sorted({t for _, t in texts if t and len(t.split()) >= 60})
    rng.shuffle(whole)
    out = []
    for i, text in enumerate(whole):
        copy = altered(text, rng, 0.79 + 0.2 * (i + 1) / len(whole))
        out.append((text, copy, similarity(text, copy)))
    return [p for p in out if p[2] >= 0.8]


def bands(found, pairs):
    edges = [0.8, 0.85, 0.9, 0.95, 1.01]
    return [np.mean([f for f, p in zip(found, pairs) if a <= p[2] < b]) for a, b in zip(edges, edges[1:])]


def test_near_copies_are_found(spark, pairs):
    """Recall against brute-force shingle similarity, through the whole operator."""
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept or i for i in range(len(pairs)))
    found = [2 * i + 1 not in kept for i in range(len(pairs))]
    recall = bands(found, pairs)
    print("recall by similarity:", recall, "of", len(pairs))
    assert np.mean(found) >= 0.9 and min(recall) >= 0.85


def test_other_texts_stay(spark, texts):
    """Documents go only if they are similar to another, by their shingles themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in keep_one(docs).collect()}
    gone = [(i, t) for i, t in texts if i not in kept]
    assert gone
    for i, t in gone:
        assert max(similarity(t or "", u or "") for j, u in texts if j != i) >= 0.8
    for i, t in texts:
        assert i not in kept or not any(u == t and j < i for j, u in texts)


def test_shared_passages_do_not_make_copies(spark, texts):
    """Half of the words in common is far from a similarity of 0.8."""
    rng = random.Random(3)
    words = [w for _, t in texts for w in (t or "").split()][:4000]
    passage = " ".join(words[:100])
    rows = [(i, passage + " " + " ".join(rng.choices(words, k=100))) for i in range(60)]
    assert keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60


def test_links_equal_brute_force(spark, monkeypatch):
    """Every pair that one word's budget and the whole distance allow is connected, in parts of any size."""
    monkeypatch.setattr(near, "GROUP_KEYS", 4)
    monkeypatch.setattr(near, "COMPARED", 16)
    monkeypatch.setattr(near, "LEAF", 3)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, (12, near.WORDS), dtype=np.uint32)
    prints = [b for b in base]
    for b in base:
        for flips in rng.integers(5, 90, 8):
            bits = np.unpackbits(b.view(np.uint8))
            bits[rng.choice(near.BITS, flips, replace=False)] ^= 1
            prints.append(np.packbits(bits).view(np.uint32))
    rows = [(i, bytearray(p.tobytes())) for i, p in enumerate(prints)]
    limit = near.bits_for(0.8)
    label = list(range(len(rows)))
    linked = near.links(spark.createDataFrame(rows, "node long, fp binary"), limit).collect()
    found = [(r.a, r.b) for r in linked]
    for r in linked:
        bits = int(np.bitwise_count(prints[r.a] ^ prints[r.partner]).sum())
        assert r.a != r.partner and r.distance == bits <= limit
    want = list(range(len(rows)))
    edges = []
    for i, p in enumerate(prints):
        for j in range(i):
            x = p ^ prints[j]
            if np.bitwise_count(x).sum() <= limit and (np.bitwise_count(x >> np.uint32(8)) <= near.BUDGET).any():
                edges.append((i, j))
    for labels, pairs in ((label, found), (want, edges)):
        for _ in range(len(rows)):
            for a, b in pairs:
                labels[a] = labels[b] = min(labels[a], labels[b])
    assert label == want


def test_bits_of_similarities():
    assert near.bits_for(1.0) == 0
    assert near.bits_for(0.8) < near.bits_for(0.7) < near.BITS // 2


def test_odd_rows(odd, none):
    kept = keep_one(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    ids = [r.doc_id for r in kept.collect()]
    # null, empty and blank texts are copies of each other, as are repeated rows
    assert ids.count(4) == 1 and 0 in ids and 1 not in ids and 2 not in ids
    assert len(ids) == len(set(ids))
    assert keep_one(none).count() == 0


def test_null_ids_come_last(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (None, "x")]
    kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == [(5, "a b c d e f"), (None, "x")]


def test_a_partner_behind_a_closer_false_one_is_found(spark):
    """The pair a and b is similar; by their bits, each has a closer partner that is not."""
    rng = random.Random(5)
    a = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))

    def bits(x: str, y: str) -> int:
        return int(np.bitwise_count(near.fingerprint(x) ^ near.fingerprint(y)).sum())

    def met(x: str, y: str) -> bool:
        keys = (near.fingerprint(x) ^ near.fingerprint(y)) >> np.uint32(near.WORD_BITS - near.KEY_BITS)
        return int(np.bitwise_count(keys).min()) <= near.BUDGET and bits(x, y) <= near.bits_for(0.8)

    def copies(x: str, target: float) -> list[str]:
        made = [altered(x, rng, target) for _ in range(60)]
        return sorted((y for y in made if met(x, y)), key=lambda y: bits(x, y))

    b = [y for y in copies(a, 0.81) if similarity(a, y) >= 0.8][-1]
    c, d = ([y for y in copies(x, 0.795) if similarity(x, y) < 0.8][0] for x in (a, b))
    assert bits(a, c) < bits(a, b) > bits(b, d)
    rows = list(enumerate([a, b, c, d], 1))
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_texts_with_similar_ones_equal_brute_force(spark, monkeypatch):
    """Texts that are asked for, in sets that are dealt in many parts."""
    monkeypatch.setattr(near, "GROUP_KEYS", 3)
    rng = random.Random(11)
    bases = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(3)]
    rows = [(10 * k + i, k, i % 3 != 0, altered(b, rng, 0.86 + 0.01 * i)) for k, b in enumerate(bases) for i in range(10)]
    rows += [(100, 5, True, "alone"), (101, 6, True, None), (102, 6, True, " \n")]
    # similar to texts of another set
    rows.append((103, 7, True, bases[0]))
    frame = spark.createDataFrame(rows, "node long, label long, asked boolean, text string")
    found = {r.node for r in near.with_similar(frame, 5, 0.8).collect()}
    want = {n for n, k, asked, t in rows if asked and any(m != n and j == k and similarity(t or "", u or "") >= 0.8 for m, j, _, u in rows)}
    assert found == want and want != {n for n, _, asked, _ in rows if asked}


def test_pairs_of_a_crowd_are_never_rows(spark, monkeypatch):
    """A crowd of texts that are near each other by their bits, and of which no two are similar."""
    rng = random.Random(13)
    base = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    rows = [(i, altered(base, rng, 0.865)) for i in range(60)]
    rows = [r for r in rows if all(similarity(r[1], t) < 0.8 for i, t in rows if i != r[0])]
    counted = []
    kept_step = near.stored

    def stored(df, label):
        step = kept_step(df, label)
        if label in ("near-pairs", "near-asked", "near-sets", "near-set-texts"):
            counted.append(step.count())
        return step

    monkeypatch.setattr(near, "stored", stored)
    assert keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert len(rows) > 30 and len(counted) >= 2 and max(counted) <= len(rows)
