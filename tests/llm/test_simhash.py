from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prosemetrics.llm import simhash
from prosemetrics.llm.queries import op1_simhash
from prosemetrics.llm.tries import linked

from .conftest import SF


def plain(text: str | None) -> int:
    """The fingerprint, word for word as it is defined."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(keys: list[int], budget: int = 4) -> list[int]:
    """Places of the first key that each key is linked with."""
    label = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(keys):
            for j, b in enumerate(keys):
                if (a ^ b).bit_count() <= budget and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_query_matches_brute_force(spark, texts):
    rows = {r.doc_id: r for r in op1_simhash(spark, SF).collect()}
    prints = [plain(t) for _, t in texts]
    ids = [i for i, _ in texts]
    assert len(rows) == len(ids)
    for i, p, first in zip(ids, prints, classes(prints)):
        assert (rows[i].fingerprint, rows[i].component_id) == (f"{p:016x}", ids[first])


def test_tries_find_all_links():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = set(centres.tolist())
    for centre in centres.tolist():
        for _ in range(20):
            bits = rng.choice(64, rng.integers(1, 8), replace=False)
            keys.add(centre ^ sum(1 << int(b) for b in bits))
    ordered = np.array(sorted(keys), dtype=np.uint64)
    whole = np.array([[0], [len(ordered)], [0], [len(ordered)], [0]])
    label = list(range(len(ordered)))
    for a, b in linked(ordered, whole, 0, 4):
        label[a] = b
    assert label == classes(ordered.tolist())


def test_rotations_and_tiles(spark, monkeypatch):
    """Large tries are dealt in parts; no link between parts may be lost."""
    monkeypatch.setattr(simhash, "TRIE_KEYS", 8)
    rng = np.random.default_rng(5)
    crowd = {int(x) for x in rng.integers(0, 2**12, 150)} | {int(x) for x in rng.integers(0, 2**63, 50)}
    keys = sorted(crowd)
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, fp long")
    got = {r.fp: r.smallest for r in simhash.classes(frame, 4).collect()}
    assert [got[k] for k in keys] == classes(keys)


@pytest.mark.parametrize("runs", [5, 6, 7])
def test_any_number_of_runs_finds_all_links(spark, runs):
    rng = np.random.default_rng(runs)
    keys = {int(x) for x in rng.integers(-(2**63), 2**63, 60)}
    for k in list(keys):
        flips = [int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False)]
        keys.add(k ^ sum(1 << b for b in flips))
    ordered = sorted(keys)
    frame = spark.createDataFrame([(k,) for k in ordered], "fp long")
    label = {k: i for i, k in enumerate(ordered)}
    pairs = [(r.a, r.b) for r in simhash.links(frame, 4, runs).collect()]
    for _ in ordered:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert [label[k] for k in ordered] == classes([k % 2**64 for k in ordered])


def test_more_keys_get_more_runs():
    assert [simhash.runs_for(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**13)] == [5, 5, 6, 7, 8]
    for order in simhash.turns(4, 7):
        keys = np.array([1, 2**63, 0x0123456789ABCDEF], dtype=np.uint64)
        assert sorted(to for _, _, to in order.moves)[0] == 0 and sum(w for _, w, _ in order.moves) == 64
        assert order.restored(keys).dtype == np.uint64


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert simhash.near_duplicates(none).count() == 0
    blank = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert blank == {0}


def test_keep_one(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 0 in ids and 1 not in ids
    groups = simhash.near_duplicates(odd).select("component_id").distinct().count()
    assert len(ids) == groups
    assert simhash.keep_one(none).count() == 0


def test_long_path_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    from prosemetrics.llm.components import components

    assert components(edges).groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect() == [(0, 301), (1000, 2)]
