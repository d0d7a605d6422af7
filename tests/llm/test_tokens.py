from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from prosemetrics.llm.arrow import slabs
from prosemetrics.llm.packing import encoder, pack, supersteps
from prosemetrics.llm.queries import op4_token_counts, op8_packing
from prosemetrics.llm.token_counts import token_counts
from prosemetrics.llm.transducer import CountTransducer

from .conftest import ODD_TEXTS, SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def machine():
    return CountTransducer(PATH)


def strange(n: int) -> list[str]:
    parts = ["a", "s", "t", "re", "ve", "ll", "d", "'", "' ", "  ", "\n", "\t", " ", "1", "22", "!", "$$", "é", "ß", "日本", "😀"]
    parts += ["I'm", "they're", "<|endoftext|>", "　", "\xa0", "\x1c", "'s'", "''s", "tion", "Ᲊ", "Ɤ", "²", "é"]
    rnd = random.Random(7)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(n)]


def counted(machine, texts: list[str]) -> list[int]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return machine.count(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets).tolist()


def test_transducer_counts_like_the_library(machine, library):
    texts = [*strange(1500), "", "x" * 3000, "ab" * 700 + " " * 300, "7" * 1000, "<|endoftext|>" * 3]
    assert counted(machine, texts) == [len(library(t)) for t in texts]


def test_counts_survive_forgetting(machine, library, monkeypatch):
    monkeypatch.setattr("prosemetrics.llm.transducer.MAX_STATES", 10)
    for text in strange(30):
        assert counted(machine, [text]) == [len(library(text))]


def test_chunks_compose(machine, library, monkeypatch):
    text = "".join(strange(60))
    for size in (1, 3, 17, 100_000):
        monkeypatch.setattr("prosemetrics.llm.transducer.CHUNK", size)
        assert counted(machine, [text]) == [len(library(text))]


def test_slabs_cut_long_texts_safely(machine, library):
    texts = [None, "", "a bc d1 ef " * 50, "ééé" * 40, "ab cd"]
    total = np.zeros(len(texts), dtype=np.int64)
    for rows, data, offsets in slabs(pa.array(texts), 37):
        np.add.at(total, rows, machine.count(data, offsets))
    assert total.tolist() == [len(library(t)) for t in texts]
    sliced = pa.array(["zz", *texts, "zz"]).slice(1, len(texts))
    assert sum(len(rows) for rows, _, _ in slabs(sliced, 1 << 20)) == len(texts)


def test_count_query(spark, texts, library):
    rows = {r.doc_id: r for r in op4_token_counts(spark, SF).collect()}
    assert len(rows) == len(texts)
    for i, t in texts:
        n = len(library(t))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len(t.encode()), n, n > 1024)


def test_count_odd_rows(odd, none, library):
    rows = token_counts(odd).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(library(r.text)) for r in odd.collect())
    assert token_counts(none).count() == 0


def test_fast_encoder_has_the_librarys_ids(library):
    encode = encoder(PATH)
    for text in [*strange(800), *(t for t in ODD_TEXTS if t)]:
        assert encode(text).tolist() == library(text)


def checked(rows, texts, library, room: int) -> None:
    """Every piece of every document once, in sequences that are full from 0 on and not too long."""
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in texts}
    for i, text in texts:
        ids = np.array([*library(text), 0], dtype="<u4")
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // room)))
        assert all(r.length == room for r in mine[1:]) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room


def best_fit(lengths: list[int], room: int) -> int:
    gaps: list[int] = []
    opened = 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, length)
        gap = gaps.pop(k) if k < len(gaps) else room
        opened += gap == room
        if gap > length:
            bisect.insort(gaps, gap - length)
    return opened


def test_packing_query(spark, texts, library):
    rows = op8_packing(spark, SF).collect()
    checked(rows, texts, library, 2048)
    assert len({r.sequence_id for r in rows}) == best_fit([r.length for r in rows], 2048)


def test_supersteps_are_best_fit():
    rnd = random.Random(3)
    for _ in range(60):
        room = rnd.choice([7, 16, 50])
        lengths = [rnd.randint(1, room) for _ in range(rnd.randrange(120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = set()
        for length, rank, first, fit, _ in supersteps(counts, room).tolist():
            later = [r for n, r, *_ in supersteps(counts, room).tolist() if n == length and r > rank]
            stop = min(later, default=counts[length])
            used |= {first + k // fit for k in range(stop - rank)}
        assert len(used) == best_fit(lengths, room)


def test_packing_odd_rows(spark, odd, none, library):
    rows = pack(odd, room=64).collect()
    want = [n for r in odd.collect() for n in [len(library(r.text)) + 1]]
    assert sum(r.length for r in rows) == sum(want)
    assert len(rows) == sum(-(-n // 64) for n in want)
    assert pack(none).count() == 0
    many = spark.createDataFrame([(i, "a") for i in range(500)], "doc_id long, text string")
    checked(pack(many, room=8).collect(), [(i, "a") for i in range(500)], library, 8)
