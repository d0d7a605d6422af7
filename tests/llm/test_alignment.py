from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from prosemetrics.llm import alignment
from prosemetrics.llm.queries import op12_alignment

from .conftest import ODD_TEXTS, SF

BYTE, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def tokens(text: str | None):
    """Ids and bytes of both tokenizations by the libraries, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    from prosemetrics.llm.transducer import byte_letters

    a = tokens.__dict__.setdefault("a", Tokenizer.from_file(BYTE))
    a.encode_special_tokens = True
    b = tokens.__dict__.setdefault("b", sentencepiece.SentencePieceProcessor(model_file=PIECE))
    letters = tokens.__dict__.setdefault("letters", byte_letters())
    if not text:
        return None
    made = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in t)) for i, t in zip(made.ids, made.tokens)]
    right = [
        (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
        for i in b.encode(text)
    ]
    spelled = [b"".join(t for _, t in side) for side in (left, right)]
    return (left, right) if spelled == [(" " + text).encode()] * 2 else None


def plain(texts: list[tuple[int, str | None]]) -> list[tuple]:
    """All columns, token by token and link by link as they are defined."""
    per_text, counts = [], Counter()
    for row_id, text in texts:
        made = tokens(text)
        if made is None:
            per_text.append((row_id, 0, 0, [], ""))
            continue
        ends = []
        for side in made:
            at, here = 0, {}
            for n, (_, spelled) in enumerate(side):
                at += len(spelled)
                here[at] = n
            ends.append(here)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(str(t) for t, _ in made[0][i:m]) + "|" + ",".join(str(t) for t, _ in made[1][j:n]))
            links.append((made[0][m - 1][0], made[1][n - 1][0]))
            i, j = m, n
        counts.update(links)
        per_text.append((row_id, *map(len, made), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (row_id, a, b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest)
        for row_id, a, b, links, digest in per_text
    ]


def test_query_matches_brute_force(spark, texts):
    assert sorted(map(tuple, op12_alignment(spark, SF).collect())) == sorted(plain(texts))


STRANGE = ["a▁b", "<unk> <s> x </s>", "<|endoftext|> and <|endoftext|>", "  two  spaces \n\n x ", "﻿x 　 ﬃ", "0" * 25_000, "don't a\xa0b\r\n\tc"]


@pytest.mark.parametrize("links", [1, 50, 1 << 19])
def test_strange_texts_in_chunks_of_any_size(spark, monkeypatch, links):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", links)
    rows = list(enumerate(STRANGE + ODD_TEXTS)) * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.alignments(frame).collect())) == sorted(plain(rows))


def test_memo_is_bounded(monkeypatch, texts):
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 50)
    aligner = alignment.Aligner(BYTE, PIECE)
    for _, text in texts[:40]:
        made, want = aligner.aligned(text or ""), tokens(text)
        if made:
            n_a, n_b, groups, _ = made
            sides = [[int(i) for g in groups.split(b";") for i in g.split(b"|")[k].split(b",")] for k in (0, 1)]
            assert sides == [[i for i, _ in side] for side in want] and (n_a, n_b) == tuple(map(len, want))
        assert len(aligner.memo) <= 50


def test_odd_rows(odd, none):
    rows = alignment.alignments(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.n_a, r.n_links, r.groups_sha256) for r in rows if r.n_a == 0} == {(0, 0, "")}
    assert sum(r.doc_id is None for r in rows) == 2
    assert alignment.alignments(none).count() == 0
