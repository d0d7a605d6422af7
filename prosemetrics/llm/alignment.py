"""Alignment of two tokenizations of the same texts.

Both tokenizations of a text spell the same bytes, so a place where a token of each ends is a shared
end; shared ends cut both into groups.  Per text:

1. Each tokenizer encodes the whole text, and the bytes of both are compared with the text's.
2. An *anchor* is a shared end before tokens that both begin with a space.  Anchors cut the text into
   windows: mostly one word, as a tuple of ids of each tokenizer.
3. The same windows come again and again, so what a window gives (its groups and links) is kept by
   its tuple of ids; only windows that are new are aligned token by token.

A link joins the two tokens that end at a shared end.  How often a pair of ids is linked is counted
over the corpus: documents are taken in chunks of bounded size, a chunk keeps its links as places in
a table of its own different pairs, and only those tables are exploded, summed up and joined back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.packing import LONG_WORD, WORDS
from prosemetrics.llm.shared import stored
from prosemetrics.llm.token_counts import tokenizer_path
from prosemetrics.llm.transducer import byte_letters

# A chunk ends with the document that brings it to so many links or rows.
CHUNK_LINKS, CHUNK_ROWS = 1 << 19, 4096
# Windows of more tokens are aligned each time; so many alignments are kept at most, and as many of
# the time before.
MEMO_TOKENS, MEMO_WINDOWS = 32, 1 << 17


def byte_encoder(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """A function from a text to its ids, special tokens' strings being plain text, and every id's bytes.

    The file is a byte-level BPE vocabulary whose ids are the ranks of its merges.  It is run by the
    ``tiktoken`` library; words of extreme length are left to ``tokenizers``, with the same ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"] if t["special"]}
    vocabulary = {i: bytes(letters[c] for c in w) for w, i in spec["model"]["vocab"].items() if w not in special}
    fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks={w: i for i, w in vocabulary.items()}, special_tokens={})
    library = []

    def encode(text: str) -> np.ndarray:
        if len(text) <= LONG_WORD or max(map(len, text.split(" "))) <= LONG_WORD:
            return fast.encode_to_numpy(text)
        if not library:  # loaded when it is first needed: it takes memory in every worker
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
            library[0].encode_special_tokens = True
        return np.array(library[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode, [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1 + len(special))]


class Spelling:
    """The bytes of a vocabulary's tokens, for whole texts at once."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def ends(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray | None:
        """Where each token ends, or None if the tokens do not spell ``text``."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or ends[-1] != len(text):
            return None
        at = np.repeat(self.begins[ids] - (ends - lengths), lengths) + np.arange(len(text))
        return ends if (self.bytes[at] == text).all() else None

    def marked(self, ids: np.ndarray) -> np.ndarray:
        """Tokens before a space-marked one, and the last token."""
        return np.append(np.flatnonzero(self.spaced[ids[1:]]), len(ids) - 1)


# Stands between the ids of A and of B in a window's key; no vocabulary has such an id.
BETWEEN = b"\xff\xff\xff\xff"


class Aligner:
    """Both tokenizers, and the alignments of windows met so far.

    A window's key is the tuple of its ids, packed as 32-bit numbers.  Its alignment is the text of
    its groups, and the pairs of ids that its links join, packed as 64-bit numbers.
    """

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.encode_a, bytes_a = byte_encoder(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = self.pieces.id_to_piece(list(range(self.pieces.get_piece_size())))
        bytes_b = [bytes([int(n[3:-1], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a, self.b = Spelling(bytes_a), Spelling(bytes_b)
        # Ids as decimal text, each with room for a mark behind it.
        self.names = Spelling([b"%d," % i for i in range(max(len(bytes_a), len(bytes_b)))])
        self.names.lengths -= 1
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.before: dict[bytes, tuple[bytes, bytes]] = {}

    def aligned(self, text: str) -> tuple[int, int, bytes, np.ndarray] | None:
        """Token counts, groups and linked pairs of a text; None where its tokens do not spell a space and the text."""
        if not text:
            return None
        whole = " " + text
        try:
            spelled = np.frombuffer(whole.encode(), dtype=np.uint8)
        except UnicodeEncodeError:
            return None
        b = np.array(self.pieces.encode(text), dtype="<u4")
        ends_b = self.b.ends(b, spelled)
        if ends_b is None:
            return None
        a = self.encode_a(whole).astype("<u4", copy=False)
        ends_a = self.a.ends(a, spelled)
        if ends_a is None:
            return None
        # Shared ends before space-marked tokens, and the end of the text.
        marked_a, marked_b = self.a.marked(a), self.b.marked(b)
        found = np.searchsorted(ends_b[marked_b], ends_a[marked_a])
        shared = ends_b[marked_b[found]] == ends_a[marked_a]
        stops_a, stops_b = (4 * (marked_a[shared] + 1)).tolist(), (4 * (marked_b[found[shared]] + 1)).tolist()
        packed_a, packed_b = a.tobytes(), b.tobytes()
        get, windows, new, i, j = self.memo.get, [], [], 0, 0
        for m, n in zip(stops_a, stops_b):
            key = packed_a[i:m] + BETWEEN + packed_b[j:n]
            window = get(key)
            if window is None and (window := self.met_before(key)) is None:
                new.append((len(windows), i >> 2, m >> 2, j >> 2, n >> 2))
            windows.append(window or key)
            i, j = m, n
        if new:
            at, *edges = np.array(new, dtype=np.int64).T
            for n, window in zip(at.tolist(), self.cut(a, ends_a, b, ends_b, *edges)):
                self.keep(windows[n], window)
                windows[n] = window
        groups, pairs = zip(*windows)
        return len(a), len(b), b";".join(groups), np.frombuffer(b"".join(pairs), dtype="<i8")

    def met_before(self, key: bytes) -> tuple[bytes, bytes] | None:
        window = self.before.get(key)
        if window is not None:
            self.keep(key, window)
        return window

    def keep(self, key: bytes, window: tuple[bytes, bytes]) -> None:
        if len(key) <= 4 * MEMO_TOKENS:
            if len(self.memo) >= MEMO_WINDOWS:  # windows that are not met again until the next time go
                self.before = dict(self.memo)
                self.memo.clear()
            self.memo[key] = window

    def cut(self, a, ends_a, b, ends_b, i, m, j, n) -> Iterator[tuple[bytes, bytes]]:
        """Cut windows of a text, tokens i to m of A and j to n of B, into groups at all shared ends."""
        flat_a, flat_b = _ranges(i, m), _ranges(j, n)
        a, ends_a, b, ends_b = a[flat_a], ends_a[flat_a], b[flat_b], ends_b[flat_b]
        found = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[found] == ends_a
        last_b = np.zeros(len(b), dtype=bool)
        last_b[found[last_a]] = True
        pairs = a[last_a].astype(np.int64) * len(self.b.lengths) + b[last_b]
        # Tokens in the order of the text: a group's ids of A, then its ids of B.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        stops_a, stops_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        order_a = np.arange(len(a)) + np.append(0, stops_b)[group_a]
        order_b = np.arange(len(b)) + stops_a[group_b]
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        marks = np.empty(len(ids), dtype=np.uint8)
        ids[order_a], ids[order_b] = a, b
        marks[order_a], marks[order_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        lengths = self.names.lengths[ids] + 1
        stops = np.cumsum(lengths)
        text = self.names.bytes[np.repeat(self.names.begins[ids] - stops + lengths, lengths) + np.arange(stops[-1])]
        text[stops - 1] = marks
        # Where each window ends, in groups and in bytes.
        of_groups = np.cumsum(last_a)[np.cumsum(m - i) - 1]
        of_bytes = stops[np.cumsum(m - i) + np.cumsum(n - j) - 1].tolist()
        packed, text = pairs.astype("<i8").tobytes(), text.tobytes()
        begin = first = 0
        for stop, last in zip(of_bytes, (8 * of_groups).tolist()):
            yield text[begin : stop - 1], packed[first:last]
            begin, first = stop, last


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers from each start to its stop, end to end."""
    lengths = stop - start
    ends = np.cumsum(lengths)
    return np.repeat(start - ends + lengths, lengths) + np.arange(ends[-1])


def _chunks(byte_tokenizer: str, piece_tokenizer: str, id_type: pa.DataType):
    """One row for each chunk of documents: their own figures, their links as places in the chunk's
    table of pairs, and that table with the chunk's counts."""
    aligners: dict[str, Aligner] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not aligners:
            aligners[""] = Aligner(tokenizer_path(byte_tokenizer), tokenizer_path(piece_tokenizer))
        aligner = aligners[""]
        chunk = TaskContext.get().partitionId() << 32
        rows, links = [], []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, held
            all_links = np.concatenate([np.zeros(0, dtype=np.int64), *links])
            pairs, place, counts = np.unique(all_links, return_inverse=True, return_counts=True)
            width = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
            ids, n_a, n_b, n_groups, digests = zip(*rows)
            columns = {
                "chunk": pa.array([chunk], pa.int64()),
                "ids": pa.array([list(ids)], pa.list_(id_type)),
                "n_a": pa.array([n_a], pa.list_(pa.int64())),
                "n_b": pa.array([n_b], pa.list_(pa.int64())),
                "n_links": pa.array([n_groups], pa.list_(pa.int64())),
                "digests": pa.array([digests], pa.list_(pa.string())),
                "links": pa.array([place.astype(width).tobytes()], pa.binary()),
                "pairs": pa.array([pairs], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
            }
            rows.clear(), links.clear()
            chunk, held = chunk + 1, 0
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                made = aligner.aligned(text.as_py() or "")
                if made is None:
                    rows.append((row_id, 0, 0, 0, ""))
                else:
                    n_a, n_b, groups, found = made
                    rows.append((row_id, n_a, n_b, len(found), hashlib.sha256(groups).hexdigest()))
                    links.append(found)
                    held += len(found)
                if held >= CHUNK_LINKS or len(rows) >= CHUNK_ROWS:
                    yield flush()
        if rows:
            yield flush()

    return run


def _documents(id_name: str, id_type: pa.DataType):
    """Rows of documents from their chunks, once the counts of the chunk's pairs are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                pairs = row["pairs"].values.to_numpy() if row["pairs"].is_valid else np.zeros(0, dtype=np.int64)
                totals, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
                if row["known"].is_valid:
                    known = row["known"].values.flatten()
                    places = np.searchsorted(pairs, known[0].to_numpy())
                    totals[places], best[places] = known[1].to_numpy(), known[2].to_numpy(zero_copy_only=False)
                n_links = row["n_links"].values.to_numpy()
                width = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
                links = np.frombuffer(row["links"].as_py(), dtype=width)
                stops = np.cumsum(n_links)
                sums = [np.concatenate([[0], np.cumsum(values[links])]) for values in (totals, best)]
                count_sum, n_best = (s[stops] - s[stops - n_links] for s in sums)
                yield pa.RecordBatch.from_pydict(
                    {
                        id_name: pa.array(row["ids"].values, id_type),
                        "n_a": row["n_a"].values,
                        "n_b": row["n_b"].values,
                        "n_groups": row["n_links"].values,
                        "n_links": row["n_links"].values,
                        "n_best": n_best,
                        "count_sum": count_sum,
                        "groups_sha256": row["digests"].values,
                    }
                )

    return run


def pair_counts(chunks: DataFrame, pieces: int) -> DataFrame:
    """``pair, total, best``: how many links hold each pair of ids, corpus-wide, and whether that is
    the most that any pair with its second id has."""
    entries = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    totals = stored(entries.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    totals = totals.withColumn("b", F.col("pair") % pieces)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))  # a row for each piece of the vocabulary
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def alignments(
    docs: DataFrame,
    byte_tokenizer: str = "byte_bpe_50k.json",
    piece_tokenizer: str = "piece_bpe_32k.model",
    pieces: int = 32_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row for every row.

    The byte-level tokenizer (A) encodes a space and the text, the piece tokenizer (B, with ``pieces``
    entries) the text, to which it adds a space itself; special tokens' strings are plain text.
    ``groups_sha256`` is the digest of all groups, as ids of A, a bar, ids of B, in order.  ``n_best`` counts links whose
    pair of ids is linked as often, corpus-wide, as any pair with its B id is; ``count_sum`` adds up
    the corpus-wide counts of the links' pairs.

    Defined cases: a text that is null or empty, or whose tokens do not spell it (B replaces some
    characters), has no tokens: zeros and an empty string; null and repeated ids stay as they are and
    each row counts; other columns are not read; an empty table gives no rows.
    """
    id_type = dict(docs.dtypes)[id_col]
    arrow_type = _arrow_type(docs, id_col)
    lists = ", ".join(f"{n} array<bigint>" for n in ("n_a", "n_b", "n_links"))
    schema = f"chunk long, ids array<{id_type}>, {lists}, digests array<string>, links binary, pairs array<bigint>, counts array<bigint>"
    chunks = stored(docs.select(id_col, text_col).mapInArrow(_chunks(byte_tokenizer, piece_tokenizer, arrow_type), schema), "aligned")
    own = chunks.select("chunk", F.explode("pairs").alias("pair"))
    known = own.join(pair_counts(chunks, pieces), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "total", "best")).alias("known"))
    whole = chunks.drop("counts").join(known, "chunk", "left")
    out = ", ".join(f"{n} long" for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return whole.mapInArrow(_documents(id_col, arrow_type), f"{id_col} {id_type}, {out}, groups_sha256 string")


def _arrow_type(docs: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[id_col].dataType)
