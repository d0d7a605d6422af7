"""Best-fit packing of token sequences in bulk supersteps.

Pieces of one length are interchangeable, and so are sequences with one gap.  A superstep takes all
pieces of the next shorter length at once: they go to their successor, the smallest gap that holds
them, as many to each sequence as fit; when that gap's sequences are used up, a sweep goes on to
the next larger one; what finds no gap opens new sequences.  Which piece goes where is decided by
rank: the pieces of a length are numbered, and so are the sequences of a gap, and equal numbers
meet, so there are no conflicts to undo.  Then gaps are updated and the next superstep begins.  The
result is that of best fit by falling length.

The supersteps need only how many pieces have each length (a table of at most ``room`` rows), and
give a table of intervals of ranks whose size depends on ``room`` alone: a sequence is met again
only when its gap has at least halved.  Counting, numbering and placing the pieces is the work on
the data; each is done in parallel, and no length comes together in one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.shared import numbered
from prosemetrics.llm.token_counts import tokenizer_path
from prosemetrics.llm.transducer import byte_letters

END = 0
# Words of more characters go to the slower library, whose time does not grow with their square.
LONG_WORD = 20_000
# Fixed value: how byte-level vocabularies of this kind cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict = {}


def encoder(path: str):
    """A function from a text to its ids (numpy, 32 bits) for a ``tokenizers`` file.

    Byte-level BPE files are run by the ``tiktoken`` library, several times as fast and with the same
    ids: in these files a token's id is the rank of its merge.  Other files, and texts with
    extremely long words, are left to ``tokenizers``.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as file:
            fast = _fast_encoder(json.load(file))
        library = []

        def by_library(text: str) -> np.ndarray:
            if not library:  # loaded when it is first needed: it takes memory in every worker
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_file(path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        def encode(text: str) -> np.ndarray:
            if fast is None or (len(text) > LONG_WORD and max(map(len, text.split(" "))) > LONG_WORD):
                return by_library(text)
            return fast(text)

        _encoders[path] = encode
    return _encoders[path]


def _fast_encoder(spec: dict):
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    if not plain or spec.get("normalizer") or "merges" not in model:
        return None
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    joined = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
    if joined != sorted(joined):
        return None
    made = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: made.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, tokenizer: str, room: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32``: every document's tokens and an end token, cut into
    pieces of ``room`` tokens of which the first may be shorter."""
    schema = f"id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for at, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                start, stop = 0, (len(ids) - 1) % room + 1
                for piece in range(-(-len(ids) // room)):
                    rows.append((at, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop = stop, stop + room
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(table[:, 0])),
                    pa.array(table[:, 1].astype(np.int32)),
                    *[pa.array(np.ascontiguousarray(table[:, i])) for i in (2, 3, 4)],
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def supersteps(counts: dict[int, int], room: int) -> np.ndarray:
    """Intervals of ranks, from how many pieces have each length.

    Rows are length, first rank, first sequence, pieces for each sequence and offset in it, sorted
    by length and rank.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence and number of sequences
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left, gap = 0, counts[length], length
        while left:
            while gap < room and not gaps.get(gap):
                gap += 1
            if gap < room:
                first, sequences = gaps[gap].pop()
            else:  # empty sequences, as many as are needed
                first, sequences = opened, -(-left // (room // length))
                opened += sequences
            fit = gap // length
            full = min(sequences, left // fit)
            used = min(sequences, -(-left // fit))
            plan.append((length, rank, first, fit, room - gap))
            placed = min(left, used * fit)
            partial = placed - full * fit
            for begin, number, rest in (
                (first, full, gap - fit * length),
                (first + full, used - full, gap - partial * length),
                (first + used, sequences - used, gap),
            ):
                if number and rest:
                    gaps.setdefault(rest, []).append((begin, number))
            rank, left = rank + placed, left - placed
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    room: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row for every piece.

    A document is its token ids and then id 0.  Only one of more than ``room`` tokens is cut.

    Defined cases: a null or empty text is the one id 0; null and repeated ids stay as they are, and
    each row is a document of its own; other columns are not read; an empty table gives no rows.
    """
    placed = numbered(pieces(docs, tokenizer, room, id_col, text_col), "length", "rank", "pieces")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = supersteps(counts, room)
    schema = f"id {dict(placed.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sorted key for length and rank: the interval is the last that begins at or before it.
        keys = plan[:, 0] << 40 | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            _, begin, first, fit, offset = plan[at].T
            within = rank - begin
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first + within // fit), pa.array(offset + within % fit * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return placed.mapInArrow(place, schema).withColumnRenamed("id", id_col)
