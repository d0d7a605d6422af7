"""Near-duplicates by SimHash: fingerprints of word shingles, joined as binary tries."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.components import components
from prosemetrics.llm.shared import identified, stored
from prosemetrics.session import sized_broadcast

SEED = 42
# Keys of one trie that go to one task together.  A larger trie is dealt out in parts, and every two
# of its parts meet in a task.
TRIE_KEYS = 2048
# Shingles whose bits are counted at once.
SLICE = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text as an unsigned 64-bit number; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    size = min(words, len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(stops)
    )
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), SLICE):
        piece = hashes[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, words: int = 4, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts' fingerprints as signed longs in a new column ``name``."""
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, name]
            )

    schema = docs.select(*docs.columns, F.lit(0).cast("long").alias(name)).schema
    for column in schema:
        column.nullable = True
    return docs.mapInArrow(add, schema)


@dataclass(frozen=True)
class Turn:
    """An order of the bits of a key: some runs of bits come to the top, the others follow.

    ``moves`` has each run's first bit, width and new first bit, counted from the left.
    """

    moves: tuple[tuple[int, int, int], ...]
    top: int

    def turned(self, key: Column) -> Column:
        out = F.lit(0).cast("long")
        for start, width, to in self.moves:
            run = F.shiftrightunsigned(key, 64 - start - width).bitwiseAND(2**width - 1)
            out = out.bitwiseOR(F.shiftleft(run, 64 - to - width))
        return out

    def restored(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros_like(keys)
        for start, width, to in self.moves:
            run = (keys >> np.uint64(64 - to - width)) & np.uint64(2**width - 1)
            out |= run << np.uint64(64 - start - width)
        return out


def turns(max_bits: int, runs: int) -> list[Turn]:
    """Cut 64 bits into ``runs`` runs.  Two keys within ``max_bits`` differing bits agree in
    ``runs - max_bits`` of them at least, so each choice of so many runs comes to the top once."""
    edges = [64 * i // runs for i in range(runs + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in itertools.combinations(range(runs), runs - max_bits):
        moves, at = [], 0
        for i in [*chosen, *(i for i in range(runs) if i not in chosen)]:
            moves.append((*spans[i], at))
            at += spans[i][1]
        out.append(Turn(tuple(moves), sum(spans[i][1] for i in chosen)))
    return out


def runs_for(keys: int, max_bits: int) -> int:
    """How many runs to cut keys into, so that a trie below one top value has ``TRIE_KEYS`` keys or
    fewer if keys are spread evenly.  The links found do not depend on it."""
    runs = max_bits + 1
    while runs < max_bits + 4 and keys > TRIE_KEYS * 2 ** min(t.top for t in turns(max_bits, runs)):
        runs += 1
    return runs


def _join_tries(orders: list[Turn], max_bits: int):
    def solve(turn: int, rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links among the tries of one rotation; rows: group number, side, key."""
        group, side, key = rows
        order = np.lexsort((key, side, group))
        group, side, key = group[order], side[order], key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(key))
        sided = side[low]
        twins = sided == 0  # one trie with itself
        pairs = [np.stack([low[twins], high[twins], low[twins], high[twins], np.zeros(twins.sum(), dtype=np.int64)])]
        first = np.flatnonzero(sided == 1)
        first = first[(first + 1 < len(low))]
        first = first[(sided[first + 1] == 2) & (group[low[first]] == group[low[first + 1]])]
        pairs.append(np.stack([low[first], high[first], low[first + 1], high[first + 1], np.zeros(len(first), dtype=np.int64)]))
        found = list(linked_places(key, np.concatenate(pairs, axis=1), orders[turn].top, max_bits))
        if not found:
            return []
        whole = orders[turn].restored(key)
        at = np.array(found, dtype=np.int64)
        return [(whole[at[:, 0]].view(np.int64), whole[at[:, 1]].view(np.int64))]

    from prosemetrics.llm.tries import linked as linked_places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by rotation and group; whole groups are gathered up to a bound.
        held: list[list[np.ndarray]] = []
        count, number, last, turn = 0, 0, None, None

        def flush():
            if held:
                for a, b in solve(turn, [np.concatenate(x) for x in zip(*held)]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held.clear()

        for batch in batches:
            turns, tops, tiles, sides, keys = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(turns):
                continue
            change = np.ones(len(turns), dtype=bool)
            change[1:] = (turns[1:] != turns[:-1]) | (tops[1:] != tops[:-1]) | (tiles[1:] != tiles[:-1])
            change[0] = last != (turns[0], tops[0], tiles[0])
            last = (turns[-1], tops[-1], tiles[-1])
            numbers = number + np.cumsum(change)
            number = int(numbers[-1])
            cuts = np.flatnonzero(change)
            start = 0
            for cut in [*cuts.tolist(), len(turns)]:
                if cut > start:
                    held.append([numbers[start:cut], sides[start:cut].astype(np.int64), keys[start:cut].view(np.uint64)])
                    count += cut - start
                if cut < len(turns) and (count >= SLICE or turn != turns[cut]):
                    yield from flush()
                    count, turn = 0, int(turns[cut])
                start = cut
        yield from flush()

    return run


def links(prints: DataFrame, max_bits: int = 4, runs: int | None = None) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints (column ``fp``) that span all linked sets.

    Keys within ``max_bits`` bits agree in some runs of bits (:func:`turns`).  So every key goes
    into several tries, each with other runs at the top, and pairs are sought below one value of
    the top: both nodes of a pair are followed down together, and a pair is dropped when its bits
    exceed the budget.  Each trie gives a star for each linked set, not all pairs.  Up to 2^24 keys
    one run of five is at the top; with more keys there are more runs (15 choices of two of six, 35
    of three of seven), so that tries stay small.

    Tries that still have more than ``TRIE_KEYS`` keys are dealt into parts by a hash; each two
    parts, and each part with itself, are one tile.
    """
    orders = turns(max_bits, runs or runs_for(prints.count(), max_bits))
    turned = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("turn"),
                    order.turned(F.col("fp")).alias("key"),
                    F.shiftrightunsigned(order.turned(F.col("fp")), 64 - order.top).alias("top"),
                )
                for i, order in enumerate(orders)
            ]
        )
    ).alias("t")
    rows = prints.select(turned).select("t.turn", "t.top", "t.key")
    sizes = rows.groupBy("turn", "top").agg(F.ceil(F.count(F.lit(1)) / TRIE_KEYS).alias("parts")).filter("parts > 1")
    sized = rows.join(sized_broadcast(stored(sizes, "large-tries")), ["turn", "top"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    sized = sized.withColumn("own", own).select("turn", "top", "key", "parts", "own", F.explode(others).alias("other"))
    small, large = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tiles = sized.select("turn", "top", (small * F.col("parts") + large).alias("tile"), side.alias("side"), "key")
    dealt = tiles.repartition("turn", "top", "tile").sortWithinPartitions("turn", "top", "tile")
    return dealt.mapInArrow(_join_tries(orders, max_bits), "a long, b long")


def classes(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fp, smallest``: for every distinct fingerprint of ``prints`` (columns ``id`` and ``fp``)
    the smallest id of its linked set."""
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    labels = components(links(distinct.select("fp"), max_bits))
    members = stored(labels.join(distinct, labels.node == distinct.fp).select("fp", "label", "id"), "members")
    least = stored(members.groupBy("label").agg(F.min("id").alias("smallest")), "least")
    found = members.join(least, "label").select("fp", "smallest")
    joined = distinct.join(found, "fp", "left").select("fp", F.coalesce("smallest", "id").alias("smallest"))
    return stored(joined, "classes")


def near_duplicates(
    docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for every row of ``docs``.

    Words are runs of characters but space and U+0009 to U+000D, A-Z lower-cased; shingles are
    ``words`` words joined by spaces (a shorter text is one shingle); a bit is set if it is set in
    over half of the shingles' XXH64.  Fingerprints link at ``max_bits`` or fewer differing bits;
    the component is named by its smallest id.

    Defined cases: a null text is an empty one; a text without words has fingerprint 0 and is
    linked like any other; null ids never name a component unless it has no other; repeated rows
    are rows of their own; other columns are not read; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = stored(with_fingerprint(slim, "fp", words).select("id", "fp"), "fingerprints")
    joined = prints.join(classes(prints, max_bits), "fp")
    return joined.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("smallest").alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each component: that with the smallest
    id (of repeated ids, one of their rows).  Cases are defined as in :func:`near_duplicates`."""
    marked, row = identified(docs, "near")
    slim = marked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*row).alias("row"))
    prints = stored(with_fingerprint(slim, "fp", words).select("id", "fp", "row"), "fingerprints")
    prints = prints.join(classes(prints, max_bits), "fp")
    first = prints.groupBy("smallest").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    kept = stored(first.select(*[F.col(f"first.row.{c}").alias(c) for c in row]), "kept")
    # The same join at every size; row numbers are all different, so no task gets more than its share.
    return marked.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
