"""Near copies down to a shingle similarity of 0.8, by wide SimHash fingerprints and binary tries.

Two texts whose sets of five-word shingles have Jaccard similarity 0.8 differ in about 15 % of
SimHash bits (the angle of a cosine of 0.89), which is 10 of 64: too many to search for in 64 bits.
So a fingerprint is ``WORDS`` words of 32 bits.

* Each word's first ``KEY_BITS`` bits are a key of a trie of their own, searched for pairs with at
  most ``BUDGET`` differing bits: node pairs are followed down together and dropped when their bits
  exceed the budget.  One word finds a pair of similarity 0.8 with probability 0.27, so one of ten
  does with 0.96, and a more similar pair nearly always.
* A pair that is found in a trie is a link when its whole fingerprints differ in at most
  ``max_bits`` bits, whose share of all bits stands for the similarity.
* Bits are an estimate, so the closest pair of each linked text is then checked by its shingles
  themselves.  A text whose closest pair fails is compared with all texts of its linked set, inside
  tasks that hold a bounded part of the set and give no pairs, only the texts that have a similar
  one.  A text without one stays; the estimate alone drops nothing.

Within the budget two keys agree in one of ``BUDGET + 1`` runs of bits.  Each key is dealt to the
tasks once for each run, by the run's bits; large groups are dealt out in parts, and every two
parts meet.  A task gives links that span its linked sets, and the closest pair of each key, not
all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.components import components
from prosemetrics.llm.marks import marked_rows, row_marks
from prosemetrics.llm.shared import identified, stored

WORDS, WORD_BITS = 10, 32
BITS = WORDS * WORD_BITS
KEY_BITS, BUDGET = 24, 2
RUNS = BUDGET + 1
RUN_BITS = KEY_BITS // RUNS
SEED = 42
# Keys of one group that go to one task together, rows that a task gathers before it works, key
# pairs that are compared at once, and the size of node pairs that are compared key by key.
GROUP_KEYS, GATHERED, COMPARED, LEAF = 2048, 1 << 15, 1 << 18, 16
# Shingles whose bits are counted at once.
SLICE = 1 << 14
# Bytes of texts of a linked set that a task holds at once, and shared shingles counted at once.
HELD_BYTES, COUNTED = 16 << 20, 1 << 20
# Standard deviations of a fingerprint's distance that are allowed above its mean.
MARGIN = 2.0


def bits_for(similarity: float) -> int:
    """Differing bits that pairs of a Jaccard similarity have at most, but for a few of the least
    similar ones (``MARGIN``)."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(min(1.0, cosine)) / math.pi
    return math.floor(BITS * share + MARGIN * math.sqrt(BITS * share * (1 - share)))


def fingerprint(text: str | None, words: int = 5) -> np.ndarray:
    """``WORDS`` numbers of 32 bits; zeros for a text without words.

    A bit is 1 if it is set in over half of the different shingles' hashes.  A-Z are lower-cased,
    and words are runs of characters but space and U+0009 to U+000D; a shorter text is one shingle.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(WORDS, dtype=np.uint32)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    size = min(words, len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - size + 1].tolist()
    shingles = {joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())}
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), SLICE):
        wide = _spread(hashes[i : i + SLICE])
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u4")


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Rows of ``BITS`` bits, each half of an independent 64-bit mix of the hash."""
    out = np.empty((len(hashes), BITS // 64), dtype="<u8")
    for i in range(out.shape[1]):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def with_fingerprint(docs: DataFrame, name: str, words: int, text_col: str) -> DataFrame:
    """``docs`` with its texts' fingerprints as binary values in a new column ``name``, without the texts."""
    at = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c != text_col]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words).tobytes() for t in batch.column(at)]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.binary())], names=[*kept, name])

    schema = docs.select(*kept, F.lit(b"").alias(name)).schema
    for column in schema:
        column.nullable = True
    return docs.mapInArrow(add, schema)


class Keys:
    """Sorted keys with their fingerprints, and one label for each linked set of them."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, max_bits: int):
        self.keys, self.prints, self.max_bits = keys, prints, max_bits
        self.labels = np.arange(len(keys))
        # The closest other key that each key was compared with and linked to.
        self.partner, self.distance = np.full(len(keys), -1), np.full(len(keys), BITS + 1)
        self._ones: dict[int, np.ndarray] = {}

    def _split(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        """Where the keys with a one at ``depth`` begin in each range of keys."""
        if depth not in self._ones:
            bit = (self.keys >> np.uint32(KEY_BITS - 1 - depth)) & np.uint32(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        ones = self._ones[depth]
        return high - (ones[high] - ones[low])

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        labels = self.labels
        while True:
            a, b = labels[left], labels[right]
            open_ = a != b
            if not open_.any():
                return
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
            while (labels[labels] != labels).any():
                labels[:] = labels[labels]

    def _meet(self, own: np.ndarray, other: np.ndarray, bits: np.ndarray) -> None:
        closer = bits < self.distance[own]
        own, other, bits = own[closer], other[closer], bits[closer]
        order = np.argsort(-bits, kind="stable")  # the closest is written last
        self.partner[own[order]], self.distance[own[order]] = other[order], bits[order]

    def _compare(self, pairs: np.ndarray) -> None:
        """Link the close keys of node pairs; keys that are linked already are not compared."""
        a, b, c, d, _ = pairs
        width, size = d - c, (b - a) * (d - c)
        stops = np.cumsum(size)
        for begin in range(0, int(stops[-1]), COMPARED):
            at = np.arange(begin, min(begin + COMPARED, int(stops[-1])))
            owner = np.searchsorted(stops, at, side="right")
            within = at - (stops[owner] - size[owner])
            left, right = a[owner] + within // width[owner], c[owner] + within % width[owner]
            open_ = self.labels[left] != self.labels[right]
            left, right = left[open_], right[open_]
            near = np.bitwise_count(self.keys[left] ^ self.keys[right]) <= BUDGET
            left, right = left[near], right[near]
            bits = np.bitwise_count(self.prints[left] ^ self.prints[right]).sum(axis=1, dtype=np.int64)
            close = bits <= self.max_bits
            left, right, bits = left[close], right[close], bits[close]
            self._meet(left, right, bits)
            self._meet(right, left, bits)
            self._link(left, right)

    def join(self, pairs: np.ndarray, depth: int) -> None:
        """Follow node pairs (rows: low, high, low, high, differing bits) down from ``depth``."""
        while pairs.shape[1]:
            a, b, c, d, bits = pairs
            small = ((b - a) * (d - c) <= LEAF) | (depth == KEY_BITS)
            if small.any():
                self._compare(pairs[:, small])
                pairs = pairs[:, ~small]
                a, b, c, d, bits = pairs
            if not pairs.shape[1]:
                return
            m, n = self._split(a, b, depth), self._split(c, d, depth)
            twin = a == c
            grown = [
                np.stack([a, m, c, n, bits]),
                np.stack([m, b, n, d, bits]),
                np.stack([a, m, n, d, bits + 1]),
                np.stack([m, b, c, n, bits + 1])[:, ~twin],  # a node's halves meet once
            ]
            pairs = np.concatenate(grown, axis=1)
            a, b, c, d, bits = pairs
            pairs = pairs[:, (b > a) & (d > c) & (bits <= BUDGET)]
            depth += 1


def _solve(group: np.ndarray, side: np.ndarray, key: np.ndarray, node: np.ndarray, prints: np.ndarray, max_bits: int):
    """Links within groups: of side 0 with itself, and of side 1 with side 2.

    For each linked key: its node, that of its set, that of its closest partner, and their distance.
    """
    order = np.lexsort((key, side, group))
    group, side, key, node, prints = group[order], side[order], key[order], node[order], prints[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(key))
    twins = np.flatnonzero(side[low] == 0)
    first = np.flatnonzero(side[low] == 1)
    first = first[first + 1 < len(low)]
    first = first[(side[low[first + 1]] == 2) & (group[low[first]] == group[low[first + 1]])]
    a, b = np.concatenate([twins, first]), np.concatenate([twins, first + 1])
    keys = Keys(key, prints, max_bits)
    if len(a):
        keys.join(np.stack([low[a], high[a], low[b], high[b], np.zeros(len(a), dtype=np.int64)]), RUN_BITS)
    at = np.flatnonzero(keys.partner >= 0)
    return node[at], node[keys.labels[at]], node[keys.partner[at]], keys.distance[at]


def _links_of_groups(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by group; whole groups are gathered up to a bound.
        held: list[list[np.ndarray]] = []
        count = number = 0
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = _solve(*[np.concatenate(x) for x in zip(*held)], max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "partner", "distance"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            group, tile, side, key, node = (batch.column(i).to_numpy() for i in range(5))
            prints = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype="<u8").reshape(len(key), -1)
            change = np.ones(len(key), dtype=bool)
            change[1:] = (group[1:] != group[:-1]) | (tile[1:] != tile[:-1])
            change[0] = last != (group[0], tile[0])
            last = (group[-1], tile[-1])
            numbers = number + np.cumsum(change)
            number, start = int(numbers[-1]), 0
            for cut in [*np.flatnonzero(change).tolist(), len(key)]:
                if cut > start:
                    part = slice(start, cut)
                    held.append([numbers[part], side[part], key[part].astype(np.uint32), node[part], prints[part]])
                    count += cut - start
                if cut < len(key) and count >= GATHERED:
                    yield from flush()
                    count = 0
                start = cut
        yield from flush()

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's keys, once for each run of bits; that run comes to the top."""
    for batch in batches:
        if not batch.num_rows:
            continue
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(batch.num_rows, WORDS)
        node = batch.column(0)
        for word in range(WORDS):
            key = prints[:, word] >> np.uint32(WORD_BITS - KEY_BITS)
            for run in range(RUNS):
                low = np.uint32(RUN_BITS * run)
                turned = ((key << low) | (key >> np.uint32(KEY_BITS - int(low)))) & np.uint32(2**KEY_BITS - 1) if run else key
                group = (np.int64(word * RUNS + run) << RUN_BITS) + (turned >> np.uint32(KEY_BITS - RUN_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(turned.astype(np.int64)), node, batch.column(1)], names=["group", "key", "node", "fp"]
                )


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """``a, b, partner, distance``: for nodes of ``prints`` (columns ``node`` and ``fp``), pairs a and b
    that span linked sets, and a close partner of a."""
    rows = prints.select("node", "fp").mapInArrow(_dealt, "group long, key long, node long, fp binary")
    # The number of groups is fixed, so their sizes are a small table.
    sizes = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_KEYS).alias("parts"))
    sized = rows.join(F.broadcast(stored(sizes, "trie-sizes")), "group")
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(others))
    small, large = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tiles = sized.select("group", (small * F.col("parts") + large).alias("tile"), side.cast("long").alias("side"), "key", "node", "fp")
    dealt = tiles.repartition("group", "tile").sortWithinPartitions("group", "tile")
    return dealt.mapInArrow(_links_of_groups(max_bits), "a long, b long, partner long, distance long")


def shingles(text: str | None, words: int) -> set[bytes]:
    parts = (text or "").encode("utf-8", "replace").lower().split()
    size = min(words, len(parts))
    return {b" ".join(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()


def _similar(words: int, similarity: float):
    """Keeps the pairs (a, b, text of a, text of b) whose sets of shingles are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = shingles(one.as_py(), words), shingles(other.as_py(), words)
                keep.append(len(x & y) >= similarity * len(x | y))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    return run


class Part:
    """Texts of a linked set, found by the hashes of their shingles."""

    def __init__(self, words: int, similarity: float):
        self.words, self.similarity = words, similarity
        self.nodes: list[int] = []
        self.texts: list[str | None] = []
        self._hashes: list[np.ndarray] = []

    def hashes(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        found = shingles(text, self.words)
        return np.sort(np.fromiter((xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found)))

    def add(self, node: int, text: str | None) -> None:
        self.nodes.append(node)
        self.texts.append(text)
        self._hashes.append(self.hashes(text))

    def close(self) -> None:
        self.sizes = np.array([len(h) for h in self._hashes], dtype=np.int64)
        every = np.concatenate([*self._hashes, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(every, kind="stable")
        self.sorted = every[order]
        self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[order]
        self._hashes = []

    def similar(self, node: int, text: str | None) -> bool:
        """Whether another text of the part is similar; a hash only says where to look."""
        own = self.hashes(text)
        low = np.searchsorted(self.sorted, own, side="left")
        runs = np.searchsorted(self.sorted, own, side="right") - low
        shared = np.zeros(len(self.sizes), dtype=np.int64)
        stops = np.cumsum(runs)
        begin = 0
        while begin < len(own):
            before = stops[begin] - runs[begin]
            end = max(begin + 1, int(np.searchsorted(stops, before + COUNTED, side="right")))
            n, starts = runs[begin:end], low[begin:end]
            at = np.arange(int(n.sum())) + np.repeat(starts - (stops[begin:end] - n - before), n)
            shared += np.bincount(self.owner[at], minlength=len(shared))
            begin = end
        near = np.flatnonzero(shared >= self.similarity * (len(own) + self.sizes - shared))
        mine = shingles(text, self.words)
        for i in near[np.argsort(-shared[near], kind="stable")].tolist():
            if self.nodes[i] != node:
                other = shingles(self.texts[i], self.words)
                if len(mine & other) >= self.similarity * len(mine | other):
                    return True
        return False


def _with_similar(words: int, similarity: float):
    """Nodes that are asked for and have a similar text in a part of their set.

    Rows (label, part, asked part, asked, node, text) come sorted, those to look among first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, closed = None, Part(words, similarity), False
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for *tile, asked, node, text in zip(*columns, batch.column(5)):
                if tile != last:
                    last, part, closed = tile, Part(words, similarity), False
                if not asked:
                    part.add(node, text.as_py())
                    continue
                if not closed:
                    part.close()
                    closed = True
                if part.similar(node, text.as_py()):
                    found.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["node"])

    return run


def with_similar(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``node`` of the rows that are ``asked`` for and have a similar text in their set, perhaps several times
    (columns ``node``, ``label`` of the set, ``asked`` and ``text``).

    A set is dealt to the tasks in parts of bounded size, and every part of those asked for meets
    every part of the set.
    """
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_KEYS, F.sum(F.octet_length(F.coalesce("text", F.lit("")))) / HELD_BYTES))
    sizes = texts.groupBy("label").agg(F.greatest(parts, F.lit(1)).alias("parts"), F.ceil(F.count_if("asked") / GROUP_KEYS).alias("asked_parts"))
    sized = texts.join(stored(sizes, "set-sizes"), "label").withColumn("own", F.xxhash64("node"))

    def dealt(own: str, other: str, asked: bool) -> DataFrame:
        rows = sized.filter("asked") if asked else sized
        one = F.pmod("own", F.col(own)).alias(own)
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other)
        return rows.select("label", one, each, F.lit(asked).alias("now"), "node", "text").select("label", "parts", "asked_parts", "now", "node", "text")

    rows = dealt("parts", "asked_parts", False).unionByName(dealt("asked_parts", "parts", True))
    tile = ["label", "parts", "asked_parts"]
    return rows.repartition(*tile).sortWithinPartitions(*tile, "now").mapInArrow(_with_similar(words, similarity), "node long")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each set of near copies: that with the
    smallest id (of repeated ids, one of their rows).

    Sets are connected over links: fingerprints of ``words``-word shingles that differ in at most
    :func:`bits_for` ``similarity`` bits.  Each text of a set of several has a pair in it whose sets of shingles have
    this Jaccard similarity or more; copies of a text are its equals by fingerprint.

    Only rows that go, and a few that share a mark with them, are looked up; other rows are never
    moved.

    Defined cases: a null text is an empty one, and texts without words are copies of each other;
    null ids come last; repeated rows are copies; other columns stay; an empty table gives no rows.
    """
    marked, row = identified(docs, "near")
    slim = marked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*row).alias("row"))
    prints = stored(with_fingerprint(slim, "fp", words, "text"), "wide-prints")
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    distinct = prints.groupBy("fp").agg(F.min(best).alias("first"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "wide-distinct")
    found = stored(links(distinct, bits_for(similarity)), "wide-links")
    labels = components(found.select("a", "b"))

    # The closest pair of each linked node, by the texts of the nodes' first rows.
    closest = found.groupBy("a").agg(F.min_by("partner", F.struct("distance", "partner")).alias("b"))
    pairs = stored(closest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = stored(distinct.join(nodes, "node").select("node", "first.row.*"), "near-ends")
        lines = marked.select(*row, F.col(text_col).alias("text_of_node"))
        lines = marked_rows(lines, row_marks(wanted, row), row).join(wanted.hint("shuffle_hash"), row)
        return stored(lines.select("node", F.col("text_of_node").alias("text")), "near-texts")

    lines = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    for end in ("a", "b"):
        pairs = pairs.join(lines.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    sure = pairs.select("a", "b", "text_a", "text_b").mapInArrow(_similar(words, similarity), "a long, b long")
    sure = stored(sure.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-nodes")

    # The others, and the sets that they are in.
    passed = sure.withColumn("passed", F.lit(True))
    asked = stored(labels.join(passed, "node", "left").select("node", "label", F.col("passed").isNull().alias("asked")), "near-asked")
    open_sets = asked.filter("asked").select("label").distinct()
    sets = stored(asked.join(open_sets, "label", "left_semi"), "near-sets")
    if not sets.isEmpty():
        lines = stored(texts_of(sets.select("node")).join(sets, "node"), "near-set-texts")
        sure = stored(sure.unionByName(with_similar(lines, words, similarity)).distinct(), "near-nodes")

    labels = labels.join(sure, "node", "left_semi")
    members = distinct.join(labels, "node", "left").select("fp", "first", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("linked"))
    members = stored(members, "wide-members")
    # A node that is alone may give its number to a set that it is no longer in.
    least = members.groupBy("label", "linked").agg(F.min("first").alias("stays"))
    stays = stored(members.join(least, ["label", "linked"]).select("fp", "stays"), "wide-sets")
    gone = prints.join(stays, "fp").filter(F.col("row") != F.col("stays.row")).select("row.*")
    gone = stored(gone, "near-gone")
    looked_up = marked_rows(marked, row_marks(gone, row), row)
    rest = marked_rows(marked, row_marks(gone, row), row, False)
    kept = looked_up.join(gone.hint("shuffle_hash"), row, "left_anti")
    return rest.select(*docs.columns).unionByName(kept.select(*docs.columns))
