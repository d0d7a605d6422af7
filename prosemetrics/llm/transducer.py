"""A byte-level BPE tokenizer compiled to a deterministic transducer that emits token counts.

**Words.**  The tokenizer first cuts a text into words.  Where it cuts depends on the classes of a
few neighbouring characters, so :func:`word_starts` finds all cuts of a buffer at once.

**States.**  In a word, byte-pair encoding has one property that makes it finite-state: the
encoding of a prefix is the encoding of a shorter prefix and one last token, and a token may follow
another exactly if the two, joined and encoded again, give the same two tokens.  To go on after a
prefix one needs, for every suffix that begins some longer token, its node in the token trie, the
token before it and the difference of token counts.  That tuple is the state.  A transition says
which state follows on a byte and by how much the count changes (it can fall: tokens merge).

**Compilation.**  Transitions are built when data first ask for them and kept in a hash table of
numpy arrays.  Both the table and the dictionary of states are dropped when they exceed a bound;
counts do not depend on that.

**Chunks.**  A buffer is cut into chunks of equal length, wherever that falls.  The map of a chunk,
from the state before it to the state and count after it, is known without the text before it
once the chunk has a word start: bytes up to there (the head) are applied to the incoming state,
all others have a fixed result.  Maps compose: all chunks run in step, a running maximum (the
prefix scan) finds for every head the chunk whose end state it continues, then all heads run in
step.  A word over many chunks is one long head.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from tokenizers import pre_tokenizers

CHUNK = 128
MAX_STATES = 400_000

LETTER, NUMBER, SPACE, BLANK, OTHER = 0, 1, 2, 3, 4

# The characters with the Unicode property White_Space, but for the space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# Beyond, no version of Unicode has letters or numbers.
LAST_PLANES = 0x40000

_classes: np.ndarray | None = None
_compiled: dict[str, CountTransducer] = {}


def char_classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        major = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
        codes = np.frombuffer(major.encode("ascii"), dtype=np.uint8)
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        table[codes == ord("L")] = LETTER
        table[codes == ord("N")] = NUMBER
        table[list(WHITE_SPACE)] = BLANK
        table[0x20] = SPACE
        # The library may know later versions of Unicode than Python does: ask it for the rest.
        ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in (c for c in range(LAST_PLANES) if unicodedata.category(chr(c)) == "Cn"):
            for prefix, kind in (("a", LETTER), ("1", NUMBER)):
                if len(ask(prefix + chr(c))) == 1:
                    table[c] = kind
        _classes = table
    return _classes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and code points of the characters of a UTF-8 buffer."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.int32)
    if len(at) < len(data):
        for shortest, bits, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
            some = np.flatnonzero((lead >= shortest) & (lead < (shortest >> 1 | 0x80) + (size == 4) * 0x100))
            value = (lead[some] & bits).astype(np.int32)
            for k in range(1, size):
                value = value << 6 | (data[at[some] + k] & 0x3F)
            points[some] = value
    return at, points


def word_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes begin a word.  ``starts``: where the (non-empty) texts of the buffer begin."""
    flags = np.zeros(len(data), dtype=bool)
    if not len(data):
        return flags
    at, points = code_points(data)
    kind = char_classes()[points]
    n = len(at)
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(at, starts)] = True
    first[n] = True
    begins, ends = first[:-1], first[1:]
    white = (kind == SPACE) | (kind == BLANK)

    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    after_white = np.zeros(n, dtype=bool)
    after_white[1:] = white[:-1]
    before_solid = np.zeros(n, dtype=bool)
    before_solid[:-1] = ~white[1:]
    before_solid &= ~ends

    cut = np.where(
        white,
        ~after_white | before_solid,  # a run of white space; its last character stands alone
        (before != SPACE) & (before != kind),
    )
    # Contractions: an apostrophe that begins a word, and the letters that belong to it.
    marks = np.flatnonzero((points == 0x27) & (begins | (before == LETTER) | (before == NUMBER) | (before == BLANK)))
    if len(marks):
        ahead = np.zeros((2, len(marks)), dtype=np.int32)
        inside = np.ones(len(marks), dtype=bool)
        for k in (0, 1):
            there = marks + k + 1
            inside &= ~first[np.minimum(there, n)]
            ahead[k] = np.where(inside, points[np.minimum(there, n - 1)], 0)
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(marks), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (ahead[0] == ord(a)) & (ahead[1] == ord(b))
        cut[marks[one | two] + 1] = False
        for which, size in ((one, 2), (two, 3)):
            past = marks[which] + size
            cut[past[past < n]] = True
    flags[at[cut | begins]] = True
    return flags


class CountTransducer:
    """Counts the tokens of texts for one byte-level BPE vocabulary (a ``tokenizers`` JSON file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        letters = byte_letters()
        self.special = [t["content"].encode() for t in spec["added_tokens"] if t["special"]]
        skip = {t["content"] for t in spec["added_tokens"]}
        token_of = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in skip}
        self.bytes_of = {i: b for b, i in token_of.items()}
        self.single = [token_of[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.merges[token_of[a], token_of[b]] = (rank, token_of[a + b])
        self.children: list[dict[int, int]] = [{}]
        self.ending = [-1]
        for word, i in token_of.items():
            node = 0
            for byte in word:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ending.append(-1)
                node = self.children[node][byte]
            self.ending[node] = i
        self._pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    # -- compilation -------------------------------------------------------------------------

    def reset(self) -> None:
        """Forget all states but the start of a word, which is state 0."""
        start = ((0, -1, 0),)
        self.states = [start]
        self.number = {start: 0}
        self._pairs.clear()
        self.size = 1 << 18
        self.keys = np.full(self.size, -1, dtype=np.int64)
        self.values = np.zeros(self.size, dtype=np.int64)
        self.filled = 0

    def encode(self, word: bytes) -> list[int]:
        """Plain byte-pair encoding of a short string."""
        parts = [self.single[b] for b in word]
        while len(parts) > 1:
            found = [m for m in map(self.merges.get, zip(parts, parts[1:])) if m]
            if not found:
                break
            _, merged = best = min(found)
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.merges.get((parts[i], parts[i + 1])) == best:
                    out.append(merged)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a."""
        if a < 0:
            return True
        known = self._pairs.get((a, b))
        if known is None:
            known = self._pairs[a, b] = self.encode(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def build(self, state: int, byte: int) -> tuple[int, int]:
        """The state after ``byte`` and the change of the count."""
        grown, last, count = [], -1, 0
        for node, before, level in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.ending[child]
            if last < 0 and token >= 0 and self.may_follow(before, token):
                last, count = token, level + 1
            if self.children[child]:
                grown.append((child, before, level))
        key = (*((child, before, level - count) for child, before, level in grown), (0, last, 0))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        return found, count

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> 20) & (self.size - 1)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put new, distinct keys into the table; it is doubled before it is a third full."""
        while (self.filled + len(keys)) * 3 > self.size:
            old = self.keys >= 0
            keys = np.concatenate([self.keys[old], keys])
            values = np.concatenate([self.values[old], values])
            self.size *= 2
            self.keys = np.full(self.size, -1, dtype=np.int64)
            self.values = np.zeros(self.size, dtype=np.int64)
            self.filled = 0
        slots = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            here = slots[left]
            free = self.keys[here] < 0
            self.keys[here[free]] = keys[left[free]]  # of several for one slot, the last stays
            won = self.keys[here] == keys[left]
            self.values[here[won]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & (self.size - 1)
        self.filled += len(keys)

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of every lane: new states and changes of the count."""
        keys = states << 8 | data
        slots = self._slots(keys)
        seen = self.keys[slots]
        packed = self.values[slots]
        left = np.flatnonzero(seen != keys)
        while len(left):
            missing = left[seen[left] < 0]
            if len(missing):
                new = np.unique(keys[missing])
                built = [self.build(int(k) >> 8, int(k) & 255) for k in new]
                self._insert(new, np.array([s << 8 | d + 128 for s, d in built], dtype=np.int64))
                slots[left] = self._slots(keys[left])
            else:
                slots[left] = (slots[left] + 1) & (self.size - 1)
            seen[left] = self.keys[slots[left]]
            packed[left] = self.values[slots[left]]
            left = left[seen[left] != keys[left]]
        return packed >> 8, (packed & 255) - 128

    # -- running -----------------------------------------------------------------------------

    def _run(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, states: np.ndarray, resets, changes: np.ndarray) -> np.ndarray:
        """Run lanes over data[start:stop] in step; fills ``changes``, returns the end states."""
        order = np.argsort(start - stop, kind="stable")  # the longest lanes first
        start, length, states = start[order], (stop - start)[order], states[order].copy()
        for k in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -k))
            where = start[:active] + k
            now = states[:active]
            if resets is not None:
                now = np.where(resets[where], 0, now)
            states[:active], changes[where] = self.step(now, data[where].astype(np.int64))
        out = np.empty_like(states)
        out[order] = states
        return out

    def changes(self, data: np.ndarray, resets: np.ndarray) -> np.ndarray:
        """How much each byte of the buffer changes the count.  ``resets``: word starts."""
        n = len(data)
        changes = np.zeros(n, dtype=np.int64)
        if not n:
            return changes
        begin = np.arange(0, n, CHUNK)
        cuts = np.flatnonzero(resets)
        following = np.searchsorted(cuts, begin)
        body = np.where(following < len(cuts), cuts[np.minimum(following, len(cuts) - 1)], n)
        end = np.minimum(begin + CHUNK, n)
        fixed = body < end  # chunks that have a word start
        tail = np.zeros(len(begin), dtype=np.int64)
        tail[fixed] = self._run(data, body[fixed], end[fixed], tail[fixed], resets, changes)
        # The scan: the last chunk with a fixed end before each chunk.
        last = np.maximum.accumulate(np.where(fixed, np.arange(len(begin)), -1))
        heads = np.flatnonzero(body > begin)
        heads = heads[last[heads - 1] == heads - 1]  # others continue an earlier head
        self._run(data, begin[heads], body[heads], tail[heads - 1], None, changes)
        return changes

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens of each text of a buffer, given the texts' offsets (one more than texts)."""
        if len(self.states) > MAX_STATES:
            self.reset()
        texts = np.arange(len(offsets) - 1)
        low, high = offsets[:-1], offsets[1:]
        extra = np.zeros(len(texts), dtype=np.int64)
        raw = data.tobytes() if self.special else b""
        if any(word in raw for word in self.special):
            data, low, high, texts, extra = self._split(raw, low, high)
        starts = low[high > low]
        changes = self.changes(data, word_starts(data, starts))
        total = np.concatenate([[0], np.cumsum(changes)])
        np.add.at(extra, texts, total[high] - total[low])
        return extra

    def _split(self, raw: bytes, low: np.ndarray, high: np.ndarray):
        """Special strings count one each and end the text before them."""
        parts, owner, extra = [], [], np.zeros(len(low), dtype=np.int64)
        for i, (a, b) in enumerate(zip(low, high)):
            pieces = [raw[a:b]]
            for word in self.special:
                pieces = [x for piece in pieces for x in piece.split(word)]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        ends = np.cumsum([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        return data, np.concatenate([[0], ends[:-1]]), ends, np.array(owner), extra


def byte_letters() -> dict[str, int]:
    """The bytes behind the printable letters in which a byte-level vocabulary is written."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def compiled(path: str) -> CountTransducer:
    """The transducer of a vocabulary file; each Python worker keeps one for each file."""
    if path not in _compiled:
        _compiled[path] = CountTransducer(path)
    return _compiled[path]
