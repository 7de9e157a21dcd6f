"""Weighted acyclic automata over words: shard tries, their union, minimal transducers.

A *shard trie* counts all word sequences of up to ``depth`` words of a stretch of text.
It is built by levels from sorted sequences: the nodes of a level stand in order, each
with its parent, its label (a place in the sorted word table) and its count.  Tries can
be cut at boundaries (sequences of words) into prefix ranges, and tries of one range are
united by summing the counts of equal sequences.

A :class:`CountTransducer` holds the sequences that are left after the union.  It is
built incrementally from sorted sequences, sharing equal right sides, and gives each
sequence its place in order by counting accepted sequences along the path, so counts
stand beside it and do not hinder sharing.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Trie:
    """words: sorted; levels[k]: (parent places in level k-1, labels, counts), in order."""

    words: pa.Array
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def packed(value: object) -> bytes:
    plain = pickle.dumps(value, protocol=5)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> object:
    """What :func:`packed` made in another task of the same job."""
    size = int.from_bytes(data[:8], "little")
    return pickle.loads(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True))


def trie_to_bytes(trie: Trie) -> bytes:
    words = trie.words.cast(pa.large_binary())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    joined = b"".join(words.to_pylist())
    return packed((_narrow(lengths), joined, [tuple(_narrow(x) for x in level) for level in trie.levels]))


def word_column(lengths: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def trie_from_bytes(data: bytes) -> Trie:
    lengths, joined, levels = unpacked(data)
    return Trie(
        word_column(lengths.astype(np.int64), joined),
        levels,
    )


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words in byte order, place of each given word among them)."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def build(words: pa.Array, piece: np.ndarray, depth: int, skip: int = 0) -> Trie:
    """Count all sequences of 1..depth words inside equal ``piece`` numbers.

    Sequences that end within the first ``skip`` words were counted before.
    """
    table, word = _ranked(words)
    size = len(table)
    counted = np.bincount(word[skip:], minlength=size)
    levels = [(np.zeros(size, np.int64), np.arange(size), counted)]
    node = word
    for k in range(2, depth + 1):
        ends = np.flatnonzero(piece[k - 1 :] == piece[: max(0, len(word) - k + 1)]) + k - 1
        if k < depth or skip:
            keys, inverse = np.unique(node[ends - 1] * size + word[ends], return_inverse=True)
            counts = np.bincount(inverse[ends >= skip], minlength=len(keys))
            following = np.zeros(len(word), np.int64)
            following[ends] = inverse
            node = following
        else:
            keys, counts = np.unique(node[ends - 1] * size + word[ends], return_counts=True)
        levels.append(tuple(_narrow(x) for x in (keys // max(size, 1), keys % max(size, 1), counts)))
        del keys, ends
    return Trie(table, levels)


def cut_places(trie: Trie, boundary: Sequence[bytes], words: list[bytes]) -> list[int]:
    """How many nodes of each level stand before the sequence ``boundary``."""
    places, at, match = [], 0, True
    for k, (parent, label, _) in enumerate(trie.levels):
        if k == 0:
            first, last = 0, len(label)
        else:
            first = int(np.searchsorted(parent, at))
            last = int(np.searchsorted(parent, at + 1)) if match else first
        at, hit = first, False
        if match and k < len(boundary):
            code = bisect_left(words, boundary[k])
            at = first + int(np.searchsorted(label[first:last], code))
            hit = at < last and code < len(words) and words[code] == boundary[k] and label[at] == code
        match = hit
        places.append(at + (1 if hit and len(boundary) > k + 1 else 0))
    return places


def split(trie: Trie, boundaries: Sequence[Sequence[bytes]]) -> Iterator[tuple[int, Trie]]:
    """(range number, its part) of the non-empty prefix ranges between sorted boundaries.

    Nodes on the way to a part's sequences that belong to an earlier range count 0.
    """
    words = trie.words.to_pylist()
    cuts = [[0] * len(trie.levels)]
    cuts += [cut_places(trie, boundary, words) for boundary in boundaries]
    cuts.append([len(label) for _, label, _ in trie.levels])
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low == high:
            continue
        start = list(low)
        for k in range(len(start) - 1, 0, -1):
            if start[k] < high[k]:
                start[k - 1] = min(start[k - 1], int(trie.levels[k][0][start[k]]))
        levels, used = [], []
        for k, (parent, label, count) in enumerate(trie.levels):
            span = slice(start[k], high[k])
            counts = count[span].copy()
            counts[: low[k] - start[k]] = 0
            levels.append((parent[span].astype(np.int64) - (start[k - 1] if k else 0), label[span], counts))
            used.append(label[span])
        names, places = np.unique(np.concatenate(used), return_inverse=True)
        ends = np.cumsum([len(u) for u in used])
        parts = np.split(places, ends[:-1])
        yield number, Trie(
            trie.words.take(pa.array(names)),
            [(parent, part, count) for (parent, _, count), part in zip(levels, parts)],
        )


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sums, place of each key)."""
    if not len(keys):
        return keys, counts, keys
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    places = np.empty(len(keys), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[new], np.add.reduceat(counts[order], np.flatnonzero(new)), places


def union(tries: list[Trie], least: int = 1) -> Trie:
    """Sum the counts of equal sequences; what counts below ``least`` goes with all below it.

    Nodes that count 0 lie on the way to this range's sequences and stay.
    """
    table, word = _ranked(pa.concat_arrays([t.words for t in tries]))
    starts = np.cumsum([0, *[len(t.words) for t in tries]])
    maps = [word[a:b] for a, b in zip(starts, starts[1:])]
    size = max(len(table), 1)
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    above: list[np.ndarray] = [np.zeros(1, np.int64) for _ in tries]  # new place of old nodes, or -1
    for k in range(len(tries[0].levels)):
        keys, counts, sizes, kept = [], [], [], []
        for trie, names, places in zip(tries, maps, above):
            parent, label, count = trie.levels[k]
            up = places[parent]
            stays = up >= 0
            keys.append(up[stays] * size + names[label[stays]])
            counts.append(count[stays].astype(np.int64))
            sizes.append(int(stays.sum()))
            kept.append(stays)
        distinct, sums, where = _summed(np.concatenate(keys), np.concatenate(counts))
        good = (sums >= least) | (sums == 0)
        renumbered = np.where(good, np.cumsum(good) - 1, -1)
        levels.append((distinct[good] // size, distinct[good] % size, sums[good]))
        above = []
        for stays, part in zip(kept, np.split(where, np.cumsum(sizes)[:-1])):
            places = np.full(len(stays), -1, np.int64)
            places[stays] = renumbered[part]
            above.append(places)
    return Trie(table, levels)


def sequences(trie: Trie) -> list[tuple[tuple[bytes, ...], int]]:
    """Sequences that count, in order of their words, with their counts."""
    words = trie.words.to_pylist()
    above: list[tuple[bytes, ...]] = [()]
    found = []
    for parent, label, count in trie.levels:
        above = [(*above[p], words[w]) for p, w in zip(parent.tolist(), label.tolist())]
        found += [(s, c) for s, c in zip(above, count.tolist()) if c]
    return sorted(found)


class CountTransducer:
    """Minimal acyclic automaton of sorted sequences, with a count for each."""

    def __init__(self) -> None:
        self.arcs: list[dict[bytes, int]] = []  # of each state; labels were added in order
        self.final: list[bool] = []
        self.below: list[int] = []  # sequences accepted from each state
        self.counts: list[int] = []
        self._known: dict[tuple, int] = {}
        self._path: list[tuple[bytes, dict[bytes, int], bool]] = []

    @classmethod
    def of(cls, pairs: Iterable[tuple[Sequence[bytes], int]]) -> "CountTransducer":
        """From (sequence, count) in ascending order of sequences, each once."""
        made = cls()
        open_: list[list] = [[{}, False]]  # arcs and final flag of the states on the last path
        last: Sequence[bytes] = ()
        for sequence, count in pairs:
            if made.counts and not tuple(last) < tuple(sequence):
                raise ValueError("sequences must ascend")
            shared = 0
            while shared < min(len(last), len(sequence)) and last[shared] == sequence[shared]:
                shared += 1
            made._close(open_, last, shared)
            open_ += [[{}, False] for _ in sequence[shared:]]
            open_[-1][1] = True
            made.counts.append(count)
            last = sequence
        made._close(open_, last, 0)
        made.root = made._register(*open_[0])
        del made._known
        return made

    def _close(self, open_: list[list], last: Sequence[bytes], depth: int) -> None:
        """States of the last path below ``depth`` are finished: replace or register them."""
        while len(open_) > depth + 1:
            state = self._register(*open_.pop())
            open_[-1][0][last[len(open_) - 1]] = state

    def _register(self, arcs: dict[bytes, int], final: bool) -> int:
        key = (final, tuple(arcs.items()))
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.below.append(final + sum(self.below[t] for t in arcs.values()))
        return state

    def __len__(self) -> int:
        return len(self.counts)

    def items(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        return self.compose(self)

    def compose(self, acceptor: "CountTransducer") -> Iterator[tuple[tuple[bytes, ...], int]]:
        """Sequences that both accept, in order, with this transducer's counts."""
        stack = [((), self.root, acceptor.root, 0)]
        while stack:
            prefix, mine, theirs, before = stack.pop()
            if self.final[mine] and acceptor.final[theirs]:
                yield prefix, self.counts[before]
            place = before + self.final[mine]
            asked, following = acceptor.arcs[theirs], []
            for word, state in self.arcs[mine].items():
                if word in asked:
                    following.append(((*prefix, word), state, asked[word], place))
                place += self.below[state]
            stack += reversed(following)

    def to_bytes(self) -> bytes:
        return packed((self.arcs, self.final, self.below, self.counts, self.root))

    @classmethod
    def from_bytes(cls, data: bytes) -> "CountTransducer":
        made = cls.__new__(cls)
        made.arcs, made.final, made.below, made.counts, made.root = unpacked(data)
        return made
