"""Canonical length-limited Huffman codes over integer ids, coded and decoded by arrays."""

from __future__ import annotations

import numpy as np

#: Longest code in bits; the decoding table has two to this power entries.
MAX_BITS = 20
#: Ids between two bit offsets that a block keeps.
CHECKPOINT = 1024


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for absent ids.

    A single present id gets one bit.
    """
    lengths = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    if len(present) <= 1:
        lengths[present] = 1
        return lengths
    if len(present) > 1 << limit:
        raise ValueError(f"{len(present)} ids do not fit codes of {limit} bits")
    weights = counts[present].astype(np.float64)
    order = np.argsort(weights, kind="stable")
    weights = weights[order]
    n = len(weights)
    #: per level: for each item in weight order, how many leaves came before it
    levels = []
    merged = weights
    leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(leaf)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by_weight = np.argsort(both, kind="stable")
        merged = both[by_weight]
        leaf = by_weight < n
    levels.append(leaf)
    taken = 2 * n - 2
    found = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(np.count_nonzero(leaf[:taken]))
        found[:leaves] += 1
        taken = 2 * (taken - leaves)
    lengths[present[order]] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), each right-aligned in a uint32."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    # A code's place on a line of 2**32 points grows by 2**(32 - length) each time.
    places = np.cumsum(np.left_shift(np.int64(1), 32 - size)) - np.left_shift(np.int64(1), 32 - size)
    codes[order] = (places >> (32 - size)).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for each possible next ``bits`` bits, and ``bits``."""
    bits = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    repeats = np.left_shift(np.int64(1), bits - lengths[order].astype(np.int64))
    ids = np.zeros(1 << bits, np.uint32)
    sizes = np.ones(1 << bits, np.uint8)
    filled = np.repeat(order, repeats)
    ids[: len(filled)] = filled
    sizes[: len(filled)] = lengths[filled]
    return ids, sizes, bits


def encode(
    ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray
) -> tuple[bytes, int, np.ndarray]:
    """(bits, number of bits, bit offset of every ``CHECKPOINT``-th id)."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    starts = ends - sizes
    words = np.zeros(total // 32 + 2, np.uint64)
    word, inside = starts >> 5, starts & 31
    shifted = codes[ids].astype(np.uint64) << (64 - inside - sizes).astype(np.uint64)
    if len(ids):
        # Bit ranges do not overlap, so sums are unions.
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    packed = words.astype(">u4").tobytes()[: (total + 7) // 8]
    return packed, total, starts[::CHECKPOINT].astype(np.uint32)


def decode(
    blocks: list[bytes],
    counts: np.ndarray,
    checkpoints: list[np.ndarray],
    table: tuple[np.ndarray, np.ndarray, int],
) -> np.ndarray:
    """Ids of all blocks joined; every checkpoint of every block is read side by side."""
    ids, sizes, bits = table
    padded = b"".join(block + b"\0" * 8 for block in blocks)
    begins = np.cumsum([0] + [len(block) + 8 for block in blocks])[:-1]
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint32)
    window = np.ndarray(len(padded) - 3, ">u4", padded, strides=(1,))
    lanes = np.array([len(c) for c in checkpoints])
    at = np.concatenate([c.astype(np.int64) for c in checkpoints]) + np.repeat(begins * 8, lanes)
    step = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    left = np.minimum(np.repeat(counts, lanes) - step * CHECKPOINT, CHECKPOINT)
    out_at = np.repeat(np.cumsum(counts) - counts, lanes) + step * CHECKPOINT
    order = np.argsort(-left, kind="stable")
    at, left, out_at = at[order], left[order], out_at[order]
    out = np.zeros(total, np.uint32)
    shift = np.uint32(32 - bits)
    for i in range(int(left[0])):
        live = int(np.searchsorted(-left, -i, side="left"))  # lanes with more than i ids
        place = at[:live]
        peek = window[place >> 3].astype(np.uint32) << (place & 7).astype(np.uint32) >> shift
        out[out_at[:live] + i] = ids[peek]
        place += sizes[peek]
    return out
