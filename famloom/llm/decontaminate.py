"""Benchmark passages in documents, up to a share of word edits.

Words are runs of letters and digits, lower-cased.  A document leaks an item of n words
if some stretch of its words is within ``EDITS`` * n word edits (insert, delete, replace)
of the whole item.

1. Seeds: n words with at most e edits leave a run of q = n // (e + 1) item words
   untouched, so only places that share q words with an item can leak it.  This loses
   nothing and asks one table look-up per word.
2. Windows of the item's size at these places are embedded by the random walks of
   Chakraborty, Goldenberg and Koucky: at each of 3n steps the current word is copied and
   a random bit of (walk, step, word) says whether to move on, which turns few edits into
   few differing steps.  Each of ``WALKS`` walks is read at ``SAMPLES`` sets of
   ``COORDINATES`` random steps, one in each part of the item's own walk, before it ends;
   a window goes on if one set agrees with the item.  Of windows of unrelated words 1 to
   3 % go on.  Of 200 passages of 8 to 300 words with as many edits as allowed, at least
   99 % were found, each by several windows; with fewer edits, all.
3. The edit distance of the item and the best stretch around the window is computed in
   full.

Documents are read once where they lie; nothing is shuffled.  Items are broadcast in
blocks of at most ``BLOCK_BYTES`` of text, each block against all documents.

Null and empty texts, and items without words, leak nothing.  Rows are independent, so
repeated rows are judged alike; an empty table on either side gives no leaks.  Other
columns pass through :func:`drop_contaminated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import id_and_text, slices, text_bytes
from famloom.llm.minhash import mixed, word_hashes

EDITS = 0.25
WALKS = 8
SAMPLES = 32
COORDINATES = 2
BLOCK_BYTES = 32 << 20
#: Windows embedded, and pairs verified, at a time.
CHUNK = 2048
#: Pairs of a document's place and an item's place listed at a time.
SEEDS = 1 << 17

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FACTORS = mixed(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
_FILTER_BITS = 20


class Items(NamedTuple):
    ids: np.ndarray
    #: word hashes of all items joined, and where each begins
    words: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    edits: np.ndarray
    #: per seed length: sorted seed hashes, their items and offsets, and a quick filter
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: steps that each walk takes through each item, (walk, item)
    spans: np.ndarray
    #: (item, walk, sample) keys
    keys: np.ndarray


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row of every word) of a column without nulls."""
    return word_hashes(*text_bytes(pc.utf8_lower(texts)), apart=_APART)


def _grams(words: np.ndarray, q: int) -> np.ndarray:
    total = np.zeros(max(0, len(words) - q + 1), np.uint64)
    for i in range(q):
        total += words[i : len(words) - q + 1 + i] * _FACTORS[i % 64]
    return mixed(total)


def _draws() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(51)
    return (
        (draw.random((WALKS, SAMPLES, COORDINATES)) + np.arange(COORDINATES)) / COORDINATES,
        draw.integers(1, 1 << 63, WALKS, dtype=np.uint64) | np.uint64(1),
    )


_PLACES, _WALK_KEYS = _draws()


def walks(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(step, walk, window): place in ``words`` at each step, ``len(words)`` behind the window's end."""
    steps = 3 * int(sizes.max(initial=0))
    at = np.zeros((WALKS, len(starts)), np.int64)
    trace = np.empty((steps, WALKS, len(starts)), np.int64)
    room = np.minimum(sizes, stops - starts)
    padded = np.append(words, np.uint64(0))
    for j in range(steps):
        trace[j] = spot = np.where(at < room, starts + at, len(words))
        bit = (padded[spot] ^ np.uint64(j)) * _WALK_KEYS[:, None] * np.uint64(2 * j + 1)
        at += (bit >> np.uint64(63)).astype(np.int64)
    return trace


def embedded_keys(words: np.ndarray, trace: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(window, walk, sample) keys of walks, read at the same shares of ``spans`` steps.

    ``spans`` are the steps of the items' walks, so an item's keys hold words only; a
    window whose walk has ended by then reads an ``end`` mark, which no item has.
    """
    padded = np.append(words, np.uint64(0))
    keys = np.zeros((trace.shape[2], WALKS, SAMPLES), np.uint64)
    column = np.arange(trace.shape[2])
    for w in range(WALKS):
        for s in range(SAMPLES):
            for c in range(COORDINATES):
                step = (_PLACES[w, s, c] * spans[w]).astype(np.int64)
                keys[:, w, s] += padded[trace[step, w, column]] * _FACTORS[c]
    return keys


def prepare(ids: list[int], texts: list[str]) -> Items:
    """Items with words, their seeds, and their keys."""
    words, row = words_of(pa.array(texts, pa.string()))
    sizes = np.bincount(row, minlength=len(texts))
    full = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[full]
    sizes = sizes[full]
    edits = (sizes * EDITS).astype(np.int64)
    lengths = np.maximum(1, sizes // (edits + 1))
    seeds = {}
    for q in np.unique(lengths).tolist():
        grams, item, offset = [], [], []
        for i in np.flatnonzero(lengths == q).tolist():
            own = _grams(words[begins[i] : begins[i] + sizes[i]], q)
            grams.append(own)
            item.append(np.full(len(own), i))
            offset.append(np.arange(len(own)))
        grams, item, offset = map(np.concatenate, (grams, item, offset))
        order = np.argsort(grams, kind="stable")
        quick = np.zeros(1 << _FILTER_BITS, bool)
        quick[grams >> np.uint64(64 - _FILTER_BITS)] = True
        seeds[q] = (grams[order], item[order], offset[order], quick)
    spans, keys = np.zeros((WALKS, len(sizes)), np.int64), np.zeros((len(sizes), WALKS, SAMPLES), np.uint64)
    in_size = np.argsort(sizes, kind="stable")
    for i in range(0, len(sizes), CHUNK):
        own = in_size[i : i + CHUNK]
        trace = walks(words, begins[own], begins[own] + sizes[own], sizes[own])
        spans[:, own] = np.minimum((trace < len(words)).sum(axis=0), 3 * sizes[own])
        keys[own] = embedded_keys(words, trace, spans[:, own])
    return Items(np.array(ids, np.int64)[full], words, begins, sizes, edits, seeds, spans, keys)


def seeded(words: np.ndarray, row: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """Columns (item, window start, row), each once; a start may lie before the row's first word.

    Places come in order and at most ``SEEDS`` pairs, or those of one place, at a time, so
    an opening line that many items share lists no more than that.
    """
    for q, (grams, item, offset, quick) in items.seeds.items():
        own = _grams(words, q)
        at = np.flatnonzero(quick[own >> np.uint64(64 - _FILTER_BITS)])
        at = at[row[at] == row[at + q - 1]]
        low, high = np.searchsorted(grams, own[at], "left"), np.searchsorted(grams, own[at], "right")
        width = high - low
        ends = np.cumsum(width)
        first = 0
        while first < len(at):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + SEEDS, "right")))
            some = width[first:last]
            spot = np.arange(some.sum()) + np.repeat(low[first:last] - np.cumsum(some) + some, some)
            place = np.repeat(at[first:last], some)
            if len(spot):
                yield np.unique(np.stack([item[spot], place - offset[spot], row[place]]), axis=1)
            first = last


def best_stretch(
    words: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, items: Items
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, first word, end) of the stretch of words[low:high] nearest to each item.

    Row by row over the item's words; the start of the best path rides in the low bits.
    """
    unit = 1 << 20
    width = int((high - low).max())
    column = np.arange(width + 1)
    area = np.where(low[:, None] + column[:-1] < high[:, None], low[:, None] + column[:-1], -1)
    text = np.where(area >= 0, words[area], np.uint64(0))
    sizes = items.sizes[item]
    cost = np.broadcast_to(column, (len(low), width + 1)).astype(np.int64).copy()
    final = cost.copy()
    for i in range(int(sizes.max())):
        live = i < sizes
        word = items.words[np.minimum(items.begins[item] + i, len(items.words) - 1)]
        step = np.where((text == word[:, None]) & (area >= 0), 0, unit)
        new = cost + unit
        new[:, 1:] = np.minimum(new[:, 1:], cost[:, :-1] + step)
        new = np.minimum.accumulate(new - column * unit, axis=1) + column * unit
        cost = np.where(live[:, None], new, cost)
        final = cost
    final = np.where(low[:, None] + column <= high[:, None], final, 1 << 60)
    end = final.argmin(axis=1)
    best = final[np.arange(len(low)), end]
    return best >> 20, low + (best & (unit - 1)), low + end


def passing(
    words: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray, items: Items
) -> np.ndarray:
    """Whether the window from each start agrees with its item in one sample of one walk."""
    trace = walks(words, start, stop, items.sizes[item])
    keys = embedded_keys(words, trace, items.spans[:, item])
    return (keys == items.keys[item]).any(axis=(1, 2))


def leaks_of(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end) for each leaking (row, item), words counted in the row."""
    words, row = words_of(texts)
    if not len(words) or not len(items.ids):
        return []
    count = np.bincount(row, minlength=len(texts))
    row_end = np.cumsum(count)
    row_begin = row_end - count
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    windows = (found[:, i : i + CHUNK] for found in seeded(words, row, items) for i in range(0, found.shape[1], CHUNK))
    for item, start, own in windows:
        begin, stop = row_begin[own], row_end[own]
        near = passing(words, np.clip(start, begin, stop), stop, item, items)
        if not near.any():
            continue
        item, start, own, begin, stop = (x[near] for x in (item, start, own, begin, stop))
        room = items.edits[item]
        low = np.clip(start - room, begin, stop)
        high = np.clip(start + items.sizes[item] + room, begin, stop)
        distance, first, end = best_stretch(words, low, high, item, items)
        for k in np.flatnonzero(distance <= room).tolist():
            key = (int(own[k]), int(item[k]))
            hit = (int(distance[k]), int(first[k] - begin[k]), int(end[k] - begin[k]))
            if key not in best or hit < best[key]:
                best[key] = hit
    return [(r, i, *hit) for (r, i), hit in sorted(best.items())]


def _blocks(items: DataFrame) -> Iterator[Items]:
    """Items in blocks of bounded text, by a hash of the id."""
    rows = items.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = part.orderBy("item_id", "text").collect()
        yield prepare([-1 if r.item_id is None else r.item_id for r in held], [r.text for r in held])


def _report(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in slices(batches):
            found = leaks_of(batch.column("text"), items)
            rows, which, edits, first, end = (
                np.array([f[i] for f in found], np.int64) for i in range(5)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(items.ids[which]),
                    pa.array(items.sizes[which]),
                    pa.array(edits),
                    pa.array(first),
                    pa.array(end),
                ],
                ["doc_id", "item_id", "item_words", "edits", "first_word", "end_word"],
            )

    return run


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per leaking document and item: the nearest stretch and its word edits.

    A null item_id comes back as -1.
    """
    spark = docs.sparkSession
    kind = "doc_id bigint, item_id bigint, item_words bigint, edits bigint, first_word bigint, end_word bigint"
    found = [
        id_and_text(docs).mapInArrow(_report(spark.sparkContext.broadcast(block)), kind)
        for block in _blocks(items)
    ]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kind)


def _clean(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = leaks_of(batch.column(text).fill_null(""), shared.value)
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in found]] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    kept = docs
    for block in _blocks(items):
        kept = kept.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), text), docs.schema)
    return kept
