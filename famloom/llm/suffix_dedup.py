"""Repeated byte strings across documents, by longest-previous-factor arrays.

Texts are UTF-8 bytes; a string of ``span`` bytes is a window.  Windows that occur twice
share the smallest hash among their short grams, so each run of windows around one such
anchor is a segment, and equal windows lie in segments of one anchor:

1. Segments of anchors that occur once cannot repeat and go.
2. Equal segments (by two independent 64-bit digests) repeat whole; one of each goes on,
   the first by (doc_id, position).
3. Different segments of one anchor meet in one task.  There a suffix array over their
   windows is sorted (eight bytes a round, only ties go on), neighbours get their longest
   common prefix, and the previous and next smaller positions in suffix order give every
   window its longest earlier match; mirrored, its longest later one.  An anchor with more
   than ``GROUP`` different segments does not fit a task: its windows are matched one by
   one by their digests, with partial counts before the shuffle.

``keep="first"`` removes the bytes of windows that have an earlier match; ``keep="none"``
those of windows that have any other match.  Matches never cross documents.

Null text is empty and has no window; so has a text shorter than ``span``.  Rows with a
null doc_id take part and sort first.  Repeated rows (same id and text) count as copies;
with ``keep="first"`` they share their positions, so all or none of them stay.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import binary_rows, id_and_text, slices, text_bytes
from famloom.llm.minhash import mixed
from famloom.session import discard, durable

SPAN = 200
GRAM = 32
#: Different segments of one anchor that one task compares by their suffixes.
GROUP = 4096
#: Bytes of segments whose suffixes are sorted together.
SORTED_BYTES = 2 << 20

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}

_KEY = "doc_id bigint, mark bigint"


class _Hashes:
    """Polynomial hashes of any part of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        if len(_POWERS.get((base, True), ())) <= n:
            for up in (True, False):
                steps = np.full(n + 1, base if up else pow(base, -1, 1 << 64), np.uint64)
                steps[0] = 1
                _POWERS[base, up] = np.cumprod(steps)
        self.down = _POWERS[base, False]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[base, True][:n], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN):
    """(row, anchor, digest, first window, last window) of all segments; windows count from 0 in a row."""
    gram = min(GRAM, max(1, span // 4))
    width = span - gram + 1
    if len(data) < span:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    grams = _Hashes(data, _BASES[0]).grams(gram)
    count = len(grams) - width + 1
    least, step = grams, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:count], least[width - step :])
    sizes = np.diff(offsets)
    valid = np.zeros(count + 1, np.int8)
    fit = sizes >= span
    np.add.at(valid, offsets[:-1][fit], 1)
    np.add.at(valid, (offsets[1:] - span + 1)[fit], -1)
    valid = np.cumsum(valid[:count]).astype(bool)
    opens = np.ones(count, bool)
    # A run ends where the least gram changes, or leaves the window and comes again.
    opens[1:] = (least[1:] != least[:-1]) | (grams[: count - 1] == least[:-1])
    opens[offsets[:-1][fit]] = True
    opens &= valid
    first = np.flatnonzero(opens)
    if not len(first):
        return segments(data[:0], offsets[:1], span)
    inside = np.flatnonzero(valid)
    last = np.zeros(len(first), np.int64)
    last[(np.cumsum(opens) - 1)[inside]] = inside
    row = np.searchsorted(offsets, first, side="right") - 1
    digest = _Hashes(data, _BASES[1]).of(first, last + span)
    return row, least[first], digest, first - offsets[row], last - offsets[row]


def suffix_array(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): windows of ``span`` bytes at ``starts`` sorted, ties by index.

    lcp[i] is the common prefix of the windows at ranks i-1 and i, at most ``span``.
    """
    padded = np.concatenate([data, np.zeros(span + 8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, ">u8", padded.tobytes(), strides=(1,))
    order = np.arange(len(starts))
    lcp = np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts))  # ranks still tied with a neighbour
    group = np.zeros(len(starts), np.int64)  # first rank of the tie
    for depth in range(0, span, 8):
        if not len(tied):
            break
        here = order[tied]
        key = eight[starts[here] + depth].astype(np.uint64)
        if span - depth < 8:
            key &= np.uint64(~((1 << 8 * (8 - span + depth)) - 1) & (1 << 64) - 1)
        by = np.lexsort((here, key, group[tied]))
        order[tied] = here[by]
        key = key[by]
        same_group = np.zeros(len(tied), bool)
        same_group[1:] = group[tied][1:] == group[tied][:-1]
        differ = np.ones(len(tied), bool)
        differ[1:] = (key[1:] != key[:-1]) | ~same_group[1:]
        cut = np.flatnonzero(differ & same_group)
        apart = (key[cut] ^ key[cut - 1]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        lcp[tied[cut]] = depth + apart.argmax(axis=1)
        group[tied] = tied[np.maximum.accumulate(np.where(differ, np.arange(len(tied)), 0))]
        alone = differ & np.append(differ[1:], True)
        tied = tied[~alone]
    rest = np.zeros(len(starts), bool)
    rest[tied] = True
    rest &= group != np.arange(len(starts))
    lcp[rest] = span
    return order, lcp


def _nearest_smaller(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """By rank: common prefix with the nearest rank before it that holds a smaller position.

    Every rank points at its predecessor and follows the pointers of larger positions,
    all at once, until it meets a smaller one; the least prefix on the way comes along.
    """
    n = len(order)
    position = np.append(order, -1)
    link = np.arange(-1, n - 1)
    common = lcp.copy()
    moving = np.flatnonzero(position[link] > order) if n else link
    while len(moving):
        over = link[moving]
        common[moving] = np.minimum(common[moving], common[over])
        link[moving] = link[over]
        moving = moving[position[link[moving]] > order[moving]]
    common[link < 0] = 0
    return common


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Per position: the longest prefix (up to the sorted depth) that starts at an earlier one."""
    before = _nearest_smaller(order, lcp)
    after = _nearest_smaller(order[::-1], np.append(0, lcp[1:][::-1]) if len(lcp) else lcp)[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def longest_next_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Per position: the longest prefix that starts at a later one."""
    return longest_previous_factor(len(order) - 1 - order, lcp)[::-1]


def _segments(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            row, anchor, digest, first, last = segments(*text_bytes(batch.column("text")), span)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("mark").take(at),
                    pa.array(anchor.view(np.int64)),
                    pa.array(digest.view(np.int64)),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                ],
                ["doc_id", "mark", "anchor", "digest", "first", "last"],
            )

    return run


def _contexts(span: int):
    """Bytes of the segments that a document's list names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            row = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            size = last - first + span
            ends = np.cumsum(size)
            spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[row] + first - ends + size, size)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("mark").take(at),
                    flat.field("anchor"),
                    flat.field("first"),
                    flat.field("hot"),
                    binary_rows(data[spots], ends),
                ],
                ["doc_id", "mark", "anchor", "first", "hot", "bytes"],
            )

    return run


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of flags within one owner."""
    new = flags.copy()
    new[1:] &= ~flags[:-1] | (owner[1:] != owner[:-1])
    stop = flags.copy()
    stop[:-1] &= ~flags[1:] | (owner[1:] != owner[:-1])
    return np.flatnonzero(new), np.flatnonzero(stop)


def _matched(span: int, keep: str):
    """Suffix arrays over whole groups of one anchor; rows come sorted by anchor and position."""

    def match(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets = text_bytes(table.column("bytes"))
        windows = np.diff(offsets) - span + 1
        owner = np.repeat(np.arange(len(windows)), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, lcp = suffix_array(data, offsets[owner] + inside, span)
        hit = longest_previous_factor(order, lcp) >= span
        if keep == "none":
            hit |= longest_next_factor(order, lcp) >= span
        begin, end = _runs(hit, owner)
        at = pa.array(owner[begin])
        first = table.column("first").to_numpy()[owner[begin]]
        return pa.RecordBatch.from_arrays(
            [
                table.column("doc_id").take(at),
                table.column("mark").take(at),
                pa.array(first + inside[begin], pa.int64()),
                pa.array(first + inside[end] + span, pa.int64()),
            ],
            ["doc_id", "mark", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in slices(batches, "bytes", SORTED_BYTES):
            anchors = batch.column("anchor").to_numpy()
            edges = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if held and size >= SORTED_BYTES:
                cut = 0 if anchors[0] != last else (edges[0] if len(edges) else batch.num_rows)
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield match(held)
                    held, size = [], 0
                    batch = batch.slice(cut)
                else:
                    continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            last = anchors[-1]
        if held:
            yield match(held)

    return run


def _windows(span: int):
    """Digests of single windows of the segments of an anchor that no task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 18):
            data, offsets = text_bytes(batch.column("bytes"))
            windows = np.diff(offsets) - span + 1
            owner = np.repeat(np.arange(len(windows)), windows)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = offsets[owner] + inside
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("mark").take(at),
                    pa.array(batch.column("first").to_numpy()[owner] + inside, pa.int64()),
                    *(pa.array(_Hashes(data, b).of(begin, begin + span).view(np.int64)) for b in _BASES),
                ],
                ["doc_id", "mark", "start", "one", "two"],
            )

    return run


def with_mark(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text; the mark tells rows of one doc_id apart."""
    return id_and_text(docs).withColumn("mark", F.xxhash64("text")).select("doc_id", "mark", "text")


def repeated_spans(docs: DataFrame, span: int = SPAN, keep: str = "first") -> DataFrame:
    """Rows doc_id, mark, start, end: bytes to remove; intervals may touch or overlap."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    texts = with_mark(docs)
    every = durable(
        texts.mapInArrow(_segments(span), f"{_KEY}, anchor bigint, digest bigint, first bigint, last bigint")
    )
    # Stored sides keep each join between two plain shuffles, which adaptive execution can split.
    again = durable(
        every.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    )
    shared = durable(every.join(again, "anchor"))
    discard(every, again)
    place = F.struct("doc_id", "mark", "first", "last")
    kinds = durable(
        shared.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("head"))
    )
    copies = shared.join(kinds.filter("n > 1"), ["anchor", "digest"])
    if keep == "first":
        copies = copies.filter(~place.eqNullSafe(F.col("head")))
    whole = copies.select("doc_id", "mark", F.col("first").alias("start"), (F.col("last") + span).alias("end"))

    varied = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1")
    listed = (
        kinds.join(varied, "anchor")
        .select(
            "head.doc_id", "head.mark", "head.first", "head.last", "anchor", (F.col("_kinds") > GROUP).alias("hot")
        )
        .groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("first", "last", "anchor", "hot")).alias("wanted"))
    )
    same = texts.doc_id.eqNullSafe(listed.doc_id) & (texts.mark == listed.mark)
    contexts = durable(
        # Repeated rows have one text; one of them stands for all.
        texts.join(listed, same)
        .select(texts.doc_id, texts.mark, "text", "wanted")
        .mapInArrow(
            _contexts(span), f"{_KEY}, anchor bigint, first bigint, hot boolean, bytes binary"
        )
    )
    some = (
        contexts.filter("not hot")
        .dropDuplicates(["doc_id", "mark", "anchor", "first"])
        .repartition("anchor")
        .sortWithinPartitions("anchor", F.asc_nulls_first("doc_id"), "mark", "first")
        .mapInArrow(_matched(span, keep), f"{_KEY}, start bigint, end bigint")
    )
    single = durable(
        contexts.filter("hot")
        .mapInArrow(_windows(span), f"{_KEY}, start bigint, one bigint, two bigint")
        .dropDuplicates(["doc_id", "mark", "start"])
    )
    spot = F.struct("doc_id", "mark", "start")
    met = durable(
        single.groupBy("one", "two")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(spot).alias("_head"))
        .filter("_n > 1")
    )
    hits = single.join(met, ["one", "two"])
    if keep == "first":
        hits = hits.filter(~spot.eqNullSafe(F.col("_head")))
    hot = hits.select("doc_id", "mark", "start", (F.col("start") + span).alias("end"))
    return whole.unionByName(some).unionByName(hot)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        spans, kept = [], []
        for i, found in enumerate(batch.column("found")):
            own = data[offsets[i] : offsets[i + 1]]
            if not found.is_valid or not len(found):
                spans.append([])
                kept.append(own.tobytes())
                continue
            edges = found.values
            start, end = edges.field("start").to_numpy(), edges.field("end").to_numpy()
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.append(True, start[1:] > reach[:-1])
            begins, ends = start[new], reach[np.append(new[1:], True)]
            gone = np.zeros(len(own) + 1, np.int32)
            gone[begins] += 1
            gone[ends] -= 1
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(begins, ends)])
            kept.append(own[np.cumsum(gone[:-1]) == 0].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def without_repeats(docs: DataFrame, span: int = SPAN, keep: str = "first") -> DataFrame:
    """Per document: doc_id, n_bytes, spans (maximal removed runs), kept (the bytes that stay)."""
    texts = with_mark(docs)
    found = (
        repeated_spans(docs, span, keep)
        .groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("start", "end")).alias("found"))
    )
    same = texts.doc_id.eqNullSafe(found.doc_id) & (texts.mark == found.mark)
    return (
        texts.join(found, same, "left")
        .select(texts.doc_id, "text", "found")
        .mapInArrow(
            _cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
        )
    )


def digest_rows(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of :func:`without_repeats`."""
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


