"""Packing documents into sequences of a fixed length by shortest-pack-first.

Each document's ids (with the end id) are cut every ``size`` ids; full pieces are a
sequence each.  The histogram of the remaining lengths, at most ``size`` numbers, is
packed longest first: each length goes to the open packs that are shortest so far (the
most room), whole groups of equal packs at a time, and opens new packs when none has
room.  A group owns a range of sequence ids, so each step is one row "ranks r..r+n of
this length go to sequences s..s+n at this offset"; pieces find their row by their rank
among the pieces of their length.

Null and empty texts are one end id.  Repeated doc_ids are separate documents; null
doc_ids are packed and come back null.  An empty table gives no pieces.  Other columns
are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from famloom.llm.common import id_and_text, shuffle_partitions, slices
from famloom.llm.tokens import WORD_SLICE, encoder, with_end
from famloom.session import durable

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=WORD_SLICE):
            ids, counts = with_end(*encoder(path).encode(batch.column("text")), end)
            data = memoryview(ids.astype("<u4").tobytes())
            pieces = -(-counts // size)
            doc = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * size
            length = np.minimum(counts[doc] - start, size)
            at = (np.cumsum(counts) - counts)[doc] + start
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(counts[doc], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def pieces_of(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, without their places."""
    return id_and_text(docs).mapInArrow(_cut(tokenizer, end, size), _PIECES)


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset) for a histogram of lengths.

    Groups of equal packs wait in a heap by their filled length; a group larger than what
    is left to place is split.  Placing one length adds at most two groups, so groups
    stay below twice the number of lengths whatever the counts are.
    """
    rows, opened = [], 0
    heap: list[tuple[int, int, int]] = []  # filled, first sequence, packs
    for length in sorted(histogram, reverse=True):
        rank, left, put = 0, histogram[length], []
        while left:
            if heap and heap[0][0] + length <= size:
                filled, first, packs = heapq.heappop(heap)
            else:
                # No open pack has room: as many new packs as fill up with this length.
                filled, first, packs = 0, opened, -(-left // (size // length))
                opened += packs
            used = min(packs, left)
            rows.append((length, rank, used, first, filled))
            rank, left = rank + used, left - used
            heapq.heappush(heap, (filled + length, first, used))
            if used < packs:
                heapq.heappush(heap, (filled, first + used, packs - used))
    return rows


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (length between 1 and ``size``).

    Ranks within a length are counted per (length, bucket of documents) with offsets from
    one count per such pair, so no length's pieces meet in one task.  The driver sees the
    histogram only.
    """
    buckets = shuffle_partitions(pieces.sparkSession)
    kept = durable(
        pieces.withColumn(
            "_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
        )
    )
    counts = kept.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = (
        Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    based = counts.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    inside = Window.partitionBy("_bucket", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = kept.withColumn("_rank", F.row_number().over(inside) - 1)
    rows = plan_packs(histogram, size)
    # A piece finds its row among those of its length by its rank; rows are sorted by both.
    lengths = np.array([r[0] for r in rows] or [0], np.int64)
    ranks = np.array([r[1] for r in rows] or [0], np.int64)
    firsts = np.array([r[3] for r in rows] or [0], np.int64)
    offsets = np.array([r[4] for r in rows] or [0], np.int64)
    by_length = np.lexsort((ranks, lengths))
    lengths, ranks, firsts, offsets = (a[by_length] for a in (lengths, ranks, firsts, offsets))
    span = int(ranks.max()) + 1 + max(histogram.values(), default=0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths * span + ranks
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_at").to_numpy()
            row = np.searchsorted(keys, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
                    pa.array(firsts[row] + rank - ranks[row], pa.int64()),
                    pa.array(offsets[row], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return (
        ranked.join(based, ["length", "_bucket"])
        .withColumn("_at", (F.col("_rank") + F.col("_base")).cast("bigint"))
        .mapInArrow(place, f"{_PIECES}, sequence_id bigint, offset bigint")
    )


def padding(packed: DataFrame, size: int = 2048) -> DataFrame:
    """One row: sequences, ids, padding ids (a sequence of a power of two needs none)."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return filled.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("n").alias("ids"),
        F.sum(F.when(power, 0).otherwise(size - F.col("n"))).alias("padding"),
    )
