"""Residue sets as bitmap blocks, for keys with any number of segments.

A set is kept as one 64-bit word per (key, block of 64 positions).  A span gives the
words it touches, each with the bits of its part, so a segment of 200 residues is four
or five rows; equal blocks are OR-ed with partial sums before the shuffle.  Set sizes
and intersections are bit counts of single rows: there is no sweep over a key, no sort
and no window, and a key with many segments never meets in one task.

Blocks follow the length of the spans, which residues bound; for coordinates without
such a bound use :mod:`famloom.operators.intervals`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: log2 of the positions of a block.
_WIDTH = 6


def _bits_from(low: Column) -> Column:
    """Bits low..63."""
    return F.call_function("shiftleft", F.lit(-1).cast("bigint"), low.cast("int"))


def _bits_to(high: Column) -> Column:
    """Bits 0..high."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (63 - high).cast("int"))


def _words(start: Column, end: Column) -> Column:
    """(block, bits) of the closed span; null and reversed spans give none."""
    first, last = F.shiftright(start, _WIDTH), F.shiftright(end, _WIDTH)

    def word(block: Column) -> Column:
        low = F.when(block == first, _bits_from(start - block * 64)).otherwise(F.lit(-1).cast("bigint"))
        high = F.when(block == last, _bits_to(end - block * 64)).otherwise(F.lit(-1).cast("bigint"))
        return F.struct(block.alias("block"), low.bitwiseAND(high).alias("bits"))

    # A span that covers nothing keeps its key in a block without bits.
    nothing = F.array(F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("bits")))
    return F.when(start <= end, F.transform(F.sequence(first, last), word)).otherwise(nothing)


def residue_bitmaps(
    spans: DataFrame, key: str | Sequence[str], start: str = "start", end: str = "end"
) -> DataFrame:
    """(keys, block, bits): the union of each key's spans."""
    keys = [key] if isinstance(key, str) else list(key)
    low, high = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    return (
        spans.select(*keys, F.inline(_words(low, high)))
        .groupBy(*keys, "block")
        .agg(F.bit_or("bits").alias("bits"))
    )


def bitmap_lengths(bitmaps: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(keys, covered): positions in each key's set."""
    keys = [key] if isinstance(key, str) else list(key)
    return bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("covered"))


def bitmap_totals(
    spans: DataFrame, key: str | Sequence[str], side: str, start: str = "start", end: str = "end"
) -> DataFrame:
    """Per key: positions of side 1, of side 2, and of both (``total1``, ``total2``, ``overlap``).

    The same result as :func:`famloom.operators.intervals.coverage_totals`.
    """
    keys = [key] if isinstance(key, str) else list(key)
    low, high = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    which = F.col(side).alias("_side")

    def bits(number: int) -> Column:
        none = F.lit(0).cast("bigint")
        return F.bit_or(F.when(F.col("_side") == number, F.col("bits")).otherwise(none))

    blocks = (
        spans.select(*keys, which, F.inline(_words(low, high)))
        .groupBy(*keys, "block")
        .agg(bits(1).alias("_one"), bits(2).alias("_two"))
    )

    def total(column: Column) -> Column:
        return F.sum(F.bit_count(column)).cast("bigint")

    return blocks.groupBy(*keys).agg(
        total(F.col("_one")).alias("total1"),
        total(F.col("_two")).alias("total2"),
        total(F.col("_one").bitwiseAND(F.col("_two"))).alias("overlap"),
    )
