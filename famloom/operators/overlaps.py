"""Pairs of overlapping interval records, by key and, for keys of many records, by bins.

The records of a key with few of them are paired as they are and held against each other:
each is shuffled once, and a record has few candidates.  Keys of more records, which are
counted first, go through a hierarchical bin join.

Two closed intervals overlap when one starts inside the other.  A start is a point, and
"point in interval" is an equi-join: an interval is cut into the few aligned bins that
tile it exactly (widths 1, 4, 16, ...; at most six a width), and a point lies in one bin
of each width.  A point meets an interval in exactly one bin, so every joined row is a
pair that overlaps: there are no candidates to throw away, no duplicates to remove, and
nothing is paired up only because it shares a key.

Bins that hold many points are split: their points are dealt to numbered slices and the
intervals of such a bin are read by each slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from famloom.session import durable

#: Bits that a bin is wider than the next finer one.
STEP = 2
#: Points of a bin that one slice holds.
SLICE_POINTS = 20_000
#: Records of a key, both sides together, up to which all its pairs are candidates.
FEW_RECORDS = 500


def _floor(value: Column, level: Column) -> Column:
    """value div 4**level, towards minus infinity; ``level`` may be a lambda's variable."""
    return F.call_function("shiftright", value, (level * STEP).cast("int"))


def _ceil(value: Column, level: Column) -> Column:
    return -_floor(-value, level)


def _tiles(start: Column, end: Column, top: int) -> Column:
    """Aligned bins (level, bin) that tile start..end exactly, levels 0..top."""

    def span(low: Column, high: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.when(low <= high, F.sequence(low, high)).otherwise(empty)

    def tiles_of(level: Column) -> Column:
        low, high = _ceil(start, level), _floor(end + 1, level) - 1
        up_low, up_high = _ceil(start, level + 1), _floor(end + 1, level + 1) - 1
        covered = (level < top) & (up_low <= up_high)
        width = F.lit(1 << STEP)
        left = span(low, F.least(high, up_low * width - 1))
        right = span(F.greatest(low, (up_high + 1) * width), high)
        bins = F.when(covered, F.concat(left, right)).otherwise(span(low, high))
        return F.transform(bins, lambda b: F.struct(level.alias("level"), b.alias("bin")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), tiles_of))


def _point_bins(point: Column, top: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(top)),
        lambda level: F.struct(level.alias("level"), _floor(point, level).alias("bin")),
    )


def _top_level(*sides: DataFrame) -> int:
    """Coarsest level that the longest interval can fill; one row reaches the driver."""
    longest = 1
    for side in sides:
        most = side.agg(F.max(F.col("_end") - F.col("_start") + 1)).first()[0]
        longest = max(longest, most or 1)
    return (longest.bit_length() - 1) // STEP


def _starts_inside(
    points: DataFrame, spans: DataFrame, keys: list[str], top: int, slice_points: int
) -> DataFrame:
    """Rows (keys, _row of points, _row of spans): ``_point`` lies in ``_from``.. ``_to``."""
    bins = [*keys, "level", "bin"]
    pointed = points.select(*keys, F.col("_row").alias("_point_row"), F.inline(_point_bins(F.col("_point"), top)))
    tiled = spans.filter("_from <= _to").select(
        *keys, F.col("_row").alias("_span_row"), F.inline(_tiles(F.col("_from"), F.col("_to"), top))
    )
    hot = durable(
        pointed.groupBy(*bins)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > slice_points)
        .select(*bins, F.ceil(F.col("_n") / slice_points).cast("int").alias("_slices"))
    )
    slices = F.coalesce("_slices", F.lit(1))
    dealt = pointed.join(hot, bins, "left").withColumn(
        "_slice", F.pmod(F.xxhash64("_point_row"), slices).cast("int")
    )
    copied = tiled.join(hot, bins, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return dealt.drop("_slices").join(copied.drop("_slices"), [*bins, "_slice"]).select(
        *keys, "_point_row", "_span_row"
    )


def _bin_join(one: DataFrame, two: DataFrame, keys: list[str], slice_points: int) -> DataFrame:
    """Rows (keys, _one, _two) of the pairs that overlap, for keys of any number of records."""
    top = _top_level(one, two)
    point = F.col("_start").alias("_point")
    # The left record starts inside the right one, or the right one later inside the left one.
    first = _starts_inside(
        one.select(*keys, point, "_row"),
        two.select(*keys, F.col("_start").alias("_from"), F.col("_end").alias("_to"), "_row"),
        keys, top, slice_points,
    ).select(*keys, F.col("_point_row").alias("_one"), F.col("_span_row").alias("_two"))
    second = _starts_inside(
        two.select(*keys, point, "_row"),
        one.select(*keys, (F.col("_start") + 1).alias("_from"), F.col("_end").alias("_to"), "_row"),
        keys, top, slice_points,
    ).select(*keys, F.col("_span_row").alias("_one"), F.col("_point_row").alias("_two"))
    return first.unionByName(second)


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    start: str = "start",
    end: str = "end",
    slice_points: int = SLICE_POINTS,
    few_records: int = FEW_RECORDS,
) -> DataFrame:
    """Every pair of a ``left`` and a ``right`` record of one key whose intervals overlap.

    Result: the keys, the other columns of both sides with ``_1`` and ``_2`` at the end of
    their names, and ``overlap_start``, ``overlap_end``.  Repeated records give repeated
    pairs.  Records with a null key, a null bound or start > end overlap nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def side(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        spans = df.select(
            *keys,
            F.col(start).cast("bigint").alias("_start"),
            F.col(end).cast("bigint").alias("_end"),
            F.struct(*rest).alias("_row"),
        )
        # A record that overlaps nothing loses its key; a constant key is no longer seen as one,
        # which would make the join by key one without keys.
        held = F.when(F.col("_start") <= F.col("_end"), F.col(keys[0])).alias(keys[0])
        return spans.select(held, *keys[1:], "_start", "_end", "_row").filter(
            reduce(and_, [F.col(k).isNotNull() for k in keys])
        )

    def bound(row: str, column: str) -> Column:
        return F.col(row)[column].cast("bigint")

    one, two = side(left), side(right)
    large = durable(
        one.select(*keys).unionAll(two.select(*keys)).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few_records).select(*keys)
    )
    binned = None
    if not large.isEmpty():
        binned = _bin_join(*(s.join(large, keys, "left_semi") for s in (one, two)), keys, slice_points)
        one, two = (s.join(large, keys, "left_anti") for s in (one, two))
    # The bounds are read from the rows, so that they are not shuffled twice.
    found = (
        one.select(*keys, F.col("_row").alias("_one"))
        .join(two.select(*keys, F.col("_row").alias("_two")), keys)
        .filter((bound("_one", start) <= bound("_two", end)) & (bound("_two", start) <= bound("_one", end)))
    )
    if binned is not None:
        found = found.unionByName(binned)
    return found.select(
        *keys,
        *[F.col("_one")[c].alias(f"{c}_1") for c in left.columns if c not in keys],
        *[F.col("_two")[c].alias(f"{c}_2") for c in right.columns if c not in keys],
        F.greatest(bound("_one", start), bound("_two", start)).alias("overlap_start"),
        F.least(bound("_one", end), bound("_two", end)).alias("overlap_end"),
    )
