"""Closed integer intervals per key: merge, intersect, subtract and measure.

Every operator is one sweep.  An interval adds +1 at its start and -1 after its
end; the marks are summed per (key, position) *before* anything is grouped by
key, so a key with any number of intervals shrinks to at most one row per
distinct coordinate -- two per residue of the sequence -- before its running
depth is computed.  No interval is ever joined with another one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Keys = str | Sequence[str]


def _names(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def depth_profile(
    spans: DataFrame, key: Keys, start: str = "start", end: str = "end", side: str | None = None
) -> DataFrame:
    """Coverage depth of each side from ``pos`` up to the next mark.

    ``side`` names a column holding 1 or 2; without it everything is side 1.
    Result: key columns, ``pos``, ``step1``, ``step2`` (change at ``pos``),
    ``depth1``, ``depth2`` and ``next_pos`` (null after the last mark).
    Null and reversed intervals (start > end) cover nothing but keep their key.
    """
    keys = _names(key)
    which = F.col(side) if side else F.lit(1)
    low, high = F.col(start).cast("bigint"), F.col(end).cast("bigint")

    def mark(pos: Column, step: int) -> Column:
        return F.struct(pos.alias("pos"), F.lit(step).alias("_step"))

    nothing = F.array(mark(F.lit(0).cast("bigint"), 0))
    marks = (
        spans.select(
            *keys,
            which.alias("_side"),
            F.inline(
                F.when(low <= high, F.array(mark(low, 1), mark(high + 1, -1))).otherwise(nothing)
            ),
        )
        .groupBy(*keys, "pos")
        .agg(
            F.sum(F.when(F.col("_side") == 1, F.col("_step")).otherwise(0)).alias("step1"),
            F.sum(F.when(F.col("_side") == 2, F.col("_step")).otherwise(0)).alias("step2"),
        )
    )
    ordered = Window.partitionBy(*keys).orderBy("pos")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.select(
        *keys,
        "pos",
        "step1",
        "step2",
        F.sum("step1").over(running).alias("depth1"),
        F.sum("step2").over(running).alias("depth2"),
        F.lead("pos").over(ordered).alias("next_pos"),
    )


def maximal_runs(
    profile: DataFrame, key: Keys, inside: Callable[[Column, Column], Column]
) -> DataFrame:
    """Longest runs of positions where ``inside(depth1, depth2)`` holds, as start/end."""
    keys = _names(key)
    now = inside(F.col("depth1"), F.col("depth2"))
    before = inside(F.col("depth1") - F.col("step1"), F.col("depth2") - F.col("step2"))
    ordered = Window.partitionBy(*keys).orderBy("pos")
    return (
        profile.select(*keys, "pos", now.alias("_in"), before.alias("_was"))
        .filter(F.col("_in") != F.col("_was"))
        .select(
            *keys,
            F.col("pos").alias("start"),
            (F.lead("pos").over(ordered) - 1).alias("end"),
            "_in",
        )
        .filter("_in")
        .drop("_in")
    )


def merge_intervals(spans: DataFrame, key: Keys, start: str = "start", end: str = "end") -> DataFrame:
    """Union of the intervals of each key; touching intervals are joined."""
    profile = depth_profile(spans, key, start, end)
    return maximal_runs(profile, key, lambda a, b: a > 0)


def _two_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "start", "end"]
    return left.select(*columns, F.lit(1).alias("_which")).unionByName(
        right.select(*columns, F.lit(2).alias("_which"))
    )


def subtract_intervals(left: DataFrame, right: DataFrame, key: Keys) -> DataFrame:
    """Parts of the merged ``left`` intervals that ``right`` does not cover."""
    keys = _names(key)
    profile = depth_profile(_two_sided(left, right, keys), keys, side="_which")
    return maximal_runs(profile, keys, lambda a, b: (a > 0) & (b <= 0))


def intersect_intervals(left: DataFrame, right: DataFrame, key: Keys) -> DataFrame:
    """Overlaps of the merged ``left`` with the merged ``right`` intervals."""
    keys = _names(key)
    profile = depth_profile(_two_sided(left, right, keys), keys, side="_which")
    return maximal_runs(profile, keys, lambda a, b: (a > 0) & (b > 0))


def coverage_totals(
    spans: DataFrame, key: Keys, side: str, start: str = "start", end: str = "end"
) -> DataFrame:
    """Per key: positions covered by side 1, by side 2, and by both."""
    keys = _names(key)
    width = F.coalesce(F.col("next_pos") - F.col("pos"), F.lit(0))
    one, two = F.col("depth1") > 0, F.col("depth2") > 0

    def covered(condition: Column) -> Column:
        return F.sum(F.when(condition, width).otherwise(0)).cast("bigint")

    return (
        depth_profile(spans, keys, start, end, side)
        .groupBy(*keys)
        .agg(
            covered(one).alias("total1"),
            covered(two).alias("total2"),
            covered(one & two).alias("overlap"),
        )
    )


def covered_length(spans: DataFrame, key: Keys, start: str = "start", end: str = "end") -> DataFrame:
    """Distinct positions covered per key (inclusive lengths of the merged intervals)."""
    keys = _names(key)
    return (
        coverage_totals(spans.withColumn("_one", F.lit(1)), keys, "_one", start, end)
        .withColumnRenamed("total1", "covered")
        .drop("total2", "overlap")
    )
