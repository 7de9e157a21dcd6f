"""Parsing of region text, and interval arithmetic inside one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN_TYPE = "array<struct<start:int,end:int>>"


def region_segments(region: Column) -> Column:
    """Every ``start-end`` segment in the text; ``-`` alone gives an empty array."""
    pattern = F.lit(r"(\d+)-(\d+)")
    starts = F.regexp_extract_all(region, pattern, F.lit(1))
    ends = F.regexp_extract_all(region, pattern, F.lit(2))
    return F.zip_with(
        starts,
        ends,
        lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end")),
    )


def region_hull(region: Column, whole_length: Column) -> Column:
    """First and last number of the text as one span; ``-`` is the whole protein."""
    parts = F.split(region, "-")
    return F.when(
        region == "-", F.struct(F.lit(1).alias("start"), whole_length.cast("int").alias("end"))
    ).otherwise(
        F.struct(
            F.element_at(parts, 1).cast("int").alias("start"),
            F.element_at(parts, -1).cast("int").alias("end"),
        )
    )


def clip_span(start: Column, end: Column, length: Column) -> Column:
    """Order the two coordinates and clip them to ``1..length``."""
    return F.struct(
        F.greatest(F.least(start, end), F.lit(1)).alias("start"),
        F.least(F.greatest(start, end), length).alias("end"),
    )


def merged_length(spans: Column) -> Column:
    """Distinct positions covered by an array of 1-based spans held in one row.

    Spans are taken by start, so a reversed span ends before any later one starts
    and adds nothing.
    """

    def add(state: Column, span: Column) -> Column:
        fresh = span["end"] - F.greatest(state["reach"], span["start"] - 1)
        return F.struct(
            (state["total"] + F.greatest(fresh, F.lit(0))).alias("total"),
            F.greatest(state["reach"], span["end"]).alias("reach"),
        )

    empty = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    return F.aggregate(F.sort_array(spans), empty, add, lambda state: state["total"])


def template_coverage(text: Column) -> Column:
    """``x-y (z)`` as (y - x + 1) / z; null when malformed or z is zero."""
    pattern = r"^\s*([^-]*)-([^(]*)\(([^)]*)\)"
    low = F.regexp_extract(text, pattern, 1).try_cast("double")
    high = F.regexp_extract(text, pattern, 2).try_cast("double")
    size = F.regexp_extract(text, pattern, 3).try_cast("double")
    return F.try_divide(high - low + 1, size)
