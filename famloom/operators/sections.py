"""Sections of line-oriented files, by a segmented scan over slices of the files.

Whether a line lies in a section depends on the last opening or closing line before it,
perhaps far back in the file.  Each slice (a split of a file, as it was read) finds that
for itself; one row a slice then carries the state over to the next ones.  No file is
read as one value or by one task, and lines of no interest leave before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.session import durable


def section_lines(
    lines: DataFrame, key: str, block: Column, order: Column, opens: Column, closes: Column, wanted: Column
) -> DataFrame:
    """The ``wanted`` lines that stand in a section, with ``section`` numbered from 1 per key.

    ``key`` names the file, ``block`` its slice and ``order`` the place in the file; blocks
    of a key compare as their lines do.  A section begins after a line that ``opens`` holds
    for and ends before the next one that ``closes`` holds for; an opening line inside a
    section begins the next one.
    """
    event = F.when(opens, F.lit(1)).when(closes, F.lit(0))
    marked = durable(
        lines.withColumns({"_event": event, "_block": block, "_order": order}).filter(
            F.col("_event").isNotNull() | wanted
        )
    )
    slices = marked.groupBy(key, "_block").agg(
        F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("_order"))).alias("_last"),
        F.count_if(F.col("_event") == 1).alias("_opened"),
    )
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = durable(
        slices.select(
            key,
            "_block",
            F.last("_last", ignorenulls=True).over(earlier).alias("_state"),
            F.coalesce(F.sum("_opened").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    inside = Window.partitionBy(key, "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    scanned = marked.select(
        *lines.columns,
        "_block",
        "_event",
        F.last("_event", ignorenulls=True).over(inside).alias("_own"),
        F.count_if(F.col("_event") == 1).over(inside).alias("_number"),
    )
    # A slice without an event takes its state from before.
    return (
        scanned.filter("_event is null")
        .join(carried, [key, "_block"])
        .filter(F.coalesce("_own", "_state") == 1)
        .select(*lines.columns, (F.col("_number") + F.col("_before")).alias("section"))
    )
