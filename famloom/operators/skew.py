"""Building blocks that keep hot keys and global orderings off a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.session import durable


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``left`` to the one-row-per-key ``right``, reading ``left`` once.

    One rule at every size: a plain equi-join.  ``right`` is stored first, so both sides
    are scans or plain shuffles; then adaptive execution sees their true sizes,
    broadcasts a small ``right``, and splits the partitions of hot (or null) left keys,
    which it cannot where a grouping on the same key feeds the join.
    """
    return left.join(durable(right), list(keys), how)


def flag_members(left: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean column: does ``left[key]`` occur in the one-column table ``ids``?"""
    found = (
        ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(flag, F.lit(True))
    )
    return lookup(left, found, [key]).withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).select(
        *[c for c in left.columns if c != flag], flag
    )


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows 1..n in ``order`` without moving them all to one task.

    Rows are range-partitioned and sorted, numbered inside each partition, and
    shifted by the row counts of the partitions before theirs.  The only
    single-task step sees one row per partition.
    """
    numbered = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + local + 1).cast("bigint"))
        .drop("_mid", "_part", "_offset")
    )


def group_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Number rows 1..n within each key in ``order``; no key's rows meet in one task.

    Positions over the whole table follow (keys, order); a group's first one is taken off.
    """
    placed = global_position(df, [*[F.col(k) for k in keys], *order], "_global")
    firsts = durable(placed.groupBy(*keys).agg(F.min("_global").alias("_first"))).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], "_first"
    )
    same = [placed[k].eqNullSafe(firsts[f"_key_{k}"]) for k in keys]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return (
        placed.join(firsts, condition)
        .withColumn(name, F.col("_global") - F.col("_first") + 1)
        .select(*df.columns, name)
    )
