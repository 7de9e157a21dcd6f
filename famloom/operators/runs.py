"""Runs of equal states along an ordered sequence of rows per key, or inside long texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from famloom.session import durable

#: Bytes of text whose runs are found at once; bounds what a task holds besides its batch.
TEXT_BYTES = 1 << 20


def state_runs(df: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Maximal runs of equal ``state`` per key: state, x, y (1-based row positions).

    The rows of one key may span many tasks: rows are range-partitioned on
    (key, order), runs are found inside each slice, and only the first and last
    run of every slice are compared across slices.
    """
    sliced = (
        df.select(key, *order, F.col(state).alias("_state"))
        .repartitionByRange(F.col(key), *[F.col(c) for c in order])
        .withColumn("_slice", F.spark_partition_id())
    )
    slice_rows = Window.partitionBy(key, "_slice")
    rows = slice_rows.orderBy(*order)
    marked = sliced.select(
        key,
        "_slice",
        F.col("_state").alias("state"),
        F.row_number().over(rows).alias("_first"),
        F.count(F.lit(1)).over(slice_rows).alias("_rows"),
        F.coalesce(F.col("_state") != F.lag("_state").over(rows), F.lit(True)).alias("_new"),
    )
    starts = slice_rows.orderBy("_first")
    next_start = F.lead("_first").over(starts)
    local = durable(
        marked.filter("_new").select(
            key,
            "_slice",
            "state",
            "_rows",
            "_first",
            F.coalesce(next_start - 1, F.col("_rows")).alias("_last"),
            (F.col("_first").eqNullSafe(1) | next_start.isNull()).alias("_edge"),
        )
    )
    # One row per (key, slice): how many rows of the key come before it.
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        local.groupBy(key, "_slice")
        .agg(F.max("_rows").alias("_rows"))
        .select(key, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    placed = local.join(slices, [key, "_slice"]).select(
        key,
        "_slice",
        "state",
        (F.col("_first") + F.col("_offset")).alias("x"),
        (F.col("_last") + F.col("_offset")).alias("y"),
        "_edge",
    )
    inner = placed.filter(~F.col("_edge")).select(key, "state", "x", "y")
    across = Window.partitionBy(key).orderBy("x")
    joins_previous = (
        (F.lag("state").over(across) == F.col("state"))
        & (F.lag("_slice").over(across) != F.col("_slice"))
    )
    # Start and end of every stretch of edge runs that continue each other.
    edges = (
        placed.filter("_edge")
        .withColumn("_new", ~F.coalesce(joins_previous, F.lit(False)))
        .withColumn("_end_of_previous", F.lag("y").over(across))
        .withColumn("_last_end", F.max("y").over(Window.partitionBy(key)))
        .filter("_new")
        .select(
            key,
            "state",
            "x",
            F.coalesce(F.lead("_end_of_previous").over(across), F.col("_last_end")).alias("y"),
        )
    )
    return inner.unionByName(edges)


def _text_finder(column: int, codes: list[int], names: list[str]) -> Callable:
    def runs_of(cut: np.ndarray, raw: np.ndarray) -> Iterator[pa.Array]:
        # A character counts by its first byte; those of other states need not be told apart.
        heads = (raw & 0xC0) != 0x80
        others = np.flatnonzero(~heads)
        if len(others):
            cut, raw = cut - np.searchsorted(others, cut), raw[heads]
        new = np.ones(len(raw), bool)
        new[1:] = raw[1:] != raw[:-1]
        new[cut[cut < len(raw)]] = True
        starts = np.flatnonzero(new)
        state, ends = raw[starts], np.append(starts[1:], len(raw))
        first = np.searchsorted(starts, cut)
        before = np.repeat(cut[:-1], np.diff(first))
        x, y = (starts - before + 1).astype(np.int32), (ends - before).astype(np.int32)
        for code in codes:
            mine = np.flatnonzero(state == code)
            offsets = np.searchsorted(mine, first).astype(np.int32)
            yield pa.ListArray.from_arrays(
                offsets, pa.StructArray.from_arrays([pa.array(x[mine]), pa.array(y[mine])], ["x", "y"])
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts = batch.num_rows, batch.column(column)
            if n == 0:
                continue
            width = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, width, n + 1, texts.offset * width.itemsize).astype(np.int64)
            data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            low = 0
            while low < n:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + TEXT_BYTES, "right")) - 1)
                cut = offsets[low : high + 1]
                found = runs_of(cut - cut[0], data[cut[0] : cut[-1]])
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rows.columns, *found], names)
                low = high

    return run


def text_runs(df: DataFrame, text: str, columns: dict[str, str]) -> DataFrame:
    """Add, per state, the runs of its character in ``text`` as (x, y), 1-based and inclusive.

    ``columns``: the added column of each state; states are ASCII characters.  Positions
    count characters.  A null text has no runs.  Memory is bounded by a batch of rows, or
    by one text.
    """
    place = StructType().add("x", IntegerType()).add("y", IntegerType())
    schema = StructType(list(df.schema.fields))
    for name in columns.values():
        schema = schema.add(name, ArrayType(place))
    finder = _text_finder(df.columns.index(text), [ord(state) for state in columns], schema.names)
    return df.mapInArrow(finder, schema)
