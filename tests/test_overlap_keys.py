"""Overlap pairs of keys with few and with many records, and what is shuffled for them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from famloom.operators import overlaps
from test_wide_joins import SCHEMA, _brute, _records


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few_records", [0, 40, 100, 10_000])
def test_few_and_many_records(spark, few_records):
    draw = random.Random(few_records)
    left = _records(draw, 150, ["a", "a", "b", "c"], -300, 300, 70)
    right = _records(draw, 150, ["a", "a", "b", "d"], -300, 300, 40)
    left += [(None, 900, 1, 5), ("a", 901, None, 5), ("a", 902, 5, None), left[0], left[0]]
    right += [(None, 900, 1, 5)]
    found = overlaps.overlap_pairs(
        spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "k", few_records=few_records
    )
    got = sorted((r.k, r.id_1, r.id_2, r.overlap_start, r.overlap_end) for r in found.collect())
    assert got == _brute(left, right) and got
    assert ("level" in _plan(found)) == (few_records < 10_000)


def test_keys_of_few_records_are_not_cut_into_bins(spark):
    """Each record of such a key is shuffled once, not once a bin; one hot key changes that for itself only."""
    left = spark.range(3_000).select(
        (F.col("id") % 1_000).alias("k"), "id", F.col("id").alias("start"), (F.col("id") + 40).alias("end")
    )
    found = overlaps.overlap_pairs(left, left, "k")
    assert "level" not in _plan(found) and found.count() == 3_000
    hot = left.unionByName(left.withColumn("k", F.lit(5)))
    both = overlaps.overlap_pairs(hot, hot, "k")
    assert "level" in _plan(both)
    pairs = both.groupBy((F.col("k") == 5).alias("hot")).count().collect()
    meets = sum(min(3_000, i + 41) - max(0, i - 40) for i in range(3_000))
    own = 3 + 2 * sum(min(3_000, i + 41) - max(0, i - 40) for i in (5, 1005, 2005))
    assert {r.hot: r["count"] for r in pairs} == {False: 2_997, True: meets + own}


def test_several_keys_and_nan(spark):
    rows = [("x", float("nan"), 1, 5), ("x", 2.0, 4, 9), ("x", None, 1, 9), (None, 2.0, 1, 9)]
    df = spark.createDataFrame(rows, "a string, b double, start int, end int")
    for few_records in (0, 10):
        found = overlaps.overlap_pairs(df, df, ["a", "b"], few_records=few_records)
        assert sorted((r.overlap_start, r.overlap_end) for r in found.collect()) == [(1, 5), (4, 9)]
