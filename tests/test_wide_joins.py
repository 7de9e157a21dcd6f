"""Overlap pairs, sieves and bitmaps against brute force; what their plans shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from famloom.operators import bitmaps, intervals, overlaps, sieve


def _records(draw, count, keys, low, high, longest):
    out = []
    for i in range(count):
        start = draw.randint(low, high)
        out.append((draw.choice(keys), i, start, start + draw.randrange(-2, longest)))
    return out


def _brute(left, right):
    return sorted(
        (a[0], a[1], b[1], max(a[2], b[2]), min(a[3], b[3]))
        for a in left
        for b in right
        if None not in (*a, *b) and a[0] == b[0]
        and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]
    )


SCHEMA = "k string, id int, start int, end int"


@pytest.mark.parametrize("longest,slice_points", [(3, 20_000), (90, 3), (5_000, 20_000)])
def test_overlap_pairs(spark, longest, slice_points):
    draw = random.Random(longest)
    left = _records(draw, 120, ["a", "a", "b", "c"], -300, 300, longest)
    right = _records(draw, 120, ["a", "a", "b", "d"], -300, 300, 40)
    left += [(None, 900, 1, 5), ("a", 901, None, 5), ("a", 902, 5, None), left[0], left[0]]
    found = overlaps.overlap_pairs(
        spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "k", slice_points=slice_points
    )
    got = sorted((r.k, r.id_1, r.id_2, r.overlap_start, r.overlap_end) for r in found.collect())
    assert got == _brute(left, right) and got


def test_overlap_pairs_of_a_hot_key(spark):
    """20,000 disjoint records of one key meet their neighbours only, not each other."""
    left = spark.range(20_000).select(
        F.lit("k").alias("k"), F.col("id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 6).alias("end")
    )
    right = left.withColumns({"start": F.col("start") + 5, "end": F.col("end") + 5})
    found = overlaps.overlap_pairs(left, right, "k", slice_points=500)
    assert found.count() == 20_000 + 19_999  # its own two and the next one's first
    joined = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joined and "NestedLoop" not in joined


def test_overlap_pairs_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("a", 1, 1, 2)], SCHEMA)
    assert overlaps.overlap_pairs(none, some, "k").count() == 0
    assert overlaps.overlap_pairs(some, none, "k").count() == 0


@pytest.fixture(scope="module")
def listed(spark):
    return spark.range(0, 40_000, 8).select(F.col("id").alias("number"))


def test_sieve_gives_the_rows_of_the_plain_joins(spark, listed):
    rows = spark.range(40_000).select((F.col("id") % 20_011).cast("int").alias("fam"), "id").unionByName(
        spark.createDataFrame([(None, -1), (None, -2)], "fam int, id bigint")
    )
    ids = listed.unionByName(listed).unionByName(spark.createDataFrame([(None,)], "number bigint"))
    lists = sieve.IdSieve(ids)
    keys = listed.select(F.col("number").cast("int").alias("fam"))
    kept = {tuple(r) for r in rows.join(keys, "fam", "left_semi").collect()}
    rest = {tuple(r) for r in rows.join(keys, "fam", "left_anti").collect()}
    assert {tuple(r) for r in lists.keep(rows, "fam").collect()} == kept
    assert {tuple(r) for r in lists.remove(rows, "fam").collect()} == rest and (None, -1) in rest
    flags = {(r.fam, r.id, r.known) for r in lists.flag(rows, "fam", "known").collect()}
    assert flags == {(*r, True) for r in kept} | {(*r, False) for r in rest}


def test_sieve_shuffles_hits_only(spark, listed):
    lists = sieve.IdSieve(listed)
    for every, share in ((8, 1.0), (7, 1 / 8), (1, 1 / 8)):
        rows = spark.range(0, 40_000, every).select(F.col("id").alias("fam"))
        hits = rows.filter("fam % 8 = 0").count()
        through = lists.marked(rows, "fam").filter("_maybe").count()
        assert hits <= through <= hits + 0.02 * (rows.count() - hits) + 5
        assert abs(hits / rows.count() - share) < 0.01
    plan = lists.marked(rows, "fam").filter("_maybe")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the filter itself moves no row


def test_sieve_of_nothing_and_text(spark):
    none = sieve.IdSieve(spark.createDataFrame([], "id string"))
    rows = spark.createDataFrame([("x",), ("",), (None,)], "fam string")
    assert none.keep(rows, "fam").count() == 0 and none.remove(rows, "fam").count() == 3
    some = sieve.IdSieve(spark.createDataFrame([("x",), ("",)], "id string"))
    assert some.remove(rows, "fam").collect() == [(None,)]
    assert sieve.filter_words(10**12) == sieve.MAX_WORDS


def test_bitmaps_equal_the_sweep(spark):
    draw = random.Random(4)
    rows = [(k, i % 2 + 1, s, e) for k, i, s, e in _records(draw, 300, ["a", "b", "c"], -200, 900, 300)]
    rows += [("n", 1, None, None), ("n", 2, 5, 1), ("w", 1, 0, 63), ("w", 2, 63, 64), ("z", 2, -64, -1)]
    spans = spark.createDataFrame(rows, "k string, side int, start int, end int")
    want = sorted(map(tuple, intervals.coverage_totals(spans, "k", "side").collect()))
    assert sorted(map(tuple, bitmaps.bitmap_totals(spans, "k", "side").collect())) == want
    one = spans.filter("side = 1")
    got = bitmaps.bitmap_lengths(bitmaps.residue_bitmaps(one, "k"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, intervals.covered_length(one, "k").collect()))
    plan = bitmaps.bitmap_totals(spans, "k", "side")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
