"""Bundles of small files: whole reads, point reads, ranges as gzip files, uncommitted bundles."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from famloom.sources import bundles


@pytest.fixture
def written(spark, tmp_path):
    rows = [(f, i, f">{f}_{i}\nACDE{'K' * (f % 7)}") for f in range(300) for i in range(1 + f % 3)]
    rows += [(5000, i, f">hot{i}\n{'M' * 90}") for i in range(4000)]
    rows += [(6000, 0, None), (None, 0, "no family"), (7000, 0, ""), (7001, 0, "é" * 50_000)]
    df = spark.createDataFrame(rows, "family int, n int, text string")
    path = str(tmp_path / "bundles")
    bundles.write_bundles(df, path, "family", "text", ["n"], member_bytes=20_000)
    expected: dict = {}
    for family, _, text in sorted(rows, key=lambda r: (r[0] is not None, r[:2])):
        if text is not None:
            expected[family] = expected.get(family, "") + text + "\n"
    return path, expected


def _texts(rows):
    found: dict = {}
    for row in sorted(rows, key=lambda r: r.part):
        found[row.family] = found.get(row.family, "") + row.content
    return found


def test_all_families_come_back_in_order(spark, written):
    path, expected = written
    rows = bundles.read_bundles(spark, path).collect()
    assert _texts(rows) == expected
    assert sum(row.family == 5000 for row in rows) >= 18  # a large family is many members


def test_point_reads(spark, written):
    path, expected = written
    wanted = spark.createDataFrame([(3,), (3,), (299,), (5000,), (12345,)], "id int")
    rows = bundles.read_bundles(spark, path, wanted).collect()
    assert _texts(rows) == {f: expected[f] for f in (3, 299, 5000)}
    one = bundles.read_family(spark, path, 7001).collect()
    assert "".join(r.content for r in one) == expected[7001]
    assert bundles.read_family(spark, path, 6000).count() == 0


def test_the_index_is_pruned_by_family(spark, written):
    path, _ = written
    index = bundles.bundle_index(spark, path).filter(F.col("family") == 3)
    assert "EqualTo(family,3)" in index._jdf.queryExecution().toString()
    assert bundles.bundle_index(spark, path).select("file").distinct().count() <= 8


def test_a_range_is_a_gzip_file(spark, written):
    path, expected = written
    data = b""
    for row in bundles.bundle_index(spark, path).filter("family = 5000").orderBy("part").collect():
        with open(f"{path}/data/{row.file}", "rb") as handle:
            handle.seek(row.offset)
            data += handle.read(row.length)
    assert gzip.decompress(data).decode() == expected[5000]


def test_bundles_that_no_index_names_are_not_read(spark, written):
    path, expected = written
    with gzip.open(f"{path}/data/bundle-000000-lost.gz", "wb") as handle:
        handle.write(b"from a lost attempt\n")
    assert _texts(bundles.read_bundles(spark, path).collect()) == expected


def test_empty_table_and_lines(spark, tmp_path):
    empty = spark.createDataFrame([], "family string, text string")
    path = str(tmp_path / "none")
    bundles.write_bundles(empty, path, "family", "text")
    assert bundles.read_bundles(spark, path).count() == 0
    with pytest.raises(ValueError, match="already holds"):
        bundles.write_bundles(empty, path, "family", "text")
    rows = spark.createDataFrame([("a", ">x\nAC"), ("b", "")], "family string, text string")
    path = str(tmp_path / "two")
    bundles.write_bundles(rows, path, "family", "text")
    lines = bundles.bundle_lines(bundles.read_bundles(spark, path)).collect()
    assert sorted((r.family, r.line_order, r.value) for r in lines) == [
        ("a", 0, ">x"), ("a", 1, "AC"), ("b", 0, "")
    ]
