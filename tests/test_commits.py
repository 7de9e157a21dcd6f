"""Versioned tables and rejected rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from famloom.functions.annotations import document_faults, hit_spans, parsed_hits
from famloom.operators.quarantine import part_rows
from famloom.operators.versions import CommitConflict, VersionedTable


@pytest.fixture
def held(spark, tmp_path):
    made = VersionedTable(spark, f"file:{tmp_path}/table")
    rows = spark.range(100).select("id", F.lit("old").alias("name"), (F.col("id") * 2).alias("size"))
    made.create(rows, "id", buckets=8)
    return made


def _names(df):
    return {r.id: r.name for r in df.collect()}


def test_updates_make_versions(spark, held):
    changes = spark.createDataFrame([(3, "new"), (50, None), (777, "nobody")], "id bigint, name string")
    second = held.update(changes, ["name"])
    assert second.number == 2 and _names(held.read()) == {**dict.fromkeys(range(100), "old"), 3: "new", 50: None}
    assert _names(held.read(1)) == dict.fromkeys(range(100), "old")
    assert held.read().filter("id = 3").first()["size"] == 6
    third = held.update(spark.createDataFrame([(3, "a", 1), (3, "b", 2)], "id bigint, name string, n int"), ["name"], "n")
    assert _names(held.read())[3] == "b"
    # Only the bucket of id 3 was written again.
    assert len([b for b, f in third.folders.items() if f != second.folders[b]]) == 1


def test_a_crash_before_the_manifest_changes_nothing(spark, held):
    changes = spark.createDataFrame([(1, "lost")], "id bigint, name string")
    held.prepare_update(changes, ["name"])  # data is written, then the writer dies
    assert held.latest().number == 1 and _names(held.read())[1] == "old"
    # A manifest cut off while it was written is passed over, and its number is not used again.
    stream = held._files.create(held._path(f"{held.root}/versions/{2:012d}.json"), False)
    stream.write(bytearray(b'{"number": 2, "par'))
    stream.close()
    assert held.latest().number == 1 and _names(held.read())[1] == "old"
    assert held.update(changes, ["name"]).number == 3 and _names(held.read())[1] == "lost"


def test_of_two_writers_one_fails(spark, held):
    mine = held.prepare_update(spark.createDataFrame([(1, "mine")], "id bigint, name string"), ["name"])
    theirs = held.prepare_update(spark.createDataFrame([(2, "theirs")], "id bigint, name string"), ["name"])
    held.commit(theirs)
    with pytest.raises(CommitConflict):
        held.commit(mine)
    assert _names(held.read())[1] == "old" and _names(held.read())[2] == "theirs"
    with pytest.raises(CommitConflict):
        held.create(spark.range(3), "id")


def test_expired_versions_take_their_data_along(spark, held):
    for name in ("a", "b"):
        held.update(spark.createDataFrame([(1, name)], "id bigint, name string"), ["name"])
    before = _names(held.read())
    assert held.expire(keep=1) and [v.number for v in held.versions()] == [3]
    assert _names(held.read()) == before
    with pytest.raises(ValueError):
        held.read(1)


def test_empty_and_repeated(spark, tmp_path):
    empty = VersionedTable(spark, f"file:{tmp_path}/none")
    assert empty.latest() is None
    with pytest.raises(ValueError):
        empty.read()
    empty.create(spark.createDataFrame([], "id bigint, name string"), "id")
    assert empty.read().count() == 0
    empty.update(spark.createDataFrame([(1, "x")], "id bigint, name string"), ["name"])
    assert empty.read().count() == 0


DOCUMENTS = {
    "": None, "{}": None, '{"p":[["a",1,2,3,4,5,6]],"x":1}': None, '{"p":null,"m":[]}': None,
    "nonsense": "not a JSON object", "[1]": "not a JSON object", '{"p":[["a",1]]}': "short hit under p",
    '{"p":5}': "p is not a list of hits", '{"m":{"a":1}}': "m is not a list of hits",
    '{"m":[["F",1,2,"x",4]]}': "bad coordinate under m", '{"p":[null]}': "short hit under p",
    '{"p":[["a",1,2,3,4,5,6]': "not a JSON object",
}


def test_documents_are_parted_in_one_pass(spark):
    rows = [(i, text) for i, text in enumerate([*DOCUMENTS, None])] + [(0, "nonsense")]
    df = spark.createDataFrame(rows, "id int, metadata string")
    parted = part_rows(df, document_faults(F.col("metadata")))
    good = {(r.id, r.metadata) for r in parted.good.collect()}
    bad = sorted((r.metadata, r.reject_reason) for r in parted.rejected.collect())
    assert bad == sorted([(t, r) for t, r in DOCUMENTS.items() if r] + [("nonsense", "not a JSON object")])
    assert {t for _, t in good} == {t for t, r in DOCUMENTS.items() if not r} | {None}
    assert parted.counts["good"] == len(good) and sum(parted.counts.values()) == len(rows)
    assert parted.counts["not a JSON object"] == 4
    # What passed is read without an error.
    hits = parsed_hits(F.col("metadata"))
    parted.good.select(*[hit_spans(hits, key, F.lit(100)) for key in ("p", "m")]).collect()
    assert parted.good.columns == df.columns


def test_parting_needs_checks_and_free_names(spark):
    df = spark.createDataFrame([(1,)], "reject_reason int")
    with pytest.raises(ValueError, match="reject_reason"):
        part_rows(df, {"odd": F.lit(True)})
    with pytest.raises(ValueError):
        part_rows(df, {})
    empty = part_rows(spark.createDataFrame([], "x int"), {"odd": F.col("x") > 1})
    assert empty.good.count() == empty.rejected.count() == 0 and empty.counts == {"good": 0, "odd": 0}
