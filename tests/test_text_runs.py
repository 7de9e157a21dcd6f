"""Runs inside long texts, and the feature documents built from them."""

from __future__ import annotations

import itertools
import random

import pytest

from famloom.operators import runs
from famloom.plans import alignments
from oracle import connect, difference
from query_catalog import ORACLES, QUERIES

ODD = "HHHEEC\u0000 .é漢😀"


def _brute(text, state):
    places, at = [], 1
    for char, group in itertools.groupby(text or ""):
        size = len(list(group))
        if char == state:
            places.append((at, at + size - 1))
        at += size
    return places


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_text_runs(spark, monkeypatch, held):
    monkeypatch.setattr(runs, "TEXT_BYTES", held)
    draw = random.Random(held)
    texts = ["".join(draw.choices(ODD, k=draw.randrange(30))) for _ in range(200)]
    rows = list(enumerate([None, "", *texts, "H" * 500, ""]))
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = runs.text_runs(df, "text", {"H": "h", "C": "c"}).collect()
    assert [(r.id, r.text) for r in got] == rows
    for r in got:
        assert ([tuple(p) for p in r.h], [tuple(p) for p in r.c]) == (_brute(r.text, "H"), _brute(r.text, "C"))


def test_feature_documents_are_built_once(spark):
    """No filter that builds the tracks a second time, where the rows are read, to see that there are some."""
    plan = QUERIES["feature_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("α-helices") == 1


def test_feature_documents_of_odd_texts(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "é"), (4, "Hh7 漢9E"), (5, "x\u0000😀😀11")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    found = QUERIES["feature_documents"](spark, str(tmp_path))
    assert difference(found, connect(str(tmp_path)), ORACLES["feature_documents"]) is None


def test_feature_document_keeps_the_residues(spark):
    rows = [("p", "0123", "HHCC", "MKVL"), ("q", "", "", "")]
    df = spark.createDataFrame(rows, "id string, confidence string, states string, residues string")
    got = {r.id: r.document for r in alignments.secondary_structure_features(df).collect()}
    assert got["p"].sequence == "MKVL" and [p.y for p in got["p"].features[3].data] == [0, 1, 2, 3]
    assert [[tuple(p) for p in f.data] for f in got["p"].features[:3]] == [[(1, 2)], [], [(3, 4)]]
    assert [list(f.data) for f in got["q"].features] == [[], [], [], []]
