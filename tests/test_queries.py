"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

from famloom.operators import similarity
from oracle import connect, difference
from query_catalog import ORACLES, QUERIES, similarity as catalog
from query_catalog.adapters import family_meta

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, database, name):
    assert difference(QUERIES[name](spark, FOLDER), database, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["family_similarities", "singletons", "redundant_families", "similarity_split"])
def test_query_stores_a_row_per_set(spark, monkeypatch, name):
    """The step that these queries share does not store elements row by row."""
    stored, kept = [], similarity.durable

    def seen(df):
        stored.append(kept(df))
        return stored[-1]

    monkeypatch.setattr(similarity, "durable", seen)
    QUERIES[name](spark, FOLDER)
    monkeypatch.undo()
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert stored and sum(t.count() for t in stored) < lines


def test_redundancy_sizes_only_families_in_redundant_pairs(spark, monkeypatch):
    """Sizes are summed for the families that they decide on, not for every family."""
    seen, kept = [], catalog.redundancy.eliminate_redundant

    def eliminated(similarities, sizes, *rest):
        seen.append((similarities, sizes))
        return kept(similarities, sizes, *rest)

    monkeypatch.setattr(catalog.redundancy, "eliminate_redundant", eliminated)
    QUERIES["redundant_families"](spark, FOLDER)
    (pairs, sizes), = seen
    wanted = {f for r in pairs.filter("similarity >= 0.95").collect() for f in (r["fam1"], r["fam2"])}
    every = {r["id"]: r["family_size"] for r in family_meta(spark, FOLDER).collect()}
    got = {r["id"]: r["family_size"] for r in sizes.collect()}
    assert wanted <= set(got) and len(got) < len(every) / 2
    assert all(every[f] == n for f, n in got.items())


def test_family_similarities_derive_meta_of_pairs_only(spark, monkeypatch):
    asked, kept = [], catalog.family_meta

    def meta(spark, folder, listed=None):
        asked.append(listed)
        return kept(spark, folder, listed)

    monkeypatch.setattr(catalog, "family_meta", meta)
    QUERIES["family_similarities"](spark, FOLDER)
    assert asked and None not in asked
    assert family_meta(spark, FOLDER, asked[0]).count() < family_meta(spark, FOLDER).count() / 2
