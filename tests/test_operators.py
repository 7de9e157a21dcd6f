"""Distributed operators against brute force on small random data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from famloom.operators import graph, intervals, redundancy, remap, runs, similarity, skew, updates

SPANS = "protein string, start int, end int"


def _positions(rows):
    found = {}
    for protein, start, end in rows:
        found.setdefault(protein, set()).update(range(start, end + 1))
    return found


def _as_sets(df):
    found = {}
    for row in df.collect():
        found.setdefault(row["protein"], []).append((row["start"], row["end"]))
    return found


def _runs_of(positions):
    out = []
    for pos in sorted(positions):
        if out and out[-1][1] == pos - 1:
            out[-1] = (out[-1][0], pos)
        else:
            out.append((pos, pos))
    return out


def _random_spans(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randint(1, 60)
        # One protein holds about a third of all intervals.
        protein = "hot" if rng.random() < 0.33 else f"p{rng.randint(1, 12)}"
        rows.append((protein, start, start + rng.randint(-2, 9)))
    return rows


def test_merge_joins_overlapping_and_touching(spark):
    rows = [("a", 1, 3), ("a", 4, 6), ("a", 8, 9), ("b", 5, 5), ("a", 2, 2)]
    got = _as_sets(intervals.merge_intervals(spark.createDataFrame(rows, SPANS), "protein"))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(1, 6), (8, 9)], "b": [(5, 5)]}


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_algebra_equals_position_sets(spark, seed):
    left, right = _random_spans(seed, 150), _random_spans(seed + 10, 150)
    a, b = _positions(left), _positions(right)
    da, db = spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS)
    for operator, combine in (
        (intervals.subtract_intervals, lambda x, y: x - y),
        (intervals.intersect_intervals, lambda x, y: x & y),
    ):
        got = {k: sorted(v) for k, v in _as_sets(operator(da, db, "protein")).items()}
        want = {k: _runs_of(combine(a[k], b.get(k, set()))) for k in a}
        assert got == {k: v for k, v in want.items() if v}
    covered = {r["protein"]: r["covered"] for r in intervals.covered_length(da, "protein").collect()}
    assert covered == {k: len(v) for k, v in a.items()}


def _sets(seed, families=60):
    rng = random.Random(seed)
    rows = [
        (f, f"p{int(rng.paretovariate(0.7)) % 30}")
        for f in range(families)
        for _ in range(rng.choice([1, 2, 3, 5, 9]))
    ]
    return rows + [(f, "everywhere") for f in range(0, families, 2)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.95, 1.0])
def test_similar_sets_is_exact(spark, threshold):
    rows = _sets(3)
    sets = {}
    for family, element in rows:
        sets.setdefault(family, set()).add(element)
    want = {}
    for a in sets:
        for b in sets:
            jaccard = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and jaccard >= threshold:
                want[a, b] = jaccard
    df = spark.createDataFrame(rows, "family_id long, protein string")
    got = similarity.similar_sets(df, threshold).collect()
    assert {(r["fam_a"], r["fam_b"]): r["jaccard"] for r in got} == want


def test_similar_sets_with_hot_elements(spark):
    test_similar_sets_is_exact(spark, 0.5)


def test_similar_sets_with_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_SUB_BUCKETS", 1)
    test_similar_sets_is_exact(spark, 0.5)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.95, 1.0])
def test_similar_sets_of_families_cut_into_parts(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "PART_ROWS", 3)
    test_similar_sets_is_exact(spark, threshold)


def test_similar_sets_with_few_frequency_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_CELLS", 8)
    monkeypatch.setattr(similarity, "_PAGE", 4)
    test_similar_sets_is_exact(spark, 0.5)


def test_similar_sets_store_a_row_per_set(spark, monkeypatch):
    """A set's elements are dealt and stored once, together, not row by row in several tables."""
    rows = [(f, f"p{f * 7 % 90 + k * k}") for f in range(300) for k in range(8)]
    stored, kept = [], similarity.durable

    def seen(df):
        stored.append(kept(df))
        return stored[-1]

    monkeypatch.setattr(similarity, "durable", seen)
    found = similarity.similar_sets(spark.createDataFrame(rows, "family_id long, protein string"), 0.9)
    monkeypatch.undo()
    per_set = [t for t in stored if "_s" not in t.columns]
    assert found.count() > 0 and sum(t.count() for t in per_set) < len(rows) / 2


def test_similar_sets_of_nothing(spark):
    assert similarity.similar_sets(spark.createDataFrame([], "family_id long, protein string"), 0.5).count() == 0


def test_similar_sets_rule_pairs_out_before_the_shuffle(spark, monkeypatch):
    rows = [(i, e) for i in range(60) for e in ("shared", *(f"{i // 2}-{k}" for k in range(3)), f"own {i}")]
    stored, kept = [], similarity.durable

    def seen(df):
        stored.append(kept(df))
        return stored[-1]

    monkeypatch.setattr(similarity, "durable", seen)
    found = similarity.similar_sets(spark.createDataFrame(rows, "family_id long, protein string"), 0.5).count()
    monkeypatch.undo()
    candidates = [t.count() for t in stored if t.columns[:2] == ["_s", "_l"]]
    assert found == 30 and len(candidates) == 1 and 30 <= candidates[0] < 60 * 59 // 20


def test_large_families_are_counted_by_cells_first(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART_ROWS", 100)
    rows = [(f, f"p{k}") for f in range(500) for k in range(3)] + [(7000 + f, f"q{k}") for f in (0, 1) for k in range(100 + f * 150)]
    known = spark.createDataFrame(rows, "family_id long, protein string")
    got = similarity._large_families(known, "family_id", len(rows))
    assert [tuple(r) for r in got.collect()] == [(7001, 3)]


def test_equal_sets_are_looked_up_among_few(spark, monkeypatch):
    """Sets that no other family holds are left out before digests are grouped."""
    rows = [(f, f"p{f}-{k}") for f in range(1000) for k in range(3)] + [(f, f"q{k}") for f in (5000, 5001) for k in range(3)]
    seen, kept = [], similarity.lookup
    monkeypatch.setattr(similarity, "lookup", lambda left, *a: seen.append(left.count()) or kept(left, *a))
    got = similarity.similar_sets(spark.createDataFrame(rows, "family_id long, protein string"), 0.5)
    assert [tuple(r) for r in got.collect()] == [(5000, 5001, 3, 3, 3, 1.0)]
    assert len(seen) == 1 and 2 <= seen[0] < 200


def test_next_band_takes_the_prefix_that_its_sizes_need(spark):
    """A set of 4 shares at least 4 elements with one of 8 or more: only its first is needed there."""
    rows = [(f, size, before, band) for f, size, band in ((1, 4, 2), (2, 5, 2), (3, 7, 2), (4, 1, 0)) for before in range(size)]
    ranked = spark.createDataFrame(rows, "f long, _size long, _before long, _band int")
    got = similarity._next_band(ranked, 0.5).groupBy("f", "_band").count().orderBy("f").collect()
    assert [tuple(r) for r in got] == [(1, 3, 1), (2, 3, 1), (3, 3, 3), (4, 1, 1)]


@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.75, 0.9])
def test_similar_sets_across_size_bands(spark, threshold):
    """Subsets and near subsets of a few sets, of all sizes, so that pairs lie at the threshold."""
    rng = random.Random(11)
    sets = []
    for base in range(3):
        pool = [f"{base}-{k}" for k in range(24)]
        sets += [set(rng.sample(pool, n)) for n in range(12, 25)] + [set(pool[:n]) for n in range(1, 25)]
    want = {
        (a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b]))
        for a in range(len(sets)) for b in range(a + 1, len(sets))
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
    }
    df = spark.createDataFrame([(f, e) for f, s in enumerate(sets) for e in s], "family_id long, protein string")
    got = similarity.similar_sets(df, threshold).collect()
    assert {(r["fam_a"], r["fam_b"]): (r["shared"], r["size_a"] + r["size_b"] - r["shared"]) for r in got} == want


def test_similar_sets_leave_out_rows_without_a_family(spark):
    rows = [(f, e) for f in (1, None) for e in "abc"] + [(2, e) for e in "abcd"]
    got = similarity.similar_sets(spark.createDataFrame(rows, "family_id long, protein string"), 0.5)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3, 4, 3, 0.75)]


def test_residue_similarity_tries_first_representative_first(spark):
    members = spark.createDataFrame(
        [(1, "a", "1-10"), (2, "a", "6-15"), (1, "b", "-"), (2, "b", "1-5"),
         (3, "c", "1-4"), (1, "c", "1-2-4"), (4, "d", "1-9")],
        "family_id long, protein string, region string",
    )
    meta = spark.createDataFrame(
        [(1, "a", 99), (2, "b", 20), (3, "x", 7), (4, "d", 9)],
        "id long, protein_rep string, rep_length int",
    )
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (3, 1)], "fam1 long, fam2 long")
    got = {
        (r["fam1"], r["fam2"]): r["similarity"]
        for r in similarity.residue_similarity(pairs, members, meta).collect()
    }
    # 1-10 against 6-15; then b whole (20) against 1-5; no shared representative twice.
    assert got == {(1, 2): 5 / 15, (2, 1): 5 / 20, (3, 4): 0.0, (3, 1): 0.0}


def test_residue_similarity_stores_members_of_pairs_only(spark, monkeypatch):
    rows = [(f, f"p{f // 2}", "1-10") for f in range(2000)]
    members = spark.createDataFrame(rows, "family_id long, protein string, region string")
    meta = members.select(F.col("family_id").alias("id"), F.col("protein").alias("protein_rep"), F.lit(20).alias("rep_length"))
    pairs = spark.createDataFrame([(2, 3), (40, 41)], "fam1 long, fam2 long")
    stored, kept = [], similarity.durable

    def seen(df):
        stored.append(kept(df))
        return stored[-1]

    monkeypatch.setattr(similarity, "durable", seen)
    got = similarity.residue_similarity(pairs, members, meta).collect()
    monkeypatch.undo()
    assert sorted(map(tuple, got)) == [(2, 3, 1.0), (40, 41, 1.0)]
    held = [t.count() for t in stored if "region" in t.columns]
    assert len(held) == 1 and 4 <= held[0] < 200


def test_residue_similarity_asks_for_meta_of_pairs_only(spark):
    rows = [(f, f"p{f // 2}", "1-10") for f in range(2000)]
    members = spark.createDataFrame(rows, "family_id long, protein string, region string")
    whole = members.select(F.col("family_id").alias("id"), F.col("protein").alias("protein_rep"), F.lit(20).alias("rep_length"))
    asked = []

    def meta(listed):
        asked.append(listed.marked(whole, "id").filter("_maybe").drop("_maybe"))
        return asked[0]

    pairs = spark.createDataFrame([(2, 3), (40, 41)], "fam1 long, fam2 long")
    got = similarity.residue_similarity(pairs, members, meta).collect()
    assert sorted(map(tuple, got)) == [(2, 3, 1.0), (40, 41, 1.0)]
    assert len(asked) == 1 and 4 <= asked[0].count() < 200


def test_direction_follows_row_order(spark):
    members = spark.createDataFrame(
        [(9, "a", "1-10", 1), (2, "a", "1-10", 2)],
        "family_id long, protein string, region string, row_no long",
    )
    meta = spark.createDataFrame([(9, "a", 10), (2, "a", 10)], "id long, protein_rep string, rep_length int")
    by_row = similarity.family_similarities(members, meta, order="row_no").first()
    by_id = similarity.family_similarities(members, meta).first()
    assert (by_row["fam1"], by_row["fam2"], by_row["similarity"]) == (9, 2, 1.0)
    assert (by_id["fam1"], by_id["fam2"]) == (2, 9)


def _sequential(pairs, size):
    pairs, out = list(pairs), []
    while pairs:
        a, b, _ = pairs[-1]
        loser = a if size[a] < size[b] else b if size[a] > size[b] else max(a, b)
        out.append(loser)
        pairs = [p for p in pairs if loser not in p[:2]]
    return out


def _check_redundancy(spark, seed, n):
    rng = random.Random(seed)
    size = {i: rng.randint(1, 6) for i in range(n)}
    pairs = [(rng.randrange(n), rng.randrange(n), i) for i in range(2 * n)]
    dropped = redundancy.redundant_families(
        spark.createDataFrame(pairs, "fam1 long, fam2 long, row_no long"),
        spark.createDataFrame(list(size.items()), "id long, family_size long"),
    )
    got = [r["family_id"] for r in dropped.orderBy(F.col("dropped_at").desc()).collect()]
    assert got == _sequential(pairs, size)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_redundancy_equals_sequential_loop(spark, seed):
    _check_redundancy(spark, seed, 15 * seed)


def test_redundancy_with_hot_winners(spark):
    _check_redundancy(spark, 7, 20)


def test_redundancy_star_settles(spark):
    """A hub that loses to all its neighbours, and one that beats them all."""
    pairs = [(0, i, i) for i in range(1, 30)] + [(100, 100 + i, 50 + i) for i in range(1, 30)]
    size = {0: 1, 100: 9} | {i: 5 for i in range(1, 30)} | {100 + i: 5 for i in range(1, 30)}
    dropped, kept = redundancy.eliminate_redundant(
        spark.createDataFrame(
            [(a, b, 0.97, i) for a, b, i in pairs] + [(1, 2, 0.6, 500), (1, 101, 0.6, 501)],
            "fam1 long, fam2 long, similarity double, row_no long",
        ),
        spark.createDataFrame(list(size.items()), "id long, family_size long"),
    )
    assert {r["family_id"] for r in dropped.collect()} == {0} | set(range(101, 130))
    assert [(r["fam1"], r["fam2"]) for r in kept.collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_redundancy_of_a_long_chain_takes_few_rounds(spark, monkeypatch, seed):
    """Each family's only winner is the one before it; the pairs' order is drawn."""
    count, rounds = 200, []
    step = redundancy._next_rules
    monkeypatch.setattr(redundancy, "_next_rules", lambda *a: rounds.append(1) or step(*a))
    when = list(range(count))
    if seed:
        random.Random(seed).shuffle(when)
    else:
        when.reverse()  # every outcome hangs on the whole chain before it
    pairs = sorted(((i, i + 1, when[i]) for i in range(count)), key=lambda p: p[2])
    size = {i: 1000 - i for i in range(count + 1)}
    dropped = redundancy.redundant_families(
        spark.createDataFrame(pairs, "fam1 long, fam2 long, row_no long"),
        spark.createDataFrame(list(size.items()), "id long, family_size long"),
    )
    got = [r["family_id"] for r in dropped.orderBy(F.col("dropped_at").desc()).collect()]
    assert got == _sequential(pairs, size)
    assert len(rounds) <= 9


def test_redundancy_needs_sizes(spark):
    with pytest.raises(Exception, match="no size for family 2"):
        redundancy.redundant_families(
            spark.createDataFrame([(1, 2, 1)], "fam1 long, fam2 long, row_no long"),
            spark.createDataFrame([(1, 5)], "id long, family_size long"),
        ).collect()


def _both_ways(edges):
    return [(str(a), str(b)) for a, b in edges] + [(str(b), str(a)) for a, b in edges]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_after_new_edges_equal_a_full_run(spark, monkeypatch, seed):
    rng = random.Random(seed)
    draw = lambda n, most: [(rng.randrange(most), rng.randrange(most)) for _ in range(n)]
    old, new = draw(60, 90), draw(12, 110) + [(500, 501), (501, 3)]
    of = lambda pairs: spark.createDataFrame(_both_ways(pairs), "src string, dst string")
    before = graph.connected_components(of(old))
    read = []
    whole = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: read.append(e.count()) or whole(e))
    after = graph.extend_components(before, of(new))
    monkeypatch.undo()
    got = sorted(map(tuple, after.collect()))
    assert got == sorted(map(tuple, graph.connected_components(of(old + new)).collect()))
    assert read and read[0] <= 2 * len(new)
    nothing = graph.extend_components(before, of([]))
    assert sorted(map(tuple, nothing.collect())) == sorted(map(tuple, before.collect()))


def _check_components(spark, seed):
    rng = random.Random(seed)
    edges = [(str(rng.randrange(120)), str(rng.randrange(120)), 0.5) for _ in range(70)]
    edges += [("hub", str(i), 0.25) for i in range(60, 80)] + [("7", "7", 0.5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        parent[find(a)] = find(b)
    want = {}
    for node in list(parent):
        want.setdefault(find(node), set()).add(node)
    df = spark.createDataFrame(edges, "fam1 string, fam2 string, weight double")
    clusters, members = graph.cluster_summaries(graph.symmetric_edges(df))
    got = {}
    for row in members.collect():
        got.setdefault(row["cluster_id"], set()).add(row["family_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    key = lambda x: (0, int(x), "") if x.isdigit() else (1, 0, x)
    numbered = sorted(got.values(), key=lambda c: key(min(c, key=key)))
    assert [got[f"SF_{i}"] for i in range(1, len(got) + 1)] == numbered
    assert {r["cluster_id"]: r["family_size"] for r in clusters.collect()} == {
        k: len(v) for k, v in got.items()
    }


def test_finished_components_leave_the_rounds(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(0, 200, 2)] + [(i, i + 1) for i in range(1000, 1064)]
    edges = spark.createDataFrame(_both_ways(pairs), "src string, dst string")
    read, kept = [], graph.durable

    def seen(df):
        stored = kept(df)
        if df.columns == ["src", "dst"]:
            read.append(stored.count())
        return stored

    monkeypatch.setattr(graph, "durable", seen)
    found = graph.connected_components(edges).collect()
    monkeypatch.undo()
    want = {str(i): min(str(i - i % 2), str(i - i % 2 + 1)) for i in range(200)}
    assert {r["node"]: r["component"] for r in found} == {**want, **{str(i): "1000" for i in range(1000, 1065)}}
    assert read[0] == len(pairs) and sum(read[1:]) <= 2 * len(pairs)


def test_components_equal_union_find(spark):
    _check_components(spark, 5)


def test_components_with_hubs(spark):
    _check_components(spark, 6)


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_state_runs_across_slices(spark, partitions):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        rows.append(("hot" if i % 3 else f"k{i % 5}", i, rng.choice("AAAB")))
    want = {}
    for key in {r[0] for r in rows}:
        states = [r[2] for r in rows if r[0] == key]
        out = []
        for pos, state in enumerate(states, 1):
            if out and out[-1][0] == state:
                out[-1] = (state, out[-1][1], pos)
            else:
                out.append((state, pos, pos))
        want[key] = out
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "key string, n long, s string").repartition(3)
        got = {}
        for r in runs.state_runs(df, "key", ["n"], "s").orderBy("x").collect():
            got.setdefault(r["key"], []).append((r["state"], r["x"], r["y"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_global_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    got = skew.global_position(df, [F.col("v").desc()], "n").collect()
    assert all(r["n"] == 1000 - r["v"] for r in got) and len(got) == 1000


def test_lookup_keeps_every_row(spark):
    left = spark.createDataFrame([("a" if i % 2 else None if i % 3 else f"k{i}", i) for i in range(60)], "k string, v int")
    right = left.groupBy("k").agg(F.max("v").alias("m")).filter("k <> 'k6'")
    want = left.join(right, "k", "left")
    got = skew.lookup(left, right, ["k"])
    assert sorted(map(tuple, got.select("k", "v", "m").collect()), key=str) == sorted(
        map(tuple, want.select("k", "v", "m").collect()), key=str
    )


def test_lookup_reads_the_left_side_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS fam1", "id % 5 AS fam2").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    mapping = spark.createDataFrame([(1, 5), (2, 6)], "old_id long, new_id long")
    plan = remap.map_edge_ids(edges, mapping)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("fam1#") and plan.count("Relation [fam1") == 1


def test_group_position(spark):
    df = spark.createDataFrame([(k, i * 37 % 101) for k in ("a", "b", None) for i in range(100)], "k string, v int")
    got = skew.group_position(df.repartition(7), ["k"], [F.col("v")], "n").collect()
    for key in ("a", "b", None):
        rows = sorted((r["v"], r["n"]) for r in got if r["k"] == key)
        assert [n for _, n in rows] == list(range(1, 101))


def test_repeated_keys_need_an_order(spark):
    table = spark.createDataFrame([(1, "x")], "id long, v string")
    twice = spark.createDataFrame([(1, 5), (1, 6)], "old_id long, new_id long")
    blobs = spark.createDataFrame([(1, "f", bytearray(b"x")), (1, "f", bytearray(b"y"))], "id long, file_name string, content binary")
    named = table.withColumns({"name": F.lit("f"), "blob": F.lit(None).cast("binary")})
    for job in (
        lambda: remap.map_ids(table, twice, "id"),
        lambda: remap.map_edge_ids(table.withColumn("b", F.col("id")), twice, ("id", "b")),
        lambda: remap.file_plan(table.select(F.lit("1.a").alias("file_name")), mapping=twice),
        lambda: updates.update_by_id(table, twice.toDF("id", "v"), "id", ["v"]),
        lambda: updates.attach_named_blobs(named, blobs, "name", "blob"),
        lambda: updates.attach_missing_blobs(named, blobs, "id", "name", "blob"),
    ):
        with pytest.raises(Exception, match="occurs more than once"):
            job().collect()
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.6)], "fam1 long, fam2 long, weight double")
    from famloom.operators import graph

    with pytest.raises(Exception, match="several weights"):
        graph.symmetric_edges(edges).collect()


def test_similar_sets_with_many_equal_sets(spark):
    rows = [(i, e) for i in range(300) for e in ("a", "b", "c")] + [(1000, e) for e in ("a", "b", "c", "d")]
    df = spark.createDataFrame(rows, "family_id long, protein string")
    got = similarity.similar_sets(df, 0.7)
    assert got.filter("jaccard = 1").count() == 300 * 299 // 2
    assert got.filter("jaccard < 1").count() == 300


def test_map_ids_last_row_wins_and_others_pass(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "id string, v string")
    mapping = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "old_id long, new_id long, row_no int")
    got = remap.map_ids(df, mapping, "id", "row_no").collect()
    assert {r["v"]: r["id"] for r in got} == {"x": "6", "y": "2", "z": None}


def test_remove_ids_keeps_null_ids(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "id string, v string")
    ids = spark.createDataFrame([(1,)], "id long")
    assert {r["v"] for r in remap.remove_ids(df, ids, 0).collect()} == {"y", "z"}


def test_uncovered_clusters(spark):
    clusters = spark.createDataFrame(
        [("a", "p1_1"), ("a", "p2_1"), ("b", "p3_1"), ("c", "p4_1"), ("c", "p4_2"), ("d", "p5"), ("d", "p6")],
        "cluster_rep string, sequence_id string",
    )
    members = spark.createDataFrame([(1, "p2", "-")], "family_id long, protein string, region string")
    got = [tuple(r) for r in remap.uncovered_clusters(clusters, members).collect()]
    assert got == [("c", 2), ("d", 2)]


def test_blob_policies(spark):
    families = spark.createDataFrame([(1, None), (2, None)], "id long, blob binary")
    blobs = spark.createDataFrame([(1, bytearray(b"x"))], "id long, content binary")
    with pytest.raises(ValueError, match="missing 2"):
        updates.attach_all_blobs(families, blobs, "id", "blob")
    updated = updates.attach_all_blobs(families, blobs, "id", "blob", allow_missing=True)
    assert {r["id"]: r["blob"] for r in updated.collect()} == {1: b"x", 2: None}
    extra = spark.createDataFrame([(7, bytearray(b"x"))], "id long, content binary")
    with pytest.raises(ValueError, match="extra 7"):
        updates.attach_all_blobs(families, extra, "id", "blob", allow_missing=True)


def test_widen_leaves_wide_scans_alone(spark, tmp_path):
    from famloom.sources.tables import widen

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert widen(scan).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores)
    assert widen(wide) is wide
