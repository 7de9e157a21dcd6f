"""User-level jobs on small tables with known results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from famloom.functions import trees
from famloom.functions.annotations import annotation_keys
from famloom.plans import alignments, biomes, coverage, documents, profiles, stars, superfamilies
from famloom.schemas import MissingColumnsError, add_missing_columns, require_columns
from query_catalog import adapters

PROTEINS = "protein string, sequence string, metadata string"


def _p(start, end, name="PF00001"):
    return [name, 1e-5, 20.0, 1, 3, start, end]


def test_annotation_stats_counts_overlap_once(spark):
    df = spark.createDataFrame(
        [
            ("s1", "AAAAAA", json.dumps({"p": [_p(1, 3), _p(3, 5)]})),
            ("s2", "AAAA", ""),
        ],
        PROTEINS,
    )
    row = coverage.annotation_stats(coverage.whole_rows(df), {"pfam": "p"}).first()
    assert row["total_sequences"] == 2 and row["annotated_sequences"] == 1
    assert row["total_amino_acids"] == 10 and row["annotated_amino_acids"] == 5
    assert row["annotated_sequence_percentage"] == 50.0
    assert row["annotated_amino_acid_percentage"] == 50.0


def test_annotation_stats_over_both_keys(spark):
    document = {"p": [_p(1, 4)], "m": [["F1", 1e-7, 35.0, 3, 6]]}
    df = spark.createDataFrame([("s1", "AAAAAA", json.dumps(document))], PROTEINS)
    got = {r["label"]: r["annotated_amino_acids"] for r in coverage.annotation_stats(coverage.whole_rows(df), {"a": "p", "b": "p,m"}).collect()}
    assert got == {"a": 4, "b": 6}


def test_malformed_hit_fails(spark):
    df = spark.createDataFrame([("s1", "AAAA", '{"p":[["x",1]]}')], PROTEINS)
    with pytest.raises(Exception, match="Malformed annotation"):
        coverage.annotation_stats(coverage.whole_rows(df), {"a": "p"}).collect()


def test_annotation_keys_are_checked():
    assert annotation_keys(" p , m") == ["p", "m"]
    with pytest.raises(ValueError, match="no layout for"):
        annotation_keys("p,q")
    with pytest.raises(ValueError, match="list is empty"):
        annotation_keys(" ,")


STATS = (
    "label string, total_sequences long, annotated_sequences long, total_amino_acids long, "
    "annotated_amino_acids long, annotated_sequence_percentage double, "
    "annotated_amino_acid_percentage double"
)


def test_compare_stats(spark):
    stats = spark.createDataFrame(
        [("pfam", 10, 3, 100, 40, 30.0, 40.0), ("both", 10, 5, 100, 70, 50.0, 70.0),
         ("none", 10, 0, 100, 0, 0.0, 0.0)],
        STATS,
    )
    row = coverage.compare_stats(stats, "pfam", "both").first()
    assert row["annotated_sequence_percentage_point_increase"] == 20.0
    assert row["annotated_sequence_relative_increase_percentage"] == 66.666667
    assert row["annotated_amino_acid_percentage_point_increase"] == 30.0
    assert row["annotated_amino_acid_relative_increase_percentage"] == 75.0
    zero = coverage.compare_stats(stats, "none", "both").first()
    assert zero["annotated_sequence_relative_increase_percentage"] == 0.0


@pytest.mark.parametrize("keep,by", [("label <> 'pfam'", []), ("false", []), ("label = 'both' or dataset = 'one'", ["dataset"])])
def test_compare_stats_needs_a_row_of_each_label(spark, keep, by):
    rows = [(d, label, 10, 3, 100, 40, 30.0, 40.0) for d in ("one", "two") for label in ("pfam", "both")]
    stats = spark.createDataFrame(rows, f"dataset string, {STATS}").filter(keep)
    with pytest.raises(Exception, match="no statistics row is labelled pfam"):
        coverage.compare_stats(stats, "pfam", "both", by).collect()


def test_statistics_ask_how_proteins_are_split(spark):
    df = spark.createDataFrame([("s1", "AAAA", ""), ("s1", "AAAA", "")], PROTEINS)
    with pytest.raises(MissingColumnsError, match="n_parts"):
        coverage.annotation_stats(df, {"a": "p"})
    marked = coverage.whole_rows(df)
    assert coverage.annotation_stats(marked, {"a": "p"}).first()["total_sequences"] == 2
    with pytest.raises(ValueError, match="part"):
        coverage.whole_rows(marked)


HITS = "target string, query string, i_evalue double, score double, ali_from int, ali_to int, line_order int"


def test_append_replaces_family_hits(spark):
    proteins = spark.createDataFrame(
        [("a", "AAAA", '{"p":[["P",1,2,3,4,5,6]],"m":[["old",1,2,3,4]]}'), ("b", "CC", '{"m":[],"z":1}'), ("c", "", None)],
        PROTEINS,
    )
    hits = spark.createDataFrame(
        [("a", "F2", 1e-9, 5.0, 2, 4, 2), ("a", "F1", 1e-8, 6.0, 1, 2, 1)], HITS
    )
    got = {r["protein"]: json.loads(r["metadata"]) for r in coverage.append_annotations(proteins, hits).collect()}
    assert got["a"] == {"p": [["P", 1, 2, 3, 4, 5, 6]], "m": [["F1", 1e-8, 6.0, 1, 2], ["F2", 1e-9, 5.0, 2, 4]]}
    assert got["b"] == {"z": 1} and got["c"] == {}


def test_hot_target_continues_in_parts(spark):
    """Hits beyond one cell continue in further rows, and statistics see them all."""
    proteins = spark.createDataFrame([("a", "A" * 100, '{"z":1}'), ("b", "A" * 10, "{}")], PROTEINS)
    hits = spark.createDataFrame(
        [("a", "F", 1e-9, 5.0, 2 * i, 2 * i + 2, i) for i in range(1, 40)] + [("b", "F", 1e-9, 5.0, 1, 2, 0)], HITS
    )
    annotated = coverage.append_annotations(proteins, hits, per_cell=10)
    rows = annotated.filter("protein = 'a'").collect()
    assert len(rows) == 4 and sum(len(json.loads(r["metadata"])["m"]) for r in rows) == 39
    assert [json.loads(r["metadata"]).get("z") for r in sorted(rows, key=lambda r: r["part"])] == [1, None, None, None]
    stats = coverage.annotation_stats(annotated, {"m": "m"}).first()
    assert stats["total_sequences"] == 2 and stats["annotated_sequences"] == 2
    assert stats["total_amino_acids"] == 110 and stats["annotated_amino_acids"] == 79 + 2


@pytest.mark.parametrize("size", [1, 2, 3])
def test_parts_are_contiguous_and_whole(spark, size):
    """Every protein keeps its own document, and the parts read in order are its hits in order."""
    counts = {f"p{i}": i % 7 for i in range(40)}
    proteins = spark.createDataFrame([(p, "A" * 50, '{"p":[["P",1,2,3,4,5,6]]}') for p in counts], PROTEINS)
    hits = spark.createDataFrame(
        [(p, f"F{k}", 1e-9, 5.0, k, k, k) for p, n in counts.items() for k in range(n, 0, -1)], HITS
    )
    annotated = coverage.append_annotations(proteins, hits, per_cell=size)
    found = {}
    for row in sorted(annotated.collect(), key=lambda r: (r["protein"], r["part"])):
        doc = json.loads(row["metadata"])
        assert ("p" in doc) == (row["part"] == 0) and len(doc.get("m", [])) <= size
        assert row["n_parts"] == max(1, -(-counts[row["protein"]] // size))
        found.setdefault(row["protein"], []).extend(h[0] for h in doc.get("m", []))
    assert found == {p: [f"F{k}" for k in range(1, n + 1)] for p, n in counts.items()}
    whole = coverage.annotation_stats(coverage.append_annotations(proteins, hits), {"m": "m"}).first()
    assert coverage.annotation_stats(annotated, {"m": "m"}).first() == whole


def test_annotation_diff_keeps_proteins_without_segments(spark):
    one = spark.createDataFrame([("a", "1-5,8-9"), ("b", "-")], "protein string, region string")
    two = spark.createDataFrame([("a", "4-8"), ("c", "2-2")], "protein string, region string")
    got = {r["protein"]: tuple(r)[1:] for r in coverage.annotation_diff(one, two).collect()}
    assert got == {"a": (7, 5, 4, 2, 3), "b": (0, 0, 0, 0, 0), "c": (0, 1, 0, 1, 0)}
    summary = coverage.diff_summary(coverage.annotation_diff(one, two))
    assert summary.first()["increase_ratio"] == (3 + 7) / 7 * 100
    report = {r["label"]: r["value"] for r in coverage.summary_report(summary).collect()}
    assert report["Increase Ratio"] == "142.86%"


def test_exclusive_regions_without_any(spark):
    schema = "family_id string, protein string, region string, row_no int"
    same = spark.createDataFrame([("f", "a", "1-5", 1)], schema)
    assert coverage.exclusive_regions(same, same, "row_no").collect() == []


def _superfamilies(spark):
    report = spark.createDataFrame(
        [("1", "1", "2", "0.6"), ("2", "1_loc", "3", "0.8"), ("3", " 2", "3 ", "0.9"), ("4", "10", "11", "0.5")],
        "Row string, `Family Id 1` string, `Family Id 2` string, `Jaccard Score` string",
    )
    return superfamilies.build_superfamilies(superfamilies.filtered_edges(report), 1, 12)


def test_superfamilies(spark):
    found = _superfamilies(spark)
    rows = [tuple(r) for r in found.ordered().collect()]
    assert rows[:2] == [("SF_1", "2", 3), ("SF_2", "10", 2)]
    assert [r[0] for r in rows[2:]] == [f"Singleton_{i}" for i in (4, 5, 6, 7, 8, 9, 12)]
    assert found.total_families().first()[0] == 12
    cells = {r["cluster_id"]: r["family_ids"] for r in found.report().collect()}
    assert cells["SF_1"] == "1;2;3" and cells["Singleton_12"] == "12"
    split = found.report(ids_per_row=2).filter("cluster_id = 'SF_1'").collect()
    assert {r["part"]: r["family_ids"] for r in split} == {0: "1;2", 1: "3"}


def test_edges_need_their_columns(spark):
    with pytest.raises(MissingColumnsError, match="Family Id 2, Jaccard Score"):
        superfamilies.filtered_edges(spark.createDataFrame([("1",)], "`Family Id 1` string"))


def test_last_weight_wins(spark):
    from famloom.operators.graph import symmetric_edges

    edges = spark.createDataFrame(
        [("1", "2", 0.9, 1), ("2", "1", 0.1, 2)], "fam1 string, fam2 string, weight double, row_no int"
    )
    assert {r["weight"] for r in symmetric_edges(edges, "row_no").collect()} == {0.1}


def test_size_histograms(spark):
    clusters = spark.createDataFrame([(n,) for n in (1, 2, 10, 11, 20, 21)], "family_size long")
    assert {tuple(r) for r in superfamilies.small_size_histogram(clusters).collect()} == {(2, 1), (10, 1)}
    large = superfamilies.large_size_histogram(clusters).orderBy("lower").collect()
    assert [(r["size_range"], r["n_clusters"]) for r in large] == [("11-20", 2), ("21-30", 1)]


def test_novelty(spark):
    report = spark.createDataFrame(
        [("SF_1", "1;2;3"), ("SF_2", "4; 5;"), ("Singleton_8", "8"), ("SF_9", "7")],
        "`Cluster Id` string, `Family Ids` string",
    )
    members = superfamilies.members_of_report(report, "Cluster Id", "Family Ids")
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("8",)], "id string")
    novel = superfamilies.true_novel_superfamilies(members, ids)
    assert {r[0] for r in novel.collect()} == {"SF_1", "Singleton_8"}
    selected = spark.createDataFrame([(1,), (3,), (7,)], "id long")
    got = [tuple(r) for r in superfamilies.novelty_scores(members, selected, novel).collect()]
    assert got == [("SF_1", 3, 66.666667)]


BLOB = "ids,labels,parents,counts\nroot,root,,5\nroot:Env,Env,root,3\nroot:Env:Soil,Soil,root:Env,2\n"


def _leaves(spark):
    families = spark.createDataFrame(
        [
            ("F1", BLOB + "root:Env:Water,Water,root:Env,1\n"),
            ("F2", BLOB),
            ("F3", 'ids,labels,parents,counts\nroot:Host:Soil,"Soil",root:Host,x\n'),
            ("F4", "not,a,tree\n1,2,3"),
            ("F5", "  "),
            ("F6", None),
        ],
        "id string, biome_blob string",
    )
    return biomes.family_leaves(families)


def test_biome_leaves_and_distribution(spark):
    leaves = _leaves(spark)
    assert leaves.select("family_id").distinct().count() == 3
    rows = {r["path"]: r for r in biomes.leaf_distribution(leaves).collect()}
    assert {k: r["n_families"] for k, r in rows.items()} == {
        "root:Env:Soil": 2, "root:Env:Water": 1, "root:Host:Soil": 1,
    }
    assert rows["root:Env:Soil"]["top_level"] == "Env"
    assert {r["family_id"] for r in biomes.exclusive_families(leaves).collect()} == {"F2", "F3"}
    assert {tuple(r) for r in biomes.exclusive_leaves(leaves).collect()} == {
        ("root:Env:Water", "F1"), ("root:Host:Soil", "F3"),
    }
    labels = biomes.duplicate_labels(leaves, biomes.leaf_distribution(leaves))
    assert [tuple(r) for r in labels.collect()] == [("Soil", 2, 3)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_leaves_parse_a_tree_once(spark):
    blobs = spark.createDataFrame([("F1", BLOB)], "id string, biome_blob string").select("biome_blob")
    parsed = trees.tree_records(F.col("biome_blob"))
    whole, leaves = (_plan(blobs.select(c)) for c in (parsed, trees.leaf_records(parsed)))
    assert leaves.count("split(") == whole.count("split(") > 0
    assert "translate(" not in leaves


def test_leaves_of_nodes_read_the_nodes_once(spark, tmp_path):
    rows = [
        ("a", "root", ""), ("a", "root:x", "root"), ("a", "root:x:y", "root:x"), ("a", "root:x:y", "root:x"),
        ("a", "root:z", "root"), ("b", "root", None), ("c", None, "root"), ("c", "root", ""),
        (None, "root", ""), (None, "root:x", "root"),
    ]
    schema = "family_id string, path string, parent string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/nodes")
    found = biomes.leaves_of_nodes(spark.read.parquet(f"{tmp_path}/nodes"))
    assert _plan(found).count("Relation [") == 1
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(
        [rows[2], rows[3], rows[4], rows[5], rows[6], rows[8], rows[9]], key=repr
    )


def test_tree_nodes_are_dealt_by_family(spark):
    leaves = spark.createDataFrame(
        [("F1", "root:a:b", 2), ("F1", "root:a:c", 1), ("F2", "root", 4)], "family_id string, path string, count int"
    )
    nodes = adapters.tree_nodes(leaves)
    assert {tuple(r) for r in nodes.collect()} == {
        ("F1", "root", "", "root", 3), ("F1", "root:a", "root", "a", 3), ("F1", "root:a:b", "root:a", "b", 2),
        ("F1", "root:a:c", "root:a", "c", 1), ("F2", "root", "", "root", 4),
    }
    plan = biomes.leaves_of_nodes(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_biome_breadth(spark):
    leaves = _leaves(spark)
    distribution = biomes.leaf_distribution(leaves)
    top = biomes.broadest_families(leaves, distribution, 1).first()
    assert (top["family_id"], top["n_leaves"], round(top["percent_available"], 1)) == ("F1", 2, 66.7)
    narrow = biomes.narrowest_families(leaves, distribution).orderBy("n_leaves", "family_id").collect()
    assert [r["family_id"] for r in narrow] == ["F2", "F3", "F1"]
    stats = biomes.breadth_statistics(leaves).first()
    assert (stats["median_leaves"], stats["max_leaves"], stats["over_5"]) == (1.0, 2, 0)


def test_known_top_level_has_its_colour(spark):
    from famloom.functions.trees import colour

    got = spark.range(1).select(colour(F.lit("Engineered")), colour(F.lit("Nowhere"))).first()
    assert tuple(got) == ("#4CAF76", "#AAAAAA")


def test_stars(spark):
    families = spark.createDataFrame(
        [(1, 70.0, 100, 100), (2, 50.0, 99, 99), (3, None, None, None), (4, 10.0, 5, 0)],
        "id long, plddt double, family_size long, rep_length int",
    )
    hits = spark.createDataFrame(
        [(1, "1-50 (100)"), (1, "1-10 (100)"), (2, "1-10 (100)"), (3, "bad"), (4, "1-5 (0)")],
        "family_id long, hmm_range string",
    )
    folds = spark.createDataFrame(
        [(1, "x", 60), (2, "own1", 90), (2, "x", 40), (3, "OWN2", 9), (4, "x", 0)],
        "family_id long, target string, aligned_length int",
    )
    got = stars.stars(families, stars.model_coverage(hits), stars.best_folds(folds, excluded_prefix="Own"))
    assert {r["family_id"]: (r["quality_stars"], r["novelty_stars"]) for r in got.collect()} == {
        1: (4, 0), 2: (1, 2), 3: (0, 4), 4: (0, 4),
    }


def test_rank_profiles_ties_keep_order(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, 10, 0.5, 0.1), (2, "b", 1.0, 10, 0.5, 0.1), (3, "c", 3.0, 10, 0.9, 0.2)],
        "line_no int, name string, eff_nseq double, M int, p_relE double, compKL double",
    )
    got = profiles.rank_profiles(df, "line_no").orderBy("rank").collect()
    assert [r["name"] for r in got] == ["c", "a", "b"]
    assert got[0]["score"] == pytest.approx(0.45 + 0.30 - 0.10)


def test_trim_alignments(spark):
    records = spark.createDataFrame(
        [("1", 1, "seq1/10-16", "AB-CD-EF"[0:2] + "CD-EF" + "G"), ("1", 2, "seq2/20-25", "-AB-CDEF"),
         ("1", 3, "full_length", "ABCDEFGH")],
        "family_id string, line_order int, header string, sequence string",
    )
    masks = spark.createDataFrame([("1", "..xxx.x.")], "family_id string, mask string")
    got = [(r["header"], r["sequence"]) for r in alignments.trim_alignments(records, masks).orderBy("line_order").collect()]
    assert got == [("seq1/12-15", "CD-EF"), ("seq2/21-24", "B-CDE"), ("full_length/3-7", "CDEFG")]
    whole = spark.createDataFrame([("1", "x..xxx.x")], "family_id string, mask string")
    kept = alignments.trim_alignments(records, whole).orderBy("line_order").collect()
    assert [r["header"] for r in kept] == ["seq1/10-16", "seq2/20-25", "full_length"]


@pytest.mark.parametrize("mask, message", [("xx", "differ in width"), (None, "no mask")])
def test_trim_rejects_bad_masks(spark, mask, message):
    records = spark.createDataFrame(
        [("1", 1, "a/1-3", "ABC")], "family_id string, line_order int, header string, sequence string"
    )
    masks = spark.createDataFrame([("1" if mask else "2", mask or "x")], "family_id string, mask string")
    with pytest.raises(Exception, match=message):
        alignments.trim_alignments(records, masks).collect()


def test_rewrite_keeps_unknown_keys(spark):
    document = {
        "a": [1, {"b": None}],
        "architecture_containers": [{"n": 1, "domains": [{"id": "0", "name": "xFAM9", "w": 2}, {"name": "other"}, {"id": 1}]}],
    }
    df = spark.createDataFrame([("12", json.dumps(document)), ("3", '{"q":1}')], "id string, document string")
    got = {r["id"]: json.loads(r["document"]) for r in documents.rewrite_domain_documents(df, "FAM", "AC", "http://h/").collect()}
    first = got["12"]["architecture_containers"][0]
    assert first["domains"][0] == {"id": "12", "name": "FAM12", "link": "http://h/AC0000000012", "w": 2}
    assert first["domains"][1:] == [{"name": "other"}, {"id": 1}] and first["n"] == 1
    assert got["12"]["a"] == [1, {"b": None}] and got["3"] == {"q": 1}


def test_schema_helpers(spark):
    df = spark.range(1)
    with pytest.raises(MissingColumnsError, match="t lacks the columns a, b"):
        require_columns(df, ["b", "id", "a"], "t")
    assert add_missing_columns(df, {"id": "int", "x": "int"}).dtypes == [("id", "bigint"), ("x", "int")]
