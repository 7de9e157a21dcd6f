"""Readers and writers on files made for the test."""

from __future__ import annotations

import glob
import gzip
import json
import os

import random

import pytest
from pyspark.sql import functions as F

from famloom import sinks
from famloom.operators import remap, updates
from famloom.plans import alignments, collect, profiles
from famloom.sources.tables import read_lines
from famloom.sources import files, reports, tables


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as handle:
        handle.write(text)
    return str(path)


def _texts(folder):
    out = []
    for path in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)):
        with (gzip.open(path, "rt") if path.endswith(".gz") else open(path)) as handle:
            out.append(handle.read())
    return "".join(out)


def _domain_line(target, query, evalue, start, end):
    return f"{target} - 100 {query} - 120 1e-20 50.0 0.0 1 1 2e-10 {evalue} 45.0 0.0 4 60 {start} {end} 2 70 0.95 -\n"


def test_domain_hits_from_gz_chunks(spark, tmp_path):
    text = "# comment\n\n" + _domain_line("s1", "F1", "3e-10", 8, 64) + _domain_line("s1", "F2", "0.3", 1, 5) + "short line\n"
    _write(tmp_path / "d" / "a_000001.gz", text)
    _write(tmp_path / "d" / "a_000002.gz", _domain_line("s1", "F3", "1e-4", 2, 3) + _domain_line("s2", "F4", "0.001", 2, 3))
    got = reports.read_domain_hits(spark, str(tmp_path / "d")).orderBy("line_order").collect()
    assert [(r["target"], r["query"], r["ali_from"], r["ali_to"]) for r in got] == [
        ("s1", "F1", 8, 64), ("s1", "F3", 2, 3), ("s2", "F4", 2, 3),
    ]
    assert reports.read_domain_hits(spark, str(tmp_path / "d"), None, partitions=3).count() == 4
    assert {r[0] for r in reports.read_annotated_targets(spark, str(tmp_path / "d")).collect()} == {"s1", "s2", "short"}


def test_profile_stats(spark, tmp_path):
    path = _write(tmp_path / "stats.txt", "# idx name\n\n1 a - 10 3.5 80 0.59 0.6 0.5 0.02\n2 b PF1 12 4.5 90 0.59 0.6 0.7 0.01\n")
    ranked = profiles.rank_profiles(reports.read_profile_stats(spark, path), "line_order")
    rows = profiles.ranked_report(ranked).orderBy("rank").collect()
    assert [(r["name"], r["eff_nseq"], r["score"]) for r in rows] == [("b", "4.50", "0.9000"), ("a", "3.50", "-0.1000")]
    bad = _write(tmp_path / "bad.txt", "1 2 3\n")
    with pytest.raises(Exception, match="3 tokens instead of 10, row"):
        reports.read_profile_stats(spark, bad).collect()


def test_csv_readers(spark, tmp_path):
    path = _write(tmp_path / "p.csv.gz", 'b,a\n"x,""y""\nz",1\n,2\n')
    got = tables.read_csv(spark, path, "a int, b string", multi_line=True).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, 'x,"y"\nz'), (2, None)]
    with pytest.raises(ValueError, match="lacks the columns c"):
        tables.read_csv(spark, path, "a int, c string")
    report = _write(tmp_path / "r.csv", "# title\n# more\nRow,Family Id 1\n1,7\n")
    assert [tuple(r) for r in tables.read_commented_csv(spark, report).collect()] == [("1", "7")]
    headerless = _write(tmp_path / "h.tsv", "a\tb\n")
    assert tuple(tables.read_headerless(spark, headerless, "x string, y string", "\t").first()) == ("a", "b")


def test_csv_files_with_other_headers_fail(spark, tmp_path):
    _write(tmp_path / "many" / "a.csv", "a,b\n1,x\n")
    _write(tmp_path / "many" / "b.csv", "b,a\ny,2\n")
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(tmp_path / "many"), "a int, b string").collect()


def test_quoted_trees_of_any_size(spark):
    from famloom.functions.trees import tree_records

    wide = "x, ""\n" * 20_000
    blobs = [
        'ids,labels,parents,counts\r\nroot,"a ""b"", c\nd",,2\r\n"root:x","",root,bad\r\n',
        'ids,labels,parents,counts\nroot,"' + wide.replace('"', '""') + '",,1.9\n',
        "ids,labels,parents,counts\n" + '"root","l",,1\n' * 20_000,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, blob string")
    got = [r["r"] for r in df.select(tree_records(F.col("blob")).alias("r"), "i").orderBy("i").collect()]
    assert [tuple(r) for r in got[0]] == [("root", 'a "b", c\nd', "", 2, 0), ("root:x", "", "root", 0, 1)]
    assert got[1][0]["labels"] == wide and got[1][0]["counts"] == 1
    assert len(got[2]) == 20_000


def test_id_readers(spark, tmp_path):
    path = _write(tmp_path / "ids.txt", "1\n\n 2 \n1\n")
    assert sorted(r[0] for r in tables.read_ids(spark, path, kind="bigint").collect()) == [1, 2]
    path = _write(tmp_path / "acc.csv", "ID,Full size\nFAM0000000003,200\nFAM0000000012,1\n")
    assert sorted(r[0] for r in tables.read_accessions(spark, path).collect()) == [3, 12]
    path = _write(tmp_path / "bad.csv", "ID\nabc\n")
    with pytest.raises(Exception, match="no number in"):
        tables.read_accessions(spark, path).collect()


def test_trim_job_from_files(spark, tmp_path):
    _write(tmp_path / "msa" / "1.fas.gz", ">seq1/10-16\nABCD-\nEFG\n>seq2/20-25\n-AB-CDEF\n")
    _write(tmp_path / "rf" / "1.txt", "..xxx.x.\n")
    records = files.read_fasta(spark, str(tmp_path / "msa")).withColumn(
        "family_id", F.regexp_extract("file_name", r"^(.*)\.fas\.gz$", 1)
    )
    trimmed = alignments.trim_alignments(records, files.read_masks(spark, str(tmp_path / "rf")))
    numbered = trimmed.select("family_id", F.col("line_order.row").alias("row"), "header", "sequence")
    sinks.write_family_fasta(numbered, str(tmp_path / "out"), "family_id", "row")
    assert _texts(tmp_path / "out" / "family_id=1") == ">seq1/12-15\nCD-EF\n>seq2/21-24\nB-CDE\n"
    _write(tmp_path / "bad" / "2.txt", "..y")
    with pytest.raises(Exception, match="invalid mask"):
        files.read_masks(spark, str(tmp_path / "bad")).collect()


def test_representatives_from_files(spark, tmp_path):
    _write(tmp_path / "m" / "x" / "7.fas", ">rep/1-4 some > text\nab-\nc.d1\n>other\nTTTT\n")
    _write(tmp_path / "m" / "8.fas", "")
    records = files.read_fasta(spark, str(tmp_path / "m"), recursiveFileLookup=True, pathGlobFilter="*.fas")
    first = files.first_records(records).withColumn("family_id", F.regexp_extract("file_name", r"^(.*)\.fas$", 1))
    got = alignments.representatives(first).collect()
    assert [tuple(r) for r in got] == [("7", "rep/1-4", "ABCD")]
    named = spark.createDataFrame([("7 rep", "ABCD"), ("8", "")], "n string, s string")
    sinks.write_fasta(named, str(tmp_path / "fa"), "n", "s")
    assert _texts(tmp_path / "fa") == ">7 rep\nABCD\n"


HORIZ = "# x\n\nConf: 98\nPred: HH\n  AA: MK\n\nConf: 701\nPred: ECC\n  AA: VLA\n"


def test_secondary_structure_from_files(spark, tmp_path):
    _write(tmp_path / "s" / "1.horiz", HORIZ)
    predictions = reports.read_secondary_structure(spark, str(tmp_path / "s"))
    documents = alignments.secondary_structure_features(predictions)
    sinks.write_json_documents(documents, str(tmp_path / "json"), "document")
    document = json.loads(_texts(tmp_path / "json"))
    assert document["sequence"] == "MKVLA"
    tracks = {f["name"]: f for f in document["features"]}
    assert tracks["α-helices"]["data"] == [{"x": 1, "y": 2}] and tracks["α-helices"]["className"] == "pred-h"
    assert tracks["β-strands"]["data"] == [{"x": 3, "y": 3}]
    assert tracks["Coil"]["data"] == [{"x": 4, "y": 5}]
    assert [p["y"] for p in tracks["Confidence Score"]["data"]] == [9, 8, 7, 0, 1]
    _write(tmp_path / "bad" / "1.horiz", "Conf: 9\nPred: HH\n  AA: M\n")
    with pytest.raises(Exception, match="not equally long"):
        reports.read_secondary_structure(spark, str(tmp_path / "bad")).collect()


def test_local_quality(spark, tmp_path):
    body = "loop_\n_ma_qa_metric_local.label_asym_id\n_ma_qa_metric_local.ordinal_id\nA 1 M 1 50.5 1 1\nA 2 K 1 60.5 1 2\n#\nloop_\nA 2 K 1 99.0 1 2\n"
    _write(tmp_path / "c" / "1.cif", "data_x\n1 2 3 4 5 6 7\n" + body)
    _write(tmp_path / "c" / "2.cif", "data_y\n")
    got = alignments.structure_quality(reports.read_local_quality(spark, str(tmp_path / "c"))).collect()
    assert {tuple(r) for r in got} == {("1", 2, 55.5), ("2", 0, 0.0)}


def test_local_quality_of_files_in_many_splits(spark, tmp_path):
    """Sections that begin splits before their rows, against a search of the whole text."""
    draw = random.Random(2)
    want = {}
    for name in range(6):
        lines = []
        for _ in range(draw.choice([0, 40, 400])):
            kind = draw.random()
            lines.append(
                "_ma_qa_metric_local.ordinal_id" if kind < 0.04 else " loop_" if kind < 0.07
                else f"A {len(lines)} M 1 {draw.randrange(100)} 1 1" if kind < 0.6 else "ATOM 1 N N . MET A 1 1 ? 1.5"
            )
        text = "\n".join(["data_x", *lines]) + "\n"
        _write(tmp_path / "s" / f"{name}.cif", text)
        inside, found = False, []
        for line in lines:
            if line.startswith("_ma"):
                inside = True
            elif line == " loop_":
                inside = False
            elif inside and len(line.split()) == 7:
                found.append(float(line.split()[4]))
        want[str(name)] = sorted(found) or [None]
    sizes = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    kept = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        assert read_lines(spark, str(tmp_path / "s")).rdd.getNumPartitions() > 20
        rows = reports.read_local_quality(spark, str(tmp_path / "s")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    got = {}
    for row in rows:
        got.setdefault(row.id, []).append(row.plddt)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_blobs_from_files(spark, tmp_path):
    _write(tmp_path / "b" / "1.fas.gz", ">a\nX\n")
    listed = files.family_files(files.list_files(spark, str(tmp_path / "b")))
    blobs = files.read_file_text(spark, str(tmp_path / "b")).join(listed.select("family_id", "file_name"), "file_name")
    families = spark.createDataFrame([(1, None)], "family_id long, seed_blob binary")
    got = updates.attach_all_blobs(families, blobs, "family_id", "seed_blob").collect()
    assert [(r["family_id"], bytes(r["seed_blob"])) for r in got] == [(1, b">a\nX\n")]
    _write(tmp_path / "b2" / "x1.fas.gz", "")
    with pytest.raises(Exception, match="not a numeric family id"):
        files.family_files(files.list_files(spark, str(tmp_path / "b2"))).collect()
    for folder in ("1", "2"):
        _write(tmp_path / "b3" / folder / "7.fas.gz", "")
    with pytest.raises(Exception, match="Duplicate file for family id 7"):
        files.family_files(files.list_files(spark, str(tmp_path / "b3"), recursiveFileLookup=True)).collect()


def test_collect_from_marked_folders(spark, tmp_path):
    root = tmp_path / "work"
    _write(root / "aa" / "11" / "versions.yml", "FOLD:SCORES\n")
    _write(root / "aa" / "22" / "versions.yml", "OTHER\n")
    line = "Predicted structure for {} with length 20, pLDDT 54.7, pTM 0.029 in 2.3s\n"
    _write(root / "aa" / "11" / "1_scores.txt", "noise\n" + line.format(1))
    _write(root / "aa" / "22" / "2_scores.txt", line.format(2))
    got = collect.collect_scores(spark, str(root), "versions.yml", ["X", "FOLD:SCORES"]).collect()
    assert [tuple(r) for r in got] == [(1, 20, 54.7, 0.029)]
    _write(root / "aa" / "11" / "h.m8", "1\tpdb1\t0.5\t30\t1\t0\t1\t30\t2\t31\t1e-5\t50\n")
    hits = collect.collect_structure_hits(spark, str(root), "versions.yml", ["FOLD"]).collect()
    assert [(r["target"], r["alnlen"], r["bits"]) for r in hits] == [("pdb1", 30, 50.0)]


def test_collect_documents_by_hidden_marker(spark, tmp_path):
    root = tmp_path / "work"
    _write(root / "aa" / "11" / ".command.run", "# PARSE_DOMAINS\n")
    _write(root / "aa" / "11" / "domain_results" / "1.json", "{}")
    _write(root / "aa" / "22" / ".command.run", "# ELSE\n")
    _write(root / "aa" / "22" / "domain_results" / "2.json", "{}")
    got = collect.collect_documents(spark, str(root), ".command.run", ["PARSE_DOMAINS"]).collect()
    assert [r["stem"] for r in got] == ["1"]


def test_collect_selected_families(spark, tmp_path):
    root = tmp_path / "work"
    folder = root / "aa" / "11"
    _write(folder / "versions.yml", "REFINE\n")
    for kind in ("rf", "hmm", "msa_sto", "seed_msa_sto", "domtblout"):
        _write(folder / kind / "c1_5.txt", "x")
        _write(folder / kind / "c1_6.txt", "x")
    _write(folder / "refined_families" / "c1.tsv", "5\tp1\n6\tp2\n5\tp3\textra\n")
    _write(folder / "family_metadata" / "c1.csv", "5,10,rep,1-9,zz\n6,1,r,2\n5,1\n")
    ids = spark.createDataFrame([("c1_5",), ("c9_9",)], "id string")
    got = collect.collect_selected_families(spark, str(root), ids, "versions.yml", ["REFINE"])
    assert got["files"].count() == 5
    assert [tuple(r) for r in got["members"].collect()] == [("c1_5", "p1")]
    assert [tuple(r) for r in got["metadata"].collect()] == [("c1_5", "10", "rep", "1-9")]


def test_file_plan_from_listing(spark, tmp_path):
    for name in ("1.cif", "2.cif", "3.cif"):
        _write(tmp_path / "c" / name, "x")
    plan = remap.file_plan(
        files.list_files(spark, str(tmp_path / "c")),
        removed=spark.createDataFrame([("2",)], "id string"),
        mapping=spark.createDataFrame([("3", "30"), ("2", "20")], "old_id string, new_id string"),
    )
    assert {tuple(r) for r in plan.collect()} == {
        ("1.cif", "keep", None), ("2.cif", "drop", None), ("3.cif", "rename", "30.cif"),
    }


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id int, share double").coalesce(1)
    sinks.write_csv(sinks.fixed_decimals(df), str(tmp_path / "csv"))
    assert _texts(tmp_path / "csv") == "id,share\n1,0.500000\n"
    sinks.write_csv(df, str(tmp_path / "tsv"), separator="\t", compression="gzip")
    assert _texts(tmp_path / "tsv") == "id\tshare\n1\t0.5\n"
    sinks.write_ids(df, str(tmp_path / "ids"), "id")
    assert _texts(tmp_path / "ids") == "1\n"
    sinks.write_tables({"t": df}, str(tmp_path / "db"))
    sinks.append_table(df, str(tmp_path / "db" / "t"))
    scanned = tables.scan_table(spark, str(tmp_path / "db" / "t"), ["id"], present="share")
    assert scanned.count() == 2 and tables.row_count(scanned).first()["n_rows"] == 2
