"""Interval, coverage and annotation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.functions.annotations import parsed_hits
from famloom.functions.ranges import region_hull, region_segments
from famloom.operators.intervals import (
    covered_length,
    intersect_intervals,
    merge_intervals,
    subtract_intervals,
)
from famloom.plans import coverage as C
from famloom.session import durable
from famloom.sources.reports import domain_hits_from_lines
from famloom.sources.tables import widen
from query_catalog.adapters import HITS_SQL, hits, table


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    every = hits(spark, folder)
    return every.filter("which = 1"), every.filter("which = 2")


def _spans(df: DataFrame) -> DataFrame:
    return C.region_spans(df)


def interval_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(_spans(hits(spark, folder)), "protein")


def interval_difference(spark: SparkSession, folder: str) -> DataFrame:
    first, second = _sides(spark, folder)
    return subtract_intervals(_spans(first), _spans(second), "protein")


def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    first, second = _sides(spark, folder)
    return intersect_intervals(_spans(first), _spans(second), "protein")


def interval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return covered_length(_spans(hits(spark, folder)), "protein")


def annotation_diff(spark: SparkSession, folder: str) -> DataFrame:
    return C.annotation_diff(*_sides(spark, folder))


def annotation_diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.diff_summary(annotation_diff(spark, folder))


def annotation_diff_report(spark: SparkSession, folder: str) -> DataFrame:
    return C.summary_report(annotation_diff_summary(spark, folder))


def exclusive_regions(spark: SparkSession, folder: str) -> DataFrame:
    first, second = _sides(spark, folder)
    return C.exclusive_regions(first, second, "row_no")


def region_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Both readings of a region: its segments and its hull."""
    hull = region_hull(F.translate("region", "_", "-"), F.lit(60))
    segments = region_segments(F.col("region"))
    return (
        hits(spark, folder)
        .select("protein", F.size(segments).alias("n"), hull.alias("hull"))
        .groupBy("protein")
        .agg(
            F.sum("n").alias("n_segments"),
            F.min("hull.start").alias("hull_start"),
            F.max("hull.end").alias("hull_end"),
        )
    )


def proteins(spark: SparkSession, folder: str) -> DataFrame:
    """Each line as a protein with one to three hits in its document.

    The first ``p`` hit runs backwards, the second may pass the end of the
    sequence; lines with return flag N have no ``m`` hits, lines without tax no
    document at all.
    """
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    p = F.format_string(
        '"p":[["PF1",1e-5,20.0,1,3,%d,%d],["PF2",1e-6,22.5,1,3,%d,%d]]', n + 4, n, q, q + 6
    )
    m = F.format_string(',"m":[["F%d",1e-7,35.0,%d,%d]]', F.col("l_suppkey"), q - 3, q + 2)
    document = F.concat(
        F.lit("{"), p, F.when(F.col("l_returnflag") == "N", "").otherwise(m), F.lit(',"x":{"y":1}}')
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag"
    )
    return widen(lines).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("protein"),
        F.repeat(F.lit("A"), q + 3).alias("sequence"),
        F.when(F.col("l_tax") == 0, "").otherwise(document).alias("metadata"),
    )


_PROTEINS_SQL = """
proteins AS (
  SELECT row_number() OVER () AS rid, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q,
         CAST(l_quantity AS INTEGER) + 3 AS len, l_returnflag AS flag, l_tax FROM lineitem),
spans AS (
  SELECT rid, len, 'p' AS k, n AS s, n + 4 AS e FROM proteins WHERE l_tax <> 0
  UNION ALL SELECT rid, len, 'p', q, q + 6 FROM proteins WHERE l_tax <> 0
  UNION ALL SELECT rid, len, 'm', q - 3, q + 2 FROM proteins WHERE l_tax <> 0 AND flag <> 'N'),
points AS (
  SELECT rid, k, unnest(range(greatest(s, 1), least(e, len) + 1)) AS pos FROM spans),
counts AS (
  SELECT 'pfam' AS label, 'p' AS annotation_keys, count(DISTINCT rid) AS seqs,
         count(DISTINCT (rid, pos)) AS residues FROM points WHERE k = 'p'
  UNION ALL
  SELECT 'pfam_families', 'p,m', count(DISTINCT rid), count(DISTINCT (rid, pos)) FROM points),
totals AS (SELECT count(*) AS n_seq, CAST(sum(len) AS BIGINT) AS n_aa FROM proteins),
stats AS (
  SELECT label, annotation_keys, n_seq AS total_sequences, seqs AS annotated_sequences,
         round(CAST(seqs AS DOUBLE) / n_seq * 100, 6) AS annotated_sequence_percentage,
         n_aa AS total_amino_acids, residues AS annotated_amino_acids,
         round(CAST(residues AS DOUBLE) / n_aa * 100, 6) AS annotated_amino_acid_percentage
  FROM counts, totals)
"""

_SELECTIONS = {"pfam": "p", "pfam_families": "p,m"}


def annotation_stats(spark: SparkSession, folder: str) -> DataFrame:
    return C.annotation_stats(C.whole_rows(proteins(spark, folder)), _SELECTIONS)


def annotation_compare(spark: SparkSession, folder: str) -> DataFrame:
    stats = annotation_stats(spark, folder)
    return C.compare_stats(stats, "pfam", "pfam_families")


def _domain_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines rendered as 22-token domain-hit text; lines without tax get a short line."""
    number = F.col("l_quantity").cast("int")
    middle = [F.lit("x")] * 3
    full = F.concat_ws(
        "  ",
        F.col("l_orderkey"), F.lit("-"), F.lit("100"),
        F.concat(F.lit("F"), F.col("l_suppkey").cast("string")),
        F.lit("-"), F.lit("120"), F.lit("1e-20"), F.lit("50.0"), F.lit("0.0"),
        F.lit("1"), F.lit("1"), F.lit("2e-10"),
        F.col("l_discount").cast("string"), F.format_string("%.1f", "l_quantity"), F.lit("0.0"),
        F.lit("1"), F.lit("3"), number.cast("string"), (number + F.col("l_linenumber")).cast("string"),
        *middle,
    )
    short = F.concat(F.lit("# "), full)
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    return widen(lines).select(
        F.when(F.col("l_tax") == 0, short).otherwise(full).alias("value"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount").alias(
            "line_order"
        ),
    )


def domain_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Domain-hit text parsed and filtered by e-value."""
    return domain_hits_from_lines(_domain_lines(spark, folder), 0.05).drop("line_order")


def annotation_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Searched hits numbered within their protein."""
    return C.annotation_hits(durable(domain_hits_from_lines(_domain_lines(spark, folder), 0.05)))


def append_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of orders with new ``m`` hits, read back hit by hit."""
    return _appended(spark, folder, C.HITS_PER_CELL).drop("part")


def append_annotations_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The same in parts of two hits."""
    return _appended(spark, folder, 2)


def _appended(spark: SparkSession, folder: str, per_cell: int) -> DataFrame:
    proteins_ = widen(table(spark, folder, "orders")).select(
        F.col("o_orderkey").cast("string").alias("protein"),
        F.format_string(
            '{"p":[["P",1e-5,2.0,1,2,3,%d]],"m":[["old",1,2,3,4]]}', F.col("o_custkey")
        ).alias("metadata"),
    )
    found = durable(domain_hits_from_lines(_domain_lines(spark, folder), 0.05))
    annotated = C.append_annotations(proteins_, found, per_cell=per_cell)
    read = annotated.select("protein", "part", parsed_hits(F.col("metadata")).alias("doc"))
    return read.select(
        "protein",
        "part",
        F.col("doc.p")[0][6].cast("int").alias("kept"),
        F.posexplode_outer("doc.m").alias("hit_no", "hit"),
    ).select(
        "protein",
        "part",
        "kept",
        "hit_no",
        F.col("hit")[0].alias("family"),
        F.col("hit")[1].cast("double").alias("evalue"),
        F.col("hit")[2].cast("double").alias("score"),
        F.col("hit")[3].cast("int").alias("ali_from"),
        F.col("hit")[4].cast("int").alias("ali_to"),
    )


def annotation_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Before/after statistics with orders as proteins and lines as searched hits."""
    proteins_ = widen(table(spark, folder, "orders")).select(
        F.col("o_orderkey").cast("string").alias("protein"),
        F.repeat(F.lit("A"), 40).alias("sequence"),
        F.format_string(
            '{"p":[["P",1e-5,2.0,1,2,3,%d]]}', F.length("o_orderpriority")
        ).alias("metadata"),
    )
    found = durable(domain_hits_from_lines(_domain_lines(spark, folder), 0.05))
    return C.annotation_pipeline(proteins_, found)[2]


def annotation_pipeline_by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The same per order priority; hits get the priority of their order."""
    orders = widen(table(spark, folder, "orders"))
    proteins_ = orders.select(
        F.col("o_orderkey").cast("string").alias("protein"),
        F.col("o_orderpriority").alias("dataset"),
        F.repeat(F.lit("A"), 40).alias("sequence"),
        F.format_string(
            '{"p":[["P",1e-5,2.0,1,2,3,%d]]}', F.length("o_orderpriority")
        ).alias("metadata"),
    )
    found = domain_hits_from_lines(_domain_lines(spark, folder), 0.05)
    places = proteins_.select(F.col("protein").alias("target"), "dataset")
    return C.annotation_pipeline(proteins_, durable(found.join(places, "target")), dataset="dataset")[2]


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Orders cut into chunks of 1000 in key order."""
    sequences = table(spark, folder, "orders").select("o_orderkey")
    return C.chunk_sequences(sequences, ["o_orderkey"], 1000, F.lit("proteins"))


def _islands(condition: str) -> str:
    return f"""
WITH {HITS_SQL},
chosen AS (
  SELECT protein, pos FROM positions GROUP BY protein, pos HAVING {condition}),
grouped AS (
  SELECT protein, pos, pos - row_number() OVER (PARTITION BY protein ORDER BY pos) AS g FROM chosen)
SELECT protein, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS "end"
FROM grouped GROUP BY protein, g
"""


_DIFF = """
diff AS (
  SELECT protein, count(*) FILTER (a) AS total_coverage_file1,
         count(*) FILTER (b) AS total_coverage_file2,
         count(*) FILTER (a AND NOT b) AS exclusive_coverage_file1,
         count(*) FILTER (b AND NOT a) AS exclusive_coverage_file2,
         count(*) FILTER (a AND b) AS overlap_coverage
  FROM (SELECT protein, pos, bool_or(which = 1) AS a, bool_or(which = 2) AS b
        FROM positions GROUP BY protein, pos) GROUP BY protein),
summary AS (
  SELECT CAST(sum(total_coverage_file1) AS BIGINT) AS total_coverage_file1,
         CAST(sum(total_coverage_file2) AS BIGINT) AS total_coverage_file2,
         CAST(sum(exclusive_coverage_file1) AS BIGINT) AS exclusive_coverage_file1,
         CAST(sum(exclusive_coverage_file2) AS BIGINT) AS exclusive_coverage_file2,
         CAST(sum(overlap_coverage) AS BIGINT) AS overlap_coverage,
         CAST(sum(exclusive_coverage_file2) + sum(total_coverage_file1) AS DOUBLE)
           / CAST(sum(total_coverage_file1) AS DOUBLE) * 100 AS increase_ratio
  FROM diff)
"""

QUERIES = {
    "interval_merge": interval_merge,
    "interval_difference": interval_difference,
    "interval_overlap": interval_overlap,
    "interval_coverage": interval_coverage,
    "annotation_diff": annotation_diff,
    "annotation_diff_summary": annotation_diff_summary,
    "annotation_diff_report": annotation_diff_report,
    "exclusive_regions": exclusive_regions,
    "region_parse": region_parse,
    "annotation_stats": annotation_stats,
    "annotation_compare": annotation_compare,
    "domain_hits": domain_hits,
    "annotation_hits": annotation_hits,
    "append_annotations": append_annotations,
    "append_annotations_parts": append_annotations_parts,
    "annotation_pipeline": annotation_pipeline,
    "annotation_pipeline_by_dataset": annotation_pipeline_by_dataset,
    "chunk_ids": chunk_ids,
}

ORACLES = {
    "interval_merge": _islands("true"),
    "interval_difference": _islands("max(which) = 1"),
    "interval_overlap": _islands("count(DISTINCT which) = 2"),
    "interval_coverage": f"""
WITH {HITS_SQL} SELECT protein, count(DISTINCT pos) AS covered FROM positions GROUP BY protein
""",
    "annotation_diff": f"WITH {HITS_SQL}, {_DIFF} SELECT * FROM diff",
    "annotation_diff_summary": f"WITH {HITS_SQL}, {_DIFF} SELECT * FROM summary",
    "annotation_diff_report": f"""
WITH {HITS_SQL}, {_DIFF}
SELECT 'Total Coverage File 1' AS label, CAST(total_coverage_file1 AS VARCHAR) AS value FROM summary
UNION ALL SELECT 'Total Coverage File 2', CAST(total_coverage_file2 AS VARCHAR) FROM summary
UNION ALL SELECT 'Exclusive Coverage File 1', CAST(exclusive_coverage_file1 AS VARCHAR) FROM summary
UNION ALL SELECT 'Exclusive Coverage File 2', CAST(exclusive_coverage_file2 AS VARCHAR) FROM summary
UNION ALL SELECT 'Overlap Coverage', CAST(overlap_coverage AS VARCHAR) FROM summary
UNION ALL SELECT 'Amino Acid Level Increase', CAST(exclusive_coverage_file2 AS VARCHAR) FROM summary
UNION ALL SELECT 'Increase Ratio', printf('%.2f%%', increase_ratio) FROM summary
""",
    "exclusive_regions": f"""
WITH {HITS_SQL},
chosen AS (SELECT protein, pos FROM positions GROUP BY protein, pos HAVING min(which) = 2),
grouped AS (
  SELECT protein, pos, pos - row_number() OVER (PARTITION BY protein ORDER BY pos) AS g FROM chosen),
firsts AS (
  SELECT protein, family_id FROM (
    SELECT protein, family_id, row_number() OVER (
      PARTITION BY protein ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r
    FROM hits WHERE which = 2) WHERE r = 1)
SELECT f.family_id, g.protein, concat(min(pos), '-', max(pos)) AS region,
       CAST(count(*) AS BIGINT) AS annotation_length
FROM grouped g JOIN firsts f ON f.protein = g.protein GROUP BY f.family_id, g.protein, g.g
""",
    "region_parse": f"""
WITH {HITS_SQL}
SELECT protein, CAST(sum(CASE WHEN l_tax > 0.04 THEN 2 ELSE 1 END) AS BIGINT) AS n_segments,
       min(s) AS hull_start,
       max(CASE WHEN l_tax > 0.04 THEN s + 70 + l_linenumber ELSE s + l_linenumber * 3 END) AS hull_end
FROM hits GROUP BY protein
""",
    "annotation_stats": f"WITH {_PROTEINS_SQL} SELECT * FROM stats",
    "annotation_compare": f"""
WITH {_PROTEINS_SQL}
SELECT b.label AS before_label, a.label AS after_label,
  b.total_sequences AS total_sequences_before, a.total_sequences AS total_sequences_after,
  b.annotated_sequences AS annotated_sequences_before, a.annotated_sequences AS annotated_sequences_after,
  b.annotated_sequence_percentage AS annotated_sequence_percentage_before,
  a.annotated_sequence_percentage AS annotated_sequence_percentage_after,
  round(a.annotated_sequence_percentage - b.annotated_sequence_percentage, 6)
    AS annotated_sequence_percentage_point_increase,
  round((a.annotated_sequence_percentage - b.annotated_sequence_percentage)
    / b.annotated_sequence_percentage * 100, 6) AS annotated_sequence_relative_increase_percentage,
  b.total_amino_acids AS total_amino_acids_before, a.total_amino_acids AS total_amino_acids_after,
  b.annotated_amino_acids AS annotated_amino_acids_before,
  a.annotated_amino_acids AS annotated_amino_acids_after,
  b.annotated_amino_acid_percentage AS annotated_amino_acid_percentage_before,
  a.annotated_amino_acid_percentage AS annotated_amino_acid_percentage_after,
  round(a.annotated_amino_acid_percentage - b.annotated_amino_acid_percentage, 6)
    AS annotated_amino_acid_percentage_point_increase,
  round((a.annotated_amino_acid_percentage - b.annotated_amino_acid_percentage)
    / b.annotated_amino_acid_percentage * 100, 6) AS annotated_amino_acid_relative_increase_percentage
FROM stats b, stats a WHERE b.label = 'pfam' AND a.label = 'pfam_families'
""",
    "domain_hits": """
SELECT CAST(l_orderkey AS VARCHAR) AS target, concat('F', l_suppkey) AS query,
       l_discount AS i_evalue, l_quantity AS score, CAST(l_quantity AS INTEGER) AS ali_from,
       CAST(l_quantity AS INTEGER) + l_linenumber AS ali_to
FROM lineitem WHERE l_tax <> 0 AND l_discount <= 0.05
""",
    "annotation_hits": """
SELECT CAST(l_orderkey AS VARCHAR) AS protein,
       row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS hit_no,
       concat('F', l_suppkey) AS family, l_discount AS evalue, l_quantity AS score,
       CAST(l_quantity AS INTEGER) AS ali_from, CAST(l_quantity AS INTEGER) + l_linenumber AS ali_to
FROM lineitem WHERE l_tax <> 0 AND l_discount <= 0.05
""",
    "append_annotations_parts": """
WITH found AS (
  SELECT l_orderkey, concat('F', l_suppkey) AS family, l_discount AS evalue, l_quantity AS score,
         CAST(l_quantity AS INTEGER) AS ali_from, CAST(l_quantity AS INTEGER) + l_linenumber AS ali_to,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 AS n
  FROM lineitem WHERE l_tax <> 0 AND l_discount <= 0.05)
SELECT CAST(o_orderkey AS VARCHAR) AS protein, CAST(coalesce(n, 0) // 2 AS INTEGER) AS part,
       CASE WHEN coalesce(n, 0) < 2 THEN CAST(o_custkey AS INTEGER) END AS kept,
       CAST(n % 2 AS INTEGER) AS hit_no, family, evalue, score, ali_from, ali_to
FROM orders LEFT JOIN found ON l_orderkey = o_orderkey
""",
    "append_annotations": """
WITH found AS (
  SELECT l_orderkey, concat('F', l_suppkey) AS family, l_discount AS evalue, l_quantity AS score,
         CAST(l_quantity AS INTEGER) AS ali_from, CAST(l_quantity AS INTEGER) + l_linenumber AS ali_to,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 AS hit_no
  FROM lineitem WHERE l_tax <> 0 AND l_discount <= 0.05)
SELECT CAST(o_orderkey AS VARCHAR) AS protein, CAST(o_custkey AS INTEGER) AS kept,
       CAST(hit_no AS INTEGER) AS hit_no, family, evalue, score, ali_from, ali_to
FROM orders LEFT JOIN found ON l_orderkey = o_orderkey
""",
    "annotation_pipeline": """
WITH spans AS (
  SELECT o_orderkey AS k, 'p' AS kind, 3 AS s, length(o_orderpriority) AS e FROM orders
  UNION ALL
  SELECT l_orderkey, 'm', CAST(l_quantity AS INTEGER), CAST(l_quantity AS INTEGER) + l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax <> 0 AND l_discount <= 0.05),
points AS (SELECT k, kind, unnest(range(greatest(s, 1), least(e, 40) + 1)) AS pos FROM spans),
n AS (SELECT count(*) AS ns, count(*) * 40 AS na FROM orders),
b AS (SELECT count(DISTINCT k) AS s, count(DISTINCT (k, pos)) AS r FROM points WHERE kind = 'p'),
a AS (SELECT count(DISTINCT k) AS s, count(DISTINCT (k, pos)) AS r FROM points),
share AS (
  SELECT ns, na, b.s AS bs, a.s AS as_, b.r AS br, a.r AS ar,
         round(CAST(b.s AS DOUBLE) / ns * 100, 6) AS bsp, round(CAST(a.s AS DOUBLE) / ns * 100, 6) AS asp,
         round(CAST(b.r AS DOUBLE) / na * 100, 6) AS brp, round(CAST(a.r AS DOUBLE) / na * 100, 6) AS arp
  FROM n, b, a)
SELECT 'pfam' AS before_label, 'pfam_families' AS after_label,
  ns AS total_sequences_before, ns AS total_sequences_after,
  bs AS annotated_sequences_before, as_ AS annotated_sequences_after,
  bsp AS annotated_sequence_percentage_before, asp AS annotated_sequence_percentage_after,
  round(asp - bsp, 6) AS annotated_sequence_percentage_point_increase,
  round((asp - bsp) / bsp * 100, 6) AS annotated_sequence_relative_increase_percentage,
  CAST(na AS BIGINT) AS total_amino_acids_before, CAST(na AS BIGINT) AS total_amino_acids_after,
  br AS annotated_amino_acids_before, ar AS annotated_amino_acids_after,
  brp AS annotated_amino_acid_percentage_before, arp AS annotated_amino_acid_percentage_after,
  round(arp - brp, 6) AS annotated_amino_acid_percentage_point_increase,
  round((arp - brp) / brp * 100, 6) AS annotated_amino_acid_relative_increase_percentage
FROM share
""",
    "annotation_pipeline_by_dataset": """
WITH spans AS (
  SELECT o_orderpriority AS d, o_orderkey AS k, 'p' AS kind, 3 AS s, length(o_orderpriority) AS e FROM orders
  UNION ALL
  SELECT o_orderpriority, l_orderkey, 'm', CAST(l_quantity AS INTEGER), CAST(l_quantity AS INTEGER) + l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax <> 0 AND l_discount <= 0.05),
points AS (SELECT d, k, kind, unnest(range(greatest(s, 1), least(e, 40) + 1)) AS pos FROM spans),
n AS (SELECT o_orderpriority AS d, count(*) AS ns, count(*) * 40 AS na FROM orders GROUP BY 1),
b AS (SELECT d, count(DISTINCT k) AS s, count(DISTINCT (k, pos)) AS r FROM points WHERE kind = 'p' GROUP BY d),
a AS (SELECT d, count(DISTINCT k) AS s, count(DISTINCT (k, pos)) AS r FROM points GROUP BY d),
share AS (
  SELECT n.d, ns, na, b.s AS bs, a.s AS as_, b.r AS br, a.r AS ar,
         round(CAST(b.s AS DOUBLE) / ns * 100, 6) AS bsp, round(CAST(a.s AS DOUBLE) / ns * 100, 6) AS asp,
         round(CAST(b.r AS DOUBLE) / na * 100, 6) AS brp, round(CAST(a.r AS DOUBLE) / na * 100, 6) AS arp
  FROM n JOIN b ON b.d = n.d JOIN a ON a.d = n.d)
SELECT d AS dataset, 'pfam' AS before_label, 'pfam_families' AS after_label,
  ns AS total_sequences_before, ns AS total_sequences_after,
  bs AS annotated_sequences_before, as_ AS annotated_sequences_after,
  bsp AS annotated_sequence_percentage_before, asp AS annotated_sequence_percentage_after,
  round(asp - bsp, 6) AS annotated_sequence_percentage_point_increase,
  round((asp - bsp) / bsp * 100, 6) AS annotated_sequence_relative_increase_percentage,
  CAST(na AS BIGINT) AS total_amino_acids_before, CAST(na AS BIGINT) AS total_amino_acids_after,
  br AS annotated_amino_acids_before, ar AS annotated_amino_acids_after,
  brp AS annotated_amino_acid_percentage_before, arp AS annotated_amino_acid_percentage_after,
  round(arp - brp, 6) AS annotated_amino_acid_percentage_point_increase,
  round((arp - brp) / brp * 100, 6) AS annotated_amino_acid_relative_increase_percentage
FROM share
""",
    "chunk_ids": """
SELECT o_orderkey, printf('proteins_chunk_%06d', CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS BIGINT))
  AS chunk_id FROM orders
""",
}
