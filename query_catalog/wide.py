"""Record overlaps, long id lists, residue bitmaps, committed updates, rejected rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.functions.annotations import document_faults
from famloom.operators.bitmaps import bitmap_totals
from famloom.operators.overlaps import overlap_pairs as pairs_of
from famloom.operators.quarantine import part_rows
from famloom.operators.sieve import IdSieve
from famloom.operators.versions import VersionedTable
from famloom.plans import coverage as C
from famloom.session import ensure_checkpoint_dir
from famloom.sinks import fasta_lines
from famloom.sources.bundles import bundle_lines, read_bundles, write_bundles
from famloom.sources.reports import local_quality_from_lines
from query_catalog.adapters import HITS_SQL, hits, table


def overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of segments of the two annotation sets that overlap on a protein."""
    spans = C.region_spans(hits(spark, folder), "which", "family_id", "row_no").select(
        "protein", "which", "family_id", F.col("row_no.l_linenumber").alias("line"), "start", "end"
    )
    first, second = (spans.filter(f"which = {side}").drop("which") for side in (1, 2))
    return pairs_of(first, second, "protein")


def overlap_partners(spark: SparkSession, folder: str) -> DataFrame:
    """Orders open at the same time: pairs of one customer whose shipping periods overlap."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        *[pick(F.unix_date(F.to_date("l_shipdate"))).alias(n) for n, pick in (("start", F.min), ("end", F.max))]
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    periods = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    found = pairs_of(periods, periods, "o_custkey").filter("o_orderkey_1 < o_orderkey_2")
    return found.select(
        "o_custkey", "o_orderkey_1", "o_orderkey_2",
        (F.col("overlap_end") - F.col("overlap_start") + 1).alias("days"),
    )


def _large_orders(spark: SparkSession, folder: str) -> IdSieve:
    return IdSieve(table(spark, folder, "orders").filter("o_totalprice > 300000").select("o_orderkey"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def sieve_keep(spark: SparkSession, folder: str) -> DataFrame:
    return _large_orders(spark, folder).keep(_lines(spark, folder), "l_orderkey")


def sieve_remove(spark: SparkSession, folder: str) -> DataFrame:
    return _large_orders(spark, folder).remove(_lines(spark, folder), "l_orderkey")


def sieve_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _large_orders(spark, folder).flag(_lines(spark, folder), "l_orderkey", "is_large")


def residue_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    """Residues of both annotation sets per protein, and their Jaccard similarity."""
    spans = C.region_spans(hits(spark, folder), "which")
    totals = bitmap_totals(spans, "protein", "which")
    union = F.col("total1") + F.col("total2") - F.col("overlap")
    return totals.withColumn("jaccard", F.try_divide(F.col("overlap").cast("double"), union))


def committed_update(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a versioned table: balances set by orders, then segments of some; both versions."""
    held = VersionedTable(spark, f"{ensure_checkpoint_dir(spark)}/versioned-{uuid.uuid4().hex}")
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    held.create(customers, "c_custkey", buckets=16)
    changes = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.struct("o_orderdate", "o_orderkey").alias("row_no"),
    )
    second = held.update(changes, ["c_acctbal"], "row_no")
    rich = held.read().filter("c_acctbal > 200000").select("c_custkey", F.lit("RICH").alias("c_mktsegment"))
    held.update(rich, ["c_mktsegment"])
    numbered = [
        held.read(v.number).withColumn("version", F.lit(v.number)) for v in (second, held.latest())
    ]
    return numbered[0].unionByName(numbered[1])


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each line as an annotation document; some are cut off, lack fields or hold words for numbers."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    whole = F.format_string('{"p":[["PF",1e-5,20.0,1,3,%d,%d]],"m":[["F",1e-7,35.0,%d,%d]]}', n, n + 4, q, q + 6)
    document = (
        F.when(F.col("l_tax") == 0.01, F.expr("substring(whole, 1, length(whole) - 1)"))
        .when(F.col("l_tax") == 0.02, F.format_string('{"p":[["PF",1e-5,20.0,1,3,%d]]}', n))
        .when(F.col("l_tax") == 0.03, F.format_string('{"m":[["F",1e-7,35.0,%d,"end"]]}', n))
        .when(F.col("l_tax") == 0.04, F.format_string('{"m":{"F":%d}}', n))
        .when(F.col("l_tax") == 0.05, F.lit(None).cast("string"))
        .otherwise(F.col("whole"))
    )
    lines = table(spark, folder, "lineitem").withColumn("whole", whole)
    return lines.select("l_orderkey", "l_linenumber", document.alias("metadata"))


def annotation_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Good and rejected documents with the reason, and how many share it."""
    parted = part_rows(_documents(spark, folder), document_faults(F.col("metadata")))
    counts = [F.struct(F.lit(k).alias("outcome"), F.lit(n).cast("bigint").alias("n")) for k, n in parted.counts.items()]
    totals = spark.range(1).select(F.inline(F.array(*counts)))
    both = parted.rejected.withColumnRenamed("reject_reason", "outcome").unionByName(
        parted.good.withColumn("outcome", F.lit("good"))
    )
    return both.join(F.broadcast(totals), "outcome").select("l_orderkey", "l_linenumber", "metadata", "outcome", "n")


def local_quality_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as structure files whose quality tables open and close far from their rows."""
    lines = table(spark, folder, "lineitem")
    row = F.concat_ws(" ", F.lit("A"), F.lit("1"), F.lit("M"), F.lit("1"), F.col("l_quantity").cast("int"), F.lit("1 1"))
    head = F.when(
        F.expr("l_orderkey % 40 = 0"), F.lit("_ma_qa_metric_local.ordinal_id")
    ).when(F.expr("l_orderkey % 60 = 7"), F.lit("loop_")).otherwise(F.lit("ATOM 1 N N . MET A 1 1 ? 1.5"))
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    written = lines.select(
        F.col("l_suppkey").alias("file_path"), place.alias("_place"), F.posexplode(F.array(head, row)).alias("_no", "value")
    ).select(
        "file_path",
        "value",
        F.struct(
            F.col("file_path").alias("file"), F.expr("_place.l_orderkey div 5000").alias("block"),
            F.struct("_place", "_no").alias("row"),
        ).alias("line_order"),
    )
    return local_quality_from_lines(written).groupBy("file_path", "section").agg(
        F.count(F.lit(1)).alias("residues"), F.sum(F.col("plddt").cast("bigint")).alias("quality")
    )


def family_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as FASTA records in bundles of their suppliers, and the records of every bundle."""
    path = f"{ensure_checkpoint_dir(spark)}/bundles-{uuid.uuid4().hex}"
    header = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")
    records = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber",
        fasta_lines(header, F.concat("l_returnflag", "l_linestatus")).alias("record"),
    )
    write_bundles(records, path, "l_suppkey", "record", ["l_orderkey", "l_linenumber"])
    lines = bundle_lines(read_bundles(spark, path))
    return lines.groupBy(F.col("family").alias("l_suppkey"), F.col("value").alias("line")).agg(
        F.count(F.lit(1)).alias("n"), (F.min("line_order") % 2).alias("place")
    )


QUERIES = {
    "family_bundles": family_bundles,
    "overlap_pairs": overlap_pairs,
    "overlap_partners": overlap_partners,
    "sieve_keep": sieve_keep,
    "sieve_remove": sieve_remove,
    "sieve_flag": sieve_flag,
    "residue_bitmap": residue_bitmap,
    "committed_update": committed_update,
    "annotation_quarantine": annotation_quarantine,
    "local_quality_lines": local_quality_lines,
}

_LARGE = "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000"
_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_quantity"

ORACLES = {
    "family_bundles": """
SELECT l_suppkey, '>' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS line,
       count(*) AS n, CAST(0 AS INTEGER) AS place
FROM lineitem GROUP BY ALL
UNION ALL
SELECT l_suppkey, l_returnflag || l_linestatus, count(*), CAST(1 AS INTEGER) FROM lineitem GROUP BY ALL
""",
    "overlap_pairs": f"""WITH {HITS_SQL},
spans AS (
  SELECT protein, which, family_id, l_linenumber AS line, s, s + l_linenumber * 3 AS e FROM hits
  UNION ALL
  SELECT protein, which, family_id, l_linenumber, s + 70, s + 70 + l_linenumber FROM hits WHERE l_tax > 0.04)
SELECT a.protein, a.family_id AS family_id_1, a.line AS line_1, a.s AS start_1, a.e AS end_1,
       b.family_id AS family_id_2, b.line AS line_2, b.s AS start_2, b.e AS end_2,
       greatest(a.s, b.s) AS overlap_start, least(a.e, b.e) AS overlap_end
FROM spans a JOIN spans b ON a.protein = b.protein AND a.s <= b.e AND b.s <= a.e
WHERE a.which = 1 AND b.which = 2
""",
    "overlap_partners": """
WITH periods AS (
  SELECT o_custkey, o_orderkey, min(CAST(l_shipdate AS DATE)) AS s, max(CAST(l_shipdate AS DATE)) AS e
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT a.o_custkey, a.o_orderkey AS o_orderkey_1, b.o_orderkey AS o_orderkey_2,
       CAST(date_diff('day', greatest(a.s, b.s), least(a.e, b.e)) + 1 AS BIGINT) AS days
FROM periods a JOIN periods b ON a.o_custkey = b.o_custkey AND a.s <= b.e AND b.s <= a.e
WHERE a.o_orderkey < b.o_orderkey
""",
    "sieve_keep": f"SELECT {_COLUMNS} FROM lineitem WHERE l_orderkey IN ({_LARGE})",
    "sieve_remove": f"SELECT {_COLUMNS} FROM lineitem WHERE l_orderkey NOT IN ({_LARGE})",
    "sieve_flag": f"SELECT {_COLUMNS}, l_orderkey IN ({_LARGE}) AS is_large FROM lineitem",
    "residue_bitmap": f"""WITH {HITS_SQL},
sides AS (
  SELECT protein, pos, bool_or(which = 1) AS one, bool_or(which = 2) AS two FROM positions GROUP BY ALL)
SELECT protein, count(*) FILTER (one) AS total1, count(*) FILTER (two) AS total2,
       count(*) FILTER (one AND two) AS overlap,
       CAST(count(*) FILTER (one AND two) AS DOUBLE) / count(*) AS jaccard
FROM sides GROUP BY protein
""",
    "committed_update": """
WITH second AS (
  SELECT c_custkey, coalesce(arg_max(o_totalprice, (o_orderdate, o_orderkey)), any_value(c_acctbal)) AS c_acctbal,
         any_value(c_mktsegment) AS c_mktsegment
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT *, 2 AS version FROM second
UNION ALL
SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 200000 THEN 'RICH' ELSE c_mktsegment END, 3 FROM second
""",
    "annotation_quarantine": """
WITH written AS (
  SELECT l_orderkey, l_linenumber, l_tax,
         printf('{"p":[["PF",1e-5,20.0,1,3,%d,%d]],"m":[["F",1e-7,35.0,%d,%d]]}', l_linenumber, l_linenumber + 4,
                CAST(l_quantity AS INTEGER), CAST(l_quantity AS INTEGER) + 6) AS whole
  FROM lineitem),
judged AS (
  SELECT l_orderkey, l_linenumber,
         CASE l_tax WHEN 0.01 THEN left(whole, length(whole) - 1)
              WHEN 0.02 THEN printf('{"p":[["PF",1e-5,20.0,1,3,%d]]}', l_linenumber)
              WHEN 0.03 THEN printf('{"m":[["F",1e-7,35.0,%d,"end"]]}', l_linenumber)
              WHEN 0.04 THEN printf('{"m":{"F":%d}}', l_linenumber)
              WHEN 0.05 THEN NULL ELSE whole END AS metadata,
         CASE l_tax WHEN 0.01 THEN 'not a JSON object' WHEN 0.02 THEN 'short hit under p'
              WHEN 0.03 THEN 'bad coordinate under m' WHEN 0.04 THEN 'm is not a list of hits'
              ELSE 'good' END AS outcome
  FROM written)
SELECT *, count(*) OVER (PARTITION BY outcome) AS n FROM judged
""",
    "local_quality_lines": """
WITH placed AS (
  SELECT l_suppkey AS file_path, CAST(CAST(l_quantity AS INTEGER) AS BIGINT) AS q,
         CASE WHEN l_orderkey % 40 = 0 THEN 1 WHEN l_orderkey % 60 = 7 THEN 0 END AS event,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n
  FROM lineitem),
scanned AS (
  SELECT file_path, q, last_value(event IGNORE NULLS) OVER upto AS state,
         count(*) FILTER (event = 1) OVER upto AS section
  FROM placed WINDOW upto AS (PARTITION BY file_path ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT file_path, section, count(*) AS residues, CAST(sum(q) AS BIGINT) AS quality
FROM scanned WHERE state = 1 GROUP BY ALL
""",
}
