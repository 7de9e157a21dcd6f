"""Parsers and layouts over text rendered from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.functions.ids import digits_of
from famloom.plans.superfamilies import members_of_report
from famloom.sinks import fixed_decimals
from famloom.sources.reports import profile_stats_from_lines, secondary_structure_from_text
from query_catalog.adapters import table


def profile_stats_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as lines of profile statistics, with a comment and a blank line for each."""
    line = F.format_string(
        "%d  %s %s  %d %.2f %d 0.50 1.25 0.75 2.00 ",
        F.col("p_partkey"),
        F.replace("p_brand", F.lit("#"), F.lit("_")),
        F.concat(F.lit("AC"), F.col("p_partkey")),
        F.col("p_size"),
        F.col("p_size") / 4,
        F.length("p_name"),
    )
    lines = table(spark, folder, "part").select(
        F.explode(F.array(F.lit("# idx name"), F.lit(" \t"), line)).alias("value"),
        F.struct(
            F.lit("part").alias("file"), F.lit(0).alias("block"), F.col("p_partkey").alias("row")
        ).alias("line_order"),
    )
    return profile_stats_from_lines(lines).drop("line_order")


def secondary_structure_text(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as predictions of two blocks."""
    states = F.repeat(F.substring("o_orderstatus", 1, 1), F.length("o_orderpriority"))
    block = F.concat(
        F.lit("Conf: "), F.repeat(F.lit("7"), F.length("o_orderpriority")),
        F.lit("\nPred: "), states,
        F.lit("\n  AA: "), F.upper(F.repeat(F.lit("g"), F.length("o_orderpriority"))),
        F.lit("\n\n"),
    )
    texts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("# report\n"), block, block).alias("value")
    )
    return secondary_structure_from_text(texts)


def accession_list(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers inside accessions, each once."""
    names = table(spark, folder, "lineitem").select(
        F.concat(F.lit("FAM"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("accession")
    )
    return names.select(digits_of(F.col("accession")).alias("id")).distinct()


def report_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members read back from ``;``-joined cells, one cell per order."""
    report = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("Cluster Id"))
        .agg(F.array_join(F.collect_list(F.concat(F.lit("P"), F.col("l_partkey"))), ";").alias("Family Ids"))
    )
    return members_of_report(report, "Cluster Id", "Family Ids")


def fixed_decimals_report(spark: SparkSession, folder: str) -> DataFrame:
    """Prices and quantities as text with four and one decimals."""
    prices = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").cast("double").alias("price"),
        F.col("l_quantity").cast("double").alias("quantity"),
    )
    return fixed_decimals(prices, {"price": 4, "quantity": 1})


QUERIES = {
    "profile_stats_lines": profile_stats_lines,
    "secondary_structure_text": secondary_structure_text,
    "accession_list": accession_list,
    "report_members": report_members,
    "fixed_decimals_report": fixed_decimals_report,
}

ORACLES = {
    "profile_stats_lines": """
SELECT CAST(p_partkey AS INTEGER) AS idx, replace(p_brand, '#', '_') AS name, concat('AC', p_partkey) AS accession,
       CAST(p_size AS INTEGER) AS nseq, CAST(p_size AS DOUBLE) / 4 AS eff_nseq,
       CAST(length(p_name) AS INTEGER) AS "M", 0.5::DOUBLE AS relent, 1.25::DOUBLE AS info,
       0.75::DOUBLE AS "p_relE", 2.0::DOUBLE AS "compKL"
FROM part
""",
    "secondary_structure_text": """
SELECT o_orderkey AS id, repeat('7', 2 * length(o_orderpriority)) AS confidence,
       repeat(left(o_orderstatus, 1), 2 * length(o_orderpriority)) AS states,
       repeat('G', 2 * length(o_orderpriority)) AS residues
FROM orders
""",
    "accession_list": "SELECT DISTINCT CAST(l_partkey AS BIGINT) AS id FROM lineitem",
    "report_members": """
SELECT CAST(l_orderkey AS VARCHAR) AS cluster_id, concat('P', l_partkey) AS family_id FROM lineitem
""",
    "fixed_decimals_report": """
SELECT l_orderkey, l_linenumber, l_partkey, printf('%.4f', CAST(l_extendedprice AS DOUBLE)) AS price,
       printf('%.1f', CAST(l_quantity AS DOUBLE)) AS quantity
FROM lineitem
""",
}
