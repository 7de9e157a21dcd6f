"""Whitespace-separated hit tables, profile statistics, logs and per-protein reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from famloom.functions.ids import file_stem
from famloom.operators.sections import section_lines
from famloom.sources.tables import read_headerless, read_lines
from famloom.schemas import STRUCTURE_HITS

# Fixed format of a domain-hit line: fewest tokens and the 0-based places used.
DOMAIN_TOKENS = 22
DOMAIN_PLACES = {"target": 0, "query": 3, "i_evalue": 12, "score": 13, "ali_from": 17, "ali_to": 18}

# Fixed format of a profile-statistics line: its ten columns in order.
PROFILE_COLUMNS = {
    "idx": "int", "name": "string", "accession": "string", "nseq": "int", "eff_nseq": "double",
    "M": "int", "relent": "double", "info": "double", "p_relE": "double", "compKL": "double",
}

# Fixed format of a structure-score log line.
SCORE_LINE = r"Predicted structure for (\d+) with length (\d+), pLDDT ([\d.]+), pTM ([\d.]+)"


def tokens(line: Column) -> Column:
    """Whitespace-separated parts of a line."""
    return F.split(F.btrim(line, F.lit(" \t\r\n\f\v")), r"\s+")


def _token_rows(lines: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Lines that ``keep`` accepts, with their tokens as ``_parts``, split once per line."""
    parts = F.filter(F.array(tokens(F.col("value"))), keep)
    return lines.select("*", F.explode(parts).alias("_parts"))


def _data_lines(lines: DataFrame) -> DataFrame:
    blank = F.btrim("value", F.lit(" \t\r\n\f\v")) == ""
    return lines.filter(~F.col("value").startswith("#") & ~blank)


def domain_hits_from_lines(lines: DataFrame, max_evalue: float | None = 0.001) -> DataFrame:
    """Hits in a text DataFrame (``value`` plus any order columns); short lines are skipped."""
    kinds = {"i_evalue": "double", "score": "double", "ali_from": "int", "ali_to": "int"}
    # Blank lines are too short to count, so only comments need a test of their own.
    parts = _token_rows(
        lines.filter(~F.col("value").startswith("#")), lambda p: F.size(p) >= DOMAIN_TOKENS
    )
    hits = parts.select(
        *[
            F.get("_parts", F.lit(place)).cast(kinds.get(name, "string")).alias(name)
            for name, place in DOMAIN_PLACES.items()
        ],
        *[c for c in lines.columns if c != "value"],
    )
    return hits if max_evalue is None else hits.filter(F.col("i_evalue") <= max_evalue)


def read_domain_hits(
    spark: SparkSession,
    path: str | list[str],
    max_evalue: float | None = 0.001,
    partitions: int | None = None,
) -> DataFrame:
    """Domain hits of one or many (gz) files; ``line_order`` keeps file and line order.

    Gzip files cannot be split, so ``partitions`` can spread their lines after the scan.
    """
    lines = read_lines(spark, path)
    if partitions:
        lines = lines.repartition(partitions, F.xxhash64("value"))
    return domain_hits_from_lines(lines, max_evalue)


def read_annotated_targets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct first tokens of all data lines."""
    lines = _data_lines(spark.read.text(path))
    return lines.select(F.get(tokens(F.col("value")), F.lit(0)).alias("family_id")).distinct()


def read_profile_stats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Profile statistics; a data line without exactly ten tokens fails the job."""
    return profile_stats_from_lines(read_lines(spark, path))


def profile_stats_from_lines(lines: DataFrame) -> DataFrame:
    """Profile statistics in a text DataFrame: ``value`` and the ``line_order`` of a reader."""
    lines = _data_lines(lines).withColumn("_parts", tokens(F.col("value")))
    wanted = len(PROFILE_COLUMNS)
    checked = F.when(F.size("_parts") == wanted, F.col("_parts")).otherwise(
        F.raise_error(
            F.concat(
                F.lit("profile statistics: "), F.size("_parts").cast("string"),
                F.lit(f" tokens instead of {wanted}, row "), F.col("line_order.row").cast("string"),
                F.lit(" of split "), F.col("line_order.block").cast("string"), F.lit(" in "),
                F.col("line_order.file"), F.lit(": "), F.col("value"),
            )
        )
    )
    lines = lines.withColumn("_parts", checked)
    return lines.select(
        *[
            F.get("_parts", F.lit(place)).cast(kind).alias(name)
            for place, (name, kind) in enumerate(PROFILE_COLUMNS.items())
        ],
        "line_order",
    )


def scores_from_lines(lines: DataFrame) -> DataFrame:
    """Structure scores found in log lines."""
    found = lines.filter(F.col("value").rlike(SCORE_LINE))
    return found.select(
        F.regexp_extract("value", SCORE_LINE, 1).cast("bigint").alias("id"),
        F.regexp_extract("value", SCORE_LINE, 2).cast("int").alias("length"),
        F.regexp_extract("value", SCORE_LINE, 3).cast("double").alias("plddt"),
        F.regexp_extract("value", SCORE_LINE, 4).cast("double").alias("ptm"),
    )


def read_structure_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Structure-search hits of all files, one after the other."""
    return read_headerless(spark, path, STRUCTURE_HITS, separator="\t")


def read_secondary_structure(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per protein file: confidence digits, states and residues joined over its blocks.

    One file is one protein, so a file is one row.  Unequal lengths fail the job.
    """
    texts = spark.read.text(path, wholetext=True)
    return secondary_structure_from_text(
        texts.select(file_stem(F.col("_metadata.file_name")).alias("id"), "value")
    )


def secondary_structure_from_text(texts: DataFrame) -> DataFrame:
    """The same for whole texts in a DataFrame (id, value)."""

    def joined(pattern: str) -> Column:
        return F.array_join(F.regexp_extract_all(F.col("value"), F.lit(pattern), F.lit(1)), "")

    parsed = texts.select(
        "id",
        joined(r"(?m)^Conf:[ \t]*(\d*)").alias("confidence"),
        joined(r"(?m)^Pred:[ \t]*(\S*)").alias("states"),
        joined(r"(?m)^  AA:[ \t]*(\S*)").alias("residues"),
    )
    same = (F.length("confidence") == F.length("states")) & (
        F.length("states") == F.length("residues")
    )
    return parsed.withColumn(
        "states",
        F.when(same, F.col("states")).otherwise(
            F.raise_error(F.lit("secondary structure: confidence, states and residues are not equally long"))
        ),
    )


def read_local_quality(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per structure file: one row per residue of its local-quality table.

    The table starts after the line naming its first column and ends at the next
    ``loop_``; its rows have seven tokens, the fifth being the quality.  Files
    without the table keep one row with null quality.  Large files are read in splits.
    """
    found = local_quality_from_lines(read_lines(spark, path)).select("file_path", "plddt")
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file_path"), file_stem(F.col("_metadata.file_name")).alias("id")
    )
    return files.join(found, "file_path", "left").select("id", "plddt")


def local_quality_from_lines(lines: DataFrame) -> DataFrame:
    """The same for lines in a DataFrame (file_path, value, line_order): file_path, section, plddt."""
    opens = F.col("value").contains("_ma_qa_metric_local.ordinal_id")
    closes = F.col("value").rlike(r"^\s*loop_")
    parts = tokens(F.col("value"))
    rows = section_lines(
        lines.select("file_path", "value", "line_order"),
        "file_path", F.col("line_order.block"), F.col("line_order"), opens, closes, F.size(parts) == 7,
    )
    return rows.select("file_path", "section", F.get(parts, F.lit(4)).cast("double").alias("plddt"))
