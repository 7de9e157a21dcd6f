"""Alignment rows: trimming by mask, representatives, secondary structure, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from famloom.functions.sequences import STATE_TRACKS, feature_document, letters_upper, trimmed_record
from famloom.operators.runs import text_runs


def trim_alignments(
    records: DataFrame, masks: DataFrame, order: str = "line_order"
) -> DataFrame:
    """Cut the masked ends off every aligned row.

    ``records``: family_id, header, sequence and the order column; ``masks``:
    family_id, mask.  A family without a mask, a row of another length than its
    mask, or an unreadable header fails the job.
    """
    joined = records.join(masks, "family_id", "left")
    mask = F.coalesce(
        "mask", F.raise_error(F.concat(F.lit("no mask for family "), F.col("family_id")))
    )
    checked = joined.withColumn("mask", mask)
    return checked.select(
        "family_id",
        order,
        trimmed_record(F.col("header"), F.col("sequence"), F.col("mask")).alias("_row"),
    ).select("family_id", order, "_row.header", "_row.sequence")


def representatives(first: DataFrame, name: str = "family_id") -> DataFrame:
    """First record of each family: its id, the record's own id, letters in upper case."""
    return first.select(
        name,
        F.regexp_extract("header", r"^(\S*)", 1).alias("record_id"),
        letters_upper(F.col("sequence")).alias("sequence"),
    )


def secondary_structure_features(predictions: DataFrame) -> DataFrame:
    """Feature document per protein from confidence digits, states and residues."""
    columns = {state: f"_runs_{state}" for state in STATE_TRACKS}
    placed = text_runs(predictions.select("id", "confidence", "states", "residues"), "states", columns)
    runs = {state: F.col(name) for state, name in columns.items()}
    return placed.select(
        "id", feature_document(F.col("confidence"), runs, F.col("residues")).alias("document")
    )


def structure_quality(residues: DataFrame) -> DataFrame:
    """Residue count and mean local quality per structure; 0 and 0.0 without residues."""
    return residues.groupBy("id").agg(
        F.count("plddt").cast("int").alias("length"),
        F.coalesce(F.avg("plddt"), F.lit(0.0)).alias("plddt"),
    )
