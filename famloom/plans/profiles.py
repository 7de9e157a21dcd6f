"""Ranking profiles by a weighted score, and length/size distributions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from famloom.functions.scores import PROFILE_WEIGHTS, min_max, weighted_sum
from famloom.functions.sequences import bin_label, bin_start, size_group
from famloom.operators.skew import flag_members, global_position


def score_profiles(profiles: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``score``: the weighted sum of the columns scaled to 0..1 over all profiles."""
    weights = dict(PROFILE_WEIGHTS, **(weights or {}))
    ends = [F.min(c).cast("double").alias(f"min_{c}") for c in weights] + [
        F.max(c).cast("double").alias(f"max_{c}") for c in weights
    ]
    bounds = profiles.agg(*ends).select(F.struct("*").alias("bounds")).scalar()
    parts = {
        c: min_max(F.col(c).cast("double"), F.col(f"_bounds.min_{c}"), F.col(f"_bounds.max_{c}"))
        for c in weights
    }
    bounded = profiles.withColumn("_bounds", bounds)
    return bounded.withColumn("score", weighted_sum(parts, weights)).drop("_bounds")


def rank_profiles(
    profiles: DataFrame, order: str, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Profiles with score and rank, best first; ties keep the ``order`` column's order."""
    scored = score_profiles(profiles, weights)
    return global_position(scored, [F.col("score").desc(), F.col(order)], "rank")


def ranked_report(ranked: DataFrame) -> DataFrame:
    """Ranked profiles as text: two decimals, four for the score."""
    two = ["eff_nseq", "relent", "info", "p_relE", "compKL"]
    return ranked.select(
        "rank", "idx", "name", "accession", "nseq",
        *[
            F.format_string("%.2f", c).alias(c) if c in two else F.col(c)
            for c in ["eff_nseq", "M", "relent", "info", "p_relE", "compKL"]
        ],
        F.format_string("%.4f", "score").alias("score"),
    )


def length_distribution(
    families: DataFrame, annotated_ids: DataFrame, value: str = "hmm_length",
    short_max: int = 300, medium_max: int = 1000,
    short_bin: int = 10, medium_bin: int = 50, long_bin: int = 100,
) -> DataFrame:
    """Annotated and other families per size group and bin, in one pass.

    ``families`` has family_id and the ``value`` column (length or size).
    """
    flagged = flag_members(families, annotated_ids, "family_id", "_annotated")

    def by_group(short: int, medium: int, long: int):
        return (
            F.when(F.col("size_group") == "short", short)
            .when(F.col("size_group") == "medium", medium)
            .otherwise(long)
        )

    grouped = flagged.withColumn("size_group", size_group(F.col(value), short_max, medium_max))
    width = by_group(short_bin, medium_bin, long_bin)
    floor = by_group(0, short_max, medium_max)
    counted = (
        grouped.withColumn("bin_start", bin_start(F.col(value), width))
        .groupBy("size_group", "bin_start")
        .agg(
            F.count_if("_annotated").alias("annotated"),
            F.count_if(~F.col("_annotated")).alias("unannotated"),
        )
    )
    total = F.col("annotated") + F.col("unannotated")
    return counted.select(
        "size_group",
        "bin_start",
        bin_label(F.col("bin_start"), width, floor).alias("bin_label"),
        "annotated",
        "unannotated",
        (F.lit(100.0) * F.col("annotated") / total).alias("percent_annotated"),
    )


def family_lengths(report: DataFrame) -> DataFrame:
    """family_id, consensus length and size from the family report."""
    return report.select(
        F.col("`Family Id`").cast("string").alias("family_id"),
        F.length("HMM consensus").alias("hmm_length"),
        F.col("Size").cast("bigint").alias("size"),
    )
