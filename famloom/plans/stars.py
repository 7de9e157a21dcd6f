"""Quality and novelty stars of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from famloom.functions.ranges import template_coverage
from famloom.functions.scores import novelty_stars, novelty_stars_from_ids, quality_stars
from famloom.operators.skew import flag_members


def model_coverage(model_hits: DataFrame, key: str = "family_id", text: str = "hmm_range") -> DataFrame:
    """Largest template coverage per family among well-formed ``x-y (z)`` ranges."""
    return (
        model_hits.filter(F.col(text).ilike("%-% (%"))
        .groupBy(key)
        .agg(F.max(template_coverage(F.col(text))).alias("model_coverage"))
    )


def best_folds(
    folds: DataFrame, key: str = "family_id", target: str = "target",
    length: str = "aligned_length", excluded_prefix: str | None = None,
) -> DataFrame:
    """Longest alignment per family; families whose longest is 0 or null are left out.

    ``excluded_prefix`` drops targets starting with it, ignoring case.
    """
    if excluded_prefix is not None:
        folds = folds.filter(~F.col(target).ilike(f"{excluded_prefix}%"))
    best = folds.groupBy(key).agg(F.max(length).alias("aligned_length"))
    return best.filter(F.col("aligned_length") != 0)


def stars(families: DataFrame, coverage: DataFrame, folds: DataFrame) -> DataFrame:
    """Both star ratings per family.

    ``families``: id, plddt, family_size, rep_length; the others come from
    :func:`model_coverage` and :func:`best_folds`.
    """
    joined = families.join(
        coverage.select(F.col("family_id").alias("id"), "model_coverage"), "id", "left"
    ).join(folds.select(F.col("family_id").alias("id"), "aligned_length"), "id", "left")
    return joined.select(
        F.col("id").alias("family_id"),
        quality_stars(F.col("plddt"), F.col("family_size"), F.col("rep_length")).alias(
            "quality_stars"
        ),
        novelty_stars(
            F.col("model_coverage"), F.col("aligned_length"), F.col("rep_length")
        ).alias("novelty_stars"),
    )


def stars_from_lists(
    sizes: DataFrame, scores: DataFrame, model_ids: DataFrame, fold_ids: DataFrame
) -> DataFrame:
    """Star ratings when only the lists of annotated ids are known (novelty 0-3).

    ``sizes``: id, family_size; ``scores``: id, length, plddt.  Only families in both count.
    """
    joined = scores.join(sizes, "id")
    flagged = flag_members(joined, model_ids, "id", "_in_models")
    flagged = flag_members(flagged, fold_ids, "id", "_in_folds")
    return flagged.select(
        F.col("id").alias("family_id"),
        quality_stars(F.col("plddt"), F.col("family_size"), F.col("length")).alias("quality_stars"),
        novelty_stars_from_ids(F.col("_in_models"), F.col("_in_folds")).alias("novelty_stars"),
    )
