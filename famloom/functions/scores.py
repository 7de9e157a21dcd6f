"""Scores, shares and star ratings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Default weights of the profile score.
PROFILE_WEIGHTS = {"eff_nseq": 0.45, "p_relE": 0.30, "M": 0.15, "compKL": -0.10}


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent at 6 decimals; 0 when the whole is 0."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(F.round(ratio * 100, 6), F.lit(0.0))


def relative_increase(before: Column, after: Column) -> Column:
    """Change relative to ``before`` in percent at 6 decimals; 0 when it is 0."""
    ratio = (after - before) / F.nullif(before, F.lit(0.0))
    return F.coalesce(F.round(ratio * 100, 6), F.lit(0.0))


def _star(condition: Column, stars: int = 1) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), stars).otherwise(0)


def quality_stars(plddt: Column, family_size: Column, rep_length: Column) -> Column:
    """0-4: pLDDT from 70 gives 2 and from 50 gives 1; size and length from 100 give 1 each."""
    return (
        _star(plddt >= 50) + _star(plddt >= 70) + _star(family_size >= 100) + _star(rep_length >= 100)
    )


def novelty_stars(model_coverage: Column, aligned_length: Column, rep_length: Column) -> Column:
    """0-4: two for no model hit and two for no fold, or one each when under half covered."""
    share = aligned_length / F.nullif(rep_length.cast("double"), F.lit(0.0))
    model = _star(model_coverage.isNull(), 2) + _star(model_coverage < 0.5)
    fold = _star(aligned_length.isNull(), 2) + _star(share < 0.5)
    return model + fold


def novelty_stars_from_ids(in_models: Column, in_folds: Column) -> Column:
    """0-3: two when absent from the model list, one when absent from the fold list."""
    return _star(~in_models, 2) + _star(~in_folds)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; 0 for a column whose values are all equal."""
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def weighted_sum(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of ``weights[name] * parts[name]`` in the order of ``weights``."""
    total = None
    for name, weight in weights.items():
        term = F.lit(float(weight)) * parts[name]
        total = term if total is None else total + term
    return total
