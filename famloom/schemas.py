"""Table schemas and schema checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

HITS = "family_id string, protein string, region string"
MEMBERS = "family_id bigint, protein string, region string"
FAMILY_META = "id bigint, protein_rep string, rep_region string, rep_length int, family_size bigint"
PROTEINS = "protein string, sequence string, full_length string, cluster_size int, metadata string"
SIMILARITIES = "fam1 bigint, fam2 bigint, similarity double"
ID_MAP = "old_id bigint, new_id bigint"
CLUSTERS = "cluster_rep string, sequence_id string"
MODEL_HITS = "family_id bigint, hmm_range string"
FOLDS = "family_id bigint, target string, aligned_length int"
STARS = "family_id bigint, quality_stars int, novelty_stars int"
STRUCTURE_HITS = (
    "query string, target string, fident double, alnlen int, mismatch int, gapopen int, "
    "qstart int, qend int, tstart int, tend int, evalue double, bits double"
)


class MissingColumnsError(ValueError):
    """A table lacks columns an operator needs."""


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    """Return ``df`` unchanged, or raise naming the missing columns in sorted order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def add_missing_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Append each absent column as nulls of the given type."""
    absent = {
        name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns
    }
    return df.withColumns(absent) if absent else df
