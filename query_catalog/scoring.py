"""Star and profile-score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.operators.updates import apply_stars as apply_star_columns
from famloom.plans import alignments, profiles as P, stars as S
from famloom.sources.reports import scores_from_lines
from query_catalog.adapters import (
    FAMILIES_SQL, FOLDS_SQL, MODEL_SQL, PROFILES_SQL, folds, model_hits, profiles, star_families, table,
)


def max_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return S.model_coverage(model_hits(spark, folder))


def best_fold(spark: SparkSession, folder: str) -> DataFrame:
    return S.best_folds(folds(spark, folder), excluded_prefix="OWN")


def stars(spark: SparkSession, folder: str) -> DataFrame:
    return S.stars(
        star_families(spark, folder), max_coverage(spark, folder), best_fold(spark, folder)
    )


def stars_from_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Stars when only lists of annotated families are known."""
    families = star_families(spark, folder)
    scores = families.select("id", F.col("rep_length").alias("length"), "plddt")
    lines = table(spark, folder, "lineitem")
    in_models = lines.filter("l_tax = 0.08").select(F.col("l_partkey").alias("id"))
    in_folds = lines.filter("l_discount = 0").select(F.col("l_partkey").alias("id"))
    return S.stars_from_lists(families.select("id", "family_size"), scores, in_models, in_folds)


def apply_stars(spark: SparkSession, folder: str) -> DataFrame:
    """Stars of families with folds stored in a table that lacks the columns."""
    rated = stars(spark, folder).join(
        best_fold(spark, folder).select("family_id"), "family_id", "left_semi"
    )
    return apply_star_columns(star_families(spark, folder).select("id", "family_size"), rated)


def score_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return P.score_profiles(profiles(spark, folder)).select("idx", "score")


def rank_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return P.rank_profiles(profiles(spark, folder), "idx").select("rank", "idx", "name", "score")


def ranked_report(spark: SparkSession, folder: str) -> DataFrame:
    ranked = P.rank_profiles(profiles(spark, folder), "idx", {"eff_nseq": 0.6})
    return P.ranked_report(ranked).select("rank", "idx", "M", "score")


def length_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by length; labelled ones count as annotated."""
    families = table(spark, folder, "documents").select(
        F.col("doc_id").alias("family_id"), F.col("n_chars").alias("hmm_length")
    )
    annotated = table(spark, folder, "labels").select("doc_id")
    return P.length_distribution(families, annotated)


def size_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by the number of their lines; parts in big sizes count as annotated."""
    families = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("family_id")).agg(
        F.count(F.lit(1)).alias("size")
    )
    annotated = table(spark, folder, "part").filter("p_size > 25").select("p_partkey")
    return P.length_distribution(families, annotated, "size", 20, 30, 2, 5, 10)


def structure_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Mean quality per part over its lines."""
    residues = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_quantity").alias("plddt")
    )
    return alignments.structure_quality(residues)


def score_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines rendered from lines of orders and read back; others are noise."""
    message = F.format_string(
        "26/01/01 | INFO | Predicted structure for %d with length %d, pLDDT %.1f, pTM %.3f in 2.3s",
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity"), F.col("l_discount"),
    )
    noise = F.concat(F.lit("Loading model "), F.col("l_orderkey").cast("string"))
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", noise).otherwise(message).alias("value")
    )
    return scores_from_lines(lines)


_STARS = f"""
WITH {FAMILIES_SQL}, {MODEL_SQL}, {FOLDS_SQL},
stars AS (
  SELECT f.id AS family_id,
    CAST((CASE WHEN plddt >= 70 THEN 2 WHEN plddt >= 50 THEN 1 ELSE 0 END)
       + (CASE WHEN family_size >= 100 THEN 1 ELSE 0 END)
       + (CASE WHEN rep_length >= 100 THEN 1 ELSE 0 END) AS INTEGER) AS quality_stars,
    CAST((CASE WHEN model_coverage IS NULL THEN 2 WHEN model_coverage < 0.5 THEN 1 ELSE 0 END)
       + (CASE WHEN aligned_length IS NULL THEN 2
               WHEN rep_length <> 0 AND CAST(aligned_length AS DOUBLE) / rep_length < 0.5 THEN 1
               ELSE 0 END) AS INTEGER) AS novelty_stars
  FROM families f LEFT JOIN coverage c ON c.family_id = f.id LEFT JOIN folds d ON d.family_id = f.id)
"""


def _scored(first_weight: str) -> str:
    return f"""
WITH {PROFILES_SQL},
ends AS (
  SELECT min(eff_nseq) AS e0, max(eff_nseq) AS e1, min(prele) AS p0, max(prele) AS p1,
         min(m) AS m0, max(m) AS m1, min(compkl) AS k0, max(compkl) AS k1 FROM profiles),
scored AS (
  SELECT profiles.*,
         CAST({first_weight} AS DOUBLE) * ((eff_nseq - e0) / (e1 - e0))
         + CAST(0.3 AS DOUBLE) * ((prele - p0) / (p1 - p0))
         + CAST(0.15 AS DOUBLE) * ((m - m0) / (m1 - m0))
         + CAST(-0.1 AS DOUBLE) * ((compkl - k0) / (k1 - k0)) AS score
  FROM profiles, ends),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM scored)
"""


def _bins(source: str, value: str, short: int, medium: int, widths: tuple[int, int, int]) -> str:
    return f"""
WITH source AS ({source}),
grouped AS (
  SELECT annotated, {value} AS v,
         CASE WHEN {value} <= {short} THEN 'short' WHEN {value} <= {medium} THEN 'medium' ELSE 'long' END AS size_group,
         CASE WHEN {value} <= {short} THEN {widths[0]} WHEN {value} <= {medium} THEN {widths[1]} ELSE {widths[2]} END AS w,
         CASE WHEN {value} <= {short} THEN 0 WHEN {value} <= {medium} THEN {short} ELSE {medium} END AS low
  FROM source),
binned AS (SELECT *, CAST(v // w * w AS BIGINT) AS bin_start FROM grouped)
SELECT size_group, bin_start,
       concat(greatest(bin_start + 1, any_value(low) + 1), '-', bin_start + any_value(w)) AS bin_label,
       count(*) FILTER (annotated) AS annotated, count(*) FILTER (NOT annotated) AS unannotated,
       100.0 * count(*) FILTER (annotated) / count(*) AS percent_annotated
FROM binned GROUP BY size_group, bin_start
"""


QUERIES = {
    "max_coverage": max_coverage,
    "best_fold": best_fold,
    "stars": stars,
    "stars_from_lists": stars_from_lists,
    "apply_stars": apply_stars,
    "score_profiles": score_profiles,
    "rank_profiles": rank_profiles,
    "ranked_report": ranked_report,
    "length_bins": length_bins,
    "size_bins": size_bins,
    "structure_quality": structure_quality,
    "score_lines": score_lines,
}

ORACLES = {
    "max_coverage": f"WITH {MODEL_SQL} SELECT * FROM coverage",
    "best_fold": f"WITH {FOLDS_SQL} SELECT * FROM folds",
    "stars": f"{_STARS} SELECT * FROM stars",
    "stars_from_lists": f"""{_STARS}
SELECT family_id, quality_stars,
       CAST((CASE WHEN family_id IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0.08) THEN 0 ELSE 2 END)
          + (CASE WHEN family_id IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0) THEN 0 ELSE 1 END)
         AS INTEGER) AS novelty_stars
FROM stars
""",
    "apply_stars": f"""{_STARS}
SELECT id, family_size, quality_stars AS quality_rank, novelty_stars AS novelty_rank
FROM families LEFT JOIN (SELECT stars.* FROM stars SEMI JOIN folds USING (family_id)) ON id = family_id
""",
    "score_profiles": f"{_scored('0.45')} SELECT idx, score FROM scored",
    "rank_profiles": f"{_scored('0.45')} SELECT rank, idx, name, score FROM ranked",
    "ranked_report": f"""{_scored('0.6')}
SELECT rank, idx, CAST(m AS INTEGER) AS "M", printf('%.4f', score) AS score FROM ranked
""",
    "length_bins": _bins(
        "SELECT n_chars, doc_id IN (SELECT doc_id FROM labels) AS annotated FROM documents",
        "n_chars", 300, 1000, (10, 50, 100),
    ),
    "size_bins": _bins(
        "SELECT count(*) AS n, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS annotated "
        "FROM lineitem GROUP BY l_partkey",
        "n", 20, 30, (2, 5, 10),
    ),
    "structure_quality": """
SELECT l_partkey AS id, CAST(count(*) AS INTEGER) AS length, avg(l_quantity) AS plddt
FROM lineitem GROUP BY l_partkey
""",
    "score_lines": """
SELECT l_orderkey AS id, l_linenumber AS length, l_quantity AS plddt, l_discount AS ptm
FROM lineitem WHERE l_returnflag <> 'N'
""",
}
