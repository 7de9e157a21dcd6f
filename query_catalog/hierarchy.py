"""Biome tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.plans import biomes as B
from famloom.session import durable
from query_catalog.adapters import LEAVES_SQL, biome_leaves, table, tree_nodes


def tree_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves recovered from tree nodes kept as rows."""
    nodes = tree_nodes(biome_leaves(spark, folder))
    return B.leaves_of_nodes(nodes)


def blob_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves read back from a CSV tree per family.

    A tree holds at most one node per place and month, however many lines it has.
    """
    nodes = tree_nodes(biome_leaves(spark, folder))
    line = F.concat_ws(",", "path", "label", "parent", "count")
    blobs = nodes.groupBy(F.col("family_id").alias("id")).agg(
        F.concat(
            F.lit("ids,labels,parents,counts\n"),
            F.array_join(F.sort_array(F.collect_list(line)), "\n"),
        ).alias("biome_blob")
    )
    return B.family_leaves(blobs).drop("place")


def blob_leaves_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as trees whose leaf has the whole text as its quoted label.

    Labels hold commas, line breaks and doubled quotes; counts of other languages are no numbers.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    count = F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise("many")
    leaf = F.concat_ws(
        ",",
        F.concat(F.lit("root:"), "source"),
        quoted(F.concat(F.lit('say "so", '), "text")),
        F.lit("root"),
        count,
    )
    blob = F.concat(F.lit("ids,labels,parents,counts\nroot,root,,1\n"), leaf, F.lit("\n"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), blob.alias("biome_blob"))
    return B.family_leaves(docs).drop("place")


def leaf_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return B.leaf_distribution(biome_leaves(spark, folder))


def top_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return B.top_leaves(leaf_distribution(spark, folder))


def family_breadth(spark: SparkSession, folder: str) -> DataFrame:
    return B.family_breadth(biome_leaves(spark, folder))


def exclusive_families(spark: SparkSession, folder: str) -> DataFrame:
    return B.exclusive_families(biome_leaves(spark, folder))


def exclusive_by_path(spark: SparkSession, folder: str) -> DataFrame:
    return B.exclusive_by_path(biome_leaves(spark, folder))


def exclusive_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return B.exclusive_leaves(biome_leaves(spark, folder))


def exclusive_share(spark: SparkSession, folder: str) -> DataFrame:
    return B.exclusive_share(biome_leaves(spark, folder))


def duplicate_label_paths(spark: SparkSession, folder: str) -> DataFrame:
    return B.duplicate_label_paths(leaf_distribution(spark, folder))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    leaves = durable(biome_leaves(spark, folder))
    return B.duplicate_labels(leaves, B.leaf_distribution(leaves))


def duplicate_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _labels(spark, folder)


def top_duplicate_labels(spark: SparkSession, folder: str) -> DataFrame:
    return B.top_duplicate_labels(_labels(spark, folder))


def duplicate_totals(spark: SparkSession, folder: str) -> DataFrame:
    return B.duplicate_totals(_labels(spark, folder))


def breadth_top(spark: SparkSession, folder: str) -> DataFrame:
    leaves = durable(biome_leaves(spark, folder))
    return B.broadest_families(leaves, B.leaf_distribution(leaves))


def narrow_top(spark: SparkSession, folder: str) -> DataFrame:
    leaves = durable(biome_leaves(spark, folder))
    return B.narrowest_families(leaves, B.leaf_distribution(leaves))


def leaf_count_stats(spark: SparkSession, folder: str) -> DataFrame:
    return B.breadth_statistics(biome_leaves(spark, folder))


_FAMILIES = """
fams AS (SELECT family_id, count(*) AS n_leaves, CAST(sum(n) AS BIGINT) AS total_count
         FROM leaves GROUP BY family_id),
dups AS (SELECT label, count(DISTINCT path) AS n_paths, count(DISTINCT family_id) AS n_families
         FROM leaves GROUP BY label HAVING count(DISTINCT path) > 1)
"""
_WITH = f"WITH {LEAVES_SQL}, {_FAMILIES}"

# In these tables the top level is a region, which has no colour of its own.
_DISTRIBUTION = """
SELECT path, min(label) AS label, count(DISTINCT family_id) AS n_families,
       min(top_level) AS top_level, '#AAAAAA' AS colour
FROM leaves GROUP BY path
"""


def _extreme(order: str) -> str:
    return f"""{_WITH},
chosen AS (SELECT family_id, n_leaves FROM fams ORDER BY {order} LIMIT 25),
available AS (SELECT count(DISTINCT path) AS n FROM leaves)
SELECT c.family_id, any_value(n_leaves) AS n_leaves, any_value(a.n) AS available_paths,
       100.0 * any_value(n_leaves) / any_value(a.n) AS percent_available,
       string_agg(DISTINCT top_level, ', ' ORDER BY top_level) AS top_levels
FROM chosen c JOIN leaves USING (family_id), available a GROUP BY c.family_id
"""


_LEAF_ROWS = """
SELECT family_id, path, parent, label, CAST(n AS INTEGER) AS count FROM leaves
"""

QUERIES = {
    "tree_leaves": tree_leaves,
    "blob_leaves": blob_leaves,
    "blob_leaves_quoted": blob_leaves_quoted,
    "leaf_distribution": leaf_distribution,
    "top_leaves": top_leaves,
    "family_breadth": family_breadth,
    "exclusive_families": exclusive_families,
    "exclusive_by_path": exclusive_by_path,
    "exclusive_leaves": exclusive_leaves,
    "exclusive_share": exclusive_share,
    "duplicate_label_paths": duplicate_label_paths,
    "duplicate_labels": duplicate_labels,
    "top_duplicate_labels": top_duplicate_labels,
    "duplicate_totals": duplicate_totals,
    "breadth_top": breadth_top,
    "narrow_top": narrow_top,
    "leaf_count_stats": leaf_count_stats,
}

ORACLES = {
    "tree_leaves": f"{_WITH} {_LEAF_ROWS}",
    "blob_leaves": f"""{_WITH}
SELECT family_id, path, label, CAST(n AS INTEGER) AS count, top_level FROM leaves
""",
    "blob_leaves_quoted": """
SELECT doc_id AS family_id, concat('root:', source) AS path, concat('say "so", ', text) AS label,
       CAST(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END AS INTEGER) AS count, source AS top_level
FROM documents
""",
    "leaf_distribution": f"{_WITH} {_DISTRIBUTION}",
    "top_leaves": f"{_WITH} {_DISTRIBUTION} ORDER BY n_families DESC, path LIMIT 30",
    "family_breadth": f"{_WITH} SELECT * FROM fams",
    "exclusive_families": f"""{_WITH}
SELECT family_id, path FROM leaves JOIN fams USING (family_id) WHERE n_leaves = 1
""",
    "exclusive_by_path": f"""{_WITH}
SELECT path, count(*) AS n_families FROM leaves JOIN fams USING (family_id) WHERE n_leaves = 1 GROUP BY path
""",
    "exclusive_leaves": f"""{_WITH}
SELECT path, any_value(family_id) AS family_id FROM leaves GROUP BY path HAVING count(DISTINCT family_id) = 1
""",
    "exclusive_share": f"""{_WITH}
SELECT count(*) AS n_families, count(*) FILTER (n_leaves = 1) AS n_exclusive,
       100.0 * count(*) FILTER (n_leaves = 1) / count(*) AS percent_exclusive FROM fams
""",
    "duplicate_label_paths": f"""{_WITH}
SELECT DISTINCT label, path, n_paths FROM leaves JOIN dups USING (label)
""",
    "duplicate_labels": f"{_WITH} SELECT * FROM dups",
    "top_duplicate_labels": f"{_WITH} SELECT * FROM dups ORDER BY n_paths DESC, label LIMIT 30",
    "duplicate_totals": f"""{_WITH}
SELECT count(*) AS n_labels, CAST(sum(n_paths) AS BIGINT) AS n_paths FROM dups
""",
    "breadth_top": _extreme("n_leaves DESC, family_id"),
    "narrow_top": _extreme("n_leaves, family_id"),
    "leaf_count_stats": f"""{_WITH}
SELECT count(*) AS n_families, median(n_leaves) AS median_leaves,
       CAST(sum(n_leaves) AS DOUBLE) / count(*) AS mean_leaves, max(n_leaves) AS max_leaves,
       count(*) FILTER (n_leaves > 5) AS over_5, count(*) FILTER (n_leaves > 10) AS over_10
FROM fams
""",
}
