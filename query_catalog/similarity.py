"""Set similarity, redundancy, superfamily and novelty queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.functions.ids import from_sortable_text
from famloom.operators import graph, redundancy, similarity
from famloom.plans import superfamilies as S
from famloom.session import durable
from query_catalog.adapters import PAIRS_SQL, family_meta, members, table


def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.similar_sets(members(spark, folder), 0.5)


def residue_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Residue similarity of every pair that shares enough proteins."""
    pairs = jaccard_pairs(spark, folder).select(
        F.col("fam_a").alias("fam1"), F.col("fam_b").alias("fam2")
    )
    return similarity.residue_similarity(
        durable(pairs), members(spark, folder), partial(family_meta, spark, folder)
    )


def family_similarities(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.family_similarities(members(spark, folder), partial(family_meta, spark, folder), 0.5)


def _similarities(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by shared proteins as the similarity list, in (fam1, fam2) order."""
    return durable(
        jaccard_pairs(spark, folder).select(
            F.col("fam_a").alias("fam1"),
            F.col("fam_b").alias("fam2"),
            F.col("jaccard").alias("similarity"),
            F.struct(F.col("fam_a").alias("a"), F.col("fam_b").alias("b")).alias("row_no"),
        )
    )


def _eliminated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(dropped families, kept pairs); only families in a redundant pair are sized."""
    similarities = _similarities(spark, folder)
    listed = similarity.families_of(similarities.filter(F.col("similarity") >= 0.95))
    return redundancy.eliminate_redundant(similarities, family_meta(spark, folder, listed), 0.95)


def redundant_families(spark: SparkSession, folder: str) -> DataFrame:
    dropped, _ = _eliminated(spark, folder)
    return dropped.select("family_id")


def non_redundant_similarities(spark: SparkSession, folder: str) -> DataFrame:
    _, kept = _eliminated(spark, folder)
    return kept.drop("row_no")


def similarity_split(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs on each side of the redundancy threshold."""
    redundant = F.col("jaccard") >= 0.95
    return (
        jaccard_pairs(spark, folder)
        .groupBy(F.when(redundant, "redundant").otherwise("similar").alias("kind"))
        .agg(F.count(F.lit(1)).alias("n_pairs"))
    )


def _report(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity report with localised ids (an underscore) for every urgent order."""
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("fam_a"), F.lit("_loc").alias("_suffix")
    )
    return (
        jaccard_pairs(spark, folder)
        .join(urgent, "fam_a", "left")
        .select(
            F.concat(F.lit(" "), F.col("fam_a"), F.coalesce("_suffix", F.lit(""))).alias(
                "Family Id 1"
            ),
            F.concat(F.col("fam_b").cast("string"), F.lit(" ")).alias("Family Id 2"),
            F.col("jaccard").cast("string").alias("Jaccard Score"),
        )
    )


def filtered_edges(spark: SparkSession, folder: str) -> DataFrame:
    return S.filtered_edges(_report(spark, folder))


def _edges(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    edges = jaccard_pairs(spark, folder).select(
        F.col("fam_a").alias("fam1"), F.col("fam_b").alias("fam2"), F.col("jaccard").alias("weight")
    )
    ends = table(spark, folder, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return edges, ends[0], ends[1]


def _superfamilies(spark: SparkSession, folder: str) -> S.Superfamilies:
    return S.build_superfamilies(*_edges(spark, folder))


def superfamily_report(spark: SparkSession, folder: str) -> DataFrame:
    return _superfamilies(spark, folder).ordered()


def superfamily_members(spark: SparkSession, folder: str) -> DataFrame:
    return _superfamilies(spark, folder).members


def components_extended(spark: SparkSession, folder: str) -> DataFrame:
    """Components of most edges, extended by the rest: each family and the smallest of its component."""
    edges, _, _ = _edges(spark, folder)
    late = F.expr("(fam1 + fam2) % 10 = 0")
    edges = durable(edges)
    first, rest = (durable(graph.symmetric_edges(edges.filter(c))) for c in (~late, late))
    labels = graph.extend_components(durable(graph.connected_components(first)), rest)
    return labels.select(
        from_sortable_text(F.col("node")).alias("family_id"), from_sortable_text(F.col("component")).alias("component")
    )


def superfamily_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _superfamilies(spark, folder).report()


def superfamily_cells_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of at most two families."""
    return _superfamilies(spark, folder).report(ids_per_row=2)


def singletons(spark: SparkSession, folder: str) -> DataFrame:
    return S.singletons(*_edges(spark, folder))


def size_hist_small(spark: SparkSession, folder: str) -> DataFrame:
    return S.small_size_histogram(_superfamilies(spark, folder).clusters)


def size_hist_large(spark: SparkSession, folder: str) -> DataFrame:
    return S.large_size_histogram(_superfamilies(spark, folder).clusters)


def total_families(spark: SparkSession, folder: str) -> DataFrame:
    return _superfamilies(spark, folder).total_families()


def _novel_ids(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .filter("o_orderstatus <> 'P'")
        .select(F.col("o_orderkey").cast("string").alias("id"))
    )


def true_novel(spark: SparkSession, folder: str) -> DataFrame:
    found = _superfamilies(spark, folder)
    return S.true_novel_superfamilies(found.members, _novel_ids(spark, folder))


def novelty_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = _superfamilies(spark, folder)
    selected = table(spark, folder, "orders").filter("o_totalprice > 100000").select("o_orderkey")
    novel = S.true_novel_superfamilies(found.members, _novel_ids(spark, folder))
    return S.novelty_scores(found.members, selected, novel)


_COMPONENTS = f"""
WITH RECURSIVE {PAIRS_SQL},
links AS (SELECT fam_a AS a, fam_b AS b, jaccard AS w FROM pairs
          UNION ALL SELECT fam_b, fam_a, jaccard FROM pairs),
reach(a, b) AS (
  SELECT a, a FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
component AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
degree AS (SELECT a AS node, round(sum(w), 12) AS d FROM links GROUP BY a),
ranked AS (
  SELECT root, c.node, row_number() OVER (PARTITION BY root ORDER BY d DESC, c.node) AS r,
         count(*) OVER (PARTITION BY root) AS n
  FROM component c JOIN degree USING (node)),
graph AS (
  SELECT root, node AS rep, n, concat('SF_', row_number() OVER (ORDER BY root)) AS cluster_id
  FROM ranked WHERE r = 1),
alone AS (
  SELECT k FROM range((SELECT min(o_orderkey) FROM orders), (SELECT max(o_orderkey) FROM orders) + 1) t(k)
  WHERE k NOT IN (SELECT node FROM component)),
clusters AS (
  SELECT cluster_id, CAST(rep AS VARCHAR) AS family_rep_id, n AS family_size FROM graph
  UNION ALL SELECT concat('Singleton_', k), CAST(k AS VARCHAR), 1 FROM alone),
membership AS (
  SELECT cluster_id, CAST(node AS VARCHAR) AS family_id FROM graph JOIN component USING (root)
  UNION ALL SELECT concat('Singleton_', k), CAST(k AS VARCHAR) FROM alone),
novel AS (
  SELECT cluster_id FROM membership
  LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'P') ON id = family_id
  GROUP BY cluster_id HAVING count(*) = count(id))
"""

_SEQUENTIAL = f"""
WITH RECURSIVE {PAIRS_SQL},
weights AS (SELECT l_orderkey AS f, count(*) AS n FROM lineitem GROUP BY l_orderkey),
todo AS (
  SELECT row_number() OVER (ORDER BY fam_a DESC, fam_b DESC) AS i, fam_a, fam_b,
         CASE WHEN wa.n < wb.n THEN fam_a WHEN wa.n > wb.n THEN fam_b ELSE greatest(fam_a, fam_b) END AS loser
  FROM pairs JOIN weights wa ON wa.f = fam_a JOIN weights wb ON wb.f = fam_b WHERE jaccard >= 0.95),
steps(i, gone) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT t.i, CASE WHEN list_contains(gone, fam_a) OR list_contains(gone, fam_b) THEN gone
                   ELSE list_append(gone, loser) END
  FROM steps JOIN todo t ON t.i = steps.i + 1),
dropped AS (SELECT unnest(gone) AS family_id FROM steps WHERE i = (SELECT max(i) FROM steps))
"""

_RESIDUES = f"""
WITH {PAIRS_SQL},
meta AS (SELECT l_orderkey AS id, min(l_partkey) AS rep FROM lineitem GROUP BY l_orderkey),
chosen AS (
  SELECT fam_a, fam_b,
         CASE WHEN EXISTS (SELECT 1 FROM sets WHERE f = fam_b AND p = ma.rep) THEN ma.rep
              WHEN EXISTS (SELECT 1 FROM sets WHERE f = fam_a AND p = mb.rep) THEN mb.rep END AS rep
  FROM pairs JOIN meta ma ON ma.id = fam_a JOIN meta mb ON mb.id = fam_b),
spans AS (
  SELECT l_orderkey AS f, l_partkey AS p,
         CASE WHEN l_discount = 0 THEN 1 ELSE CAST(l_quantity AS INTEGER) END AS s,
         CASE WHEN l_discount = 0 THEN 60 ELSE CAST(l_quantity AS INTEGER) + l_linenumber * 3 END AS e
  FROM lineitem),
cells AS (
  SELECT fam_a, fam_b, 1 AS side, unnest(range(s, e + 1)) AS pos FROM chosen JOIN spans ON f = fam_a AND p = rep
  UNION SELECT fam_a, fam_b, 2, unnest(range(s, e + 1)) FROM chosen JOIN spans ON f = fam_b AND p = rep),
scored AS (
  SELECT fam_a, fam_b, CAST(count(*) FILTER (n = 2) AS DOUBLE) / count(*) AS similarity
  FROM (SELECT fam_a, fam_b, pos, count(*) AS n FROM cells GROUP BY ALL) GROUP BY fam_a, fam_b),
residues AS (
  SELECT fam_a AS fam1, fam_b AS fam2, coalesce(similarity, 0.0) AS similarity
  FROM chosen LEFT JOIN scored USING (fam_a, fam_b))
"""

QUERIES = {
    "jaccard_pairs": jaccard_pairs,
    "residue_jaccard": residue_jaccard,
    "family_similarities": family_similarities,
    "similarity_split": similarity_split,
    "redundant_families": redundant_families,
    "non_redundant_similarities": non_redundant_similarities,
    "filtered_edges": filtered_edges,
    "superfamily_report": superfamily_report,
    "superfamily_members": superfamily_members,
    "components_extended": components_extended,
    "superfamily_cells": superfamily_cells,
    "superfamily_cells_parts": superfamily_cells_parts,
    "singletons": singletons,
    "size_hist_small": size_hist_small,
    "size_hist_large": size_hist_large,
    "total_families": total_families,
    "true_novel": true_novel,
    "novelty_scores": novelty_scores,
}

ORACLES = {
    "jaccard_pairs": f"WITH {PAIRS_SQL} SELECT * FROM pairs",
    "residue_jaccard": f"{_RESIDUES} SELECT * FROM residues",
    "family_similarities": f"{_RESIDUES} SELECT * FROM residues WHERE similarity >= 0.5",
    "similarity_split": f"""
WITH {PAIRS_SQL}
SELECT CASE WHEN jaccard >= 0.95 THEN 'redundant' ELSE 'similar' END AS kind, count(*) AS n_pairs
FROM pairs GROUP BY 1
""",
    "redundant_families": f"{_SEQUENTIAL} SELECT family_id FROM dropped",
    "non_redundant_similarities": f"""{_SEQUENTIAL}
SELECT fam_a AS fam1, fam_b AS fam2, jaccard AS similarity FROM pairs
WHERE jaccard < 0.95 AND fam_a NOT IN (SELECT family_id FROM dropped)
  AND fam_b NOT IN (SELECT family_id FROM dropped)
""",
    "filtered_edges": f"""
WITH {PAIRS_SQL}
SELECT CAST(fam_a AS VARCHAR) AS fam1, CAST(fam_b AS VARCHAR) AS fam2, jaccard AS weight
FROM pairs WHERE fam_a NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""",
    "superfamily_report": f"{_COMPONENTS} SELECT * FROM clusters",
    "superfamily_members": f"{_COMPONENTS} SELECT * FROM membership",
    "components_extended": f"""{_COMPONENTS}
SELECT family_id, CAST(min(CAST(family_id AS BIGINT)) OVER (PARTITION BY cluster_id) AS VARCHAR) AS component
FROM membership WHERE cluster_id LIKE 'SF_%'
""",
    "superfamily_cells": f"""{_COMPONENTS}
SELECT c.cluster_id, c.family_rep_id, c.family_size, 0 AS part,
       string_agg(m.family_id, ';' ORDER BY CAST(m.family_id AS BIGINT)) AS family_ids
FROM clusters c JOIN membership m USING (cluster_id) GROUP BY ALL
""",
    "superfamily_cells_parts": f"""{_COMPONENTS},
placed AS (
  SELECT cluster_id, family_id, CAST((row_number() OVER (
    PARTITION BY cluster_id ORDER BY CAST(family_id AS BIGINT)) - 1) // 2 AS INTEGER) AS part
  FROM membership)
SELECT cluster_id, c.family_rep_id, c.family_size, part,
       string_agg(family_id, ';' ORDER BY CAST(family_id AS BIGINT)) AS family_ids
FROM placed JOIN clusters c USING (cluster_id) GROUP BY ALL
""",
    "singletons": f"{_COMPONENTS} SELECT CAST(k AS VARCHAR) AS family_id FROM alone",
    "size_hist_small": f"""{_COMPONENTS}
SELECT family_size AS size, count(*) AS n_clusters FROM clusters
WHERE family_size BETWEEN 2 AND 10 GROUP BY family_size
""",
    "size_hist_large": f"""{_COMPONENTS}
SELECT lower, concat(lower, '-', lower + 9) AS size_range, count(*) AS n_clusters
FROM (SELECT (family_size - 1) // 10 * 10 + 1 AS lower FROM clusters WHERE family_size >= 11) GROUP BY lower
""",
    "total_families": f"""{_COMPONENTS}
SELECT CAST(sum(family_size) AS BIGINT) AS total_families FROM clusters
""",
    "true_novel": f"{_COMPONENTS} SELECT cluster_id FROM novel",
    "novelty_scores": f"""{_COMPONENTS}
SELECT cluster_id, count(*) AS family_size, round(100.0 * count(o_orderkey) / count(*), 6) AS novelty_score
FROM membership JOIN novel USING (cluster_id)
LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) ON CAST(family_id AS BIGINT) = o_orderkey
GROUP BY cluster_id HAVING count(o_orderkey) > 0
""",
}
