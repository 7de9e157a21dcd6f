"""Superfamilies from family similarity, and their novelty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from famloom.functions.ids import sort_key, split_ids
from famloom.operators.graph import cluster_summaries, singleton_ids, symmetric_edges
from famloom.operators.skew import flag_members, group_position
from famloom.schemas import require_columns
from famloom.session import durable

IDS_PER_ROW = 100_000


def filtered_edges(
    report: DataFrame,
    first: str = "Family Id 1",
    second: str = "Family Id 2",
    weight: str = "Jaccard Score",
) -> DataFrame:
    """Edges between canonical families: ids with an underscore are left out."""
    require_columns(report, [first, second, weight], "similarity report")
    trimmed = report.select(
        F.trim(F.col(f"`{first}`")).alias("fam1"),
        F.trim(F.col(f"`{second}`")).alias("fam2"),
        F.col(f"`{weight}`").cast("double").alias("weight"),
    )
    return trimmed.filter(~F.col("fam1").contains("_") & ~F.col("fam2").contains("_"))


@dataclass
class Superfamilies:
    """Clusters (one row each) and their members (one row per family)."""

    clusters: DataFrame
    members: DataFrame
    singletons: DataFrame

    def ordered(self) -> DataFrame:
        """Clusters by size, then representative, then id."""
        return self.clusters.orderBy(
            F.col("family_size").desc(), sort_key(F.col("family_rep_id")), "cluster_id"
        )

    def total_families(self) -> DataFrame:
        """Sum of all cluster sizes."""
        return self.clusters.agg(
            F.coalesce(F.sum("family_size"), F.lit(0)).alias("total_families")
        )

    def report(self, ids_per_row: int = IDS_PER_ROW) -> DataFrame:
        """Clusters with their ids in one ``;``-joined cell, in order.

        Row ``part`` of a cluster lists its families number part * ``ids_per_row`` + 1 and
        following; read by part, the cells are the sorted list.
        """
        placed = group_position(self.members, ["cluster_id"], [sort_key(F.col("family_id"))], "_n")
        ids = F.array_sort(F.collect_list(sort_key(F.col("family_id"))))
        cells = (
            placed.withColumn("part", F.floor((F.col("_n") - 1) / ids_per_row).cast("int"))
            .groupBy("cluster_id", "part")
            .agg(F.array_join(F.transform(ids, lambda k: k["text"]), ";").alias("family_ids"))
        )
        return cells.join(self.clusters, "cluster_id").select(
            "cluster_id", "family_rep_id", "family_size", "part", "family_ids"
        )


def singletons(
    edges: DataFrame, first_id: int, last_id: int, order: str | None = None
) -> DataFrame:
    """Ids of the range on no edge; needs no components."""
    return singleton_ids(symmetric_edges(edges, order), first_id, last_id)


def build_superfamilies(
    edges: DataFrame, first_id: int, last_id: int, order: str | None = None
) -> Superfamilies:
    """Connected components plus a singleton for every id of the range on no edge.

    Clusters and members are stored, since every report reads them.
    """
    symmetric = durable(symmetric_edges(edges, order))
    clusters, members = cluster_summaries(symmetric)
    alone = durable(singleton_ids(symmetric, first_id, last_id))
    named = alone.select(
        F.concat(F.lit("Singleton_"), "family_id").alias("cluster_id"), "family_id"
    )
    singles = named.select(
        "cluster_id",
        F.col("family_id").alias("family_rep_id"),
        F.lit(1).cast("bigint").alias("family_size"),
    )
    return Superfamilies(
        clusters=durable(clusters.unionByName(singles)),
        members=durable(members.unionByName(named)),
        singletons=alone,
    )


def small_size_histogram(clusters: DataFrame) -> DataFrame:
    """Clusters per exact size from 2 to 10."""
    return (
        clusters.filter(F.col("family_size").between(2, 10))
        .groupBy(F.col("family_size").cast("bigint").alias("size"))
        .agg(F.count(F.lit(1)).alias("n_clusters"))
    )


def large_size_histogram(clusters: DataFrame) -> DataFrame:
    """Clusters per ten-wide size range from 11 up."""
    lower = (F.floor((F.col("family_size") - 1) / 10) * 10 + 1).cast("bigint")
    return (
        clusters.filter("family_size >= 11")
        .groupBy(lower.alias("lower"))
        .agg(F.count(F.lit(1)).alias("n_clusters"))
        .select(
            "lower",
            F.concat_ws("-", F.col("lower"), F.col("lower") + 9).alias("size_range"),
            "n_clusters",
        )
    )


def members_of_report(report: DataFrame, cluster: str, ids: str) -> DataFrame:
    """Member rows of a report whose cells hold ``;``-joined ids."""
    require_columns(report, [cluster, ids], "superfamily report")
    return report.select(
        F.col(f"`{cluster}`").alias("cluster_id"),
        F.explode(split_ids(F.col(f"`{ids}`"))).alias("family_id"),
    )


def true_novel_superfamilies(members: DataFrame, novel_ids: DataFrame) -> DataFrame:
    """Clusters all of whose families are novel."""
    flagged = flag_members(members, novel_ids, "family_id", "_novel")
    return (
        flagged.groupBy("cluster_id")
        .agg(F.bool_and("_novel").alias("_all"))
        .filter("_all")
        .select("cluster_id")
    )


def novelty_scores(
    members: DataFrame, novel_filtered: DataFrame, true_novel: DataFrame
) -> DataFrame:
    """Share of selected families per true-novel cluster, best first; 0 is left out.

    Ids that are not numbers count in the denominator but never match.
    """
    wanted = members.join(true_novel.select("cluster_id"), "cluster_id", "left_semi")
    # Sizes and hits both read the novel clusters' members, which are found once.
    numbered = durable(wanted.select("cluster_id", F.col("family_id").try_cast("bigint").alias("_id")))
    ids = novel_filtered.select(F.col(novel_filtered.columns[0]).cast("bigint").alias("_id")).distinct()
    # Sizes come from all rows, hits from the matching ones, so ids without a number are not joined.
    sizes = numbered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("family_size"))
    hits = numbered.join(ids, "_id", "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_hits"))
    scored = sizes.join(hits, "cluster_id")
    score = F.round(F.lit(100.0) * F.col("_hits") / F.col("family_size"), 6)
    return (
        scored.filter("_hits > 0")
        .select("cluster_id", "family_size", score.alias("novelty_score"))
        .orderBy(F.col("novelty_score").desc(), F.col("family_size").desc(), "cluster_id")
    )
