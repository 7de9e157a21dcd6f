"""Where families occur: leaves of per-family biome trees, rolled up by full path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.functions.trees import colour, leaf_records, top_level, tree_records


def family_leaves(families: DataFrame, key: str = "id", blob: str = "biome_blob") -> DataFrame:
    """One row per leaf record: family_id, path, label, count, top_level, place in its tree.

    Families whose tree is missing or unreadable are left out.
    """
    leaves = leaf_records(tree_records(F.col(blob)))
    return (
        families.filter(F.col(blob).isNotNull())
        .select(F.col(key).alias("family_id"), F.posexplode(leaves).alias("place", "leaf"))
        .select(
            "family_id",
            "place",
            F.col("leaf.ids").alias("path"),
            F.col("leaf.labels").alias("label"),
            F.col("leaf.counts").alias("count"),
            top_level(F.col("leaf.ids")).alias("top_level"),
        )
    )


def leaves_of_nodes(nodes: DataFrame, key: str = "family_id") -> DataFrame:
    """Leaves when the tree nodes are rows (family, path, parent, ...): never a parent.

    Each node also gives a mark on its parent's place; where marks stand first, the place is
    no leaf.  The nodes are read once, and nodes dealt by family are not dealt again.
    """
    node = F.struct(F.col("path").alias("_path"), F.lit(0).alias("_mark"))
    mark = F.struct(F.col("parent").alias("_path"), F.lit(1).alias("_mark"))
    inner = F.coalesce("parent", F.lit("")) != ""
    places = nodes.select("*", F.inline(F.when(inner, F.array(node, mark)).otherwise(F.array(node))))
    marks_first = Window.partitionBy(key, "_path").orderBy(F.col("_mark").desc())
    # A place without a path or family is on nobody's parent's place.
    unknown = F.col(key).isNull() | F.col("_path").isNull()
    return (
        places.withColumn("_first", F.first("_mark").over(marks_first))
        .filter((F.col("_mark") == 0) & ((F.col("_first") == 0) | unknown))
        .select(key, "path", *[c for c in nodes.columns if c not in (key, "path")])
    )


def leaf_distribution(leaves: DataFrame) -> DataFrame:
    """Distinct families per leaf path; the label is the last one written."""
    last_label = F.max_by("label", F.struct("family_id", "place"))
    per_path = leaves.groupBy("path").agg(
        F.count_distinct("family_id").alias("n_families"), last_label.alias("label")
    )
    category = top_level(F.col("path"))
    return per_path.select(
        "path", "label", "n_families", category.alias("top_level"), colour(category).alias("colour")
    )


def top_leaves(distribution: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` leaf paths with most families."""
    return distribution.orderBy(F.col("n_families").desc(), "path").limit(n)


def family_breadth(leaves: DataFrame) -> DataFrame:
    """Leaf rows and summed counts per family."""
    return leaves.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("n_leaves"), F.sum("count").alias("total_count")
    )


def exclusive_families(leaves: DataFrame) -> DataFrame:
    """Families with a single leaf, and that leaf."""
    return (
        leaves.groupBy("family_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("path").alias("path"))
        .filter("_n = 1")
        .drop("_n")
    )


def exclusive_by_path(leaves: DataFrame) -> DataFrame:
    """Single-leaf families per path, most first."""
    return (
        exclusive_families(leaves)
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n_families"))
        .orderBy(F.col("n_families").desc(), "path")
    )


def exclusive_leaves(leaves: DataFrame) -> DataFrame:
    """Leaf paths of one family only, and that family."""
    return (
        leaves.groupBy("path")
        .agg(F.min("family_id").alias("family_id"), F.max("family_id").alias("_last"))
        .filter(F.col("family_id") == F.col("_last"))
        .drop("_last")
    )


def duplicate_label_paths(distribution: DataFrame) -> DataFrame:
    """(label, path) rows of labels standing on more than one path."""
    repeated = (
        distribution.filter("label <> ''")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n_paths"))
        .filter("n_paths > 1")
    )
    return distribution.select("label", "path").join(repeated, "label")


def duplicate_labels(leaves: DataFrame, distribution: DataFrame) -> DataFrame:
    """Per repeated label: its paths and distinct families."""
    paths = duplicate_label_paths(distribution)
    found = leaves.select("family_id", "path").join(paths, "path")
    return found.groupBy("label").agg(
        F.max("n_paths").alias("n_paths"), F.count_distinct("family_id").alias("n_families")
    )


def top_duplicate_labels(labels: DataFrame, n: int = 30) -> DataFrame:
    """Labels on most paths."""
    return labels.orderBy(F.col("n_paths").desc(), "label").limit(n)


def duplicate_totals(labels: DataFrame) -> DataFrame:
    """Repeated labels and the leaf paths they stand on."""
    return labels.agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.coalesce(F.sum("n_paths"), F.lit(0)).alias("n_paths"),
    )


def _with_share(chosen: DataFrame, leaves: DataFrame, distribution: DataFrame) -> DataFrame:
    available = distribution.agg(F.count(F.lit(1))).scalar()
    # At most the few chosen families reach this grouping.
    tops = (
        leaves.join(F.broadcast(chosen.select("family_id")), "family_id", "left_semi")
        .select("family_id", "top_level")
        .distinct()
        .groupBy("family_id")
        .agg(F.array_join(F.sort_array(F.collect_list("top_level")), ", ").alias("top_levels"))
    )
    return chosen.join(tops, "family_id").select(
        "family_id",
        "n_leaves",
        available.alias("available_paths"),
        (F.lit(100.0) * F.col("n_leaves") / available).alias("percent_available"),
        "top_levels",
    )


def _chosen(leaves: DataFrame, order: list[Column], n: int) -> DataFrame:
    return family_breadth(leaves).select("family_id", "n_leaves").orderBy(*order).limit(n)


def broadest_families(leaves: DataFrame, distribution: DataFrame, n: int = 25) -> DataFrame:
    """Families on most leaf paths, smaller id first on ties."""
    order = [F.col("n_leaves").desc(), F.col("family_id")]
    return _with_share(_chosen(leaves, order, n), leaves, distribution)


def narrowest_families(leaves: DataFrame, distribution: DataFrame, n: int = 25) -> DataFrame:
    """Families on fewest leaf paths, ids compared as text on ties."""
    order = [F.col("n_leaves"), F.col("family_id").cast("string")]
    return _with_share(_chosen(leaves, order, n), leaves, distribution)


def breadth_statistics(leaves: DataFrame) -> DataFrame:
    """Median, mean, largest and counts above 5 and 10 of leaves per family.

    Families are first counted per number of leaves, so the median works on a
    small frequency table.
    """
    frequency = family_breadth(leaves).groupBy("n_leaves").agg(F.count(F.lit(1)).alias("_n"))
    n, leaves_ = F.col("_n"), F.col("n_leaves")
    return frequency.agg(
        F.sum(n).alias("n_families"),
        F.percentile("n_leaves", 0.5, F.col("_n")).alias("median_leaves"),
        (F.sum(leaves_ * n) / F.sum(n)).alias("mean_leaves"),
        F.max(leaves_).alias("max_leaves"),
        F.sum(F.when(leaves_ > 5, n).otherwise(0)).alias("over_5"),
        F.sum(F.when(leaves_ > 10, n).otherwise(0)).alias("over_10"),
    )


def exclusive_share(leaves: DataFrame) -> DataFrame:
    """How many of all families have a single leaf, in percent."""
    breadth = family_breadth(leaves)
    total, single = F.count(F.lit(1)), F.count_if(F.col("n_leaves") == 1)
    return breadth.agg(
        total.alias("n_families"),
        single.alias("n_exclusive"),
        F.coalesce(F.try_divide(F.lit(100.0) * single, total), F.lit(0.0)).alias("percent_exclusive"),
    )
