"""Removing, renaming, selecting and updating rows by id across tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from famloom.functions.ids import base_id, file_stem, with_id_basename
from famloom.operators.skew import flag_members, lookup
from famloom.schemas import require_columns
from famloom.session import durable


def latest_rows(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the last by ``order``; without an order a repeated key fails the job."""
    rest = [c for c in df.columns if c != key]
    if order is not None:
        row = F.max_by(F.struct(*rest), F.col(order))
    else:
        many = F.concat(F.lit(f"{key} occurs more than once: "), F.first(key).cast("string"))
        row = F.when(F.count(F.lit(1)) > 1, F.raise_error(many)).otherwise(F.first(F.struct(*rest)))
    return df.groupBy(key).agg(row.alias("_last")).select(key, "_last.*")


def remove_ids(df: DataFrame, ids: DataFrame, column: str | int) -> DataFrame:
    """Rows whose id is not listed; rows without an id stay.

    ``column`` is a name, or a 0-based position for tables without names.
    """
    name = df.columns[column] if isinstance(column, int) else column
    require_columns(df, [name])
    kind = dict(df.dtypes)[name]
    gone = ids.select(F.col(ids.columns[0]).cast(kind).alias(name))
    return df.join(gone, name, "left_anti").select(*df.columns)


def keep_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is listed."""
    kept = ids.select(F.col(ids.columns[0]).alias(column))
    return df.join(kept, column, "left_semi").select(*df.columns)


def map_ids(
    df: DataFrame, mapping: DataFrame, column: str | int, order: str | None = None
) -> DataFrame:
    """Replace ids by ``new_id`` where ``old_id`` matches; others pass through.

    ``order`` picks the last of repeated mapping rows; without it they fail the job.
    """
    name = df.columns[column] if isinstance(column, int) else column
    require_columns(df, [name])
    kind = dict(df.dtypes)[name]
    unique = latest_rows(mapping, "old_id", order).select(
        F.col("old_id").cast(kind).alias(name), F.col("new_id").cast(kind).alias("_new_id")
    )
    joined = lookup(df, unique, [name])
    return joined.withColumn(name, F.coalesce("_new_id", name)).select(*df.columns)


def map_edge_ids(
    edges: DataFrame, mapping: DataFrame, ends: Sequence[str] = ("fam1", "fam2"),
    order: str | None = None,
) -> DataFrame:
    """Translate both ends of every edge; the edges are read once."""
    kind = dict(edges.dtypes)
    latest = durable(latest_rows(mapping, "old_id", order).select("old_id", "new_id"))
    for end in ends:
        require_columns(edges, [end])
        new = latest.select(
            F.col("old_id").cast(kind[end]).alias(end), F.col("new_id").cast(kind[end]).alias("_new_id")
        )
        edges = edges.join(new, end, "left").withColumn(end, F.coalesce("_new_id", end)).select(*edges.columns)
    return edges


def rename_files(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rewrite file-name columns to ``<id>.<extension>``."""
    return df.withColumns({c: with_id_basename(F.col(c), F.col(key)) for c in columns})


def subset_tables(
    tables: Mapping[str, DataFrame], ids: DataFrame, keys: Mapping[str, str]
) -> dict[str, DataFrame]:
    """The same selection of ids applied to several tables, each by its own key column."""
    return {name: keep_ids(df, ids, keys[name]) for name, df in tables.items()}


def uncovered_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters of two or more rows none of whose members is a family member.

    Singletons are judged before id suffixes are cut, and sizes count rows.  A row's
    membership and its cluster's size are settled in one grouping.
    """
    rows = clusters.select("cluster_rep", base_id(F.col("sequence_id")).alias("_base"))
    # Equal rows are folded first, so a repeated id costs one lookup per cluster.
    folded = rows.groupBy("cluster_rep", "_base").agg(F.count(F.lit(1)).alias("_n"))
    flagged = flag_members(folded, members.select("protein"), "_base", "_covered")
    return (
        flagged.groupBy("cluster_rep")
        .agg(F.sum("_n").alias("cluster_size"), F.bool_or("_covered").alias("_covered"))
        .filter((F.col("cluster_size") > 1) & ~F.col("_covered"))
        .select(F.col("cluster_rep").alias("rep_name"), "cluster_size")
        .orderBy(F.col("cluster_size").desc(), "rep_name")
    )


def non_singletons(clusters: DataFrame) -> DataFrame:
    """Cluster rows of clusters with two or more rows."""
    big = (
        clusters.groupBy("cluster_rep")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("cluster_rep")
    )
    flagged = lookup(clusters, big, ["cluster_rep"], "inner")
    return flagged.select(*clusters.columns)


def reconcile_ids(table_ids: DataFrame, file_ids: DataFrame, key: str) -> DataFrame:
    """Ids without a file (``missing``) and files without a row (``extra``)."""
    left, right = table_ids.select(key).distinct(), file_ids.select(key).distinct()
    missing = left.join(right, key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = right.join(left, key, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def file_plan(
    files: DataFrame, removed: DataFrame | None = None, mapping: DataFrame | None = None,
    selected: DataFrame | None = None, order: str | None = None,
) -> DataFrame:
    """What to do with each listed file: ``drop``, ``rename`` or ``keep``, and its new name.

    File stems are compared as text with ``removed`` ids and ``old_id`` of the
    mapping; ``selected`` limits the plan to those stems, and ``order`` picks the
    last of repeated mapping rows.
    """
    plan = files
    if "stem" not in plan.columns:
        plan = plan.withColumn("stem", file_stem(F.col("file_name")))
    if selected is not None:
        plan = keep_ids(plan, selected.select(F.col(selected.columns[0]).cast("string")), "stem")
    if removed is not None:
        plan = flag_members(
            plan, removed.select(F.col(removed.columns[0]).cast("string")), "stem", "_drop"
        )
    else:
        plan = plan.withColumn("_drop", F.lit(False))
    new_name: Column = F.lit(None).cast("string")
    if mapping is not None:
        names = latest_rows(mapping, "old_id", order).select(
            F.col("old_id").cast("string").alias("stem"),
            F.col("new_id").cast("string").alias("_new_stem"),
        )
        plan = lookup(plan, names, ["stem"])
        extension = F.expr("substring(file_name, length(stem) + 1)")
        new_name = F.when(~F.col("_drop"), F.concat("_new_stem", extension))
    return plan.withColumn("new_name", new_name).select(
        "file_name",
        F.when(F.col("_drop"), "drop")
        .when(F.col("new_name").isNotNull(), "rename")
        .otherwise("keep")
        .alias("action"),
        "new_name",
    )
