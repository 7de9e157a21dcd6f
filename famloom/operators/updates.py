"""New versions of a table with some columns updated by id.

Spark tables are not changed in place: each function returns the next version,
which the caller writes as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from famloom.operators.remap import latest_rows, reconcile_ids
from famloom.schemas import add_missing_columns
from famloom.session import durable


def update_by_id(
    table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: str | None = None
) -> DataFrame:
    """Overwrite ``columns`` where ``changes`` has a row for the id; others keep theirs.

    ``order`` picks the last of repeated change rows; without it they fail the job.
    """
    latest = latest_rows(changes, key, order).select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_changed")
    )
    joined = table.join(latest, key, "left")
    updated = {
        c: F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns
    }
    return joined.withColumns(updated).select(*table.columns)


def apply_stars(
    families: DataFrame, stars: DataFrame, key: str = "id", order: str | None = None
) -> DataFrame:
    """Store star ratings as ``quality_rank`` and ``novelty_rank``, adding the columns if absent."""
    ranked = add_missing_columns(families, {"quality_rank": "int", "novelty_rank": "int"})
    kept = [] if order is None else [order]
    changes = stars.select(
        F.col("family_id").alias(key),
        F.col("quality_stars").cast("int").alias("quality_rank"),
        F.col("novelty_stars").cast("int").alias("novelty_rank"),
        *kept,
    )
    return update_by_id(ranked, changes, key, ["quality_rank", "novelty_rank"], order)


def attach_all_blobs(
    families: DataFrame, blobs: DataFrame, key: str, column: str, allow_missing: bool = False
) -> DataFrame:
    """Strict policy: every file needs a row, and every row a file unless allowed.

    ``blobs`` has the key and ``content``.  The check runs before anything is built
    gives the number of problems and the first 20 of them in its message;
    :func:`famloom.operators.remap.reconcile_ids` lists them all.
    """
    problems = reconcile_ids(families, blobs, key)
    if allow_missing:
        problems = problems.filter("problem = 'extra'")
    problems = durable(problems)
    shown = problems.orderBy("problem", key).limit(20).collect()
    if shown:
        listed = ", ".join(f"{row['problem']} {row[key]}" for row in shown)
        counts = problems.groupBy("problem").count().orderBy("problem").collect()
        total = ", ".join(f"{row['count']} {row['problem']}" for row in counts)
        raise ValueError(f"family ids and files do not match ({total}): {listed}")
    changes = blobs.select(key, F.col("content").alias(column))
    return update_by_id(families, changes, key, [column])


def attach_named_blobs(
    families: DataFrame, blobs: DataFrame, name_column: str, column: str
) -> DataFrame:
    """By file name: only rows naming a readable, non-empty file change.

    A file name that occurs twice fails the job.
    """
    usable = latest_rows(blobs.select("file_name", "content"), "file_name", None).filter(F.length("content") > 0).select(
        F.col("file_name").alias(name_column), F.col("content").alias("_content")
    )
    joined = families.join(usable, name_column, "left")
    return joined.withColumn(column, F.coalesce("_content", column)).select(*families.columns)


def attach_missing_blobs(
    families: DataFrame, blobs: DataFrame, key: str, name_column: str, column: str
) -> DataFrame:
    """Fill-in policy: a row changes only while its file name or blob is still null.

    A key with two files fails the job.
    """
    new = latest_rows(blobs.select(key, "file_name", "content"), key, None).select(
        key, F.col("file_name").alias("_name"), F.col("content").alias("_content")
    )
    done = F.col(name_column).isNotNull() & F.col(column).isNotNull()
    use_new = F.col("_name").isNotNull() & ~done
    joined = families.join(new, key, "left")
    return joined.withColumns(
        {
            name_column: F.when(use_new, F.col("_name")).otherwise(F.col(name_column)),
            column: F.when(use_new, F.col("_content")).otherwise(F.col(column)),
        }
    ).select(*families.columns)
