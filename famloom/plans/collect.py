"""Gathering results from a tree of task folders, recognised by marker files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.functions.ids import file_stem
from famloom.schemas import STRUCTURE_HITS
from famloom.sources.files import files_in_folders, lines_in_folders, marked_folders
from famloom.sources.reports import scores_from_lines


def collect_scores(spark: SparkSession, root: str, marker_file: str, markers: list[str]) -> DataFrame:
    """Structure scores logged in marked folders."""
    folders = marked_folders(spark, root, marker_file, markers)
    return scores_from_lines(lines_in_folders(spark, root, "*_scores.txt", folders))


def collect_structure_hits(
    spark: SparkSession, root: str, marker_file: str, markers: list[str]
) -> DataFrame:
    """All structure-search hit lines of marked folders, typed."""
    folders = marked_folders(spark, root, marker_file, markers)
    lines = lines_in_folders(spark, root, "*.m8", folders).filter(F.col("value") != "")
    parts = F.split("value", "\t")
    fields = [field.split() for field in STRUCTURE_HITS.split(", ")]
    return lines.select(
        *[F.get(parts, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]
    )


def collect_documents(
    spark: SparkSession, root: str, marker_file: str, markers: list[str],
    pattern: str = "domain_results/*",
) -> DataFrame:
    """Listing of the result documents below marked folders."""
    return files_in_folders(
        spark, root, pattern, marked_folders(spark, root, marker_file, markers)
    )


def collect_selected_families(
    spark: SparkSession, root: str, ids: DataFrame, marker_file: str, markers: list[str]
) -> dict[str, DataFrame]:
    """Files and table rows of the selected families, ids being ``<chunk>_<family>``.

    Only folders holding a mask file of a selected id count.  ``files`` lists the
    family's files by kind; ``members`` and ``metadata`` hold the chunk tables'
    rows under the combined id.
    """
    folders = marked_folders(spark, root, marker_file, markers)
    wanted = ids.select(F.col(ids.columns[0]).alias("family_id")).distinct()
    masks = files_in_folders(spark, root, "rf/*", folders).select(
        "folder", F.col("stem").alias("family_id")
    )
    held = masks.join(wanted, "family_id", "left_semi").distinct()
    kinds = ["rf", "hmm", "msa_sto", "seed_msa_sto", "domtblout"]
    files = None
    for kind in kinds:
        found = files_in_folders(spark, root, f"{kind}/*", folders).select(
            "folder", F.col("stem").alias("family_id"), F.lit(kind).alias("kind"), "path"
        )
        files = found if files is None else files.unionByName(found)

    def rows(table: str, separator: str) -> DataFrame:
        lines = spark.read.text(f"{root}/*/*/{table}/*").select(
            F.regexp_replace(F.col("_metadata.file_path"), r"(/[^/]*){2}$", "").alias("folder"),
            file_stem(F.col("_metadata.file_name")).alias("_chunk"),
            F.split(F.trim("value"), separator).alias("_parts"),
        )
        keyed = lines.withColumn(
            "family_id", F.concat_ws("_", "_chunk", F.get("_parts", F.lit(0)))
        )
        return keyed.join(held, ["folder", "family_id"], "left_semi")

    members = rows("refined_families", "\t").filter(F.size("_parts") == 2)
    metadata = rows("family_metadata", ",").filter(F.size("_parts") >= 4)
    return {
        "files": files.join(held, ["folder", "family_id"], "left_semi"),
        "members": members.select("family_id", F.get("_parts", F.lit(1)).alias("protein")),
        "metadata": metadata.select(
            "family_id",
            *[F.get("_parts", F.lit(i)).alias(f"field_{i}") for i in (1, 2, 3)],
        ),
    }
