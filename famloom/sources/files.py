"""FASTA and mask files, whole-file blobs, JSON documents and result folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from famloom.functions.ids import file_stem
from famloom.functions.sequences import mask_is_valid
from famloom.sources.places import folders_in, opened
from famloom.sources.tables import read_lines


def read_fasta(spark: SparkSession, path: str | list[str], **options: object) -> DataFrame:
    """FASTA records, plain or gz: file name, order, header and joined sequence.

    Records are read with a line break followed by ``>`` as separator, so plain
    files split at records and no file is held whole.
    """
    raw = read_lines(spark, path, separator="\n>", **options)
    text = F.regexp_replace("value", r"^\s*>", "")
    header = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s", "")
    return raw.filter(F.col("value").rlike(r"\S")).select(
        "file_path", "file_name", "line_order", header.alias("header"), body.alias("sequence")
    )


def first_records(records: DataFrame, key: str = "file_path") -> DataFrame:
    """First FASTA record of every file."""
    kept = [c for c in records.columns if c not in (key, "line_order")]
    first = F.min_by(F.struct(*kept), F.col("line_order"))
    return records.groupBy(key).agg(first.alias("_first")).select(key, "_first.*")


def read_masks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Mask per file name stem; an empty or invalid mask fails the job."""
    mask = F.regexp_replace("value", r"\s", "")
    checked = F.when(mask_is_valid(mask), mask).otherwise(
        F.raise_error(F.concat(F.lit("invalid mask in "), F.col("_metadata.file_name")))
    )
    return spark.read.text(path, wholetext=True).select(
        file_stem(F.col("_metadata.file_name")).alias("family_id"), checked.alias("mask")
    )


def list_files(spark: SparkSession, path: str | list[str], **options: object) -> DataFrame:
    """Path, name and stem of files; contents are not read."""
    return (
        spark.read.options(**options)
        .format("binaryFile")
        .load(path)
        .select(
            "path",
            F.col("_metadata.file_name").alias("file_name"),
            file_stem(F.col("_metadata.file_name")).alias("stem"),
            "length",
        )
    )


def family_files(files: DataFrame, suffix: str = ".fas.gz") -> DataFrame:
    """Numeric family id per listed file; other names and repeated ids fail the job."""
    stem = F.expr(f"left(file_name, length(file_name) - {len(suffix)})")
    family = F.when(
        F.col("file_name").endswith(suffix) & stem.rlike(r"^\d+$"), stem.cast("bigint")
    ).otherwise(
        F.raise_error(F.concat(F.lit("file name is not a numeric family id: "), F.col("file_name")))
    )
    repeated = F.raise_error(
        F.concat(F.lit("Duplicate file for family id "), F.max("family_id").cast("string"))
    )
    return (
        files.withColumn("family_id", family)
        .groupBy("family_id")
        .agg(
            F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.max("path")).alias("path"),
            F.max("file_name").alias("file_name"),
        )
    )


def read_file_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole text of each file, decompressed by extension, as bytes."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.encode("value", "UTF-8").alias("content"),
    )


def read_file_bytes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw bytes of each file."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.col("_metadata.file_name").alias("file_name"), "content")
    )


def read_json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON document per file, keyed by file name stem."""
    return spark.read.text(path, wholetext=True).select(
        file_stem(F.col("_metadata.file_name")).alias("id"), F.col("value").alias("document")
    )


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def _one_form(path: Column) -> Column:
    """Local names with one slash after the scheme, as Hadoop writes them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def marked_folders(
    spark: SparkSession, root: str, marker_file: str, markers: list[str]
) -> DataFrame:
    """Second-level folders whose marker file contains any of the ``markers``.

    The driver lists the first level only.  Tasks list the second level of their folders
    and open the marker files there, so nothing deeper is listed and hidden names are
    found like others.  Markers are looked for in the file's bytes.
    """
    first = spark.createDataFrame([(f,) for f in folders_in(spark, root)], "folder string")
    sought = [marker.encode() for marker in markers]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, base = opened(folder)
                below = system.get_file_info(fs.FileSelector(base, recursive=False))
                names = [f.base_name for f in below if f.type == fs.FileType.Directory]
                files = system.get_file_info([f"{base}/{name}/{marker_file}" for name in names])
                found = []
                for name, file in zip(names, files):
                    if file.type == fs.FileType.File:
                        with system.open_input_stream(file.path, compression=None) as handle:
                            content = handle.read()
                        if any(marker in content for marker in sought):
                            found.append(f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["folder"])

    spread = max(1, spark.sparkContext.defaultParallelism)
    return first.repartition(spread, "folder").mapInArrow(keep, "folder string")


def lines_in_folders(
    spark: SparkSession, root: str, pattern: str, folders: DataFrame
) -> DataFrame:
    """Lines of ``root/*/*/pattern`` files that lie in the given folders."""
    lines = read_lines(spark, f"{root}/*/*/{pattern}")
    return lines.withColumn("folder", _one_form(_parent(F.col("file_path")))).join(
        folders, "folder", "left_semi"
    )


def files_in_folders(spark: SparkSession, root: str, pattern: str, folders: DataFrame) -> DataFrame:
    """Listing of ``root/*/*/pattern`` files below the given folders."""
    files = list_files(spark, f"{root}/*/*/{pattern}")
    depth = pattern.count("/") + 1
    return files.withColumn(
        "folder", _one_form(F.regexp_replace("path", rf"(/[^/]*){{{depth}}}$", ""))
    ).join(folders, "folder", "left_semi")
