"""Delimited tables, id lists and relational scans.

Schemas are always given; nothing is inferred.  Gzip is recognised by extension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from famloom.functions.ids import digits_of

_CSV = {"quote": '"', "escape": '"', "maxCharsPerColumn": -1}


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str, separator: str = ",",
    header: bool = True, multi_line: bool = False,
) -> DataFrame:
    """CSV with quoted cells of any width.

    Files split over tasks; where cells may hold line breaks pass ``multi_line=True``,
    which reads each file by one task.  With ``header`` columns are picked by name, so the
    schema may list a subset; files that order their columns otherwise than the first
    fail the job.
    """
    if not header:
        reader = spark.read.options(**_CSV).option("multiLine", multi_line)
        return reader.option("sep", separator).schema(schema).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    text = read_text_table(spark, path, separator, multi_line)
    missing = sorted({field.name for field in wanted} - set(text.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def read_text_table(
    spark: SparkSession, path: str | list[str], separator: str = ",", multi_line: bool = False
) -> DataFrame:
    """CSV with a header, every column as text and all columns kept.

    The first file's header names the columns, and each file's own header is held against
    it, so a file with another order or other names fails instead of mixing columns.
    """
    reader = spark.read.options(**_CSV).option("multiLine", multi_line)
    reader = reader.options(sep=separator, header=True, inferSchema=False, enforceSchema=False)
    names = reader.csv(path).columns
    schema = StructType([StructField(name, StringType()) for name in names])
    return reader.schema(schema).csv(path)


def read_headerless(
    spark: SparkSession, path: str | list[str], schema: str, separator: str = ","
) -> DataFrame:
    """Delimited lines without a header; single-line cells, so large files split."""
    return spark.read.schema(schema).option("sep", separator).csv(path)


def read_commented_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Report CSV whose lines starting with ``#`` are metadata; all columns as text."""
    return (
        spark.read.options(header=True, comment="#", quote='"', escape='"', inferSchema=False)
        .csv(path)
    )


def read_lines(
    spark: SparkSession, path: str | list[str], separator: str | None = None, **options: object
) -> DataFrame:
    """Text records with an order key that follows each file.

    ``line_order`` compares (file, split start, record in split), so it orders
    records as they stand in the files however the files were split over tasks.
    """
    reader = spark.read.options(**options)
    if separator is not None:
        reader = reader.option("lineSep", separator)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_order"),
    )


def read_ids(
    spark: SparkSession, path: str | list[str], name: str = "id", kind: str = "string"
) -> DataFrame:
    """One id per line, trimmed; blank lines dropped, repeats removed."""
    value = F.trim(F.col("value"))
    return (
        spark.read.text(path).filter(value != "").select(value.cast(kind).alias(name)).distinct()
    )


def read_accessions(spark: SparkSession, path: str | list[str], name: str = "id") -> DataFrame:
    """Numbers inside the first column of a CSV with a header; fails on text without digits."""
    table = read_text_table(spark, path)
    first = F.trim(F.col(f"`{table.columns[0]}`"))
    return table.filter(first.isNotNull()).select(digits_of(first).alias(name)).distinct()


def widen(scan: DataFrame) -> DataFrame:
    """Spread a scan with few splits (gzip, one row group) over the idle cores.

    A scan with at least half as many splits as cores is returned as it is, so
    nothing is shuffled once the input is large.  Pass a plain scan: looking at the
    splits of a joined or grouped DataFrame would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def scan_table(
    spark: SparkSession, path: str, columns: Sequence[str], present: str | None = None
) -> DataFrame:
    """Parquet scan of some columns, optionally only rows where ``present`` is set."""
    df = spark.read.parquet(path)
    if present is not None:
        df = df.filter(F.col(present).isNotNull())
    return df.select(*columns)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, columns: Sequence[str], key: str, partitions: int,
    lower: int, upper: int, present: str | None = None, **options: str,
) -> DataFrame:
    """Scan of a database table in ``partitions`` key ranges; needs its JDBC driver jar."""
    df = (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, numPartitions=str(partitions))
        .options(lowerBound=str(lower), upperBound=str(upper), **options)
        .load()
    )
    if present is not None:
        df = df.filter(F.col(present).isNotNull())
    return df.select(*columns)


def row_count(df: DataFrame, present: str | None = None) -> DataFrame:
    """One row: number of rows, or of rows where ``present`` is set."""
    counted: Column = F.count(F.lit(1)) if present is None else F.count(F.col(present))
    return df.agg(counted.alias("n_rows"))
