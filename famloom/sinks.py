"""Writers: CSV, id lists, FASTA, fixed-decimal reports, JSON and table versions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def write_csv(
    df: DataFrame, path: str, separator: str = ",", compression: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """CSV with header in the DataFrame's column order."""
    writer = df.write.mode(mode).option("header", True).option("sep", separator)
    writer = writer.option("escape", '"').option("quoteAll", False)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_ids(df: DataFrame, path: str, column: str) -> None:
    """One id per line."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def fasta_lines(name: Column, sequence: Column) -> Column:
    """Header line and sequence line of one record."""
    return F.concat(F.lit(">"), name.cast("string"), F.lit("\n"), sequence)


def write_fasta(records: DataFrame, path: str, name: str, sequence: str) -> None:
    """FASTA records; rows without a sequence are left out."""
    kept = records.filter(F.coalesce(F.col(sequence), F.lit("")) != "")
    kept.select(fasta_lines(F.col(name), F.col(sequence)).alias("value")).write.text(path)


def write_family_fasta(records: DataFrame, path: str, family: str, order: str) -> None:
    """Gzipped FASTA in one folder per family, rows in ``order``.

    Rows are range-partitioned by family and order, so a large family becomes
    several consecutive files instead of one task.
    """
    sorted_rows = records.repartitionByRange(F.col(family), F.col(order)).sortWithinPartitions(
        family, order
    )
    sorted_rows.select(
        family, fasta_lines(F.col("header"), F.col("sequence")).alias("value")
    ).write.partitionBy(family).option("compression", "gzip").text(path)


def fixed_decimals(df: DataFrame, decimals: Mapping[str, int] | int = 6) -> DataFrame:
    """Floating columns as text with a fixed number of decimals, for reports."""
    floating = [name for name, kind in df.dtypes if kind in ("double", "float")]
    places = decimals if isinstance(decimals, Mapping) else dict.fromkeys(floating, decimals)
    return df.select(
        *[
            F.format_string(f"%.{places[c]}f", c).alias(c) if c in places else F.col(c)
            for c in df.columns
        ]
    )


def write_json_documents(df: DataFrame, path: str, column: str) -> None:
    """One JSON document per line; struct columns are rendered, text is kept."""
    value = F.col(column) if dict(df.dtypes)[column] == "string" else F.to_json(column)
    df.select(value.alias("value")).write.text(path)


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """Each table as Parquet below ``root``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to an existing Parquet table."""
    df.write.mode("append").parquet(path)
