"""Identifier parsing, formatting and ordering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits_of(text: Column) -> Column:
    """First run of digits as a number; raises when there is none."""
    found = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(found != "", found.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("digits_of: no number in "), text))
    )


def split_ids(cell: Column, separator: str = ";") -> Column:
    """Delimited id list as a trimmed array without empty parts."""
    parts = F.transform(F.split(cell, separator), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def base_id(text: Column) -> Column:
    """Text before the first underscore."""
    return F.substring_index(text, "_", 1)


def accession(prefix: Column | str, number: Column, width: int = 10) -> Column:
    """Prefix plus the number zero-padded to ``width`` (longer numbers stay whole)."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    text = number.cast("string")
    return F.concat(
        prefix, F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
    )


def sort_key(family: Column) -> Column:
    """Struct ordering ids numerically first, then other text alphabetically."""
    number = family.try_cast("bigint")
    return F.struct(
        number.isNull().alias("is_text"), number.alias("number"), family.alias("text")
    )


def sortable_text(family: Column) -> Column:
    """Same order as :func:`sort_key` for non-negative ids, as one string."""
    is_number = family.rlike(r"^\d{1,18}$")
    padded = F.lpad(family, 18, "0")
    return F.when(is_number, F.concat(F.lit("0"), padded, F.lit("|"), family)).otherwise(
        F.concat(F.lit("1|"), family)
    )


def from_sortable_text(text: Column) -> Column:
    """Undo :func:`sortable_text`."""
    return F.regexp_extract(text, r"^(?:0\d{18}|1)\|(.*)$", 1)


def chunk_name(parent: Column, position: Column, size: int) -> Column:
    """Name of the fixed-size chunk holding the 1-based ``position``."""
    number = F.floor((position - 1) / F.lit(size)).cast("bigint") + 1
    return F.format_string("%s_chunk_%06d", parent, number)


def file_name(path: Column) -> Column:
    """Last component of a path or URI."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def with_id_basename(path: Column, family: Column) -> Column:
    """``<id>.<last extension>`` of a file name; null paths stay null."""
    renamed = F.concat_ws(".", family.cast("string"), F.element_at(F.split(path, r"\."), -1))
    return F.when(path.isNotNull(), renamed)
