"""One pass that parts a table into good rows and rejected rows with a reason."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from famloom.session import ensure_checkpoint_dir

_REASON = "reject_reason"


@dataclass(frozen=True)
class Parted:
    """``good`` has the input's columns; ``rejected`` also ``reject_reason``; ``counts`` by outcome."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def part_rows(df: DataFrame, checks: Mapping[str, Column], folder: str | None = None) -> Parted:
    """Store ``df`` once, good rows beside rejected ones, and count while writing.

    ``checks`` maps a reason to a condition that holds for a bad row; a row goes under the
    first that does (an unknown condition counts as not holding).  Both outputs are parts
    of one written table, so the input is read and checked once.  ``counts`` gives the rows
    of every reason and of ``good``.
    """
    if not checks:
        raise ValueError("no checks are given")
    clash = {_REASON, "_bad"} & set(df.columns)
    if clash:
        raise ValueError(f"the table already has {', '.join(sorted(clash))}")
    reason: Column = F.lit(None).cast("string")
    for name, bad in reversed(checks.items()):
        reason = F.when(bad, F.lit(name)).otherwise(reason)
    judged = df.withColumn(_REASON, reason).withColumn("_bad", F.col(_REASON).isNotNull())
    seen = Observation()
    measures = [F.count_if(F.col(_REASON) == name).alias(f"c{i}") for i, name in enumerate(checks)]
    path = f"{folder or ensure_checkpoint_dir(df.sparkSession)}/parted-{uuid.uuid4().hex}"
    judged.observe(seen, F.count_if(~F.col("_bad")).alias("good"), *measures).write.partitionBy("_bad").parquet(path)
    stored = df.sparkSession.read.schema(judged.schema).parquet(path)
    counts = {"good": seen.get["good"]} | {name: seen.get[f"c{i}"] for i, name in enumerate(checks)}
    return Parted(
        stored.filter("not _bad").select(*df.columns),
        stored.filter("_bad").select(*df.columns, _REASON),
        counts,
    )
