"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition makes one run: its distinct digests in order, each with the
identifier that stays and a count.  Runs merge in rounds.  In round r a run whose digit
r (base ``fan``) is not zero goes to the run with that digit cleared, as in a binomial
tree, and equal digests of the runs that meet are merged.  What a group carries is a
record (its verified identifier and the digest it stands for), and Spark aggregates
records over rows in digest order: each task sorts what it holds into a run and collapses
it in one pass, and the task that receives runs merges them in order and collapses them
again.  So copies collapse inside a task before anything travels and again at every level,
and a group with a third of all rows sends at most one row per run.  Within a run digests
are dealt by hash, so the last run is spread over all tasks as well.  Sorting spills to
disk, so no run has to fit in memory.

A digest is SHA-256 with the byte length and an independent 64-bit hash.  Rows merge by
SHA-256, and at every level the least and the greatest (length, hash) of a group must be
the same; if they ever differ, different texts share a SHA-256 and the job fails rather
than dropping one.

Null text is empty.  A null doc_id never stays if its group has another; repeated rows
(same id and text) all count, and all are marked kept when their id stays.  An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import id_and_text
from famloom.session import durable

#: Runs that meet in one merge.
FAN = 4


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest columns and the run (input partition) of every document."""
    text = id_and_text(docs)
    return text.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("text").cast("bigint").alias("_bytes"),
        F.xxhash64("text").alias("_mark"),
        F.spark_partition_id().alias("_run"),
    )


def merge_runs(rows: DataFrame, runs: int, keep: str = "smallest", fan: int = FAN) -> DataFrame:
    """Distinct digests with keep_id and group_size; ``rows`` come in ``runs`` runs."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    # Null ids lose under either order.
    late = F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()
    check = F.struct("_bytes", "_mark")
    merged = rows.select(
        "text_sha256",
        "_run",
        F.struct(late.alias("late"), "doc_id").alias("_stay"),
        check.alias("_low"),
        check.alias("_high"),
        F.lit(1).cast("bigint").alias("group_size"),
    )
    step = 1
    while True:
        step *= fan
        # All digits up to this round's are cleared: the run at the head of the subtree.
        head = F.col("_run") - F.col("_run") % step
        merged = (
            merged.withColumn("_run", head)
            .groupBy("text_sha256", "_run")
            .agg(
                best("_stay").alias("_stay"),
                F.min("_low").alias("_low"),
                F.max("_high").alias("_high"),
                F.sum("group_size").alias("group_size"),
            )
        )
        if step >= runs:
            break
    two = F.raise_error(F.concat(F.lit("different texts share the SHA-256 "), F.col("text_sha256")))
    return merged.select(
        "text_sha256",
        F.when(F.col("_low") == F.col("_high"), F.col("_stay.doc_id")).otherwise(two).alias("keep_id"),
        "group_size",
    )


def exact_duplicates(docs: DataFrame, keep: str = "smallest", fan: int = FAN) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are read once; the narrow table of digests is stored and read for the merge and
    for the decisions.
    """
    rows = durable(digests(docs))
    runs = (rows.agg(F.max("_run").alias("n")).first().n or 0) + 1
    merged = merge_runs(rows, runs, keep, fan)
    return rows.join(merged, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay."""
    stays = exact_duplicates(docs, keep).filter("kept").select("doc_id").distinct()
    return docs.join(stays, docs.doc_id.eqNullSafe(stays.doc_id), "left_semi")
