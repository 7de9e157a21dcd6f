"""Annotation coverage: comparing two annotation sets, and whole-table statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from famloom.functions.annotations import (
    annotation_keys,
    hit_spans,
    parsed_hits,
    with_family_hits,
)
from famloom.functions.ids import chunk_name
from famloom.functions.ranges import merged_length, region_segments
from famloom.functions.scores import percentage, relative_increase
from famloom.operators.intervals import covered_length, coverage_totals, subtract_intervals
from famloom.operators.skew import global_position, group_position
from famloom.schemas import require_columns

#: Hits in one document; further ones continue in the protein's next part.
HITS_PER_CELL = 100_000


def region_spans(hits: DataFrame, *keep: str) -> DataFrame:
    """One row per segment of ``region``; a protein without segments keeps a null span."""
    return hits.select(
        "protein", *keep, F.inline_outer(region_segments(F.col("region")))
    )


def annotation_diff(hits1: DataFrame, hits2: DataFrame) -> DataFrame:
    """Per protein: residues covered by each side, by one side only, and by both."""
    both = region_spans(hits1).withColumn("side", F.lit(1)).unionByName(
        region_spans(hits2).withColumn("side", F.lit(2))
    )
    return coverage_totals(both, "protein", "side").select(
        "protein",
        F.col("total1").alias("total_coverage_file1"),
        F.col("total2").alias("total_coverage_file2"),
        (F.col("total1") - F.col("overlap")).alias("exclusive_coverage_file1"),
        (F.col("total2") - F.col("overlap")).alias("exclusive_coverage_file2"),
        F.col("overlap").alias("overlap_coverage"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: the five sums and the increase ratio in percent (0 without coverage)."""
    columns = [c for c in diff.columns if c != "protein"]
    sums = diff.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    first, gained = F.col("total_coverage_file1"), F.col("exclusive_coverage_file2")
    ratio = F.try_divide((gained + first).cast("double"), first) * 100
    return sums.withColumn("increase_ratio", F.coalesce(ratio, F.lit(0.0)))


def summary_report(summary: DataFrame) -> DataFrame:
    """The summary as labelled lines."""
    labels = {
        "Total Coverage File 1": F.col("total_coverage_file1").cast("string"),
        "Total Coverage File 2": F.col("total_coverage_file2").cast("string"),
        "Exclusive Coverage File 1": F.col("exclusive_coverage_file1").cast("string"),
        "Exclusive Coverage File 2": F.col("exclusive_coverage_file2").cast("string"),
        "Overlap Coverage": F.col("overlap_coverage").cast("string"),
        "Amino Acid Level Increase": F.col("exclusive_coverage_file2").cast("string"),
        "Increase Ratio": F.format_string("%.2f%%", "increase_ratio"),
    }
    rows = [F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in labels.items()]
    return summary.select(F.inline(F.array(*rows)))


def exclusive_regions(hits1: DataFrame, hits2: DataFrame, order: str) -> DataFrame:
    """Regions of ``hits2`` not covered by ``hits1``, longest first.

    Each is labelled with the family of the protein's first row by ``order``.
    """
    first_family = hits2.groupBy("protein").agg(F.min_by("family_id", order).alias("family_id"))
    regions = subtract_intervals(region_spans(hits2), region_spans(hits1), "protein")
    length = (F.col("end") - F.col("start") + 1).alias("annotation_length")
    return (
        regions.join(first_family, "protein")
        .select(
            "family_id",
            "protein",
            F.concat_ws("-", "start", "end").alias("region"),
            length,
            "start",
        )
        .orderBy(F.col("annotation_length").desc(), "protein", "start")
        .drop("start")
    )


def annotation_hits(
    hits: DataFrame, order: str = "line_order", by: Sequence[str] = ()
) -> DataFrame:
    """Long form: protein, hit_no from 1 in ``order``, and the hit's fields.

    Hits have target, query, i_evalue, score, ali_from, ali_to and the order column, and
    the columns ``by`` that tell datasets apart.
    """
    rest = ["query", "i_evalue", "score", "ali_from", "ali_to"]
    ties = [F.col(c) for c in (order, *rest)]
    keys = [*by, "target"]
    return group_position(hits.select(*keys, order, *rest), keys, ties, "hit_no").select(
        *by,
        F.col("target").alias("protein"),
        "hit_no",
        F.col("query").alias("family"),
        F.col("i_evalue").alias("evalue"),
        "score",
        "ali_from",
        "ali_to",
    )


def append_annotations(
    proteins: DataFrame, hits: DataFrame, order: str = "line_order",
    per_cell: int = HITS_PER_CELL, by: Sequence[str] = (),
) -> DataFrame:
    """Replace the ``m`` hits in each protein's document by its ``hits``, in order.

    The documents are a layout of :func:`annotation_hits`: part (hit_no - 1) div
    ``per_cell`` of ``n_parts`` holds the hits of that range.  Part 0 is the protein's own
    document and always there; further parts hold only ``m`` hits.  ``by`` names columns
    of both tables that tell datasets apart.
    """
    numbered = annotation_hits(hits, order, by)
    key = [*by, "protein"]
    entry = F.struct(
        F.col("hit_no").alias("order"), "family", "evalue", "score", "ali_from", "ali_to"
    )
    part = F.floor((F.col("hit_no") - 1) / per_cell).cast("int")
    grouped = (
        numbered.withColumn("part", part)
        .groupBy(*key, "part")
        .agg(F.array_sort(F.collect_list(entry)).alias("_hits"))
    )
    counts = grouped.groupBy(*key).agg((F.max("part") + 1).alias("n_parts"))
    joined = (
        proteins.join(grouped, key, "left")
        .join(counts, key, "left")
        .withColumns({"part": F.coalesce("part", F.lit(0)), "n_parts": F.coalesce("n_parts", F.lit(1))})
    )
    base = F.when(F.col("part") == 0, F.col("metadata")).otherwise(F.lit("{}"))
    return joined.select(
        *[c for c in proteins.columns if c != "metadata"],
        with_family_hits(base, F.col("_hits")).alias("metadata"),
        "part",
        "n_parts",
    )


def whole_rows(proteins: DataFrame) -> DataFrame:
    """``proteins`` with every row marked as a whole protein: part 0 of 1."""
    clash = {"part", "n_parts"} & set(proteins.columns)
    if clash:
        raise ValueError(f"the table already says how it is split: {', '.join(sorted(clash))}")
    return proteins.withColumns({"part": F.lit(0), "n_parts": F.lit(1)})


def _covered_per_protein(
    proteins: DataFrame, selections: Sequence[Sequence[str]], by: Sequence[str]
) -> DataFrame:
    """(by..., residues, covered_<i>...) for each protein and each selection of keys."""
    length = F.length(F.coalesce("sequence", F.lit("")))
    parsed = proteins.withColumns({"_hits": parsed_hits(F.col("metadata")), "_length": length})
    used = sorted({key for keys in selections for key in keys})
    parsed = parsed.withColumns(
        {f"_{key}": hit_spans(F.col("_hits"), key, F.col("_length")) for key in used}
    )

    def spans_of(keys: Sequence[str]) -> Column:
        return F.concat(*[F.col(f"_{key}") for key in keys])

    def in_row(df: DataFrame) -> DataFrame:
        return df.select(
            *by,
            F.col("_length").cast("bigint").alias("residues"),
            *[
                merged_length(spans_of(keys)).cast("bigint").alias(f"covered_{i}")
                for i, keys in enumerate(selections)
            ],
        )

    # Proteins split over several rows: their spans are merged across the rows.
    whole = in_row(parsed.filter("n_parts = 1"))
    split = parsed.filter("n_parts > 1")
    key = [*by, "protein"]
    lengths = split.groupBy(*key).agg(F.max("_length").cast("bigint").alias("residues"))
    for i, keys in enumerate(selections):
        spans = split.select(*key, F.inline_outer(spans_of(keys)))
        covered = covered_length(spans, key).withColumnRenamed("covered", f"covered_{i}")
        lengths = lengths.join(covered, key)
    return whole.unionByName(lengths.drop("protein"))


def annotation_stats(
    proteins: DataFrame, selections: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Sequence and residue annotation shares, one row per label (and value of ``by``).

    A protein is the rows that share its name if ``n_parts`` says it is split, else one
    row.  Tables from :func:`append_annotations` have that column; :func:`whole_rows`
    gives it to a table of one row a protein.  Without it the job fails.

    ``selections`` maps a label to its comma-separated keys; all labels share one
    scan.  Coverage is settled inside each protein's row, so the only shuffle
    carries one partial sum per task.
    """
    require_columns(proteins, ["n_parts"], "protein table (see whole_rows)")
    keys = {label: annotation_keys(text) for label, text in selections.items()}
    per_protein = _covered_per_protein(proteins, list(keys.values()), by)
    places = range(len(keys))
    sums = per_protein.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.coalesce(F.sum("residues"), F.lit(0)).alias("total_amino_acids"),
        *[F.count_if(F.col(f"covered_{i}") > 0).alias(f"sequences_{i}") for i in places],
        *[F.coalesce(F.sum(f"covered_{i}"), F.lit(0)).alias(f"residues_{i}") for i in places],
    )

    def row(i: int, label: str) -> Column:
        sequences, residues = F.col(f"sequences_{i}"), F.col(f"residues_{i}")
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(",".join(keys[label])).alias("annotation_keys"),
            F.col("total_sequences"),
            sequences.alias("annotated_sequences"),
            percentage(sequences, F.col("total_sequences")).alias("annotated_sequence_percentage"),
            F.col("total_amino_acids"),
            residues.alias("annotated_amino_acids"),
            percentage(residues, F.col("total_amino_acids")).alias(
                "annotated_amino_acid_percentage"
            ),
        )

    return sums.select(*by, F.inline(F.array(*[row(i, label) for i, label in enumerate(keys)])))


def compare_stats(stats: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """Before/after row (per value of ``by``) with percentage-point and relative increases.

    A label without a row, in the table or for a value of ``by``, fails the job.
    """

    def of(label: str, column: str) -> Column:
        mine = F.col("label") == label
        none = F.raise_error(F.lit(f"no statistics row is labelled {label}"))
        return F.when(F.count_if(mine) == 0, none).otherwise(F.max(F.when(mine, F.col(column))))

    # Whole numbers are read through double, so "10.0" counts as 10.
    counts = [
        "total_sequences", "annotated_sequences", "total_amino_acids", "annotated_amino_acids",
    ]
    shares = {
        "annotated_sequence": "annotated_sequence_percentage",
        "annotated_amino_acid": "annotated_amino_acid_percentage",
    }
    sides = {"before": before, "after": after}
    wide = stats.groupBy(*by).agg(
        *[
            of(label, c).cast("double").cast("bigint").alias(f"{c}_{side}")
            for c in counts
            for side, label in sides.items()
        ],
        *[
            of(label, c).cast("double").alias(f"{c}_{side}")
            for c in shares.values()
            for side, label in sides.items()
        ],
    )

    def gains(stem: str, column: str) -> list[Column]:
        was, now = F.col(f"{column}_before"), F.col(f"{column}_after")
        return [
            was,
            now,
            F.round(now - was, 6).alias(f"{stem}_percentage_point_increase"),
            relative_increase(was, now).alias(f"{stem}_relative_increase_percentage"),
        ]

    return wide.select(
        *by,
        F.lit(before).alias("before_label"),
        F.lit(after).alias("after_label"),
        "total_sequences_before", "total_sequences_after",
        "annotated_sequences_before", "annotated_sequences_after",
        *gains("annotated_sequence", shares["annotated_sequence"]),
        "total_amino_acids_before", "total_amino_acids_after",
        "annotated_amino_acids_before", "annotated_amino_acids_after",
        *gains("annotated_amino_acid", shares["annotated_amino_acid"]),
    )


def chunk_sequences(
    sequences: DataFrame, order: Sequence[str], size: int, parent: Column
) -> DataFrame:
    """Assign each sequence the name of its fixed-size chunk in row order."""
    placed = global_position(sequences, [F.col(c) for c in order], "_position")
    return placed.withColumn("chunk_id", chunk_name(parent, F.col("_position"), size)).drop(
        "_position"
    )


def annotation_pipeline(
    proteins: DataFrame, hits: DataFrame, order: str = "line_order",
    before: str = "pfam", after: str = "pfam_families", dataset: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotated proteins, statistics, comparison) from proteins and searched hits.

    With ``dataset``, a column of both tables, several datasets go through together: hits
    stay with the proteins of their dataset, and statistics are compared within each.
    """
    by = [] if dataset is None else [dataset]
    annotated = append_annotations(proteins, hits, order, by=by)
    stats = annotation_stats(whole_rows(proteins), {before: "p"}, by).unionByName(
        annotation_stats(annotated, {after: "p,m"}, by)
    )
    return annotated, stats, compare_stats(stats, before, after, by)
