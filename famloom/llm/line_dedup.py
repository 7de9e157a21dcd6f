"""Repeated runs of lines across documents, by a suffix array over line ids.

Lines are numbered by content (SHA-256 of the line); lines that occur once cannot repeat
and drop out.  Suffixes are ranked by distributed prefix doubling: a suffix's rank over
2k lines is the rank of the pair (its rank over k lines, the rank of the suffix k lines
on).  A round counts the distinct pairs with partial counts before the shuffle, drops the
pairs that occur once, numbers the others in order (range partitions, numbered inside and
shifted), and joins the numbers back.  Ranks beyond ``min_lines`` lines would only order
the suffixes inside an interval of that common prefix, which no decision reads, so
doubling stops there; a last, overlapping step makes the depth exact.

Suffixes of one final rank are an interval of the suffix array whose common prefix is at
least ``min_lines`` lines.  The first of an interval by (doc_id, line) stays; each later
one marks its ``min_lines`` lines, and marked lines that touch make the maximal repeated
runs, which are deleted.  Runs never cross documents; overlaps count.  With
``min_words``, a line of that many words (runs of characters other than white space) is a
run by itself, so later copies of it go whatever lines stand around them.

Everything is built-in functions.  A line that a third of all documents hold is a hot
pair only in joins of two shuffled sides, which adaptive execution splits.

Null text is empty and stays null; an empty text is one empty line.  Rows with a null
doc_id take part and sort last.  Repeated rows (same id and text) are one document that
comes back as often as it came.  An empty table gives no rows.  Other columns pass
through :func:`drop_repeated_lines`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.llm.common import id_and_text
from famloom.operators.skew import global_position
from famloom.session import discard, durable

MIN_LINES = 2
#: Words of a line that is long enough to be a passage by itself.
PASSAGE_WORDS = 50
_DOC = ["doc_id", "mark"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _place() -> Column:
    """Order of lines over all documents; null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark", "line")


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Number the distinct keys that occur more than once, in their order; keep the first place."""
    again = (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(_place()).alias("head"))
        .filter("_n > 1")
        .drop("_n")
    )
    return global_position(again, [F.col(k) for k in keys], "rank")


def _line_ranks(docs: DataFrame, min_words: int | None = None) -> DataFrame:
    """doc_id, mark, line, rank, head of lines that occur again; with ``min_words`` also long."""
    content, keys = F.col("content"), [*_DOC, "line"]
    found = id_and_text(docs).withColumn("mark", F.xxhash64("text")).select(
        *_DOC, F.posexplode(_lines(F.col("text"))).alias("line", "content")
    )
    if min_words is not None:
        words = F.regexp_count(content, F.lit(r"[^ \t\r\f\x0B]+"))
        found, keys = found.withColumn("long", words >= min_words), [*keys, "long"]
    lines = durable(found.select(*keys, F.unhex(F.sha2(content, 256)).alias("content")).distinct())
    first = _ranked(lines, ["content"])
    suffixes = durable(lines.join(first, "content").select(*keys, "rank", "head"))
    discard(lines)
    return suffixes


def _deeper(suffixes: DataFrame, depth: int) -> DataFrame:
    """Ranks over ``depth`` lines from ranks over one, whose table is deleted."""
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        here = Window.partitionBy(*_DOC).orderBy("line").rangeBetween(step, step)
        pairs = suffixes.select(*_DOC, "line", "rank", F.max("rank").over(here).alias("then")).filter(
            F.col("then").isNotNull()
        ).withColumnRenamed("rank", "now")
        numbered = _ranked(pairs, ["now", "then"])
        longer = durable(pairs.join(numbered, ["now", "then"]).select(*_DOC, "line", "rank", "head"))
        discard(suffixes)
        suffixes, reach = longer, reach + step
    return suffixes


def suffix_ranks(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, mark, line, rank, head: suffixes whose first ``depth`` lines occur again.

    Equal ranks mean equal first ``depth`` lines, ranks follow the order of line ids, and
    ``head`` is the first place of the rank.
    """
    return _deeper(_line_ranks(docs), depth)


def repeated_runs(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None
) -> DataFrame:
    """doc_id, mark, runs: per document the maximal runs (first, last line, from 0) to delete."""
    is_later = ~_place().eqNullSafe(F.col("head"))
    marks = lambda df, n: df.filter(is_later).select(*_DOC, "line", (F.col("line") + n - 1).alias("last"))
    ranks = _line_ranks(docs, min_words)
    passages = None if min_words is None else durable(marks(ranks.filter("long"), 1))
    later = marks(_deeper(ranks, min_lines), min_lines)
    if passages is not None:
        later = later.unionByName(passages)
    in_order = Window.partitionBy(*_DOC).orderBy("line", "last")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("line") > F.max("last").over(before) + 1
    islands = later.select(*_DOC, "line", "last", F.coalesce(gap, F.lit(True)).cast("int").alias("_new")).select(
        *_DOC, "line", "last", F.sum("_new").over(in_order).alias("_run")
    )
    return (
        islands.groupBy(*_DOC, "_run")
        .agg(F.min("line").alias("first"), F.max("last").alias("last"))
        .groupBy(*_DOC)
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside sorted runs, slice by slice."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.element_at(runs, i.cast("int"))["last"] + 1)
    end = lambda i: F.when(i == F.size(runs), F.size(lines)).otherwise(
        F.element_at(runs, (i + 1).cast("int"))["first"]
    )
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))
        )
    )


def without_repeated_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None
) -> DataFrame:
    """Per document: _row (all its columns), kept_text, n_lines, n_removed, n_runs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select(
        "_row",
        F.col("_row.doc_id").cast("bigint").alias("_id"),
        F.xxhash64(F.coalesce(F.col("_row.text"), F.lit(""))).alias("_mark"),
    )
    runs = repeated_runs(docs, min_lines, min_words)
    same = rows["_id"].eqNullSafe(runs.doc_id) & (rows["_mark"] == runs.mark)
    joined = rows.join(runs, same, "left").select("_row", "runs")
    lines = _lines(F.col("_row.text"))
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.select(
        "_row",
        F.when(F.col("runs").isNull(), F.col("_row.text"))
        .otherwise(F.array_join(_kept(lines, F.col("runs")), "\n"))
        .alias("kept_text"),
        F.size(_lines(F.coalesce(F.col("_row.text"), F.lit("")))).cast("bigint").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("bigint").alias("n_runs"),
    )


def digest_rows(cut: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 of :func:`without_repeated_lines`."""
    return cut.select(
        "_row.doc_id",
        "n_lines",
        "n_removed",
        "n_runs",
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def drop_repeated_lines(
    docs: DataFrame,
    min_lines: int = MIN_LINES,
    drop_emptied: bool = False,
    min_words: int | None = None,
) -> DataFrame:
    """``docs`` with later copies of line runs deleted from the text; n_chars follows the text.

    With ``drop_emptied``, rows all of whose lines were deleted go.
    """
    cut = without_repeated_lines(docs, min_lines, min_words)
    if drop_emptied:
        cut = cut.filter(F.col("n_removed") < F.col("n_lines"))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("_row.n_chars"))
    return cut.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


#: The same decisions in SQL: of equal windows of two lines, and of equal lines of 50 words,
#: the first stays.
ORACLE = """
WITH numbered AS (
  SELECT doc_id, line_no, content, lead(content) OVER (PARTITION BY doc_id ORDER BY line_no) AS following
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
        FROM documents)),
later AS (
  SELECT doc_id, line_no FROM numbered WHERE following IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY content, following ORDER BY doc_id, line_no) > 1),
passages AS (
  SELECT doc_id, line_no FROM numbered
  WHERE len(regexp_extract_all(content, '[^ \\t\\r\\f\\x0B]+')) >= 50
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, line_no) > 1),
marked AS (
  SELECT n.doc_id, n.line_no, n.content,
         EXISTS (SELECT 1 FROM later l WHERE l.doc_id = n.doc_id
                 AND l.line_no IN (n.line_no, n.line_no - 1))
         OR EXISTS (SELECT 1 FROM passages p WHERE p.doc_id = n.doc_id AND p.line_no = n.line_no) AS gone
  FROM numbered n),
edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE) AS opens
  FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       count(*) FILTER (opens) AS n_runs,
       sha256(coalesce(string_agg(content, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM edges GROUP BY doc_id"""
