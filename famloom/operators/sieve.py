"""Semi- and anti-joins with id lists that are too large to broadcast.

The list is folded into a Bloom filter of 64-bit words: an id sets four bits of one word.
Words are aggregated with partial sums, gathered into pages of 128 words, and the pages
are broadcast -- their number is bounded by ``MAX_WORDS``, whatever the list's length.
Rows whose bits are not all set cannot be listed and are settled where they are read;
only the rest, the hits and a few false ones, is shuffled to the exact join behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from famloom.session import durable

#: Words of 8 bytes that a filter may hold at most: 128 MB.  Longer lists let more through.
MAX_WORDS = 1 << 24
#: Bits of the filter for each listed id.
BITS_PER_ID = 20
_PAGE = 128
_BITS = 4


def _place(column: Column, words: int) -> dict[str, Column]:
    """Page, word of the page, and bit mask of an id."""
    where = F.pmod(F.xxhash64(column), F.lit(words))
    which = F.xxhash64(F.lit("bits"), column)
    mask = F.lit(0).cast("bigint")
    for i in range(_BITS):
        bit = F.shiftright(which, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return {
        "_page": F.floor(where / _PAGE).cast("int"),
        "_word": (where % _PAGE).cast("int"),
        "_mask": mask,
    }


def bloom_pages(ids: DataFrame, words: int) -> DataFrame:
    """(_page, _bits): the filter of the one-column table ``ids`` as pages of words."""
    spark = ids.sparkSession
    listed = ids.select(F.col(ids.columns[0]).alias("_id")).filter(F.col("_id").isNotNull())
    marks = listed.select(*[c.alias(n) for n, c in _place(F.col("_id"), words).items()])
    # Every word is there once with no bits, so a page's sorted words are its array.
    blank = spark.range(words).select(
        F.floor(F.col("id") / _PAGE).cast("int").alias("_page"),
        (F.col("id") % _PAGE).cast("int").alias("_word"),
        F.lit(0).cast("bigint").alias("_mask"),
    )
    summed = marks.unionByName(blank).groupBy("_page", "_word").agg(F.bit_or("_mask").alias("_mask"))
    in_order = F.sort_array(F.collect_list(F.struct("_word", "_mask")))
    return summed.groupBy("_page").agg(F.transform(in_order, lambda w: w["_mask"]).alias("_bits"))


def filter_words(count: int) -> int:
    """Words for a list of ``count`` ids: whole pages, a power of two, bounded."""
    wanted = max(_PAGE, min(MAX_WORDS, count * BITS_PER_ID // 64 + 1))
    return 1 << (wanted - 1).bit_length()


class IdSieve:
    """A stored list of distinct ids and its filter; serves any number of tables."""

    def __init__(self, ids: DataFrame, kind: str | None = None) -> None:
        column = F.col(ids.columns[0])
        self.ids = durable(
            ids.select((column.cast(kind) if kind else column).alias("_id")).filter("_id is not null").distinct()
        )
        self.words = filter_words(self.ids.count())
        self.pages = durable(bloom_pages(self.ids, self.words))

    def marked(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``_maybe``: false where the id is surely not listed (nulls never are)."""
        kind = self.ids.schema["_id"].dataType
        placed = df.withColumns(_place(F.col(column).cast(kind), self.words))
        met = placed.join(F.broadcast(self.pages), "_page")
        hit = F.get("_bits", F.col("_word")).bitwiseAND(F.col("_mask")) == F.col("_mask")
        return met.select(*df.columns, (F.col(column).isNotNull() & hit).alias("_maybe"))

    def _listed(self, column: str, df: DataFrame) -> DataFrame:
        return self.ids.select(F.col("_id").cast(df.schema[column].dataType).alias(column))

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose id is listed."""
        sifted = self.marked(df, column).filter("_maybe").drop("_maybe")
        return sifted.join(self._listed(column, df), column, "left_semi").select(*df.columns)

    def remove(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose id is not listed; rows without an id stay."""
        marked = self.marked(df, column)
        sure = marked.filter("not _maybe").drop("_maybe")
        unsure = marked.filter("_maybe").drop("_maybe")
        rest = unsure.join(self._listed(column, df), column, "left_anti").select(*df.columns)
        return sure.unionByName(rest)

    def flag(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """All rows, with a column that says whether the id is listed."""
        marked = self.marked(df, column)
        sure = marked.filter("not _maybe").select(*df.columns, F.lit(False).alias(name))
        found = self._listed(column, df).withColumn(name, F.lit(True))
        unsure = marked.filter("_maybe").drop("_maybe").join(found, column, "left")
        return sure.unionByName(unsure.select(*df.columns, F.coalesce(name, F.lit(False)).alias(name)))
