"""Pairs of similar sets, and residue-level similarity of family pairs.

The set join is exact and never pairs up everything that shares one element.
Each set becomes one row, its elements from rare to common by the frequency of their
hash cells; two sets with Jaccard >= t must share an element among the first few of
each (the prefix), and must be of similar size.
Only prefixes are joined, on (element, size band); parity sketches of the sets rule
out most joined pairs on the spot, and the other candidates are counted in full.  An element that nearly every set holds ranks last and is
joined only for sets too small to have anything rarer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.functions.ranges import region_hull
from famloom.operators.bitmaps import bitmap_totals
from famloom.operators.sieve import IdSieve
from famloom.operators.skew import lookup
from famloom.session import durable

_SUB_BUCKETS = 256
#: A family with more rows is cut into parts by element, so that no task holds it whole.
PART_ROWS = 1 << 14
#: Hash cells that element frequencies are counted in at most: 4 MB for all tasks.
MAX_CELLS = 1 << 22
_PAGE = 1 << 10


def _needed(threshold: float, total: Column) -> Column:
    """Shared elements two sets need when their sizes add up to ``total``."""
    share = threshold / (1.0 + threshold)
    return F.ceil(total * F.lit(share) - F.lit(1e-9)).cast("bigint")


def _cell(element: str, cells: int) -> Column:
    return F.pmod(F.xxhash64(element), F.lit(cells))


def _frequency_pages(rows: DataFrame, element: str, cells: int) -> DataFrame:
    """(_page, _classes): per hash cell of elements, log2 of its rows; -1 for a single one.

    A cell's class is a rank that needs no join with the elements: rare ones come first,
    and one that shares its cell with a frequent one only comes later than it might.
    """
    blank = rows.sparkSession.range(cells).select("id", F.lit(0).cast("bigint").alias("_rows"))
    counted = rows.groupBy(_cell(element, cells).alias("id")).agg(F.count(F.lit(1)).alias("_rows"))
    class_ = F.when(F.col("_rows") <= 1, F.lit(-1)).otherwise(F.floor(F.log2("_rows"))).cast("tinyint")
    summed = counted.unionByName(blank).groupBy("id").agg(F.sum("_rows").alias("_rows"))
    in_order = F.sort_array(F.collect_list(F.struct((F.col("id") % _PAGE).alias("at"), class_.alias("class"))))
    return summed.groupBy(F.floor(F.col("id") / _PAGE).alias("_page")).agg(
        F.transform(in_order, lambda c: c["class"]).alias("_classes")
    )


def _large_families(known: DataFrame, family: str, rows: int) -> DataFrame:
    """(family, _parts) of the families with more than ``PART_ROWS`` of all ``rows``.

    Rows are counted per hash cell first: a large family makes its cell full, and only the
    rows of full cells are counted by family.
    """
    cells = 1 << min(max(8 * rows // PART_ROWS, 1), MAX_CELLS).bit_length()
    cell, count = _cell(family, cells), F.count(F.lit(1)).alias("_rows")
    full = known.groupBy(cell.alias("_full")).agg(count).filter(F.col("_rows") > PART_ROWS).select("_full")
    sized = known.withColumn("_full", cell).join(F.broadcast(full), "_full", "left_semi").groupBy(family).agg(count)
    return sized.filter(F.col("_rows") > PART_ROWS).select(
        family, F.ceil(F.col("_rows") / PART_ROWS).cast("int").alias("_parts")
    )


def _pieces(members: DataFrame, family: str, element: str) -> DataFrame:
    """Every set as one row (family, _part, _parts, _n, _alone, _items, _buckets).

    ``_items`` are the distinct elements from rare to common, by (bucket, element); a bucket
    is a frequency class cut into hash slices.  The first ``_alone`` of them are held by no
    other set.  A family of many rows has several parts, dealt by element, and only then
    ``_buckets``.  Rows are shuffled once, by family and part.
    """
    known = members.select(family, element).filter(F.col(family).isNotNull() & F.col(element).isNotNull())
    rows = known.count()
    large = durable(_large_families(known, family, rows))
    cells = 1 << min(max(rows, _PAGE), MAX_CELLS).bit_length() - 1
    pages = durable(_frequency_pages(known, element, cells))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = (
        known.join(F.broadcast(large), family, "left")
        .select(
            family,
            element,
            F.pmod(F.xxhash64(F.lit("part"), element), parts).cast("int").alias("_part"),
            parts.alias("_parts"),
        )
        .repartition(family, "_part")
    )
    class_ = F.get("_classes", (_cell(element, cells) % _PAGE).cast("int"))
    slice_ = F.pmod(F.xxhash64(element), F.lit(_SUB_BUCKETS)).cast("int")
    bucket = F.when(class_ < 0, F.lit(-1)).otherwise(class_.cast("int") * _SUB_BUCKETS + slice_)
    placed = dealt.withColumn("_page", F.floor(_cell(element, cells) / _PAGE)).join(F.broadcast(pages), "_page")
    grouped = (
        placed.select(family, "_part", "_parts", F.struct(bucket.alias("bucket"), F.col(element).alias("item")).alias("_at"))
        .groupBy(family, "_part")
        .agg(F.max("_parts").alias("_parts"), F.sort_array(F.collect_set("_at")).alias("_sorted"))
    )
    return durable(
        grouped.select(
            family,
            "_part",
            "_parts",
            F.size("_sorted").cast("bigint").alias("_n"),
            F.size(F.filter("_sorted", lambda x: x["bucket"] < 0)).alias("_alone"),
            F.col("_sorted.item").alias("_items"),
            F.when(F.col("_parts") > 1, F.col("_sorted.bucket")).alias("_buckets"),
        )
    )


def _marks(pieces: DataFrame, family: str) -> DataFrame:
    """(family, _n, _one, _two): size and two digests; only cut families are grouped."""
    per = pieces.select(
        family,
        "_parts",
        "_n",
        F.xxhash64("_part", "_items").alias("_one"),
        F.xxhash64(F.lit("second"), "_part", "_items").alias("_two"),
    )
    cut = per.filter("_parts > 1").groupBy(family).agg(
        F.sum("_n").alias("_n"), F.bit_xor("_one").alias("_one"), F.bit_xor("_two").alias("_two")
    )
    return per.filter("_parts = 1").drop("_parts").unionByName(cut)


def _sketch(half: int) -> Column:
    """64 of a set's 128 parity bits: each element flips one of them."""
    zero = F.lit(0).cast("bigint")

    def flip(bits: Column, item: Column) -> Column:
        bit = F.pmod(F.xxhash64(F.lit("sketch"), item), F.lit(128)).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)))
        return bits.bitwiseXOR(F.when(F.shiftright(bit, 6) == half, one).otherwise(zero))

    return F.aggregate("_items", zero, flip)


def _prefixes(pieces: DataFrame, threshold: float, family: str, element: str) -> DataFrame:
    """Elements that a pair may meet on: (family, element, _size, _before, _low, _high).

    ``_before`` counts the set's elements that come earlier.  In a cut family, where no task
    sees them all, it counts those in strictly rarer buckets, which are a bounded number.
    """
    facts = [family, "_size", "_before", "_low", "_high"]
    size = F.col("_size")
    longest = (size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    marked = pieces.withColumns({"_low": _sketch(0), "_high": _sketch(1)})
    whole = (
        marked.filter("_parts = 1")
        .withColumn("_size", F.col("_n"))
        .select(family, "_size", "_alone", "_low", "_high", F.posexplode(F.slice("_items", F.lit(1), longest)))
        .filter("pos >= _alone")
        .select(family, F.col("col").alias(element), "_size", F.col("pos").cast("bigint").alias("_before"), "_low", "_high")
    )
    cut = pieces.filter("_parts > 1")
    if cut.isEmpty():
        return whole
    totals = marked.filter("_parts > 1").groupBy(family).agg(
        F.sum("_n").alias("_size"), F.bit_xor("_low").alias("_low"), F.bit_xor("_high").alias("_high")
    )
    tagged = cut.select(family, F.inline(F.arrays_zip(F.col("_items").alias(element), F.col("_buckets").alias("_bucket"))))
    earlier = Window.partitionBy(family).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        tagged.groupBy(family, "_bucket")
        .agg(F.count(F.lit(1)).alias("_in"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
        .filter("_bucket >= 0")
        .join(totals, family)
        .filter(F.col("_before") < longest)
        .select("_bucket", *facts)
    )
    return whole.unionByName(
        tagged.join(durable(buckets), [family, "_bucket"]).select(family, element, *facts[1:])
    )


def similar_sets(
    members: DataFrame, threshold: float, family: str = "family_id", element: str = "protein"
) -> DataFrame:
    """All pairs of families whose element sets have Jaccard >= ``threshold``.

    Result: ``fam_a`` < ``fam_b``, their sizes, ``shared`` and ``jaccard``.  Families with
    equal sets stand behind the smallest of them while candidates are found and counted,
    so that work follows the number of distinct sets; pairs are expanded at the end.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    pieces = _pieces(members, family, element)
    copies = _equal_sets(_marks(pieces, family), family)
    others = copies.filter(F.col(family) != F.col("_head")).select(family)
    heads = pieces if others.isEmpty() else IdSieve(others).remove(pieces, family)
    return _expanded(_similar_heads(heads, threshold, family, element), copies, family)


def _equal_sets(marks: DataFrame, family: str) -> DataFrame:
    """Sets that several families hold as (family, _n, _head), _head being the smallest of them.

    Sets are told apart by size and two independent 64-bit digests.  Most sets are held once;
    they are left out by 32 bits of their digests, so the digests themselves are not shuffled.
    """
    digests = ["_n", "_one", "_two"]
    short = marks.withColumn("_short", F.hash(*digests))
    met = short.groupBy("_short").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_short")
    marks = IdSieve(met).marked(short, "_short").filter("_maybe").select(family, *digests)
    repeated = marks.groupBy(*digests).agg(F.min(family).alias("_head"), F.count(F.lit(1)).alias("_k"))
    copies = lookup(marks, repeated.filter("_k > 1").drop("_k"), digests, "inner")
    return durable(copies.select(family, "_n", "_head"))


def _expanded(pairs: DataFrame, copies: DataFrame, family: str) -> DataFrame:
    """Pairs of all families from pairs of heads, and the pairs inside each class.

    A head without copies stands for itself, so only the copies are joined.
    """
    one = copies.select(F.col("_head").alias("_s"), F.col(family).alias("_x"))
    two = copies.select(F.col("_head").alias("_l"), F.col(family).alias("_y"))
    n = F.col("_n")
    equal = copies.filter(F.col(family) == F.col("_head")).select(
        F.col("_head").alias("_s"), F.col("_head").alias("_l"), n.alias("_s_size"), n.alias("_l_size"),
        n.alias("shared"), F.lit(1.0).alias("jaccard"),
    )
    every = pairs.unionByName(equal).join(one, "_s", "left").join(two, "_l", "left").withColumns(
        {"_x": F.coalesce("_x", "_s"), "_y": F.coalesce("_y", "_l")}
    )
    flip = F.col("_x") > F.col("_y")
    return every.filter((F.col("_s") != F.col("_l")) | (F.col("_x") < F.col("_y"))).select(
        F.when(flip, F.col("_y")).otherwise(F.col("_x")).alias("fam_a"),
        F.when(flip, F.col("_x")).otherwise(F.col("_y")).alias("fam_b"),
        F.when(flip, F.col("_l_size")).otherwise(F.col("_s_size")).alias("size_a"),
        F.when(flip, F.col("_s_size")).otherwise(F.col("_l_size")).alias("size_b"),
        "shared",
        "jaccard",
    )


def _next_band(ranked: DataFrame, threshold: float) -> DataFrame:
    """Prefixes that smaller sets need among the larger sets of the next size band."""
    size, band = F.col("_size"), F.col("_band") + 1
    there = F.ceil(F.pow(F.lit(1.0 / threshold), band) * F.lit(1.0 - 1e-9)).cast("bigint")
    least = _needed(threshold, size + F.greatest(size, there))
    return ranked.filter(F.col("_before") < size - least + 1).withColumn("_band", band)


def _similar_heads(pieces: DataFrame, threshold: float, family: str, element: str) -> DataFrame:
    """(_s, _l, their sizes, shared, jaccard) of different sets.

    Parity bits that differ are at most the elements that only one of two sets holds, so
    pairs with too many of them are left out where they are found, before any shuffle.
    """
    size = F.col("_size")
    base = math.log(1.0 / threshold) if threshold < 1.0 else None
    band = F.floor(F.log(size.cast("double")) / base).cast("int") if base else size.cast("int")
    ranked = _prefixes(pieces, threshold, family, element).withColumn("_band", band)

    def side(mark: str, rows: DataFrame) -> DataFrame:
        facts = [F.col(c).alias(f"_{mark}{c}") for c in ("_size", "_before", "_low", "_high")]
        return rows.select(F.col(family).alias(f"_{mark}"), element, *facts, "_band")

    total = F.col("_s_size") + F.col("_l_size")
    required = _needed(threshold, total)
    ordered = (F.col("_s_size") < F.col("_l_size")) | (
        (F.col("_s_size") == F.col("_l_size")) & (F.col("_s") < F.col("_l"))
    )
    apart = F.bit_count(F.col("_s_low").bitwiseXOR(F.col("_l_low"))) + F.bit_count(
        F.col("_s_high").bitwiseXOR(F.col("_l_high"))
    )

    def met(smaller: DataFrame) -> DataFrame:
        return (
            side("s", smaller)
            .join(side("l", ranked), [element, "_band"])
            .filter(
                ordered
                & (F.col("_s_size") >= F.col("_l_size") * F.lit(threshold) - F.lit(1e-9))
                & (F.col("_s_before") < F.col("_s_size") - required + 1)
                & (F.col("_l_before") < F.col("_l_size") - required + 1)
                & (apart <= total - required * 2)
            )
            .select("_s", "_l", "_s_size", "_l_size")
        )

    # Inside a band both sides are the same rows and one shuffle.  A larger set may also be in
    # the next band; by the sizes there, more of the smaller one is shared, so its prefix is shorter.
    found = met(ranked)
    if base:
        found = found.unionByName(met(_next_band(ranked, threshold)))
    candidates = durable(found.distinct())
    # Few sets are in a candidate; the others' elements are not shuffled to be counted.
    listed = IdSieve(candidates.select(F.col("_s").alias("_f")).unionByName(candidates.select(F.col("_l").alias("_f"))))
    common = (
        listed.marked(pieces.withColumnRenamed(family, "_f"), "_f")
        .filter("_maybe")
        .select("_f", F.explode("_items").alias(element))
    )
    shared = (
        candidates.join(common.withColumnRenamed("_f", "_s"), "_s")
        .join(common.withColumnRenamed("_f", "_l"), ["_l", element], "left_semi")
        .groupBy("_s", "_l", "_s_size", "_l_size")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    jaccard = F.col("shared") / (F.col("_s_size") + F.col("_l_size") - F.col("shared"))
    return shared.filter(jaccard >= threshold).withColumn("jaccard", jaccard)


def families_of(pairs: DataFrame) -> IdSieve:
    """The families of (fam1, fam2) pairs."""
    return IdSieve(pairs.select(F.col("fam1").alias("_f")).unionByName(pairs.select(F.col("fam2").alias("_f"))))


def residue_similarity(
    pairs: DataFrame, members: DataFrame, meta: DataFrame | Callable[[IdSieve], DataFrame]
) -> DataFrame:
    """Residue Jaccard of each (fam1, fam2) on a representative both families hold.

    fam1's representative is used if fam2 holds it, else fam2's if fam1 holds it,
    else the similarity is 0.  Regions count from their first to their last number,
    and ``-`` is the whole representative.  Only members of families in a pair are shuffled;
    ``meta`` may be a function of these families, so that it is derived for them alone.
    """
    listed = families_of(pairs)
    members = durable(
        listed.marked(members.select("family_id", "protein", "region"), "family_id").filter("_maybe").drop("_maybe")
    )
    reps = (meta(listed) if callable(meta) else meta).select(
        F.col("id"), F.col("protein_rep").alias("_rep"), F.col("rep_length").alias("_length")
    )
    held = members.select("family_id", "protein").distinct()

    def rep_of(fam: str) -> DataFrame:
        return reps.select(
            F.col("id").alias(fam), F.col("_rep").alias(f"_rep_{fam}"),
            F.col("_length").alias(f"_length_{fam}"),
        )

    def holds(fam: str, rep: str, flag: str) -> DataFrame:
        return held.select(
            F.col("family_id").alias(fam), F.col("protein").alias(rep), F.lit(True).alias(flag)
        )

    with_reps = pairs.select("fam1", "fam2").join(rep_of("fam1"), "fam1").join(rep_of("fam2"), "fam2")
    chosen = durable(
        with_reps.join(holds("fam2", "_rep_fam1", "_in_2"), ["fam2", "_rep_fam1"], "left")
        .join(holds("fam1", "_rep_fam2", "_in_1"), ["fam1", "_rep_fam2"], "left")
        .select(
            "fam1",
            "fam2",
            F.when(F.col("_in_2"), F.col("_rep_fam1"))
            .when(F.col("_in_1"), F.col("_rep_fam2"))
            .alias("protein"),
            F.when(F.col("_in_2"), F.col("_length_fam1"))
            .when(F.col("_in_1"), F.col("_length_fam2"))
            .alias("_length"),
        )
    )
    sides = chosen.filter(F.col("protein").isNotNull()).select(
        "fam1",
        "fam2",
        "protein",
        "_length",
        F.inline(
            F.array(
                F.struct(F.col("fam1").alias("family_id"), F.lit(1).alias("side")),
                F.struct(F.col("fam2").alias("family_id"), F.lit(2).alias("side")),
            )
        ),
    )
    spans = (
        sides.join(members, ["family_id", "protein"])
        .withColumn("_span", region_hull(F.col("region"), F.col("_length")))
        .select("fam1", "fam2", "side", "_span.start", "_span.end")
    )
    totals = bitmap_totals(spans, ["fam1", "fam2"], "side")
    union = F.col("total1") + F.col("total2") - F.col("overlap")
    scored = totals.select(
        "fam1", "fam2", F.try_divide(F.col("overlap").cast("double"), union).alias("similarity")
    )
    return (
        chosen.select("fam1", "fam2")
        .join(scored, ["fam1", "fam2"], "left")
        .withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    )


def family_similarities(
    members: DataFrame,
    meta: DataFrame | Callable[[IdSieve], DataFrame],
    threshold: float = 0.5,
    order: str | None = None,
) -> DataFrame:
    """Family pairs similar both by shared proteins and by shared residues.

    ``order`` names a row-order column of ``members``: the family met first becomes
    fam1.  Without it the smaller id does.
    """
    pairs = durable(similar_sets(members, threshold))
    if order is None:
        directed = pairs.select(F.col("fam_a").alias("fam1"), F.col("fam_b").alias("fam2"))
    else:
        met = members.groupBy("family_id").agg(F.min(order).alias("_met"))
        a = met.select(F.col("family_id").alias("fam_a"), F.col("_met").alias("_met_a"))
        b = met.select(F.col("family_id").alias("fam_b"), F.col("_met").alias("_met_b"))
        first = F.col("_met_a") <= F.col("_met_b")
        directed = (
            pairs.join(a, "fam_a")
            .join(b, "fam_b")
            .select(
                F.when(first, F.col("fam_a")).otherwise(F.col("fam_b")).alias("fam1"),
                F.when(first, F.col("fam_b")).otherwise(F.col("fam_a")).alias("fam2"),
            )
        )
    return residue_similarity(directed, members, meta).filter(F.col("similarity") >= threshold)
