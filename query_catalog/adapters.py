"""Views giving the driver's tables the shape of family data, in Spark and in SQL.

Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.operators.sieve import IdSieve


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _start():
    return F.col("l_quantity").cast("int")


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as annotation hits: an order is a protein, a supplier a family.

    Lines with a higher tax have a second segment.  ``which`` is 1 for return flag A.
    ``row_no`` is an order over all columns, since line keys repeat.
    """
    start, width = _start(), F.col("l_linenumber") * 3
    first = F.concat_ws("-", start, start + width)
    second = F.concat_ws("-", start + 70, start + 70 + F.col("l_linenumber"))
    region = F.when(F.col("l_tax") > 0.04, F.concat_ws("_", first, second)).otherwise(first)
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("family_id"),
        F.col("l_orderkey").alias("protein"),
        region.alias("region"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("which"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("row_no"),
    )


HITS_SQL = """
hits AS (
  SELECT l_suppkey AS family_id, l_orderkey AS protein,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS which,
         l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax,
         CAST(l_quantity AS INTEGER) AS s
  FROM lineitem),
segments AS (
  SELECT protein, which, s, s + l_linenumber * 3 AS e FROM hits
  UNION ALL
  SELECT protein, which, s + 70, s + 70 + l_linenumber FROM hits WHERE l_tax > 0.04),
positions AS (
  SELECT DISTINCT protein, which, unnest(range(s, e + 1)) AS pos FROM segments)
"""


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as family members: an order is a family, a part a protein.

    Lines without discount are members as whole proteins (``-``).
    """
    start = _start()
    region = F.concat_ws("-", start, start + F.col("l_linenumber") * 3)
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("family_id"),
        F.col("l_partkey").alias("protein"),
        F.when(F.col("l_discount") == 0, "-").otherwise(region).alias("region"),
    )


def family_meta(spark: SparkSession, folder: str, listed: IdSieve | None = None) -> DataFrame:
    """Per family (order): its smallest part as representative, of length 60.

    With ``listed``, lines of other families are left out where they are read, but for a few.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    if listed is not None:
        lines = listed.marked(lines, "l_orderkey").filter("_maybe")
    return (
        lines.groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.min("l_partkey").alias("protein_rep"),
            F.lit(60).alias("rep_length"),
            F.count(F.lit(1)).alias("family_size"),
        )
    )


PAIRS_SQL = """
sets AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS p FROM lineitem),
sizes AS (SELECT f, count(*) AS n FROM sets GROUP BY f),
pairs AS (
  SELECT a.f AS fam_a, b.f AS fam_b, any_value(na.n) AS size_a, any_value(nb.n) AS size_b,
         count(*) AS shared,
         CAST(count(*) AS DOUBLE) / (any_value(na.n) + any_value(nb.n) - count(*)) AS jaccard
  FROM sets a JOIN sets b ON a.p = b.p AND a.f < b.f
  JOIN sizes na ON na.f = a.f JOIN sizes nb ON nb.f = b.f
  GROUP BY a.f, b.f
  HAVING CAST(count(*) AS DOUBLE) / (any_value(na.n) + any_value(nb.n) - count(*)) >= 0.5)
"""


def biome_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of family trees root:REGION:NATION:SEGMENT:MONTH.

    A part and line number is a family; the leaf says where and when an order
    holding it was placed.  One row per family and leaf.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("label")
    )
    places = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey", F.concat_ws(":", F.lit("root"), "r_name", "n_name", "c_mktsegment").alias("parent")
        )
    )
    # Orders get their place before they meet the lines, which are then dealt only once.
    placed = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "parent", "label")
    path = F.concat_ws(":", "parent", "label")
    return (
        lines.join(placed, lines.l_orderkey == placed.o_orderkey)
        .groupBy(F.concat_ws("/", "l_partkey", "l_linenumber").alias("family_id"), "parent", "label")
        .agg(F.count(F.lit(1)).cast("int").alias("count"))
        .select(
            "family_id", path.alias("path"), "parent", "label", "count",
            F.get(F.split(path, ":"), F.lit(1)).alias("top_level"), F.lit(0).alias("place"),
        )
    )


LEAVES_SQL = """
leaves AS (
  SELECT concat(l_partkey, '/', l_linenumber) AS family_id,
         concat('root:', r_name, ':', n_name, ':', c_mktsegment) AS parent,
         strftime(o_orderdate, '%Y-%m') AS label,
         concat('root:', r_name, ':', n_name, ':', c_mktsegment, ':',
                strftime(o_orderdate, '%Y-%m')) AS path,
         r_name AS top_level, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)
"""


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """Leaves plus all their ancestors as (family_id, path, parent, label, count).

    The few leaves of a family are dealt by family, so ancestors are summed where they arise.
    Ancestors are many times the leaves, so the parts are counted, not merged by the leaves' size.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = F.sequence(F.lit(1), F.size(F.split("path", ":")))
    path, label = F.col("node"), F.substring_index("node", ":", -1)
    parent = F.when(
        F.contains(path, F.lit(":")), F.left(path, F.char_length(path) - F.char_length(label) - 1)
    ).otherwise("")
    return (
        leaves.select("family_id", "path", "count")
        .repartition(parts, "family_id")
        .select("family_id", "path", "count", F.explode(levels).alias("_level"))
        .select("family_id", F.expr("substring_index(path, ':', _level)").alias("node"), "count")
        .groupBy("family_id", "node")
        .agg(F.sum("count").cast("int").alias("count"))
        .select("family_id", path.alias("path"), parent.alias("parent"), label.alias("label"), "count")
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with line statistics as profiles; averages come from whole numbers."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count(F.lit(1)).alias("nseq"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("_quantity"),
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("_discount"),
        )
    )
    return (
        table(spark, folder, "part")
        .join(lines, "p_partkey")
        .select(
            F.col("p_partkey").alias("idx"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("accession"),
            "nseq",
            (F.col("_quantity").cast("double") / F.col("nseq")).alias("eff_nseq"),
            F.col("p_size").alias("M"),
            F.lit(0.5).alias("relent"),
            F.lit(0.6).alias("info"),
            F.col("p_retailprice").alias("p_relE"),
            (F.col("_discount").cast("double") / F.col("nseq")).alias("compKL"),
        )
    )


PROFILES_SQL = """
profiles AS (
  SELECT p_partkey AS idx, p_name AS name, nseq,
         CAST(q AS DOUBLE) / nseq AS eff_nseq, CAST(p_size AS DOUBLE) AS m,
         p_retailprice AS prele, CAST(d AS DOUBLE) / nseq AS compkl
  FROM part JOIN (
    SELECT l_partkey, count(*) AS nseq, sum(CAST(l_quantity AS BIGINT)) AS q,
           sum(CAST(round(l_discount * 100) AS BIGINT)) AS d
    FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)
"""


def star_families(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as families; sizes are summed quantities, some predictions are missing."""
    sizes = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("id"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("family_size"))
    )
    plddt = F.when(
        F.col("p_type") != "PROMO", F.round((F.col("p_retailprice") - 900) * 100).cast("bigint") % 100
    )
    return (
        table(spark, folder, "part")
        .select(
            F.col("p_partkey").alias("id"),
            plddt.cast("double").alias("plddt"),
            (F.col("p_size") * 4).alias("rep_length"),
        )
        .join(sizes, "id", "left")
    )


FAMILIES_SQL = """
families AS (
  SELECT p_partkey AS id,
         CASE WHEN p_type <> 'PROMO'
              THEN CAST(CAST(round((p_retailprice - 900) * 100) AS BIGINT) % 100 AS DOUBLE) END AS plddt,
         p_size * 4 AS rep_length, family_size
  FROM part LEFT JOIN (
    SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS family_size
    FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)
"""


def model_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as model hits with ranges like ``3-17 (60)``; some are malformed, some over 0."""
    low, high = F.col("l_linenumber"), F.col("l_linenumber") + _start()
    size = F.when(F.col("l_tax") == 0, 0).otherwise(60)
    good = F.format_string("%d-%d (%d)", low, high, size)
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("family_id"),
        F.when(F.col("l_returnflag") == "N", F.concat_ws("-", low, high))
        .otherwise(good)
        .alias("hmm_range"),
    )


MODEL_SQL = """
coverage AS (
  SELECT l_partkey AS family_id,
         max(CASE WHEN l_tax <> 0
             THEN (CAST(l_linenumber + CAST(l_quantity AS INTEGER) AS DOUBLE) - l_linenumber + 1) / 60.0
             END) AS model_coverage
  FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey)
"""


def folds(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as structure hits; lines with status O hit a collection to be left out."""
    target = F.concat(
        F.when(F.col("l_linestatus") == "O", "own").otherwise("pdb"), F.col("l_suppkey").cast("string")
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("family_id"), target.alias("target"), _start().alias("aligned_length")
    )


FOLDS_SQL = """
folds AS (
  SELECT l_partkey AS family_id, max(CAST(l_quantity AS INTEGER)) AS aligned_length
  FROM lineitem WHERE l_linestatus <> 'O' GROUP BY l_partkey HAVING max(CAST(l_quantity AS INTEGER)) <> 0)
"""
