"""Id removal, translation, selection, reconciliation and update queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.functions.ids import accession, digits_of
from famloom.operators import remap as R, updates as U
from query_catalog.adapters import table


def _removed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").filter("s_acctbal < 2000").select("s_suppkey")


def remove_ids(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return R.remove_ids(lines, _removed(spark, folder), "l_suppkey")


def remove_ids_by_position(spark: SparkSession, folder: str) -> DataFrame:
    """Second column of a table of text columns."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").cast("string").alias("l_suppkey")
    )
    return R.remove_ids(lines, _removed(spark, folder), 1)


def _mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers in debt-free standing get new ids; repeated rows, the last one counts."""
    suppliers = table(spark, folder, "supplier").filter("s_acctbal >= 5000")
    repeats = F.explode(F.array(F.lit(1), F.lit(2))).alias("row_no")
    return suppliers.select(F.col("s_suppkey").alias("old_id"), repeats).withColumn(
        "new_id", F.col("old_id") * 10 + F.col("row_no")
    )


def map_ids(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return R.map_ids(lines, _mapping(spark, folder), "l_suppkey", "row_no")


def map_ids_by_position(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    return R.map_ids(lines, _mapping(spark, folder), 1, "row_no")


def map_edge_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as edges between suppliers and parts, both ends translated."""
    edges = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("fam1"), F.col("l_partkey").alias("fam2"), "l_discount"
    )
    return R.map_edge_ids(edges, _mapping(spark, folder), order="row_no")


def file_column_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """File columns renamed after the id; the old names are whole addresses, dots and slashes included."""
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("id"),
        F.col("url").alias("msa_file"),
        F.when(F.length("html") % 2 == 0, F.concat(F.lit("f"), F.length("html"), F.lit(".cif"))).alias(
            "cif_file"
        ),
    )
    return R.rename_files(pages, "id", ["msa_file", "cif_file"])


def subset_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left in each of four tables after selecting customers of one segment."""
    wanted = (
        table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    )
    orders = table(spark, folder, "orders")
    tables = {
        "customer": table(spark, folder, "customer").select(F.col("c_custkey").alias("id")),
        "orders": orders.select(F.col("o_custkey").alias("family_id")),
        "events": table(spark, folder, "events").select(F.col("user_id").alias("family_id")),
        "supplier": table(spark, folder, "supplier").select(F.col("s_suppkey").alias("family_id")),
    }
    keys = dict.fromkeys(tables, "family_id") | {"customer": "id"}
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(name))
        for name, df in R.subset_tables(tables, wanted, keys).items()
    ]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionByName(other)
    return result


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("cluster_rep"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("_x_1")).alias("sequence_id"),
    )


def uncovered_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Customers none of whose orders holds a large untaxed line."""
    covered = table(spark, folder, "lineitem").filter("l_quantity >= 45 AND l_tax = 0")
    members = covered.select(F.col("l_orderkey").cast("string").alias("protein"))
    return R.uncovered_clusters(_clusters(spark, folder), members)


def non_singleton_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return R.non_singletons(_clusters(spark, folder))


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    nobody = table(spark, folder, "region").select(F.col("r_name").alias("protein"))
    return R.uncovered_clusters(_clusters(spark, folder), nobody)


def id_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without lines and parts-as-files without an order."""
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("family_id"))
    files = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + F.col("l_linenumber")).alias("family_id")
    )
    return R.reconcile_ids(rows, files, "family_id")


def file_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: unlabelled sources dropped, labelled ones renamed."""
    files = table(spark, folder, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".fas.gz")).alias("file_name"),
        F.col("doc_id").cast("string").alias("stem"),
    )
    labels = table(spark, folder, "labels")
    removed = labels.filter("toxic = 1").select("doc_id")
    mapping = labels.filter("quality = 1").select(
        F.col("doc_id").alias("old_id"), (F.col("doc_id") + 1000000).alias("new_id")
    )
    return R.file_plan(files, removed=removed, mapping=mapping)


def apply_update(spark: SparkSession, folder: str) -> DataFrame:
    """Customer balances overwritten by their largest order; the last change counts."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.struct("o_orderdate", "o_orderkey").alias("row_no"),
    )
    return U.update_by_id(customers, changes, "c_custkey", ["c_acctbal"], "row_no")


def _with_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as families; some already have a file name, some also a blob."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "en", F.concat(F.col("doc_id"), F.lit(".json"))).alias("file"),
        F.when(F.col("source") == "src0", F.col("lang")).cast("binary").alias("blob"),
    )


def _blobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("doc_id"), F.lit(".json")).alias("file_name"),
        F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("q"), F.col("quality"))).cast(
            "binary"
        ).alias("content"),
    )


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("blob", F.col("blob").cast("string"))


def blobs_for_all(spark: SparkSession, folder: str) -> DataFrame:
    families, blobs = _with_columns(spark, folder), _blobs(spark, folder)
    return _as_text(U.attach_all_blobs(families, blobs, "id", "blob", allow_missing=True))


def blobs_by_name(spark: SparkSession, folder: str) -> DataFrame:
    families, blobs = _with_columns(spark, folder), _blobs(spark, folder)
    return _as_text(U.attach_named_blobs(families, blobs, "file", "blob"))


def blobs_if_missing(spark: SparkSession, folder: str) -> DataFrame:
    families, blobs = _with_columns(spark, folder), _blobs(spark, folder)
    return _as_text(U.attach_missing_blobs(families, blobs, "id", "file", "blob"))


def accessions(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys as padded accessions and back."""
    coded = table(spark, folder, "orders").select(
        accession("FAM", F.col("o_orderkey")).alias("accession")
    )
    return coded.withColumn("id", digits_of(F.col("accession")))


_MAP = """
WITH mapping AS (SELECT s_suppkey AS old_id, s_suppkey * 10 + 2 AS new_id FROM supplier WHERE s_acctbal >= 5000)
"""
_BLOBS = """
WITH families AS (
  SELECT doc_id AS id, CASE WHEN lang = 'en' THEN concat(doc_id, '.json') END AS file,
         CASE WHEN source = 'src0' THEN lang END AS blob FROM documents),
blobs AS (
  SELECT doc_id AS bid, concat(doc_id, '.json') AS name,
         CASE WHEN toxic = 1 THEN '' ELSE concat('q', quality) END AS content FROM labels)
"""
_COVERED = """
SELECT o_custkey AS rep_name, count(*) AS cluster_size FROM orders GROUP BY o_custkey HAVING count(*) > 1
"""

QUERIES = {
    "remove_ids": remove_ids,
    "remove_ids_by_position": remove_ids_by_position,
    "map_ids": map_ids,
    "map_ids_by_position": map_ids_by_position,
    "map_edge_ids": map_edge_ids,
    "file_column_rewrite": file_column_rewrite,
    "subset_semi": subset_semi,
    "uncovered_clusters": uncovered_clusters,
    "non_singleton_clusters": non_singleton_clusters,
    "cluster_sizes": cluster_sizes,
    "id_reconcile": id_reconcile,
    "file_plan": file_plan,
    "apply_update": apply_update,
    "blobs_for_all": blobs_for_all,
    "blobs_by_name": blobs_by_name,
    "blobs_if_missing": blobs_if_missing,
    "accessions": accessions,
}

ORACLES = {
    "remove_ids": """
SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)
""",
    "remove_ids_by_position": """
SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)
""",
    "map_ids": f"""{_MAP}
SELECT l_orderkey, coalesce(new_id, l_suppkey) AS l_suppkey, l_quantity
FROM lineitem LEFT JOIN mapping ON old_id = l_suppkey
""",
    "map_ids_by_position": f"""{_MAP}
SELECT l_orderkey, coalesce(new_id, l_suppkey) AS l_suppkey FROM lineitem LEFT JOIN mapping ON old_id = l_suppkey
""",
    "map_edge_ids": f"""{_MAP}
SELECT coalesce(a.new_id, l_suppkey) AS fam1, coalesce(b.new_id, l_partkey) AS fam2, l_discount
FROM lineitem LEFT JOIN mapping a ON a.old_id = l_suppkey LEFT JOIN mapping b ON b.old_id = l_partkey
""",
    "file_column_rewrite": """
SELECT page_id AS id, concat(page_id, '.', string_split(url, '.')[-1]) AS msa_file,
       CASE WHEN length(html) % 2 = 0 THEN concat(page_id, '.cif') END AS cif_file FROM pages
""",
    "subset_semi": """
WITH wanted AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'customer' AS name, count(*) AS n_rows FROM customer WHERE c_custkey IN (SELECT k FROM wanted)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT k FROM wanted)
UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (SELECT k FROM wanted)
UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey IN (SELECT k FROM wanted)
""",
    "uncovered_clusters": """
SELECT o_custkey AS rep_name, count(*) AS cluster_size FROM orders o
WHERE NOT EXISTS (
  SELECT 1 FROM orders c JOIN lineitem ON l_orderkey = c.o_orderkey
  WHERE c.o_custkey = o.o_custkey AND l_quantity >= 45 AND l_tax = 0)
GROUP BY o_custkey HAVING count(*) > 1
""",
    "non_singleton_clusters": """
SELECT o_custkey AS cluster_rep, concat(o_orderkey, '_x_1') AS sequence_id FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
""",
    "cluster_sizes": _COVERED,
    "id_reconcile": """
WITH files AS (SELECT DISTINCT l_orderkey + l_linenumber AS k FROM lineitem)
SELECT o_orderkey AS family_id, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT k FROM files)
UNION ALL SELECT k, 'extra' FROM files WHERE k NOT IN (SELECT o_orderkey FROM orders)
""",
    "file_plan": """
SELECT concat(d.doc_id, '.fas.gz') AS file_name,
       CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'rename' ELSE 'keep' END AS action,
       CASE WHEN toxic IS DISTINCT FROM 1 AND quality = 1 THEN concat(d.doc_id + 1000000, '.fas.gz') END AS new_name
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
    "apply_update": """
SELECT c_custkey, coalesce(arg_max(o_totalprice, (o_orderdate, o_orderkey)), any_value(c_acctbal)) AS c_acctbal,
       any_value(c_mktsegment) AS c_mktsegment
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""",
    "blobs_for_all": f"""{_BLOBS}
SELECT id, file, CASE WHEN bid IS NULL THEN blob ELSE content END AS blob FROM families LEFT JOIN blobs ON bid = id
""",
    "blobs_by_name": f"""{_BLOBS}
SELECT id, file, CASE WHEN content <> '' THEN content ELSE blob END AS blob
FROM families LEFT JOIN blobs ON name = file
""",
    "blobs_if_missing": f"""{_BLOBS}
SELECT id, CASE WHEN bid IS NULL OR (file IS NOT NULL AND blob IS NOT NULL) THEN file ELSE name END AS file,
       CASE WHEN bid IS NULL OR (file IS NOT NULL AND blob IS NOT NULL) THEN blob ELSE content END AS blob
FROM families LEFT JOIN blobs ON bid = id
""",
    "accessions": """
SELECT concat('FAM', lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS accession, o_orderkey AS id FROM orders
""",
}
