"""JSON document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.functions.annotations import with_family_hits
from famloom.plans.documents import rewrite_domain_documents
from famloom.sources.tables import widen
from query_catalog.adapters import table


def nested_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as documents with two containers; urgent ones hold no family domain."""
    mark = F.when(F.col("o_orderpriority") == "1-URGENT", "Pfam").otherwise("oldFAM")
    document = F.format_string(
        '{"architecture_containers":[{"keep":%d,"domains":['
        '{"id":"9","name":"%s7","link":"l","score":1.5},{"id":"8","name":"Pfam8","link":"m"}]},'
        '{"size":2}],"top":{"status":"%s"}}',
        F.col("o_custkey"), mark, F.col("o_orderstatus"),
    )
    documents = widen(table(spark, folder, "orders")).select(
        F.col("o_orderkey").cast("string").alias("id"), document.alias("document")
    )
    rewritten = rewrite_domain_documents(documents, "FAM", "FAMY", "http://example.org/?id=")

    def at(path: str):
        return F.get_json_object("document", f"$.{path}")

    first, second = "architecture_containers[0].domains[0]", "architecture_containers[0].domains[1]"
    return rewritten.select(
        "id",
        at(f"{first}.id").alias("domain_id"),
        at(f"{first}.name").alias("domain_name"),
        at(f"{first}.link").alias("domain_link"),
        at(f"{first}.score").alias("domain_score"),
        at(f"{second}.name").alias("other_name"),
        at("architecture_containers[0].keep").alias("kept"),
        at("architecture_containers[1].size").alias("size"),
        at("top.status").alias("status"),
    )


def metadata_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties with new ``m`` hits for purchases; other keys stay."""
    hit = F.struct(
        F.concat(F.lit("F"), F.col("user_id")).alias("family"),
        F.col("value").alias("evalue"),
        F.lit(1.5).alias("score"),
        F.lit(1).alias("ali_from"),
        F.length("event_type").alias("ali_to"),
    )
    hits = F.when(F.col("event_type") == "purchase", F.array(hit))
    rewritten = widen(table(spark, folder, "events")).select(
        "event_id", with_family_hits(F.col("props"), hits).alias("document")
    )
    return rewritten.select(
        "event_id",
        F.get_json_object("document", "$.k").cast("int").alias("k"),
        F.get_json_object("document", "$.m[0][0]").alias("family"),
        F.get_json_object("document", "$.m[0][1]").cast("double").alias("evalue"),
        F.get_json_object("document", "$.m[0][4]").cast("int").alias("ali_to"),
    )


QUERIES = {"nested_rewrite": nested_rewrite, "metadata_rewrite": metadata_rewrite}

ORACLES = {
    "nested_rewrite": """
SELECT CAST(o_orderkey AS VARCHAR) AS id,
       CASE WHEN urgent THEN '9' ELSE CAST(o_orderkey AS VARCHAR) END AS domain_id,
       CASE WHEN urgent THEN 'Pfam7' ELSE concat('FAM', o_orderkey) END AS domain_name,
       CASE WHEN urgent THEN 'l' ELSE concat('http://example.org/?id=FAMY', lpad(CAST(o_orderkey AS VARCHAR), 10, '0'))
         END AS domain_link,
       '1.5' AS domain_score, 'Pfam8' AS other_name, CAST(o_custkey AS VARCHAR) AS kept, '2' AS size,
       o_orderstatus AS status
FROM (SELECT *, o_orderpriority = '1-URGENT' AS urgent FROM orders)
""",
    "metadata_rewrite": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CASE WHEN event_type = 'purchase' THEN concat('F', user_id) END AS family,
       CASE WHEN event_type = 'purchase' THEN value END AS evalue,
       CASE WHEN event_type = 'purchase' THEN 8 END AS ali_to
FROM events
""",
}
