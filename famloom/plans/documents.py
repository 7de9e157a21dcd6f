"""Rewriting domain-architecture documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from famloom.functions.ids import accession

CONTAINERS = "architecture_containers"


def _as_map(value: Column) -> Column:
    return value.cast("map<string,variant>")


def _replaced(old: Column, name: str, value: Column) -> Column:
    """Map ``old`` with key ``name`` set to ``value``, other keys untouched."""
    rest = F.map_filter(old, lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), value))


def rewrite_domain_documents(
    documents: DataFrame, family_mark: str, accession_prefix: str, link_base: str
) -> DataFrame:
    """Point domains whose name contains ``family_mark`` at the document's own family.

    Such a domain gets id = document id, name = mark + id and link = ``link_base`` +
    ``accession_prefix`` + the id padded to ten digits.  Every other key, at any
    level, is preserved.  ``documents``: id (digits), document (JSON text).
    """
    family = F.col("id")
    link = F.concat(F.lit(link_base), accession(accession_prefix, family.cast("bigint")))
    new_name = F.concat(F.lit(family_mark), family)

    def domain(value: Column) -> Column:
        old = _as_map(value)
        name = F.coalesce(F.try_element_at(old, F.lit("name")).cast("string"), F.lit(""))
        changed = old
        for key, text in (("id", family), ("name", new_name), ("link", link)):
            changed = _replaced(changed, key, text.cast("variant"))
        return F.when(name.contains(family_mark), changed).otherwise(old)

    def container(value: Column) -> Column:
        old = _as_map(value)
        domains = F.transform(F.try_element_at(old, F.lit("domains")).cast("array<variant>"), domain)
        return F.when(
            F.map_contains_key(old, "domains"),
            _replaced(old, "domains", F.to_variant_object(domains)),
        ).otherwise(old)

    whole = _as_map(F.parse_json("document"))
    containers = F.transform(
        F.try_element_at(whole, F.lit(CONTAINERS)).cast("array<variant>"), container
    )
    rewritten = F.when(
        F.map_contains_key(whole, CONTAINERS),
        _replaced(whole, CONTAINERS, F.to_variant_object(containers)),
    ).otherwise(whole)
    return documents.select("id", F.to_json(rewritten).alias("document"))
