"""Weighted undirected graphs: edges, connected components, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from famloom.functions.ids import from_sortable_text, sortable_text
from famloom.operators.skew import global_position, lookup
from famloom.session import discard, durable


def symmetric_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Both directions of every (fam1, fam2, weight); the last weight of a repeated edge wins.

    Without ``order`` there is no last one, so an edge repeated with another weight fails
    the job.  Node ids become text that sorts numerically (``src``, ``dst``).
    """
    kept = [] if order is None else [F.col(order).alias("_order")]
    text = edges.select(
        sortable_text(F.col("fam1").cast("string")).alias("src"),
        sortable_text(F.col("fam2").cast("string")).alias("dst"),
        F.col("weight"),
        *kept,
    )
    both = text.unionByName(
        text.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    )
    only = F.when(F.min("weight") == F.max("weight"), F.max("weight")).otherwise(
        F.raise_error(F.lit("an edge has several weights and no order says which is last"))
    )
    last = F.max_by("weight", "_order") if order is not None else only
    return both.groupBy("src", "dst").agg(last.alias("weight"))


def _representatives(edges: DataFrame, turn: int) -> DataFrame:
    """(node, into): the first of a node and its neighbours in an order drawn anew each turn.

    Firsts are partial sums before the shuffle, so a hub's edges never meet in one task.
    """
    src, dst = F.col("src"), F.col("dst")
    ends = F.array(F.struct(src.alias("node"), dst.alias("other")), F.struct(dst.alias("node"), src.alias("other")))

    def drawn(node: str):
        return F.struct(F.xxhash64(F.lit(turn), node).alias("at"), F.col(node).alias("node"))

    first = F.least(F.min(drawn("other")), F.min(drawn("node")))
    return edges.select(F.inline(ends)).groupBy("node").agg(first["node"].alias("into"))


def _contracted(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges between the representatives of their ends, each once, larger end first."""
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(chosen.select(F.col("node").alias(end), F.col("into").alias(f"_{end}")), end)
    return (
        ends.filter("_src <> _dst")
        .select(F.greatest("_src", "_dst").alias("src"), F.least("_src", "_dst").alias("dst"))
        .distinct()
    )


def _stored(edges: DataFrame) -> tuple[DataFrame, int]:
    """Store a round's edges and count them while they are written."""
    seen = Observation()
    kept = durable(edges.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept, seen.get["n"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of symmetric text edges; component = smallest node.

    Randomised contraction (Boegeholz et al. 2020): each round every node joins the first of
    its neighbourhood in a random order, and only the edges between different ones go on.
    A round leaves at most three quarters of the nodes on average, whatever the graph, so
    finished components leave at once and all rounds together cost a few times the first.
    """
    nodes = edges.select(F.col("src").alias("node")).distinct()
    current, left = _stored(edges.filter(F.col("src") > F.col("dst")).select("src", "dst").distinct())
    rounds: list[DataFrame] = []
    while left:
        chosen = durable(_representatives(current, len(rounds)))
        before = current
        current, left = _stored(_contracted(before, chosen))
        discard(before)
        rounds.append(chosen)
    discard(current)
    if not rounds:
        return nodes.withColumn("component", F.col("node"))
    # The last round's representatives stand for whole components; earlier ones look them up.
    found = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        ends = found.select(F.col("node").alias("into"), F.col("into").alias("_into"))
        joined = earlier.join(ends, "into", "left").select("node", F.coalesce("_into", "into").alias("into"))
        following = durable(joined)
        discard(earlier, found)
        found = following
    smallest = found.groupBy("into").agg(F.min("node").alias("component"))
    links = lookup(found, smallest, ["into"], "inner").select("node", "component")
    return nodes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))


def extend_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after new edges joined the graph: the same as a run over all edges.

    ``labels`` is the last version, (node, component) with the smallest node as component;
    ``edges`` are symmetric and may bring new nodes.  Each end becomes its component, so
    only the components that the new edges touch are joined anew: rounds and rows follow
    the new edges, and the old ones are not read.
    """
    labels, edges = labels.select("node", "component"), durable(edges.select("src", "dst"))
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    known = durable(ends.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))

    def of(end: str) -> DataFrame:
        return known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))

    contracted = (
        edges.join(of("src"), "src")
        .join(of("dst"), "dst")
        .select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        .filter("src <> dst")
    )
    merged = connected_components(durable(contracted.distinct())).select(
        F.col("node").alias("component"), F.col("component").alias("_new")
    )
    fresh = known.join(labels.select("node"), "node", "left_anti").select("node", "component")
    every = labels.unionByName(fresh)
    return lookup(every, merged.filter("component <> _new"), ["component"]).select(
        "node", F.coalesce("_new", "component").alias("component")
    )


def cluster_summaries(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of the graph given by symmetric text edges.

    clusters: cluster_id ``SF_n`` numbered by smallest member, family_rep_id,
    family_size.  The representative has the largest summed edge weight, the
    smaller id on ties; sums are compared at 12 decimals.
    members: cluster_id, family_id -- one row per member, however large the cluster.
    """
    components = durable(connected_components(edges))
    degree = edges.groupBy("src").agg(F.round(F.sum("weight"), 12).alias("_degree"))
    weighted = components.join(degree.withColumnRenamed("src", "node"), "node")
    best = F.min_by("node", F.struct((-F.col("_degree")).alias("d"), F.col("node").alias("n")))
    clusters = weighted.groupBy("component").agg(
        best.alias("_rep"), F.count(F.lit(1)).alias("family_size")
    )
    numbered = global_position(clusters, [F.col("component")], "_number")
    named = numbered.select(
        "component",
        F.concat(F.lit("SF_"), F.col("_number").cast("string")).alias("cluster_id"),
        from_sortable_text(F.col("_rep")).alias("family_rep_id"),
        "family_size",
    )
    members = lookup(
        components, named.select("component", "cluster_id"), ["component"], "inner"
    ).select("cluster_id", from_sortable_text(F.col("node")).alias("family_id"))
    return named.drop("component"), members


def singleton_ids(edges: DataFrame, first: int, last: int) -> DataFrame:
    """Ids of ``first..last`` on no edge, as text."""
    ids = edges.sparkSession.range(first, last + 1).select(
        F.col("id").cast("string").alias("family_id")
    )
    present = edges.select(from_sortable_text(F.col("src")).alias("family_id"))
    return ids.join(present, "family_id", "left_anti")
