"""Order-dependent removal of redundant families.

The rule is sequential: take the last remaining redundant pair, drop its smaller
family (the larger id when sizes are equal), forget all pairs of that family,
repeat.  Seen from one family: it is dropped at the latest pair it would lose
whose winner is still present then.  That only depends on when its winners are
dropped; chains of winners are halved round by round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from famloom.operators.skew import global_position
from famloom.session import discard, durable


def _oriented(pairs: DataFrame, sizes: DataFrame, order: str) -> DataFrame:
    """Pairs as (winner, loser, when); a family without a size fails the job."""

    def sized(fam: str) -> DataFrame:
        return sizes.select(F.col("id").alias(fam), F.col("family_size").alias(f"_size_{fam}"))

    known = pairs.join(sized("fam1"), "fam1", "left").join(sized("fam2"), "fam2", "left")

    def size(fam: str):
        return F.coalesce(
            F.col(f"_size_{fam}"),
            F.raise_error(F.concat(F.lit("no size for family "), F.col(fam).cast("string"))),
        )

    first_loses = (size("fam1") < size("fam2")) | (
        (size("fam1") == size("fam2")) & (F.col("fam1") > F.col("fam2"))
    )
    return known.select(
        F.when(first_loses, F.col("fam2")).otherwise(F.col("fam1")).alias("winner"),
        F.when(first_loses, F.col("fam1")).otherwise(F.col("fam2")).alias("loser"),
        F.col(order).alias("when"),
    )


def _numbered(edges: DataFrame) -> DataFrame:
    """(winner, loser, when, step): pairs numbered from 1 in order, so 0 can mean "never"."""
    return global_position(edges, [F.col("when")], "step")


def redundant_families(pairs: DataFrame, sizes: DataFrame, order: str = "row_no") -> DataFrame:
    """Families dropped from the redundant ``pairs``, with ``dropped_at`` = the deciding pair.

    ``order`` is the unique row order of the pairs; processing runs from its largest
    value down, so sorting by ``dropped_at`` descending gives the dropping order.
    """
    edges = durable(_numbered(_oriented(pairs, sizes, order)))
    dropped = _drop_steps(edges.select("winner", "loser", "step"))
    at = edges.select("step", F.col("when").alias("dropped_at"))
    return dropped.join(at, "step").select("family_id", "dropped_at")


def _drop_steps(edges: DataFrame) -> DataFrame:
    """(family_id, step) of the dropped families.

    A family's step is the largest over its pairs of ``low`` if the winner's step is below
    ``limit``, else ``high`` -- to begin with, the pair's own step if the winner is still
    there, else 0.  Such a rule through a winner that itself hangs on a single rule is
    again one rule on that winner's winner, so each round halves the chains of winners
    (pointer jumping); and each round settles every rule whose outcome the bounds known
    for the winner already decide.  Settled families leave the table.
    """
    zero = F.lit(0).cast("bigint")
    # Of several pairs with one winner only the latest matters.
    latest = edges.groupBy("loser", "winner").agg(F.max("step").alias("step"))
    itself = F.col("winner") == F.col("loser")
    rules = durable(
        latest.select(
            F.col("loser").alias("family"),
            F.when(~itself, F.col("winner")).alias("on"),
            F.col("step").alias("limit"),
            F.col("step").alias("low"),
            F.when(itself, F.col("step")).otherwise(zero).alias("high"),
        )
    )
    done: list[DataFrame] = []
    while True:
        families = durable(_bounds(rules))
        settled = families.filter("least = most").select(F.col("family").alias("family_id"), F.col("least").alias("step"))
        done.append(durable(settled))
        if families.filter("least < most").isEmpty():
            discard(rules, families)
            break
        following = durable(_next_rules(rules, families, done[:-1]))
        discard(rules, families)
        rules = following
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.filter("step > 0")


def _bounds(rules: DataFrame) -> DataFrame:
    """Per family: bounds of its step, and its rule where only one is left open."""
    is_open = F.col("on").isNotNull()
    only = F.when(F.count_if(is_open) == 1, F.max(F.when(is_open, F.struct("on", "limit", "low", "high"))))
    return rules.groupBy("family").agg(
        F.max(F.least("low", "high")).alias("least"),
        F.max(F.greatest("low", "high")).alias("most"),
        F.max(F.when(~is_open, F.col("low"))).alias("floor"),
        only.alias("only"),
    )


def _next_rules(rules: DataFrame, families: DataFrame, before: list[DataFrame]) -> DataFrame:
    """Rules of the open families, settled or moved on to the winner's winner.

    ``before`` holds the families settled in earlier rounds, which a jump may land on.
    """
    own = families.filter("least < most").select("family", F.col("least").alias("_least"))
    winner = families.select(
        F.col("family").alias("on"), F.col("least").alias("_from"), F.col("most").alias("_to"),
        F.coalesce("floor", F.lit(0).cast("bigint")).alias("_floor"), F.col("only").alias("_only"),
    )
    for settled in before:
        known = settled.select(F.col("family_id").alias("on"), F.col("step").alias("_from"), F.col("step").alias("_to"))
        winner = winner.unionByName(known, allowMissingColumns=True)
    judged = rules.join(own, "family").join(winner, "on", "left")
    # A winner that loses no pair is never dropped: its step is 0.
    first, last = F.coalesce("_from", F.lit(0).cast("bigint")), F.coalesce("_to", F.lit(0).cast("bigint"))
    limit, low, high = F.col("limit"), F.col("low"), F.col("high")
    value = (
        F.when(F.col("on").isNull(), low)
        .when(last < limit, low)
        .when(first >= limit, high)
        .when(low == high, low)
    )
    jumps = value.isNull() & F.col("_only").isNotNull()

    def through(outcome: str):
        step = F.greatest(F.col("_only")[outcome], F.col("_floor"))
        return F.when(step < limit, low).otherwise(high)

    settled = value.isNotNull()
    moved = judged.select(
        "family",
        "_least",
        F.when(settled, F.lit(None)).when(jumps, F.col("_only")["on"]).otherwise(F.col("on")).alias("on"),
        F.when(jumps, F.col("_only")["limit"]).otherwise(limit).alias("limit"),
        F.when(settled, value).when(jumps, through("low")).otherwise(low).alias("low"),
        F.when(settled, value).when(jumps, through("high")).otherwise(high).alias("high"),
    )
    # Rules that cannot pass what the family has for sure are spent; one row keeps that.
    kept = moved.filter(F.col("on").isNotNull() & (F.greatest("low", "high") > F.col("_least")))
    sure = moved.groupBy("family", "_least").agg(F.max(F.when(F.col("on").isNull(), F.col("low"))).alias("_fixed"))
    fixed = sure.select(
        "family", F.lit(None).cast(rules.schema["on"].dataType).alias("on"), F.lit(0).cast("bigint").alias("limit"),
        F.greatest("_least", F.coalesce("_fixed", F.lit(0).cast("bigint"))).alias("low"),
    ).withColumn("high", F.col("low"))
    return kept.select("family", "on", "limit", "low", "high").unionByName(fixed)


def eliminate_redundant(
    similarities: DataFrame, sizes: DataFrame, threshold: float = 0.95, order: str = "row_no"
) -> tuple[DataFrame, DataFrame]:
    """(dropped families, surviving pairs below the threshold)."""
    redundant = similarities.filter(F.col("similarity") >= threshold)
    similar = similarities.filter(F.col("similarity") < threshold)
    dropped = redundant_families(redundant, sizes, order)
    gone = dropped.select("family_id")
    kept = similar.join(gone.withColumnRenamed("family_id", "fam1"), "fam1", "left_anti").join(
        gone.withColumnRenamed("family_id", "fam2"), "fam2", "left_anti"
    )
    return dropped, kept.select(*similarities.columns)
