"""Choosing what to load next: least complete first, budgets, rotation, priorities."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def least_complete_first(novels: DataFrame, stored: DataFrame) -> DataFrame:
    """(novel_id, stored, total, rank) of incomplete novels: the smallest stored share first, then by id.

    ``novels`` has novel_id and chapter_count, ``stored`` novel_id and numbers.  One row per novel is ranked.
    """
    have = F.coalesce("numbers", F.lit(0))
    open_ = (
        novels.where("chapter_count > 0")
        .join(stored.select("novel_id", "numbers"), "novel_id", "left")
        .select("novel_id", have.alias("stored"), F.col("chapter_count").alias("total"))
        .where("stored < total")
    )
    return open_.withColumn("rank", F.row_number().over(W.orderBy(F.col("stored") / F.col("total"), "novel_id")))


def budgeted(queue: DataFrame, wanted: Column, each: int, budget: int) -> DataFrame:
    """``queue`` with ``granted``: at most ``each`` per row and ``budget`` in all, in order of ``rank``; rows granted nothing are left out."""
    before = F.coalesce(F.sum("__want").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        queue.withColumn("__want", F.least(F.lit(each), wanted))
        .withColumn("granted", F.least(F.col("__want"), F.greatest(F.lit(budget) - before, F.lit(0))))
        .where("granted > 0")
        .drop("__want")
    )


def next_numbers(missing: DataFrame, queue: DataFrame) -> DataFrame:
    """(novel_id, chapter_number) to load: the first ``granted`` numbers of each novel's missing ranges.

    ``missing`` has (novel_id, from_number, to_number), ``queue`` (novel_id, granted).  Ranges are clipped
    before they are unfolded, so a long gap costs only what is granted.
    """
    order = W.partitionBy("novel_id").orderBy("from_number").rowsBetween(W.unboundedPreceding, -1)
    size = F.col("to_number") - F.col("from_number") + 1
    clipped = (
        missing.join(queue.select("novel_id", "granted"), "novel_id")
        .withColumn("before", F.coalesce(F.sum(size).over(order), F.lit(0)))
        .withColumn("take", F.least(size, F.col("granted") - F.col("before")))
        .where("take > 0")
    )
    last = F.col("from_number") + F.col("take") - 1
    return clipped.select("novel_id", F.explode(F.sequence(F.col("from_number"), last.cast("int"))).alias("chapter_number"))


def rotation(items: DataFrame, order: str, cursor: int, most: int) -> DataFrame:
    """The ``most`` items from position ``cursor`` on, going round; ``turn`` is the place in this round.

    One row per source series is numbered; this is the size of a catalog, not of a store.
    """
    placed = items.withColumn("__place", F.row_number().over(W.orderBy(order)) - 1)
    n = items.count()
    turn = F.pmod(F.col("__place") - F.lit(cursor), F.lit(max(n, 1)))
    return placed.withColumn("turn", turn.cast("int")).where(F.col("turn") < most).drop("__place")


def priority_then_rotation(items: DataFrame, key: str, priority: str, order: str, cursor: int, featured: int, most: int) -> DataFrame:
    """At most ``featured`` items with a priority, smallest first, then the rotation up to ``most``; no item twice."""
    first = items.where(F.col(priority).isNotNull()).orderBy(priority, key).limit(featured).withColumn("queue", F.lit(0))
    rest = rotation(items.join(first.select(key), key, "left_anti"), order, cursor, most)
    queue = first.withColumn("turn", F.lit(-1)).unionByName(rest.withColumn("queue", F.lit(1)))
    place = F.row_number().over(W.orderBy("queue", F.when(F.col("queue") == 0, F.col(priority)), "turn", key))
    return queue.withColumn("place", place).where(F.col("place") <= most).drop("turn")


def _admitted(budget: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, reserved = object(), 0
        for batch in batches:
            sums, taken = [], []
            for own, cost in zip(batch["day"], batch["cost"].tolist()):
                if own != day:
                    day, reserved = own, 0
                fits = reserved + cost <= budget
                reserved += cost if fits else 0
                sums.append(reserved)
                taken.append(fits)
            yield pd.DataFrame({"id": batch["id"].tolist(), "day": batch["day"].tolist(), "reserved": sums, "accepted": taken})

    return run


def reserved(requests: DataFrame, day: str, order: list[str], identity: str, cost: str, budget: int) -> DataFrame:
    """(id, day, reserved, accepted): compare-and-reserve; a request is accepted if it still fits, and only then adds to the day's sum.

    Whether a request fits depends on all accepted ones before it, so a day is worked through in order by one task, which
    holds one batch at a time.  Costs are whole numbers, null ones count as 0; a null day is a day of its own.
    """
    rows = requests.select(F.col(day).alias("day"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.col(identity).alias("id"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("cost"))
    placed = rows.repartition("day").sortWithinPartitions("day", *[f"__{i}" for i in range(len(order))]).select("id", "day", "cost")
    return placed.mapInPandas(_admitted(budget), f"id {requests.schema[identity].dataType.simpleString()}, day {requests.schema[day].dataType.simpleString()}, reserved long, accepted boolean")


def target_count(stored: Column, latest: Column, batch: int) -> Column:
    """How far a checkpointed catch-up goes: at most ``batch`` further, never back when the source shrinks."""
    return F.greatest(stored, F.least(latest, stored + batch))
