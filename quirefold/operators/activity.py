"""What sources release: tips, releases, lifecycles of records, feeds, alerts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FIVE_DAYS = 5 * 86400


def best_evidence(df: DataFrame, columns: list[str], total: str) -> DataFrame:
    """``df`` with tip, evidence and behind: the largest of several columns, the first listed on ties, and how far ``total`` lags."""
    entries = F.array(*[F.struct(F.col(c).cast("long").alias("n"), F.lit(-i).alias("rank"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    best = F.array_max(F.filter(entries, lambda e: e["n"].isNotNull()))
    return (
        df.withColumn("__best", best)
        .withColumn("tip", F.col("__best.n"))
        .withColumn("evidence", F.col("__best.name"))
        .withColumn("behind", F.greatest(F.lit(0), F.coalesce("tip", F.lit(0)) - F.coalesce(total, F.lit(0))).cast("long"))
        .drop("__best")
    )


def release_states(observations: DataFrame, key: str, order: list[str], tip: str, ongoing: str, at: str, clears: bool = True) -> DataFrame:
    """Each observation with the state after it: seen, release_number, first_number, released_at.

    The first observation of a key is a baseline.  A tip above all earlier ones of an ongoing source is a release; with
    ``clears`` a source that is not ongoing, or whose tip falls back, clears what is pending, otherwise only the flag counts.
    This is the window form of a keyed state machine: segments begin where the state is cleared.
    """
    w = W.partitionBy(key).orderBy(*order)
    earlier = F.coalesce(F.max(tip).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = observations.withColumn("__prev", earlier)
    released = (F.col("__prev") > 0) & (F.col(tip) > F.col("__prev"))
    if clears:
        released &= F.col(ongoing)
    cleared = ~released & (~F.col(ongoing) | (F.col(tip) < F.col("__prev"))) if clears else ~released & ~F.col(ongoing)
    rows = rows.withColumn("__rel", released).withColumn("__seg", F.sum(cleared.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = W.partitionBy(key, "__seg").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        *observations.columns,
        F.greatest("__prev", tip).alias("seen"),
        F.max(F.when(F.col("__rel"), F.col(tip))).over(s).alias("release_number"),
        F.min(F.when(F.col("__rel"), F.col("__prev") + 1)).over(s).alias("first_number"),
        F.max(F.when(F.col("__rel"), F.col(at))).over(s).alias("released_at"),
    )


def merged_records(previous: DataFrame, outcomes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Records after a scan: outcome verified replaces, unverifiable deletes, failed (or none) keeps the previous one."""
    new = outcomes.select(key, "outcome", *[F.col(v).alias(f"__{v}") for v in values])
    pick = [F.when(F.col("outcome") == "verified", F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values]
    kept = previous.withColumn("__had", F.lit(True)).join(new, key, "full")
    gone = F.coalesce(F.col("outcome") == "unverifiable", F.lit(False)) | (F.col("__had").isNull() & (F.col("outcome") != "verified"))
    return kept.where(~gone).select(key, *pick)


def feed(items: DataFrame, observed_at: str, age_s: str, now: Column, most_age: int = FIVE_DAYS) -> DataFrame:
    """Visible items whose effective age is below ``most_age``, strictly, with ``effective_age_s``; none is cut off.

    The age grows with the clock: now - observed_at + age at observation.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp(observed_at) + F.col(age_s)
    return items.where(~F.coalesce("discovery_hidden", F.lit(False))).withColumn("effective_age_s", age).where((age >= 0) & (age < most_age))


def alerts(saved: DataFrame, seen: DataFrame, releases: DataFrame) -> DataFrame:
    """(user_id, novel_id, first_new, new_chapters) for saved novels with released chapters that are stored and not seen.

    ``releases`` has novel_id, first_number, release_number and stored (the last number that can be read).
    """
    first = F.greatest(F.col("first_number"), F.coalesce("seen", F.lit(0)) + 1)
    last = F.least("release_number", "stored")
    return (
        saved.join(releases.where("release_number IS NOT NULL"), "novel_id")
        .join(seen, ["user_id", "novel_id"], "left")
        .select("user_id", "novel_id", first.alias("first_new"), (last - first + 1).alias("new_chapters"))
        .where("new_chapters > 0")
    )
