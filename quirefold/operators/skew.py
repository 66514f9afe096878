"""Per-key results when a few keys hold most rows.

A key that holds a third of all rows would send a third of all rows to one task.  The operators
here never do that: rows of a key are first aggregated under (key, salt), where the salt is a hash
of the row's own identity, and the small partial results are merged by key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"
KEY = "__key"


def _salt(identity: Sequence[Column], salts: int) -> Column:
    return F.pmod(F.xxhash64(*identity), F.lit(salts)).cast("int")


def key_counts(df: DataFrame, key: str, identity: Sequence[str], salts: int = 32) -> DataFrame:
    """(key, n_rows) of every key, null included, by two-stage counting.

    Empty tables give no rows.  ``identity`` names columns that tell rows apart; repeated rows are all counted.
    """
    partial = (
        df.select(F.col(key).alias(KEY), _salt([F.col(c) for c in identity], salts).alias(SALT))
        .groupBy(KEY, SALT)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return partial.groupBy(KEY).agg(F.sum("n").alias("n_rows")).withColumnRenamed(KEY, key)


def heavy_keys(df: DataFrame, key: str, identity: Sequence[str], share: float = 0.03, salts: int = 32) -> DataFrame:
    """(key, n_rows, share_of_rows) of keys holding more than ``share`` of all rows.

    There are fewer than 1 / share of them, whatever the size of the table.  A null key is never named,
    but its rows count in the total.  An empty table has none.
    """
    counts = key_counts(df, key, identity, salts)
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") > total * F.lit(share))).select(
        key, "n_rows", (F.col("n_rows") / total).alias("share_of_rows")
    )


def salted_aggregate(
    df: DataFrame,
    key: str,
    identity: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    share: float = 0.03,
    salts: int = 32,
) -> DataFrame:
    """Two-stage aggregation: rows of heavy keys get a salt, ``partial`` runs per (key, salt), ``merge`` per key.

    ``partial`` maps names to aggregates over rows; ``merge`` maps result names to aggregates over those
    names.  Keys that are not heavy keep salt 0, so their rows are aggregated once and merged from one row.
    ``identity`` decides the salt: rows equal in it share a salt, so a distinct count over those columns
    can be summed.  Nulls in ``key`` form a group of their own; an empty table gives no rows.
    """
    heavy = heavy_keys(df, key, identity, share, salts).select(F.col(key).alias(KEY), F.lit(True).alias("__heavy"))
    salted = df.join(F.broadcast(heavy), F.col(key) == F.col(KEY), "left").withColumn(
        SALT, F.when(F.col("__heavy"), _salt([F.col(c) for c in identity], salts)).otherwise(F.lit(0))
    )
    parts = salted.groupBy(key, SALT).agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(key).agg(*[c.alias(n) for n, c in merge.items()])
