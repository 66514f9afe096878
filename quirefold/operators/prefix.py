"""Running sums per key in two levels, so that a key with any share of the rows is summed by many tasks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_sum(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over rows of the key up to and with the row.

    ``bucket`` must not decrease along ``order``, for instance the hour of a time.  Rows are summed within (key, bucket);
    the sums of whole buckets, few rows, give what lies before each bucket.  Nulls count as 0.
    """
    rows = df.withColumn("__bucket", bucket)
    v = F.coalesce(F.col(value), F.lit(0))
    inside = W.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("__key").orderBy(F.col("__at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    before = (
        rows.groupBy(F.col(key).alias("__key"), F.col("__bucket").alias("__at"))
        .agg(F.sum(v).alias("__sum"))
        .select("__key", "__at", F.coalesce(F.sum("__sum").over(whole), F.lit(0)).alias("__before"))
    )
    return (
        rows.withColumn("__inside", F.sum(v).over(inside))
        .join(before, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__at")))
        .withColumn(out, F.col("__inside") + F.col("__before"))
        .drop("__bucket", "__inside", "__key", "__at", "__before")
    )
