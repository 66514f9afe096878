"""Readers' state: three-way merges and last-write-wins, in table form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def three_way_sets(base: DataFrame, local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """remote + (local - base) - (base - local), as rows of ``key``; one pass over the three sides, no list per user."""

    def side(df: DataFrame, bit: int) -> DataFrame:
        return df.select(*key, F.lit(bit).alias("__side")).distinct()

    flags = side(base, 1).unionByName(side(local, 2)).unionByName(side(remote, 4)).groupBy(key).agg(F.sum("__side").alias("__in"))
    b, loc, rem = [F.col("__in").bitwiseAND(x) > 0 for x in (1, 2, 4)]
    return flags.where((rem | (loc & ~b)) & ~(b & ~loc)).select(key)


def three_way_arrays(base: Column, local: Column, remote: Column) -> Column:
    """The same for arrays within one row: what stays of remote, then what is new in local."""
    b, lo, re = [F.coalesce(c, F.array().cast("array<string>")) for c in (base, local, remote)]
    return F.array_except(F.array_union(re, F.array_except(lo, b)), F.array_except(b, lo))


def newest(events: DataFrame, key: list[str], at: str, tie: str, values: list[str]) -> DataFrame:
    """The values of the latest event of each key; a stale event never wins over a newer one."""
    last = F.max_by(F.struct(*values), F.struct(at, tie))
    return events.groupBy(key).agg(last.alias("__last"), F.max(at).alias(at)).select(*key, at, *[F.col(f"__last.{v}").alias(v) for v in values])


def newest_of_each(rows: DataFrame, key: str, at: str, tie: str, most: int = 200) -> DataFrame:
    """At most ``most`` rows per key, newest first.

    Spark keeps only ``most`` rows of a key per task before the shuffle (window group limit), so a hot key stays small.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return rows.withColumn("place", place).where(F.col("place") <= most)
