"""Screening of submitted texts: counts that a reviewer is shown, deterministic and explainable."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import collapsed, link_count, word_count
from quirefold.session import spread


def screen(texts: DataFrame, group: str, identity: str, text: str, least_repeat: int = 140) -> DataFrame:
    """Per group: texts, words, links, blank texts, and texts longer than ``least_repeat`` that repeat an earlier one.

    Repeats are counted as texts less distinct texts, by digest, in two aggregations with partial sums.
    """
    low = F.lower(collapsed(F.coalesce(F.col(text), F.lit(""))))
    rows = spread(texts.select(group, text)).select(
        F.col(group).alias("g"),
        F.when(F.length(low) > least_repeat, F.xxhash64(low)).alias("key"),
        word_count(F.coalesce(F.col(text), F.lit(""))).alias("words"),
        link_count(F.coalesce(F.col(text), F.lit(""))).alias("links"),
        (low == "").cast("int").alias("blank"),
    )
    by_text = rows.groupBy("g", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.sum("blank").alias("blank")
    )
    return by_text.groupBy(F.col("g").alias(group)).agg(
        F.sum("n").alias("texts"),
        F.sum("words").alias("words"),
        F.sum("links").alias("links"),
        F.sum("blank").alias("blank"),
        F.sum(F.when(F.col("key").isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeated"),
    )


def changed_reports(now: DataFrame, before: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of ``now`` whose fingerprint is new or differs from that of ``before`` (key, fingerprint)."""
    print_ = F.sha2(F.to_json(F.struct(*fields)), 256)
    return (
        now.withColumn("fingerprint", print_)
        .join(before.select(key, F.col("fingerprint").alias("__old")), key, "left")
        .where(~F.col("fingerprint").eqNullSafe(F.col("__old")))
        .drop("__old")
    )
