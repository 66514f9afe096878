"""Queries of the problem "a few keys hold most records"."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.skew import heavy_keys, salted_aggregate
from quirefold.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        heavy_keys(table(spark, d, name).select("novel_id", identity), "novel_id", [identity]).select(
            F.lit(name).alias("table_name"), "novel_id"
        )
        for name, identity in (("chapters", "row_id"), ("novel_shards", "route_id"))
    ]
    return parts[0].unionByName(parts[1])


def p4_chapter_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per novel: stored rows, distinct numbers, first and last number, missing numbers, bytes of bodies, newest ingest."""
    rows = table(spark, d, "chapters").select(
        "novel_id", "chapter_number", "ingested_at", F.octet_length("paragraphs_json").cast("long").alias("body_bytes")
    )
    merged = salted_aggregate(
        rows,
        "novel_id",
        ["novel_id", "chapter_number"],
        partial={
            "n": F.count(F.lit(1)),
            "d": F.countDistinct("chapter_number"),
            "lo": F.min("chapter_number"),
            "hi": F.max("chapter_number"),
            "b": F.sum("body_bytes"),
            "at": F.max("ingested_at"),
        },
        merge={
            "stored_rows": F.sum("n"),
            "distinct_numbers": F.sum("d"),
            "first_number": F.min("lo"),
            "last_number": F.max("hi"),
            "body_bytes": F.sum("b"),
            "newest_ingest": F.max("at"),
        },
    )
    return merged.withColumn(
        "missing_numbers", (F.col("last_number") - F.col("first_number") + 1 - F.col("distinct_numbers")).cast("long")
    )


def p4_route_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per novel: route rows, distinct databases, newest route time."""
    rows = table(spark, d, "novel_shards")
    return salted_aggregate(
        rows,
        "novel_id",
        ["database_id"],
        partial={"n": F.count(F.lit(1)), "k": F.countDistinct("database_id"), "at": F.max("assigned_at")},
        merge={"route_rows": F.sum("n"), "databases": F.sum("k"), "newest_route": F.max("at")},
    )


QUERIES = {
    "p4_found": p4_found,
    "p4_chapter_totals": p4_chapter_totals,
    "p4_route_totals": p4_route_totals,
}

SQL = {
    "p4_found": """
SELECT 'chapters' AS table_name, novel_id FROM chapters WHERE novel_id IS NOT NULL GROUP BY novel_id
HAVING count(*) > 0.03 * (SELECT count(*) FROM chapters)
UNION ALL
SELECT 'novel_shards' AS table_name, novel_id FROM novel_shards WHERE novel_id IS NOT NULL GROUP BY novel_id
HAVING count(*) > 0.03 * (SELECT count(*) FROM novel_shards)""",
    "p4_chapter_totals": """
SELECT novel_id, count(*) AS stored_rows, count(DISTINCT chapter_number) AS distinct_numbers,
  min(chapter_number) AS first_number, max(chapter_number) AS last_number,
  CAST(sum(strlen(paragraphs_json)) AS BIGINT) AS body_bytes, max(ingested_at) AS newest_ingest,
  CAST(max(chapter_number) - min(chapter_number) + 1 - count(DISTINCT chapter_number) AS BIGINT) AS missing_numbers
FROM chapters GROUP BY novel_id""",
    "p4_route_totals": """
SELECT novel_id, count(*) AS route_rows, count(DISTINCT database_id) AS databases, max(assigned_at) AS newest_route
FROM novel_shards GROUP BY novel_id""",
}
