"""Queries of the operators on texts of a training corpus, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import leakage, lookalike, mixing, mojibake, neardup, packing, residue, subjects
from quirefold.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "chapters")).select("row_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of evidence: records that hold it."""
    return residue.residue(table(spark, d, "chapters")).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "auto_freewebnovel"), "entry_id", ["title", "author", "synopsis"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("entry_id", "field_name")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled values and, where nothing was lost, the text as first written."""
    return _garbled(spark, d)


def _chapter_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.forest_pairs(
        table(spark, d, "chapters"), "row_id", "paragraphs_json", neardup.read_json_body, threshold=0.5, shingle=3, least=300
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand(*_chapter_pairs(spark, d)).select("row_a", "row_b")


def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The block of each stored body of a routed novel."""
    return packing.block_bodies(table(spark, d, "chapters"), table(spark, d, "novel_shards"), table(spark, d, "shards"))


def p5_unused(spark: SparkSession, d: str) -> DataFrame:
    """Per database: blocks, bytes stored, bytes left, and the fewest blocks that could hold them."""
    blocks = p5_blocks(spark, d).groupBy("database_id", "block_id", "block_bytes").agg(F.sum("piece_bytes").alias("bytes"))
    return (
        blocks.groupBy("database_id")
        .agg(F.count(F.lit(1)).alias("blocks"), F.sum("bytes").alias("bytes"), F.sum(F.col("block_bytes") - F.col("bytes")).alias("unused_bytes"), F.max("block_bytes").alias("block_bytes"))
        .withColumn("least_blocks", F.ceil(F.col("bytes") / F.col("block_bytes")))
    )


def p5_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Per database: rows and bytes that its blocks hold, rows cut because they are longer than a block."""
    rows = p5_blocks(spark, d).groupBy("database_id", "row_id").agg(F.sum("piece_bytes").alias("bytes"), F.count(F.lit(1)).alias("pieces"))
    return rows.groupBy("database_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("bytes"), F.count_if(F.col("pieces") > 1).alias("cut_rows"))


_CHAPTER_TEXTS = {"title": False, "paragraphs_json": True}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The values that get another form, or keep a mixed-script token that has no known reading."""
    return p6_plain(spark, d).select("row_id", "field_name")


def p6_plain(spark: SparkSession, d: str) -> DataFrame:
    """The plain form of each value that is not in it, and how many mixed-script tokens stay unresolved."""
    return lookalike.plain_values(table(spark, d, "chapters"), "row_id", _CHAPTER_TEXTS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: documents that show it, the longest run of its words in one of them."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest_run").alias("longest_run"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Windows of items that stand in a document with some words changed: similarity of 0.6 or more."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), least_similarity=0.6).select(
        "doc_id", "item_id", F.round("similarity", 6).alias("similarity")
    )


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents, how often each is used, and its tokens."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each listed source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of each subject; a document of two subjects counts for both."""
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    return _subjects(spark, d).join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p5_blocks": p5_blocks,
    "p5_unused": p5_unused,
    "p5_accounting": p5_accounting,
    "p6_found": p6_found,
    "p6_plain": p6_plain,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_near": p7_near,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_RUNS_OF_12 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, k, array_to_string(w[k:k+11], ' ') AS s FROM d, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
iw AS (SELECT item_id, k, array_to_string(w[k:k+11], ' ') AS s FROM i, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
hits AS (SELECT DISTINCT doc_id, item_id, dw.k AS dk, iw.k AS ik FROM dw JOIN iw USING (s))"""

SQL: dict[str, str] = {
    "p5_accounting": """
WITH newest AS (SELECT novel_id, database_id, row_number() OVER (PARTITION BY novel_id
    ORDER BY assigned_at IS NOT NULL DESC, assigned_at DESC, route_id DESC) AS r FROM novel_shards WHERE novel_id IS NOT NULL)
SELECT database_id, count(*) AS n_rows, CAST(sum(strlen(paragraphs_json)) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE strlen(paragraphs_json) > block_bytes) AS cut_rows
FROM chapters JOIN newest USING (novel_id) JOIN shards USING (database_id)
WHERE r = 1 AND paragraphs_json IS NOT NULL GROUP BY database_id""",
    "p7_found": _RUNS_OF_12 + " SELECT DISTINCT doc_id, item_id FROM hits",
    "p7_report": _RUNS_OF_12
    + """, g AS (SELECT *, dk - row_number() OVER (PARTITION BY doc_id, item_id, dk - ik ORDER BY dk) AS grp FROM hits),
runs AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM g GROUP BY doc_id, item_id, dk - ik, grp)
SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(n) AS INT) AS longest_run FROM runs GROUP BY item_id""",
}
