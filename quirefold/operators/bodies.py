"""Repeated bodies, within a novel and across novels, and what a list of known repeats says of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import body, digest16
from quirefold.session import spread


def body_digests(chapters: DataFrame, least: int = 300) -> DataFrame:
    """(novel_id, chapter_number, digest) of bodies of at least ``least`` characters; rows stored again count once.

    Rows without a key are left out.  The digest comes out of a generator, because the optimizer would copy
    a plain expression into the filter and work out each body twice.
    """
    digest = F.transform(F.array(body(F.col("paragraphs_json"))), lambda b: F.when(F.length(b) >= least, digest16(b)))
    return (
        spread(chapters.select("novel_id", "chapter_number", "paragraphs_json"))
        .where("novel_id IS NOT NULL AND chapter_number IS NOT NULL")
        .select("novel_id", "chapter_number", F.explode(F.filter(digest, lambda d: d.isNotNull())).alias("digest"))
        .distinct()
        .where("digest IS NOT NULL")
    )


def repeats_in_novel(digests: DataFrame) -> DataFrame:
    """(novel_id, first_chapter, repeated_chapter, digest): each later chapter with the first that has its body.

    The first chapter of a body comes from a partial aggregation and is joined back, so that a body which
    fills a third of a table gathers nowhere.
    """
    first = digests.groupBy("novel_id", "digest").agg(F.min("chapter_number").alias("first_chapter"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        digests.join(first, ["novel_id", "digest"])
        .where("chapter_number > first_chapter")
        .select("novel_id", "first_chapter", F.col("chapter_number").alias("repeated_chapter"), "digest")
    )


def repeats_across(digests: DataFrame) -> DataFrame:
    """(digest, chapters, novels) of bodies that stand in more than one place."""
    return (
        digests.groupBy("digest", "novel_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.sum("n").alias("chapters"), F.count(F.lit(1)).alias("novels"))
        .where("chapters > 1")
    )


_ENTRY = ["novel_id", "first_chapter", "repeated_chapter", "digest"]


def unlisted_repeats(repeats: DataFrame, known: DataFrame) -> DataFrame:
    """Repeats that no entry of the list names with all four values."""
    return repeats.join(known.select(_ENTRY).distinct(), _ENTRY, "left_anti")


def listed_entries(known: DataFrame, digests: DataFrame) -> DataFrame:
    """Each distinct entry with its state: still_repeated, body_changed or chapter_gone."""
    now = digests.select("novel_id", F.col("chapter_number").alias("repeated_chapter"), F.col("digest").alias("now"))
    original = digests.select("novel_id", F.col("chapter_number").alias("first_chapter"), F.col("digest").alias("was"))
    entries = known.select(_ENTRY).distinct()
    state = (
        entries.join(now, ["novel_id", "repeated_chapter"], "left")
        .join(original, ["novel_id", "first_chapter"], "left")
        .groupBy(_ENTRY)
        .agg(
            F.count("now").alias("present"),
            F.max(F.coalesce((F.col("now") == F.col("digest")) & (F.col("was") == F.col("digest")), F.lit(False))).alias("fits"),
        )
    )
    return state.select(
        *_ENTRY, F.when(F.col("fits"), "still_repeated").when(F.col("present") > 0, "body_changed").otherwise("chapter_gone").alias("state")
    )
