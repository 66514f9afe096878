"""The store of numbered chapters: statistics, gaps, versions, inventory, routes, audits.

No operator here windows over all rows of a novel: gaps and neighbours come from joins on (novel, number), and windows
run over the ends of unbroken runs only, so one novel may hold any share of the rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["novel_id", "chapter_number"]


def stats(chapters: DataFrame) -> DataFrame:
    """Rows, distinct numbers, first and last number per novel.

    Two steps: by (novel, number), then by novel, both with partial sums.
    """
    return (
        chapters.groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("novel_id")
        .agg(
            F.sum("n").alias("stored"),
            F.count("chapter_number").alias("numbers"),
            F.min("chapter_number").alias("minimum"),
            F.max("chapter_number").alias("maximum"),
        )
    )


def totals(chapters: DataFrame) -> DataFrame:
    """One row: all rows, exact number of novels, rows without a novel."""
    return (
        chapters.groupBy("novel_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("stored"), F.count("novel_id").alias("novels"), F.sum(F.when(F.col("novel_id").isNull(), F.col("n")).otherwise(0)).alias("without_novel"))
    )


def repeated_keys(chapters: DataFrame) -> DataFrame:
    """(novel_id, chapter_number, copies) of keys stored more than once."""
    return chapters.groupBy(KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _version(chapters: DataFrame, pick: Column) -> DataFrame:
    kept = chapters.where("novel_id IS NOT NULL AND chapter_number IS NOT NULL").groupBy(KEY).agg(pick.alias("row_id"))
    return chapters.join(kept.select("row_id"), "row_id", "left_semi")


def last_write(chapters: DataFrame) -> DataFrame:
    """The newest row of each key: an upsert that overwrites.  Bodies are not shuffled to be compared, only ids are."""
    return _version(chapters, F.max_by("row_id", F.struct("ingested_at", "row_id")))


def first_write(chapters: DataFrame) -> DataFrame:
    """The oldest row of each key: an insert that does nothing on conflict."""
    return _version(chapters, F.min_by("row_id", F.struct("ingested_at", "row_id")))


def insert_missing(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` and the rows of ``incoming`` whose key is not stored; of several such rows the oldest."""
    return stored.unionByName(first_write(incoming).join(stored.select(KEY), KEY, "left_anti"))


def overwrite(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` and the rows of ``stored`` whose key does not come in."""
    new = last_write(incoming)
    return stored.join(new.select(KEY), KEY, "left_anti").unionByName(new)


def runs(chapters: DataFrame) -> DataFrame:
    """(novel_id, from_number, to_number) of unbroken runs of numbers, from 1 up."""
    present = chapters.select(KEY).where("novel_id IS NOT NULL AND chapter_number >= 1").distinct()
    before = present.select("novel_id", (F.col("chapter_number") + 1).alias("chapter_number"))
    after = present.select("novel_id", (F.col("chapter_number") - 1).alias("chapter_number"))
    starts = present.join(before, KEY, "left_anti").select(*KEY, F.lit(0).alias("is_end"))
    ends = present.join(after, KEY, "left_anti").select(*KEY, F.lit(1).alias("is_end"))
    order = W.partitionBy("novel_id").orderBy("chapter_number", "is_end")
    return (
        starts.unionByName(ends)
        .withColumn("to_number", F.lead("chapter_number").over(order))
        .where("is_end = 0")
        .select("novel_id", F.col("chapter_number").alias("from_number"), "to_number")
    )


def gaps(chapters: DataFrame) -> DataFrame:
    """(novel_id, from_number, to_number) of numbers missing between 1 and the last stored one."""
    order = W.partitionBy("novel_id").orderBy("from_number")
    before = F.coalesce(F.lag("to_number").over(order), F.lit(0))
    return (
        runs(chapters)
        .select("novel_id", (before + 1).alias("first"), (F.col("from_number") - 1).alias("last"))
        .where("first <= last")
        .select("novel_id", F.col("first").alias("from_number"), F.col("last").alias("to_number"))
    )


def first_missing(chapters: DataFrame, novels: DataFrame) -> DataFrame:
    """(novel_id, first_missing) of each novel of the catalog: 1 if nothing is stored, null if 1..chapter_count is complete."""
    head = runs(chapters).where("from_number = 1").select("novel_id", (F.col("to_number") + 1).alias("next"))
    found = F.coalesce("next", F.lit(1))
    return novels.join(head, "novel_id", "left").select("novel_id", F.when(found <= F.col("chapter_count"), found).alias("first_missing"))


def out_of_sequence(chapters: DataFrame) -> DataFrame:
    """Novels whose distinct numbers are not exactly 1..N, and by how much."""
    return (
        stats(chapters.where("novel_id IS NOT NULL AND chapter_number IS NOT NULL"))
        .where("minimum <> 1 OR maximum <> numbers")
        .select("novel_id", "numbers", "minimum", "maximum", (F.col("maximum") - F.col("numbers")).alias("absent"))
    )


def readable() -> Column:
    return ~F.coalesce(F.col("removed_duplicate"), F.lit(False)) & (F.col("paragraphs_json") != "[]")


def neighbours(chapters: DataFrame) -> DataFrame:
    """(novel_id, chapter_number, previous, next) of readable chapters, removed ones passed over.

    A neighbour is the number beside, or, at the end of a run, the near end of the next run.
    """
    kept = chapters.where(readable()).select(KEY).where("novel_id IS NOT NULL AND chapter_number >= 1").distinct()
    order = W.partitionBy("novel_id").orderBy("from_number")
    ends = runs(kept).select(
        "novel_id", "from_number", "to_number", F.lag("to_number").over(order).alias("before"), F.lead("from_number").over(order).alias("after")
    )
    left = ends.select("novel_id", F.col("from_number").alias("chapter_number"), "before", F.lit(True).alias("at_start"))
    right = ends.select("novel_id", F.col("to_number").alias("chapter_number"), "after", F.lit(True).alias("at_end"))
    return (
        kept.join(left, KEY, "left")
        .join(right, KEY, "left")
        .select(
            *KEY,
            F.when(F.col("at_start"), F.col("before")).otherwise(F.col("chapter_number") - 1).alias("previous"),
            F.when(F.col("at_end"), F.col("after")).otherwise(F.col("chapter_number") + 1).alias("next"),
        )
    )


def inventory(novels: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per novel of catalog or store: slots, stored, removed, readable, remaining, and whether it is historical."""
    by_key = (
        chapters.where("novel_id IS NOT NULL AND chapter_number IS NOT NULL")
        .groupBy(KEY)
        .agg(F.max(F.coalesce(F.col("removed_duplicate"), F.lit(False)).cast("int")).alias("removed"))
    )
    stored = by_key.groupBy("novel_id").agg(F.count(F.lit(1)).alias("stored"), F.sum("removed").alias("removed"))
    catalog = novels.select("novel_id", F.col("chapter_count").alias("slots"), F.lit(True).alias("listed"))
    n, r = F.coalesce("stored", F.lit(0)), F.coalesce("removed", F.lit(0))
    return catalog.join(stored, "novel_id", "full").select(
        "novel_id",
        "slots",
        n.alias("stored"),
        r.alias("removed"),
        (n - r).alias("readable"),
        F.greatest(F.coalesce("slots", F.lit(0)) - n, F.lit(0)).alias("remaining"),
        F.col("listed").isNull().alias("historical"),
    )


def current_routes(routes: DataFrame) -> DataFrame:
    """(novel_id, database_id): the newest route; rows without a time are oldest, ties go to the larger route_id."""
    order = F.struct(F.col("assigned_at").isNotNull(), "assigned_at", "route_id")
    return routes.where("novel_id IS NOT NULL").groupBy("novel_id").agg(F.max_by("database_id", order).alias("database_id"))


def route_conflicts(routes: DataFrame, shards: DataFrame) -> DataFrame:
    """Novels with routes to several databases, or whose current route names no known one."""
    named = routes.where("novel_id IS NOT NULL").groupBy("novel_id", "database_id").agg(F.count(F.lit(1)).alias("n"))
    spread = named.groupBy("novel_id").agg(F.count("database_id").alias("databases"))
    known = shards.select("database_id", F.lit(True).alias("known"))
    return (
        current_routes(routes)
        .join(F.broadcast(known), "database_id", "left")
        .join(spread, "novel_id")
        .where("databases > 1 OR known IS NULL")
        .select("novel_id", "databases", F.col("database_id").alias("current_database"), F.col("known").isNotNull().alias("known"))
    )


def shard_loads(chapters: DataFrame, routes: DataFrame, shards: DataFrame) -> DataFrame:
    """Per database: novels routed there, their stored rows and bytes.  Rows are summed by novel before the join."""
    sums = chapters.groupBy("novel_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("paragraphs_json")).alias("b"))
    placed = current_routes(routes).join(sums, "novel_id", "left")
    per = placed.groupBy("database_id").agg(
        F.count(F.lit(1)).alias("novels"), F.coalesce(F.sum("n"), F.lit(0)).alias("stored"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")
    )
    return shards.join(per, "database_id", "left").select(
        "shard_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("novels", "stored", "bytes")]
    )


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(novel_id, chapter_number, problem) of keys of two stores that do not hold the same title and paragraphs.

    Texts are compared by digest, so only 64 characters per row are shuffled; the paragraphs, not their JSON, count.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        text = F.to_json(F.struct(F.col("title").alias("t"), F.from_json("paragraphs_json", "array<string>").alias("p")))
        return df.select(*KEY, F.sha2(text, 256).alias(name))

    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("unequal")
    return side(left, "a").join(side(right, "b"), KEY, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*KEY, problem.alias("problem"))


def digests(chapters: DataFrame, block: int = 1000) -> DataFrame:
    """(novel_id, digest): the content of each novel in order of numbers, by blocks of ``block`` numbers.

    A block's digest covers its chapters in order, the novel's its blocks in order, so no task holds a whole novel.
    """
    one = F.sha2(F.concat_ws("\n", F.col("chapter_number").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("paragraphs_json", F.lit(""))), 256)

    def joined(order: str, value: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(order, value)))
        return F.sha2(F.array_join(F.transform(pairs, lambda p: p[value]), "\n"), 256)

    rows = chapters.where("novel_id IS NOT NULL AND chapter_number IS NOT NULL").select(*KEY, F.floor(F.col("chapter_number") / block).alias("block"), one.alias("d"))
    return (
        rows.groupBy("novel_id", "block").agg(joined("chapter_number", "d").alias("d")).groupBy("novel_id").agg(joined("block", "d").alias("digest"))
    )


def chunks(chapters: DataFrame, novels: DataFrame, files: int | None = None, least: int = 100) -> DataFrame:
    """(novel_id, chapter_number, chunk): the chunk file of each chapter.

    The capacity is the novel's own, or ``least`` where it has none; with ``files`` it is whatever gives that many files.
    """
    own = F.coalesce(F.col("lazy_chunks.capacity"), F.lit(least))
    capacity = own if files is None else F.greatest(F.lit(least), F.ceil(F.col("chapter_count") / files)).cast("int")
    # Catalogs are small beside the store, but may outgrow a broadcast: Spark decides by their size.
    sized = novels.select("novel_id", capacity.alias("capacity"))
    rows = chapters.select(KEY).where("novel_id IS NOT NULL AND chapter_number >= 1").distinct()
    return rows.join(sized, "novel_id").select(*KEY, (F.floor((F.col("chapter_number") - 1) / F.col("capacity")) + 1).cast("int").alias("chunk"))
