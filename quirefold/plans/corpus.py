"""Queries over chapters, novels, routes and known duplicates."""

from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import bodies, store
from quirefold.session import spread
from quirefold.sources.tables import table

_BLANK = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_BODY = "lower(trim(regexp_replace(array_to_string(from_json(paragraphs_json, '[\"VARCHAR\"]'), ' '), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')))"
_DIGESTS = f"""WITH digests AS (SELECT DISTINCT novel_id, chapter_number, substr(sha256(b), 1, 16) AS digest
  FROM (SELECT novel_id, chapter_number, {_BODY} AS b FROM chapters WHERE novel_id IS NOT NULL AND chapter_number IS NOT NULL) WHERE length(b) >= 300)"""
_REPEATS = _DIGESTS + """, first AS (SELECT novel_id, digest, min(chapter_number) AS first_chapter FROM digests GROUP BY 1, 2),
repeats AS (SELECT novel_id, first_chapter, chapter_number AS repeated_chapter, digest
  FROM digests JOIN first USING (novel_id, digest) WHERE chapter_number > first_chapter)"""
_ROUTES = """WITH current AS (SELECT novel_id, database_id FROM (SELECT *, row_number() OVER (PARTITION BY novel_id
  ORDER BY assigned_at IS NOT NULL DESC, assigned_at DESC, route_id DESC) AS r FROM novel_shards WHERE novel_id IS NOT NULL) WHERE r = 1)"""
_PRESENT = "SELECT DISTINCT novel_id, chapter_number AS n FROM chapters WHERE novel_id IS NOT NULL AND chapter_number >= 1"


def _chapters(spark, d):
    return table(spark, d, "chapters")


def _digests(spark, d):
    return bodies.body_digests(_chapters(spark, d))


def repeated_bodies_by_novel(spark, d):
    return bodies.repeats_in_novel(_digests(spark, d))


def repeated_bodies_global(spark, d):
    return bodies.repeats_across(_digests(spark, d))


def unexpected_repeats(spark, d):
    return bodies.unlisted_repeats(repeated_bodies_by_novel(spark, d), table(spark, d, "known_chapter_duplicates"))


def known_repeat_states(spark, d):
    return bodies.listed_entries(table(spark, d, "known_chapter_duplicates"), _digests(spark, d))


def store_stats(spark, d):
    return store.stats(_chapters(spark, d))


def store_totals(spark, d):
    return store.totals(_chapters(spark, d))


def repeated_keys(spark, d):
    return store.repeated_keys(_chapters(spark, d))


def last_write(spark, d):
    return store.last_write(_chapters(spark, d)).select("novel_id", "chapter_number", "row_id", "ingested_at")


def first_write(spark, d):
    return store.first_write(_chapters(spark, d)).select("novel_id", "chapter_number", "row_id", "ingested_at")


_CUT = "2026-06-01"


def _split(spark, d):
    rows = _chapters(spark, d).where("novel_id IS NOT NULL AND chapter_number IS NOT NULL")
    early = F.col("ingested_at") < F.lit(_CUT).cast("timestamp")
    return store.first_write(rows.where(early)), rows.where(~early)


def missing_only_upsert(spark, d):
    return store.insert_missing(*_split(spark, d)).select("novel_id", "chapter_number", "row_id")


def overwrite_upsert(spark, d):
    return store.overwrite(*_split(spark, d)).select("novel_id", "chapter_number", "row_id")


def unbroken_runs(spark, d):
    return store.runs(_chapters(spark, d))


def missing_ranges(spark, d):
    return store.gaps(_chapters(spark, d))


def first_missing(spark, d):
    return store.first_missing(_chapters(spark, d), table(spark, d, "novels"))


def sequence_violations(spark, d):
    return store.out_of_sequence(_chapters(spark, d))


def chapter_neighbours(spark, d):
    return store.neighbours(_chapters(spark, d))


def inventory(spark, d):
    return store.inventory(table(spark, d, "novels"), _chapters(spark, d))


def tombstones(spark, d):
    """Removed chapters, and whether they still hold text."""
    rows = _chapters(spark, d).where("removed_duplicate")
    return rows.groupBy("novel_id").agg(
        F.count(F.lit(1)).alias("removed"), F.count_if(F.coalesce(F.trim("paragraphs_json"), F.lit("[]")) != "[]").alias("malformed")
    )


def route_conflicts(spark, d):
    return store.route_conflicts(table(spark, d, "novel_shards"), table(spark, d, "shards"))


def current_routes(spark, d):
    return store.current_routes(table(spark, d, "novel_shards"))


def shard_loads(spark, d):
    return store.shard_loads(_chapters(spark, d), table(spark, d, "novel_shards"), table(spark, d, "shards"))


def unrouted_novels(spark, d):
    """Novels with stored chapters but no route, and novels with a route but no chapters."""
    stored = _chapters(spark, d).where("novel_id IS NOT NULL").select("novel_id").distinct().withColumn("has_chapters", F.lit(True))
    routed = table(spark, d, "novel_shards").where("novel_id IS NOT NULL").select("novel_id").distinct().withColumn("has_route", F.lit(True))
    both = stored.join(routed, "novel_id", "full").where("has_chapters IS NULL OR has_route IS NULL")
    return both.select("novel_id", F.when(F.col("has_route").isNull(), "no_route").otherwise("no_chapters").alias("problem"))


def content_audit(spark, d):
    """The oldest against the newest row of each key: where title or paragraphs differ."""
    rows = _chapters(spark, d)
    return store.differing(store.first_write(rows), store.last_write(rows))


def corpus_digest(spark, d):
    return store.digests(store.last_write(_chapters(spark, d)))


def chunk_layout(spark, d):
    """Chapters per chunk file of each novel with chunks, and the file's name."""
    novels = table(spark, d, "novels").where("lazy_chunks IS NOT NULL")
    sizes = store.chunks(_chapters(spark, d), novels).groupBy("novel_id", "chunk").agg(F.count(F.lit(1)).alias("chapters"))
    return sizes.join(novels.select("novel_id", "lazy_chunks.prefix"), "novel_id").select(
        "novel_id", "chunk", "chapters", T.chunk_name(F.col("prefix"), F.col("chunk")).alias("file")
    )


def late_arrivals(spark, d):
    """Per novel: rows that came in a day or more after their update, the longest delay in seconds, rows without an update time."""
    delay = F.unix_timestamp("ingested_at") - F.unix_timestamp("updated_at")
    return (
        _chapters(spark, d)
        .groupBy("novel_id")
        .agg(F.count_if(delay >= 86400).alias("late"), F.max(delay).alias("longest_delay_s"), F.count_if(F.col("updated_at").isNull()).alias("undated"))
    )


def valid_paragraphs(spark, d):
    """Per novel: rows whose paragraphs are all valid, rows with too little text, paragraphs and characters in all."""
    p = T.paragraphs(F.col("paragraphs_json"))
    chars = F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x))
    return (
        spread(_chapters(spark, d).select("novel_id", "paragraphs_json"))
        .select("novel_id", p.alias("p"))
        .select(
            "novel_id",
            (F.forall("p", lambda x: T.collapsed(x) != "") & (F.size("p") > 0)).alias("valid"),
            ((F.size("p") < 3) | (chars < 250)).alias("short"),
            F.greatest(F.size("p"), F.lit(0)).alias("n"),
            F.coalesce(chars, F.lit(0)).alias("chars"),
        )
        .groupBy("novel_id")
        .agg(
            F.count_if("valid").alias("valid_rows"),
            F.count_if("short").alias("short_rows"),
            F.sum("n").alias("paragraphs"),
            F.sum("chars").cast("long").alias("chars"),
        )
    )


def title_labels(spark, d):
    """Titles whose first number a second one contradicts, the label they should bear, and its number."""
    label = T.unprefixed_title(F.col("title"))
    return (
        _chapters(spark, d)
        .select("row_id", "chapter_number", label.alias("label"), T.number_in_title(T.collapsed(label)).alias("label_number"), "title")
        .where("label <> title")
        .drop("title")
    )


QUERIES = {
    f.__name__: f
    for f in (
        repeated_bodies_by_novel, repeated_bodies_global, unexpected_repeats, known_repeat_states, store_stats, store_totals, repeated_keys,
        last_write, first_write, missing_only_upsert, overwrite_upsert, unbroken_runs, missing_ranges, first_missing, sequence_violations,
        chapter_neighbours, inventory, tombstones, route_conflicts, current_routes, shard_loads, unrouted_novels, content_audit, corpus_digest,
        chunk_layout, late_arrivals, valid_paragraphs, title_labels,
    )
}

_ISLANDS = f"""p AS ({_PRESENT}), g AS (SELECT novel_id, n, n - row_number() OVER (PARTITION BY novel_id ORDER BY n) AS i FROM p),
runs AS (SELECT novel_id, min(n) AS from_number, max(n) AS to_number FROM g GROUP BY novel_id, i)"""
_LAST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY novel_id, chapter_number ORDER BY ingested_at DESC, row_id DESC) AS r
  FROM chapters WHERE novel_id IS NOT NULL AND chapter_number IS NOT NULL) WHERE r = 1"""
_FIRST = _LAST.replace("ingested_at DESC, row_id DESC", "ingested_at, row_id")
_EARLY = _FIRST.replace("FROM chapters WHERE", f"FROM chapters WHERE ingested_at < TIMESTAMPTZ '{_CUT} 00:00:00+00' AND")
_LATE_LAST = _LAST.replace("FROM chapters WHERE", f"FROM chapters WHERE NOT (ingested_at < TIMESTAMPTZ '{_CUT} 00:00:00+00') AND")
_LATE_FIRST = _FIRST.replace("FROM chapters WHERE", f"FROM chapters WHERE NOT (ingested_at < TIMESTAMPTZ '{_CUT} 00:00:00+00') AND")

SQL = {
    "repeated_bodies_by_novel": _REPEATS + " SELECT * FROM repeats",
    "repeated_bodies_global": _DIGESTS
    + " SELECT digest, count(*) AS chapters, count(DISTINCT coalesce(novel_id, '-')) AS novels FROM digests GROUP BY digest HAVING count(*) > 1",
    "unexpected_repeats": _REPEATS + " SELECT * FROM repeats ANTI JOIN known_chapter_duplicates USING (novel_id, first_chapter, repeated_chapter, digest)",
    "known_repeat_states": _DIGESTS
    + """, k AS (SELECT DISTINCT novel_id, first_chapter, repeated_chapter, digest FROM known_chapter_duplicates)
SELECT k.novel_id, k.first_chapter, k.repeated_chapter, k.digest,
  CASE WHEN coalesce(max(CAST(r.digest = k.digest AND o.digest = k.digest AS INT)), 0) = 1 THEN 'still_repeated'
       WHEN count(r.digest) > 0 THEN 'body_changed' ELSE 'chapter_gone' END AS state
FROM k LEFT JOIN digests r ON r.novel_id = k.novel_id AND r.chapter_number = k.repeated_chapter
  LEFT JOIN digests o ON o.novel_id = k.novel_id AND o.chapter_number = k.first_chapter GROUP BY 1, 2, 3, 4""",
    "store_stats": "SELECT novel_id, count(*) AS stored, count(DISTINCT chapter_number) AS numbers, min(chapter_number) AS minimum, max(chapter_number) AS maximum FROM chapters GROUP BY novel_id",
    "store_totals": "SELECT count(*) AS stored, count(DISTINCT novel_id) AS novels, count(*) FILTER (WHERE novel_id IS NULL) AS without_novel FROM chapters",
    "repeated_keys": "SELECT novel_id, chapter_number, count(*) AS copies FROM chapters GROUP BY 1, 2 HAVING count(*) > 1",
    "last_write": f"SELECT novel_id, chapter_number, row_id, ingested_at FROM ({_LAST})",
    "first_write": f"SELECT novel_id, chapter_number, row_id, ingested_at FROM ({_FIRST})",
    "missing_only_upsert": f"""WITH s AS ({_EARLY}), i AS ({_LATE_FIRST}) SELECT novel_id, chapter_number, row_id FROM s
UNION ALL SELECT novel_id, chapter_number, row_id FROM i ANTI JOIN s USING (novel_id, chapter_number)""",
    "overwrite_upsert": f"""WITH s AS ({_EARLY}), i AS ({_LATE_LAST}) SELECT novel_id, chapter_number, row_id FROM i
UNION ALL SELECT novel_id, chapter_number, row_id FROM s ANTI JOIN i USING (novel_id, chapter_number)""",
    "unbroken_runs": f"WITH {_ISLANDS} SELECT * FROM runs",
    "missing_ranges": f"""WITH {_ISLANDS}, l AS (SELECT novel_id, coalesce(lag(to_number) OVER (PARTITION BY novel_id ORDER BY from_number), 0) + 1 AS a,
  from_number - 1 AS b FROM runs) SELECT novel_id, a AS from_number, b AS to_number FROM l WHERE a <= b""",
    "first_missing": f"""WITH p AS ({_PRESENT}), w AS (SELECT novel_id, unnest(range(1, coalesce(chapter_count, 0) + 1)) AS n FROM novels)
SELECT novels.novel_id, m.n AS first_missing FROM novels LEFT JOIN
  (SELECT novel_id, CAST(min(n) AS INT) AS n FROM w ANTI JOIN p USING (novel_id, n) GROUP BY novel_id) m USING (novel_id)""",
    "sequence_violations": """SELECT novel_id, numbers, minimum, maximum, maximum - numbers AS absent FROM (SELECT novel_id, count(DISTINCT chapter_number) AS numbers,
  min(chapter_number) AS minimum, max(chapter_number) AS maximum FROM chapters WHERE novel_id IS NOT NULL AND chapter_number IS NOT NULL GROUP BY novel_id)
WHERE minimum <> 1 OR maximum <> numbers""",
    "chapter_neighbours": """SELECT novel_id, chapter_number, lag(chapter_number) OVER w AS previous, lead(chapter_number) OVER w AS next FROM
 (SELECT DISTINCT novel_id, chapter_number FROM chapters WHERE NOT coalesce(removed_duplicate, false) AND paragraphs_json <> '[]'
  AND novel_id IS NOT NULL AND chapter_number >= 1) WINDOW w AS (PARTITION BY novel_id ORDER BY chapter_number)""",
    "inventory": """WITH s AS (SELECT novel_id, count(*) AS stored, CAST(sum(r) AS BIGINT) AS removed FROM (SELECT novel_id, chapter_number,
  max(CAST(coalesce(removed_duplicate, false) AS INT)) AS r FROM chapters WHERE novel_id IS NOT NULL AND chapter_number IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT coalesce(n.novel_id, s.novel_id) AS novel_id, chapter_count AS slots, coalesce(stored, 0) AS stored, coalesce(removed, 0) AS removed,
  coalesce(stored, 0) - coalesce(removed, 0) AS readable, greatest(coalesce(chapter_count, 0) - coalesce(stored, 0), 0) AS remaining,
  n.novel_id IS NULL AS historical FROM novels n FULL JOIN s ON s.novel_id = n.novel_id""",
    "tombstones": """SELECT novel_id, count(*) AS removed, count(*) FILTER (WHERE coalesce(trim(paragraphs_json), '[]') <> '[]') AS malformed
FROM chapters WHERE removed_duplicate GROUP BY novel_id""",
    "route_conflicts": _ROUTES
    + """ SELECT c.novel_id, n.databases, c.database_id AS current_database, s.database_id IS NOT NULL AS known FROM current c
JOIN (SELECT novel_id, count(DISTINCT database_id) AS databases FROM novel_shards GROUP BY 1) n USING (novel_id)
LEFT JOIN shards s ON s.database_id = c.database_id WHERE n.databases > 1 OR s.database_id IS NULL""",
    "current_routes": _ROUTES + " SELECT * FROM current",
    "shard_loads": _ROUTES
    + """ SELECT shard_name, count(c.novel_id) AS novels, CAST(coalesce(sum(n), 0) AS BIGINT) AS stored, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes
FROM shards LEFT JOIN current c USING (database_id) LEFT JOIN (SELECT novel_id, count(*) AS n, sum(strlen(paragraphs_json)) AS b FROM chapters GROUP BY 1) USING (novel_id)
GROUP BY shard_name""",
    "unrouted_novels": """SELECT coalesce(a.novel_id, b.novel_id) AS novel_id, CASE WHEN b.novel_id IS NULL THEN 'no_route' ELSE 'no_chapters' END AS problem
FROM (SELECT DISTINCT novel_id FROM chapters WHERE novel_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT novel_id FROM novel_shards WHERE novel_id IS NOT NULL) b
ON a.novel_id = b.novel_id WHERE a.novel_id IS NULL OR b.novel_id IS NULL""",
    "content_audit": f"""WITH a AS ({_FIRST}), b AS ({_LAST}) SELECT novel_id, chapter_number, 'unequal' AS problem FROM a JOIN b USING (novel_id, chapter_number)
WHERE a.title IS DISTINCT FROM b.title OR from_json(a.paragraphs_json, '["VARCHAR"]') IS DISTINCT FROM from_json(b.paragraphs_json, '["VARCHAR"]')""",
    "corpus_digest": f"""WITH c AS (SELECT novel_id, chapter_number, chapter_number // 1000 AS block,
  sha256(concat_ws(chr(10), CAST(chapter_number AS VARCHAR), coalesce(title, ''), coalesce(paragraphs_json, ''))) AS d FROM ({_LAST})),
b AS (SELECT novel_id, block, sha256(string_agg(d, chr(10) ORDER BY chapter_number)) AS d FROM c GROUP BY 1, 2)
SELECT novel_id, sha256(string_agg(d, chr(10) ORDER BY block)) AS digest FROM b GROUP BY 1""",
    "chunk_layout": f"""SELECT novel_id, CAST((n - 1) // lazy_chunks.capacity + 1 AS INT) AS chunk, count(*) AS chapters,
  lazy_chunks.prefix || lpad(CAST((n - 1) // lazy_chunks.capacity + 1 AS VARCHAR), CAST(greatest(2, length(CAST((n - 1) // lazy_chunks.capacity + 1 AS VARCHAR))) AS INT), '0') || '.js' AS file
FROM ({_PRESENT}) JOIN novels USING (novel_id) WHERE lazy_chunks IS NOT NULL GROUP BY ALL""",
    "late_arrivals": """SELECT novel_id, count(*) FILTER (WHERE s >= 86400) AS late, CAST(max(s) AS BIGINT) AS longest_delay_s, count(*) FILTER (WHERE updated_at IS NULL) AS undated
FROM (SELECT *, CAST(floor(epoch(ingested_at)) - floor(epoch(updated_at)) AS BIGINT) AS s FROM chapters) GROUP BY novel_id""",
    "valid_paragraphs": """WITH t AS (SELECT novel_id, from_json(paragraphs_json, '["VARCHAR"]') AS p FROM chapters),
u AS (SELECT novel_id, p, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS chars,
  list_filter(p, lambda x: trim(regexp_replace(x, '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')) = '') AS blank FROM t)
SELECT novel_id, count(*) FILTER (WHERE p IS NOT NULL AND len(blank) = 0 AND len(p) > 0) AS valid_rows,
  count(*) FILTER (WHERE p IS NOT NULL AND (len(p) < 3 OR chars < 250)) AS short_rows,
  CAST(sum(coalesce(len(p), 0)) AS BIGINT) AS paragraphs, CAST(sum(chars) AS BIGINT) AS chars FROM u GROUP BY novel_id""",
    "title_labels": f"""SELECT row_id, chapter_number, label, TRY_CAST(regexp_extract(regexp_replace(label, '{_BLANK}+', ' ', 'g'), '(?i)^ *ch(?:apter|\\.)? *([0-9]{{1,9}})(?:[^0-9]|$)', 1) AS INT) AS label_number
FROM (SELECT *, regexp_replace(regexp_replace(title, '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g'), '(?i)^{_BLANK}*chapter{_BLANK}+[0-9.]+{_BLANK}*:{_BLANK}*(chapter{_BLANK}+[0-9]+)', '\\1') AS label
  FROM chapters) WHERE label <> title""",
}
