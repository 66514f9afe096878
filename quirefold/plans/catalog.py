"""Queries over the catalog, the registry of found titles, documents and events."""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import html as H
from quirefold.functions import text as T
from quirefold.operators import activity, placement, prefix, reader, schedule, screening, store
from quirefold.session import checkpoint_folder, spread
from quirefold.sources import files
from quirefold.sources.tables import table
from quirefold.streaming import releases

NOW = "2026-10-11 09:00:00"
#: Rules of the classifier, in order.  Fixed values.
GENRES = [
    ("Romance", ["romance", "marriage", "husband", "wife", "love", "heiress"]),
    ("Action", ["action", "battle", "war", "martial", "fighter"]),
    ("Fantasy", ["fantasy", "magic", "system", "cultivation", "transmigration", "reincarnation"]),
    ("Sci-fi", ["sci-fi", "apocalypse", "interstellar", "space", "technology"]),
    ("Mystery", ["mystery", "crime", "detective", "forensic", "thriller"]),
    ("Historical", ["historical", "ancient", "emperor", "imperial", "marquis", "dynasty"]),
    ("Game", ["game", "vrmmo", "player"]),
]


def _stored(spark, d):
    return store.stats(table(spark, d, "chapters").where("novel_id IS NOT NULL AND chapter_number IS NOT NULL"))


def least_complete_first(spark, d):
    return schedule.least_complete_first(table(spark, d, "novels"), _stored(spark, d))


def budgeted_selection(spark, d):
    return schedule.budgeted(least_complete_first(spark, d), F.col("total") - F.col("stored"), 25, 400)


def numbers_to_load(spark, d):
    """The chapters that the next run loads: first gaps up to chapter_count, at most 25 per novel and 400 in all."""
    novels = table(spark, d, "novels").where("chapter_count > 0")
    inner = store.gaps(table(spark, d, "chapters"))
    tail = (
        novels.join(_stored(spark, d), "novel_id", "left")
        .select("novel_id", (F.coalesce("maximum", F.lit(0)) + 1).alias("from_number"), F.col("chapter_count").alias("to_number"))
        .where("from_number <= to_number")
    )
    known = novels.select("novel_id", "chapter_count")
    ranges = inner.join(known, "novel_id").select("novel_id", "from_number", F.least("to_number", "chapter_count").alias("to_number"))
    missing = ranges.where("from_number <= to_number").unionByName(tail)
    return schedule.next_numbers(missing, budgeted_selection(spark, d))


def rotation_slice(spark, d):
    return schedule.rotation(table(spark, d, "novels").select("novel_id"), "novel_id", 30, 45)


def priority_queue(spark, d):
    registry = table(spark, d, "auto_freewebnovel").groupBy("id").agg(F.min("discovery_rank").alias("rank"))
    queue = schedule.priority_then_rotation(registry, "id", "rank", "id", 10, 15, 45)
    return queue.select("id", "rank", "queue", "place")


def daily_budget(spark, d):
    """Events as requests that each cost their value in whole units, against a daily budget."""
    requests = table(spark, d, "events").select(
        "event_id", F.to_date("ts").alias("day"), "ts", F.coalesce(F.ceil(F.abs("value")).cast("long"), F.lit(0)).alias("cost")
    )
    return schedule.reserved(requests, "day", ["ts", "event_id"], "event_id", "cost", 2000).withColumnRenamed("id", "event_id")


def running_totals(spark, d):
    """Per customer, the running number of orders and their value in cents, by order date."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return prefix.running_sum(orders, "o_custkey", F.date_trunc("year", "o_orderdate"), ["o_orderdate", "o_orderkey"], "cents", "running_cents").select(
        "o_orderkey", "running_cents"
    )


def catch_up_targets(spark, d):
    """How far each novel's next checkpoint goes: at most 100 chapters further, never back."""
    stored = F.coalesce(F.col("numbers"), F.lit(0))
    return (
        table(spark, d, "novels")
        .join(_stored(spark, d), "novel_id", "left")
        .select("novel_id", schedule.target_count(stored, F.coalesce(F.col("chapter_count").cast("long"), F.lit(0).cast("long")), 100).alias("target"))
    )


def _volumes(spark, d):
    sums = (
        table(spark, d, "chapters")
        .where("novel_id IS NOT NULL")
        .groupBy("novel_id")
        .agg(F.coalesce(F.sum(F.octet_length("paragraphs_json")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n"))
    )
    return sums.select("novel_id", placement.projected_bytes(F.col("b"), F.col("n")).alias("bytes"))


def capacity_forecast(spark, d):
    return _volumes(spark, d)


def largest_novels(spark, d):
    return _volumes(spark, d).orderBy(F.col("bytes").desc(), "novel_id").limit(8)


def _loads(spark, d):
    return {r["shard_name"]: 0 for r in table(spark, d, "shards").select("shard_name").collect()}


def lpt_placement(spark, d):
    """Novels without a valid route on the lightest of the shards, routed ones where they are; loads start at what is stored."""
    shards = table(spark, d, "shards").select("shard_name", "database_id")
    where = store.current_routes(table(spark, d, "novel_shards")).join(F.broadcast(shards), "database_id").select("novel_id", F.col("shard_name").alias("pinned"))
    volumes = _volumes(spark, d).join(where, "novel_id", "left")
    held = {r["pinned"]: r["b"] for r in volumes.where("pinned IS NOT NULL").groupBy("pinned").agg(F.sum("bytes").alias("b")).collect()}
    return placement.least_loaded(volumes, _loads(spark, d) | held)


def lpt_fresh_placement(spark, d):
    """All novels on empty shards, largest first to the lightest, none beyond 300 MiB."""
    volumes = _volumes(spark, d).withColumn("pinned", F.lit(None).cast("string"))
    return placement.least_loaded(volumes, _loads(spark, d), 300 << 20)


def best_fit_placement(spark, d):
    return placement.best_fit(_volumes(spark, d), 12 << 20)


def lag_audit(spark, d):
    """How far each novel's catalog count lags behind the best evidence: stored numbers, the catalog, or titles."""
    titled = table(spark, d, "chapters").groupBy("novel_id").agg(F.max(T.number_in_title(F.col("title"))).alias("titled"))
    evidence = table(spark, d, "novels").join(_stored(spark, d), "novel_id", "left").join(titled, "novel_id", "left")
    audited = activity.best_evidence(evidence, ["maximum", "chapter_count", "titled"], F.col("chapter_count"))
    return audited.select("novel_id", "tip", "evidence", "behind")


def _observations(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("key"),
        F.col("ts").alias("at"),
        "event_id",
        F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("tip"),
        (F.col("event_type") != "purchase").alias("ongoing"),
    )


def release_tracker(spark, d):
    states = activity.release_states(_observations(spark, d), "key", ["at", "event_id"], "tip", "ongoing", "at")
    return states.select("event_id", "seen", "release_number", "first_number", "released_at")


def scan_tracker(spark, d):
    """The variant in which a tip above all earlier ones is a release whatever the status."""
    states = activity.release_states(_observations(spark, d), "key", ["at", "event_id"], "tip", "ongoing", "at", clears=False)
    return states.select("event_id", "seen", "release_number", "first_number", "released_at")


def activity_feed(spark, d):
    """Novels with a chapter that came in less than five days before the clock, newest first."""
    last = table(spark, d, "chapters").where(F.col("ingested_at") <= F.lit(NOW).cast("timestamp")).groupBy("novel_id").agg(F.max("ingested_at").alias("observed_at"))
    items = table(spark, d, "novels").join(last, "novel_id").withColumn("age_s", F.lit(0))
    shown = activity.feed(items, "observed_at", "age_s", F.lit(NOW).cast("timestamp"))
    labelled = shown.select("novel_id", "observed_at", "effective_age_s", T.age_label(F.col("effective_age_s")).alias("label"))
    return labelled.orderBy("effective_age_s", "novel_id")


def record_lifecycle(spark, d):
    """Registry entries by id: found once and again; a later find replaces, one without a rank deletes."""
    order = F.struct("discovered_at", "entry_id")
    rows = table(spark, d, "auto_freewebnovel")
    before = rows.groupBy("id").agg(F.min_by(F.struct("title", "discovery_rank"), order).alias("x"), F.count(F.lit(1)).alias("n"))
    after = rows.groupBy("id").agg(F.max_by(F.struct("title", "discovery_rank"), order).alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1")
    outcome = F.when(F.col("y.discovery_rank").isNull(), "unverifiable").otherwise("verified")
    return activity.merged_records(
        before.select("id", "x.title", "x.discovery_rank"), after.select("id", outcome.alias("outcome"), "y.title", "y.discovery_rank"), "id", ["title", "discovery_rank"]
    )


def chapter_alerts(spark, d):
    """Customers as readers: orders are saved novels and what was seen of them."""
    n = table(spark, d, "novels").select("novel_id", "chapter_count")
    count = n.count()
    ranked = n.select("novel_id", (F.row_number().over(W.orderBy("novel_id")) - 1).alias("place"), "chapter_count")
    reads = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.pmod(F.col("o_orderkey"), F.lit(max(1, count))).cast("int").alias("place"))
    both = reads.join(ranked, "place").select(F.col("o_custkey").alias("user_id"), "novel_id", F.pmod(F.col("o_orderkey"), F.lit(60)).cast("int").alias("number"))
    seen = both.groupBy("user_id", "novel_id").agg(F.max("number").alias("seen"))
    releases = n.join(_stored(spark, d), "novel_id").select(
        "novel_id", (F.col("chapter_count") - 4).alias("first_number"), F.col("chapter_count").alias("release_number"), F.col("maximum").alias("stored")
    )
    return activity.alerts(seen.select("user_id", "novel_id"), seen, releases)


def bookmark_merge(spark, d):
    """Three sides of each reader's bookmarks, taken from kinds of events."""
    e = table(spark, d, "events").select("user_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).alias("novel"), "event_type", "event_id")
    parts = [e.where(F.pmod("event_id", F.lit(5)).isin(*k)).select("user_id", "novel") for k in ((0, 1), (1, 2), (0, 3))]
    return reader.three_way_sets(*parts, ["user_id", "novel"])


def reading_progress(spark, d):
    """The last position of each reader by kind of event."""
    return reader.newest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", ["event_id", "value"])


def newest_positions(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    return reader.newest_of_each(rows, "user_id", "ts", "event_id", 20).select("user_id", "event_id", "place")


def screening_counts(spark, d):
    return screening.screen(table(spark, d, "documents"), "source", "doc_id", "text")


def genre_by_words(spark, d):
    """Genre by the first rule one of whose words stands in title or synopsis, the names of all such rules, and a summary."""
    tags = T.matching_rules(F.concat_ws(" ", "title", "synopsis"), GENRES, "Fantasy", 6)
    rows = table(spark, d, "auto_freewebnovel").select("entry_id", tags.alias("tags"), T.shortened(F.col("synopsis"), 158).alias("summary"))
    return rows.select("entry_id", F.col("tags")[0].alias("genre"), "tags", "summary")


def tags_in_use(spark, d):
    tags = table(spark, d, "novels").select("novel_id", F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.countDistinct("novel_id").alias("novels"))


def undiscovered_titles(spark, d):
    """Registry ids, first seen first, that the catalog does not have."""
    first = table(spark, d, "auto_freewebnovel").groupBy("slug").agg(F.min("entry_id").alias("first_entry"))
    return first.join(table(spark, d, "novels").select(F.col("novel_id").alias("slug")), "slug", "left_anti")


def age_labels(spark, d):
    """Ages of documents in words, and the words read back."""
    age = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("fetched_at")
    rows = table(spark, d, "documents").select("doc_id", age.alias("age_s"))
    label = T.age_label(F.col("age_s"))
    return rows.select("doc_id", label.alias("label"), T.age_seconds(label).alias("read_back_s"))


def _pages(spark, d):
    """Stored pages: each document's lines as a page of a reading site."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: F.concat(F.lit("<p>"), T.html_escaped(x), F.lit("</p>")))
    html = F.concat(
        F.lit("<html><head><title>x</title><script>var t = '<p>no text</p>';</script></head><body><nav><a href=\"/\">Home</a></nav><div><h1>"),
        T.html_escaped(F.coalesce("novel_id", F.lit(""))),
        F.lit("</h1>"),
        F.array_join(lines, ""),
        F.lit('</div><a href="/novel/'),
        F.coalesce("novel_id", F.lit("none")),
        F.lit('">More</a></body></html>'),
    )
    documents = spread(table(spark, d, "documents").select("doc_id", "novel_id", "text"))
    return documents.where("text IS NOT NULL").select("doc_id", "novel_id", "text", html.alias("html"))


def page_links(spark, d):
    return _pages(spark, d).select("doc_id", F.posexplode(T.attribute_values(F.col("html"), "href")).alias("position", "href"))


def page_titles(spark, d):
    return _pages(spark, d).select("doc_id", T.first_heading(F.col("html"), F.lit("untitled")).alias("title"))


def page_word_counts(spark, d):
    return _pages(spark, d).select("doc_id", T.word_count(T.visible_text(F.col("html"))).alias("words"))


def page_content(spark, d):
    """Paragraphs of the main block of each page by its element tree."""
    p = H.content_paragraphs("html")
    return _pages(spark, d).select("doc_id", p.alias("p")).select("doc_id", F.size("p").alias("paragraphs"), F.sha2(F.array_join("p", "\n"), 256).alias("digest"))


def page_anchors(spark, d):
    return _pages(spark, d).select("doc_id", F.explode(H.links("html")).alias("a")).select("doc_id", "a.href", "a.label")


def text_keys(spark, d):
    """Compatible form, slug and key of registry titles."""
    rows = table(spark, d, "auto_freewebnovel").where("title IS NOT NULL")
    return rows.select("entry_id", T.compatible("title").alias("plain"), T.slug("title").alias("slug_of_title"), T.title_key("title").alias("title_key"))


def upsert_export(spark, d):
    """SQL statements that store each chapter, by digest, and whether they fit a statement."""
    rows = files.upsert_statements(store.last_write(table(spark, d, "chapters")))
    return rows.select("novel_id", "chapter_number", F.sha2("statement", 256).alias("digest"), "fits")


def escaped_titles(spark, d):
    """Titles as they stand in HTML and in SQL, and their length in UTF-16 units."""
    t = F.col("title")
    return table(spark, d, "chapters").where("title IS NOT NULL").select(
        "row_id", T.html_escaped(t).alias("html"), T.sql_quoted(t).alias("sql"), T.utf16_length(t).cast("long").alias("utf16_length")
    )


def sitemap_files(spark, d):
    """URLs of readable chapters of visible novels per sitemap file of at most 2,000."""
    hidden = table(spark, d, "novels").where("discovery_hidden").select("novel_id")
    rows = table(spark, d, "chapters").where(store.readable() & F.col("novel_id").isNotNull()).select("novel_id", "chapter_number").join(hidden, "novel_id", "left_anti")
    urls = rows.select(F.concat(F.lit("/novel/"), "novel_id", F.lit("/"), F.col("chapter_number").cast("string")).alias("url"))
    return files.sitemap_pages(urls, "url", 2000).groupBy("sitemap").agg(F.count(F.lit(1)).alias("urls"))


def release_stream(spark, d):
    """The stateful stream over all events, worked off once; the state after each observation."""
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    observed = source.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").alias("at"),
        F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("tip"),
        (F.col("event_type") != "purchase").alias("ongoing"),
    )
    folder = f"{checkpoint_folder(spark)}/releases-{uuid.uuid4().hex}"
    return releases.run_available(observed, f"{folder}/states", f"{folder}/checkpoint")


QUERIES = {
    f.__name__: f
    for f in (
        least_complete_first, budgeted_selection, numbers_to_load, rotation_slice, priority_queue, daily_budget, running_totals, catch_up_targets,
        capacity_forecast, largest_novels, lpt_placement, lpt_fresh_placement, best_fit_placement, lag_audit, release_tracker, scan_tracker,
        activity_feed, record_lifecycle, chapter_alerts, bookmark_merge, reading_progress, newest_positions, screening_counts, genre_by_words,
        tags_in_use, undiscovered_titles, age_labels, page_links, page_titles, page_word_counts, page_content, page_anchors, text_keys,
        upsert_export, escaped_titles, sitemap_files, release_stream,
    )
}

_STORED = """stored AS (SELECT novel_id, count(DISTINCT chapter_number) AS numbers, max(chapter_number) AS maximum FROM chapters
  WHERE novel_id IS NOT NULL AND chapter_number IS NOT NULL GROUP BY 1)"""
_QUEUE = f"""WITH {_STORED}, q AS (SELECT *, row_number() OVER (ORDER BY stored / total, novel_id) AS rank FROM
  (SELECT novel_id, coalesce(numbers, 0) AS stored, chapter_count AS total FROM novels LEFT JOIN stored USING (novel_id) WHERE chapter_count > 0)
  WHERE stored < total)"""
_BUDGET = _QUEUE + """, b AS (SELECT *, least(25, total - stored) AS want FROM q),
g AS (SELECT *, CAST(least(want, greatest(400 - coalesce(sum(want) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS granted FROM b)"""
_VOLUMES = """v AS (SELECT novel_id, CAST(ceil(1.7 * coalesce(sum(strlen(paragraphs_json)), 0) + 256 * count(*) + 1048576) AS BIGINT) AS bytes
  FROM chapters WHERE novel_id IS NOT NULL GROUP BY novel_id)"""
_OBSERVED = """o AS (SELECT user_id AS key, ts AS seen_at, event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS tip,
  event_type <> 'purchase' AS ongoing FROM events),
p AS (SELECT *, coalesce(max(tip) OVER (PARTITION BY key ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM o)"""


def _tracker(rel: str, clr: str) -> str:
    return f"""WITH {_OBSERVED}, r AS (SELECT *, {rel} AS rel FROM p), c AS (SELECT *, NOT rel AND ({clr}) AS clr FROM r),
s AS (SELECT *, sum(CAST(clr AS INT)) OVER (PARTITION BY key ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM c)
SELECT event_id, greatest(prev, tip) AS seen, max(CASE WHEN rel THEN tip END) OVER w AS release_number,
  min(CASE WHEN rel THEN prev + 1 END) OVER w AS first_number, max(CASE WHEN rel THEN seen_at END) OVER w AS released_at
FROM s WINDOW w AS (PARTITION BY key, seg ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING)"""


_LPT = f"""WITH RECURSIVE {_VOLUMES}, q AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, novel_id) AS i FROM v),
names AS (SELECT list(shard_name ORDER BY shard_name) AS s FROM shards),
walk AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS loads, CAST(NULL AS VARCHAR) AS novel_id, CAST(0 AS BIGINT) AS bytes,
    CAST(NULL AS VARCHAR) AS shard FROM names
  UNION ALL SELECT q.i, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) AND x + q.bytes <= 314572800 THEN x + q.bytes ELSE x END),
    q.novel_id, q.bytes, CASE WHEN list_min(loads) + q.bytes <= 314572800 THEN s[list_position(loads, list_min(loads))] END
  FROM walk JOIN q ON q.i = walk.i + 1, names)
SELECT novel_id, bytes, shard, CASE WHEN shard IS NULL THEN 'no_capacity' ELSE 'placed' END AS reason FROM walk WHERE i > 0"""


def _genre_sql() -> str:
    t = "lower(concat_ws(' ', title, synopsis))"
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains({t}, {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{name}' END" for name, parts in GENRES)
    return f"""SELECT entry_id, tags[1] AS genre, tags, summary FROM (SELECT entry_id, CASE WHEN len(m) = 0 THEN ['Fantasy'] ELSE m[1:6] END AS tags, summary FROM
 (SELECT entry_id, list_filter([{cases}], lambda x: x IS NOT NULL) AS m, substr(trim(regexp_replace(synopsis, '{_BLANK}+', ' ', 'g')), 1, 158) AS summary FROM auto_freewebnovel))"""


_BLANK = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_PAGE_WORDS = """len(list_filter(string_split_regex(coalesce(novel_id, '') || ' ' || text, '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+'), lambda x: x <> ''))"""
_WORDS = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+'), lambda x: x <> ''))"
_LOW = "lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')))"

SQL = {
    "least_complete_first": _QUEUE + " SELECT * FROM q",
    "budgeted_selection": _BUDGET + " SELECT novel_id, stored, total, rank, granted FROM g WHERE granted > 0",
    "numbers_to_load": _BUDGET
    + """, have AS (SELECT DISTINCT novel_id, chapter_number AS n FROM chapters), w AS (SELECT novel_id, CAST(unnest(range(1, chapter_count + 1)) AS INT) AS n FROM novels),
m AS (SELECT novel_id, n, row_number() OVER (PARTITION BY novel_id ORDER BY n) AS k FROM w ANTI JOIN have USING (novel_id, n))
SELECT novel_id, n AS chapter_number FROM m JOIN g USING (novel_id) WHERE k <= granted""",
    "rotation_slice": """WITH n AS (SELECT novel_id, row_number() OVER (ORDER BY novel_id) - 1 AS p, count(*) OVER () AS c FROM novels)
SELECT novel_id, CAST(((p - 30) % c + c) % c AS INT) AS turn FROM n WHERE ((p - 30) % c + c) % c < 45""",
    "priority_queue": """WITH r AS (SELECT id, min(discovery_rank) AS rank FROM auto_freewebnovel GROUP BY id),
f AS (SELECT id, rank, 0 AS queue, -1 AS turn FROM r WHERE rank IS NOT NULL ORDER BY rank, id LIMIT 15),
n AS (SELECT id, rank, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS c FROM r ANTI JOIN f USING (id)),
t AS (SELECT id, rank, 1 AS queue, ((p - 10) % c + c) % c AS turn FROM n), u AS (SELECT * FROM f UNION ALL SELECT * FROM t WHERE turn < 45)
SELECT id, rank, queue, place FROM (SELECT *, CAST(row_number() OVER (ORDER BY queue, CASE WHEN queue = 0 THEN rank END, turn, id) AS INT) AS place FROM u) WHERE place <= 45""",
    "daily_budget": """WITH RECURSIVE q AS (SELECT event_id, CAST(ts AS DATE) AS day, coalesce(CAST(ceil(abs(value)) AS BIGINT), 0) AS cost,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts NULLS FIRST, event_id) AS i FROM events),
walk AS (SELECT event_id, day, i, CASE WHEN cost <= 2000 THEN cost ELSE 0 END AS reserved, cost <= 2000 AS accepted FROM q WHERE i = 1
  UNION ALL SELECT q.event_id, q.day, q.i, CASE WHEN walk.reserved + q.cost <= 2000 THEN walk.reserved + q.cost ELSE walk.reserved END, walk.reserved + q.cost <= 2000
  FROM walk JOIN q ON q.day IS NOT DISTINCT FROM walk.day AND q.i = walk.i + 1)
SELECT event_id, day, CAST(reserved AS BIGINT) AS reserved, accepted FROM walk""",
    "running_totals": """SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cents FROM orders""",
    "catch_up_targets": f"""WITH {_STORED} SELECT novel_id, greatest(coalesce(numbers, 0), least(coalesce(chapter_count, 0), coalesce(numbers, 0) + 100)) AS target
FROM novels LEFT JOIN stored USING (novel_id)""",
    "capacity_forecast": f"WITH {_VOLUMES} SELECT * FROM v",
    "largest_novels": f"WITH {_VOLUMES} SELECT * FROM v ORDER BY bytes DESC, novel_id LIMIT 8",
    "lpt_fresh_placement": _LPT,
    "lag_audit": f"""WITH {_STORED}, t AS (SELECT novel_id, max(TRY_CAST(regexp_extract(title, '(?i)^\\s*ch(?:apter|\\.)?\\s*([0-9]{{1,9}})(?:[^0-9]|$)', 1) AS INT)) AS titled FROM chapters GROUP BY 1),
e AS (SELECT novel_id, chapter_count, maximum, titled, greatest(maximum, chapter_count, titled) AS tip FROM novels LEFT JOIN stored USING (novel_id) LEFT JOIN t USING (novel_id))
SELECT novel_id, CAST(tip AS BIGINT) AS tip, CASE WHEN maximum = tip THEN 'maximum' WHEN chapter_count = tip THEN 'chapter_count' WHEN titled = tip THEN 'titled' END AS evidence,
  CAST(greatest(0, coalesce(tip, 0) - coalesce(chapter_count, 0)) AS BIGINT) AS behind FROM e""",
    "release_tracker": _tracker("prev > 0 AND tip > prev AND ongoing", "NOT ongoing OR tip < prev"),
    "scan_tracker": _tracker("prev > 0 AND tip > prev", "NOT ongoing"),
    "activity_feed": f"""WITH l AS (SELECT novel_id, max(ingested_at) AS observed_at FROM chapters WHERE ingested_at <= TIMESTAMPTZ '{NOW}+00' GROUP BY 1),
f AS (SELECT novel_id, observed_at, CAST(epoch(TIMESTAMPTZ '{NOW}+00') - floor(epoch(observed_at)) AS BIGINT) AS a FROM novels JOIN l USING (novel_id) WHERE NOT coalesce(discovery_hidden, false))
SELECT novel_id, observed_at, a AS effective_age_s, CASE WHEN a < 60 THEN 'Just now' WHEN a < 3600 THEN (a // 60) || CASE WHEN a // 60 = 1 THEN ' min ago' ELSE ' mins ago' END
  WHEN a < 86400 THEN (a // 3600) || CASE WHEN a // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END WHEN a < 172800 THEN 'Yesterday' ELSE (a // 86400) || ' days ago' END AS label
FROM f WHERE a >= 0 AND a < 432000""",
    "record_lifecycle": """WITH r AS (SELECT id, title, discovery_rank, row_number() OVER (PARTITION BY id ORDER BY discovered_at NULLS FIRST, entry_id) AS f,
  row_number() OVER (PARTITION BY id ORDER BY discovered_at DESC NULLS LAST, entry_id DESC) AS l, count(*) OVER (PARTITION BY id) AS n FROM auto_freewebnovel)
SELECT id, title, discovery_rank FROM r WHERE l = 1 AND (n = 1 OR discovery_rank IS NOT NULL)""",
    "chapter_alerts": f"""WITH {_STORED}, n AS (SELECT novel_id, chapter_count, row_number() OVER (ORDER BY novel_id) - 1 AS p, count(*) OVER () AS c FROM novels),
s AS (SELECT o_custkey AS user_id, novel_id, CAST(max(o_orderkey % 60) AS INT) AS seen FROM orders JOIN n ON p = o_orderkey % c GROUP BY 1, 2)
SELECT user_id, novel_id, first_new, last_new - first_new + 1 AS new_chapters FROM (SELECT user_id, novel_id, greatest(chapter_count - 4, seen + 1) AS first_new,
  least(chapter_count, maximum) AS last_new FROM s JOIN n USING (novel_id) JOIN stored USING (novel_id) WHERE chapter_count IS NOT NULL) WHERE last_new - first_new + 1 > 0""",
    "bookmark_merge": """WITH e AS (SELECT user_id, coalesce(json_extract_string(props, '$.k'), '0') AS novel, event_id % 5 AS m FROM events),
f AS (SELECT user_id, novel, bool_or(m IN (0, 1)) AS b, bool_or(m IN (1, 2)) AS l, bool_or(m IN (0, 3)) AS r FROM e GROUP BY 1, 2)
SELECT user_id, novel FROM f WHERE (r OR (l AND NOT b)) AND NOT (b AND NOT l)""",
    "reading_progress": """SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1""",
    "newest_positions": """SELECT user_id, event_id, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r <= 20""",
    "screening_counts": f"""WITH t AS (SELECT source, {_LOW} AS low, {_WORDS} AS words,
  len(regexp_extract_all(lower(coalesce(text, '')), 'https?://|www\\.')) AS links FROM documents)
SELECT source, count(*) AS texts, CAST(sum(words) AS BIGINT) AS words, CAST(sum(links) AS BIGINT) AS links, count(*) FILTER (WHERE low = '') AS blank,
  count(*) FILTER (WHERE length(low) > 140) - count(DISTINCT CASE WHEN length(low) > 140 THEN low END) AS repeated FROM t GROUP BY source""",
    "genre_by_words": _genre_sql(),
    "tags_in_use": "SELECT tag, count(DISTINCT novel_id) AS novels FROM (SELECT novel_id, unnest(tags) AS tag FROM novels) GROUP BY tag",
    "undiscovered_titles": "SELECT slug, min(entry_id) AS first_entry FROM auto_freewebnovel WHERE slug IS NULL OR slug NOT IN (SELECT novel_id FROM novels WHERE novel_id IS NOT NULL) GROUP BY slug",
    "page_links": """SELECT doc_id, CAST(unnest([0, 1]) AS INT) AS position, unnest(['/', '/novel/' || coalesce(novel_id, 'none')]) AS href FROM documents WHERE text IS NOT NULL""",
    "page_titles": "SELECT doc_id, coalesce(nullif(novel_id, ''), 'untitled') AS title FROM documents WHERE text IS NOT NULL",
    "page_word_counts": f"SELECT doc_id, 3 + {_PAGE_WORDS} AS words FROM documents WHERE text IS NOT NULL",
    "escaped_titles": """SELECT row_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  '''' || replace(title, '''', '''''') || '''' AS sql, CAST(length(title) + length(regexp_replace(title, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) AS BIGINT) AS utf16_length
FROM chapters WHERE title IS NOT NULL""",
    "upsert_export": """SELECT novel_id, chapter_number, sha256(s) AS digest, strlen(s) <= 95000 AS fits FROM (SELECT novel_id, chapter_number,
  'INSERT INTO chapters (novel_id, chapter_number, title, paragraphs_json) VALUES (' || concat_ws(', ', '''' || replace(novel_id, '''', '''''') || '''', CAST(chapter_number AS VARCHAR),
  coalesce('''' || replace(title, '''', '''''') || '''', 'NULL'), coalesce('''' || replace(paragraphs_json, '''', '''''') || '''', 'NULL'))
  || ') ON CONFLICT (novel_id, chapter_number) DO UPDATE SET title = excluded.title, paragraphs_json = excluded.paragraphs_json;' AS s FROM
 (SELECT *, row_number() OVER (PARTITION BY novel_id, chapter_number ORDER BY ingested_at DESC, row_id DESC) AS r FROM chapters
  WHERE novel_id IS NOT NULL AND chapter_number IS NOT NULL) WHERE r = 1)""",
}
