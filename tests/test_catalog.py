"""Scheduling, placement, activity, reader, files, pages and the stream, on fixtures and against brute force."""

import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold.functions import html as H
from quirefold.operators import activity, placement, prefix, reader, schedule, screening
from quirefold.sources import files
from quirefold.streaming import releases

AT = datetime.datetime(2026, 3, 1)


def test_least_complete_first_and_budget(spark):
    novels = spark.createDataFrame([("a", 10), ("b", 20), ("c", 2), ("d", None)], "novel_id string, chapter_count int")
    stored = spark.createDataFrame([("a", 5), ("c", 2)], "novel_id string, numbers long")
    queue = schedule.least_complete_first(novels, stored)
    assert [r.novel_id for r in queue.orderBy("rank").collect()] == ["b", "a"]
    granted = schedule.budgeted(queue, F.col("total") - F.col("stored"), 25, 22)
    assert [(r.novel_id, r.granted) for r in granted.orderBy("rank").collect()] == [("b", 20), ("a", 2)]
    missing = spark.createDataFrame([("a", 2, 2), ("a", 4, 900000000), ("b", 1, 20)], "novel_id string, from_number int, to_number int")
    assert sorted(r.chapter_number for r in schedule.next_numbers(missing, granted).where("novel_id = 'a'").collect()) == [2, 4]


def test_rotation(spark):
    items = spark.createDataFrame([(f"n{i}", 3 - i if i < 3 else None) for i in range(7)], "id string, rank int")
    assert [r.id for r in schedule.rotation(items, "id", 5, 4).orderBy("turn").collect()] == ["n5", "n6", "n0", "n1"]
    queue = schedule.priority_then_rotation(items, "id", "rank", "id", 1, 2, 5).orderBy("place").collect()
    assert [r.id for r in queue] == ["n2", "n1", "n3", "n4", "n5"]
    assert schedule.rotation(items.limit(0), "id", 5, 4).count() == 0


def test_running_sum_and_budget(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice("ab"), AT + datetime.timedelta(minutes=draw.randint(0, 600)), draw.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v long")
    got = {r.id: r.s for r in prefix.running_sum(df, "k", F.date_trunc("hour", "ts"), ["ts", "id"], "v", "s").collect()}
    want, sums = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[k] = sums.get(k, 0) + (v or 0)
        want[i] = sums[k]
    assert got == want


def test_placement(spark):
    df = spark.createDataFrame([("a", 65, None), ("b", 60, None), ("c", 35, None), ("d", 101, None)], "novel_id string, bytes long, pinned string")
    best = {r.novel_id: (r.shard, r.reason) for r in placement.best_fit(df, 100).collect()}
    assert best == {"a": ("bin-1", "placed"), "b": ("bin-2", "placed"), "c": ("bin-1", "placed"), "d": (None, "oversized")}
    pinned = spark.createDataFrame([("a", 65, "02"), ("b", 60, None), ("c", 35, None), ("e", 500, None)], "novel_id string, bytes long, pinned string")
    least = {r.novel_id: (r.shard, r.reason) for r in placement.least_loaded(pinned, {"01": 0, "02": 65}, 400).collect()}
    assert least == {"a": ("02", "already_stored"), "b": ("01", "placed"), "c": ("01", "placed"), "e": (None, "no_capacity")}
    row = spark.range(1).select(placement.projected_bytes(F.lit(10000), F.lit(5))).collect()[0]
    assert row[0] == 1_066_856


def _observations(n, seed):
    draw = random.Random(seed)
    return [(f"k{draw.randint(0, 8)}", AT + datetime.timedelta(minutes=i), draw.randint(0, 12), draw.random() < 0.8, i) for i in range(n)]


def test_release_states_equal_the_sequential_machine(spark):
    rows = _observations(400, 1)
    df = spark.createDataFrame(rows, "key string, at timestamp, tip int, ongoing boolean, i long")
    got = {r.i: (r.seen, r.release_number, r.first_number) for r in activity.release_states(df, "key", ["at", "i"], "tip", "ongoing", "at").collect()}
    state, want = {}, {}
    for key, at, tip, ongoing, i in rows:
        seen, pending = state[key] = releases.step(*state.get(key, (0, None)), tip, ongoing, at)
        want[i] = (seen, *(pending[:2] if pending else (None, None)))
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rows = _observations(120, 2)
    df = spark.createDataFrame(rows, "key string, at timestamp, tip int, ongoing boolean, i long")
    batch = activity.release_states(df, "key", ["at"], "tip", "ongoing", "at").select("key", F.col("at").alias("observed_at"), "tip", "seen", "release_number", "first_number", "released_at")
    source, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    for part in ("i < 60", "i >= 60"):  # two polls; the state goes on
        df.where(part).coalesce(1).write.mode("append").parquet(source)
        found = releases.run_available(spark.readStream.schema(df.schema).parquet(source), out, state)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


@pytest.mark.parametrize(("columns", "total", "tip", "name"), [((5, 5, None), 3, 5, "a"), ((None, 2, 7), 9, 7, "c"), ((None, None, None), 1, None, None)])
def test_best_evidence(spark, columns, total, tip, name):
    df = spark.createDataFrame([(*columns, total)], "a int, b int, c int, total int")
    row = activity.best_evidence(df, ["a", "b", "c"], F.col("total")).collect()[0]
    assert (row.tip, row.evidence, row.behind) == (tip, name, max(0, (tip or 0) - total))


def test_feed_cuts_at_exactly_five_days(spark):
    now = datetime.datetime(2026, 10, 11, 9)
    ages = {"old": 6 * 86400, "edge": 5 * 86400, "four": 4 * 86400, "hour": 3600, "hidden": 10}
    df = spark.createDataFrame([(k, now, v, True if k == "hidden" else None) for k, v in ages.items()], "id string, observed_at timestamp, age_s long, discovery_hidden boolean")
    shown = activity.feed(df, "observed_at", "age_s", F.lit(now)).orderBy("effective_age_s").collect()
    assert [r.id for r in shown] == ["hour", "four"]


def test_lifecycle_and_alerts(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    after = spark.createDataFrame([("a", "verified", 9), ("b", "unverifiable", 8), ("c", "failed", 7), ("d", "verified", 6), ("e", "failed", 5)], "id string, outcome string, v int")
    assert sorted(map(tuple, activity.merged_records(before, after, "id", ["v"]).collect())) == [("a", 9), ("c", 3), ("d", 6)]
    saved = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, novel_id string")
    seen = spark.createDataFrame([("u", "a", 2)], "user_id string, novel_id string, seen int")
    rel = spark.createDataFrame([("a", 3, 4, 4), ("b", None, None, 4)], "novel_id string, first_number int, release_number int, stored int")
    assert [tuple(r) for r in activity.alerts(saved, seen, rel).collect()] == [("u", "a", 3, 2)]


def test_reader_merges(spark):
    def side(*x):
        return spark.createDataFrame([("u", v) for v in x], "user string, novel string")

    got = reader.three_way_sets(side("a"), side("a", "b"), side("c"), ["user", "novel"])
    assert sorted(r.novel for r in got.collect()) == ["b", "c"]
    row = spark.range(1).select(reader.three_way_arrays(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))).alias("x")).collect()[0]
    assert row.x == ["c", "b"]
    events = spark.createDataFrame([("u", i, AT + datetime.timedelta(seconds=i % 7)) for i in range(205)], "user string, id long, at timestamp")
    kept = reader.newest_of_each(events, "user", "at", "id", 200).collect()
    assert len(kept) == 200
    assert reader.newest(events, ["user"], "at", "id", ["id"]).collect()[0].id == max((i % 7, i) for i in range(205))[1]


def test_screening(spark):
    long = "word " * 40
    df = spark.createDataFrame([("s", 1, long), ("s", 2, "  WORD " + "word " * 39), ("s", 3, "see http://a and www.b"), ("s", 4, None), ("s", 5, "x"), ("s", 6, "x")], "g string, id long, t string")
    row = screening.screen(df, "g", "id", "t").collect()[0]
    assert (row.texts, row.links, row.blank, row.repeated) == (6, 2, 1, 1)
    now = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    first = screening.changed_reports(now, spark.createDataFrame([], "id string, fingerprint string"), "id", ["v"])
    assert first.count() == 2
    again = spark.createDataFrame([("a", 1), ("b", 3)], "id string, v int")
    assert [r.id for r in screening.changed_reports(again, first.select("id", "fingerprint"), "id", ["v"]).collect()] == ["b"]


def test_chunk_files_round_trip(spark, tmp_path):
    rows = [("n", k, f"Chapter {k}", [f"a < b & 'q' {k}", '"x"'], (k - 1) // 25 + 1, "n-") for k in range(1, 61)]
    df = spark.createDataFrame(rows, "novel_id string, chapter_number int, title string, paragraphs array<string>, chunk int, prefix string")
    texts = files.chunk_texts(df, F.lit("CH_N")).collect()
    assert sorted(t.file for t in texts) == ["n-01.js", "n-02.js", "n-03.js"]
    for t in texts:
        assert "<" not in t.text.replace("\\u003c", "")
        (tmp_path / t.file).write_text(t.text)
    back = files.chunk_files(spark, str(tmp_path / "*.js"))
    assert sorted((r.number, r.title, tuple(r.paragraphs)) for r in back.collect()) == [(r[1], r[2], tuple(r[3])) for r in rows]
    assert {r.bytes for r in files.file_sizes(spark, str(tmp_path / "*.js")).collect()} == {len(t.text.encode()) for t in texts}
    (tmp_path / "c.txt").write_text('window.N=(window.N||[]);window.N.push({"id":"n","title":"T","tags":["x"],"chapters":[{"number":1,"title":"One"}]});')
    assert [(r.id, r.tags, r.chapters[0].number) for r in files.catalog_files(spark, str(tmp_path / "c.txt")).collect()] == [("n", ["x"], 1)]


def test_written_chapters_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", k, "x") for k in range(500)] + [("b", 1, "y")], "novel_id string, chapter_number int, title string")
    files.write_chapters(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("novel_id = 'a' AND chapter_number BETWEEN 10 AND 19").count() == 10 and back.count() == 501


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        book.writestr("o/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="none"/></spine></package>')
        book.writestr("o/a.xhtml", "<p>A</p>")
        book.writestr("o/b.xhtml", "<p>B</p>")
    (tmp_path / "x.epub").write_bytes(data.getvalue())
    (tmp_path / "y.epub").write_bytes(b"no zip")
    rows = files.epub_documents(spark, str(tmp_path / "*.epub")).orderBy("position").collect()
    assert [(r.title, r.html) for r in rows if r.problem is None] == [("T", "<p>B</p>"), ("T", "<p>A</p>")]
    assert [r.problem for r in rows if r.problem] == ["BadZipFile"]


def test_main_paragraphs():
    noise = "<nav><p>Home</p></nav><script>'<p>x</p>'</script>"
    text = "".join(f"<p>Paragraph {i} of the chapter, long enough to count. {'x' * 80}</p>" for i in range(5))
    found = H.main_paragraphs(f"<html><body>{noise}<div><p>Short.</p></div><article><h1>T</h1>{text}<p>Open<p>Next</article></body></html>")
    assert len(found) == 7 and found[0].startswith("Paragraph 0") and found[-1] == "Next"
    assert H.main_paragraphs("plain words") == ["plain words"] and H.main_paragraphs("") == []
    assert H.anchors('<a href="/x">A <b>b</b></a><a name="y">no</a>') == [{"href": "/x", "label": "A b"}]


def test_sitemaps_hold_every_url_once(spark):
    df = spark.range(1000).select(F.concat(F.lit("/u/"), "id").alias("url"))
    pages = files.sitemap_pages(df.union(df), "url", 100)
    assert pages.count() == 1000 and pages.groupBy("sitemap").count().count() == 12
