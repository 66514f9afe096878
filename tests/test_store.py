"""Store, bodies and skew operators on small fixtures with the awkward cases."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import bodies, skew, store

SCHEMA = "row_id long, novel_id string, chapter_number int, title string, paragraphs_json string, removed_duplicate boolean, ingested_at timestamp"


def chapters(spark, rows):
    """Rows of (novel, number, paragraphs or None, removed)."""
    at = datetime.datetime(2026, 1, 1)
    data = [(i, n, k, f"Chapter {k}", None if p is None else json.dumps(p), r, at + datetime.timedelta(hours=i)) for i, (n, k, p, r) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


LONG = ["The lamp over the quay went out and nobody lit it again."] * 9


def test_repeated_bodies(spark):
    df = chapters(spark, [("s", 1, LONG, None), ("s", 2, LONG, None), ("s", 3, [*LONG, "End."], None), ("s", 4, ["x"], None), ("s", 5, ["x"], None), ("s", 6, None, None), ("t", 7, LONG, None)])
    digests = bodies.body_digests(df)
    found = bodies.repeats_in_novel(digests).collect()
    assert [(r.novel_id, r.first_chapter, r.repeated_chapter) for r in found] == [("s", 1, 2)]
    assert [(r.chapters, r.novels) for r in bodies.repeats_across(digests).collect()] == [(3, 2)]
    known = spark.createDataFrame([("s", 1, 2, found[0].digest), ("s", 1, 3, found[0].digest), ("s", 1, 9, "0" * 16)], "novel_id string, first_chapter int, repeated_chapter int, digest string")
    assert bodies.unlisted_repeats(bodies.repeats_in_novel(digests), known).count() == 0
    states = {r.repeated_chapter: r.state for r in bodies.listed_entries(known, digests).collect()}
    assert states == {2: "still_repeated", 3: "body_changed", 9: "chapter_gone"}


def test_three_repeats_all_name_the_first(spark):
    df = chapters(spark, [("s", k, LONG, None) for k in (4, 2, 9)])
    assert sorted((r.first_chapter, r.repeated_chapter) for r in bodies.repeats_in_novel(bodies.body_digests(df)).collect()) == [(2, 4), (2, 9)]


@pytest.mark.parametrize(("numbers", "total", "first", "missing"), [([], 5, 1, []), ([1, 2, 3, 4, 5], 5, None, []), ([1, 2], 5, 3, []), ([1, 4], 5, 2, [(2, 3)]), ([3, 3, 7], 7, 1, [(1, 2), (4, 6)])])
def test_gaps(spark, numbers, total, first, missing):
    df = chapters(spark, [("a", k, ["x"], None) for k in numbers])
    novels = spark.createDataFrame([("a", total)], "novel_id string, chapter_count int")
    assert store.first_missing(df, novels).collect()[0].first_missing == first
    assert sorted((r.from_number, r.to_number) for r in store.gaps(df).collect()) == missing


def test_gaps_and_neighbours_against_brute_force(spark):
    draw = random.Random(3)
    numbers = {n: sorted(draw.sample(range(1, 40), draw.randint(1, 30))) for n in "abcdef"}
    df = chapters(spark, [(n, k, ["x"], draw.random() < 0.3) for n, ks in numbers.items() for k in ks])
    kept = {n: [r.chapter_number for r in df.where(f"novel_id = '{n}' AND NOT removed_duplicate").orderBy("chapter_number").collect()] for n in numbers}
    want = {(n, k): (ks[i - 1] if i else None, ks[i + 1] if i + 1 < len(ks) else None) for n, ks in kept.items() for i, k in enumerate(ks)}
    assert {(r.novel_id, r.chapter_number): (r.previous, r.next) for r in store.neighbours(df).collect()} == want
    gone = {n: {k for k in range(1, max(ks)) if k not in ks} for n, ks in numbers.items()}
    got = {n: set() for n in numbers}
    for r in store.gaps(df).collect():
        got[r.novel_id] |= set(range(r.from_number, r.to_number + 1))
    assert got == gone


def test_first_and_last_write(spark):
    df = chapters(spark, [("a", 1, ["old"], None), ("a", 1, ["new"], None), ("a", 2, ["x"], None), (None, 1, ["x"], None), ("a", None, ["x"], None)])
    assert sorted(r.row_id for r in store.first_write(df).collect()) == [0, 2]
    assert sorted(r.row_id for r in store.last_write(df).collect()) == [1, 2]
    more = chapters(spark, [("a", 2, ["y"], None), ("a", 3, ["z"], None)]).withColumn("row_id", F.col("row_id") + 100)
    base = store.first_write(df)
    assert sorted(r.row_id for r in store.insert_missing(base, more).collect()) == [0, 2, 101]
    assert sorted(r.row_id for r in store.overwrite(base, more).collect()) == [0, 100, 101]


def test_content_audit(spark):
    a = chapters(spark, [("a", 1, ["x", "y"], None), ("a", 2, ["x"], None), ("a", 3, ["x"], None)])
    b = chapters(spark, [("a", 1, ["x", "y"], None), ("a", 2, ["changed"], None), ("a", 4, ["x"], None)])
    b = b.withColumn("paragraphs_json", F.replace("paragraphs_json", F.lit(", "), F.lit(",")))  # another spelling
    assert sorted((r.chapter_number, r.problem) for r in store.differing(a, b).collect()) == [(2, "unequal"), (3, "missing"), (4, "extra")]


def test_digest_does_not_depend_on_partitions(spark):
    df = chapters(spark, [("a", k, [f"text {k}"], None) for k in range(1, 50)])
    once = store.digests(df, block=7).collect()
    assert store.digests(df.repartition(7), block=7).collect() == once
    assert store.digests(df.where("chapter_number <> 8"), block=7).collect() != once


def test_routes(spark):
    at = datetime.datetime(2026, 1, 1)
    routes = spark.createDataFrame(
        [(1, "a", "x", at), (2, "a", "y", None), (3, "b", "x", at), (4, "b", "z", at + datetime.timedelta(1)), (5, None, "x", at), (6, "c", None, at)],
        "route_id long, novel_id string, database_id string, assigned_at timestamp",
    )
    assert {r.novel_id: r.database_id for r in store.current_routes(routes).collect()} == {"a": "x", "b": "z", "c": None}
    shards = spark.createDataFrame([("x",), ("y",)], "database_id string")
    assert {r.novel_id: (r.databases, r.known) for r in store.route_conflicts(routes, shards).collect()} == {"a": (2, True), "b": (2, False), "c": (0, False)}


def test_skew(spark):
    rows = [(i, "hot" if i < 500 else None if i < 510 else f"k{i % 50}", i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, key string, v long")
    assert {r.key for r in skew.heavy_keys(df, "key", ["id"]).collect()} == {"hot"}
    got = skew.salted_aggregate(df, "key", ["v"], {"n": F.count(F.lit(1)), "d": F.countDistinct("v"), "s": F.sum("v")}, {"n": F.sum("n"), "d": F.sum("d"), "s": F.sum("s")})
    want = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("d"), F.sum("v").alias("s"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)
    assert skew.heavy_keys(df.limit(0), "key", ["id"]).count() == 0
    assert skew.key_counts(df.limit(0), "key", ["id"]).count() == 0


@pytest.mark.parametrize(("label", "seconds"), [("Updated 11 mins ago", 660), ("2 hours ago", 7200), ("yesterday", 86400), ("5 days ago", 432000), ("an hour ago", 3600), ("just now", 0), ("soon", None), ("1000 days ago", None), (None, None)])
def test_ages(spark, label, seconds):
    assert spark.createDataFrame([(label,)], "a string").select(T.age_seconds(F.col("a"))).collect()[0][0] == seconds


@pytest.mark.parametrize(("title", "label"), [("Chapter 1800: Chapter 1799 - X", "Chapter 1799 - X"), ("Chapter 7: Chapter 6.2 - Y", "Chapter 6.2 - Y"), ("​Chapter 3: Z", "Chapter 3: Z")])
def test_labels(spark, title, label):
    assert spark.createDataFrame([(title,)], "a string").select(T.unprefixed_title(F.col("a"))).collect()[0][0] == label


def test_text(spark):
    text = "a  b﻿ c\t  d <i>'q'</i> & \U0001f600"
    df = spark.createDataFrame([(text, "/a/b-", "../b")], "a string, good string, bad string")
    row = df.select(T.collapsed(F.col("a")).alias("c"), T.utf16_length(F.col("a")).alias("n"), T.html_escaped(F.col("a")).alias("h"), T.word_count(F.col("a")).alias("w"), T.chunk_name(F.lit("p-"), F.lit(105)).alias("f"), T.safe_path(F.col("bad")).alias("s"), T.slug(F.lit("Élan à Zürich!")).alias("g"), T.title_key(F.lit("Straße 7")).alias("k")).collect()[0]
    assert row.c == "a b c d <i>'q'</i> & \U0001f600" and row.n == len(text) + 1 and row.w == 7
    assert "&lt;i&gt;&#39;q&#39;&lt;/i&gt; &amp; " in row.h and row.f == "p-105.js" and not row.s and row.g == "elan-a-zurich" and row.k == "strasse7"
    page = "<div><script>var a = '<p>no</p>';</script><h1>One &amp; two</h1><p>x</p></div>"
    assert spark.range(1).select(T.visible_text(F.lit(page))).collect()[0][0] == "One & two x"
