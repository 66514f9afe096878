"""Queries that look at texts of any script, on fixtures and against brute force."""

import re

from quirefold.plans import catalog, corpus

SPACE = "\t\n\v\f\r \xa0                　﻿"


def test_genre_of_every_entry(spark, tmp_path):
    rows = [
        (1, "The “Emperor” of Dawn", "An elder’s　tale\xa0 – of  swords "),
        (2, "Café SPACE", None),
        (3, None, "Dread é"),
        (4, "霧の河", "夜の約束。" * 60),
        (5, None, None),
        (6, "Дорога", "and GARDEN"),
        (7, "plain", "a love of magic in a game"),
        (8, "İstanbul", "ＬＯＶＥ"),
    ]
    spark.createDataFrame(rows, "entry_id long, title string, synopsis string").write.parquet(str(tmp_path / "auto_freewebnovel.parquet"))

    def tags(title, synopsis):
        low = " ".join(x for x in (title, synopsis) if x is not None).lower()
        return [name for name, parts in catalog.GENRES if any(p in low for p in parts)][:6] or ["Fantasy"]

    def summary(text):
        return None if text is None else re.sub(f"[{SPACE}]+", " ", text).strip(" ")[:158]

    got = {r.entry_id: (r.genre, r.tags, r.summary) for r in catalog.genre_by_words(spark, str(tmp_path)).collect()}
    assert got == {i: (tags(t, s)[0], tags(t, s), summary(s)) for i, t, s in rows}
    assert got[1][0] == "Historical" and got[2][0] == "Sci-fi" and got[4][0] == "Fantasy" and got[7][1] == ["Romance", "Fantasy", "Game"]


def test_labels_of_titles_in_any_script(spark, tmp_path):
    titles = {
        1: "Chapter 416: Chapter 415 - Café Of The Velvet Ember",
        2: "Chapter 1700: ​Chapter 1700: Quinn Museum",
        3: "Chapter 20:　Chapter　19　-　Name",
        4: "Chapter 7: 夜の約束",
        5: "Zero​ width",
        6: "Café",
        7: None,
        8: "chapter 3: chapter 2 plain",
    }
    rows = [(i, i, t) for i, t in titles.items()]
    spark.createDataFrame(rows, "row_id long, chapter_number int, title string").write.parquet(str(tmp_path / "chapters.parquet"))
    got = {r.row_id: (r.label, r.label_number) for r in corpus.title_labels(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("Chapter 415 - Café Of The Velvet Ember", 415),
        2: ("Chapter 1700: Quinn Museum", 1700),
        3: ("Chapter　19　-　Name", 19),
        5: ("Zero width", None),
        8: ("chapter 2 plain", 2),
    }


def test_requests_that_do_not_fit_reserve_nothing(spark):
    from quirefold.operators.schedule import reserved

    rows = [(1, "a", 1, 6), (2, "a", 2, 5), (3, "a", 3, 4), (4, "a", 4, None), (5, "b", 1, 11), (6, "b", 2, 10), (7, None, 1, 3), (8, "a", 3, 1)]
    df = spark.createDataFrame(rows, "id long, day string, at int, cost int")
    got = {r.id: (r.reserved, r.accepted) for r in reserved(df, "day", ["at", "id"], "id", "cost", 10).collect()}
    assert got == {1: (6, True), 2: (6, False), 3: (10, True), 8: (10, False), 4: (10, True), 5: (0, False), 6: (10, True), 7: (3, True)}
    assert reserved(df.limit(0), "day", ["at", "id"], "id", "cost", 10).count() == 0
