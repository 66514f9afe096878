import json

import pytest

from quirefold.llm import lookalike as L

FIELDS = {"title": False, "paragraphs_json": True}
PLAIN = ["plain", "Pêphe’s café", "Ждана, they said", "하늘벽 and 霧島塔", "a\tb\nc", "", " ", "“quotes” — dash…", "Καλημέρα world", "価格：100、了解！", "🙂 fine"]
ODD = {
    "Ｃｈａｐｔｅｒ　１": "Chapter 1", "café": "café", "zero​width": "zerowidth", "no\xa0break": "no break", "soft\xadhyphen": "softhyphen", "𝐛𝐨𝐥𝐝 𝕏": "bold X", "ﬁre": "fire", "Ⅽhapter": "Chapter", "x²": "x2",
    "KK": "KK", "하늘": "하늘", "a b": "a b", "Ch. 2 － Tide": "Ch. 2 - Tide", "﻿start": "start",
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert L.is_plain(text) and L.folded(text) == text


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    assert not L.is_plain(text) and L.folded(text) == ODD[text] and L.is_plain(ODD[text])


def test_mixed_tokens():
    assert L.mixed_tokens("the lаmp and Ждана") == ["lаmp"] and L.repaired("lаmp") == "lamp"
    assert L.repaired("Дорoга") == "Дорога"  # a Latin o in a Cyrillic word
    assert L.mixed_tokens("Т/N") == [] and not L.is_plain("сlock") and L.is_plain("сор")


def test_values(spark):
    rows = [(1, "lаmp", json.dumps(["the lamp"])), (2, "qzжv", None), (3, None, json.dumps(["café", "ok", 3])), (3, None, json.dumps(["café"])), (4, "fine", "no json é"), (5, "", "[]"), (None, "lаmp", None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "row_id long, title string, paragraphs_json string, row string, field_name string")
    found = sorted((r.row_id or 0, r.field_name) for r in L.odd_values(df, "row_id", FIELDS).collect())
    assert found == [(0, "title"), (1, "title"), (2, "title"), (3, "paragraphs_json"), (3, "paragraphs_json")]
    plain = {(r.row_id, r.field_name): (list(r.plain), r.unresolved) for r in L.plain_values(df.where("row_id IS NOT NULL"), "row_id", FIELDS).dropDuplicates(["row_id"]).collect()}
    assert plain[1, "title"] == (["lamp"], 0)
    assert plain[2, "title"] == (["qzжv"], 1)  # no reading in the vocabulary: left alone and counted
    assert plain[3, "paragraphs_json"][0][0] == "café"
    assert L.odd_values(df.limit(0), "row_id", FIELDS).count() == 0 and L.plain_values(df.limit(0), "row_id", FIELDS).count() == 0


def test_long_text():
    assert not L.is_plain("x" * 200_000 + "​") and L.is_plain("é" * 200_000)


def test_readings():
    assert L.readings("lаmp") == ["lamp"] and L.readings("Дорoга") == ["Дорога"]
    assert L.readings("сoр") == ["сор", "cop"]  # Cyrillic dominates, Latin is possible
    assert L.readings("cор") == ["сор", "cop"] and L.readings("cоp") == ["cop", "сор"]
    assert L.readings("հayոց") == ["hayng"] and L.readings("բoզ") == ["բօզ"]  # no Armenian letter looks like y, no Latin one like բ
    assert L.readings("qzжv") == [] and L.readings("אab") == [] and L.repaired("אab") == "אab"
    assert L.readings("cafе́") == ["café"]  # the accent stands on a Cyrillic letter


def test_vocabulary_decides(spark):
    rows = [(1, "сoр", "[]"), (2, "a cop", "[]"), (None, "lаmp", '["the Lamp"]'), (4, "Дорoга", "[]"), (5, "Дорога", "[]")]
    df = spark.createDataFrame(rows, "row_id long, title string, paragraphs_json string")
    plain = {r.row_id: (list(r.plain), r.unresolved) for r in L.plain_values(df, "row_id", FIELDS).collect()}
    # The dominant reading is not in the vocabulary, the other one is; a missing key takes nothing from a value.
    assert plain == {1: (["cop"], 0), None: (["lamp"], 0), 4: (["Дорога"], 0)}
    both = {r.row_id: list(r.plain) for r in L.plain_values(df.unionByName(df.sparkSession.createDataFrame([(6, "сор", None)], df.schema)), "row_id", FIELDS).collect()}
    assert both[1] == ["сор"]


def test_found_by_repair(spark, tmp_path):
    from quirefold.llm import queries

    rows = [(1, "lаmp", '["the lamp"]'), (2, "qzжv", None), (3, "fine", '["café", "ok"]'), (3, "fine", '["café", "ok"]'), (4, "Ждана", '["café"]'), (None, "no\xa0break", None)]
    spark.createDataFrame(rows, "row_id long, title string, paragraphs_json string").write.parquet(str(tmp_path / "chapters.parquet"))
    found = queries.p6_found(spark, str(tmp_path))
    assert found.columns == ["row_id", "field_name"] and dict(found.dtypes)["row_id"] == "bigint"
    assert sorted((r.row_id or 0, r.field_name) for r in found.collect()) == [(0, "title"), (1, "title"), (2, "title"), (3, "paragraphs_json"), (3, "paragraphs_json")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "pairs" in plan  # the readings are held against the vocabulary
