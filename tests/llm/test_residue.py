import json

import pytest

from quirefold.llm import residue as R

SCHEMA = "row_id long, novel_id string, paragraphs_json string, kind string, line string"
STORY = "The lamp over the quay went out and nobody lit it again."

FOUND = [
    ("template", "{{ chapter.title }}"), ("template", "Dear {{{reader.name}}}, thank you."), ("template", "Part ${volume_no} of the book"), ("template", "<%= content %>"),
    ("template", "{% include body %}"), ("template", "<!-- chapter_text -->"), ("template", "%%BODY%%"), ("template", "Next: @@NEXT_LINK@@"), ("template", "__TITLE__"),
    ("template", "[[READER_LANG]]"), ("template", "[PAGE_TEXT]"), ("template", "[BODY]"), ("template", "{title|default('')}"), ("template", "{0}"), ("template", "He left. %s"),
    ("template", "$body$"), ("template", ":content:"), ("template", ":author.name:"), ("template", "[object Object]"), ("template", "undefined"), ("template", "It rained. NaN NaN"),
    ("template", "Dear null, welcome."), ("filler", "Lorem ipsum dolor sit amet"), ("filler", "Nulla vitae corpus amet sit dolor."), ("filler", "[INSERT CHAPTER TEXT HERE]"),
    ("filler", "TODO: add the text of this chapter"), ("filler", "test test test"), ("filler", "aaaa bbbb cccc"), ("filler", "Loading..."), ("filler", "Loading chapter..."),
    ("filler", "Please wait while the chapter loads"), ("filler", "Texto de ejemplo, sustituir."), ("filler", "(chapter body goes here)"), ("error_page", "404 Not Found"), ("error_page", "<h1>Bad Gateway</h1>"),
    ("error_page", "Error 520"), ("error_page", "Access denied"), ("error_page", f"{STORY} Access denied Your address has been blocked (12ab)."), ("error_page", "Could not connect to the database."),
    ("error_page", "Traceback: app/views line 30, KeyError 'x'"), ("error_page", "Seite nicht gefunden."), ("error_page", "Checking your browser before opening the page."), ("script_notice", "Please enable JavaScript to continue."),
    ("script_notice", "JavaScript is disabled in your browser."), ("script_notice", "<noscript>Allow cookies</noscript>"), ("script_notice", "We noticed an ad blocker."), ("script_notice", "Bitte aktiviere JavaScript, um zu lesen."),
]
CLEAN = [
    "{Status} Strength: 43 | Luck: 27 | Title: brave", "[System] Level 73 reached.", "<Skill: grim stove> appeared.", "${} was how Ana signed, a dollar sign and two brackets.",
    "The index card said page not found, so Ana drew it again.", "As a developer Ana dreamed of JavaScript and of scripts that never loaded.", "Ana had named one cat Lorem and the other Ipsum.",
    "Access denied: the words were carved over the gate.", "\"Error 404,\" joked Ana when the cellar was empty.", "They kept too many requests in one jar.", "\"Please wait while the mirror cools,\" she said.",
    "T/N: the joke is lost here.", "Under [the hedge] stood a blank, to be filled in by Ana.", "None of them came.", "Edited by Ana, read early on the author page.", "100% sure", "To be continued.", "Nothing was null about it.",
]


@pytest.mark.parametrize(("kind", "line"), FOUND)
def test_evidence(kind, line):
    assert kind in R.Judge().line(line)


@pytest.mark.parametrize("line", CLEAN)
def test_no_evidence(line):
    assert R.Judge().line(line) == []


def test_rules_need_their_triggers():
    judge = R.Judge()
    for _, line in FOUND:
        assert judge.marked([line])


def rows(spark, data):
    return spark.createDataFrame([(i, h, p, "clash", "clash") for i, (h, p) in enumerate(data)], SCHEMA)


def test_records(spark):
    one = json.dumps([STORY, "%%BODY%%"])
    df = rows(spark, [("a", one), ("a", one), (None, json.dumps(["404 Not Found"])), ("a", None), ("a", "[]"), ("a", "no json"), ("a", '{"x": 1}'), ("a", json.dumps(["", " "])), ("a", json.dumps([STORY])), ("a", json.dumps([STORY * 5000 + " {{x}}", None, 3]))])
    got = {r.row_id: (list(r.kinds), r.evidence_lines) for r in R.residue(df).collect()}
    assert got == {0: (["template"], 1), 1: (["template"], 1), 2: (["error_page"], 1), 9: (["template"], 1)}
    assert R.residue(df.limit(0)).count() == 0


def test_recurrent_lines_are_boilerplate_whatever_their_evidence(spark):
    for line in ("Loading...", "404 Not Found", "Please enable JavaScript to comment."):
        framed = json.dumps([line, STORY])
        df = rows(spark, [("a", framed)] * 6 + [("b", framed)] + [("a", json.dumps([line, STORY, "{{ body }}"]))])
        assert [r.row_id for r in R.residue(df, recurrent=5).orderBy("row_id").collect()] == [6, 7]
        assert R.residue(df, recurrent=8).count() == 8
        # The same six lines among many records are no frame.
        many = rows(spark, [("a", framed)] * 6 + [("a", json.dumps([STORY]))] * 40)
        assert R.residue(many, recurrent=5).count() == 6
        # Nothing is framed where the line is all there is.
        alone = rows(spark, [("a", json.dumps([line]))] * 6 + [(None, json.dumps([line]))] * 6)
        assert R.residue(alone, recurrent=5).count() == 12


@pytest.mark.parametrize("line", ["Morbus tenebrarum vocet silvam, et fulgor undarum cadit.", "Quilum ventor marisque dolum satis crepit.", "Vastor nelum, priscum odorem fugit umbrarum."])
def test_filler_of_words_in_no_list(line):
    assert R.pseudo_latin(line.lower().replace(" et ", " atque "))


@pytest.mark.parametrize("line", ["The museum curator and the emperor sit in the forum.", "Doctor Ventor, visit us!", "Marcus Brutus Maximus met Julius Octavius in the forum.", "Der Kaiser ist ein Kurator des Museums."])
def test_prose_is_no_filler(line):
    assert not R.pseudo_latin(line.lower())
