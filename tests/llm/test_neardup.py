import itertools
import json
import random
import re

import numpy as np

from quirefold.llm import neardup as N
from quirefold.llm import words


def shingles(text, size):
    w = re.findall(r"[^\W_]+", text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(seed=1, n=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(4000)]
    texts = []
    for _ in range(n):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(40, 160))]
        texts.append(base)
        for _ in range(draw.randint(0, 3)):
            copy = list(base)
            for _ in range(draw.randint(0, 12)):
                k = draw.randrange(len(copy))
                draw.choice([lambda: copy.pop(k), lambda: copy.insert(k, draw.choice(vocabulary)), lambda: copy.__setitem__(k, "x")])()
            texts.append(copy)
    return [" ".join(t) for t in texts]


def pairs(spark, rows, **options):
    df = spark.createDataFrame(rows, "row_id long, body string, id string, n string")
    members, links = N.forest_pairs(df, "row_id", "body", **options)
    return {(r.row_a, r.row_b): r.similarity for r in N.expand(members, links, piece=2).collect()}


def test_words_are_those_of_the_pattern():
    texts = ["", "a", "Ünï-cödé x_y 12ab ², ٣ 中文、日本 ﬁ".lower(), "\U0001d400 b\n c", "x" * 70_000 + " y"]
    value, number, start, end = words.word_hashes(texts)
    got = [(number[i], texts[number[i]][start[i] : end[i]]) for i in range(len(value))]
    assert got == [(k, m) for k, t in enumerate(texts) for m in re.findall(r"[^\W_]+", t)]
    by_word = {}
    for (_, w), v in zip(got, value):
        assert by_word.setdefault(w, v) == v
    assert len(set(by_word.values())) == len(by_word)


def test_signatures_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(130, 530))
    sig, counts = N.signatures([a, b, "short"], 3, 2048, 1)
    want = jaccard(shingles(a, 3), shingles(b, 3))
    assert abs(np.mean(sig[0] == sig[1]) - want) < 0.05 and counts.tolist() == [398, 398, 0]


def test_pairs_against_brute_force(spark):
    texts = corpus()
    got = pairs(spark, [(i, t, "clash", "clash") for i, t in enumerate(texts)], threshold=0.5, shingle=3)
    sets = [shingles(t, 3) for t in texts]
    want = {(i, j): jaccard(sets[i], sets[j]) for i, j in itertools.combinations(range(len(texts)), 2)}
    want = {p: s for p, s in want.items() if s >= 0.5}
    assert not set(got) - set(want)
    assert len(set(want) - set(got)) <= 0.02 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_crowded_nodes_lose_nothing(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base, f"only{k}", f"also{k}"]), "", "") for k in range(60)]
    got = pairs(spark, rows, threshold=0.8, crowd=3, block=7)
    assert len(got) == 60 * 59 // 2


def test_copies_form_classes(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = text + " end"
    rows = [(k, text, "", "") for k in range(9)] + [(20, other, "", ""), (21, None, "", ""), (22, "", "", ""), (23, "two words", "", ""), (24, "two words", "", "")]
    got = pairs(spark, rows, threshold=0.8)
    assert {p for p in got if p[1] < 9} == set(itertools.combinations(range(9), 2))
    assert {p for p in got if 20 in p} == {(k, 20) for k in range(9)}
    assert {p for p in got if p[0] > 20} == {(23, 24)}


def test_json_bodies_and_lengths(spark):
    same = ["A  line of text", "and  another line of it, quite long enough"]
    rows = [(1, json.dumps(same), "", ""), (2, json.dumps(same, indent=1).upper().replace("\\N", "\\n"), "", ""), (3, "no json", "", ""), (4, "[]", "", ""), (5, '{"a": 1}', "", ""), (6, json.dumps([None, 1]), "", "")]
    got = pairs(spark, rows, read=N.read_json_body, threshold=0.5, shingle=3, least=50)
    assert set(got) == {(1, 2)}
    assert pairs(spark, rows, read=N.read_json_body, threshold=0.5, shingle=3, least=300) == {}
    assert pairs(spark, rows[:0], threshold=0.5) == {}


def test_broadcast_and_shuffle_give_the_same(spark):
    rows = [(i, t, "", "") for i, t in enumerate(corpus(4, 30))]
    assert pairs(spark, rows, threshold=0.5, shingle=3) == pairs(spark, rows, threshold=0.5, shingle=3, broadcast_ids=0)


def test_recall_is_the_same_in_crowded_families(spark):
    core = " ".join(f"w{i}" for i in range(100))
    texts = [core + " " + " ".join(f"own{k}x{i}" for i in range(48)) for k in range(40)]
    sets = [shingles(t, 3) for t in texts]
    assert all(0.5 <= jaccard(a, b) < 0.51 for a, b in itertools.combinations(sets, 2))
    got = pairs(spark, [(k, t, "", "") for k, t in enumerate(texts)], threshold=0.5, shingle=3)
    assert len(got) >= 0.99 * 40 * 39 / 2
    few = pairs(spark, [(k, t, "", "") for k, t in enumerate(texts[:4])], threshold=0.5, shingle=3)
    assert set(few) == {p for p in got if p[1] < 4}


def test_crowded_node_of_a_thousand_at_the_threshold(spark):
    """Over 1,000 texts of similarity 0.50 to 0.55 to each other, so each shared label is a crowded node; several blocks, many ranges."""
    core = " ".join(f"w{i}" for i in range(64))
    texts = [core + " " + " ".join(f"own{k}x{i}" for i in range(26)) for k in range(1050)]
    one, two = shingles(texts[0], 3), shingles(texts[1], 3)
    assert 0.5 <= jaccard(one, two) < 0.55
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row_id long, body string")
    members, links = N.forest_pairs(df, "row_id", "body", threshold=0.5, shingle=3, block=256, entries=20_000)
    assert members.count() == 1050
    assert links.count() >= 0.99 * 1050 * 1049 / 2


def test_entries_packed_and_unpacked():
    draw = np.random.default_rng(3)
    for top in (1, 200, 70_000, 2**40, 2**62):
        node = np.sort(draw.integers(0, top, 50, dtype=np.int64))
        ids = draw.integers(-top, top, 50, dtype=np.int64)
        got = N.unpack_entries(N.pack_entries(node, ids))
        assert (got[0] == node).all() and (got[1] == ids).all()


def test_labels_are_shortened_to_the_recall():
    assert N.label_lengths(0.8, 108, 8, 0.999) == [8] * 108
    lengths = N.label_lengths(0.5, 108, 8, 0.999)
    assert np.prod([1 - 0.5**x for x in lengths]) <= 0.001 and min(lengths) >= 4
    assert N.label_lengths(1.0, 2, 8, 0.999) == [8, 8]
