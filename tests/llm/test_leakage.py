import random
import re

import numpy as np

from quirefold.llm import leakage as L
from quirefold.llm import words


def runs(document, item, n):
    a, b = (re.findall(r"[^\W_]+", t.lower()) for t in (document, item))
    grams = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
    return any(tuple(b[i : i + n]) in grams for i in range(len(b) - n + 1))


def test_sliding_sums():
    rows = np.random.default_rng(0).integers(-3, 3, (50, 4)).astype(np.int32)
    for n in (1, 2, 5, 11, 12, 50):
        assert (L._sliding(rows, n) == np.stack([rows[i : i + n].sum(axis=0) for i in range(50 - n + 1)])).all()


def test_fingerprints_of_equal_runs_are_equal_and_of_near_runs_near():
    value = words.word_hashes([" ".join(f"w{i}" for i in range(40))])[0]
    prints = L.fingerprints(value, 12)
    assert (L.fingerprints(value[5:20], 12) == prints[5:9]).all()
    other = value.copy()
    other[11] ^= np.uint64(99)
    assert np.bitwise_count(prints[0] ^ L.fingerprints(other, 12)[0]) < 24


def test_blocks_find_all_within_the_radius():
    draw = np.random.default_rng(1)
    for radius in (1, 3, 4):
        base = draw.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
        near = base.copy()
        for k in range(len(near)):
            for bit in draw.choice(64, draw.integers(0, radius + 3), replace=False):
                near[k] ^= np.uint64(1) << np.uint64(bit)
        at, which = L._Index(base, radius).within(near)
        want = {(i, j) for i in range(300) for j in range(300) if bin(int(near[i] ^ base[j])).count("1") <= radius}
        assert set(zip(at.tolist(), which.tolist())) == want


def test_leaks_against_brute_force(spark):
    draw = random.Random(2)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(5, 40)))) for i in range(20)]
    documents = []
    for k in range(120):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(0, 120))]
        if k % 2:
            w = draw.choice(items)[1].split()
            n = draw.randint(8, 20)
            at = draw.randrange(max(1, len(w) - n))
            part = draw.choice([", ", "\n", " -- "]).join(x.upper() if draw.random() < 0.3 else x for x in w[at : at + n])
            text.insert(len(text) // 2, part)
        documents.append((k, " ".join(text)))
    documents += [(500, None), (501, ""), (502, items[3][1]), (502, items[3][1])]
    items += [(90, None), (91, ""), (None, items[3][1]), (92, items[3][1])]
    d = spark.createDataFrame([(*x, "clash") for x in documents], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(dk, ik) for dk, dt in documents if dt for ik, it in items if it and ik is not None and runs(dt, it, 12)}
    got = L.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, i, held_windows=50).collect()} == want
    n = len(items[3][1].split())
    if n >= 12:
        assert {r.longest_run for r in got if r.doc_id == 502 and r.item_id == 3} == {n}
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_changed_words_are_found_below_full_similarity(spark):
    item = " ".join(f"w{i}" for i in range(30))
    changed = item.replace("w7 ", "other ").replace("w25", "more")
    d, i = spark.createDataFrame([(1, changed)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    exact = L.leaks(d, i).collect()
    assert [(r.longest_run, r.similarity) for r in exact] == [(17, 1.0)]
    short = spark.createDataFrame([(1, " ".join(changed.split()[:12]))], "doc_id long, text string")
    assert L.leaks(short, i).count() == 0
    near = L.leaks(short, i, radius=31, least_similarity=0.6).collect()
    assert len(near) == 1 and near[0].longest_run == 0 and 0.6 <= near[0].similarity < 1


def test_a_very_long_document(spark):
    item = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, "x y " * 60_000 + item + " z" * 60_000)], "doc_id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert L.leaks(d, i).count() == 1


def test_near_windows_against_brute_force(spark, tmp_path):
    from collections import Counter

    from quirefold.llm.queries import p7_near

    draw = random.Random(7)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(11, 18)))) for i in range(8)]
    documents = []
    for k in range(60):
        w = draw.choice(items)[1].split()[:13]
        for _ in range(k % 4):
            at = draw.randrange(len(w))
            draw.choice([lambda: w.pop(at), lambda: w.insert(at, "new"), lambda: w.__setitem__(at, "other")])()
        documents.append((k, " ".join([draw.choice(vocabulary) for _ in range(6)] + w + ["end"] * 3)))
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))

    def shingles(text):
        w = text.split()
        return [Counter({**{x: 2 * n for x, n in Counter(v).items()}, **Counter(zip(v, v[1:]))}) for v in (w[i : i + 12] for i in range(len(w) - 11))]

    want = {}
    for dk, dt in documents:
        for ik, it in items:
            best = max((sum((x & y).values()) / sum((x | y).values()) for x in shingles(dt) for y in shingles(it)), default=0)
            if best >= 0.6:
                want[dk, ik] = round(best, 6)
    got = {(r.doc_id, r.item_id): r.similarity for r in p7_near(spark, str(tmp_path)).collect()}
    assert got == want and sum(s < 1 for s in want.values()) > 15
