import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import packing as K


@pytest.mark.parametrize("seed", range(5))
def test_fullest_against_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(60):
        lengths = draw.sample(range(1, 40), draw.randint(0, 5))
        counts = [draw.randint(1, 4) for _ in lengths]
        room = draw.randint(0, 90)
        taken = K.fullest(lengths, counts, room)
        sums = [sum(a * b for a, b in zip(t, lengths)) for t in itertools.product(*[range(c + 1) for c in counts])]
        assert sum(a * b for a, b in zip(taken, lengths)) == max(s for s in sums if s <= room)
        assert all(0 <= t <= c for t, c in zip(taken, counts))


def test_pack():
    draw = np.random.default_rng(1)
    lengths = draw.integers(0, 900, 2000)
    bins = K.pack(lengths, 1000)
    sums = np.bincount(bins, weights=lengths)
    assert bins.min() >= 0 and sums.max() <= 1000 and len(sums) <= 1.02 * np.ceil(lengths.sum() / 1000)
    assert K.pack(np.array([5, 5, 5, 5]), 10).tolist().count(0) == 2
    assert K.pack(np.array([], dtype=np.int64), 10).tolist() == [] and K.pack(np.array([0, 0]), 10).tolist() == [0, 0]


def test_fill(spark):
    rows = [(i, s, 100, "a") for i, s in enumerate([60, 40, 250, 0, 100, 30, 30, 40])] + [(50, 10, 7, "b"), (51, None, 7, "b"), (52, 3, None, "b"), (53, 4, 7, None), (0, 60, 100, "a")]
    df = spark.createDataFrame(rows, "id long, size long, capacity long, db string").withColumn("window", F.lit("clash")).withColumn("n", F.lit(1))
    for window in (2000, 3):
        got = K.fill(df, "db", window).collect()
        assert sorted((r.id, r.piece) for r in got) == sorted([(i, 0) for i in (0, 0, 1, 3, 4, 5, 6, 7)] + [(2, 0), (2, 1), (2, 2), (50, 0), (50, 1)])
        sums = {}
        for r in got:
            sums[r.db, r.window, r.block] = sums.get((r.db, r.window, r.block), 0) + r.piece_size
            assert sums[r.db, r.window, r.block] <= r.capacity
        assert sum(v for k, v in sums.items() if k[0] == "a") == 610
    assert K.fill(df.limit(0), "db").count() == 0


def test_bodies_of_routed_novels(spark):
    chapters = spark.createDataFrame([(1, "a", "[\"é\"]"), (2, "a", None), (3, "b", "[]"), (4, None, "[]"), (5, "c", "[]")], "row_id long, novel_id string, paragraphs_json string")
    routes = spark.createDataFrame([(1, "a", "x", None), (2, "a", "y", None), (3, "b", "gone", None), (4, "c", None, None)], "route_id long, novel_id string, database_id string, assigned_at timestamp")
    shards = spark.createDataFrame([("x", 8), ("y", 8)], "database_id string, block_bytes long")
    got = K.block_bodies(chapters, routes, shards).collect()
    assert [(r.row_id, r.database_id, r.piece_bytes) for r in got] == [(1, "y", 6)]
