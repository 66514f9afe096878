import random

import pytest

from quirefold.llm import mixing as X


def test_flow_repeats_as_little_as_possible():
    flows, total = X.plan({("a",): 100.0, ("b",): 10.0, ("a", "b"): 20.0}, {"a": (0.5, 1), "b": (0.5, 2)})
    assert total == pytest.approx(120, rel=1e-6)  # b reaches 2 * (10 + 20) tokens
    assert sum(v for (p, s), v in flows.items() if s == "b") == pytest.approx(60, rel=1e-6)
    flows, _ = X.plan({("a",): 100.0, ("b",): 10.0, ("a", "b"): 20.0}, {"a": (0.5, 1), "b": (0.5, 2)}, total=50)
    used = {p: sum(v for (q, _), v in flows.items() if q == p) for p in [("a",), ("b",), ("a", "b")]}
    assert used[("b",)] <= 10.0001 and used[("a", "b")] <= 20.0001 and sum(used.values()) == pytest.approx(50)  # nothing twice
    assert X.plan({}, {"a": (1.0, 1)}) == ({}, 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_totals_are_feasible(seed):
    draw = random.Random(seed)
    names = "abcd"
    patterns = {tuple(sorted(draw.sample(names, draw.randint(1, 3)))): draw.uniform(1, 100) for _ in range(6)}
    targets = {s: (draw.uniform(0.1, 1), draw.randint(1, 4)) for s in names}
    flows, total = X.plan(patterns, targets)
    present = {s for p in patterns for s in p}
    weight = sum(targets[s][0] for s in present)
    for s in present:
        assert sum(v for (_, t), v in flows.items() if t == s) == pytest.approx(total * targets[s][0] / weight, rel=1e-4)
    for p, w in patterns.items():
        used = {s: v for (q, s), v in flows.items() if q == p}
        assert all(v <= w * targets[s][1] * 1.000001 for s, v in used.items()) and sum(used.values()) <= w * max(targets[s][1] for s in p) * 1.000001


def test_mix(spark):
    rows = [(i, "a", f"text number {i} of many words here", 0) for i in range(400)] + [(1000 + i, "b", f"other text {i}", 0) for i in range(30)]
    rows += [(2000 + i, "b", f"text number {i} of many words here", 0) for i in range(50)] + [(3000, "a", None, 0), (3001, "a", " ", 0), (3002, None, "x y", 0), (3003, "unlisted", "x y z", 0), (3004, "a", "text number 1 of many words here", 0)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int").withColumnRenamed("tokens", "repeats")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 2), (None, None, None)], "source string, target_share double, max_repeats int")
    for bucket in (5000, 7):
        chosen, shares = X.mix(d, t, bucket=bucket)
        got = chosen.collect()
        assert len({r.doc_id for r in got}) == len(got) and all(r.repeats <= {"a": 1, "b": 3}[r.source] for r in got)
        reached = {r.source: r.reached_share for r in shares.collect()}
        assert reached["a"] == pytest.approx(0.625, abs=0.02) and reached["b"] == pytest.approx(0.375, abs=0.02) and reached["none"] == 0
        assert sorted(map(tuple, X.mix(d.repartition(5), t, bucket=bucket)[0].collect())) == sorted(map(tuple, got))
    chosen, shares = X.mix(d.limit(0), t)
    assert chosen.count() == 0 and {r.mix_tokens for r in shares.collect()} == {0}


def test_tokens_are_those_of_the_vocabulary(spark):
    import base64

    import tiktoken

    with open(X.TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=X.PIECES, mergeable_ranks=ranks, special_tokens={})
    text = "It's <|endoftext|> 12 Größe\n\n  x " * 3
    d = spark.createDataFrame([(1, "a", text)], "doc_id long, source string, text string")
    assert [r.tokens for r in X.token_counts(d).collect()] == [len(coder.encode_ordinary(text))]
    assert coder.decode(coder.encode_ordinary(text)) == text
