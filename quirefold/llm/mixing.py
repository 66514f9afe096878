"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

1. Tokens of each text are counted with a public tokenizer, whose file is a parameter.  Equal texts are one document,
   which may belong to several sources; the set of its sources is its membership pattern.  There are at most as many
   patterns as sets of sources that occur, whatever the number of documents.
2. Flow of tokens: from each pattern, whose r-th use of all its tokens costs r - 1, to the sources of the pattern, at most
   ``max_repeats`` uses for each, to the quota of each source, that is its share of the total.  The cheapest flow repeats
   as little as possible.
3. The total is the largest at which every source that has documents reaches its share, unless it is given.  Shares of
   listed sources without documents cannot be reached; the other shares keep their proportions.
4. Documents of a pattern stand in a seeded order, by their tokens on a line of length 1.  The flows of the pattern lie on
   the same line, end to end, going round; a document is used by a source as often as the source's stretch passes it.
   So no document is used more than its cap, and each source has its tokens but for one document at each end.

Null and blank texts, null sources and sources without a target are not used.  ``shares`` reports what is reached.
"""

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirefold.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers cut text into pieces.  A fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _counted(tokenizer: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            if not len(batch):
                continue
            counts = [len(coder.encode_ordinary(t)) for t in batch["text"]]
            yield pd.DataFrame({k: batch[k].tolist() for k in ("doc_id", "source", "text_key")} | {"tokens": counts})

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_key, tokens) of documents with text; ``text_key`` is equal for equal texts."""
    rows = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", "text", F.sha2("text", 256).alias("text_key")).where("text IS NOT NULL AND trim(text) <> ''")
    return rows.mapInPandas(_counted(tokenizer), "doc_id long, source string, text_key string, tokens long")


class Flow:
    """Min-cost flow on a small network by successive cheapest paths."""

    def __init__(self, nodes: int):
        self.edges: list[list[float]] = []  # to, room, cost
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: float, cost: float) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, room, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0.0, -cost])
        return len(self.edges) - 2

    def run(self, start: int, end: int, least: float = 1e-6) -> float:
        """Sends all that can be sent; the amount."""
        sent = 0.0
        while True:
            cost, via = [math.inf] * len(self.out), [-1] * len(self.out)
            cost[start], changed = 0.0, True
            for _ in range(len(self.out)):
                if not changed:
                    break
                changed = False
                for a, edges in enumerate(self.out):
                    if cost[a] == math.inf:
                        continue
                    for e in edges:
                        b, room, price = self.edges[e]
                        if room > least and cost[a] + price < cost[b] - 1e-12:
                            cost[b], via[b], changed = cost[a] + price, e, True
            if cost[end] == math.inf:
                return sent
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.edges[via[at] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount
            sent += amount


def route(patterns: dict[tuple[str, ...], float], targets: dict[str, tuple[float, int]], total: float) -> tuple[dict, float]:
    """({(pattern, source): tokens}, tokens sent) of the cheapest flow to quotas of ``total``.

    ``targets`` maps a source to (share, max_repeats); shares are used as given.
    """
    sets, sources = sorted(patterns), sorted(targets)
    end = 1 + len(sets) + len(sources)
    flow = Flow(end + 1)
    kept = {}
    for i, p in enumerate(sets):
        for r in range(max(targets[s][1] for s in p)):
            flow.add(0, 1 + i, patterns[p], float(r))
        for s in p:
            kept[p, s] = flow.add(1 + i, 1 + len(sets) + sources.index(s), patterns[p] * targets[s][1], 0.0)
    for j, s in enumerate(sources):
        flow.add(1 + len(sets) + j, end, targets[s][0] * total, 0.0)
    sent = flow.run(0, end)
    return {k: flow.edges[e ^ 1][1] for k, e in kept.items() if flow.edges[e ^ 1][1] > 1e-6}, sent


def plan(patterns: dict[tuple[str, ...], float], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict, float]:
    """(flows, total): flows by (pattern, source).  Without ``total`` it is the largest that all sources with documents can fill."""
    usable = {p: w for p, w in patterns.items() if w > 0 and p}
    present = {s for p in usable for s in p}
    weight = sum(targets[s][0] for s in present)
    if not present or weight <= 0:
        return {}, 0.0
    scaled = {s: (targets[s][0] / weight, targets[s][1]) for s in present}
    if total is None:
        lo, hi = 0.0, sum(w * max(scaled[s][1] for s in p) for p, w in usable.items())
        for _ in range(50):
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if route(usable, scaled, middle)[1] >= middle * (1 - 1e-9) else (lo, middle)
        total = lo
    return route(usable, scaled, total)[0], total


def mix(
    documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER, bucket: int = 5000
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): (doc_id, source, repeats, tokens), and what each listed source reaches.

    ``documents`` has doc_id, source and text, ``targets`` source, target_share and max_repeats (a short list).
    """
    spark = documents.sparkSession
    wanted = {
        r["source"]: (float(r["target_share"]), int(r["max_repeats"]))
        for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()
    }
    listed = targets.where("target_share > 0 AND max_repeats > 0").select("source")
    counted = token_counts(documents.join(F.broadcast(listed), "source", "left_semi"), tokenizer).where("tokens > 0")
    # One document per text and source, then one row per text; both shrink before the shuffle, so copies do not gather.
    single = counted.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = cut(
        single.groupBy("text_key")
        .agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("of"))
        .withColumn("pattern", F.concat_ws("\u001f", "of.source"))
        .withColumn("place", F.xxhash64(F.lit(seed), "text_key"))
        .select("text_key", "tokens", "of", "pattern", "place")
    )
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    patterns = {tuple(r["pattern"].split("\u001f")): float(r["tokens"]) for r in sums}
    counts = {r["pattern"]: r["n"] for r in sums}
    flows, _ = plan(patterns, wanted, total)

    stretches, at = [], {}
    for (p, s), tokens in sorted(flows.items()):
        begin = at.get(p, 0.0)
        at[p] = begin + tokens / patterns[p]
        stretches.append(("\u001f".join(p), s, begin, at[p], patterns[p], max(1, counts["\u001f".join(p)] // bucket)))
    lines = spark.createDataFrame(stretches, "pattern string, source string, begin double, end double, whole double, buckets long")
    buckets = F.broadcast(lines.select("pattern", "whole", "buckets").distinct())
    placed = texts.join(buckets, "pattern").withColumn("bucket", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * F.col("buckets")).cast("long"))
    before = (
        placed.groupBy("pattern", "bucket")
        .agg(F.sum("tokens").alias("sum"))
        .withColumn("before", F.sum("sum").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("sum"))
        .select("pattern", "bucket", "before")
    )
    inside = W.partitionBy("pattern", "bucket").orderBy("place", "text_key").rowsBetween(W.unboundedPreceding, 0)
    positioned = (
        placed.withColumn("upto", F.sum("tokens").over(inside))
        .join(before, ["pattern", "bucket"])
        .withColumn("u", (F.col("before") + F.col("upto") - F.col("tokens") / 2) / F.col("whole"))  # the middle of the document
    )
    # Whole numbers k with begin <= u + k < end.
    uses = F.ceil(F.col("end") - F.col("u")) - F.ceil(F.col("begin") - F.col("u"))
    chosen = (
        positioned.join(F.broadcast(lines.select("pattern", "source", "begin", "end")), "pattern")
        .withColumn("repeats", uses.cast("int"))
        .where("repeats > 0")
        .select(F.expr("filter(of, x -> x.source = source)[0].doc_id").alias("doc_id"), "source", "repeats", "tokens")
    )
    reached = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats")
    )
    whole = reached.agg(F.sum("mix_tokens")).scalar()
    shares = (
        targets.select("source", "target_share", "max_repeats")
        .join(reached, "source", "left")
        .select(
            "source",
            "target_share",
            F.coalesce(F.col("mix_tokens") / whole, F.lit(0.0)).alias("reached_share"),
            F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            "max_repeats",
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
    return chosen, shares
