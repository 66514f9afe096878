"""Near-duplicate texts with small edits: a MinHash LSH forest with exact verification.

1. Rows with the same normalised text form a class; only one representative per class goes on, so a
   group of copies costs one row however large it is.
2. A representative gets one label of MinHash values per tree of the forest.  Labels start ``longest`` values long and are
   shortened, tree after tree, one value at a time, until a pair at the threshold shares the label of some tree with the
   chance ``recall``, 1 - product(1 - threshold**length).  The lengths follow from these parameters only, so the recall
   is the same at every size and in every node.
3. The tries are sorted sequences of (tree, label, id).  Each batch of rows is sorted by itself and sent to ranges of the
   labels in packed form, about half the bytes of plain rows; a range puts its sorted stretches together.  A label that
   ``crowd`` rows of one batch share does not travel to its range: these rows leave at once as a block of ids, and the
   range is told, so that a label of a third of all rows fills no range.  Labels with a block anywhere, or with more than
   ``crowd`` rows, are crowded nodes: all their rows form blocks, blocks get their sketches, and each pair of blocks is
   compared by itself.  No task holds a crowded node, and of its pairs only likely ones become rows.
4. A candidate pair is held against one-bit MinHash sketches (the chance that a pair at the threshold is lost there
   is under 1e-4), then its distinct shingles are compared exactly.

Null, unreadable and too short texts are in no pair.  Texts without a full shingle have no similarity.
Repeated rows are pairs like any other; ties do not matter because every pair is judged on its own.
"""

import hashlib
import json
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirefold.llm import words
from quirefold.session import cut, spread

_U = np.uint64
SKETCH_WORDS = 4


def _parameters(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    a = draw.integers(1, 2**63, n, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    return a, draw.integers(0, 2**63, n, dtype=np.int64).astype(_U)


def signatures(texts: list[str], size: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x n MinHash values of 32 bits, shingles with repeats per text)."""
    value, number = words.shingles(texts, size)
    counts = np.bincount(number, minlength=len(texts)) if len(number) else np.zeros(len(texts), dtype=np.int64)
    out = np.full((len(texts), n), 0xFFFFFFFF, dtype=np.uint32)
    if not len(value):
        return out, counts
    a, b = _parameters(n, seed)
    some = np.flatnonzero(counts)
    starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
    step = 4096
    bounds = np.searchsorted(starts, np.arange(0, len(value), step))
    bounds = np.unique(np.append(bounds, len(some)))
    with np.errstate(over="ignore"):
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            first = starts[lo]
            last = starts[hi] if hi < len(some) else len(value)
            part, at = value[first:last], starts[lo:hi] - first
            for k in range(0, n, 16):
                hashed = ((part[None, :] * a[k : k + 16, None] + b[k : k + 16, None]) >> _U(32)).astype(np.uint32)
                out[some[lo:hi], k : k + 16] = np.minimum.reduceat(hashed, at, axis=1).T
    return out, counts


def _fold(parts: np.ndarray) -> np.ndarray:
    """One 64-bit value of the columns of each row."""
    total = np.zeros(parts.shape[:-1], dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(parts.shape[-1]):
            total = words.mix(total * _U(0xD6E8FEB86659FD93) + parts[..., k].astype(_U) + _U(1))
    return total


def _read(value: str | None) -> str:
    try:
        found = json.loads(value) if value else None
    except ValueError:
        found = None
    return words.body(found) if isinstance(found, list) else ""


def read_json_body(values: pd.Series) -> list[str]:
    """Normalised bodies of JSON arrays of strings; what is null or unreadable becomes empty."""
    return [_read(v) for v in values]


def read_plain(values: pd.Series) -> list[str]:
    """Normalised plain texts."""
    return [words.body([v]) if isinstance(v, str) else "" for v in values]


def _described(read: Callable, shingle: int, least: int, lengths: list[int], seed: int) -> Callable:
    n_sketch = SKETCH_WORDS * 64
    ends = np.cumsum(lengths)

    def labels(sig: np.ndarray) -> np.ndarray:
        # 32 bits are enough within a tree: labels that meet by chance only add candidates.
        out = np.empty((len(sig), len(lengths)), dtype=np.uint32)
        for length in set(lengths):
            own = np.flatnonzero(np.array(lengths) == length)
            at = (ends[own] - length)[:, None] + np.arange(length)
            out[:, own] = (_fold(sig[:, at]) >> _U(32)).astype(np.uint32)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                texts = read(part["text"])
                keep = [i for i, t in enumerate(texts) if len(t) >= least]
                if not keep:
                    continue
                kept = [texts[i] for i in keep]
                sig, counts = signatures(kept, shingle, max(int(ends[-1]), n_sketch), seed)
                bits = np.packbits((sig[:, :n_sketch] & 1).astype(np.uint8), axis=1).view(np.int64)
                digest = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in kept]
                digest = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy()[keep],
                        "digest": digest[:, 0],
                        "check": digest[:, 1],
                        "n": counts,
                        "node": [x.tobytes() for x in labels(sig)],
                        "sketch": list(bits),
                    }
                )

    return run


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Non-negative values in as few bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return width, x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(_U)


def pack_entries(node: np.ndarray, ids: np.ndarray) -> bytes:
    """Rising nodes and their ids as differences."""
    base = int(ids.min())
    wn, steps = _narrow(np.diff(node, prepend=node[:1]))
    wi, offsets = _narrow(ids.view(_U) - np.int64(base).view(_U))
    return struct.pack("<qqIBB", int(node[0]), base, len(node), wn, wi) + steps + offsets


def unpack_entries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, base, n, wn, wi = struct.unpack_from("<qqIBB", raw)
    at = struct.calcsize("<qqIBB")
    node = np.cumsum(_wide(raw[at : at + n * wn], wn)).view(np.int64) + first
    return node, (_wide(raw[at + n * wn :], wi) + np.int64(base).view(_U)).view(np.int64)


def _routed(trees: int, ranges: int, crowd: int) -> Callable:
    """(range, entries, node, members): packed entries of a range, or a block of a crowded node and the range that is told of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            label = np.frombuffer(b"".join(batch["node"]), dtype=np.uint32).reshape(len(batch), trees)
            node = (label.astype(np.int64) + (np.arange(trees, dtype=np.int64) << 32)).ravel()
            ids = np.repeat(batch["id"].to_numpy().astype(np.int64), trees)
            order = np.lexsort((ids, node))
            node, ids = node[order], ids[order]
            lows = np.flatnonzero(np.diff(node, prepend=-1))
            sizes = np.diff(lows, append=len(node))
            out: dict[str, list] = {"range": [], "entries": [], "node": [], "members": []}

            def add(*row: object) -> None:
                for name, value in zip(out, row):
                    out[name].append(value)

            space = trees << 32
            for k in np.flatnonzero(sizes >= crowd):
                own = int(node[lows[k]])
                add(own * ranges // space, None, own, ids[lows[k] : lows[k] + sizes[k]])
            light = np.repeat(sizes < crowd, sizes)
            node, ids = node[light], ids[light]
            to = node * ranges // space
            for lo, hi in zip(cuts := np.flatnonzero(np.diff(to, prepend=-1)), np.append(cuts[1:], len(to))):
                add(int(to[lo]), pack_entries(node[lo:hi], ids[lo:hi]), None, None)
            yield pd.DataFrame({"range": out["range"], "entries": out["entries"], "node": pd.array(out["node"], dtype="Int64"), "members": out["members"]})

    return run


def _pairs_of(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(len(members), 1)
    return members[i], members[j]


def _walk(crowd: int, block: int) -> Callable:
    """Rows sorted by range come in; pairs of ids that share a label go out, and blocks of crowded nodes."""

    def of_range(parts: list[tuple[np.ndarray, np.ndarray]], crowded: list[int]) -> Iterator[pd.DataFrame]:
        if not parts:
            return
        node, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, node))
        node, ids = node[order], ids[order]
        lows = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(lows, append=len(node))
        many = (sizes > crowd) | np.isin(node[lows], np.array(crowded, dtype=np.int64))
        for size in range(2, crowd + 1):
            at = lows[~many & (sizes == size)]
            i, j = np.triu_indices(size, 1)
            step = max(1, 100_000 // len(i))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step, None]
                yield pd.DataFrame({"a": ids[part + i].ravel(), "b": ids[part + j].ravel(), "node": 0, "members": None})
        for k in np.flatnonzero(many):
            own = ids[lows[k] : lows[k] + sizes[k]]
            members = [own[lo : lo + block] for lo in range(0, len(own), block)]
            yield pd.DataFrame({"a": 0, "b": 0, "node": int(node[lows[k]]), "members": members})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, crowded = None, [], []
        for batch in batches:
            for own, entries, node in zip(batch["range"].tolist(), batch["entries"], batch["node"]):
                if own != at:
                    yield from of_range(parts, crowded)
                    at, parts, crowded = own, [], []
                if entries is None:
                    crowded.append(int(node))
                else:
                    parts.append(unpack_entries(entries))
        yield from of_range(parts, crowded)

    return run


def _block_pairs(sketch_least: float) -> Callable:
    """Likely pairs between two blocks, (n, sketch) of whose rows come along; in stretches that fit the processor's cache."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y, sx, sy, same in zip(batch["x"], batch["y"], batch["sx"], batch["sy"], batch["same"]):
                x, y = np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)
                sx, sy = np.asarray(sx, dtype=np.int64).view(_U).reshape(len(x), -1), np.asarray(sy, dtype=np.int64).view(_U).reshape(len(y), -1)
                for lo in range(0, len(x), 128):
                    apart = np.zeros((len(x[lo : lo + 128]), len(y)), dtype=np.uint16)
                    for k in range(SKETCH_WORDS):
                        apart += np.bitwise_count(sx[lo : lo + 128, k, None] ^ sy[None, :, k])
                    i, j = np.nonzero(apart <= (1 - sketch_least) * 64 * SKETCH_WORDS)
                    i += lo
                    kept = (x[i] < y[j]) if same else (x[i] != y[j])
                    a, b = x[i[kept]], y[j[kept]]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def crowded_pairs(blocks: DataFrame, sketches: DataFrame, sketch_least: float) -> DataFrame:
    """(a, b), a < b: likely pairs of the nodes that left the walk as blocks (node, members); pairs may come several times.

    Pairs of block numbers are unfolded and spread before any ids are fetched.  Nodes with a single block of one row have no pair.
    """
    # Within a node blocks hold rising ids, so the first id names a block.
    named = blocks.withColumn("first", F.col("members")[0])
    order = W.partitionBy("node").orderBy("first")
    numbers = named.select("node", "first", F.size("members").alias("n")).withColumn("i", F.row_number().over(order).cast("int"))
    counts = numbers.groupBy("node").agg(F.max("i").alias("blocks"), F.sum("n").alias("rows")).where("rows > 1")
    numbers = numbers.join(counts, "node").select("node", "first", "i", "blocks")
    rows = named.join(numbers, ["node", "first"]).select("node", "i", F.explode("members").alias("id")).join(sketches.where("n > 0"), "id")
    held = rows.groupBy("node", "i").agg(F.collect_list(F.struct("id", "sketch")).alias("all"))
    held = held.select("node", "i", F.col("all.id").alias("ids"), F.flatten("all.sketch").alias("s"))
    pairs = numbers.select("node", "i", F.explode(F.sequence("i", "blocks")).alias("j"))
    x = held.select("node", "i", F.col("ids").alias("x"), F.col("s").alias("sx"))
    y = held.select("node", F.col("i").alias("j"), F.col("ids").alias("y"), F.col("s").alias("sy"))
    return (
        pairs.join(x, ["node", "i"])
        .join(y, ["node", "j"])
        .select("x", "y", "sx", "sy", F.expr("i = j").alias("same"))
        .mapInPandas(_block_pairs(sketch_least), "a long, b long")
    )


def _likely(sketch_least: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["sa"].to_numpy()).view(_U)
            y = np.stack(batch["sb"].to_numpy()).view(_U)
            same = 64 * SKETCH_WORDS - np.bitwise_count(x ^ y).sum(axis=1)
            n, m = batch["na"].to_numpy(), batch["nb"].to_numpy()
            keep = (same >= sketch_least * 64 * SKETCH_WORDS) & (n > 0) & (m > 0)
            yield batch.loc[keep, ["a", "b"]]

    return run


def _shingle_sets(read: Callable, shingle: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = words.distinct_shingles(read(part["text"]), shingle)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "set": [s.view(np.int64) for s in sets]})

    return run


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = np.empty(len(batch))
            for k, (x, y) in enumerate(zip(batch["xa"], batch["xb"])):
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                value[k] = both / either if either else 0.0
            keep = value >= threshold
            yield pd.DataFrame({"a": batch["a"][keep], "b": batch["b"][keep], "similarity": value[keep]})

    return run


def label_lengths(threshold: float, trees: int, longest: int, recall: float) -> list[int]:
    """The values that the labels of each tree keep: shortened one by one until a pair at the threshold is found with the chance ``recall``."""
    lengths = [longest] * trees

    def missed() -> float:
        return math.prod(1 - threshold**x for x in lengths)

    while missed() > 1 - recall and max(lengths) > 1:
        lengths[lengths.index(max(lengths))] -= 1
    return lengths


def forest_pairs(
    df: DataFrame,
    identity: str,
    text: str,
    read: Callable = read_plain,
    threshold: float = 0.8,
    shingle: int = 5,
    least: int = 1,
    trees: int = 108,
    longest: int = 8,
    recall: float = 0.999,
    crowd: int = 64,
    block: int = 1024,
    entries: int = 1_000_000,
    seed: int = 20,
    broadcast_ids: int = 500_000,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, class, class_size) of each row, and (a, b, similarity) between classes, a < b.

    ``identity`` is a unique BIGINT column, ``text`` the column that ``read`` turns into normalised texts; other columns
    are not touched, so their names cannot clash.  A class is named by its smallest id.  ``members`` has the rows whose
    text has at least ``least`` characters; ``links`` the pairs of classes with at least the similarity ``threshold``,
    each found with a chance of at least ``recall`` whatever other rows there are.  ``entries`` is how many labels a range gets.
    Id sets are broadcast up to ``broadcast_ids`` ids (8 bytes each) and joined by shuffle beyond.
    """
    lengths = label_lengths(threshold, trees, longest, recall)
    sketch_least = 0.5 + threshold / 2 - 0.12
    source = df.select(F.col(identity).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    found = cut(
        spread(source).mapInPandas(
            _described(read, shingle, least, lengths, seed),
            "id long, digest long, check long, n long, node binary, sketch array<long>",
        )
    )
    sized = found.groupBy("digest", "check").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("class_size"))
    members = cut(found.select("id", "digest", "check").join(sized, ["digest", "check"]).select("id", "class", "class_size"))
    others = members.where("id <> class").select("id")

    def only(rows: DataFrame, ids: DataFrame, how: str, n: int) -> DataFrame:
        return rows.join(F.broadcast(ids) if n <= broadcast_ids else ids, "id", how)

    n_others, n = others.count(), members.count()
    first = only(found, others, "left_anti", n_others)
    ranges = max(1, math.ceil((n - n_others) * len(lengths) / entries))
    routed = first.where("n > 0").select("node", "id").mapInPandas(_routed(len(lengths), ranges, crowd), "range int, entries binary, node long, members array<long>")
    walked = cut(
        routed.select("range", "entries", "node")
        .repartitionById(min(ranges, 100_000), "range")
        .sortWithinPartitions("range")
        .mapInPandas(_walk(crowd, block), "a long, b long, node long, members array<long>")
    )
    sketches = found.select("id", "n", "sketch")
    blocks = walked.select("node", "members").unionByName(routed.select("node", "members")).where("members IS NOT NULL")
    crowded = crowded_pairs(blocks, sketches, sketch_least)
    pairs = cut(walked.where("members IS NULL").select("a", "b").distinct())
    paired = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    known = only(sketches, paired, "left_semi", paired.count())
    sparse = (
        pairs.join(known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .mapInPandas(_likely(sketch_least), "a long, b long")
    )
    likely = cut(sparse.unionByName(crowded).distinct())
    wanted = cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = only(source, wanted, "left_semi", wanted.count()).mapInPandas(_shingle_sets(read, shingle), "id long, set array<long>")
    links = (
        likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
        .mapInPandas(_verify(threshold), "a long, b long, similarity double")
    )
    return members, links


def expand(members: DataFrame, links: DataFrame, piece: int = 1000) -> DataFrame:
    """(row_a, row_b, similarity), row_a < row_b: the pairs of rows behind the classes and links.

    Classes are cut into pieces of about ``piece`` rows by a hash of the id, and pieces are paired, so that no
    task gets all copies of a text.
    """
    pieces = F.ceil(F.col("class_size") / piece).cast("int")
    placed = members.select("id", "class", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece"))
    sizes = members.where("id = class").select("class", pieces.alias("pieces"), "class_size")
    own = sizes.where("class_size > 1").select(
        F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"), F.col("pieces").alias("pa"), F.col("pieces").alias("pb")
    )
    between = links.join(sizes.select(F.col("class").alias("a"), F.col("pieces").alias("pa")), "a").join(
        sizes.select(F.col("class").alias("b"), F.col("pieces").alias("pb")), "b"
    )
    return (
        own.unionByName(between.select("a", "b", "similarity", "pa", "pb"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)))
        .where("a <> b OR i <= j")
        .join(placed.select(F.col("id").alias("x"), F.col("class").alias("a"), F.col("piece").alias("i")), ["a", "i"])
        .join(placed.select(F.col("id").alias("y"), F.col("class").alias("b"), F.col("piece").alias("j")), ["b", "j"])
        .where("a <> b OR i < j OR x < y")
        .select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"), "similarity")
    )
