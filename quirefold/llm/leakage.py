"""Evaluation passages inside a corpus: SimHash windows, Hamming blocks, exact verification.

1. Every run of ``window`` words of an item becomes a 64-bit SimHash of its weighted shingles (words, and pairs of
   neighbouring words at half weight).  The windows of the items are the query set; they are held in every task,
   because evaluation sets are small: ``held_windows`` is the most that is allowed, and a larger set is worked
   through in several passes of that many windows.
2. The same fingerprint is taken of each run of ``window`` words of each document, with sliding sums over words.
3. A fingerprint is cut into radius + 1 blocks.  Two fingerprints within the radius are equal in at least one block
   (pigeonhole), so looking up each block in a table finds all of them.
   Equal windows have equal fingerprints.  Windows with a changed word are mostly farther apart than blocks can
   reach, so below full similarity candidates come from shared pairs of neighbouring words instead: a window at
   the least similarity shares at least ``_least_pairs`` of them, so none is lost.
4. Candidates are verified on the words themselves.  The similarity of a window and a run is the weight of the
   shingles they share, as multisets, divided by the weight of either; a run is exact when all its words are equal.

``leaks`` reports (document, item) once per pair with the longest exact run and the best similarity.  Null and blank
texts and items shorter than the window leak nothing; an item or document that occurs twice is reported
for each of its ids.  Documents of any length are worked through whole, in pieces that overlap by a window.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import words
from quirefold.session import spread

_U = np.uint64


def _signs(value: np.ndarray, weight: int, kind: type) -> np.ndarray:
    """n x 64 signs of 64-bit hashes, times a weight."""
    octets = value.astype(">u8").view(np.uint8).reshape(-1, 8)
    return (np.unpackbits(octets, axis=1).view(np.int8).astype(kind) * 2 - 1) * kind(weight)


def _sliding(rows: np.ndarray, length: int) -> np.ndarray:
    """Sums of ``length`` rows in succession, by doubling."""
    out, at, power, size = None, 0, rows, 1
    n = len(rows) - length + 1
    while length:
        if length & 1:
            part = power[at : at + n]
            out = part.copy() if out is None else out + part
            at += size
        length >>= 1
        if length:
            power, size = power[:-size] + power[size:], size * 2
    return out


def fingerprints(value: np.ndarray, window: int) -> np.ndarray:
    """The SimHash of each run of ``window`` word hashes: words weigh 2, pairs of neighbours 1."""
    n = len(value) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    kind = np.int8 if 3 * window < 127 else np.int32
    with np.errstate(over="ignore"):
        pair = words.mix(value[:-1] * _U(0xD6E8FEB86659FD93) + value[1:])
    single = _signs(value, 2, kind)
    if window == 1:
        return np.packbits(single > 0, axis=1).view(">u8").ravel().astype(_U)
    score = _sliding(single[:-1] + _signs(pair, 1, kind), window - 1) + single[window - 1 :]
    return np.packbits(score > 0, axis=1).view(">u8").ravel().astype(_U)


class _Index:
    """Block tables of the fingerprints of item windows."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.width = 64 // (radius + 1)
        self.tables = []
        for k in range(radius + 1):
            block = self._block(prints, k)
            order = np.argsort(block, kind="stable")
            first = np.searchsorted(block[order], np.arange((1 << self.width) + 1, dtype=_U)) if self.width <= 20 else block[order]
            self.tables.append((first, order))

    def _block(self, prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> _U(k * self.width)) & _U((1 << self.width) - 1)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of all pairs within the radius."""
        found = []
        for k, (block, order) in enumerate(self.tables):
            own = self._block(prints, k)
            if self.width <= 20:
                lo, hi = block[own.view(np.int64)], block[own.view(np.int64) + 1]
            else:
                lo, hi = np.searchsorted(block, own, "left"), np.searchsorted(block, own, "right")
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            lo, n = lo[some], (hi - lo)[some]
            at = np.repeat(some, n)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            window = order[np.repeat(lo, n) + inside]
            near = np.bitwise_count(prints[at] ^ self.prints[window]) <= self.radius
            found.append(np.stack([at[near], window[near]]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]


def _pairs(x: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words along the last axis."""
    with np.errstate(over="ignore"):
        return words.mix(x[..., :-1] * _U(0xD6E8FEB86659FD93) + x[..., 1:])


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection of the multisets in the rows of x and y."""

    def numbered(v: np.ndarray) -> np.ndarray:
        earlier = np.tril(np.ones((v.shape[1], v.shape[1]), dtype=bool), -1)
        times = ((v[:, :, None] == v[:, None, :]) & earlier).sum(axis=2).astype(_U)
        with np.errstate(over="ignore"):
            return words.mix(v + times * _U(0x9E3779B97F4A7C15))

    return (numbered(x)[:, :, None] == numbered(y)[:, None, :]).any(axis=2).sum(axis=1)


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted-shingle similarity of equally long windows, row by row: words weigh 2, neighbours 1."""
    most = 2 * x.shape[1] + x.shape[1] - 1
    out = np.empty(len(x))
    for lo in range(0, len(x), 8192):
        a, b = x[lo : lo + 8192], y[lo : lo + 8192]
        both = 2 * _shared(a, b) + _shared(_pairs(a), _pairs(b))
        out[lo : lo + 8192] = both / (2 * most - both)
    return out


def _least_pairs(window: int, least: float) -> int:
    """Pairs of neighbours that windows of at least a similarity share, even if they share every word."""
    n = int(np.ceil(2 * (3 * window - 1) * least / (1 + least) - 2 * window - 1e-9))
    if n < 1:
        raise ValueError(f"windows of {window} words may share no pair of neighbours at similarity {least}")
    return n


class _PairIndex:
    """Windows of items by the pairs of neighbouring words of their items."""

    def __init__(self, item: np.ndarray, own: np.ndarray, window: int, least: float):
        self.window, self.need = window, _least_pairs(window, least)
        _, code = np.unique(item, return_inverse=True)
        self.items = int(code.max()) + 1
        self.order = np.argsort(code, kind="stable")
        self.bounds = np.searchsorted(code[self.order], np.arange(self.items + 1))
        table = pd.DataFrame({"pair": _pairs(own).ravel(), "code": np.repeat(code, window - 1)}).drop_duplicates().sort_values("pair")
        self.pair, self.code = table["pair"].to_numpy(), table["code"].to_numpy()

    @staticmethod
    def _each(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row with every number of its range."""
        n = hi - lo
        return np.repeat(rows, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)

    def candidates(self, part: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, window) of all runs and windows that can reach the least similarity, in pieces."""
        found = _pairs(part)
        at, entry = self._each(np.arange(len(found)), np.searchsorted(self.pair, found, "left"), np.searchsorted(self.pair, found, "right"))
        start = at[:, None] - np.arange(self.window - 1)
        key = (start * self.items + self.code[entry][:, None])[start >= 0]
        key, n = np.unique(key, return_counts=True)
        key = key[n >= self.need]
        key = key[np.isin(key // self.items, whole)]
        for lo in range(0, len(key), 2048):
            position, code = key[lo : lo + 2048] // self.items, key[lo : lo + 2048] % self.items
            row, place = self._each(np.arange(len(code)), self.bounds[code], self.bounds[code + 1])
            yield position[row], self.order[place]


def item_windows(items: list[tuple[int, str]], window: int) -> pd.DataFrame:
    """item_id, position and word hashes of each window of each item."""
    kept = [(i, t.lower()) for i, t in items if i is not None and isinstance(t, str)]
    value, number, _, _ = words.word_hashes([t for _, t in kept])
    rows = []
    for k, (item, _) in enumerate(kept):
        own = value[np.searchsorted(number, k) : np.searchsorted(number, k, "right")]
        for at in range(len(own) - window + 1):
            rows.append((item, at, own[at : at + window]))
    return pd.DataFrame(rows, columns=["item_id", "at", "words"])


def _search(windows: pd.DataFrame, window: int, radius: int, least: float) -> Callable:
    item, at, own = windows["item_id"].to_numpy(), windows["at"].to_numpy(), np.stack(windows["words"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if least < 1:
            index = _PairIndex(item, own, window, least)
        else:
            index = _Index(np.concatenate([fingerprints(w, window) for w in own]), radius)
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            group: list[int] = []
            size = 0
            for k, t in enumerate(texts):
                group.append(k)
                size += len(t)
                if size > 200_000 or k == len(texts) - 1:
                    yield from search(ids[group], [texts[g].lower() for g in group], index)
                    group, size = [], 0

    def search(ids: np.ndarray, texts: list[str], index: _Index | _PairIndex) -> Iterator[pd.DataFrame]:
        value, number, _, _ = words.word_hashes(texts)
        step = 8192
        hits = []
        for lo in range(0, max(1, len(value) - window + 1), step):
            part, owner = value[lo : lo + step + window - 1], number[lo : lo + step + window - 1]
            if len(part) < window:
                continue
            whole = np.flatnonzero(owner[: len(part) - window + 1] == owner[window - 1 :])
            if least < 1:
                found = index.candidates(part, whole)
            else:
                where, which = index.within(fingerprints(part, window)[whole])
                found = [(whole[where], which)]
            for where, which in found:
                if not len(where):
                    continue
                x, y = part[where[:, None] + np.arange(window)], own[which]
                exact = (x == y).all(axis=1)
                score = similarity(x, y) if least < 1 else exact.astype(float)
                good = (score >= least) if least < 1 else exact
                hits.append(pd.DataFrame({"k": owner[where[good]], "position": lo + where[good], "w": which[good], "similarity": score[good], "exact": exact[good]}))
        hits = [h for h in hits if len(h)]
        if not hits:
            return
        hit = pd.concat(hits).drop_duplicates(["position", "w"])
        hit["item_id"], hit["shift"] = item[hit["w"]], hit["position"] - at[hit["w"]]
        hit = hit.sort_values(["k", "item_id", "shift", "position"])
        # Exact windows that follow each other on one diagonal are one run.
        new = (hit[["k", "item_id", "shift"]].diff().ne(0).any(axis=1)) | (hit["position"].diff() != 1) | (hit["exact"] != hit["exact"].shift())
        run_length = hit.groupby(["k", "item_id", new.cumsum()]).agg(n=("exact", "sum"), s=("similarity", "max")).reset_index()
        run_length["run"] = np.where(run_length["n"] > 0, run_length["n"] + window - 1, 0)
        best = run_length.groupby(["k", "item_id"]).agg(longest_run=("run", "max"), similarity=("s", "max")).reset_index()
        yield pd.DataFrame(
            {"doc_id": ids[best["k"]], "item_id": best["item_id"], "longest_run": best["longest_run"].astype("int32"), "similarity": best["similarity"]}
        )

    return run


def leaks(
    documents: DataFrame,
    items: DataFrame,
    window: int = 12,
    radius: int = 3,
    least_similarity: float = 1.0,
    held_windows: int = 200_000,
) -> DataFrame:
    """(doc_id, item_id, longest_run, similarity) of each document and item that share a window.

    ``documents`` has doc_id and text, ``items`` item_id and text; other columns are ignored.  With
    ``least_similarity`` 1 a pair needs ``window`` equal consecutive words, below that windows with
    changed, inserted or dropped words count too (then longest_run may be 0); ``radius`` is of no account there.
    """
    spark = documents.sparkSession
    source = spread(documents.select("doc_id", "text").where("text IS NOT NULL"))
    schema = "doc_id long, item_id long, longest_run int, similarity double"
    held = item_windows([tuple(r) for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator()], window)
    if not len(held):
        return spark.createDataFrame([], schema)
    found = None
    for lo in range(0, len(held), held_windows):
        part = source.mapInPandas(_search(held.iloc[lo : lo + held_windows].reset_index(drop=True), window, radius, least_similarity), schema)
        found = part if found is None else found.unionByName(part)
    if len(held) <= held_windows:
        return found
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"))
