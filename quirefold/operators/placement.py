"""Placing novels on databases.  Greedy rules are sequential; they run over one row per novel, in one task, by design."""

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = "novel_id string, bytes long, shard string, reason string"


def projected_bytes(body_bytes: Column, chapters: Column, factor: float = 1.7, per_chapter: int = 256, per_novel: int = 1 << 20) -> Column:
    """The room a novel will take; rounded up per novel, before sums."""
    return F.ceil(body_bytes * factor + chapters * per_chapter + per_novel).cast("long")


def _once(df: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(fold, schema)


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["bytes", "novel_id"], ascending=[False, True], kind="stable")


def least_loaded(volumes: DataFrame, loads: dict[str, int], most: int | None = None) -> DataFrame:
    """(novel_id, bytes, shard, reason): pinned novels stay, others go, largest first, to the lightest shard.

    ``volumes`` has novel_id, bytes and pinned (a shard or null), ``loads`` the bytes each shard holds already.
    A pinned novel's bytes are part of its shard's load already and are not added again.  With ``most`` a novel that would
    overfill even the lightest shard is not placed.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        heap = [(load, shard) for shard, load in sorted(loads.items())]
        heapq.heapify(heap)
        out = []
        for novel, size, pinned in _sorted(frame)[["novel_id", "bytes", "pinned"]].itertuples(index=False):
            if isinstance(pinned, str):
                out.append((novel, size, pinned, "already_stored"))
                continue
            load, shard = heap[0]
            if most is not None and load + size > most:
                out.append((novel, size, None, "no_capacity"))
                continue
            heapq.heapreplace(heap, (load + size, shard))
            out.append((novel, size, shard, "placed"))
        return pd.DataFrame(out, columns=["novel_id", "bytes", "shard", "reason"])

    return _once(volumes.select("novel_id", "bytes", "pinned"), fold, _OUT)


def best_fit(volumes: DataFrame, capacity: int) -> DataFrame:
    """(novel_id, bytes, shard, reason): largest first into the fullest bin it still fits, else into a new one; shards are bin-N."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        import bisect

        free: list[tuple[int, int]] = []  # (room, -bin) in order: the first with enough room is the fullest
        bins, out = 0, []
        for novel, size in _sorted(frame)[["novel_id", "bytes"]].itertuples(index=False):
            if size > capacity:
                out.append((novel, size, None, "oversized"))
                continue
            at = bisect.bisect_left(free, (size, -(1 << 60)))
            if at < len(free):
                room, own = free.pop(at)
            else:
                bins += 1
                room, own = capacity, -bins
            bisect.insort(free, (room - size, own))
            out.append((novel, size, f"bin-{-own}", "placed"))
        return pd.DataFrame(out, columns=["novel_id", "bytes", "shard", "reason"])

    return _once(volumes.select("novel_id", "bytes"), fold, _OUT)


def absent_shards(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Names of required shards that do not exist yet."""
    return required.select("shard_name").join(existing.select("shard_name"), "shard_name", "left_anti")
