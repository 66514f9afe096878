"""Items into containers of fixed capacity: minimum bin slack by bitset subset sums.

1. Items of a group (a database) are spread over windows of about ``window`` items by a hash of their id; the number of
   windows comes from the counts of the groups, which are few.  A window is the work of one task, so a group of any size,
   one item's host included, is packed by many tasks, and each window leaves at most a few containers ill filled.
2. Items longer than the capacity are cut: full pieces fill containers alone, the rest of the item is a piece like an
   item.  Nothing else is ever cut.
3. In a window, containers are filled one after another.  The longest item that remains is taken; subset sums of the
   others, as the bits of one integer, tell the fullest reachable level of the remaining room; the lengths of that
   level are found by backtracking over counts of equal lengths.

Null lengths are left out, empty items take no room but are assigned.  Repeated ids are separate items.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def fullest(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each length to take so that their sum is the largest not above ``room``; exact.

    ``lengths`` are distinct and positive.  Equal lengths enter as powers of two of their count.
    """
    taken = [0] * len(lengths)
    if room <= 0:
        return taken
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    top = 1 << room
    for k, (length, count) in enumerate(zip(lengths, counts)):
        if length > room:
            continue
        count, power = min(count, room // length), 1
        while count > 0:
            use = min(power, count)
            steps.append((reached, k, use, use * length))
            reached |= (reached << (use * length)) & mask
            count, power = count - use, power * 2
        if reached & top:
            break
    level = reached.bit_length() - 1
    for before, k, use, size in reversed(steps):
        if before >> level & 1:
            continue
        taken[k] += use
        level -= size
    return taken


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; every length must be within the capacity."""
    bins = np.full(len(lengths), -1, dtype=np.int64)
    at: dict[int, list[int]] = {}
    for i, x in enumerate(lengths.tolist()):
        at.setdefault(x, []).append(i)
    empty = at.pop(0, [])
    order = sorted(at, reverse=True)
    number = 0
    while order:
        first = order[0]
        members = [at[first].pop()]
        if not at[first]:
            order.pop(0)
            del at[first]
        taken = fullest(order, [len(at[x]) for x in order], capacity - first)
        for x, n in zip(list(order), taken):
            if n:
                members += at[x][-n:]
                del at[x][-n:]
                if not at[x]:
                    order.remove(x)
                    del at[x]
        bins[members] = number
        number += 1
    bins[empty] = 0
    return bins


def _packed(group: str) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        capacity = int(frame["capacity"].iloc[0])
        frame = frame.sort_values(["size", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size = frame["size"].to_numpy()
        pieces = np.maximum(1, -(-size // capacity))
        row = np.repeat(np.arange(len(frame)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(size[row] - piece * capacity, capacity)
        bins = pack(length, capacity)
        return pd.DataFrame(
            {
                group: frame[group].to_numpy()[row],
                "window": frame["window"].to_numpy()[row],
                "block": bins,
                "id": frame["id"].to_numpy()[row],
                "piece": piece,
                "piece_start": piece * capacity,
                "piece_size": length,
                "capacity": capacity,
            }
        )

    return run


def fill(items: DataFrame, group: str, window: int = 2000) -> DataFrame:
    """(group, window, block, id, piece, piece_start, piece_size, capacity) of each piece.

    ``items`` has the columns id BIGINT, size BIGINT (the length), capacity BIGINT (of the group's containers, the same
    in a group) and ``group`` STRING.  A container is named by group, window and block.  Groups must be few: their
    counts, not their items, decide the number of windows.
    """
    usable = items.where(f"id IS NOT NULL AND size IS NOT NULL AND capacity > 0 AND {group} IS NOT NULL").select(group, "id", "size", "capacity")
    counts = usable.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    windows = counts.select(group, F.greatest(F.lit(1), F.round(F.col("n") / window)).cast("int").alias("windows"))
    placed = usable.join(F.broadcast(windows), group).withColumn("window", F.pmod(F.xxhash64("id"), F.col("windows")).cast("int"))
    schema = f"{group} string, window int, block long, id long, piece long, piece_start long, piece_size long, capacity long"
    return placed.drop("windows").groupBy(group, "window").applyInPandas(_packed(group), schema)


def valid_routes(routes: DataFrame, shards: DataFrame) -> DataFrame:
    """(novel_id, database_id, block_bytes): the newest route of each novel to a known database.

    Rows without a time are older than all others; ties go to the larger route_id.  A novel whose newest route names an
    unknown or no database has no valid route.
    """
    newest = routes.groupBy("novel_id").agg(F.max_by("database_id", F.struct(F.col("assigned_at").isNotNull(), "assigned_at", "route_id")).alias("database_id"))
    return newest.where("novel_id IS NOT NULL").join(F.broadcast(shards.select("database_id", F.col("block_bytes").cast("long"))), "database_id")


def block_bodies(chapters: DataFrame, routes: DataFrame, shards: DataFrame, window: int = 2000, salts: int = 16) -> DataFrame:
    """The blocks of the databases with the stored bodies of the novels routed to them.

    Columns: database_id, block_id, row_id, piece, piece_start, piece_bytes, block_bytes.
    """
    bodies = chapters.select("novel_id", F.col("row_id").cast("long").alias("id"), F.octet_length("paragraphs_json").cast("long").alias("size"))
    # A novel may hold a third of all rows: its rows are spread over salts, and its one route is repeated for each.
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    spread = valid_routes(routes, shards).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    routed = bodies.where("size IS NOT NULL").withColumn("salt", salt).join(spread, ["novel_id", "salt"]).withColumnRenamed("block_bytes", "capacity")
    return fill(routed, "database_id", window).select(
        "database_id",
        F.concat_ws("-", "database_id", "window", "block").alias("block_id"),
        F.col("id").alias("row_id"),
        F.col("piece").cast("int").alias("piece"),
        "piece_start",
        F.col("piece_size").alias("piece_bytes"),
        F.col("capacity").alias("block_bytes"),
    )
