"""Containers of fixed capacity filled with items of varying length, by sum-of-squares packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.scratch import Scratch

#: Tokens and items that one task packs, about; both bound a task's memory and time whatever the number of items.
SHARD_TOKENS = 16_000_000
SHARD_ITEMS = 400_000
#: Containers a shard can number.
NUMBERS = 1 << 32


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (sizes from 1 to capacity, in order), by the fill level that leaves the least sum of squares.

    ``open_at[h]`` counts the open containers filled to h.  An item of size s moves one from h to h + s, or opens one at s;
    the move with the least sum of squared counts is taken, of equal ones that into the fullest container.  At the end,
    open containers that fit together are joined, the fullest with the emptiest.
    """
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # 0 and the capacity stay 0: neither empty nor full ones are counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    found = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes):
        s = int(s)
        top = capacity - s
        best, level = (2 * open_at[s] + 1, 0) if s < capacity else (0, 0)
        if top > 0:
            here = open_at[1 : top + 1]
            change = 2 * (open_at[1 + s : capacity + 1] - here) + 2
            change[-1] -= 1  # full: it leaves the count without joining another
            change[here == 0] = np.iinfo(np.int64).max
            at = top - 1 - int(change[::-1].argmin())
            if change[at] <= best:
                level = at + 1
        if level:
            container = stacks[level].pop()
            open_at[level] -= 1
        else:
            container, made = made, made + 1
        found[i] = container
        if level + s < capacity:
            stacks[level + s].append(container)
            open_at[level + s] += 1
    return _joined(found, stacks, made)


def _joined(found: np.ndarray, stacks: list[list[int]], made: int) -> np.ndarray:
    """Containers left open that fit together become one."""
    capacity = len(stacks) - 1
    left = [(level, container) for level, stack in enumerate(stacks) for container in stack]
    into = np.arange(made)
    low, high = 0, len(left) - 1
    while low < high:
        fill, container = left[high]
        while low < high and fill + left[low][0] <= capacity:
            fill += left[low][0]
            into[left[low][1]] = container
            low += 1
        high -= 1
    return into[found]


def pack(sizes: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece, size, container) with every item in containers of ``capacity``; one row a piece, the first is 0.

    An item larger than the capacity is cut into full pieces, each a container of its own, and a rest that is packed like
    an item; no other is split.  Items of size 0 or without a size take no room: they get one row without container.
    Items without id are left out; an item given twice is packed twice.  An empty table gives an empty result.

    Items are spread over shards by a hash of their id, so that each shard has a like mixture of sizes, and each shard is
    packed online in the order of the hash (``sum_of_squares``).  The number of shards follows from the sizes alone; a
    shard's open containers are what is lost to the cut, a few in thousands.
    """
    if capacity < 1:
        raise ValueError("a capacity of at least 1")
    scratch = Scratch(sizes.sparkSession)
    key = sizes.schema[item].dataType.simpleString()
    rows = scratch.save(sizes.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row")).where("item is not null"))
    whole = rows.agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("items")).first()
    shards = max(1, -(-(whole["tokens"] or 0) // SHARD_TOKENS), -(-whole["items"] // SHARD_ITEMS))
    hashed = rows.where("size > 0").withColumn("hash", F.xxhash64("item", F.lit(29))).withColumn("shard", F.pmod("hash", F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "item", "row"], kind="stable")
        size, shard = pdf["size"].to_numpy(), int(pdf["shard"].iloc[0])
        full, rest = size // capacity, size % capacity
        whole_pieces = int(full.sum())
        order = np.repeat(np.arange(len(pdf)), full)
        before = np.repeat(np.cumsum(full) - full, full)
        packed = np.nonzero(rest)[0]
        bins = sum_of_squares(rest[packed], capacity) if len(packed) else np.empty(0, dtype=np.int64)
        which = np.concatenate([order, packed])
        return pd.DataFrame(
            {
                "item": pdf["item"].to_numpy()[which],
                "piece": np.concatenate([np.arange(whole_pieces) - before, full[packed]]),
                "size": np.concatenate([np.full(whole_pieces, capacity), rest[packed]]),
                "container": shard * NUMBERS + np.concatenate([np.arange(whole_pieces), whole_pieces + bins]),
            }
        )

    filled = hashed.groupBy("shard").applyInPandas(fill, f"item {key}, piece long, size long, container long")
    empty = rows.where("size <= 0").select("item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"))
    return filled.unionByName(empty).withColumnsRenamed({"item": item, "size": size})


def split_items(packed: DataFrame, item: str) -> DataFrame:
    """(item): those that had to be cut, as they exceed the capacity alone."""
    return packed.where("piece = 1").select(item)
