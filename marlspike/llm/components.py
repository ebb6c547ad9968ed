"""Groups of records linked directly or indirectly, by low-diameter decomposition."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.scratch import Scratch
from marlspike.skew import HOT_SHARE, hot_keys, skew_join

#: Rate of the exponential shifts: an edge stays between clusters with a probability of about 1 - exp(-RATE), under a fifth.
RATE = 0.2
#: Latest start of a cluster; none reaches further than this from its centre, so a level has so many rounds at most.
SPAN = 12
#: Edges (16 bytes each) that are worked through in one task.
FEW_EDGES = 20_000


def _start(vertex: str, level: int, seed: int) -> Column:
    """When a vertex starts a cluster of its own, unless another arrives first: SPAN less an exponential shift.

    Shifts beyond SPAN start at about 0, in an order of their own.  The shift comes from a hash, so that a task run again
    after the loss of an executor draws the same.
    """
    unit = (F.xxhash64(F.col(vertex), F.lit(seed), F.lit(level)).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    return F.greatest(unit * 1e-3, F.lit(float(SPAN)) + F.log(unit) / RATE)


def _clusters(scratch: Scratch, both: DataFrame, hot: list, level: int, seed: int) -> DataFrame:
    """(v, c): the cluster of each vertex. A vertex joins the cluster that arrives first, one hop taking one unit of time.

    ``both`` has each edge from either end, in buckets by ``src``; so has the state by its vertex.  A round sends messages
    from the vertices that moved in the last one: these meet their edges bucket by bucket, and only messages are shuffled.
    """
    starts = both.groupBy(F.col("src").alias("v")).agg(F.lit(True).alias("moved")).select("v", _start("v", level, seed).alias("t"), F.col("v").alias("c"), "moved")
    state, _ = scratch.save_bucketed(starts, "v")
    for _ in range(SPAN):
        front = state.where("moved").select(F.col("v").alias("src"), "t", "c")
        sent = skew_join(both, front, "src", hot).groupBy(F.col("dst").alias("v")).agg((F.min("t") + 1).alias("then"), F.min_by("c", "t").alias("to"))
        joined = state.drop("moved").join(sent, "v", "left")
        earlier = F.coalesce(F.col("then") < F.col("t"), F.lit(False))
        chosen = joined.select("v", F.when(earlier, F.col("then")).otherwise(F.col("t")).alias("t"), F.when(earlier, F.col("to")).otherwise(F.col("c")).alias("c"), earlier.alias("moved"))
        grown, seen = scratch.save_bucketed(chosen, "v", F.count_if("moved").alias("moved"))
        scratch.drop(state)
        state = grown
        if not seen["moved"]:
            break
    return state.select("v", "c")


def decomposed(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same levels over edges that fit into one task: (vertex, last cluster) of every vertex."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends, 2)
    label, draw = np.arange(len(names)), np.random.default_rng(seed)
    while len(x):
        t = np.maximum(draw.random(len(names)) * 1e-3, SPAN - draw.exponential(1 / RATE, len(names)))
        c, moved = np.arange(len(names)), np.ones(len(names), dtype=bool)
        src, dst = np.concatenate([x, y]), np.concatenate([y, x])
        for _ in range(SPAN):
            going = moved[src]
            at, to = src[going], dst[going]
            then = np.full(len(names), np.inf)
            np.minimum.at(then, to, t[at] + 1)
            first = t[at] + 1 == then[to]
            cluster = np.full(len(names), len(names))
            np.minimum.at(cluster, to[first], c[at[first]])
            moved = then < t
            if not moved.any():
                break
            t, c = np.where(moved, then, t), np.where(moved, cluster, c)
        label = c[label]
        pairs = np.unique(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])])[:, c[x] != c[y]], axis=1)
        x, y = pairs
    return names, names[label]


def components(links: DataFrame, a: str, b: str, seed: int = 11, names: tuple[str, str] = ("group_id", "record_id")) -> DataFrame:
    """One row per record with a link to another: ``group_id``, the smallest id of all records linked to it, ``record_id``.

    Level by level, clusters grow from exponentially shifted start times over the edges, are contracted to
    super-vertices, and the edges between clusters, about a fifth of them, go to the next level, until none is left.
    Then the assignments are composed from the last level back to the first, each level smaller than the one before, and
    the smallest id of each whole group takes the place of its cluster.  A level takes at most SPAN rounds, so a graph of
    E edges takes some SPAN * log5(E) rounds at worst, whatever its diameter; groups of small diameter take fewer.

    A vertex or group with a large part of all rows is joined by a broadcast of its one row (``skew_join``); messages to it
    are reduced on the map side.  A level's edges are written once, in buckets by vertex, and each round's state too, so a
    lost executor costs a task and only messages are shuffled.  A level of at most FEW_EDGES edges, by counting, and all
    after it are worked through in one task, as rounds of jobs would cost more than the edges.

    Links with a null id and of a record with itself link nothing; a link given again, in either direction, counts once.
    Ids are any integers, negative ones too.  An empty table gives an empty result.  Further columns play no part.
    """
    scratch = Scratch(links.sparkSession)
    given = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where(F.col("x") != F.col("y"))
    count = F.count(F.lit(1)).alias("n")
    edges, seen = scratch.save_observed(given.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), count)
    levels: list[DataFrame] = []
    while seen["n"] > FEW_EDGES:
        ways = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        both, _ = scratch.save_bucketed(ways.repartition("src"), "src")
        hot = hot_keys(both, "src", HOT_SHARE / 2, 2 * seen["n"])
        clusters = _clusters(scratch, both, hot, len(levels), seed)
        levels.append(clusters)
        left = skew_join(both.where("src < dst"), clusters.select(F.col("v").alias("src"), F.col("c").alias("ca")), "src", hot)
        moved = skew_join(left, clusters.select(F.col("v").alias("dst"), F.col("c").alias("cb")), "dst", hot).where("ca != cb")
        contracted, seen = scratch.save_observed(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), count)
        scratch.drop(edges, both)
        edges = contracted
    if seen["n"]:

        def rest(pdf: pd.DataFrame) -> pd.DataFrame:
            names, found = decomposed(pdf["a"].to_numpy(), pdf["b"].to_numpy(), seed)
            return pd.DataFrame({"v": names, "c": found})

        levels.append(scratch.save(edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(rest, "v long, c long")))
    if not levels:
        return edges.select(F.col("a").alias(names[0]), F.col("b").alias(names[1]))

    def compose(above: DataFrame, below: DataFrame) -> DataFrame:
        """``below`` with the clusters that ``above`` gave to its own clusters."""
        final = skew_join(below, above.select(F.col("v").alias("c"), F.col("c").alias("top")), "c", hot_keys(below, "c"), "left")
        return scratch.save(final.select("v", F.coalesce("top", "c").alias("c")))

    whole = reduce(compose, reversed(levels))
    least = scratch.save(whole.groupBy("c").agg(F.min("v").alias("least")))
    named = skew_join(whole, least, "c", hot_keys(whole, "c"))
    return named.select(F.col("least").alias(names[0]), F.col("v").alias(names[1]))
