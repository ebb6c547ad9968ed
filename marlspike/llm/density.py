"""Clusters of similar records by density peaks, over blocks of mutually similar records."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.components import components
from marlspike.scratch import Scratch
from marlspike.skew import hot_keys, skew_join

#: Bits of a block's number for the level of one field; levels are under 64.
LEVEL_BITS = 6
#: Records whose outermost are looked for in one go, pairwise.
FRONT_ROWS = 2048
#: Doublings beyond which a block of at least the mean density is a peak of its own.
PEAK_DISTANCE = 1.0
#: Blocks whose labels are broadcast to the records at most (about 20 bytes each).
BROADCAST_BLOCKS = 200_000


def level(value: Column) -> Column:
    """floor(log2(value + 1)) of an integer from 0 on, exact and without overflow."""
    bits = F.bin(value)
    return F.when(value == 0, 0).when(F.instr(bits, "0") == 0, F.length(bits)).otherwise(F.length(bits) - 1)


def _at_most_twice(high: Column, low: Column) -> Column:
    """Whether high + 1 <= 2 * (low + 1), in integers and without overflow."""
    return F.shiftright(high, 1) <= low


def _outermost(points: np.ndarray) -> np.ndarray:
    """Which rows no other row equals or exceeds in every column; one of equal rows stays.

    A row that exceeds another has the greater sum, so in that order each block of rows meets those kept before and itself.
    """
    order = np.lexsort(points.T[::-1])[::-1]
    order = order[np.argsort(-points[order].astype(float).sum(axis=1), kind="stable")]
    kept = order[:0]
    for at in range(0, len(order), 256):
        block = order[at : at + 256]
        values = points[block]
        over = (points[kept][None, :, :] >= values[:, None, :]).all(axis=2).any(axis=1)
        among = np.tril((values[None, :, :] >= values[:, None, :]).all(axis=2), -1).any(axis=1)
        kept = np.concatenate([kept, block[~(over | among)]])
    return kept


class DensityPeaks:
    """Blocks, links, density, peaks and labels of ``records`` by the integer ``fields``.

    Two records are similar if in every field the greater value plus one is at most twice the lesser plus one.  Records
    with the same floor(log2(value + 1)) in every field are a block: all of them are similar to each other, so that a block
    stands for its records, and there are at most 64 ** len(fields) of them, however many records.  Similar records lie in
    the same block or in blocks that differ by at most one in each field.

    * the blocked neighbour join finds, for each block, the adjacent ones with a similar pair of records.  Least and
      greatest values decide this where one field differs.  Where more do, they can only rule it out; the records that
      decide are then the outermost in the direction of the other block, and only these are compared.  ``diagonal`` does
      so for blocks without a denser one that differs in one field, which is all that pointers need; ``groups`` does so
      for blocks whose peaks aren't joined otherwise and needs no ``diagonal``;
    * density of a block (rho): its records, and half of those of each linked block that differs in one field;
    * distance of a block (delta): that to the nearest linked denser block, measured between the means of their records as
      the greatest difference of a field in doublings; without bound for blocks that are linked to no denser one;
    * peaks are chosen by both: blocks linked to no denser one, and blocks of at least the mean density that lie more than
      PEAK_DISTANCE from the nearest denser one.  Every other block points to that one, and following the pointers labels it;
    * ``groups`` joins the peaks' clusters that touch, which gives all records linked directly or indirectly.

    Records with a missing or negative value in a field, or without id, are left out.  A record given again counts once.
    Equal density is ordered by block number.  An empty table gives empty results; further columns play no part.
    """

    def __init__(self, records: DataFrame, record: str, fields: list[str], diagonal: bool = False):
        if not 1 <= len(fields) <= 6:
            raise ValueError("from one to six fields")  # a block has 3 ** fields - 1 neighbours
        self.scratch, self.fields, self.record = Scratch(records.sparkSession), fields, record
        self.axes = [f"x{i}" for i in range(len(fields))]
        taken = records.select(F.col(record).cast("long").alias("id"), *(F.col(f).cast("long").alias(x) for f, x in zip(fields, self.axes, strict=True)))
        whole = F.col("id").isNotNull()
        for x in self.axes:
            whole &= F.coalesce(F.col(x) >= 0, F.lit(False))
        number = F.lit(0).cast("long")
        for x in self.axes:
            number = F.shiftleft(number, LEVEL_BITS).bitwiseOR(level(F.col(x)).cast("long"))
        self.records = self.scratch.save(taken.where(whole).dropDuplicates().withColumn("block", number))
        bounds = [f(x).alias(f"{n}{x}") for x in self.axes for n, f in (("lo_", F.min), ("hi_", F.max), ("at_", lambda x: F.avg(F.log2(F.col(x) + F.lit(1.0)))))]
        self.blocks = self.scratch.save(self.records.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), *bounds))
        self._link()
        self._label(diagonal)

    def _adjacent(self) -> DataFrame:
        """Pairs of occupied adjacent blocks, each once, with the steps of the second from the first."""
        k = len(self.axes)
        steps = [s for s in itertools.product((-1, 0, 1), repeat=k) if s > (0,) * k]
        shift = [sum(d << (LEVEL_BITS * (k - 1 - i)) for i, d in enumerate(s)) for s in steps]
        moves = F.explode(F.array(*(F.struct(F.lit(d).cast("long").alias("d"), F.array(*map(F.lit, s)).alias("s")) for d, s in zip(shift, steps, strict=True))))
        levels = [F.shiftright(F.col("block"), LEVEL_BITS * (k - 1 - i)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)) for i in range(k)]
        inside = F.lit(True)
        for i, at in enumerate(levels):  # a level of 0 or 63 has no neighbour below or above
            inside &= (at + F.col("m.s")[i]).between(0, (1 << LEVEL_BITS) - 1)
        left = self.blocks.select(F.struct("*").alias("p"), "block").withColumn("m", moves).where(inside)
        left = left.select("p", F.col("m.s").alias("s"), (F.col("block") + F.col("m.d")).alias("other"))
        right = self.blocks.select(F.struct("*").alias("q"), F.col("block").alias("other"))
        return left.join(right, "other").drop("other")

    def _link(self) -> None:
        possible, differing = F.lit(True), F.lit(0)
        for i, x in enumerate(self.axes):
            s = F.col("s")[i]
            possible &= (s == 0) | ((s == 1) & _at_most_twice(F.col(f"q.lo_{x}"), F.col(f"p.hi_{x}"))) | ((s == -1) & _at_most_twice(F.col(f"p.lo_{x}"), F.col(f"q.hi_{x}")))
            differing += F.abs(s)
        apart = F.greatest(F.lit(0.0), *(F.abs(F.col(f"p.at_{x}") - F.col(f"q.at_{x}")) for x in self.axes))
        pairs = self._adjacent().withColumns({"possible": possible, "steps": differing, "apart": apart})
        pairs = pairs.select(F.col("p.block").alias("a"), F.col("q.block").alias("b"), F.col("p.n").alias("n_a"), F.col("q.n").alias("n_b"), "s", "steps", "apart", "possible")
        self.pairs = self.scratch.save(pairs)
        linked = self.pairs.where("possible and steps = 1")
        reached = linked.select(F.col("a").alias("block"), (F.col("n_b") / 2).alias("w")).unionAll(linked.select("b", F.col("n_a") / 2))
        near = reached.groupBy("block").agg(F.sum("w").alias("w"))
        density = self.blocks.select("block", "n", "least").join(near, "block", "left").select("block", "n", "least", (F.col("n") + F.coalesce("w", F.lit(0.0))).alias("density"))
        self.density, seen = self.scratch.save_observed(density, F.avg("density").alias("mean"))
        self.mean_density = seen["mean"] or 0.0

    def _diagonal(self, sure: DataFrame) -> DataFrame:
        """Similar pairs of blocks that differ in more fields, where the less dense one has no denser block among ``sure``."""
        rank = self.density.select("block", F.struct("density", "block").alias("rank"))

        def ranked(pairs: DataFrame) -> DataFrame:
            both = pairs.join(rank.toDF("a", "rank_a"), "a").join(rank.toDF("b", "rank_b"), "b")
            return both.withColumn("low", F.when(F.col("rank_a") < F.col("rank_b"), F.col("a")).otherwise(F.col("b")))

        alone = ranked(self.pairs.where("possible and steps > 1")).join(ranked(sure).select("low").distinct(), "low", "left_anti")
        open_pairs = self.scratch.save(alone.select("a", "b", "s", "steps", "apart", F.col("a").alias("lo"), F.col("b").alias("hi"), "n_a", "n_b", F.monotonically_increasing_id().alias("pair")))
        return self._decided(open_pairs).select("pair").join(open_pairs, "pair").select("a", "b", "apart")

    def _label(self, diagonal: bool) -> None:
        sure = self.pairs.where("possible and steps = 1").select("a", "b", "apart")
        if diagonal:
            sure = self.scratch.save(sure.unionByName(self._diagonal(sure)))
        both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
        rank = self.density.select(F.col("block").alias("a"), F.struct("density", "block").alias("rank"))
        other = self.density.select(F.col("block").alias("b"), F.struct("density", "block").alias("other"))
        denser = both.join(rank, "a").join(other, "b").where("other > rank")
        nearest = denser.groupBy("a").agg(F.min(F.struct("apart", (-F.col("other.density")).alias("density"), "b")).alias("to"))
        chosen = self.density.select(F.col("block").alias("a"), "density").join(nearest, "a", "left").select("a", "density", F.col("to.apart").alias("delta"), "to.b")
        is_peak = F.col("delta").isNull() | ((F.col("delta") > PEAK_DISTANCE) & (F.col("density") >= self.mean_density))
        self.decision = self.scratch.save(chosen.withColumn("is_peak", is_peak))
        pointers = self.decision.select("a", F.when(F.col("is_peak"), F.col("a")).otherwise(F.col("b")).alias("peak"))
        pointers = self.scratch.save(pointers)
        while True:  # the way to a peak halves each time
            further = pointers.select(F.col("a").alias("peak"), F.col("peak").alias("next"))
            ahead = self.scratch.save(pointers.join(further, "peak").select("a", F.col("next").alias("peak"), (F.col("next") != F.col("peak")).alias("moved")))
            self.scratch.drop(pointers)
            pointers = ahead.select("a", "peak")
            if ahead.where("moved").isEmpty():
                break
        self.peaks = pointers

    def _touching(self) -> DataFrame:
        """Pairs of different peaks (a, b) whose clusters have a similar pair of records."""
        peak_a = self.peaks.select("a", F.col("peak").alias("pa"))
        peak_b = self.peaks.select(F.col("a").alias("b"), F.col("peak").alias("pb"))
        between = self.scratch.save(self.pairs.where("possible").join(peak_a, "a").join(peak_b, "b").where("pa != pb").withColumns({"lo": F.least("pa", "pb"), "hi": F.greatest("pa", "pb")}))
        sure = between.where("steps = 1").select("lo", "hi").distinct()
        open_pairs = self.scratch.save(between.where("steps > 1").join(sure, ["lo", "hi"], "left_anti").select("a", "b", "s", "lo", "hi", "n_a", "n_b", F.monotonically_increasing_id().alias("pair")))
        return sure.unionByName(self._decided(open_pairs).select("lo", "hi").distinct())

    def _decided(self, open_pairs: DataFrame) -> DataFrame:
        """Those of the pairs of blocks that do have a similar pair of records, by the outermost records of either."""

        def facing(side: str, block: str, sign: int) -> DataFrame:
            """Records of one side, values turned so that greater means nearer to the other block; 0 where it doesn't count."""
            wanted = open_pairs.select("pair", "s", F.col(block).alias("block"), F.greatest("n_a", "n_b").alias("most"))
            turned = [(F.col("s")[i] * sign * F.col(x)).alias(x) for i, x in enumerate(self.axes)]
            # the pairs are joined to blocks, so a crowded block is spread by the records' side of the join
            return self.records.join(F.broadcast(wanted) if self.few_pairs else wanted, "block").select("pair", "most", F.lit(side).alias("side"), *turned).dropDuplicates()

        def share(rows: Column, salt: int) -> Column:
            return F.pmod(F.xxhash64(*self.axes, F.lit(salt)), F.ceil(rows / FRONT_ROWS)).alias("share")

        self.few_pairs = open_pairs.count() <= BROADCAST_BLOCKS
        few_rows = False
        rows = facing("a", "a", 1).unionByName(facing("b", "b", -1))
        schema = "pair long, side string, " + ", ".join(f"{x} long" for x in self.axes)

        axes = list(self.axes)

        def front(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.iloc[_outermost(pdf[axes].to_numpy())][["pair", "side", *axes]]

        count = F.count(F.lit(1)).alias("n")
        fronts, seen = self.scratch.save_observed(rows.groupBy("pair", "side", share(F.col("most"), 0)).applyInPandas(front, schema), count)
        for salt in itertools.count(1):  # the shares' outermost records together, until a pair's side fits into one share
            sizes = fronts.groupBy("pair", "side").agg(count)
            few_rows = (sizes.agg(F.max("n")).first()[0] or 0) <= FRONT_ROWS and salt > 1
            if few_rows:
                break
            mixed = fronts.join(sizes, ["pair", "side"]).groupBy("pair", "side", share(F.col("n"), salt))
            fewer, left = self.scratch.save_observed(mixed.applyInPandas(front, schema), count)
            stuck = left["n"] > 0.9 * seen["n"]
            fronts, seen = fewer, left
            if stuck:
                break
        sizes = fronts.groupBy("pair", "side").agg(count)
        shared = fronts.withColumn("share", F.lit(0)) if few_rows else fronts.join(sizes, ["pair", "side"]).withColumn("share", share(F.col("n"), 0)).drop("n")
        return self._meeting(shared, open_pairs)

    def _meeting(self, fronts: DataFrame, open_pairs: DataFrame) -> DataFrame:
        """(pair, lo, hi) of pairs of which a record of one front is similar to one of the other.

        A record of the first side is written by what it allows and one of the second by what it needs, both growing with
        the nearness of the other, so that two are similar where the first is at least the second in every field.  Shares of
        at most some FRONT_ROWS records are compared where their bounds allow it, within a task; no pairs of records are made.
        """
        axes = list(self.axes)
        steps = open_pairs.select("pair", "s")
        sides = fronts.join(F.broadcast(steps) if self.few_pairs else steps, "pair")
        first = F.col("side") == "a"
        needs = {x: F.when(F.col("s")[i] == 0, F.lit(0)).when(first, F.when(F.col("s")[i] == 1, F.col(x)).otherwise(-F.shiftright(-F.col(x), 1))).otherwise(F.when(F.col("s")[i] == 1, F.shiftright(-F.col(x), 1)).otherwise(-F.col(x))).alias(x) for i, x in enumerate(axes)}
        turned = self.scratch.save(sides.select("pair", "side", "share", *needs.values()))
        a, b = turned.where("side = 'a'"), turned.where("side = 'b'")
        high = a.groupBy("pair", "share").agg(*(F.max(x).alias(f"hi_{x}") for x in axes))
        low = b.groupBy("pair", F.col("share").alias("other")).agg(*(F.min(x).alias(f"lo_{x}") for x in axes))
        fits = F.lit(True)
        for x in axes:
            fits &= F.col(f"hi_{x}") >= F.col(f"lo_{x}")
        meetings = self.scratch.save(high.join(low, "pair").where(fits).select("pair", "share", "other"))
        keys = ["pair", "share", "other"]
        left = a.join(meetings, ["pair", "share"]).select(*keys, *axes)
        right = b.withColumnRenamed("share", "other").join(meetings, ["pair", "other"]).select(*keys, *axes)
        right = right.toDF(*(f"q_{c}" for c in right.columns))  # columns of their own, as both sides come from one table

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            p, q = x[axes].to_numpy(), y[[f"q_{c}" for c in axes]].to_numpy()
            for at in range(0, len(p), 512):
                if (p[at : at + 512, None, :] >= q[None, :, :]).all(axis=2).any():
                    return pd.DataFrame({"pair": x["pair"].iloc[:1]})
            return pd.DataFrame({"pair": x["pair"].iloc[:0]})

        found = left.groupBy(*keys).cogroup(right.groupBy(*(f"q_{c}" for c in keys))).applyInPandas(meet, "pair long").distinct()
        return found.join(open_pairs.select("pair", "lo", "hi"), "pair")

    def clusters(self) -> DataFrame:
        """(block, peak, n, least, density) of all blocks."""
        return self.peaks.select(F.col("a").alias("block"), "peak").join(self.density, "block")

    def groups(self) -> DataFrame:
        """(block, group, density) of blocks; ``group`` is the smallest id of all records linked directly or indirectly."""
        joined = components(self._touching(), "lo", "hi", names=("whole", "peak"))
        labelled = self.clusters().join(joined, "peak", "left").withColumn("whole", F.coalesce("whole", "peak"))
        ids = labelled.groupBy("whole").agg(F.min("least").alias("group"), F.sum("n").alias("size"))
        return self.scratch.save(labelled.join(ids, "whole").select("block", "peak", "group", "size", "density"))

    def members(self, labels: DataFrame) -> DataFrame:
        """The records with the labels of their block; a bounded number of blocks is broadcast, more are joined by block."""
        if labels.count() <= BROADCAST_BLOCKS:
            return self.records.join(F.broadcast(labels), "block")
        return skew_join(self.records, labels, "block", hot_keys(self.records, "block"))

    def typical(self, labels: DataFrame, label: str, most: int) -> DataFrame:
        """(label, typical): the ``most`` ids of the group nearest to the mean of its densest block, by the logarithm."""
        densest = labels.groupBy(label).agg(F.max(F.struct("density", "block")).alias("d")).select(label, F.col("d.block").alias("block"))
        logs = [F.log2(F.col(x) + F.lit(1.0)).alias(x) for x in self.axes]
        means = self.members(densest).select(label, *logs).groupBy(label).agg(*(F.avg(x).alias(f"m_{x}") for x in self.axes))
        inside = self.members(labels.select("block", label)).select("id", label, *logs)
        apart = sum((F.abs(F.col(x) - F.col(f"m_{x}")) for x in self.axes[1:]), F.abs(F.col("x0") - F.col("m_x0")))
        near = skew_join(inside, means, label, hot_keys(inside, label)).select(label, "id", apart.alias("apart"))
        # Spark keeps the first rows of each task before it shuffles, so a large block isn't sorted in one task
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy("apart", "id"))).where(F.col("rank") <= most)
        return ranked.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("typical"))


def similarity_groups(records: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(group, record): all records of groups of two or more, by density peaks whose clusters are joined where they touch."""
    peaks = DensityPeaks(records, record, fields)
    labels = peaks.groups().where("size > 1").select("block", "group")
    return peaks.members(labels).select(F.col("group").alias("group_id"), F.col("id").alias(record))


def peak_clusters(records: DataFrame, record: str, fields: list[str], most: int = 3) -> DataFrame:
    """One row per density peak: its cluster's smallest record id, size, density and ``most`` typical members."""
    peaks = DensityPeaks(records, record, fields, diagonal=True)
    labels = peaks.clusters()
    sizes = labels.groupBy("peak").agg(F.min("least").alias("cluster_id"), F.sum("n").alias("size"), F.max("density").alias("density"))
    return sizes.join(peaks.typical(labels, "peak", most), "peak", "left").drop("peak")


def group_profiles(records: DataFrame, record: str, fields: list[str], most: int = 3) -> DataFrame:
    """(group_id, size, typical): size and ``most`` typical members of each group of ``similarity_groups``."""
    peaks = DensityPeaks(records, record, fields)
    labels = peaks.groups().where("size > 1")
    sizes = labels.select("group", "size").distinct()
    return sizes.join(peaks.typical(labels, "group", most), "group").withColumnRenamed("group", "group_id")


__all__ = ["DensityPeaks", "group_profiles", "peak_clusters", "similarity_groups"]
