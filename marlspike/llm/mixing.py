"""Sources mixed to target shares, by a low-discrepancy schedule of slots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.scratch import Scratch
from marlspike.skew import BROADCAST_ROWS, lookup, running_sum

GOLDEN = (math.sqrt(5) - 1) / 2
#: Tokens of a block at most; mixes of few tokens have smaller ones, so that there are LEAST_SLOTS slots.
BLOCK_TOKENS = 8192
LEAST_SLOTS = 1 << 16
#: Slots numbered in one window; rows of a source ordered in one window, about, in tokens.
CHUNK_SLOTS = 1 << 16
CHUNK_TOKENS = 1 << 26
#: Shares are whole numbers of this part, so that their sums are exact.
UNITS = 1 << 40


def golden_point(i: Column) -> Column:
    """The i-th point of the golden-ratio sequence in [0, 1); split so that no digits are lost for i up to 2 ** 40."""
    high, low = F.shiftright(i, 20), i.bitwiseAND(F.lit((1 << 20) - 1))
    x = F.pmod(high.cast("double") * F.lit(math.fmod(GOLDEN * (1 << 20), 1.0)), F.lit(1.0)) + low.cast("double") * F.lit(GOLDEN) + F.lit(0.5)
    return F.pmod(x, F.lit(1.0))


class Mix:
    """A mix of ``sizes`` (id, source, tokens) to the shares in ``targets`` (source, target_share, max_repeats).

    The mix is as large as all rows together, those of no target included, and has one slot for each ``block_tokens`` (by
    default BLOCK_TOKENS, or what gives LEAST_SLOTS slots if that is less, so that few tokens are mixed as finely).  Slot i
    goes to the source in whose part of the unit interval (parts as wide as the shares, which are divided by their sum) the
    i-th golden-ratio point falls, so that any run of slots has nearly the target shares.  Each source's rows, in the order
    of a hash, are cut into blocks of that many tokens: a row is in the block in which it starts.  A source's k-th slot
    takes its block k modulo its blocks, so it starts again when all are used, at most ``max_repeats`` times; slots beyond
    that stay empty.  As the first empty slot is known, the report has two mixes: the whole one, where the shares of the
    others rise above their targets, and the balanced one, the slots before the first empty one of a source that fills any,
    where the shares of all such sources hold.

    The unit interval is cut into cells, each source is listed in the cells it touches, and a slot meets only the sources
    of its cell, so any number of targets will do.  Running sums are taken by chunks (``running_sum``), so a source with
    most of the rows is no single task; blocks are small, and the slots meet them by source and block.

    Sources are compared without outer blanks and in lower case.  Rows of size 0 or null go with the block they start in,
    rows without id are left out, rows without source or of no target count in the total only.  Null or negative shares and
    repeats count as 0; a target without rows gets nothing; of a source named twice the first by share counts.
    """

    def __init__(self, sizes: DataFrame, item: str, source: str, size: str, targets: DataFrame, block_tokens: int | None = None):
        self.scratch, self.item = Scratch(sizes.sparkSession), item
        wanted = targets.select(lower_name("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("repeats"))
        once = wanted.where("source is not null").groupBy("source").agg(F.min(F.struct("share", "repeats")).alias("t")).select("source", "t.share", "t.repeats")
        self.table, seen = self.scratch.save_observed(once, F.count(F.lit(1)).alias("n"), F.sum("share").alias("whole"))
        self.sources, self.whole = seen["n"], seen["whole"] or 0.0
        named = sizes.select(F.col(item).alias("id"), lower_name(source).alias("source"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
        self.rows, seen = self.scratch.save_observed(named.where("id is not null"), F.sum("tokens").alias("tokens"))
        self.total = seen["tokens"] or 0
        self.block = block_tokens or max(1, min(BLOCK_TOKENS, self.total // LEAST_SLOTS))
        self.slots = self.total // self.block if self.whole else 0
        sums = self.rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / self.block)).cast("long")
        self.counts = self.scratch.save(self.table.join(sums, "source", "left").withColumn("blocks", F.when(F.col("tokens").isNotNull(), blocks)))
        self._ranked: DataFrame | None = None

    def _blocks(self) -> DataFrame:
        """(source, id, tokens, block) of the targets' rows."""
        chunks = max(0, math.ceil(math.log2(max(1, self.total / CHUNK_TOKENS))))
        last = self.counts.where("blocks is not null").select("source", "blocks")
        hashed = lookup(self.rows, last, "source", self.sources).withColumn("hash", F.xxhash64("id", F.lit(31)))
        chunked = hashed.withColumn("chunk", F.shiftright("hash", 64 - chunks) if chunks else F.lit(0).cast("long"))
        placed = running_sum(chunked, ["source"], "chunk", ["hash", "id"], F.col("tokens"), "start")
        return placed.select("source", "id", "tokens", F.least(F.floor(F.col("start") / self.block), F.col("blocks") - 1).alias("block"))

    def _parts(self) -> tuple[DataFrame, int, int, int]:
        """(cell, source, low, high) of the sources in the cells they touch; the cells, all units, and the rows at most."""
        units = F.floor(F.col("share") / F.lit(self.whole) * UNITS).cast("long")
        parts = self.table.select("source", units.alias("units"), F.xxhash64("source").alias("hash")).where("units > 0")
        parts = parts.withColumns({"all": F.lit(0), "chunk": F.shiftright("hash", 52)})
        placed, seen = self.scratch.save_observed(running_sum(parts, ["all"], "chunk", ["hash", "source"], F.col("units"), "low"), F.sum("units").alias("units"))
        whole, cells = seen["units"] or 1, min(1 << 20, 1 << max(6, math.ceil(math.log2(4 * max(1, self.sources)))))

        def cell(unit: Column) -> Column:
            return F.floor(unit * cells / whole).cast("long")

        listed = placed.select("source", "low", (F.col("low") + F.col("units")).alias("high")).select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
        return listed, cells, whole, cells + self.sources

    def _slots(self) -> DataFrame:
        """(slot, source, pass, block, filled) of all slots."""
        if self._ranked is None:
            listed, cells, whole, rows = self._parts()
            unit = F.least(F.floor(golden_point(F.col("id")) * whole).cast("long"), F.lit(whole - 1))
            drawn = self.table.sparkSession.range(self.slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK_SLOTS).alias("chunk"), unit.alias("unit"))
            drawn = drawn.withColumn("cell", F.floor(F.col("unit") * cells / whole).cast("long"))
            here = drawn.join(F.broadcast(listed) if rows <= BROADCAST_ROWS else listed, "cell").where("unit >= low and unit < high")
            ranked = running_sum(here.select("slot", "chunk", "source"), ["source"], "chunk", ["slot"], F.lit(1).cast("long"), "rank")
            met = lookup(ranked, self.counts.select("source", "blocks", "repeats"), "source", self.sources)
            placed = met.withColumns({"pass": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
            filled = F.coalesce(F.col("pass") < F.col("repeats"), F.lit(False))
            self._ranked = self.scratch.save(placed.select("slot", "source", "pass", "block", filled.alias("filled")))
        return self._ranked

    def schedule(self) -> DataFrame:
        """(slot, source, pass, block) of the slots that are filled."""
        return self._slots().where("filled").drop("filled")

    def mixed(self) -> DataFrame:
        """(slot, pass, source, id, n_tokens): the rows of the mix in slots; a row comes as often as its source is repeated."""
        joined = self.schedule().join(self._blocks(), ["source", "block"])
        return joined.select("slot", "pass", "source", F.col("id").alias(self.item), F.col("tokens").alias("n_tokens"))

    def report(self) -> DataFrame:
        """One row per target: shares wanted and reached, sizes in tokens, passes begun, slots, and whether it can't reach its share.

        ``short`` sources have slots that stay empty, and less than their share of the total in all their passes.
        """
        slots = self._slots()
        asked = slots.groupBy("source").agg(F.count(F.lit(1)).alias("slots"), F.count_if(~F.col("filled")).alias("empty_slots"), F.min(F.when(~F.col("filled"), F.col("slot"))).alias("first_empty"))
        able = F.when(F.col("empty_slots") < F.col("slots"), F.col("first_empty"))  # a source that fills no slot at all has no say
        asked, seen = self.scratch.save_observed(asked, F.min(able).alias("first"))
        upto = self.slots if seen["first"] is None else seen["first"]
        balanced = F.sum(F.when(F.col("slot") < upto, F.col("n_tokens")).otherwise(0))
        took = self.mixed().groupBy("source").agg(F.sum("n_tokens").alias("reached"), (F.max("pass") + 1).alias("passes"), balanced.alias("balanced"))
        known = self.counts.join(took, "source", "left").join(asked, "source", "left")
        zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("reached", "balanced", "passes", "slots", "empty_slots")}
        columns = ["source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("size"), *zero.values()]
        whole, seen = self.scratch.save_observed(known.select(*columns), F.sum("reached").alias("reached"), F.sum("balanced").alias("balanced"))
        shares = {f"{new}_share": F.col(c) / F.lit(float(seen[c])) if seen[c] else F.lit(0.0) for c, new in (("reached", "actual"), ("balanced", "balanced"))}
        short = (F.col("empty_slots") > 0) & (F.col("size") * F.col("max_repeats") < F.col("target_share") * F.lit(float(self.total)))
        return whole.withColumns(shares | {"short": short})
