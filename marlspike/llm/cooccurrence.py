"""Items that appear together, counted in stripes, and how far beyond chance."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.scratch import Scratch
from marlspike.skew import lookup

#: Neighbours of an item that one stripe holds, about; an item with more of them gets several stripes.
STRIPE_NEIGHBOURS = 4096
#: Rows that a task adds up before it sends its stripes on.
HELD = 1_000_000


def _x_log_x(n: Column) -> Column:
    return F.when(n > 0, n * F.log(n)).otherwise(F.lit(0.0))


def log_likelihood_ratio(n: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """Dunning's ratio for the two by two table of one item with and without the other; 0 for independence."""
    n, n_a, n_b, total = (c.cast("double") for c in (n, n_a, n_b, total))
    cells = [n, n_a - n, n_b - n, total - n_a - n_b + n]
    sides = [n_a, total - n_a, n_b, total - n_b]
    whole = sum((_x_log_x(c) for c in cells), _x_log_x(total)) - sum((_x_log_x(c) for c in sides[1:]), _x_log_x(sides[0]))
    return F.greatest(F.lit(0.0), 2 * whole)


def together(items: DataFrame, pairs: DataFrame, record: str, item: str, pair: str, min_records: int = 1) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, total, lift, llr) for each two items in at least ``min_records`` common records.

    ``items`` has a row per record and item, ``pairs`` one per record and pair (an array of two names).  Names are compared
    without outer blanks and in lower case, item_a < item_b; a row given again, a pair in the other order and another
    spelling count once a record.  ``n`` counts the records with both, ``n_a`` and ``n_b`` those with each, ``total`` those
    with any item; ``lift`` is n * total / (n_a * n_b) and ``llr`` the log-likelihood ratio.

    Method of stripes: each task adds the neighbours of its rows up to one associative array an item, neighbour to count,
    and the tasks' arrays are merged by item.  An array has some STRIPE_NEIGHBOURS entries: an item's shares are split by a
    hash of the neighbour, so that an item that is in a third of all records has many stripes rather than one task, and a
    task sends its arrays on when it has taken HELD rows.  That makes two shuffles, one that drops what a record gives
    again and one of stripes, by item and share; counts are never grouped by pair.  An item's own count is joined once a stripe, the neighbours' when the stripe is opened, from a broadcast while the items, counted before, are
    few, by ``skew_join`` beyond.  Pairs are never made from a record's items here; they are read.

    Blank and missing names, pairs without two names and an item with itself give no row; rows without a record are left
    out.  Empty tables give an empty result.
    """
    scratch = Scratch(items.sparkSession)
    named = items.select(F.col(record).alias("r"), lower_name(item).alias("i")).where("r is not null and i is not null")
    # a row without item for each record counts the records in the same pass
    marked = named.select("r", F.explode(F.array("i", F.lit(None).cast("string"))).alias("i")).dropDuplicates()
    counts, seen = scratch.save_observed(marked.groupBy("i").agg(F.count(F.lit(1)).alias("n")), F.count("i").alias("items"), F.max(F.when(F.col("i").isNull(), F.col("n"))).alias("records"))
    total, rows = seen["records"] or 0, seen["items"]
    counts = counts.where("i is not null")
    shares = max(1, -(-rows // STRIPE_NEIGHBOURS))

    x, y = lower_name(F.get(pair, F.lit(0))), lower_name(F.get(pair, F.lit(1)))
    two = pairs.where(F.size(pair) == 2).select(F.col(record).alias("r"), x.alias("x"), y.alias("y")).where("r is not null and x != y")
    once = two.select("r", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).dropDuplicates()
    parts = once.select("a", "b").mapInArrow(_adding(shares), _STRIPE)
    ordered = parts.repartition("a", "share").sortWithinPartitions("a", "share")
    stripes = scratch.save(ordered.mapInArrow(_merging(min_records), _STRIPE))

    own = counts.select(F.col("i").alias("a"), F.col("n").alias("n_a"))
    zipped = F.explode(F.arrays_zip("bs", "ns")).alias("e")
    opened = lookup(stripes, own, "a", rows).select("a", "n_a", zipped).select("a", "n_a", F.col("e.bs").alias("b"), F.col("e.ns").alias("n"))
    met = lookup(opened, counts.select(F.col("i").alias("b"), F.col("n").alias("n_b")), "b", rows)
    all_records = F.lit(total).cast("long")
    lift = F.col("n") * all_records.cast("double") / (F.col("n_a") * F.col("n_b").cast("double"))
    llr = log_likelihood_ratio(F.col("n"), F.col("n_a"), F.col("n_b"), all_records)
    return met.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n", "n_a", "n_b", all_records.alias("total"), lift.alias("lift"), llr.alias("llr"))


#: A stripe: an item, the number of the share, its neighbours and their counts.
_STRIPE = "a string, share int, bs array<string>, ns array<long>"
_ARROW = pa.schema([("a", pa.string()), ("share", pa.int32()), ("bs", pa.list_(pa.string())), ("ns", pa.list_(pa.int64()))])
#: Entries of one Arrow batch of stripes, about.
_BATCH = 100_000


def _batches(stripes: Iterator[tuple[str, int, Counter]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    entries = 0
    for a, share, counts in stripes:
        rows.append((a, share, [*counts], [*counts.values()]))
        entries += len(counts)
        if entries >= _BATCH:
            yield _batch(rows)
            rows, entries = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _adding(shares: int):
    """Adds the neighbours of a task's rows up by item, in shares; items and neighbours are numbered, and runs of sorted numbers counted."""

    def stripes(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        (a, items), (b, neighbours) = ((x.indices.to_numpy(), x.dictionary) for x in (whole.column(c).chunk(0).dictionary_encode() for c in ("a", "b")))
        share = np.array([zlib.crc32(x.encode()) % shares for x in neighbours.to_pylist()], dtype=np.int64)
        key, counts = np.unique((a * np.int64(shares) + share[b]) * len(neighbours) + b, return_counts=True)
        group, b = np.divmod(key, len(neighbours))
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(starts, len(group)).astype(np.int32)
        names, parts = np.divmod(group[starts], shares)
        arrays = [items.take(pa.array(names)), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(ends, neighbours.take(pa.array(b))), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
        yield from pa.Table.from_arrays(arrays, schema=_ARROW).to_batches(max_chunksize=1000)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD:
                yield from stripes(held)
                held = []
        if sum(x.num_rows for x in held):
            yield from stripes(held)

    return add


def _merging(least: int):
    """Merges stripes of the same item and share, which come one after the other; drops neighbours with fewer than ``least``."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Counter]]:
        key, whole = None, Counter()
        for batch in batches:
            for a, share, bs, ns in zip(*(batch.column(c).to_pylist() for c in ("a", "share", "bs", "ns")), strict=True):
                if (a, share) != key:
                    if key:
                        yield *key, whole
                    key, whole = (a, share), Counter()
                for b, n in zip(bs, ns, strict=True):
                    whole[b] += n
        if key:
            yield *key, whole

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = ((a, share, Counter({b: n for b, n in counts.items() if n >= least}) if least > 1 else counts) for a, share, counts in merged(batches))
        yield from _batches(stripe for stripe in frequent if stripe[2])

    return kept
