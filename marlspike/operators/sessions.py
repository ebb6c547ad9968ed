"""Sessions: a user's events between gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(events: DataFrame, key: str, start: str, end: str, gap: int, names: tuple[str, str] = ("session_start", "session_end")) -> DataFrame:
    """One row per session of ``key``: key, first start, latest end, ``duration`` and ``events`` (a count).

    ``start`` and ``end`` are integers in the unit of ``gap``.  A session goes on while an event starts at most ``gap``
    after the latest end so far in it.

    Events that start in the same slot of the length of the gap always share a session: the later starts at most a gap
    after the earlier's start, which isn't after its end.  So events are first added up by key and slot, on the map side
    too, and only slots are sorted in windows: a key with a third of all rows has no more of them than its time span has
    gaps.  In the window, a slot whose first start lies more than a gap after the latest earlier end gets a flag, and the
    running sum of flags numbers the sessions.  The window, the running sum and the last aggregate share one shuffle.

    Rows whose key, start or end is null, and rows that end before they start, are no events and are left out.  Repeated
    rows count as often as they come; ties at the limit belong to the session.  An empty table gives an empty result, and
    further columns play no part, whatever their names.
    """
    width = max(int(gap), 1)
    rows = events.select(F.col(key).alias("_key"), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"))
    rows = rows.where(F.col("_key").isNotNull() & (F.col("_end") >= F.col("_start")))
    slot = F.floor((F.col("_start") - F.pmod(F.col("_start"), F.lit(width))) / width)
    slots = rows.groupBy("_key", slot.alias("_slot")).agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_key").orderBy("_slot")
    latest = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = slots.withColumn("_new", F.when(latest.isNull() | (F.col("_start") - latest > gap), 1).otherwise(0))
    numbered = flagged.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = names
    sessions = numbered.groupBy("_key", "_session").agg(F.min("_start").alias(first), F.max("_end").alias(last), F.sum("_n").alias("events"))
    return sessions.select(F.col("_key").alias(key), first, last, (F.col(last) - F.col(first)).alias("duration"), "events")
