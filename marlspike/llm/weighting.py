"""How distinctive a term is for a record, by probabilistic relevance weighting."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.scratch import Scratch
from marlspike.skew import lookup


def term_weights(records: DataFrame, record: str, terms: str, k1: float | None = 1.2, b: float = 0.75, rarity: str = "probabilistic") -> DataFrame:
    """(record, term, tf, df, length, total, score) for each record and distinct term.

    ``score`` is rarity * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)): it grows with the term's
    count in the record up to a ceiling, less so in long records.  ``k1=None`` is its limit for b = 0 and k1 without bound,
    where nothing saturates: rarity * tf.  ``rarity`` is ``probabilistic``, ln(1 + (N - df + 0.5) / (df + 0.5)), or
    ``smoothed``, ln((N + 1) / (df + 1)).  N counts all distinct records, those without terms too, df the records with the
    term; the average length is over records with a term.

    Terms are compared without outer blanks and in lower case; missing and blank ones are dropped.  A record given again
    counts once, and if its rows differ, the one with most terms (of those the greatest) counts.  Records without id are
    left out.  An empty table gives an empty result.

    Records are shuffled once, by id, and their terms counted where they then are, without another shuffle.  Document
    frequencies are added up on the map side, which is the only shuffle by term while the vocabulary, counted before, is
    small enough to be broadcast.  A larger one is joined by ``skew_join``, where terms in very many records, fewer than 256
    by counting, meet a broadcast of their own frequencies, so neither vocabulary nor frequent terms must fit anywhere at once.
    """
    scratch = Scratch(records.sparkSession)
    clean = F.filter(F.transform(F.coalesce(F.col(terms), F.array().cast("array<string>")), lower_name), lambda t: t.isNotNull())
    rows = records.select(F.col(record).alias("r"), clean.alias("t")).where("r is not null")
    best = rows.groupBy("r").agg(F.max(F.struct(F.size("t").alias("length"), "t")).alias("row")).select("r", "row.length", "row.t")
    whole = Observation()
    sizes = (F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean"))
    best = best.observe(whole, *sizes)
    counts = scratch.save(best.select("r", "length", F.explode("t").alias("term")).groupBy("r", "length", "term").agg(F.count(F.lit(1)).alias("tf")))
    try:
        seen = whole.get
    except Py4JJavaError:  # Spark leaves an observation out of the plan of a table that it knows to be empty
        seen = best.agg(*sizes).first()
    total, mean = seen["n"], seen["mean"] or 1.0

    frequencies, seen = scratch.save_observed(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), F.count(F.lit(1)).alias("terms"))
    met = lookup(counts, frequencies, "term", seen["terms"])
    n, df, tf = F.lit(float(total)), F.col("df"), F.col("tf")
    rare = F.log((n + 1) / (df + 1)) if rarity == "smoothed" else F.log1p((n - df + 0.5) / (df + 0.5))
    gain = tf if k1 is None else tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))
    return met.select(F.col("r").alias(record), "term", "tf", "df", "length", F.lit(total).cast("long").alias("total"), (gain * rare).alias("score"))


def top_terms(weights: DataFrame, record: str) -> DataFrame:
    """(record, term): the term with the greatest score; ties go to the first in the alphabet."""
    best = weights.groupBy(record).agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("best"))
    return best.select(record, "best.term")
