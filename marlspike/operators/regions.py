"""Regions on a line: overlaps, nearest sites, scores of sequences, and training rows made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.scratch import Scratch

BIN = 1_000_000


def overlaps(left: DataFrame, right: DataFrame, how: str = "inner", bin_size: int = BIN, key: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of half-open regions of the same key that overlap; columns of the right get the prefix ``r_``.

    Both sides are cut into bins and joined by key and bin; a pair is kept in the bin where the later of the two starts
    lies, so it comes once.  With ``how='left'`` regions without an overlap stay, with nulls.  Empty regions overlap nothing.

    For ``how='left'`` the left side is written with its row numbers first: numbers given anew in each branch of a plan
    need not agree, as the branches may be partitioned differently.
    """
    a = Scratch(left.sparkSession).save(left.withColumn("_row", F.monotonically_increasing_id())) if how == "left" else left
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))

    def bins(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        return df.where(F.col(s) < F.col(e)).withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size))))

    x, y = bins(a, start, end, "_bin"), bins(b, f"r_{start}", f"r_{end}", "_r_bin")
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_bin") == F.col("_r_bin")) & (F.col(start) < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(end))
    met = x.join(y, on).where(F.col("_bin") == F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / bin_size)).drop("_bin", "_r_bin")
    if how == "inner":
        return met
    alone = a.join(met.select("_row").distinct(), "_row", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).drop("_row")


def nearest(points: DataFrame, sites: DataFrame, key: str, at: str, site: str, out: str = "distance") -> DataFrame:
    """``points`` with the distance to the nearest site of the same key, null if the key has none.

    Distinct positions and sites are one sequence: the last site before and the first after each, in chunks no window of
    which holds all of a key: a chunk's own sites, and the last and first ones of the chunks around it.  Points meet the
    distances by key and position, so they need no row numbers; points without a key or position have none.
    """
    width = 1 << 20
    p = points.withColumns({"_key": F.col(key), "_at": F.col(at).cast("long")})
    s = sites.select(F.col(key).alias("_key"), F.col(site).cast("long").alias("_at"), F.lit(True).alias("_is_site"))
    both = p.select("_key", "_at", F.lit(False).alias("_is_site")).unionByName(s).where("_key is not null and _at is not null").distinct()
    both = both.select("_key", "_at", "_is_site", F.when(F.col("_is_site"), F.col("_at")).alias("_site"), F.floor(F.col("_at") / width).alias("_chunk"))
    ends = both.groupBy("_key", "_chunk").agg(F.min("_site").alias("_lo"), F.max("_site").alias("_hi"))
    # what lies ahead is what came before in the reverse order: frames that only grow are worked through once
    up, down = (Window.partitionBy("_key").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_chunk"), F.desc("_chunk")))
    around = ends.select("_key", "_chunk", F.last("_hi", ignorenulls=True).over(up).alias("_left"), F.last("_lo", ignorenulls=True).over(down).alias("_right"))
    ahead, back = (Window.partitionBy("_key", "_chunk").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("_at"), F.desc("_at")))
    before, after = F.last("_site", ignorenulls=True).over(ahead), F.last("_site", ignorenulls=True).over(back)
    found = both.withColumns({"_b": before, "_a": after}).where(~F.col("_is_site")).join(around, ["_key", "_chunk"])
    apart = F.least(F.col("_at") - F.coalesce("_b", "_left"), F.coalesce("_a", "_right") - F.col("_at"))
    return p.join(found.select("_key", "_at", apart.alias(out)), ["_key", "_at"], "left").select(*points.columns, out)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGT", "TGCA"))


def motif(sites: list[str], pseudo: float = 1.0) -> list[dict[str, float]]:
    """Frequencies of the four bases by position in sites of equal length, each count with ``pseudo`` added."""
    columns = []
    for bases in zip(*sites, strict=True):
        counts = {b: bases.count(b) + pseudo for b in "ACGT"}
        columns.append({b: n / sum(counts.values()) for b, n in counts.items()})
    return columns


def motif_score(sequence: Column, weights: list[dict[str, float]]) -> Column:
    """The greatest product of weights over all places and both strands; null for other letters and too short sequences."""
    tables = [F.create_map(*(F.lit(x) for pair in column.items() for x in pair)) for column in weights]

    def best(strand: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(strand) - len(weights) + 1)

        def product(place: Column) -> Column:
            return reduce(lambda a, b: a * b, (F.element_at(table, F.substr(strand, place + i, F.lit(1))) for i, table in enumerate(tables)))

        return F.array_max(F.transform(places, product))

    usable = (F.length(sequence) >= len(weights)) & sequence.rlike("^[ACGT]+$")
    return F.when(usable, F.greatest(best(sequence), best(reverse_complement(sequence))))


def letters(sequence: Column, start: Column, end: Column, copies: int = 1) -> Column:
    """The letters of a half-open region of ``copies`` of a sequence in a row, of which only those the region meets are made.

    Null for regions that reach beyond the end; as in SQL's substr, starts below -1 count from the end.
    """
    length, wide = F.length(sequence).cast("long"), end - start
    first = F.when(start < -1, length * copies + start + 1).otherwise(start)
    at = F.try_mod(first, length)
    met = F.repeat(sequence, F.ceil((at + wide) / length).cast("int"))
    return F.when((first >= 0) & (start < end) & (first + wide <= length * copies), F.substr(met, (at + 1).cast("int"), wide.cast("int")))


def binding_rows(peaks: DataFrame, bound: DataFrame, conservation: DataFrame, genome: DataFrame, sites: DataFrame, weights: list[dict[str, float]], factor: str, cell_line: str, copies: int = 1) -> DataFrame:
    """The training rows of one cell line: label, sequence score, conservation and distance to the nearest site of each peak.

    Labelled and conserved peaks meet where they overlap.  Peaks without conservation, with other letters or beyond the end
    of their sequence are dropped.  A sequence of the genome stands ``copies`` times in a row.  Sequences are longer than
    the size of their table tells, so they aren't broadcast.  Scored peaks are written first, as ``nearest`` reads them thrice.
    """
    regions = peaks.select("contig", "start", "end")
    labelled = overlaps(regions, bound.select("contig", "start", "end"), "left").groupBy("contig", "start", "end").agg(F.max(F.col("r_start").isNotNull()).alias("label"))
    conserved = overlaps(regions, conservation.where("start <= end").select("contig", "start", "end", "score"))
    scores = conserved.groupBy("contig", "start", "end").agg(F.avg("r_score").alias("avg"), F.min("r_score").alias("min"), F.max("r_score").alias("max"))
    met = overlaps(labelled, scores)
    cut = met.join(genome.hint("merge"), "contig").withColumn("_seq", letters(F.col("seq"), F.col("start"), F.col("end"), copies))
    scored = cut.where(~F.col("_seq").contains("N")).withColumn("pwm_score", motif_score(F.col("_seq"), weights))
    kept = scored.select("contig", "start", "end", "label", "r_avg", "r_min", "r_max", "pwm_score", F.floor((F.col("start") + F.col("end")) / 2).alias("_middle"))
    placed = nearest(Scratch(peaks.sparkSession).save(kept), sites, "contig", "_middle", "start", "closest_tss")
    return placed.select("contig", "start", "end", "pwm_score", F.col("r_avg").alias("phylop_avg"), F.col("r_min").alias("phylop_min"), F.col("r_max").alias("phylop_max"), "closest_tss", F.lit(factor).alias("tf"), F.lit(cell_line).alias("cell_line"), "label")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
