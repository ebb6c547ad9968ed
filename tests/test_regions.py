import random

from pyspark.sql import functions as F

from marlspike.operators import regions, risk
from marlspike.plans import tracks


def test_left_overlaps_of_a_shuffled_side(spark):
    """Each region comes once, with its overlaps or alone, also where branches of the plan are partitioned differently."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        made = spark.range(120_000).select((F.col("id") % 60_000).alias("start"), F.repeat(F.lit("x"), 1000).alias("wide")).groupBy("start").agg(F.max("wide").alias("wide"))
        left = made.select(F.lit("c").alias("contig"), (F.col("start") * 10).alias("start"), (F.col("start") * 10 + 5).alias("end"), "wide")
        right = spark.createDataFrame([("c", i * 20_000, i * 20_000 + 3) for i in range(22)], "contig string, start long, end long")
        found = regions.overlaps(left, right, "left", bin_size=100_000).select("start", "r_start").collect()
        assert len(found) == 60_000 and len({r["start"] for r in found}) == 60_000
        assert sorted(r["start"] for r in found if r["r_start"] is not None) == [i * 20_000 for i in range(22)]
        near = regions.nearest(left, right, "contig", "start", "start")
        assert near.count() == 60_000 and near.agg(F.max("distance")).first()[0] == 599_990 - 420_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nearest_keeps_every_point(spark, rows):
    points = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("b", 7, 3), (None, 1, 4), ("a", None, 5), ("a", 3_000_000, 6)], "k string, at long, extra long")
    sites = spark.createDataFrame([("a", 1), ("a", 9), (None, 1), ("a", None)], "k string, site long")
    assert {r["extra"]: r["distance"] for r in regions.nearest(points, sites, "k", "at", "site").collect()} == {1: 4, 2: 4, 3: None, 4: None, 5: None, 6: 2_999_991}
    assert rows(regions.nearest(points.limit(0), sites, "k", "at", "site")) == []


def test_binding_rows_of_sequences_never_written_out(spark, tmp_path):
    """8000 copies of the name would be 2.4 GB; the motif is met only where two copies touch."""
    name = "BC" + "A" * 299_998
    events = [(300_000 - 10, "click", 1.0), (300_000, "purchase", 1.0), (300_020, "view", 2.5), (300_040, "signup", 1.0)]
    made = spark.createDataFrame(events, "minute long, event_type string, value double")
    made.select(F.timestamp_seconds(1_704_067_200 + F.col("minute") * 60).alias("ts"), F.lit(7).alias("user_id"), "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(7, name)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    row = tracks.binding_rows(spark, str(tmp_path)).first()
    best = round(tracks.MOTIF[0]["A"] * tracks.MOTIF[1]["C"] * tracks.MOTIF[2]["G"], 6)
    assert (row["start"], row["pwm_score"], row["phylop_avg"], row["closest_tss"], row["label"]) == (299_990, best, 2.5, 20, True)


def test_letters_of_copies(spark):
    """As substr of the copies written out; regions that aren't wholly inside are null."""
    cut = spark.createDataFrame([(s, s + 4) for s in range(-16, 16)], "s long, e long")
    for copies in (1, 3):
        whole = "GATAC" * copies
        first = {s: len(whole) + s + 1 if s < -1 else s for s in range(-16, 16)}
        want = {s: whole[f : f + 4] if 0 <= f <= len(whole) - 4 else None for s, f in first.items()}
        got = cut.select("s", regions.letters(F.lit("GATAC"), F.col("s"), F.col("e"), copies).alias("x")).collect()
        assert dict(map(tuple, got)) == want


def test_smallest(spark, monkeypatch):
    """Ranks of dirty, tied and widely spread values, with nearly nothing left to sort."""
    monkeypatch.setattr(risk, "FEW_ROWS", 3)
    monkeypatch.setattr(risk, "BINS", 16)
    draw = random.Random(4)
    values = [draw.choice([1e300, -1e300, 0.0, 5.0, 5.0, 5.0, draw.random(), draw.gauss(0, 1e-9)]) for _ in range(300)]
    table = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "value double")
    ordered = sorted(values)
    for k in (1, 2, 77, 150, 299, 300):
        assert risk.smallest(table, "value", lambda n, k=k: k)[0] == ordered[k - 1]
    plain = spark.createDataFrame([(float(i % 50),) for i in range(1000)], "value double")
    assert risk.value_at_risk(plain) == 2.0 and risk.tail_mean(plain).first()[0] == (20 * 0 + 20 * 1 + 10 * 2) / 50
    assert risk.value_at_risk(plain.limit(0)) is None and risk.tail_mean(plain.limit(0)).first()[0] is None
    assert risk.density(plain.limit(0), "value").count() == 0
