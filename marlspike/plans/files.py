"""Queries over the readers: test tables written as files of a form, read back, and compared with the tables in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.operators import classify, graph, profile, sampling, trips
from marlspike.plans.linkage import MEASURES
from marlspike.scratch import Scratch
from marlspike.session import read, register
from marlspike.sources import readers

_EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _lines(df: DataFrame, *parts: Column, separator: str = "\t") -> str:
    """A folder of text files with the parts of each row; missing ones are empty."""
    path = Scratch(df.sparkSession).folder()
    df.select(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).alias("value")).write.text(path)
    return path


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def read_linkage(spark: SparkSession, directory: str) -> DataFrame:
    pairs, path = read(spark, directory, "matchdata"), Scratch(spark).folder()
    whole = pairs.select("id_1", "id_2", *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) for c in MEASURES), "is_match")
    whole.write.option("header", True).option("nullValue", "?").csv(path)
    return readers.linkage(spark, path)


def read_connections(spark: SparkSession, directory: str) -> DataFrame:
    path = Scratch(spark).folder()
    read(spark, directory, "kddcup").select(*readers.CONNECTION_COLUMNS).write.options(**_EXACT).csv(path)
    found = readers.connections(spark, path).groupBy(lower_name("label").alias("label"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("src_bytes").alias("src_bytes"), F.round(F.sum("serror_rate"), 4).alias("serror_rate"))


def read_cover(spark: SparkSession, directory: str) -> DataFrame:
    """Parts as plots of forest: their groups of one-hot columns, one of which may be without a 1."""
    parts, path = read(spark, directory, "part"), Scratch(spark).folder()
    numbers = [F.col("p_size") + i for i in range(10)]
    hot = [(F.col("p_partkey") % 5 == i).cast("int") for i in range(4)] + [(F.col("p_size") % 40 == i).cast("int") for i in range(40)]
    parts.select(*(c.alias(f"c{i}") for i, c in enumerate([*numbers, *hot, (F.col("p_partkey") % 7 + 1).cast("double")]))).write.csv(path)
    found = classify.decoded_one_hot(readers.forest_cover(spark, path), readers.COVER_GROUPS)
    return found.groupBy("wilderness", "soil").agg(F.count(F.lit(1)).alias("n"), F.sum("Elevation").alias("elevation"), F.sum("Cover_Type").alias("cover"))


def _plays(spark: SparkSession, directory: str) -> str:
    lines = read(spark, directory, "lineitem")
    broken = F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return _lines(lines, F.col("l_orderkey"), F.col("l_partkey"), broken, separator=" ")


def read_plays(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of three integers, and the number of those that can't be read."""
    path = _plays(spark, directory)
    good = readers.play_counts(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("user").alias("users"), F.sum("count").alias("counts"))
    bad = readers.rejects(spark, path, 3, " ").agg(F.count(F.lit(1)).alias("rejects"))
    return good.join(F.broadcast(bad), F.lit(True))


def read_artists(spark: SparkSession, directory: str) -> DataFrame:
    parts = read(spark, directory, "part")
    return readers.artists(spark, _lines(parts, F.col("p_partkey"), F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))))


def read_aliases(spark: SparkSession, directory: str) -> DataFrame:
    parts = read(spark, directory, "part")
    return readers.aliases(spark, _lines(parts, F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")), F.col("p_size")))


def read_lines(spark: SparkSession, directory: str) -> DataFrame:
    return readers.lines(spark, _lines(read(spark, directory, "part"), F.col("p_name"))).agg(F.count(F.lit(1)).alias("n"))


def read_citations(spark: SparkSession, directory: str) -> DataFrame:
    """Major topics of citations in XML, some lines a citation."""
    topics = read(spark, directory, "topics").where("citation_id is not null and topic is not null")
    name = F.concat(F.lit('<DescriptorName MajorTopicYN="'), F.coalesce("majortopicyn", F.lit("N")), F.lit('">'), _xml(F.col("topic")), F.lit("</DescriptorName>"))
    records = topics.groupBy("citation_id").agg(F.concat_ws("\n", F.collect_list(name)).alias("names"))
    path = Scratch(spark).folder()
    records.select(F.concat(F.lit('<MedlineCitation Status="x">\n'), "names", F.lit("\n</MedlineCitation>")).alias("value")).write.text(path)
    found = readers.citations(spark, path).select(F.explode(graph.major_topics(F.col("record"))).alias("topic"))
    return profile.class_balance(found.select(lower_name("topic").alias("topic")).where("topic is not null"), "topic")


def read_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages of an XML dump: how many letters their contents have, without white space."""
    pages, path = read(spark, directory, "doctexts"), Scratch(spark).folder()
    body = F.concat(F.lit('<text bytes="1" xml:space="preserve">'), _xml(F.coalesce("contents", F.lit(""))), F.lit("</text>"))
    pages.select(F.concat(F.lit("<page><title>"), _xml(F.coalesce("title", F.lit(""))), F.lit("</title><revision>"), body, F.lit("</revision></page>")).alias("value")).write.text(path)
    letters = F.length(F.regexp_replace(F.coalesce("contents", F.lit("")), r"\s+", ""))
    return readers.wiki_pages(spark, path).agg(F.count(F.lit(1)).alias("pages"), F.sum(letters).alias("letters"))


def read_geojson(spark: SparkSession, directory: str) -> DataFrame:
    """The zones and stands, a fixed table, as one collection of features."""
    features, path = read(spark, directory, "features"), Scratch(spark).folder()
    named = features.select("id", F.create_map(F.lit("borough"), F.coalesce("borough", F.lit(""))).alias("properties"), "geometry")
    whole = readers.feature_collection(named).agg(F.concat_ws(",", F.collect_list("json")).alias("all"))
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value")).write.text(path)
    found = readers.geojson(spark, path).groupBy(F.get_json_object("geometry", "$.type").alias("type"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.countDistinct(lower_name(F.col("properties")["borough"])).alias("boroughs"))


def _totals(row: DataFrame, *names: str) -> DataFrame:
    """One row of exact totals: those of ``names`` are bigint where they fit, as in SQL, and decimals beyond, where SQL has none."""
    saved = Scratch(row.sparkSession).save(row)
    found = saved.first()
    small = {c: F.col(c).cast("bigint") for c in names if found[c] is None or abs(found[c]) < 2**63}
    return saved.withColumns(small)


def read_trips(spark: SparkSession, directory: str) -> DataFrame:
    """Rides as a CSV of text with formatted times; times before 1970 or after 2099 aren't written.

    Sums of milliseconds leave a bigint behind at some seven million rides, so they are added up as decimals.
    """
    rides, path = read(spark, directory, "trips"), Scratch(spark).folder()

    def time(c: str) -> Column:
        return F.when(F.col(c).between(0, 4_102_444_799_999), F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd HH:mm:ss"))

    names = {"license": "hack_license", "pickupx": "pickup_longitude", "pickupy": "pickup_latitude", "dropoffx": "dropoff_longitude", "dropoffy": "dropoff_latitude"}
    text = rides.select(*(F.col(c).alias(n) for c, n in names.items()), time("pickuptime").alias("pickup_datetime"), time("dropofftime").alias("dropoff_datetime"))
    text.write.option("header", True).options(**_EXACT).csv(path)
    found = trips.parse_trips(readers.trips_text(spark, path))
    there = F.when(~F.isnan("pickupx"), F.col("pickupx"))
    sums = {n: F.sum(F.col(c).cast("decimal(20,0)")).alias(n) for c, n in (("pickuptime", "pickups"), ("dropofftime", "dropoffs"))}
    return _totals(found.agg(F.count(F.lit(1)).alias("n"), *sums.values(), F.round(F.sum(there), 2).alias("x")), *sums)


def _seconds() -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


def read_peaks(spark: SparkSession, directory: str) -> DataFrame:
    events, dot = read(spark, directory, "events"), F.lit(".")
    path = _lines(events, F.col("user_id"), _seconds(), _seconds() + 60, F.col("event_type"), F.col("value"), dot, F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    return readers.narrow_peaks(spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), F.round(F.sum("score"), 4).alias("score"))


def read_annotations(spark: SparkSession, directory: str) -> DataFrame:
    events, dot = read(spark, directory, "events"), F.lit(".")
    path = _lines(events, F.col("user_id"), dot, F.col("event_type"), _seconds() + 1, _seconds() + 60, dot, F.lit("+"), dot, F.lit('id "a"'))
    return readers.annotations(spark, path).groupBy("feature_type").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


def read_variants(spark: SparkSession, directory: str) -> DataFrame:
    parts, dot = read(spark, directory, "part"), F.lit(".")
    path = _lines(parts, F.col("p_brand"), F.col("p_partkey"), dot, F.lit("A"), F.lit("C"), dot, F.lit("PASS"), F.col("p_type"))
    return readers.variants(spark, path).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"))


def hours_by_sql(spark: SparkSession, directory: str) -> DataFrame:
    """The lengths of rides by a view and a function registered for SQL."""
    register(spark, directory, ["trips"])
    return spark.sql("select whole_hours(coalesce(pickuptime, 0), coalesce(dropofftime, 0)) as h, count(*) as count from trips group by 1")


def sampled_customers(spark: SparkSession, directory: str) -> DataFrame:
    """A fiftieth of the customers."""
    return sampling.bernoulli(read(spark, directory, "customer"), "c_custkey", 0.02, 1729).select("c_custkey")


def split_customers(spark: SparkSession, directory: str) -> DataFrame:
    """Customers in parts of nine tenths and one."""
    parts = sampling.split(read(spark, directory, "customer").select("c_custkey"), "c_custkey", [0.9, 0.1], 7)
    return parts[0].withColumn("part", F.lit(0)).unionByName(parts[1].withColumn("part", F.lit(1)))


def taken_customers(spark: SparkSession, directory: str) -> DataFrame:
    """Fifty customers drawn at random."""
    return sampling.take(read(spark, directory, "customer"), "c_custkey", 50, 3).select("c_custkey")


_QUERIES = (read_linkage, read_connections, read_cover, read_plays, read_artists, read_aliases, read_lines, read_citations, read_pages, read_geojson, read_trips, read_peaks, read_annotations, read_variants, hours_by_sql, sampled_customers, split_customers, taken_customers)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_NAME = "nullif(lower(trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '')"
_S = "epoch_us(ts) // 1000000"


def _draw(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || c_custkey::varchar), 1, 8))::bigint"


def oracles() -> dict[str, str]:
    time = "case when {0} between 0 and 4102444799999 then {0} // 1000 * 1000 else 0 end"
    return {
        "read_linkage": "select id_1, id_2, " + ", ".join(f"case when isnan({c}::double) then null else {c} end as {c}" for c in MEASURES) + ", is_match from matchdata",
        "read_connections": f"select {_NAME.format('label')} as label, count(*) as n, sum(src_bytes)::double as src_bytes, round(sum(serror_rate), 4) as serror_rate from kddcup group by 1",
        "read_cover": "select (case when p_partkey % 5 = 4 then -1 else p_partkey % 5 end)::int as wilderness, (p_size % 40)::int as soil, count(*) as n, sum(p_size)::bigint as elevation, sum(p_partkey % 7 + 1)::double as cover from part group by 1, 2",
        "read_plays": "select count(*) filter (l_linenumber <> 7) as n, sum(l_orderkey) filter (l_linenumber <> 7)::bigint as users, sum(l_quantity::int) filter (l_linenumber <> 7)::bigint as counts, count(*) filter (l_linenumber = 7) as rejects from lineitem",
        "read_artists": "select p_partkey::int as id, trim(p_name) as name from part where trim(p_name) <> ''",
        "read_aliases": "select p_partkey::int as artist, p_size as alias from part where p_partkey % 3 > 0",
        "read_lines": "select count(*) as n from part",
        "read_citations": f"select {_NAME.format('topic')} as topic, count(*) as count from topics where citation_id is not null and majortopicyn = 'Y' and {_NAME.format('topic')} is not null group by 1",
        "read_pages": "select count(*) as pages, sum(length(regexp_replace(coalesce(contents, ''), '\\s+', '', 'g')))::bigint as letters from doctexts",
        "read_geojson": f"select geometry::json->>'type' as type, count(*) as n, count(id) as ids, count(distinct {_NAME.format('borough')}) as boroughs from features group by 1",
        "read_trips": f"select count(*) as n, sum({time.format('pickuptime')})::bigint as pickups, sum({time.format('dropofftime')})::bigint as dropoffs, round(sum(case when isnan(pickupx) then 0 else coalesce(pickupx, 0) end), 2) as x from trips",
        "read_peaks": f"select event_type as name, count(*) as n, min({_S}) as first, max({_S}) + 60 as last, round(sum(value), 4) as score from events group by 1",
        "read_annotations": f"select event_type as feature_type, count(*) as n, min({_S}) as first, max({_S}) + 60 as last from events group by 1",
        "read_variants": "select p_brand as contig, count(*) as n, sum(p_partkey)::bigint as positions from part group by 1",
        "hours_by_sql": "select (coalesce(dropofftime, 0) - coalesce(pickuptime, 0)) // 3600000 as h, count(*) as count from trips group by 1",
        "sampled_customers": f"select c_custkey from customer where {_draw(1729)} < {int(0.02 * sampling.SPAN)}",
        "split_customers": f"select c_custkey, (case when {_draw(7)} < {int(0.9 * sampling.SPAN)} then 0 else 1 end)::int as part from customer",
        "taken_customers": f"select c_custkey from customer order by {_draw(3)}, c_custkey limit 50",
    }
