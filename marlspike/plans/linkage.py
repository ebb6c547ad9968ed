"""Queries of compared records and network connections: profiles, cross-tabs, priors, confusion, purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.operators import classify, cluster, profile
from marlspike.session import read

SCORED = ["cmp_lname_c1", "cmp_plz", "cmp_by", "cmp_bd", "cmp_bm"]
MEASURES = ["cmp_fname_c1", "cmp_fname_c2", "cmp_lname_c1", "cmp_lname_c2", "cmp_sex", "cmp_bd", "cmp_bm", "cmp_by", "cmp_plz"]
FLAGS = ["land", "logged_in", "is_guest_login"]


def _measured(spark: SparkSession, directory: str) -> DataFrame:
    """The pairs with NaN taken for missing."""
    pairs = read(spark, directory, "matchdata")
    return pairs.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in MEASURES})


def linkage_profile_delta(spark: SparkSession, directory: str) -> DataFrame:
    """How the measures of matches differ from those of the rest."""
    pairs = _measured(spark, directory)
    matches, misses = (profile.profile(pairs.where(w), ["id_1", "id_2", *MEASURES]) for w in ("is_match", "not is_match"))
    return profile.profile_delta(matches, misses).select("field", F.round("total", 6).alias("total"), F.round("delta", 6).alias("delta"))


def linkage_profile(spark: SparkSession, directory: str) -> DataFrame:
    rows = profile.profile(_measured(spark, directory), MEASURES)
    return rows.select("field", *(F.round(m, 6).alias(m) for m in profile.METRICS))


def profile_transposed(spark: SparkSession, directory: str) -> DataFrame:
    """The profile by way of text, unpivoted and pivoted."""
    summary = _measured(spark, directory).select(MEASURES).describe()
    wide = profile.transposed(summary, "summary", MEASURES, profile.METRICS)
    return wide.select("field", *(F.round(m, 6).alias(m) for m in profile.METRICS))


def match_balance(spark: SparkSession, directory: str) -> DataFrame:
    return profile.class_balance(read(spark, directory, "matchdata"), "is_match")


def match_score_crosstab(spark: SparkSession, directory: str) -> DataFrame:
    pairs = read(spark, directory, "matchdata").where("is_match is not null").withColumn("outcome", F.when(F.col("is_match"), "true").otherwise("false"))
    return profile.crosstab(pairs, profile.score(SCORED) >= 4.0, "outcome", ["true", "false"])


def connection_labels(spark: SparkSession, directory: str) -> DataFrame:
    return profile.class_balance(read(spark, directory, "kddcup").select(lower_name("label").alias("label")), "label")


def _logged(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "kddcup").where("logged_in in (0, 1) and dst_bytes is not null")
    return rows.select(F.col("logged_in").alias("label"), (F.col("dst_bytes") > 300).cast("int").alias("prediction"), "conn_id")


def confusion_matrix(spark: SparkSession, directory: str) -> DataFrame:
    return classify.confusion(_logged(spark, directory), "label", "prediction", [0, 1])


def prediction_scores(spark: SparkSession, directory: str) -> DataFrame:
    return classify.scores(_logged(spark, directory), "label", "prediction").select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


def class_priors(spark: SparkSession, directory: str) -> DataFrame:
    return classify.priors(read(spark, directory, "kddcup").select(lower_name("label").alias("label")), "label").select("label", F.round("prior", 6).alias("prior"))


def random_accuracy(spark: SparkSession, directory: str) -> DataFrame:
    """Two sets of connections by the parity of their id."""
    rows = read(spark, directory, "kddcup").select("conn_id", lower_name("label").alias("label"))
    train, test = rows.where("conn_id % 10 < 9"), rows.where("conn_id % 10 >= 9")
    return classify.random_accuracy(train, test, "label").select(F.round("accuracy", 6).alias("accuracy"))


def one_hot_decoded(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "kddcup").select("conn_id", *FLAGS).distinct()
    return classify.decoded_one_hot(rows, {"flagged": FLAGS}).groupBy("flagged").count()


def cluster_label_entropy(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "kddcup").select(lower_name("protocol_type").alias("cluster"), lower_name("label").alias("label"))
    return cluster.label_entropy(rows.dropna(), "cluster", "label").select(F.round("entropy", 6).alias("entropy"))


def cluster_label_counts(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "kddcup").select(lower_name("protocol_type").alias("cluster"), lower_name("label").alias("label"))
    return rows.groupBy("cluster", "label").count().orderBy("cluster", F.desc("count"), "label")


def _mean_array(column: str, length: int) -> Column:
    return F.array(*(F.avg(F.get(column, F.lit(i)).cast("double")) for i in range(length)))


def anomaly_topk(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors at least as far from their label's mean as the hundredth."""
    vectors = read(spark, directory, "embeddings")
    centres = vectors.groupBy("label").agg(_mean_array("embedding", 64).alias("centre"))
    far = cluster.centre_distances(vectors, "embedding", "label", centres)
    return cluster.anomalies(far, 100).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def queries() -> dict:
    return {f.__name__: f for f in (linkage_profile_delta, linkage_profile, profile_transposed, match_balance, match_score_crosstab, connection_labels, confusion_matrix, prediction_scores, class_priors, random_accuracy, one_hot_decoded, cluster_label_entropy, cluster_label_counts, anomaly_topk)}


_TRIM = "nullif(lower(trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _real(column: str) -> str:
    return f"case when not isnan({column}::double) then {column}::double end"


def oracles() -> dict[str, str]:
    def rows(columns: list[str], where: str = "true") -> str:
        return " union all ".join(f"select '{c}' as field, count({_real(c)})::double as count, avg({_real(c)}) as mean, stddev_samp({_real(c)}) as stddev, min({_real(c)}) as min, max({_real(c)}) as max from matchdata where {where}" for c in columns)

    whole = f"select field, round(count, 6) as count, round(mean, 6) as mean, round(stddev, 6) as stddev, round(min, 6) as min, round(max, 6) as max from ({rows(MEASURES)})"
    score = " + ".join(f"coalesce({_real(c)}, 0)" for c in SCORED)
    logged = "logged as (select logged_in as label, (dst_bytes > 300)::int as prediction from kddcup where logged_in in (0, 1) and dst_bytes is not null)"
    label, protocol = _TRIM.format("label"), _TRIM.format("protocol_type")
    return {
        "linkage_profile_delta": f"select a.field, round(a.count + b.count, 6) as total, round(a.mean - b.mean, 6) as delta from ({rows(['id_1', 'id_2', *MEASURES], 'is_match')}) a join ({rows(['id_1', 'id_2', *MEASURES], 'not is_match')}) b using (field)",
        "linkage_profile": whole,
        "profile_transposed": whole,
        "match_balance": "select is_match, count(*) as count from matchdata group by is_match",
        "match_score_crosstab": f"select above, nullif(count(*) filter (is_match), 0) as \"true\", nullif(count(*) filter (not is_match), 0) as \"false\" from (select ({score}) >= 4.0 as above, is_match from matchdata where is_match is not null) group by above",
        "connection_labels": f"select {label} as label, count(*) as count from kddcup group by 1",
        "confusion_matrix": f"with {logged} select label, count(*) filter (prediction = 0) as \"0\", count(*) filter (prediction = 1) as \"1\" from logged group by label",
        "prediction_scores": f"with {logged}, k as (select unnest([0, 1]) as k), each as (select k, (select count(*) from logged where label = k) as n, (select count(*) from logged where prediction = k) as said, (select count(*) from logged where label = k and prediction = k) as hit from k) select round(sum(hit) / sum(n), 6) as accuracy, round(sum(n * 2.0::double * hit / (n + said)) / sum(n), 6) as f1 from each where n > 0",
        "class_priors": f"select label, round(count(*)::double / sum(count(*)) over (), 6) as prior from (select {label} as label from kddcup) group by label",
        "random_accuracy": f"with r as (select conn_id, {label} as label from kddcup), a as (select label, count(*)::double / sum(count(*)) over () as p from r where conn_id % 10 < 9 group by label), b as (select label, count(*)::double / sum(count(*)) over () as q from r where conn_id % 10 >= 9 group by label) select round(coalesce(sum(p * q), 0), 6) as accuracy from a join b using (label)",
        "one_hot_decoded": "select (case when land = 1 then 0 when logged_in = 1 then 1 when is_guest_login = 1 then 2 else case when land is null or logged_in is null or is_guest_login is null then -1 else -1 end end)::int as flagged, count(*) as count from (select distinct conn_id, land, logged_in, is_guest_login from kddcup) group by 1",
        "cluster_label_entropy": f"with c as (select {protocol} as cluster, {label} as label, count(*)::double as n from kddcup where {protocol} is not null and {label} is not null group by 1, 2), s as (select *, sum(n) over (partition by cluster) as size from c), h as (select cluster, any_value(size) as size, -sum(n / size * ln(n / size)) as h from s group by cluster) select round(sum(size * h) / sum(size), 6) as entropy from h",
        "cluster_label_counts": f"select {protocol} as cluster, {label} as label, count(*) as count from kddcup group by 1, 2",
        "anomaly_topk": "with e as (select vec_id, label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, avg(x) as c from e group by label, i), d as (select vec_id, label, sum((x - c) * (x - c)) as distance from e join m using (label, i) group by vec_id, label), t as (select min(distance) as t from (select distance from d order by distance desc limit 100)) select vec_id, label, round(distance, 6) as distance from d, t where distance >= t",
    }
