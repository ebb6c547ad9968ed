from marlspike.streaming.gaps import streamed_counts, streamed_sessions


def test_sessions_of_a_stream(spark, tmp_path):
    moments = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:30:00'), ('a', timestamp'2024-01-01 03:00:00'), ('z', timestamp'2024-02-01 00:00:00') as t(user, ts)")
    moments.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(moments.schema).parquet(str(tmp_path / "in"))
    for name, df in (("sessions", streamed_sessions(stream, "user", "ts", "1 hour", "1 hour")), ("counts", streamed_counts(stream, "ts", "user", "1 hour", "1 hour"))):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r["events"] for r in spark.table("sessions").where("user = 'a'").collect()) == [1, 2]
    assert spark.table("counts").where("user = 'a'").count() == 2
