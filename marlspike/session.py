"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", app: str = "marlspike", **conf: str) -> SparkSession:
    """A session in one JVM, for tests and the bench; on a cluster spark-submit sets these things."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, directory: str, table: str):
    """One Parquet table of a directory."""
    return spark.read.parquet(f"{directory}/{table}.parquet")


def register(spark: SparkSession, directory: str, tables: list[str]) -> None:
    """Tables of a directory as views of the session, and ``whole_hours(start, end)`` of milliseconds as a function in SQL."""
    for table in tables:
        read(spark, directory, table).createOrReplaceTempView(table)
    spark.sql("create or replace temporary function whole_hours(s bigint, e bigint) returns bigint return if(e >= s, (e - s) div 3600000, -((s - e) div 3600000))")
