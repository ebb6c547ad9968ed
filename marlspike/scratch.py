"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a round's result as a Parquet table and reading it back.  Such a table
survives the loss of any executor, keeps its column statistics and is smaller than a checkpoint of row objects.  The
folder is the one named in ``spark.checkpoint.dir``; only a session in a single JVM that names none gets a temporary one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or, on ``local[...]`` without that setting, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="marlspike-")
    return _own[app]


class Scratch:
    """Tables of one run of an operator: ``save`` writes and reads back, ``drop`` frees those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/marlspike/{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[tuple[DataFrame, str]] = []  # the tables themselves, so that no other can take one's identity
        self._tables: dict[str, str] = {}
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((saved, path))
        return saved

    def folder(self) -> str:
        """A new path among the tables, for files of any form."""
        self._n += 1
        return f"{self.root}/{self._n:04d}"

    def save_observed(self, df: DataFrame, *observed: Column) -> tuple[DataFrame, dict]:
        """As ``save``, with aggregates of the rows that come out of the same pass; a task run twice may count twice."""
        seen = Observation()
        saved = self.save(df.observe(seen, *observed))
        return saved, seen.get

    def save_bucketed(self, df: DataFrame, column: str, *observed: Column) -> tuple[DataFrame, dict]:
        """As ``save_observed``, in as many buckets by ``column`` as shuffles have partitions.

        A join or aggregate by that column leaves such a table where it is: only the other side is shuffled.
        """
        self._n += 1
        path, name = f"{self.root}/{self._n:04d}", f"marlspike_{uuid.uuid4().hex}"
        seen = Observation()
        watched = df.observe(seen, *observed) if observed else df
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        watched.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(name)
        saved = self.spark.table(name)
        self._paths.append((saved, path))
        self._tables[path] = name
        return saved, seen.get if observed else {}

    def drop(self, *saved: DataFrame) -> None:
        """Deletes tables that ``save`` returned; nothing may still have to be computed from them."""
        for df in saved:
            for at, (kept, path) in enumerate(self._paths):
                if kept is df:
                    del self._paths[at]
                    self._delete(path)
                    break

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Deletes all tables; for callers that have used the operator's result.  Otherwise the end of the process does it."""
        atexit.unregister(self.close)
        try:
            for name in self._tables.values():
                self.spark.sql(f"drop table if exists {name}")
            self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        if path in self._tables:
            self.spark.sql(f"drop table if exists {self._tables.pop(path)}")
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
