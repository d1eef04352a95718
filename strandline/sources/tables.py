"""Derived tables in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Without that setting only a local master (tests, a laptop) gets one, below its
    warehouse; on a cluster that might be a disk of one machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_derived"
    return f"{base.rstrip('/')}/derived-{uuid.uuid4().hex}"


def _system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stamp(spark: SparkSession, path: str) -> tuple:
    """Time and length of a file or folder as a whole, which change when a table is written anew or added to; empty where there is none.

    Files below are not listed, of which a large table has millions.
    """
    system, where = _system(spark, path)
    if not system.exists(where):
        return ()
    told = system.getFileStatus(where)
    return told.getModificationTime(), told.getLen()


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    system, where = _system(spark, path)
    system.delete(where, True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back.

    Derived events are read by many branches of a fold; this way lines are parsed and
    linked once, and a lost executor costs no more than its reads.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Work:
    """Tables that one run of an operator writes on its way, in the shared folder, and deletes when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` written apart, so that it outlives the others."""
        return materialised(df)

    def drop(self) -> None:
        dropped(self.spark, self.folder)


_DERIVED: dict[tuple, tuple[tuple, str, tuple]] = {}


def derived(name: str, source: str, make, spark: SparkSession) -> DataFrame:
    """The table that ``make()`` derives from ``source``, written once for an application and read by all that ask for it.

    It is made anew if the source has changed, or the table itself; the one before is
    deleted then.  ``forget`` deletes all tables of the application.
    """
    key = (spark.sparkContext.applicationId, name, source)
    now = stamp(spark, source)
    made, path, own = _DERIVED.get(key, ((), "", ()))
    if path and made == now and stamp(spark, path) == own:
        return spark.read.parquet(path)
    if path:
        dropped(spark, path)
    path = shared_folder(spark)
    make().write.parquet(path)
    _DERIVED[key] = now, path, stamp(spark, path)
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the derived tables of this application."""
    for key in [k for k in _DERIVED if k[0] == spark.sparkContext.applicationId]:
        dropped(spark, _DERIVED.pop(key)[1])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has so few partitions that most of them would stand idle; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df
