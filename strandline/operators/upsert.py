"""Idempotent writes of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a session that one task writes.
SPAN = 1 << 20


def last_write_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the last by ``order``."""
    ranked = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order])
    return rows.withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")


def replace_sessions(rows: DataFrame, path: str) -> None:
    """Write events by session; sessions in ``rows`` replace those stored, others stay.

    A session is written by as many tasks as it has spans of ids, a file each.
    """
    span = F.call_function("div", F.col("id") - F.pmod("id", F.lit(SPAN)), F.lit(SPAN))
    rows.repartition("session", span).sortWithinPartitions("session", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)


def import_sessions(derived: DataFrame, path: str) -> None:
    """Store derived events: the last row of each (session, id) by file order."""
    replace_sessions(last_write_wins(derived, ["session", "id"], ["ord"]), path)
