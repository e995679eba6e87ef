"""Intermediate tables in the folder that driver and executors share, and numbers in an order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster without one is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillworks-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What this process has written, until clear().
_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: no lineage behind it, and every reader sees the same rows. It stays until clear(), as what an operator returns may read it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes the tables that operators have stored so far and tells how many; for callers that have written their results elsewhere."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def numbered(rows: DataFrame, group: list[str], order: list[str], number: str = "n") -> DataFrame:
    """rows with each one's place in ``order`` within its group, from 0. Written, so every reader sees the same numbers.

    Rows move once, to ranges of (group, order), and are numbered there; one count a range and group tells what lies in the ranges before. A
    group with most of all rows is spread over many ranges. Nulls group together and come first in order; rows that tie get places of their own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *group, *order, "_at").sortWithinPartitions(*group, *order, "_at")
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranged")
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    shift = (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift")
    counts = counts.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(group)), F.col("_part").alias("_p"), shift)
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return rows.join(counts, same).withColumn(number, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_shift", *(f"_g{k}" for k in range(len(group))))


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums in ``order`` within their group, each row's own value included; a null value counts 0.

    Rows move to ranges of (group, order). Within a range a window adds up; one row of totals a range and group gives what lies before. No task has more
    than a range of any group. Ties are added up in some order, the same for all sums. A name in ``sums`` that is a column of rows replaces it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [f"_v{k}" for k in range(len(sums))]
    rows = rows.withColumns({v: F.coalesce(c, F.lit(0)) for v, c in zip(own, sums.values(), strict=True)}).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *group, *order, "_at").sortWithinPartitions(*group, *order, "_at")
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranged")
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_part").agg(*(F.sum(v).alias(v) for v in own))
    bases = totals.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(group)), F.col("_part").alias("_p"), *(F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"_b{v}") for v in own))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    within = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({f"_s{v}": F.sum(v).over(within) for v in own}).join(bases, same)
    out = out.withColumns({name: F.col(f"_s{v}") + F.col(f"_b{v}") for name, v in zip(sums, own, strict=True)})
    return out.drop("_at", "_part", "_p", *own, *(f"_s{v}" for v in own), *(f"_b{v}" for v in own), *(f"_g{k}" for k in range(len(group))))
