"""Logs and word events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dictionary import upsert


def daily(log: DataFrame, ts: str, accuracy: str, seconds: str, late: str = "1 day") -> DataFrame:
    """Daily means over a stream, complete once the watermark passes a day."""
    rows = log.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(F.window("_ts", "1 day")).agg(F.avg(accuracy).alias("avg_accuracy"), F.avg(seconds).alias("avg_time"), F.count("*").alias("n"))
    return out.select(F.to_date("window.start").alias("day"), "avg_accuracy", "avg_time", "n")


def merge_words(events: DataFrame, folder: str, checkpoint: str):
    """Keeps a word list in ``folder``: each batch writes state-<epoch> from the state before it, so a batch that runs again writes the same."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{folder}/state-{epoch - 1}") if epoch else None
        upsert(state, batch).write.mode("overwrite").parquet(f"{folder}/state-{epoch}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
