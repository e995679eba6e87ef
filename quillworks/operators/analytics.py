"""Aggregates over processing logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return rows.where(F.to_date(ts) >= F.date_sub(F.lit(as_of).cast("date"), days))


def daily_trends(log: DataFrame, ts: str = "created_at", accuracy: str = "accuracy", seconds: str = "processing_time") -> DataFrame:
    return log.groupBy(F.to_date(ts).alias("day")).agg(F.avg(accuracy).alias("avg_accuracy"), F.avg(seconds).alias("avg_time"), F.count("*").alias("n"))


def columnar(trends: DataFrame) -> DataFrame:
    """A row of lists, newest day first."""
    rows = F.reverse(F.array_sort(F.collect_list(F.struct(*trends.columns))))
    return trends.agg(rows.alias("r")).select(*(F.col("r")[c].alias(c) for c in trends.columns))


def error_patterns(log: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent corrections with their mean confidence, ties by text."""
    return log.groupBy("original", "corrected").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")).orderBy(F.desc("n"), "original", "corrected").limit(limit)


def _ranges(rows: DataFrame, order: str, parts: int) -> Column:
    """The range of each row's ``order`` among about ``parts`` of like many rows; a null's comes first."""
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or [])) if parts > 1 else []

    def half(lo: int, hi: int) -> Column:
        middle = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col(order) <= cuts[middle], half(lo, middle)).otherwise(half(middle + 1, hi))

    return F.when(F.col(order).isNull(), -1).otherwise(half(0, len(cuts)))


def _parts(rows: DataFrame) -> int:
    return max(64, min(512, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_mean(rows: DataFrame, order: str, value: Column, name: str = "running_mean", parts: int | None = None) -> DataFrame:
    """The mean of all values up to each row in ``order`` (unique); null values do not count.

    Sums and counts of ranges of the order give each range's base; within it a window adds up. ``value`` should be exact
    (decimal) for results that do not depend on the order of additions. Quantiles cut the ranges, so they hold like many rows.
    """
    rows = rows.withColumn("_v", value).withColumn("_part", _ranges(rows, order, parts or _parts(rows)))
    sums = rows.groupBy("_part").agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("s"), F.count("_v").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = (F.coalesce(F.sum("_v").over(within), F.lit(0)) + F.col("_s")).cast("double")
    # One row a range: small whatever the table holds.
    out = rows.join(F.broadcast(base), "_part").withColumn(name, F.try_divide(total, F.count("_v").over(within) + F.col("_n")))
    return out.drop("_v", "_part", "_s", "_n")


def batch_stats(rows: DataFrame, ok: Column, seconds: Column) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("total"), F.count_if(ok).alias("successful"), F.when(n > 0, F.bround(F.count_if(ok) * 100.0 / n, 1)).otherwise(0.0).alias("success_rate"), F.bround(F.coalesce(F.sum(seconds), F.lit(0)), 3).cast("double").alias("total_time"), F.bround(F.coalesce(F.avg(seconds), F.lit(0)), 3).cast("double").alias("avg_time"))


def text_stats(rows: DataFrame, corrections: Column, morphemes: Column, seconds: Column) -> DataFrame:
    """Sums of corrections, the mean time (0 without rows) and the number of texts."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.agg(zero(F.sum(corrections)).alias("total_corrections"), zero(F.sum(morphemes)).alias("morpheme_corrections"), F.bround(zero(F.avg(seconds)), 3).cast("double").alias("average_processing_time"), F.count("*").alias("total_processed"))


def applied(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """How many texts a correction changed."""
    return rows.agg(F.count_if(before != after).alias("applied"), F.count("*").alias("total"))


def first_median(rows: DataFrame, key: str, order: str, value: Column, first: int = 20) -> DataFrame:
    """(key, angle): the median of each key's ``first`` values in order; 0 where all are null."""
    some = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_k") <= first)
    return some.groupBy(key).agg(F.coalesce(F.median(value), F.lit(0.0)).alias("angle"))


def history_stats(rows: DataFrame, key: str, order: str, score: str, last: int = 10) -> DataFrame:
    """Per key, null among them: count, mean score, share of 0.7 and more in percent, and the last scores in order."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    recent = rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last)
    recent = recent.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, score))), lambda s: s[score]).alias("last_scores"))
    n = F.count("*")
    whole = rows.groupBy(key).agg(n.alias("total"), F.bround(F.avg(score), 3).alias("avg_score"), F.bround(F.count_if(F.col(score) >= 0.7) * 100.0 / n, 1).alias("high_share"))
    return whole.join(recent.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def compare_systems(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per key which of two systems has a result: both, legacy_only, ultimate_only or both_failed. Each side: key, ok."""
    a, b = old.select(F.col(key), F.col("ok").alias("old_ok")), new.select(F.col(key), F.col("ok").alias("new_ok"))
    x, y = F.coalesce("old_ok", F.lit(False)), F.coalesce("new_ok", F.lit(False))
    return a.join(b, key, "full").select(key, F.when(x & y, "both").when(x, "legacy_only").when(y, "ultimate_only").otherwise("both_failed").alias("outcome"))


def outcome_rates(outcomes: DataFrame) -> DataFrame:
    n = F.count("*")
    return outcomes.groupBy("outcome").agg(n.alias("n")).withColumn("rate", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def progress(rows: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """Percent done, whole, after each row in ``order`` (unique, a null first).

    Counts of ranges of the order, as in running_mean, give each range's base; within it a window counts.
    """
    rows = rows.withColumn("_part", _ranges(rows, order, parts or _parts(rows)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.sum("n").over(every).alias("_all"))
    out = rows.join(F.broadcast(base), "_part").withColumn("done", F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_n"))
    return out.withColumn("percent", F.floor(F.col("done") * 100 / F.col("_all")).cast("int")).drop("_part", "_n", "_all")


def best_preset(scores: DataFrame, key: str, preset: str, order: str, score: str, plain: str = "clean") -> DataFrame:
    """(key, preset, score): per key the preset with the highest score above 0, of equal ones the first in ``order``; ``plain`` with 0 where none is above 0.

    An aggregate, so it combines before the shuffle. Null and NaN scores do not count. A null key is a key.
    """
    counts = (F.col(score) > 0) & ~F.isnan(F.col(score).cast("double"))
    best = F.max(F.when(counts, F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"), F.col(preset).alias("p"))))
    out = scores.groupBy(key).agg(best.alias("b"))
    return out.select(key, F.coalesce("b.p", F.lit(plain)).alias(preset), F.coalesce("b.s", F.lit(0)).alias(score))
