"""Results as text, JSON and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_TEXT = "No text was found in the image."


def message(text: Column) -> Column:
    """What a reader gets: the text, or that there is none."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(NO_TEXT)).otherwise(text)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def report(results: DataFrame, name: str, text: str, order: str, group: str | None = None) -> DataFrame:
    """``=== name ===`` over each text, in order; one report a group, which has to fit a row."""
    part = F.concat(F.lit("=== "), F.col(name), F.lit(" ===\n"), F.col(text), F.lit("\n\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda s: s["p"])
    return results.groupBy(*([group] if group else [])).agg(F.array_join(parts, "").alias("report"))


def latest(results: DataFrame, path: str, order: str, text: str) -> DataFrame:
    """Per base name the text that came last."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return results.groupBy(name.alias("name")).agg(F.max(F.struct(order, text))[text].alias(text))


def snapshot(text: Column, title: str, at: Column) -> Column:
    """A result as it is filed: title and time, length, a line of 60 signs, a blank line, the text."""
    return F.concat(F.lit(f"{title} - "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n텍스트 길이: "), F.length(text).cast("string"), F.lit("자\n" + "=" * 60 + "\n\n"), text)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
