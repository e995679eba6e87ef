"""Texts too long for a row: paragraphs over lines that are rows, and a report in part files that follow each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_break, strip
from .stored import numbered, running, stored


def paragraph_lines(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, pos, before, line, paragraph, start): every line with something in it, in order, with the text that stands before it.

    Concatenating ``before`` and ``line`` in order gives what the fold over one text gives. ``paragraph`` numbers the stretches between line ends from 1, and ``start`` is
    where ``before`` starts in the text, in characters. Lines are numbered by ranges, each meets the one before it by its number, and both counts are
    running sums over ranges, so a text of any number of lines is spread over all tasks and never gathered.

    Null lines are blank. A null key is a text. Lines that tie in ``order`` stand in some order.
    """
    rows = lines.select(F.col(key).alias("key"), F.col(order).alias("order"), strip(F.coalesce(F.col(line), F.lit(""))).alias("line")).where("line <> ''")
    rows = stored(numbered(rows, ["key"], ["order"], "pos"), "lines")
    last = rows.select(F.col("key").alias("_key"), (F.col("pos") + 1).alias("_pos"), F.col("line").alias("_line"))
    rows = rows.join(last, F.col("key").eqNullSafe(F.col("_key")) & (F.col("pos") == F.col("_pos")), "left").drop("_key", "_pos")
    rows = rows.withColumn("before", F.when(F.col("_line").isNull(), "").otherwise(line_break(F.col("line"), F.col("_line")))).drop("_line")
    new = (F.col("before") != " ").cast("long")
    rows = running(rows, ["key"], ["pos"], {"paragraph": new, "end": (F.length("before") + F.length("line")).cast("long")})
    return rows.select(F.col("key").alias(key), "pos", "before", "line", "paragraph", (F.col("end") - F.length("before") - F.length("line")).alias("start"))


def entry(name: Column, text: Column) -> Column:
    """One entry of a report without its closing line end."""
    return F.concat(F.lit("=== "), name, F.lit(" ===\n"), text, F.lit("\n"))


def report_places(results: DataFrame, name: str, text: str, order: str) -> DataFrame:
    """(name, order, start, bytes): where each entry lies in the report of all results, as write_report writes it. Null names and texts are empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = results.select(F.col(name).alias("name"), F.col(order).alias("order"), (F.octet_length(entry(part(name), part(text))) + 1).cast("long").alias("bytes"), F.lit(0).alias("all"))
    rows = running(rows, ["all"], ["order", "name"], {"end": F.col("bytes")})
    return rows.select(F.col("name").alias(name), F.col("order").alias(order), (F.col("end") - F.col("bytes")).alias("start"), "bytes")


def write_report(results: DataFrame, path: str, name: str, text: str, order: str) -> list[tuple[str, int, int]]:
    """Writes ``=== name ===`` over each text, in order, as part files under ``path``; returns (file, start, bytes) of each, in order.

    Ranges of ``order`` are parts, so files in the order of their names are the report, whatever its size; its bytes are those of sinks.report. A file of parts and where each
    starts is written last, as _parts.json: a report without it is not whole. Null names and texts are empty; without results there are no parts.
    """
    spark = results.sparkSession
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = results.select(F.col(order).alias("order"), part(name).alias("name"), entry(part(name), part(text)).alias("value"))
    rows.repartitionByRange(parts, "order", "name").sortWithinPartitions("order", "name").select("value").write.mode("overwrite").text(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((int(f.getPath().getName().split("-")[1]), f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    told, at = [], 0
    for _, file, size in files:
        told.append((file, at, size))
        at += size
    lines = spark.createDataFrame(told, "file string, start long, bytes long") if told else spark.createDataFrame([], "file string, start long, bytes long")
    lines.coalesce(1).write.mode("overwrite").json(f"{path}/_parts.json")
    return told
