"""Files and languages: what may come in, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "tiff")
MIME = ("image/png", "image/jpeg", "image/jpg", "image/gif", "image/bmp", "image/tiff")
LARGEST = 16 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def allowed(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES)


def allowed_mime(mime: Column) -> Column:
    return F.lower(mime).isin(*MIME)


def languages(spec: Column) -> Column:
    """Codes between + or else commas, trimmed."""
    parts = F.when(F.contains(spec, F.lit("+")), F.split(spec, r"\+")).otherwise(F.split(spec, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def sorted_languages(spec: Column) -> Column:
    """The different codes of a list, in order."""
    return F.array_sort(F.array_distinct(languages(spec)))


def scan_folder(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """Images of a folder and its subfolders, any case of suffix. A listing has each path once. Filters on path and length reach the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(allowed(F.col("path")) & (F.col("length") <= largest))


def stream_folder(spark: SparkSession, path: str, largest: int = LARGEST, files_per_batch: int = 1000) -> DataFrame:
    """The same as files arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.where(allowed(F.col("path")) & (F.col("length") <= largest))


def test_report(spark: SparkSession, path: str) -> DataFrame:
    """The nested comparison report, one JSON document."""
    return spark.read.json(path, multiLine=True)
