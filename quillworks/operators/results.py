"""Shapes of results: nested to flat, errors as rows, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETAIL = "struct<text:string,confidence:double,bbox:array<array<double>>>"
WORKER = f"success boolean, text string, details array<{DETAIL}>, total_blocks int, engine string, execution_time double, error string"
NESTED = f"""image_id string, success boolean, final_text string, raw_text string, detailed_results array<{DETAIL}>, processing_time double,
quality_metrics struct<image_quality:double,text_quality:double,overall_quality:double>,
processing_stats struct<total_blocks:int,corrections_applied:int,image_preprocessed:boolean,morpheme_analyzed:boolean>, error string"""


def overall(image: Column, text: Column) -> Column:
    return (image + text) / 2


def flat(results: DataFrame) -> DataFrame:
    """The nested result as one row of plain columns; a failure keeps its error and has an empty text."""
    ok = F.coalesce("success", F.lit(False))
    return results.select(
        "image_id",
        ok.alias("success"),
        F.when(ok, F.coalesce("final_text", F.lit(""))).otherwise("").alias("text"),
        F.when(ok, F.bround("quality_metrics.overall_quality", 3)).otherwise(0.0).alias("confidence"),
        "processing_time",
        F.col("raw_text"),
        F.coalesce("processing_stats.corrections_applied", F.lit(0)).alias("corrections"),
        F.coalesce("processing_stats.total_blocks", F.lit(0)).alias("blocks_count"),
        F.when(~ok, F.coalesce("error", F.lit("unknown error"))).alias("error"),
    )


def preview(text: Column, n: int = 100) -> Column:
    return F.substring(text, 1, n)


def options(defaults: dict, given: dict | None) -> dict:
    """Defaults with what is given put over them; a nested table is replaced whole."""
    return {**defaults, **(given or {})}


def availability(engines: list[str]) -> dict[str, object]:
    """Which systems can be used, and which one should be."""
    return {"engines": engines, "ultimate_available": "ultimate" in engines, "legacy_available": "legacy" in engines, "recommended": next((e for e in ("ultimate", "legacy", *engines) if e in engines), None)}


def merged(defaults: Column, given: Column) -> Column:
    """Two maps of options: the defaults with what is given put over them, key by key, as options() does for Python's. A null map gives nothing; a key that is given as null is null."""
    own = F.coalesce(given, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(F.coalesce(defaults, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(rest, own)


def well_formed(found: Column, least: int = 2) -> Column:
    """Of an engine's lists for each block - box, text, maybe confidence - those with ``least`` entries and more; null lists go."""
    return F.filter(found, lambda b: F.coalesce(F.size(b) >= least, F.lit(False)))
