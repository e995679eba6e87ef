"""Recognition of a folder of images as one job: spark-submit job.py FOLDER [LANGUAGES] [--engine NAME] [--output FOLDER]."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.functions import text
from quillworks.operators import blocks, engines
from quillworks.sources import encoding, files, rasters

USAGE = "usage: job.py FOLDER [LANGUAGES] [--engine NAME] [--output FOLDER]"


def arguments(argv: list[str]) -> dict[str, str] | None:
    """folder, languages, engine and output; None where they do not make sense."""
    told, rest, given = {"languages": "ko+en", "engine": "stub", "output": ""}, [], list(argv)
    while given:
        word = given.pop(0)
        if word in ("--engine", "--output"):
            if not given:
                return None
            told[word[2:]] = given.pop(0)
        elif word.startswith("--"):
            return None
        else:
            rest.append(word)
    if not 1 <= len(rest) <= 2:
        return None
    return {**told, **dict(zip(("folder", "languages"), rest, strict=False))}


def recognised(images: DataFrame, engine: str, languages: str) -> DataFrame:
    """(image_id, success, text, total_blocks, engine, languages, error) of decoded images (image_id, height, width, channels, data, error).

    Unreadable images and failed engines are rows with an error; the text goes through the first pipeline. One row an image, in any order.
    """
    good, bad = images.where("error is null"), images.where("error is not null")
    found = engines.recognise(good, engine)
    read = blocks.engine_result(found.where("error is null"), engine=engine).select("image_id", "text", "total_blocks")
    failed = found.where("error is not null").groupBy("image_id").agg(F.min("error").alias("why"))
    out = good.select("image_id").join(read, "image_id", "left").join(failed, "image_id", "left")
    out = text.worker(out.withColumn("text", F.coalesce("text", F.lit(""))))
    out = out.select("image_id", F.col("why").isNull().alias("success"), "text", F.coalesce("total_blocks", F.lit(0)).cast("long").alias("total_blocks"), F.col("why").alias("error"))
    out = out.unionByName(bad.select("image_id", F.lit(False).alias("success"), F.lit("").alias("text"), F.lit(0).cast("long").alias("total_blocks"), "error"))
    codes = files.languages(F.lit(languages))
    return out.withColumns({"engine": F.lit(engine), "languages": F.array_join(codes, "+")})


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """Reads the folder, writes a JSON line an image to the output (else shows them); 1 where the arguments are wrong."""
    told = arguments(argv)
    if told is None or told["engine"] not in engines.available():
        print(USAGE if told is None else f"no engine {told['engine']}: there are {', '.join(engines.available())}")
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    images = rasters.decoded(files.scan_folder(spark, told["folder"]))
    lines = encoding.safe_json(recognised(images, told["engine"], told["languages"]), "text")
    if told["output"]:
        lines.write.mode("overwrite").text(told["output"])
    else:
        lines.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
