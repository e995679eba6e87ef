"""Recognised blocks: (image_id, pos, bbox, text, confidence) to filtered, ordered and assembled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import let
from ..functions.text import strip

#: Thresholds from strict to lenient.
CASCADE = (0.7, 0.5, 0.3)


def confidence(column: str = "confidence") -> Column:
    """A block without a confidence is certain."""
    return F.coalesce(F.col(column), F.lit(1.0))


def strict(blocks: DataFrame, limit: float = 0.3) -> DataFrame:
    return blocks.where(F.col("confidence") > limit)


def inclusive(blocks: DataFrame, limit: float = 0.3) -> DataFrame:
    return blocks.where(F.col("confidence").isNotNull() & (F.col("confidence") >= limit))


def cascade(blocks: DataFrame, key: str = "image_id", limits=CASCADE) -> DataFrame:
    """Per image, the blocks above the strictest limit that any block meets.

    The best confidence of an image is a partial aggregate that is joined back, so an image with very many blocks is
    not sorted in one task.
    """
    blocks = blocks.where(confidence() >= limits[-1])
    best = blocks.groupBy(F.col(key).alias("_key")).agg(F.max(confidence()).alias("_best"))
    limit = F.lit(limits[-1])
    for x in reversed(limits[:-1]):
        limit = F.when(F.col("_best") >= x, F.lit(x)).otherwise(limit)
    return blocks.join(best, F.col(key).eqNullSafe(F.col("_key"))).where(confidence() >= limit).drop("_key", "_best")


def nonblank(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", strip(F.col("text"))).where("text <> ''")


def plainly(blocks: DataFrame, limit: float = 0.3) -> DataFrame:
    """What is left to do where ordering fails: text stripped, not blank, with a confidence of ``limit`` or none; input order (pos) holds."""
    return nonblank(blocks).withColumn("confidence", confidence()).where(F.col("confidence") >= limit)


def corner(bbox: Column) -> tuple[Column, Column]:
    """x and y of the first corner; 0 where the box is malformed."""
    at = lambda i: F.coalesce(F.try_element_at(F.try_element_at(bbox, F.lit(1)), F.lit(i)), F.lit(0.0))
    return at(1), at(2)


def reading_rank(blocks: DataFrame, x: Column, y: Column, key: str = "image_id", pos: str = "pos", line: int = 20) -> DataFrame:
    """rank: place in reading order within an image: lines of 20 pixels, then x, then input order."""
    order = Window.partitionBy(key).orderBy(F.floor(y / line) * line, x, pos)
    return blocks.withColumn("rank", F.row_number().over(order))


def assembled(texts: Column) -> Column:
    """An ordered array of block texts to lines: short ones join the line, a line without a trailing space or hyphen ends, none exceeds 100."""
    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def push(acc: Column, line: Column, rest: Column) -> Column:
        return F.struct(F.when(strip(line) != "", F.concat(acc["lines"], F.array(strip(line)))).otherwise(acc["lines"]).alias("lines"), rest.alias("line"))

    def step(acc: Column, t: Column) -> Column:
        line = acc["line"]
        keep = lambda x: F.struct(acc["lines"].alias("lines"), x.alias("line"))
        open_ended = F.endswith(line, F.lit(" ")) | F.endswith(line, F.lit("-"))
        grown = F.when(F.length(t) <= 2, keep(F.concat(line, t))).when(line == "", keep(t)).when(~open_ended, push(acc, line, t)).otherwise(keep(F.concat(line, F.when(F.startswith(t, F.lit("-")), F.lit("")).otherwise(F.lit(" ")), t)))
        return grown

    def bounded(acc: Column, t: Column) -> Column:
        out = step(acc, t)
        return F.when(F.length(out["line"]) > 100, push(out, out["line"], F.lit(""))).otherwise(out)

    end = lambda acc: F.when(strip(acc["line"]) != "", F.concat(acc["lines"], F.array(strip(acc["line"])))).otherwise(acc["lines"])
    return F.array_join(F.aggregate(F.filter(F.transform(texts, strip), lambda t: t != ""), zero, bounded, end), "\n")


def joined(blocks: DataFrame, key: str, order: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """One text a group, in order. A group is one image or conversation, which has to fit a row anyway."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return blocks.groupBy(key).agg(F.array_join(parts, separator).alias("joined"))


def best_engine(results: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image the longest text; of equal lengths the first engine's. An aggregate, so it combines before the shuffle."""
    best = F.max(F.struct(F.length("text").alias("n"), (-F.col("engine_pos")).alias("p"), "engine", "text"))
    return results.where(strip(F.col("text")) != "").groupBy(key).agg(best.alias("b")).select(key, "b.engine", "b.text")


def best_of(texts: dict[str, Column]) -> Column:
    """The same where all engines' texts stand in one row: a struct (engine, text), without a shuffle. Blank texts do not count; none: null."""

    def told(k: int, name: str):
        return lambda t: F.when(strip(t) != "", F.struct(F.length(t).alias("n"), F.lit(-k).alias("p"), F.lit(name).alias("engine"), t.alias("text")))

    made = F.array(*(let(t, told(k, name)) for k, (name, t) in enumerate(texts.items())))
    return let(F.array_max(made), lambda b: F.when(b.isNotNull(), F.struct(b["engine"].alias("engine"), b["text"].alias("text"))))


def engine_result(blocks: DataFrame, key: str = "image_id", engine: str = "stub") -> DataFrame:
    """One result a image: success, text, total_blocks, engine, mean confidence; without blocks no success."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    out = blocks.groupBy(key).agg(F.array_join(parts, "\n").alias("text"), F.count("*").alias("total_blocks"), F.coalesce(F.avg(confidence()), F.lit(0.0)).alias("confidence"))
    return out.select(key, (F.col("total_blocks") > 0).alias("success"), "text", "total_blocks", F.lit(engine).alias("engine"), "confidence", F.lit(None).cast("string").alias("error"))
