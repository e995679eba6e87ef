"""Balanced contiguous shards from byte-size prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, partitions


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", framing: int = 8) -> DataFrame:
    """One row per input row: id, size, text_crc32, start (bytes before it), shard, slot.

    Rows are laid end to end by (id, crc32, size), nulls first. Byte totals of range partitions give each partition's
    base; within it a running sum places each row; the shard is where a row's middle byte falls among equal targets.
    Only ids, sizes and checksums move. No group decides where a row goes, so equal texts never gather in one task.

    Null text: size ``framing``, crc32 0. Rows alike in all three keys get adjacent slots, and however many they are, ranges share them. An empty table gives no
    rows. Fewer rows than shards leave shards empty. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "shard"), partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = scratch.write(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(framing)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sized")
    keys = ["id", "text_crc32", "size"]
    ranged = sized.withColumn("row", F.monotonically_increasing_id())  # parts rows alike in all keys
    ranged = scratch.write(ranged.repartitionByRange(n, *keys, "row").withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*keys, "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a range partition, n at most: small whatever the table holds.
    placed = ranged.join(F.broadcast(bases), "part").withColumns({"start": F.col("base") + F.sum("size").over(within) - F.col("size"), "pos": F.col("base_rows") + F.row_number().over(within) - 1})
    middle = F.expr(f"((2 * start + size) * {int(shards)}) div (2 * total)")
    placed = scratch.write(placed.select(*keys, "start", "pos", F.least(middle, F.lit(shards - 1)).cast("int").alias("shard")), "placed")
    scratch.drop("sized", "ranged")
    firsts = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "start", "shard", (F.col("pos") - F.col("first")).cast("long").alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", framing: int = 8) -> DataFrame:
    """The rows themselves with shard and slot, laid out and cut as in shard_documents; a caller's columns of these names go.

    The rows move once, to ranges of (id, crc32, size), and are written there in order and numbered. Sums over ids and sizes
    alone then find each shard's first number, ``shards`` rows at most, which tell every row its shard and slot.

    Null texts, ties and repeated rows: as in shard_documents. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "shards"), partitions(spark)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")))
    crc, size, number, part, before, tie = fresh(docs, "_crc", "_size", "_number", "_part", "_before", "_tie")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({crc: F.crc32(text.cast("binary")), size: (F.octet_length(text) + F.lit(framing)).cast("long"), tie: F.monotonically_increasing_id()})
    # The high bits of the number are the partition, the low 33 the place in it.
    rows = scratch.write(rows.repartitionByRange(n, id_col, crc, size, tie).sortWithinPartitions(id_col, crc, size, tie).drop(tie).withColumn(number, F.monotonically_increasing_id()), "rows")
    light = rows.select(F.col(number).alias("number"), F.shiftright(number, 33).alias("part"), F.col(size).alias("size"))
    totals = light.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("count"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = scratch.write(totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("count"), F.sum("bytes").over(every).alias("total")), "bases")
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a range partition, n at most: small whatever the table holds.
    placed = light.withColumn("upto", F.sum("size").over(within)).join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
    shard = F.least(F.expr(f"((2 * start + size) * {int(shards)}) div (2 * total)"), F.lit(shards - 1)).cast("int")
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("number", (F.col("count") + F.col("number").bitwiseAND((1 << 33) - 1)).alias("pos"))).alias("first")).select("shard", "first.*").orderBy("shard").collect()
    known = F.col(number)
    which, slot = F.lit(0), F.lit(0)
    for x in firsts:  # ascending, so the last that starts at or before the row is its own
        which, slot = F.when(known >= x["number"], x["shard"]).otherwise(which), F.when(known >= x["number"], F.lit(x["pos"])).otherwise(slot)
    place = F.col(before) + known.bitwiseAND((1 << 33) - 1)
    out = rows.withColumn(part, F.shiftright(number, 33))
    out = out.join(F.broadcast(bases.select(F.col("part").alias(part), F.col("count").alias(before))), part)
    return out.withColumns({"shard": which.cast("int"), "slot": (place - slot).cast("long")}).drop(crc, size, number, part, before)
