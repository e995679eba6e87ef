"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, word_count

#: Hex digits of the md5 that orders documents within a source: 60 bits.
BITS = 60


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the total by weight, at most ``most`` times a source.

    Sources by code point, null last, take the weights in turn. Sources ordered by size to weight fill up first; the
    first that stays below its limit fixes the level for all after it, so the reshared excess settles in one pass.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*map(F.lit, weights))
    out = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * most)
    out = out.withColumns({"left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "heavy": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    out = out.withColumn("open", F.col("weight") * F.col("left") < F.col("cap") * F.col("heavy"))
    # The first open source's rest and weights hold for every source from there on.
    out = out.withColumns({"at_left": F.first(F.when(F.col("open"), F.col("left")), True).over(level), "at_heavy": F.first(F.when(F.col("open"), F.col("heavy")), True).over(level)})
    share = F.when(F.col("at_left").isNull(), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("at_left")).cast("double") / F.col("at_heavy").cast("double"))
    return out.select("source", "source_size", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)).alias("target"))


def md5_order(doc_id: Column, seed: str, row: Column) -> Column:
    """Where a document stands in its source: BITS bits of an md5. Rows without an id go by the row's number, so they do not stand in one place."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("row "), row.cast("string")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, BITS // 4), 16, 10).cast("long")


def plan_mix(docs: DataFrame, size=None, keep=(), weights=(1, 2, 3), most: int = 3, seed: str = "mix", rows_per_range: int = 50_000, row: str | None = None) -> DataFrame:
    """Per input row: doc_id, source, the columns in ``keep``, size, source_size, target, finish (its first copy's), copies, taken.

    ``docs`` has doc_id, source and text; ``size`` is the column that measures a row, by default the text's words. Within a source, documents go in md5 order; a copy's
    virtual finish time is (words of the source up to its end, earlier rounds included) / target. Copies are dealt to
    ranges of finish time; whole ranges before the budget's end are taken, and the one range where the running total
    meets the budget (all sources' words) is sorted and cut. Running sums are two-level: per (source, hash range)
    totals, then within a range, so a source with a third of all rows is spread over all tasks.

    Null source: a source of its own. Null or empty text: size 0, taken 0. Source without words: target 0, nothing
    taken. Equal rows (same doc_id, source and size) are interchangeable. An empty table gives no rows. Other
    columns are ignored, whatever their names. ``row`` names a column that numbers the rows and breaks ties; it is returned as
    _row with _h, the md5 order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.select("doc_id", "source", *keep, (word_count(F.col("text")) if size is None else size).alias("size"), (F.monotonically_increasing_id() if row is None else F.col(row)).alias("_row"))
    sized = scratch.write(docs.withColumn("_h", md5_order(F.col("doc_id"), seed, F.col("_row"))), "sized")
    rows, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(10, (max(1, rows) // rows_per_range).bit_length())
    ranges = 1 << bits
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)

    sized = sized.withColumn("_bucket", F.shiftright("_h", BITS - bits))
    same = lambda a, b, *more: [a["source"].eqNullSafe(b["source"]), *(a[c] == b[c] for c in more)]
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "_bucket", (F.sum("words").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("words")).alias("_base"))
    sums = sums.join(targets, same(sums, targets)).select(sums["source"], "_bucket", "_base", "source_size", "target")
    within = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sized.withColumn("_sum", F.sum("size").over(within))
    run = run.join(sums, same(run, sums, "_bucket")).select(*(run[c] for c in run.columns if c != "_sum"), "source_size", "target", (run["_sum"] + sums["_base"]).alias("_end"))
    queued = scratch.write(run, "queued")
    scratch.drop("sized")

    finish = lambda e: F.when(F.col("target") > 0, (F.lit(e) * F.col("source_size") + F.col("_end")).cast("double") / F.col("target"))
    part = lambda t: F.least(F.floor(t * ranges), F.lit(4 * ranges)).cast("long")
    copies = F.array(*(F.struct(F.lit(e).alias("epoch"), finish(e).alias("at")) for e in range(most)))
    items = queued.where("target > 0").select("_row", "_h", "doc_id", "source", "size", F.explode(copies).alias("c")).select("_row", "_h", "doc_id", "source", "size", "c.*").withColumn("range", part(F.col("at")))
    filled = items.groupBy("range").agg(F.sum("size").alias("words"))
    filled = filled.select("range", F.sum("words").over(Window.orderBy("range")).alias("upto"), "words")
    cut = filled.where(F.col("upto") > budget).orderBy("range").select("range", F.col("upto") - F.col("words")).first()
    last, before = cut or (4 * ranges + 1, budget)
    line = Window.orderBy("at", F.col("source").isNull(), "source", "epoch", "_h", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = items.where(F.col("range") == last).withColumn("upto", F.sum("size").over(line)).where(F.col("upto") <= budget - before).groupBy("_row").agg(F.count("*").alias("edge"))
    whole = sum((F.when(part(finish(e)) < last, 1).otherwise(0) for e in range(most)), F.lit(0))
    out = queued.join(edge, "_row", "left").withColumn("copies", (whole + F.coalesce("edge", F.lit(0))).cast("long"))
    out = out.withColumns({"taken": F.col("copies") * F.col("size"), "finish": finish(0)})
    return out.drop("_bucket", "_end", "edge", *(("_h", "_row") if row is None else ()))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix: each row of ``docs`` as often as plan_mix takes it, all its columns kept, whatever their names. Rows taken 0 times go.

    The rows are written once with a row number, so that the plan and the texts speak of the same rows. Within a source the plan
    takes rows in md5 order, so for each source and number of copies there is a last row that is taken so often. These few rows, one a
    source, go to the texts; a text is never shuffled. Should there be so many sources that Spark does not broadcast them,
    it joins by source and splits large ones.

    Null source: a source of its own. Null or empty text: size 0, so it weighs nothing; it stays in the mix as often as the row before
    it in its source's order. Repeated rows count each for itself. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    amount, number, place, copies, copy, other, limits = fresh(docs, "_amount", "_n", "_place", "_copies", "_copy", "_source", "_limits")
    size = options.pop("size", None)
    rows = scratch.write(docs.withColumns({amount: word_count(F.col("text")) if size is None else size, number: F.monotonically_increasing_id()}), "rows")
    plan = plan_mix(rows.select("doc_id", "source", F.col(amount).alias("amount"), F.col(number).alias("n")), F.col("amount"), row="n", **options)
    at = lambda h, size, n: F.struct(h.alias("h"), F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), size.alias("size"), n.alias("n"))
    last = plan.groupBy("source").agg(F.array(*(F.max(F.when(F.col("copies") >= c, at(F.col("_h"), F.col("size"), F.col("_row")))) for c in range(1, options.get("most", 3) + 1))).alias(limits))
    last = scratch.write(last.withColumnRenamed("source", other), "limits")
    rows = rows.withColumn(place, at(md5_order(F.col("doc_id"), options.get("seed", "mix"), F.col(number)), F.col(amount), F.col(number)))
    rows = rows.join(last, rows["source"].eqNullSafe(last[other]))
    rows = rows.withColumn(copies, F.size(F.filter(F.col(limits), lambda x: F.coalesce(F.col(place) <= x, F.lit(False)))))
    return rows.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(amount, number, place, copies, copy, other, limits)
