"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Values that a task may sort at once.
GATHERED = 10_000
#: Cuts of a pass, and how finely they are estimated: a cut's rank is off by at most one in FINE.
CUTS, FINE = 200, 10_000


def exact_medians(rows: DataFrame, key: str, value: str, gathered: int = GATHERED) -> DataFrame:
    """(key, median): the mean of both middle values of each group, exact, however many values it has.

    Each pass cuts what is left of a group at CUTS estimated quantiles and counts, exactly, what lies below and between the cuts around a middle
    rank; a hundredth or so is left each time, and nothing but a row of cuts a group is gathered. Groups with ``gathered`` values left are sorted. A pass
    reads the rows between the last cuts alone.

    Null and NaN values do not count; a group without others has a null median. A null key is a group. Equal values settle a rank as soon as both cuts are the same.
    """
    values = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    groups = values.select("key").distinct()
    values = stored(values.where("v is not null and not isnan(v)"), "values")
    sizes = values.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Two ranks a group, each with the range that holds it, the number of values in the range and the rank within it.
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.expr("(n - 1) div 2").alias("k")), F.struct(F.lit(1).alias("which"), F.expr("n div 2").alias("k")))).alias("r")
    state = stored(sizes.select("key", "n", "lo", "hi", ranks).select("key", "n", "lo", "hi", "r.*"), "ranks")
    found = []
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & a["v"].between(b["lo"], b["hi"])
    while True:
        found.append(state.where("lo = hi").select("key", "which", F.col("lo").alias("v")))
        state = state.where("lo < hi")
        few = state.where(F.col("n") <= gathered).select("key", "which", "k", "lo", "hi")
        at = F.element_at(F.sort_array(F.collect_list(values["v"])), (F.first("k") + 1).cast("int"))
        found.append(values.join(few, same(values, few)).groupBy(few["key"], "which").agg(at.alias("v")))
        state = state.where(F.col("n") > gathered)
        if state.isEmpty():
            break
        cuts = [j / CUTS for j in range(1, CUTS)]
        inner = values.join(state, same(values, state)).select(state["key"], "which", values["v"], "n", "k", "lo", "hi")
        told = inner.groupBy("key", "which").agg(F.percentile_approx("v", cuts, FINE).alias("cuts"), *(F.first(c).alias(c) for c in ("n", "k", "lo", "hi")))
        # The cuts on either side of the rank that are surely so, by more than their error.
        place, off = F.col("k") / F.col("n") * CUTS, 2.0 * CUTS / FINE
        below, above = F.floor(place - off).cast("int"), F.ceil(place + 1.0 / F.col("n") * CUTS + off).cast("int")
        lo = F.when(below >= 1, F.element_at("cuts", F.least(below, F.lit(CUTS - 1)))).otherwise(F.col("lo"))
        hi = F.when(above <= CUTS - 1, F.element_at("cuts", F.greatest(above, F.lit(1)))).otherwise(F.col("hi"))
        next_ = stored(told.select("key", "which", "k", "n", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), lo.alias("lo"), hi.alias("hi")), "cuts")
        wide = next_.select("key", "which", "k", F.col("lo0"), F.col("hi0"), F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"))
        counted = values.join(wide, values["key"].eqNullSafe(wide["key"]) & values["v"].between(wide["lo0"], wide["hi0"]))
        inside, v, new_lo, new_hi = F.col("v").between(F.col("new_lo"), F.col("new_hi")), F.col("v"), F.col("new_lo"), F.col("new_hi")
        counted = counted.groupBy(wide["key"], "which").agg(
            F.count_if(v < new_lo).alias("under"), F.count_if(inside).alias("n"), F.count_if(v == new_lo).alias("at_lo"), F.count_if(v == new_hi).alias("at_hi"),
            F.min(F.when(inside & (v > new_lo), v)).alias("next_lo"), F.max(F.when(inside & (v < new_hi), v)).alias("next_hi"), *(F.first(c).alias(c) for c in ("k", "new_lo", "new_hi")),
        )
        rank = F.col("k") - F.col("under")
        counted = counted.withColumn("k", F.when((rank >= 0) & (rank < F.col("n")), rank).otherwise(F.raise_error(F.lit("a cut was further off than its error"))))
        # Values that equal a cut are settled here, so that any number of equal values leaves the next pass less.
        low, high = F.col("k") < F.col("at_lo"), F.col("k") >= F.col("n") - F.col("at_hi")
        pick = lambda a, b, c: F.when(low, a).when(high, b).otherwise(c)
        state = counted.select("key", "which", pick(new_lo, new_hi, F.col("next_lo")).alias("lo"), pick(new_lo, new_hi, F.col("next_hi")).alias("hi"), (F.col("n") - F.col("at_lo") - F.col("at_hi")).alias("n"), (F.col("k") - F.col("at_lo")).alias("k"))
        state = stored(state, "ranks")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    medians = every.groupBy("key").agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    return groups.join(medians.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").select(F.col("key").alias(key), "median")
