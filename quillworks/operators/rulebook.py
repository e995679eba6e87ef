"""Replacements that come as rows: each owner's own rules, in their order, over that owner's texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import FLAGS

KINDS = ("plain", "regex")


def rulebooks(rules: DataFrame) -> DataFrame:
    """(owner, rules): one array an owner of ``rules`` (owner, seq, kind, pattern, replacement), in the order of seq.

    A pattern that comes again keeps its first place and takes the newest replacement. Rules without a pattern go; without a replacement, what they find goes.
    Other kinds than plain and regex are an error. In replacements of a regex \\1 is a group and $ a dollar. An owner's rules have to fit a row.
    """
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of rule: "), F.coalesce("kind", F.lit("null")))))
    rules = rules.where(F.col("pattern") != "").withColumn("kind", known)
    newest = F.max(F.struct("seq", F.coalesce("replacement", F.lit("")).alias("put")))["put"]
    once = rules.groupBy("owner", "kind", "pattern").agg(F.min("seq").alias("place"), newest.alias("put"))
    regex = F.col("kind") == "regex"
    put = F.regexp_replace(F.replace("put", F.lit("$"), F.lit("\\$")), r"\\(\d)", r"\$$1")
    once = once.select("owner", F.struct("place", "kind", "pattern", F.when(regex, F.concat(F.lit(FLAGS), "pattern")).otherwise(F.col("pattern")).alias("found"), F.when(regex, put).otherwise(F.col("put")).alias("put")).alias("r"))
    return once.groupBy("owner").agg(F.sort_array(F.collect_list("r")).alias("rules"))


def fold(text: Column, rules: Column) -> Column:
    """The text after all rules of an array, each on what those before it left."""
    one = lambda t, r: F.when(r["kind"] == "plain", F.replace(t, r["found"], r["put"])).otherwise(F.regexp_replace(t, r["found"], r["put"]))
    return F.aggregate(rules, text, one)


def apply_rows(texts: DataFrame, rules: DataFrame, owner: str = "owner", column: str = "text") -> DataFrame:
    """``texts`` with ``column`` rewritten by its owner's rules; texts whose owner has none stay.

    A null owner is an owner. One row an owner meets the texts, so an owner with most of all texts is split like any skewed join's key, and small rule
    tables go to every task without a shuffle of texts, as Spark decides by their size. A null text stays null. No rules: all texts as they are.
    """
    books = rulebooks(rules).select(F.col("owner").alias("_owner"), F.col("rules").alias("_rules"))
    met = texts.join(books, F.col(owner).eqNullSafe(F.col("_owner")), "left")
    out = F.when(F.col("_rules").isNull(), F.col(column)).otherwise(fold(F.col(column), F.col("_rules")))
    return met.withColumn(column, out).drop("_owner", "_rules")
