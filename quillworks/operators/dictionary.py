"""A user's word list: upserts, suggestions by beginning, and repair of doubtful words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOUBTFUL = 0.7
#: The three tables that an engine keeps.
USER_WORDS = "id long, word string, frequency long, context string, domain string, created_at timestamp, last_used timestamp"
CORRECTIONS = "id long, original string, corrected string, confidence double, session_id string, created_at timestamp"
PERFORMANCE = "id long, session_id string, accuracy double, processing_time double, image_quality double, created_at timestamp"


def upsert(state: DataFrame | None, events: DataFrame) -> DataFrame:
    """(word, frequency, context, domain, created_at, last_used) after events (word, context, domain, ts, seq).

    Each event adds one to a word's frequency and replaces its row: the last event's context and domain hold, and created_at is its time.
    A union and one partial aggregate: a very common word combines before the shuffle.
    """
    last = lambda c: F.max(F.struct("last_used", "seq", c))[c].alias(c)
    rows = events.select("word", F.lit(1).cast("long").alias("frequency"), "context", "domain", F.col("ts").alias("created_at"), F.col("ts").alias("last_used"), "seq")
    if state is not None:
        rows = rows.unionByName(state.select("word", "frequency", "context", "domain", "created_at", "last_used", F.lit(-1).cast("long").alias("seq")))
    return rows.groupBy("word").agg(F.sum("frequency").alias("frequency"), last("context"), last("domain"), last("created_at"), F.max("last_used").alias("last_used"))


def suggestions(words: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Words with a beginning, any case, the most frequent and latest first. % and _ in it match as in LIKE."""
    return words.where(F.col("word").ilike(prefix + "%")).orderBy(F.desc("frequency"), F.desc("last_used"), "word").limit(limit)


def zipped(words: Column, scores: Column) -> Column:
    """Pairs (word, score), cut to the shorter of both."""
    n = F.least(F.size(words), F.size(scores))
    return F.arrays_zip(F.slice(words, 1, n).alias("word"), F.slice(scores, 1, n).alias("score"))


def candidates(words: DataFrame, limit: int = 5) -> DataFrame:
    """(prefix, place, word): for each beginning of three characters, the ``limit`` best words."""
    rows = words.where(F.length("word") >= 3).withColumn("prefix", F.lower(F.substring("word", 1, 3)))
    order = Window.partitionBy("prefix").orderBy(F.desc("frequency"), F.desc("last_used"), "word")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("prefix", "place", F.col("word").alias("candidate"))


def repaired(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, pos, word, score, out): doubtful words become [suggestion], or (word) without one; others stay.

    The words that a document brings count for later batches, not for its own later tokens: wordlist.repaired_in_order has them count at once. A token
    without a score is not doubtful.
    """
    sure = tokens.where(F.coalesce(F.col("score") >= DOUBTFUL, F.lit(True))).withColumn("out", F.col("word"))
    asked = tokens.where(F.col("score") < DOUBTFUL).withColumn("prefix", F.lower(F.substring("word", 1, 3)))
    best = F.min(F.struct(F.levenshtein("word", "candidate").alias("d"), "place", "candidate"))
    # Each different doubtful word is matched once.
    once = asked.select("word", "prefix").distinct().join(candidates(words), "prefix").groupBy("word").agg(best.alias("b")).select("word", "b.candidate")
    told = asked.join(once, "word", "left").withColumn("out", F.when(F.col("candidate").isNull(), F.concat(F.lit("("), "word", F.lit(")"))).otherwise(F.concat(F.lit("["), "candidate", F.lit("]"))))
    keep = ["doc_id", "pos", "word", "score", "out"]
    return sure.select(keep).unionByName(told.select(keep))


def record_corrections(log: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The correction log with new rows (original, corrected, confidence, session_id, created_at)."""
    return rows if log is None else log.unionByName(rows)


def corrected_words(words: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The word list after corrections (original, corrected, created_at, seq): each corrected word is one more sighting, with what it replaced as context."""
    context = F.concat(F.lit("교정됨: "), F.col("original"))
    return upsert(words, rows.select(F.col("corrected").alias("word"), context.alias("context"), F.lit("general").alias("domain"), F.col("created_at").alias("ts"), "seq"))
