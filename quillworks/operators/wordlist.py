"""A word list as many readers ask it: suggestions for a table of beginnings, and doubtful words repaired by the list as it stood at each of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import DOUBTFUL
from .stored import numbered, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Events of one pattern that a task takes through at a time.
SLICE = 20_000
#: Characters of a plain run that words are met by.
GRAM = 3
KEYS = "array<struct<head:boolean,key:string>>"


def folded(word: Column) -> Column:
    """A-Z lowered, as LIKE compares."""
    return F.translate(word, UPPER, LOWER)


def _grams(word: Column, n: int) -> Column:
    """All stretches of n characters of a word, as keys."""
    one = lambda i: F.struct(F.lit(False).alias("head"), F.substring(word, i, F.lit(n)).alias("key"))
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), one)).otherwise(F.array().cast(KEYS))


def like_matches(words: DataFrame, patterns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(pattern, word) and the columns in ``keep``: every different ``words.word`` that is LIKE ``patterns.pattern`` and anything after; % and _ match as in LIKE, A-Z in any case.

    Plain patterns meet words by equal beginnings, of those lengths alone that patterns have. One with a wildcard meets words by what it has before
    it, else by the start of its first plain run anywhere in a word, and is then compared. Only a pattern without plain characters meets all words.
    Null words and patterns match nothing. With ``keep``, words have to be different already.
    """
    wild = F.regexp_extract("p", "^[^%_]*", 0)
    some, last = F.regexp_extract("p", f"[^%_]{{1,{GRAM}}}", 0), F.regexp_extract("p", "([^%_]*)[%_]*$", 1)
    asked = patterns.where("pattern is not null").select("pattern", folded(F.col("pattern")).alias("p")).distinct()
    kind = F.when(F.col("p") == wild, "plain").when(wild != "", "head").when(some != "", "has").otherwise("any")
    asked = asked.withColumn("kind", kind).withColumn("key", F.when(F.col("kind").isin("plain", "head"), wild).when(F.col("kind") == "has", some).otherwise("")).withColumn("last", last)
    asked = stored(asked, "patterns")
    # Lengths of what patterns begin with: not more than the longest pattern has.
    told = asked.groupBy(F.col("kind").isin("plain", "head").alias("heads")).agg(F.collect_set(F.length("key")).alias("lengths"), F.collect_set("kind").alias("kinds")).collect()
    lengths = sorted({n for r in told if r["heads"] for n in r["lengths"]})
    kinds = {k for r in told for k in r["kinds"]}
    words = words.where("word is not null").select("word", *keep)
    words = (words if keep else words.distinct()).withColumn("w", folded(F.col("word")))
    keys = []
    if lengths:
        heads = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("w"))
        keys.append(F.transform(heads, lambda n: F.struct(F.lit(True).alias("head"), F.substring(F.col("w"), F.lit(1), n).alias("key"))))
    for n in sorted({n for r in told if not r["heads"] for n in r["lengths"]} - {0}):
        keys.append(_grams(F.col("w"), n))
    if "any" in kinds:
        keys.append(F.array(F.struct(F.lit(False).alias("head"), F.lit("").alias("key"))))
    none = F.array().cast(KEYS)
    keyed = words.select("word", "w", *keep, F.explode(F.array_distinct(F.concat(*keys) if keys else none)).alias("k")).select("word", "w", *keep, "k.head", "k.key")
    asked = asked.withColumn("head", F.col("kind").isin("plain", "head"))
    met = keyed.join(asked, ["head", "key"])
    exact = F.like(F.col("w"), F.concat(F.replace(F.col("p"), F.lit("\\"), F.lit("\\\\")), F.lit("%")))
    return met.where((F.col("kind") == "plain") | F.contains("w", "last") & exact).select("pattern", "word", *keep)


def suggest_many(words: DataFrame, patterns: DataFrame, limit: int = 5) -> DataFrame:
    """(pattern, place, word, frequency): for each different pattern the ``limit`` best of ``words`` (word, frequency, last_used), a row a word: most frequent, latest, then by word.

    Each task cuts its rows to ``limit`` a pattern before they are shuffled, so a beginning that very many words share stays small. A pattern without words has no row.
    """
    found = like_matches(words, patterns, ("frequency", "last_used"))
    order = Window.partitionBy("pattern").orderBy(F.desc("frequency"), F.desc_nulls_last("last_used"), "word")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("pattern", "place", "word", "frequency")


def _better(x: tuple) -> tuple:
    word, frequency, used = x
    return -frequency, -used, word.encode()


def _opening(limit: int):
    """Rows sorted by (pattern, slice, what) to the best words at each slice's start; a row without a word asks, others tell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, {}
        for batch in batches:
            out = []
            for pattern, part, word, frequency, used in zip(batch["pattern"], batch["slice"], batch["word"], batch["frequency"], batch["used"], strict=True):
                if pattern != now:
                    now, best = pattern, {}
                if word is None:
                    out.append((pattern, part, [{"word": w, "frequency": f, "used": u} for w, f, u in best.values()]))
                else:
                    best[word] = (word, int(frequency), int(used))
                    if len(best) > limit:
                        best = {x[0]: x for x in sorted(best.values(), key=_better)[:limit]}
            yield pd.DataFrame(out, columns=["pattern", "slice", "best"])

    return run


def _through(limit: int):
    """One slice of a pattern in order: words that are seen rise, words that ask get the best of that moment."""

    def run(events: pa.Table, opening: pa.Table) -> pa.Table:
        best = [(x["word"], x["frequency"], x["used"]) for x in (opening.column("best")[0].as_py() if len(opening) else [])]
        best.sort(key=_better)
        seen: dict[str, int] = {}
        events, found = events.sort_by("n"), []
        for word, asks, n, before in zip(*(events.column(c).to_pylist() for c in ("word", "asks", "n", "before")), strict=True):
            if asks:
                found.append([x[0] for x in best])
            else:
                seen[word] = seen.get(word, before) + 1
                best = sorted([x for x in best if x[0] != word] + [(word, seen[word], n)], key=_better)[:limit]
        asked = events.filter(events.column("asks")).select(["doc_id", "pos", "word", "score"])
        return asked.append_column("found", pa.array(found, pa.list_(pa.string())))

    return run


def repaired_in_order(tokens: DataFrame, words: DataFrame, limit: int = 5, slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, pos, word, score, out): tokens in the order of (doc_id, pos), each seeing the word list as those before it left it.

    A sure token (score of DOUBTFUL or more) stays and is one more sighting of its word. A doubtful one asks for the ``limit`` best words that are LIKE its first
    three characters at that moment - most frequent, latest seen, by word - and becomes [the nearest by edits] or, without any, (itself).
    ``words`` (word, frequency, last_used) is the list before the first token.

    Only beginnings that are asked for are followed. Each one's events are numbered and cut into slices. A word that is not seen in a slice only falls
    behind, so what a slice needs is the best words at its start and the counts of the words seen in it: both come from one row a slice and
    word. Tasks then go through slices, whatever share of the events a beginning or a word has.

    A null score is neither sure nor doubtful: the token stays and is not counted. A null word stays null. Tokens that share (doc_id, pos) come in some order. No tokens: no rows.
    """
    tokens = stored(tokens.select("doc_id", "pos", "word", "score", F.substring("word", 1, 3).alias("pattern")), "tokens")
    kinds = {c: tokens.schema[c].dataType.simpleString() for c in ("doc_id", "pos", "score")}
    doubt = tokens.where((F.col("score") < DOUBTFUL) & F.col("word").isNotNull())
    sure = tokens.where((F.col("score") >= DOUBTFUL) & F.col("word").isNotNull())
    match = stored(like_matches(sure.select("word").unionByName(words.select("word")), doubt.select("pattern")), "matches")
    none = F.lit(None).cast("string")
    events = sure.drop("pattern").join(match, "word").select("pattern", "doc_id", "pos", "word", "score", F.lit(False).alias("asks"))
    events = events.unionByName(doubt.select("pattern", "doc_id", "pos", "word", "score", F.lit(True).alias("asks")))
    events = stored(numbered(events, ["pattern"], ["doc_id", "pos"]).withColumn("slice", F.expr(f"n div {int(slice_rows)}")), "events")

    # What the list has before the first token: older than anything that is seen.
    old = F.coalesce(F.unix_micros(F.col("last_used").cast("timestamp")), F.lit(-(1 << 61))) - F.lit(1 << 62)
    start = words.join(match, "word").select("pattern", "word", F.col("frequency").cast("long").alias("frequency"), old.alias("used"))
    start = stored(start.groupBy("pattern", "word").agg(F.max("frequency").alias("frequency"), F.max("used").alias("used")), "start")
    seen = events.where("not asks").groupBy("pattern", "slice", "word").agg(F.count("*").alias("k"), F.max("n").alias("used"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("pattern", "word").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("ahead", before).join(start.select("pattern", "word", F.col("frequency").alias("first")), ["pattern", "word"], "left")
    seen = stored(seen.select("pattern", "slice", "word", "used", "k", (F.col("ahead") + F.coalesce("first", F.lit(0))).alias("before")), "seen")

    told = seen.select("pattern", "slice", "word", (F.col("before") + F.col("k")).alias("frequency"), "used").unionByName(start.select("pattern", F.lit(-1).cast("long").alias("slice"), "word", "frequency", "used"))
    order = Window.partitionBy("pattern", "slice").orderBy(F.desc("frequency"), F.desc("used"), "word")
    told = told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")
    asking = events.select("pattern", "slice").distinct().select("pattern", "slice", none.alias("word"), F.lit(0).cast("long").alias("frequency"), F.lit(0).cast("long").alias("used"))
    stream = told.unionByName(asking).repartition("pattern").sortWithinPartitions("pattern", "slice", F.col("word").isNotNull())
    opening = stream.mapInPandas(_opening(limit), "pattern string, slice long, best array<struct<word:string,frequency:long,used:long>>")
    opening = stored(opening, "opening")

    counted = events.join(seen.select("pattern", "slice", "word", "before"), ["pattern", "slice", "word"], "left").na.fill(0, ["before"])
    schema = f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, word string, score {kinds['score']}, found array<string>"
    asked = counted.groupBy("pattern", "slice").cogroup(opening.groupBy("pattern", "slice")).applyInArrow(_through(limit), schema)
    near = F.array_min(F.transform("found", lambda w, i: F.struct(F.levenshtein(F.col("word"), w).alias("d"), i.alias("place"), w.alias("word"))))["word"]
    asked = asked.withColumn("out", F.coalesce(F.concat(F.lit("["), near, F.lit("]")), F.concat(F.lit("("), "word", F.lit(")"))))
    rest = tokens.where(F.col("word").isNull() | F.col("score").isNull() | (F.col("score") >= DOUBTFUL)).withColumn("out", F.col("word"))
    keep = ["doc_id", "pos", "word", "score", "out"]
    return rest.select(keep).unionByName(asked.select(keep))
