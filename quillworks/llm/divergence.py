"""How the sources of a language differ in their words: every pair of sources, and the terms that each source favours."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Documents of a language that a term needs.
LEAST_DOCS = 30
#: Added to every count.
PRIOR = 5
#: Ranks of terms that are given.
TOP = 50
#: Blocks of sources in a tournament; one round less is played.
BLOCKS = 6
#: Entries of a block in memory: its sources times the terms of a slice.
ENTRIES = 1 << 16
#: Different (group, term) pairs that a task gathers before it gives them away.
GATHERED = 500_000

_BYTES = np.arange(256)
_LETTER = (_BYTES >= 128) | (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)
#: Bytes of a text to bytes of its terms: A-Z lowered, all ASCII but letters a space.
TERMS = bytes(np.where(_LETTER, np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES), 32).astype(np.uint8))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) to (lang, source, term, n, docs), gathered over many texts."""
    found: dict[tuple[str, str], list[Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some]), pa.array([docs[t] for t in some])], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            words = text.as_py().translate(TERMS).split()
            n, docs = found.setdefault((lang, source), [Counter(), Counter()])
            held -= len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n)
            if held > GATHERED:
                yield from out()
                found, held = {}, 0
    yield from out()


def shares(counts: np.ndarray, whole: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + PRIOR) / (whole + PRIOR * terms)), exact: three digits of the quotient at a time, so nothing overflows below 9 * 10^15."""
    over = np.int64(whole + PRIOR * terms)
    part, rest = np.divmod(counts.astype(np.int64) + PRIOR, over)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, over)
        part = part * 1000 + more
    return part + 1


def pack(ids: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """The sparse count vectors of a block's sources in one slice: steps of ascending ids, then counts, compressed."""
    lengths = np.asarray([len(x) for x in ids], "<u4")
    steps = np.concatenate([np.diff(x, prepend=0) for x in ids] or [[]]).astype("<u4")
    return zlib.compress(lengths.tobytes() + steps.tobytes() + np.concatenate([*counts, np.zeros(0, np.int64)]).astype("<i8").tobytes(), 1)


def unpack(packed: bytes, sources: int, size: int) -> np.ndarray:
    """Count of each source (rows) and term of the slice."""
    raw = zlib.decompress(packed)
    lengths = np.frombuffer(raw, "<u4", sources)
    n, out, at = int(lengths.sum()), np.zeros((sources, size), np.int64), 0
    steps, counts = np.frombuffer(raw, "<u4", n, 4 * sources), np.frombuffer(raw, "<i8", n, 4 * sources + 4 * n)
    for k, length in enumerate(lengths.tolist()):
        out[k, np.cumsum(steps[at : at + length])] = counts[at : at + length]
        at += length
    return out


BLOCK = "lang string, slice int, block int, size int, terms long, names array<string>, wholes array<long>, packed binary, tops array<struct<source:string,item:string,value:long>>"


def _block(rows: pa.Table) -> pa.Table:
    """One block of sources in one slice, from its rows (source, id, n, total, term and what holds for all): packed vectors, and a heap of TOP terms a source.

    A row without an id stands for a source, so that one without terms in the slice is there too.
    """
    rows = rows.sort_by([("source", "ascending"), ("id", "ascending")])
    one = {c: rows.column(c)[0].as_py() for c in ("lang", "slice", "block", "size", "terms", "lang_whole")}
    name, ids = np.asarray(rows.column("source").to_pylist(), object), rows.column("id").fill_null(-1).to_numpy()
    n, total, term, whole = rows.column("n").fill_null(0).to_numpy(), rows.column("total").fill_null(0).to_numpy(), rows.column("term"), rows.column("whole").to_numpy()
    edges = np.flatnonzero(np.append(True, name[1:] != name[:-1])).tolist() + [len(name)]
    vectors, counts, wholes, tops = [], [], [], []
    for a, b in zip(edges, edges[1:], strict=False):
        real = np.flatnonzero(ids[a:b] >= 0) + a
        vectors.append(ids[real])
        counts.append(n[real])
        wholes.append(int(whole[a]))
        if len(real):
            more = shares(n[real], int(whole[a]), one["terms"]) - shares(total[real], one["lang_whole"], one["terms"])
            at = np.flatnonzero(more > 0)
            if len(at) > TOP:  # all that tie with the last one stay for the heap to order
                at = at[more[at] >= np.partition(more[at], len(at) - TOP)[len(at) - TOP]]
            best = heapq.nsmallest(TOP, ((-int(more[k]), term[int(real[k])].as_py().encode()) for k in at))
            tops += [{"source": name[a], "item": t.decode(), "value": -v} for v, t in best]
    row = {"lang": one["lang"], "slice": one["slice"], "block": one["block"], "size": one["size"], "terms": one["terms"], "names": [name[a] for a in edges[:-1]], "wholes": wholes, "packed": pack(vectors, counts), "tops": tops}
    return pa.Table.from_pylist([row], _schema)


_schema = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("block", pa.int32()), ("size", pa.int32()), ("terms", pa.int64()), ("names", pa.list_(pa.string())), ("wholes", pa.list_(pa.int64())), ("packed", pa.binary()), ("tops", pa.list_(pa.struct([("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])))])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row is a meeting of a resident block with a visitor, or with itself if there is none: the distance of every pair, for both."""
    for batch in batches:
        for x in batch.to_pylist():
            guest = x["guest"]

            def side(names: list[str], wholes: list[int], packed: bytes, x=x) -> np.ndarray:
                found = unpack(packed, len(names), x["size"])
                return np.stack([shares(c, w, x["terms"]) for c, w in zip(found, wholes, strict=True)])

            here = side(x["names"], x["wholes"], x["packed"])
            there = side(guest["names"], guest["wholes"], guest["packed"]) if guest else here
            names = guest["names"] if guest else x["names"]
            source, item, value = [], [], []
            for k, name in enumerate(x["names"]):
                far = np.abs(there - here[k]).sum(axis=1).tolist()
                for other, v in zip(names, far, strict=True):
                    if guest or other != name:  # within a block every source comes to every other one
                        source.append(name)
                        item.append(other)
                        value.append(v)
                        if guest:
                            source.append(other)
                            item.append(name)
                            value.append(v)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x["lang"]] * len(source), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def tournament(blocks: int) -> list[list[tuple[int, int]]]:
    """Rounds of (host, guest) in which every two of ``blocks`` meet once: seats face each other, and all but the first move on by one a round."""
    seats, rounds = list(range(blocks + blocks % 2)), []
    for _ in range(len(seats) - 1):
        faced = [(a, b) for a, b in zip(seats, reversed(seats), strict=True) if a < b < blocks]
        rounds.append([(a, b) if (a + b) % 2 else (b, a) for a, b in faced])  # each travels about as often as it stays
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def source_divergence(docs: DataFrame, blocks: int = BLOCKS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from each other one of its language, and its TOP terms against the language.

    Terms are runs of letters and of characters beyond ASCII, A-Z lowered; a language keeps those in ``least_docs`` of its documents. A
    source's share of a term is 1 + floor(10^9 * (n + 5) / (N + 5 V)); part ``pair`` has the sum of the shares' differences over all V terms, part
    ``term`` the terms whose share is above the language's, with the difference, up to rank TOP. Integers throughout.

    Tasks count the terms of their texts and give away (group, term, n, documents). The terms of a language are dealt into slices and
    its sources into ``blocks``, so that a block in a slice has about ENTRIES entries whatever there is; each becomes one row of packed vectors in a
    bucketed table, its terms ranked in a heap. Then blocks meet as in a tournament: residents are read where they are, each guest's row
    goes to its host's bucket, and one meeting gives both directions. Sums over slices close it.

    Null text, language or source: empty. A source without terms is at the distance that its even shares give; a language without
    kept terms has distances of 0. Ties by UTF-8. Repeated rows count each. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "divergence"), partitions(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = scratch.write(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    terms = scratch.write(terms, "terms")
    # A row a language, a row a group: groups are every (lang, source) of the table, with terms or without.
    groups = scratch.write(texts.select("lang", "source").distinct(), "groups")
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    langs = groups.groupBy("lang").agg(F.max("sources").alias("sources")).join(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_whole")), "lang", "left")
    langs = langs.na.fill(0, ["terms", "lang_whole"])
    langs = scratch.write(langs.withColumn("slices", F.expr(f"cast(greatest(1, ceil(terms * ceil(sources / {blocks}.0) / {ENTRIES})) as int)")), "langs")
    # Terms get numbers within their slice, so a vector is short.
    terms = terms.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.expr("cast(pmod(xxhash64(term), slices) as int)"))
    terms = terms.withColumn("id", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).drop("slices")
    terms = scratch.write(terms, "numbered")
    sizes = terms.groupBy("lang", "slice").agg(F.count("*").cast("int").alias("size"))
    kept = scratch.write(counts.drop("docs").join(terms, ["lang", "term"]), "kept")
    wholes = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = groups.join(wholes, ["lang", "source"], "left").na.fill(0, ["whole"]).withColumn("block", F.expr(f"cast(place % {blocks} as int)"))
    groups = scratch.write(groups.join(langs.drop("sources"), "lang").drop("place", "sources"), "sources")
    rows = groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    rows = rows.join(sizes, ["lang", "slice"], "left").na.fill(0, ["size"]).select("lang", "source", "slice", "size", *(F.lit(None).cast(t).alias(c) for c, t in (("id", "int"), ("n", "long"), ("total", "long"), ("term", "string"))))
    rows = rows.unionByName(kept.join(sizes, ["lang", "slice"]).select("lang", "source", "slice", "size", "id", "n", "total", "term"))
    rows = rows.join(groups.drop("slices"), ["lang", "source"])
    made = rows.groupBy("lang", "slice", "block").applyInArrow(_block, BLOCK)
    residents = scratch.bucketed(made, "residents", ["lang", "slice", "block"], n)

    far = residents.select(*(F.col(c) for c in ("lang", "size", "terms", "names", "wholes", "packed")), F.lit(None).cast("struct<names:array<string>,wholes:array<long>,packed:binary>").alias("guest"))
    pairs = [scratch.write(far.mapInArrow(_meet, "lang string, source string, item string, value long"), "round0")]
    for k, meetings in enumerate(tournament(blocks), 1):
        host = F.create_map(*(F.lit(x) for a, b in meetings for x in (b, a)))
        guests = residents.select("lang", "slice", F.try_element_at(host, F.col("block")).alias("block"), F.struct("names", "wholes", "packed").alias("guest")).where("block is not null")
        met = residents.join(guests.hint("merge"), ["lang", "slice", "block"]).select("lang", "size", "terms", "names", "wholes", "packed", "guest")
        pairs.append(scratch.write(met.mapInArrow(_meet, "lang string, source string, item string, value long"), f"round{k}"))
    every = pairs[0]
    for x in pairs[1:]:
        every = every.unionByName(x)
    best = residents.select("lang", F.explode("tops").alias("t")).select("lang", "t.*")
    found = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
    return out.select("lang", "source", "part", "item", "value", "rank")
