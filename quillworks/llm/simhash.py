"""SimHash near-duplicates: fingerprints, an index of one-wildcard segment variants, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, id_filter, partitions, without

#: Bit ranges of a fingerprint. Three segments: of four differing bits, one segment has one at most.
SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: Fingerprints compared at once in a run of equal keys.
BLOCK = 1 << 22


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included; fewer words make one shingle, none make 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(shingle, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def _spanning(fps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Links that connect what is connected among different fingerprints: a search from one to the next, in blocks."""
    out, todo = [], fps
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            k = max(1, BLOCK // len(todo))
            some, front = front[:k], front[k:]
            near = np.bitwise_count(some[:, None] ^ todo[None, :]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                out.append(np.stack([some[near.argmax(axis=0)[hit]], todo[hit]], axis=1))
                front, todo = np.concatenate([front, todo[hit]]), todo[~hit]
    return out


def _links(bits: int, small: int = 8):
    """Rows (key, fp) sorted by both to links (a, b): each run of one key is verified, however many batches it spans."""

    def verified(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        runs, out = np.diff(bounds), []
        for k in range(1, small):  # short runs: each row with the k-th after it
            at = np.flatnonzero(keys[k:] == keys[:-k])
            at = at[np.repeat(runs <= small, runs)[at]]
            a, b = fps[at], fps[at + k]
            near = np.bitwise_count(a ^ b) <= bits
            out.append(np.stack([a[near], b[near]], axis=1))
        for j in np.flatnonzero(runs > small):
            out += _spanning(fps[bounds[j] : bounds[j + 1]], bits)
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(links):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, c]).view(np.int64)) for c in (0, 1)], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if whole or held and held[-1][0][-1] != keys[0]:
                held.append((keys[:whole], fps[:whole]))
                yield table(verified(*map(np.concatenate, zip(*held, strict=True))))
                held = []
            held.append((keys[whole:], fps[whole:]))
        if held:
            yield table(verified(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _contracted(links: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to stars around the smallest node, some hundred thousand at a time: fewer rows and shorter paths for what follows."""

    def stars(some: list[np.ndarray]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(some), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            while (label[label] != label).any():
                label = label[label]
        out = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[label[out]])], names=["a", "b"])

    held, n = [], 0
    for batch in links:
        if batch.num_rows:
            held.append(np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1))
            n += batch.num_rows
        if n >= rows:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def simhash_components(docs: DataFrame, bits: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, fp (long, the fingerprint's 64 bits) and component_id, the smallest id reachable over links.

    Two fingerprints link if ``bits`` (4 at most) or fewer bits differ. Equal fingerprints are one node, so a group of
    copies, however large, enters the index once. Each fingerprint gives 64 keys: its segment of 21 or 22 bits with one
    bit left out. Of four differing bits, one of three segments has one at most, so linked fingerprints share a key.
    Rows of equal keys meet, are verified against all 64 bits, and give links that connect them (no list of all pairs).

    Null or empty texts have fingerprint 0 and link like any other. A component whose ids are all null has a null id.
    Repeated rows give repeated results; an empty table gives none. Other columns are ignored.
    """
    if not 0 <= bits <= 4:
        raise ValueError("three segments find up to 4 differing bits")
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "simhash"), partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    marked = scratch.write(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), f"id {kind}, fp long"), "marked")
    nodes = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    keys = [
        F.lit(bit << 22).bitwiseOR(F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(((1 << b) - (1 << a)) & ~(1 << bit)))), a).cast("int"))
        for a, b in SEGMENTS
        for bit in range(a, b)
    ]
    index = nodes.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
    verified = _links(bits)
    links = index.mapInArrow(lambda batches: _contracted(verified(batches)), "a long, b long").distinct()
    roots = components(scratch, links)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "id")
    # Nodes, not rows, meet here: one for each different fingerprint. Both sides are written, so Spark can split a root with very many nodes.
    named = scratch.write(named, "rooted")
    least = scratch.write(named.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = scratch.write(named.join(least, "root").select("fp", "component_id"), "named")
    scratch.drop("nodes", "rooted", "least")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; of rows with that id, one. Columns as given.

    Of rows that share the id, the one with the least hash of its columns stays (map columns do not count). Rows with a null id
    stay: nothing names them. Null and empty texts have fingerprint 0: one document stands for all within four bits of it.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.write(simhash_components(docs, **options), "found")
    gone = scratch.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    twice = scratch.write(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"), "twice")
    kept = without(docs, "doc_id", gone)
    if twice.isEmpty():
        return kept
    other, place = fresh(docs, "_id", "_place")
    same = id_filter(kept, "doc_id", twice).join(twice.select(F.col("id").alias(other)), F.col("doc_id") == F.col(other), "left_semi")
    told = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*told))
    one = same.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return without(kept, "doc_id", twice).unionByName(one)
