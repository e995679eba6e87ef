"""Repeated passages: a log-structured index of window fingerprints, merge-joined with each new batch and verified."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import textnum
from .common import Scratch, delete, id_filter, partitions, without

#: Words of a window, and of the shorter runs among which a window's least hash is its fingerprint.
WINDOW, RUN = 50, 10
RUN_BASE = 0xD1342543DE82EF95


def fingerprints(t: textnum.Texts, hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of each window within a text. Equal windows have equal fingerprints, wherever they stand."""
    run = min(RUN, window)
    n, wide = len(hashes), window - run + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - run + 1)
    least, step = textnum.spans(hashes, at, at + run, RUN_BASE), 1
    while step * 2 <= wide:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    if wide > step:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    own, start = t.owners(), np.arange(n - window + 1)
    start = start[own[start] == own[start + window - 1]]
    return start, least[start]


def lines_of(t: textnum.Texts) -> Iterator[bytes]:
    """Each text's words with one space between."""
    data = t.data.tobytes()
    return (b" ".join(data[a:b].split()) for a, b in zip(t.offsets, t.offsets[1:], strict=False))


def _scan(window: int):
    """(id, text, text_key) to (id, text_key, n_words, sha256 of the words, fingerprints, text where it has a window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, t in textnum.texts(batch.column(1)):
                start, least = fingerprints(t, t.hashes(), window)
                own, counts = t.owners()[start], t.counts()
                _, at = np.unique(textnum.mix(least ^ textnum.mix(own.astype(np.uint64))), return_index=True)
                at = at[np.argsort(own[at], kind="stable")]
                bounds = np.searchsorted(own[at], np.arange(len(t) + 1)).astype(np.int32)
                mine = [c.slice(rows.start, len(t)) for c in (batch.column(0), batch.column(2), batch.column(1))]
                text = mine[2].take(pa.array(np.arange(len(t)), mask=counts < window))
                yield pa.RecordBatch.from_arrays(
                    [*mine[:2], pa.array(counts.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in lines_of(t)]), pa.ListArray.from_arrays(bounds, pa.array(least[at].view(np.int64))), text],
                    names=["id", "text_key", "n_words", "words_sha", "prints", "text"],
                )

    return run


def _windows(window: int):
    """(id, text_key, mine, text, shared) to a row (d1, d2, id, text_key, mine, start) for each window with a shared fingerprint.

    d1 and d2 are 128 bits of the SHA-256 of the window's words themselves, so windows that agree in them are the same words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset, shared = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(np.uint64)
            for rows, t in textnum.texts(batch.column(3)):
                start, least = fingerprints(t, t.hashes(), window)
                own = t.owners()[start]
                known = np.sort(textnum.mix(shared[offset[rows.start] : offset[rows.stop]] ^ textnum.mix(np.repeat(np.arange(len(t)), np.diff(offset[rows.start : rows.stop + 1])).astype(np.uint64))))
                if not len(known):
                    continue
                asked = textnum.mix(least ^ textnum.mix(own.astype(np.uint64)))
                hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
                start, own = start[hit], own[hit]
                line = b" ".join(lines_of(t))
                # Where a word starts in the line: words have one byte between them, within a text as from text to text that has words.
                size = t.ends - t.starts + 1
                ends = np.cumsum(size)
                extra = np.concatenate([[0], np.cumsum(t.counts() == 0)])[t.owners()]  # an empty text leaves a space too
                first, last = (ends - size + extra)[start], (ends - 1 + extra)[start + window - 1]
                digest = np.frombuffer(b"".join(hashlib.sha256(line[a:b]).digest()[:16] for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.int64).reshape(-1, 2)
                rest = pa.array(own + rows.start)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.ascontiguousarray(digest[:, c])) for c in (0, 1)), *(batch.column(c).take(rest) for c in (0, 1, 2)), pa.array((start - t.bounds[own]).astype(np.int32))],
                    names=["d1", "d2", "id", "text_key", "mine", "start"],
                )

    return run


def _kept(window: int):
    """(id, text_key, text, starts) to (id, text_key, n_removed, kept_sha, kept) without the words of windows at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                edge, at = np.zeros(len(words) + 1, np.int64), starts.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([x.decode("utf-8", "replace") for x in texts])], names=["id", "text_key", "n_removed", "kept_sha", "kept"])

    return run


class SubstringIndex:
    """A folder of immutable runs. Each is sorted and bucketed by hash, so a batch meets it by a merge join without a shuffle of the run.

    A run of prints has, for each fingerprint, the least and greatest document id that has it; a run of texts has the least
    and greatest id of each whole sequence of words. Beside them lie the texts of each batch. add() answers a batch against all runs and itself, then
    appends its own; two runs of one level are merged into one of the next, so a row is rewritten as often as the
    number of batches has binary digits. A manifest, written last, names what belongs to the index: an index that is opened on
    its folder again goes on where the last whole batch ended.
    """

    KEYS = {"h": "long", "words_sha": "string"}

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, buckets: int | None = None):
        self.spark, self.own = spark, folder is None
        self.scratch, self.tag = Scratch(spark, "substrings"), f"substrings_{uuid.uuid4().hex}"
        if folder is not None:
            self.scratch.root = folder.rstrip("/")
        # As many buckets as shuffle partitions: each task then writes one bucket.
        self.window, self.buckets, self.kind = window, buckets or partitions(spark), None
        self.runs: dict[str, list[tuple[str, int]]] = {key: [] for key in self.KEYS}
        self.batches: list[str] = []
        self.made, self.merged = 0, 0
        if found := self._manifest():
            told = json.loads(found)
            if told["window"] != window:
                raise ValueError(f"this index has windows of {told['window']} words")
            self.buckets, self.kind, self.batches, self.made = told["buckets"], told["kind"], told["batches"], told["made"]
            for key, runs in told["runs"].items():
                for name, level in runs:
                    ids = f"{key} {self.KEYS[key]}, lo {self.kind}, hi {self.kind}"
                    spark.sql(f"CREATE TABLE {self._table(name)} ({ids}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.scratch.path(name)}'")
                    self.runs[key].append((name, level))

    def _manifest(self, text: str | None = None) -> str | None:
        """The manifest as it is; with ``text``, it is replaced."""
        jvm = self.spark._jvm
        path, new = (jvm.org.apache.hadoop.fs.Path(self.scratch.path(f"manifest.{x}")) for x in ("json", "new"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if text is not None:
            out = fs.create(new, True)
            out.write(bytearray(text.encode()))
            out.close()
            fs.delete(path, False)
            fs.rename(new, path)
            return text
        found = next((p for p in (path, new) if fs.exists(p)), None)
        return None if found is None else "\n".join(r[0] for r in self.spark.read.text(found.toString()).collect())

    def _table(self, name: str) -> str:
        return f"{self.tag}_{name}"

    def _run(self, rows: DataFrame, key: str, level: int = 0) -> DataFrame:
        self.made += 1
        name = f"run{self.made}"
        rows.repartition(self.buckets, key).sortWithinPartitions(key).write.mode("overwrite").bucketBy(self.buckets, key).sortBy(key).option("path", self.scratch.path(name)).saveAsTable(self._table(name))
        self.runs[key].append((name, level))
        return self.spark.table(self._table(name))

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")

    def _compact(self, key: str) -> list[str]:
        """Merges the last two runs while they are of one level. The names of those merged, which may go once the manifest is written."""
        gone = []
        while len(self.runs[key]) > 1 and self.runs[key][-1][1] == self.runs[key][-2][1]:
            old, level = [name for name, _ in self.runs[key][-2:]], self.runs[key][-1][1]
            both = reduce(DataFrame.unionByName, (self.spark.table(self._table(name)) for name in old))
            del self.runs[key][-2:]
            self._run(both.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), key, level + 1)
            self.merged += 1
            gone += old
        return gone

    def close(self) -> None:
        """Forgets the tables; a folder of its own goes too."""
        self._drop([name for runs in self.runs.values() for name, _ in runs])
        if self.own:
            delete(self.spark, self.scratch.root)

    def __enter__(self) -> SubstringIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def add(self, batch: DataFrame, out: Scratch) -> DataFrame:
        """Per row of ``batch`` (id, text): id, n_words, n_removed, kept_sha256 and kept (null where it is the whole text), written to ``out``.

        Ids should ascend from batch to batch: rows that were answered are not judged again.
        """
        scratch, name = self.scratch, f"batch{len(self.batches)}"
        kind = self.kind = self.kind or batch.schema["id"].dataType.simpleString()
        keys = ["id", "text_key"]
        pair = F.struct(*keys)
        scan = scratch.write(batch.select("id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(_scan(self.window), f"id {kind}, text_key long, n_words long, words_sha string, prints array<long>, text string"), f"{name}-scan")
        long = scan.where((F.col("n_words") >= self.window) & F.col("id").isNotNull())

        # Whole texts first: a later copy goes as a whole, and its windows are those of the first.
        older = [self.spark.table(self._table(n)) for n, _ in self.runs["words_sha"]]
        first = self._run(long.groupBy("words_sha").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "words_sha")
        for run in older:
            met = run.select(F.col("words_sha").alias("_sha"), F.col("lo").alias("_lo"))
            first = first.join(met, first["words_sha"] == met["_sha"], "left").select("words_sha", F.least("lo", "_lo").alias("lo"), "hi")
        # Written, as all that is joined below: both sides then have a shuffle of their own, and Spark splits keys that very many documents share.
        again = scratch.write(first.where("lo < hi").select("words_sha", "lo"), f"{name}-again")
        met = id_filter(long.select(*keys, "words_sha"), "words_sha", again.select(F.col("words_sha").alias("id")))
        copies = scratch.write(met.join(again, "words_sha").where("id > lo").select(*keys).distinct(), f"{name}-copies")
        alone = without(long.select(pair.alias("pair"), "prints"), "pair", copies.select(pair.alias("id")))
        alone = scratch.write(alone.select("pair.*", "prints"), f"{name}-prints")

        older = [self.spark.table(self._table(n)) for n, _ in self.runs["h"]]
        prints = self._run(alone.select("id", F.explode("prints").alias("h")).groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "h")
        met = [prints.where("lo < hi").select("h")]
        for run in older:
            old = run.select(F.col("h").alias("_h"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
            met.append(prints.join(old, prints["h"] == old["_h"]).where("least(lo, _lo) < greatest(hi, _hi)").select("h"))
        shared = scratch.write(reduce(DataFrame.union, met).distinct(), f"{name}-shared")

        # Of all batches, only fingerprints that this one shares, and the texts that have them, leave their place.
        self.batches.append(name)
        table = lambda b, what: self.spark.read.parquet(scratch.path(f"{b}-{what}")).withColumn("mine", F.lit(b == name))
        every = reduce(DataFrame.unionByName, (table(b, "prints") for b in self.batches)).select(*keys, "mine", F.explode("prints").alias("h"))
        holders = id_filter(every, "h", shared.select(F.col("h").alias("id"))).join(shared, "h").groupBy(*keys, "mine").agg(F.collect_set("h").alias("shared"))
        holders = scratch.write(holders, f"{name}-holders")
        texts = reduce(DataFrame.unionByName, (table(b, "scan") for b in self.batches)).where("id is not null and text is not null").select(*keys, "mine", "text")
        words = id_filter(texts, "id", holders.select("id")).join(holders, [*keys, "mine"]).select(*keys, "mine", "text", "shared")
        windows = scratch.write(words.mapInArrow(_windows(self.window), f"d1 long, d2 long, id {kind}, text_key long, mine boolean, start int"), f"{name}-windows")
        twice = scratch.write(windows.groupBy("d1", "d2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("d1", "d2", "lo"), f"{name}-twice")
        found = windows.where("mine").join(twice, ["d1", "d2"]).where("id > lo").groupBy(*keys).agg(F.collect_set("start").alias("starts"))
        found = scratch.write(found, f"{name}-found")
        cut = id_filter(scan.select(*keys, "text"), "id", found.select("id")).dropDuplicates(keys).join(found, keys).select(*keys, "text", "starts")
        cut = scratch.write(cut.mapInArrow(_kept(self.window), f"id {kind}, text_key long, n_removed long, kept_sha string, kept string"), f"{name}-cut")

        nothing = hashlib.sha256(b"").hexdigest()
        copies = copies.withColumn("copy", F.lit(True))
        rows = scan.select(*keys, "n_words", "words_sha").join(cut, keys, "left").join(copies, keys, "left")
        rows = rows.select(
            "id",
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha", "words_sha")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
        )
        rows = out.write(rows, name)
        scratch.drop(*(f"{name}-{x}" for x in ("again", "copies", "shared", "holders", "windows", "twice", "found", "cut")))

        gone = [x for key in self.runs for x in self._compact(key)]
        self._manifest(json.dumps({"window": self.window, "buckets": self.buckets, "kind": kind, "batches": self.batches, "made": self.made, "runs": self.runs}))
        self._drop(gone)
        scratch.drop(*gone)
        return rows


def dedup_substrings(docs: DataFrame, window: int = WINDOW, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256, kept (null where nothing goes).

    A word goes if a window of ``window`` words of its document covers it whose words also start in a document with a
    smaller id. Windows are judged on the texts as given. The table goes through the index in ``batches`` of ascending
    ids, as it would arrive; with three or more, a batch meets a merged run. A window's fingerprint is the least hash among its runs of ten words; windows with a fingerprint
    that another document has are compared by 128 bits of the SHA-256 of their words. Later copies of a whole text go as a whole, so
    a group of copies has its windows compared once.

    Null or empty text, or fewer words than a window: nothing goes. Null id: nothing goes and it makes nothing go.
    Rows that share an id do not make each other's words go. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    answers, out = Scratch(docs.sparkSession, "answers"), []
    if batches > 1 and isinstance(rows.schema["id"].dataType, NumericType):
        cuts = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0]
    else:  # ids without a middle between two: the last one of each range
        ranges = rows.where("id is not null").select("id").repartitionByRange(batches, "id").groupBy(F.spark_partition_id()).agg(F.max("id").alias("id"))
        cuts = sorted(r["id"] for r in ranges.collect())[: batches - 1]
    cuts = sorted(set(cuts or []))
    with SubstringIndex(docs.sparkSession, window=window) as index:
        for k in range(len(cuts) + 1):
            over = F.col("id") > cuts[k - 1] if k else F.lit(True)
            upto = F.col("id") <= cuts[k] if k < len(cuts) else F.lit(True)
            # Null ids come with the last batch.
            out.append(index.add(rows.where((over & upto) | F.col("id").isNull() if k == len(cuts) else over & upto), answers))
    return reduce(DataFrame.unionByName, out).withColumnRenamed("id", id_col)
