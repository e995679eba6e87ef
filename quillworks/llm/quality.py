"""Text quality: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, crc_mod
from .toxicity import clear_labels

#: Groups of bytes whose shares describe a text; bytes of other kinds are the last group but one and two.
GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!?", "|", "#$%&*@^~", "'\"-:;()", "<>[]{}/\\=+_`")
KINDS = np.full(256, len(GROUPS))
for _i, _g in enumerate(GROUPS):
    KINDS[list(_g.encode())] = _i
KINDS[192:] = len(GROUPS) + 1  # leading bytes of other letters; those that follow are group len(GROUPS)
NAMES = [f"share{i}" for i in range(len(GROUPS) + 2)] + ["bytes", "words", "word_mean", "word_spread", "word_most", "different", "repeated", "lines", "line_repeats", "shouted"]
LINE = np.isin(np.arange(256), [10])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def statistics(t: textnum.Texts, lines: textnum.Texts) -> np.ndarray:
    """One row of NAMES for each text. No word: means and shares of words are 0."""
    n, size = len(t), np.diff(t.offsets)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * (len(GROUPS) + 2) + KINDS[t.data], minlength=n * (len(GROUPS) + 2)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    words, own = t.counts(), t.owners()
    some, length = np.maximum(words, 1), (t.ends - t.starts).astype(float)
    mean = np.bincount(own, weights=length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(own, weights=length**2, minlength=n) / some - mean**2, 0))
    most = np.zeros(n)
    np.maximum.at(most, own, length)
    hashes = t.hashes(lower=True)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])])[: len(own)]

    def different(x: textnum.Texts, h: np.ndarray) -> np.ndarray:
        of = x.owners()
        _, at = np.unique(textnum.mix(h ^ textnum.mix(of.astype(np.uint64))), return_index=True)
        return np.bincount(of[at], minlength=n)

    rows = lines.counts()
    shouted = np.bincount(own, weights=UPPER[t.data[t.ends - 1]] if len(own) else None, minlength=n) / some
    columns = [np.log1p(size), np.log1p(words), mean, spread, np.log1p(most), different(t, hashes) / some, np.bincount(own, weights=again, minlength=n) / some, np.log1p(rows), 1 - different(lines, lines.hashes()) / np.maximum(rows, 1), shouted]
    return np.concatenate([shares, np.stack(columns, axis=1)], axis=1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, t in textnum.texts(batch.column(1)):
            x = statistics(t, textnum.Texts(t.data, t.offsets, LINE)).astype(np.float32)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), flat], names=["id", "x"])


class Features:
    """cos(W z + b) * sqrt(2 / d) of standardised statistics z: inner products approach a Gaussian kernel of width sigma."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, count: int = 384, sigma: float | None = None, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), count)) / (sigma or np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float)


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on counts by ascending x: knots (middle of a pool, its share), joined by straight lines."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, n, ones, strict=True):
        pools.append([a * b, b, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    # A pool of one class is not certain: half a case of the other is added.
    return p[:, 0] / p[:, 1], (p[:, 2] + 0.5) / (p[:, 1] + 1)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = 200_000, ridge: float = 1.0, bins: int = 256) -> DataFrame:
    """Per input row: doc_id, held_out, score, predicted.

    ``docs`` has doc_id and text, ``labels`` has doc_id and quality. Rows whose crc32(doc_id as text) mod ``folds`` is
    ``held_out`` are never learnt from. Statistics are of whole texts; their means and spreads are over all documents.
    The classifier is fitted on about ``sample`` labelled rows at most, picked by id hash: four fifths for the normal
    equations, summed by partition, one fifth for the isotonic curve over ``bins`` bins of the ridge score.

    Null or empty text: all statistics 0, scored like any other. Null doc_id: scored, held_out null. Labels that are
    null or contradict each other: clear_labels. Without labels, or labels of one class, every score is the labelled
    share with one added to each class. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = scratch.write(docs.select("doc_id", "text").mapInArrow(_statistics, f"id {kind}, x array<float>"), "stats")
    moments = stats.agg(*(f(F.col("x")[i].cast("double")).alias(f"{name}{i}") for i in range(len(NAMES)) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    learnt = clear_labels(labels, "quality").where(crc_mod(F.col("id"), folds) != held_out)
    known = learnt.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if moments["m0"] is None or not 0 < known[1] < known[0]:
        score = F.lit((known[1] + 1) / (known[0] + 2))
        out = stats.withColumn("score", score)
        return _result(out, folds, held_out)
    features = Features(*(np.array([moments[f"{k}{i}"] for i in range(len(NAMES))]) for k in "ms"))
    share = min(1.0, sample / known[0])
    pick = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30))
    fitted = scratch.write(stats.join(learnt.where(pick < int(share * (1 << 30))), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(5))), "fitted")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = features(matrix(batch.column(0)))
            z = np.concatenate([z, batch.column(1).to_numpy()[:, None]], axis=1)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    # The sample is bounded, so a few partitions hold it and a few square matrices reach the driver.
    parts = fitted.where("part > 0").select("x", "y").coalesce(6).mapInArrow(sums, "sums binary").collect()
    d = features.w.shape[1] + 1
    total = sum((np.frombuffer(p["sums"]).reshape(d + 1, d + 1) for p in parts), np.zeros((d + 1, d + 1)))
    weights = np.linalg.solve(total[:d, :d] + ridge * np.eye(d), total[:d, d])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features(matrix(batch.column(1))) @ weights)], names=["id", "raw"])

    scored = stats.mapInArrow(raw, f"id {kind}, raw double")
    ends = (-0.5, 1.5)
    held = fitted.where("part = 0").select("id", "x").mapInArrow(raw, f"id {kind}, raw double").join(learnt, "id")
    told = held.groupBy(F.width_bucket("raw", F.lit(ends[0]), F.lit(ends[1]), F.lit(bins)).alias("bin")).agg(F.avg("raw"), F.count("*"), F.sum("y")).orderBy("bin").collect()  # bins + 2 rows at most
    if told:
        x, p = isotonic(*np.array([tuple(r)[1:] for r in told], float).T)
    else:
        x, p = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    x, p = [float(v) for v in x], [float(v) for v in p]
    v, curve = F.col("raw"), F.lit(p[0] if len(x) == 1 else p[-1])
    for a, b, f, g in reversed(list(zip(x, x[1:], p, p[1:], strict=False))):
        curve = F.when(v < b, f + (v - a) * ((g - f) / (b - a))).otherwise(curve)
    # A little of the raw score tells apart what the curve levels.
    tilt = 1 / (1 + F.exp(-v))
    score = 0.998 * F.when(v <= x[0], F.lit(p[0])).otherwise(curve) + 0.002 * tilt
    return _result(scored.withColumn("score", score), folds, held_out)


def _result(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
