"""Toxicity by two class-conditional Kneser-Ney models of whole words that share what they back off to."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, crc_mod, id_filter, partitions, without

#: What follows the last byte of a word.
END = np.uint64(257)
#: Bits of the tables that tell which nodes may be in a model.
GATE = 22


def nodes_of(t: textnum.Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, word) of all beginnings of some words, one byte longer each, the last with END: the word itself. A-Z count as a-z."""
    size = t.ends[words] - t.starts[words] + 1
    last = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(last[-1] if len(last) else 0) - np.repeat(last - size, size)
    values = np.append(textnum.LOWER[t.data], 0).astype(np.uint64)[t.starts[words][word] + place] + np.uint64(1)
    values[last - 1] = END
    at = np.arange(len(values))
    return textnum.spans(values, at - place, at + 1), word


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to different (word, context): a word after a word, in class 0 (even contexts) or class 1 (odd ones)."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for rows, t in textnum.texts(batch.column(0), textnum.LETTERS, 2 * textnum.CHUNK):
            key = t.hashes(lower=True)
            before = np.concatenate([np.ones(1, np.uint64), key[:-1]])[: len(key)]
            starts = t.bounds[:-1]
            before[starts[starts < len(key)]] = 1  # a text's first word
            context = textnum.mix(before) >> np.uint64(33) << np.uint64(1) | toxic[rows][t.owners()].astype(np.uint64)
            _, at = np.unique(textnum.mix(key ^ textnum.mix(context)), return_index=True)
            at = at[np.argsort(key[at], kind="stable")]  # rows of one word after another compress well
            size = t.ends[at] - t.starts[at]
            ends = np.concatenate([[0], np.cumsum(size)])
            data = textnum.LOWER[t.data][np.arange(ends[-1]) + np.repeat(t.starts[at] - ends[:-1], size)]
            words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([words, pa.array(context[at].view(np.int64))], names=["word", "context"])


def _beginnings(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(word, o, t) to (parent, node, o, t) for each beginning of the words, summed by node over some hundred thousand words at a time."""

    def summed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = pa.Table.from_batches(parts).combine_chunks()
        counts = [some.column(c).to_numpy() for c in (1, 2)]
        for at, t in textnum.texts(some.column(0).chunk(0), np.zeros(256, bool)):  # a row is one word
            node, word = nodes_of(t, np.arange(len(t)))
            parent = np.concatenate([[0], node[:-1]]).astype(np.uint64)
            parent[np.concatenate([[True], word[1:] != word[:-1]])[: len(parent)]] = 0
            node, first, back = np.unique(node, return_index=True, return_inverse=True)
            sums = [np.bincount(back, weights=c[at][word], minlength=len(node)).astype(np.int64) for c in counts]
            order = np.argsort(parent[first], kind="stable")  # compresses well
            yield pa.RecordBatch.from_arrays([*(pa.array(x[order].view(np.int64)) for x in (parent[first], node)), *(pa.array(x[order]) for x in sums)], names=["parent", "node", "o", "t"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield from summed(held)
            held, n = [], 0
    if held:
        yield from summed(held)


def clear_labels(labels: DataFrame, name: str) -> DataFrame:
    """(id, y): one row an id, by majority, ties to 1. Null ids and labels go."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.avg(name) >= 0.5).cast("int").alias("y"))


def count_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, o, t): in how many different contexts each word stands, by class, over all labelled documents.

    Contexts, not occurrences, as Kneser and Ney count: a line repeated a thousand times, or a document with many copies, counts once.
    """
    some = id_filter(docs, "id", labels.select("id"))
    pairs = some.select("id", "text").join(labels, "id").select("text", "y").mapInArrow(_contexts, "word string, context long")
    # A word's contexts go to sixteen places: few rows of a word are left to add up, and no word gathers in one task.
    pairs = pairs.withColumn("part", F.shiftright("context", 1).bitwiseAND(15)).repartition(partitions(docs.sparkSession), "word", "part").distinct()
    toxic = F.col("context").bitwiseAND(1)
    return pairs.groupBy("word").agg(F.sum(1 - toxic).alias("o"), F.sum(toxic).alias("t"))


def log_ratios(words: DataFrame, discount: float = 0.75, weight: float = 5.0, least: int = 3) -> DataFrame:
    """(node, n, ratio): of the beginnings of words, the log ratio of their toxic to their ordinary probability after their parent.

    A beginning (a node) is one byte longer than its parent; a word is a chain of nodes that ends with its end. With n
    a node's count in a class, N its parent's and T the parent's different continuations in the class, the class gives it
        (max(n - D, 0) + (D * T + W) * q) / (N + W)
    where q, the node's share of its parent, comes from both classes' counts together: rare expressions back off to what the classes
    share. A node seen fewer than ``least`` times, or whose parent one class has not seen, has the shared probability
    in both, so its ratio is 1, as it is where the parent goes on in one way only; such nodes are left out.
    """
    nodes = words.mapInArrow(_beginnings, "parent long, node long, o long, t long")
    # Dealt out by parent once, for both the sums by node and the window. A parent has 257 nodes at most, from each task once or twice.
    nodes = nodes.repartition(partitions(words.sparkSession), "parent").groupBy("parent", "node").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    own = Window.partitionBy("parent")
    nodes = nodes.withColumns({"po": F.sum("o").over(own), "pt": F.sum("t").over(own), "ko": F.sum((F.col("o") > 0).cast("int")).over(own), "kt": F.sum((F.col("t") > 0).cast("int")).over(own)})
    n, whole = F.col("o") + F.col("t"), F.col("po") + F.col("pt")
    chance = lambda c, p, k: (F.greatest(F.col(c) - discount, F.lit(0.0)) + (discount * F.col(k) + weight) * (n / whole)) / (F.col(p) + weight)
    known = nodes.where((F.col("po") > 0) & (F.col("pt") > 0) & (n < whole) & (n >= least))
    return known.select("node", n.alias("n"), F.log(chance("t", "pt", "kt") / chance("o", "po", "ko")).alias("ratio"))


@dataclasses.dataclass
class Head:
    """The nodes of a model that fit in memory, sorted, with their ratios; open: a bit table of all others, or None."""

    nodes: np.ndarray
    ratios: np.ndarray
    open: np.ndarray | None

    def __post_init__(self):
        order = np.argsort(self.nodes)
        self.nodes, self.ratios = self.nodes[order], self.ratios[order]
        self.gate = np.zeros(1 << GATE, bool)
        self.gate[(self.nodes >> np.uint64(64 - GATE)).astype(np.int64)] = True

    def sums(self, node: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """Of each word, the sum of the ratios of its nodes."""
        at = np.flatnonzero(self.gate[(node >> np.uint64(64 - GATE)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.nodes, node[at]), max(len(self.nodes) - 1, 0))
        hit = self.nodes[place] == node[at] if len(self.nodes) else np.zeros(len(at), bool)
        return np.bincount(word[at[hit]], weights=self.ratios[place[hit]], minlength=words)

    def rest(self, node: np.ndarray) -> np.ndarray:
        """Where a node may be among the others."""
        slot = textnum.mix(node) >> np.uint64(64 - 26)
        return np.flatnonzero(self.open[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def _scorer(head: Head, share: float):
    """(row, id, text) to words and the sum over words of ln(1 - share + share * ratio); words with nodes outside ``head`` go to ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, sums, more = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), []
            for rows, t in textnum.texts(batch.column(2), textnum.LETTERS):
                _, first, back = np.unique(t.hashes(lower=True), return_index=True, return_inverse=True)
                node, word = nodes_of(t, first)
                ratio, own = head.sums(node, word, len(first)), t.owners()
                gain = np.log1p(share * np.expm1(ratio))
                if head.open is not None:
                    at = head.rest(node)
                    loose = np.zeros(len(first), bool)
                    loose[word[at]] = True
                    gain[loose] = 0
                    key, times = np.unique((own * len(first) + back)[loose[back]], return_counts=True)
                    which = key % max(len(first), 1)
                    starts = np.searchsorted(word[at], which)
                    size = np.searchsorted(word[at], which, "right") - starts
                    each = np.repeat(np.arange(len(key)), size)
                    place = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + starts[each]
                    more.append((key[each] // max(len(first), 1) + rows.start, which[each], ratio[which][each], times[each], node[at][place]))
                count[rows], sums[rows] = t.counts(), np.bincount(own, weights=gain[back], minlength=len(t))
            owner, word, ratio, times, node = map(np.concatenate, zip(*more, strict=True)) if more else [np.zeros(0, np.int64)] * 5
            fields = [pa.array(word.astype(np.int64)), pa.array(ratio.astype(float)), pa.array(times.astype(np.int64)), pa.array(node.view(np.int64))]
            lists = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32), pa.StructArray.from_arrays(fields, names=["word", "ratio", "times", "node"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), pa.array(sums), lists], names=["row", "id", "words", "sum", "more"])

    return run


def scores(scratch: Scratch, docs: DataFrame, model: DataFrame, share: float, most: int) -> DataFrame:
    """(id, words, sum) of each row of ``docs`` (id, text).

    The most frequent nodes of the model, ``most`` at most, go to every task. If there are more, a bit table of fixed size tells which words
    may have one of them; those words alone are shuffled and meet the rest of the model in a join.
    """
    level = F.floor(F.log2("n") * 16)
    rows = model.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 16 a doubling of n
    total, cut = 0, None
    for r in rows:
        if total + r["count"] > most:
            cut = r["level"]  # these and rarer ones stay out
            break
        total += r["count"]
    head = (model if cut is None else model.where(level > cut)).select("node", "ratio").toArrow()
    table = None
    if cut is not None:
        rest = model.where(level <= cut).select("node", "ratio")

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = np.unique(textnum.mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - 26)).astype(np.int64)
                byte, at = np.unique(slot >> 6, return_inverse=True)
                found = np.zeros(len(byte), np.uint64)
                np.bitwise_or.at(found, at, np.uint64(1) << (slot & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(found.view(np.int64))], names=["at", "bits"])

        told = rest.select("node").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2 ** 20 rows at most
        table = np.zeros(1 << 20, np.uint64)
        table[told.column("at").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
        table = table.view(np.uint8)
    run = _scorer(Head(head.column("node").to_numpy().view(np.uint64), head.column("ratio").to_numpy(), table), share)
    more = "array<struct<word: long, ratio: double, times: long, node: long>>"
    found = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text").mapInArrow(run, f"row long, id {docs.schema['id'].dataType.simpleString()}, words long, sum double, more {more}")
    if cut is None:
        return found.select("id", "words", "sum")
    found = scratch.write(found, "found")
    loose = found.select("row", F.explode("more").alias("x")).select("row", "x.*")
    loose = loose.join(rest.withColumnRenamed("ratio", "other"), "node", "left").groupBy("row", "word", "times", "ratio").agg(F.coalesce(F.sum("other"), F.lit(0.0)).alias("other"))
    extra = loose.groupBy("row").agg(F.sum(F.col("times") * F.log1p(share * F.expm1(F.col("ratio") + F.col("other")))).alias("extra"))
    return found.join(extra, "row", "left").select("id", "words", (F.col("sum") + F.coalesce("extra", F.lit(0.0))).alias("sum"))


def logistic(x: np.ndarray, n: np.ndarray, ones: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> tuple[float, float]:
    """Slope (0 at least) and intercept of P(1) = 1 / (1 + exp(-(slope * x + intercept))) on counts by x.

    Newton's method on a convex loss. A step that does not lower the loss enough is halved: whole steps can overshoot the
    curve, as classes that lie far apart leave hardly any row near its middle, and then swing for ever.
    """
    slope, base = 0.0, math.log((ones.sum() + 1) / (n.sum() - ones.sum() + 1))
    if not 0 < ones.sum() < n.sum():
        return 1.0, base
    even, at = base, np.array([slope, base])
    loss = lambda at: float((n * np.logaddexp(0, at[0] * x + at[1]) - ones * (at[0] * x + at[1])).sum() + ridge * at[0] ** 2 / 2)
    now = loss(at)
    for _ in range(steps):
        p = np.exp(-np.logaddexp(0, -(at[0] * x + at[1])))
        w, miss = n * p * (1 - p) + 1e-9, ones - n * p
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        rise = np.array([(miss * x).sum() - ridge * at[0], miss.sum()])
        step = np.linalg.solve(h, rise)
        part, gain = 1.0, float(rise @ step)
        while part > 1e-9 and (then := loss(at + part * step)) > now - 1e-4 * part * gain:
            part /= 2
        if part <= 1e-9 or np.abs(part * step).max() < 1e-8:
            break
        at, now = at + part * step, then
    return (float(at[0]), float(at[1])) if at[0] > 0 else (0.0, even)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, share: float = 0.005, scale: float = 1000.0, most: int = 1 << 20) -> DataFrame:
    """Per input row: doc_id, held_out, score, predicted, words, margin.

    ``docs`` has doc_id and text, ``labels`` has doc_id and toxic. A row's fold is crc32(doc_id as text) mod ``folds``.
    Rows of the fold ``held_out`` are never learnt from; the next fold calibrates (all settings were chosen by it too); the models count the
    words of all other labelled documents. Words are runs of letters, digits and bytes above 127, whole, whatever their length.

    An ordinary text draws its words from the ordinary model; a toxic one draws ``share`` of them from the toxic model and
    the others from the ordinary one. margin is the difference of the two log-likelihoods divided by the number of words.
    A logistic curve on asinh(``scale`` * margin) gives the score. ``most`` bounds what of the model goes to every task; see scores().

    Null or empty text: no words, margin 0, so the score of a document without evidence. Null doc_id: scored, held out
    null. Labels that are null or contradict each other: clear_labels. Without labels, or labels of one class, every
    score is the labelled share with one added to each class. Rows that repeat are scored alike. An empty table gives
    no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    labels = scratch.write(clear_labels(labels, "toxic").withColumn("fold", crc_mod(F.col("id"), folds)), "labels")
    calibrating = (held_out + 1) % folds
    learnt = ~F.col("fold").isin(held_out, calibrating)
    words = count_words(docs.where(~crc_mod(F.col("id"), folds).isin(held_out, calibrating)), labels.where(learnt).select("id", "y"))
    model = scratch.write(log_ratios(words), "model")
    scored = scores(scratch, docs, model, share, most).withColumn("margin", F.col("sum") / F.greatest(F.col("words"), F.lit(1)))
    scored = scratch.write(scored.select("id", "words", "margin", F.asinh(F.col("margin") * scale).alias("x")), "scored")
    step = 64
    bins = scored.join(labels.where(F.col("fold") == calibrating), "id").groupBy(F.round(F.col("x") * step).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    told = np.array([tuple(r) for r in bins.collect()], float).reshape(-1, 3)  # asinh of a double: some ten thousand bins at most
    slope, base = logistic(told[:, 0] / step, told[:, 1], told[:, 2])
    score = 1 / (1 + F.exp(-(F.col("x") * slope + base)))
    scratch.drop("model", "found")
    return scored.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), folds) == held_out).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "words", "margin")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents not predicted toxic, with all their columns. Rows that share an id are one document: all go if one does.

    Rows with a null id stay. Null, empty and repeated texts are judged as in toxicity(). An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    gone = scratch.write(toxicity(docs, labels, **options).where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "gone")
    return without(docs, "doc_id", gone)
