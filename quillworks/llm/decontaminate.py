"""Benchmark decontamination: latent semantic retrieval with a proven gate, then longest common subsequences and answer checks."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, without

#: Items of fewer words are no passage: they match nothing.
LEAST = 5
#: A longer item goes in even pieces of about so many words. A passage is two strides, a stride the longest piece: any piece lies within one.
PIECE = 256
#: With so much of an item in order, its answer need not be there whole: a word of it may be misspelt.
NEAR = 0.85
#: Pieces and different words of a block. Each block has its own vocabulary and basis, so both stay small at any benchmark.
BLOCK_PIECES, BLOCK_WORDS, BLOCKS_AT_ONCE = 256, 8_192, 8
#: Words of a slice of the sums for the singular vectors, and documents that are multiplied at a time, as a dense matrix of 8 MB at most.
SLICE, ROWS = 256, 256


@dataclasses.dataclass
class Block:
    """Some pieces of benchmark items; words are hashes. This much is sent to the tasks; what follows from it is worked out there."""

    items: list[int]
    pieces: list[np.ndarray]
    vocabulary: np.ndarray = None
    idf: np.ndarray = None
    basis: np.ndarray = None  # words x rank

    def __post_init__(self):
        self.vocabulary = np.unique(np.concatenate(self.pieces))
        self.stride = max(map(len, self.pieces))
        self.lengths = np.array(list(map(len, self.pieces)))

    def prepare(self) -> None:
        """The gate of the vocabulary."""
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in the vocabulary) of the hashes that it holds."""
        at = np.flatnonzero(self.gate[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        good = self.vocabulary[place] == hashes[at]
        return at[good], place[good]

    def matrix(self) -> np.ndarray:
        """(1 + ln tf) * idf of the pieces: pieces x words."""
        own = np.searchsorted(self.vocabulary, np.concatenate(self.pieces))
        count = np.zeros((len(self.pieces), len(self.vocabulary)), np.float32)
        np.add.at(count, (np.repeat(np.arange(len(self.pieces)), self.lengths), own), 1)
        return (np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * self.idf).astype(np.float32)

    def ready(self, share: float) -> None:
        """What the search needs: latent items, the least inner products that a match can have, answers."""
        self.prepare()
        items = self.matrix()
        self.latent = (items @ self.basis).astype(np.float32)  # pieces x rank
        self.needed = least_words(self.lengths, share)
        self.floor, self.answers = [], []
        for p, need, row in zip(self.pieces, self.needed, items, strict=True):
            word, count = np.unique(np.searchsorted(self.vocabulary, p), return_counts=True)
            # A match holds ``need`` of the piece's words, and each different one at least once: at the very least those that add least.
            worth = row[word].astype(float) * self.idf[word]
            order = np.argsort(worth / count, kind="stable")
            before = np.concatenate([[0], np.cumsum(count[order])[:-1]])
            part = np.clip((need - before) / count[order], 0, 1)
            self.floor.append(float((worth[order] * part).sum()))
            idf = self.idf[np.searchsorted(self.vocabulary, p)]
            self.answers.append(np.unique(p[np.argsort(-idf, kind="stable")[: max(1, -(-len(p) // 4))]]))
        # 1e-3 of slack for what single precision rounds.
        self.floor = np.array(self.floor) * (1 - 1e-3) - 1e-3
        self.asks = np.array(list(map(len, self.answers)))
        self.rare = np.isin(self.vocabulary, np.concatenate(self.answers)).astype(float)

    def weighted(self, row: np.ndarray, word: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, weight) with weight (1 + ln tf) * idf, and each row's length."""
        key, count = np.unique(row * len(self.vocabulary) + word, return_counts=True)
        row, word = key // len(self.vocabulary), key % len(self.vocabulary)
        weight = (1 + np.log(count)) * self.idf[word]
        return row, word, weight, np.sqrt(np.bincount(row, weights=weight**2, minlength=rows))

    def passages(self, t: textnum.Texts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word) of the passages of some texts, and each row's text and first word: a new one every stride."""
        counts = t.counts()
        each = np.maximum(1, -(-counts // self.stride) - 1)
        base = np.concatenate([[0], np.cumsum(each)])
        at, word = self.find(hashes)
        own = t.owners()[at]
        k = (at - t.bounds[own]) // self.stride
        row = np.concatenate([base[own] + np.minimum(k, each[own] - 1), (base[own] + k - 1)[(k > 0) & (k < each[own])]])
        word = np.concatenate([word, word[(k > 0) & (k < each[own])]])
        texts = np.repeat(np.arange(len(t)), each)
        return row, word, texts, (np.arange(len(texts)) - base[texts]) * self.stride

    def telling(self, row: np.ndarray, word: np.ndarray, texts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The passages that are worth a vector: those with a word of some answer, and with as many of the benchmark's words as the shortest match needs."""
        some = np.bincount(row, weights=self.rare[word], minlength=len(texts)) > 0
        some &= np.bincount(row, minlength=len(texts)) >= self.needed.min()
        at = np.cumsum(some) - 1
        return at[row[some[row]]], word[some[row]], texts[some], first[some]


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks, by length, as passages are cut to a block's longest piece. It is the stated query set; its rows stream through the driver."""
    ids, pieces, words = [], [], set()
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy(F.length("text"), "item_id", "text")
    for item, text in rows.toLocalIterator():
        for _, t in textnum.texts(pa.array([text])):
            hashes = t.hashes(lower=True)
            if len(hashes) < LEAST:
                continue
            for piece in np.array_split(hashes, max(1, round(len(hashes) / PIECE))):
                if ids and (len(ids) >= BLOCK_PIECES or len(words | set(piece.tolist())) > BLOCK_WORDS or len(piece) > 2 * min(map(len, pieces))):
                    yield Block(ids, pieces)
                    ids, pieces, words = [], [], set()
                ids.append(item)
                pieces.append(piece)
                words |= set(piece.tolist())
    if ids:
        yield Block(ids, pieces)


def _counts(blocks: list[Block]):
    """text to (block, word, count): for each text and block, the block's words in it, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            block.prepare()
        for batch in batches:
            for _, t in textnum.texts(batch.column(0)):
                hashes, own = t.hashes(lower=True), t.owners()
                for k, block in enumerate(blocks):
                    at, word = block.find(hashes)
                    key, count = np.unique(own[at] * len(block.vocabulary) + word, return_counts=True)
                    used, row = np.unique(key // len(block.vocabulary), return_inverse=True)
                    bounds = np.searchsorted(row, np.arange(len(used) + 1)).astype(np.int32)
                    lists = (pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key % len(block.vocabulary), count))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), *lists], names=["block", "word", "count"])

    return run


def _flat(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy()


def _bounds(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Where each row's list begins in the flat ones, and the last one's end."""
    offsets = batch.column(column).offsets.to_numpy()
    return offsets - offsets[0]


def _frequencies(blocks: list[Block]):
    """(block, word) of the counts to (block, word, df), summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b.vocabulary), np.int64) for b in blocks]
        for batch in batches:
            block = np.repeat(batch.column(0).to_numpy(), np.diff(_bounds(batch, 1)))
            for k, count in enumerate(counts):
                count += np.bincount(_flat(batch, 1)[block == k], minlength=len(count))
        for k, count in enumerate(counts):
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"block": np.full(len(some), k), "word": some, "df": count[some]})

    return run


def _weights(idfs: list[np.ndarray]):
    """(block, word, count) to (block, word, weight): TF-IDF rows of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.cumsum(list(map(len, idfs)))])
        idf = np.concatenate(idfs)
        for batch in batches:
            if batch.num_rows:  # rows have a word at least
                block, bounds = batch.column(0), _bounds(batch, 1)
                size = np.diff(bounds)
                weight = (1 + np.log(_flat(batch, 2))) * idf[np.repeat(starts[block.to_numpy()], size) + _flat(batch, 1)]
                weight /= np.repeat(np.sqrt(np.add.reduceat(weight**2, bounds[:-1])), size)
                yield pa.RecordBatch.from_arrays([block, batch.column(1), pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(weight.astype(np.float32)))], names=["block", "word", "weight"])

    return run


def randomised_svd(corpus: DataFrame, rows: np.ndarray, words: int, rank: int, over: int = 12, rounds: int = 2, seed: int = 4) -> np.ndarray:
    """The ``rank`` leading right singular vectors (words x rank) of the rows of ``corpus`` (word, weight) above ``rows``.

    Subspace iteration from a random start: each round multiplies by A'A and orthonormalises. All rows of ``corpus`` take part,
    where they lie: a task sums its rows' share of the product, and the shares are added up on Spark in slices of SLICE words, in the tasks'
    order, so that reruns agree. The driver gets one words x (rank + over) matrix a round, whatever the number of rows.
    """
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(words, min(words, rank + over))))[0]
    shared = corpus.sparkSession.sparkContext.broadcast

    def product(q, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = q.value
        total = np.zeros_like(q)
        for batch in batches:
            bounds, words, weights = _bounds(batch, 0), _flat(batch, 0), _flat(batch, 1)
            for at in range(0, batch.num_rows, ROWS):
                own = bounds[at : at + ROWS + 1]
                some = np.zeros((len(own) - 1, len(q)), np.float32)
                some[np.repeat(np.arange(len(some)), np.diff(own)), words[own[0] : own[-1]]] = weights[own[0] : own[-1]]
                total += some.T @ (some @ q)
        slices = [total[k : k + SLICE].tobytes() for k in range(0, len(total), SLICE)]
        yield pa.RecordBatch.from_pydict({"slice": np.arange(len(slices), dtype=np.int32), "task": np.full(len(slices), TaskContext.get().partitionId(), np.int32), "sum": slices})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(part.as_buffer(), np.float32).astype(float)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "sum": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    for _ in range(rounds + 1):
        q = shared(basis.astype(np.float32))
        parts = corpus.mapInArrow(lambda batches, q=q: product(q, batches), "slice int, task int, sum binary")
        told = parts.repartition("slice").sortWithinPartitions("slice", "task").mapInArrow(added, "slice int, sum binary").collect()
        q.destroy()
        total = rows.T @ (rows @ basis)
        for x in told:
            total[x["slice"] * SLICE : (x["slice"] + 1) * SLICE] += np.frombuffer(x["sum"]).reshape(-1, basis.shape[1])
        basis, previous = np.linalg.qr(total)[0], basis
    values, vectors = np.linalg.eigh(previous.T @ total)
    return (previous @ vectors)[:, np.argsort(-values)[:rank]]


def completed(basis: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The basis with the directions that the items have outside it: an inner product with an item is then the same in the latent space as outside."""
    rest = items.T.astype(float)
    for _ in range(2):  # twice, for rounding
        rest = rest - basis @ (basis.T @ rest)
    more, values, _ = np.linalg.svd(rest, full_matrices=False)
    return np.concatenate([basis, more[:, values > 1e-9 * max(np.abs(items).max(), 1.0)]], axis=1)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := places.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def least_words(lengths: np.ndarray, share: float) -> np.ndarray:
    """The smallest whole number of words that is ``share`` of each length, by the division that also judges a subsequence."""
    least = np.maximum(np.ceil(share * lengths) - 1, 0)
    return (least + (least / lengths < share)).astype(np.int64)


def _matches(blocks: list[Block], share: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            block.ready(share)
        for batch in batches:
            found = []
            for rows, t in textnum.texts(batch.column(1)):
                hashes = t.hashes(lower=True)
                for block in blocks:
                    row, word, texts, first = block.telling(*block.passages(t, hashes))
                    row, word, weight, length = block.weighted(row, word, len(texts))
                    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
                    for at in range(0, len(texts), 512):
                        to = min(at + 512, len(texts))
                        some = slice(bounds[at], bounds[to])
                        latent = np.add.reduceat(block.basis[word[some]] * weight[some, None].astype(np.float32), bounds[at:to] - bounds[at], axis=0)
                        product = latent @ block.latent.T
                        for i, j in zip(*np.nonzero(product >= block.floor), strict=True):
                            passage, piece = at + i, block.pieces[j]
                            start = t.bounds[texts[passage]] + first[passage]
                            words = hashes[start : min(start + 2 * block.stride, t.bounds[texts[passage] + 1])]
                            held = np.isin(piece, words)
                            known = np.isin(block.answers[j], words).sum() / block.asks[j]
                            # A common subsequence has no more words than the piece has words in the passage.
                            if held.sum() < block.needed[j] or known < answer and held.sum() / len(piece) < NEAR:
                                continue
                            common = lcs(piece, words) / len(piece)
                            if common >= share and (known >= answer or common >= NEAR):
                                cosine = product[i, j] / (length[passage] * np.linalg.norm(block.latent[j]))
                                found.append((rows.start + int(texts[passage]), block.items[j], float(cosine), common, float(known), int(first[passage])))
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([x[c] for x in found], kind) for c, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64())))], names=["id", "item_id", "cosine", "lcs", "answer", "word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, answer: float = 0.75, rank: int = 64, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, word): the benchmark items that a document gives away, with the best passage.

    Words are runs of anything but white space, A-Z lowered. Document frequencies of the benchmark's words are counted
    over all documents. The basis holds the ``rank`` leading singular vectors of the items and of all documents, whole, as TF-IDF rows,
    and what the items have outside them, so that the latent inner product of any passage with an item is that of their
    TF-IDF vectors. Nothing is fitted on a sample. Every passage of every whole text is searched by it.
    A passage is a candidate where the product is no less than a match can have: a match holds ``share`` of the item's words, so
    the product is at least what the cheapest such words give; divided by both lengths, that is the cosine that it has to reach.
    So the search loses no match. A candidate gives the item away if their longest common subsequence covers ``share`` of the
    item's words and it holds ``answer`` of the item's answer, the quarter of its words that is rarest. A text with NEAR
    of the words in order is no paraphrase but a copy, and needs no answer check. Of passages with equal subsequences, the one with the
    highest cosine is told. An item of more than one and a half PIECE goes in even pieces; one of them gives it away.

    Null or empty texts match nothing, nor do null items and items of fewer than LEAST words. Null ids: reported with a null id.
    Rows that share an id are one document. An empty table on either side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    kind = docs.schema[id_col].dataType.simpleString()
    docs, out, group = docs.select(F.col(id_col).alias("id"), "text"), [], []

    def over(rows: DataFrame, blocks: list[Block], make: Callable, schema: str, name: str) -> DataFrame:
        """rows through make(blocks), written; the blocks leave all memories after it."""
        shared = spark.sparkContext.broadcast(blocks)
        try:
            return scratch.write(rows.mapInArrow(lambda batches: make(shared.value)(batches), schema), name)
        finally:
            shared.destroy()

    def search(blocks: list[Block], name: str) -> DataFrame:
        counts = over(docs.select("text"), blocks, _counts, "block long, word array<int>, count array<int>", f"{name}-counts")
        counted = over(counts.select("block", "word"), blocks, _frequencies, "block long, word long, df long", f"{name}-df").groupBy("block", "word").agg(F.sum("df").alias("df"))
        told = counted.toArrow()  # BLOCK_WORDS rows a block at most, BLOCKS_AT_ONCE blocks
        for k, block in enumerate(blocks):
            df, mine = np.zeros(len(block.vocabulary)), told.column("block").to_numpy() == k
            df[told.column("word").to_numpy()[mine]] = told.column("df").to_numpy()[mine]
            block.idf = np.log1p((total + 1) / (df + 1))
        rows = scratch.write(counts.mapInArrow(_weights([b.idf for b in blocks]), "block long, word array<int>, weight array<float>"), f"{name}-rows")
        scratch.drop(f"{name}-counts")
        for k, block in enumerate(blocks):
            items = block.matrix()
            items /= np.linalg.norm(items, axis=1, keepdims=True)
            basis = randomised_svd(rows.where(F.col("block") == k).select("word", "weight"), items, len(block.vocabulary), min(rank, len(block.vocabulary)))
            block.basis = completed(basis, items).astype(np.float32)
        scratch.drop(f"{name}-rows", f"{name}-df")
        return over(docs, blocks, lambda b: _matches(b, share, answer), f"id {kind}, item_id long, cosine double, lcs double, answer double, word long", name)

    total = docs.count()
    for block in blocks_of(benchmark):
        group.append(block)
        if len(group) == BLOCKS_AT_ONCE:
            out.append(search(group, f"found{len(out)}"))
            group = []
    if group:
        out.append(search(group, f"found{len(out)}"))
    if not out:
        return spark.createDataFrame([], f"{id_col} {kind}, item_id long, cosine double, lcs double, answer double, word long")
    best = F.max(F.struct("lcs", "cosine", "answer", (-F.col("word")).alias("place")))
    found = reduce(DataFrame.unionByName, out).groupBy("id", "item_id").agg(best.alias("b"))
    return found.select(F.col("id").alias(id_col), "item_id", "b.cosine", "b.lcs", "b.answer", (-F.col("b.place")).alias("word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that give no item away, with all their columns. Rows that share an id are one document: all go if one does.

    Rows with a null id, null and empty texts stay. Without items all rows stay; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    found = scratch.write(contaminated(docs, benchmark, **options).where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "gone")
    return without(docs, "doc_id", found)
