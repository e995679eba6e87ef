"""Exact top-k by inner product: an impact-ordered index read score at a time, stopped only on proof, rescored exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A posting's count sits above its score in one accumulator.
COUNT = 1 << 40


class ImpactIndex:
    """Postings of a block of integer vectors: for each component, rows by quantised value.

    A segment is the rows of one component whose values share a quantised level. For a query, a segment's impact is
    the most that it can add above the component's least contribution. Segments go in descending impact, in rounds: after
    a round with threshold t, a row has at least its sum so far, and at most that plus the quantisation error plus t for
    each component not read yet.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: int = 4, rounds: int = 12):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order].astype(np.int64))
        self.step, self.rounds = step, rounds
        lows = self.vectors // step * step
        self.rows = np.argsort(lows, axis=0, kind="stable").T.copy()  # by component: rows, ascending level
        self.lows = np.take_along_axis(lows, self.rows.T, axis=0).T.copy()
        self.most = int(np.abs(self.vectors).max(initial=0)) + step

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score) without the query's own id; ties to smaller ids."""
        query = query.astype(np.int64)
        skip = slice(*np.searchsorted(self.ids, [own, own + 1]))
        n, d = self.vectors.shape
        few = max(4 * k, n // 16)
        found = None
        if d and n - (skip.stop - skip.start) > few and d * 2 * self.most * int(np.abs(query).max(initial=0)) < COUNT:
            found = self._members(query, skip, k, few)
        if found is None:
            found = np.delete(np.arange(n), skip)
        scores = self.vectors[found] @ query
        best = np.lexsort((self.ids[found], -scores))[:k]
        return list(zip(self.ids[found[best]].tolist(), scores[best].tolist(), strict=True))

    def _members(self, query: np.ndarray, skip: slice, k: int, few: int) -> np.ndarray:
        """Positions that may be among the best k, by proof: all others have k rows surely above them."""
        n, d = self.vectors.shape
        wide = np.abs(query) * (self.step - 1)  # what a level leaves open
        falls = query < 0
        ends = query[:, None] * self.lows[:, [0, -1]]
        least = ends.min(axis=1) - np.where(falls, wide, 0)
        spans = ends.max(axis=1) + np.where(falls, 0, wide) - least
        error, top = int(wide.sum()), int(spans.max())
        read = np.zeros(d, np.int64)  # postings of a component read so far, from its end of high impact
        sums = np.zeros(n, np.int64)
        for r in range(1, self.rounds + 1):
            limit = top * (self.rounds - r) // self.rounds if r < self.rounds else -1
            for c in np.flatnonzero((spans > limit) & (read < n)):
                q, low, rows = query[c], self.lows[c], self.rows[c]
                # Impact of a level: its high contribution above the component's least.
                if falls[c]:
                    upto = n if limit < 0 else int(np.searchsorted(low, -((limit + least[c]) // -q), "left"))
                    some = slice(read[c], upto)
                else:
                    upto = n if limit < 0 or q == 0 else n - int(np.searchsorted(low, (limit + least[c] - wide[c]) // q, "right"))
                    some = slice(n - upto, n - read[c])
                if upto > read[c]:
                    sums[rows[some]] += low[some] * q - (wide[c] if falls[c] else 0) - least[c] + COUNT
                    read[c] = upto
            floor, seen = sums & (COUNT - 1), sums >> 40
            ceiling = floor + error + max(limit, 0) * (d - seen)
            floor[skip], ceiling[skip] = -1, -1
            proof = np.partition(floor, n - k)[n - k]
            found = np.flatnonzero(ceiling >= proof)
            found = found[(found < skip.start) | (found >= skip.stop)]
            if len(found) <= few:
                break
        return found


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component as double; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024)))


def exact_topk(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = 16_384, queries: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller id.

    Queries: rows whose id is divisible by ``every``. Candidates: every row with another id. Candidates are dealt to
    blocks of about ``rows`` by id hash, queries to blocks of about ``queries``; each pair of blocks is one group, so a
    task holds one block's index whatever the table's size. The best k of all blocks of a query give its answer.

    Null ids, null vectors and vectors with null or non-finite components take no part. Shorter vectors count as
    padded with 0; where all are empty, every score is 0. Rows that repeat an id are candidates for other ids as often as they occur, and none for their own.
    Components so large that a score could leave 64 bits are an error, never a wrong row. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows_of = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
    total, width, low, high = rows_of.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if total and (width or 0) * max(-(low or 0), high or 0) ** 2 >= 1 << 62:
        raise ValueError(f"vectors of {width} components between {low} and {high}: inner products can leave 64 bits")
    blocks, parts = max(1, -(-total // rows)), max(1, -(-(total // every) // queries))
    cand = rows_of.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = rows_of.where(F.col("id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    cand = cand.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(t: pa.Table, width: int) -> np.ndarray:
        lists = t.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy()
        out = np.zeros((len(t), width), np.int64)
        out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        return out

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            width = max(max(map(len, t.column("v"))) for t in (left, right))
            index = ImpactIndex(left.column("id").to_numpy(), matrix(left, width))
            for query, vector in zip(right.column("id").to_pylist(), matrix(right, width), strict=True):
                found += [(query, *x) for x in index.search(vector, query, k)]
        return pa.table({name: pa.array([x[c] for x in found], pa.int64()) for c, name in enumerate(("query_id", "vec_id", "score"))})

    best = cand.groupBy("cb", "qb").cogroup(asked.groupBy("cb", "qb")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
