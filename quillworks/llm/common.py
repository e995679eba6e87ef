"""What the operators share: scratch tables in the shared folder, exact connected components, column helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillworks-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. Cuts lineage: a lost executor loses nothing that later steps read.

    What an operator returns may still read its tables, so they stay until the caller is done; ``tidy`` removes them then.
    """

    _made: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for made in Scratch._made:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """Written so that the rows of each value of ``keys`` lie together: joins on them read it where it lies, without a shuffle."""
        table = f"{name}_{uuid.uuid4().hex}"
        df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path(name)).saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # its files stay, and so does what was read of their layout
        return out

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            delete(self.spark, self.path(name))


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def tidy(*keep: Scratch) -> Iterator[None]:
    """Removes at its end, or on a failure, the tables that operators wrote within it. For callers that have written the results elsewhere."""
    made: list[Scratch] = []
    Scratch._made.append(made)
    try:
        yield
    finally:
        Scratch._made.remove(made)
        for scratch in made:
            if scratch not in keep:
                delete(scratch.spark, scratch.root)


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where ``rows`` has such a column."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the table of ids: 8 MB, whatever the number of ids.
ID_BITS = 26


def _marked(rows: DataFrame, col: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """rows with one more column: whether the id may be in ``ids`` (one column, named id), by a bit table of fixed size that is broadcast."""
    word, bits, maybe = fresh(rows, "_word", "_bits", "_maybe")
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    table = ids.select(F.shiftright(slot(F.col("id")), 6).alias(word), F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))").alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    # 2 ** (ID_BITS - 6) rows at most.
    out = rows.withColumn(word, F.shiftright(slot(F.col(col)), 6)).join(F.broadcast(table), word, "left")
    return out.withColumn(maybe, F.expr(f"coalesce((shiftrightunsigned(`{bits}`, cast(xxhash64(`{col}`) & 63 as int)) & 1) = 1, false)")).drop(word, bits), maybe


def id_filter(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id may be in ``ids``. It spares most others a shuffle; ids that share a bit pass too, so an exact join has to follow."""
    out, maybe = _marked(rows, col, ids)
    return out.where(F.col(maybe)).drop(maybe)


def without(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not in ``ids`` (one column, named id), and those with a null id. Only rows that may go are shuffled.

    Repeated rows stay or go together. Columns are as given, whatever their names. No ids: all rows; no rows: none.
    """
    marked, maybe = _marked(rows, col, ids)
    (other,) = fresh(rows, "_id")
    unsure = marked.where(F.col(maybe)).join(ids.select(F.col("id").alias(other)), F.col(col) == F.col(other), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(unsure).drop(maybe)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n. Null ids: null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of edges (a, b).

    Alternating large and small stars on written tables: the smallest neighbour of each node comes from a partial
    aggregate and is written before it goes back to the edges, so that both sides of that join have a shuffle of their own and
    Spark can split the edges of a node with very many neighbours; no neighbour list is ever gathered.
    """
    either = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = lambda e, name: scratch.write(e.groupBy("u").agg(F.min("v").alias("m")), name)

    def written(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        """The different edges, and a mark by which a round knows that it changed nothing."""
        out = scratch.write(e.where("u > v").distinct(), name)
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, mark = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges0")
    for k in range(1, rounds + 1):
        both = either(now)
        near = least(both, f"near{k}")
        large = scratch.write(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct(), f"large{k}")
        near = least(large, f"near{k}s")
        small = large.join(near, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now, seen = written(small.select("e.*"), f"edges{k}")
        scratch.drop(f"edges{k - 1}", f"near{k}", f"near{k}s", f"large{k}")
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
