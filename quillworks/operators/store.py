"""Words, corrections and sessions as stored tables that change together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dictionary import CORRECTIONS, PERFORMANCE, USER_WORDS
from .stored import numbered, stored

SCHEMAS = {"user_words": USER_WORDS, "corrections": CORRECTIONS, "performance_log": PERFORMANCE}
NOTHING = {"version": 0, "next": dict.fromkeys(SCHEMAS, 1), "parts": {name: [] for name in SCHEMAS}}


class Store:
    """Three tables in a folder. A commit writes new part tables and then one manifest that names all parts of its version.

    manifest-<version>.json is made under another name and renamed, and the highest number is the store. A commit that stops before that leaves the version before as it
    was; its files lie unused. Two writers of one version: the second one's rename fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def manifest(self) -> dict:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return NOTHING
        names = [f.getPath().getName() for f in fs.listStatus(self._path(""))]
        versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return NOTHING
        return json.loads(self.spark.read.text(f"{self.folder}/manifest-{max(versions)}.json", wholetext=True).first()[0])

    def _commit(self, told: dict) -> None:
        fs, new, final = self._fs(), self._path(f"_manifest-{told['version']}.new"), self._path(f"manifest-{told['version']}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(new, final):
            raise RuntimeError(f"version {told['version']} is there already: another writer was first")

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        parts = (manifest or self.manifest())["parts"][name]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.folder}/{p}" for p in parts))

    def _write(self, name: str, rows: DataFrame, version: int) -> str:
        part = f"{name}-{version}"
        columns = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMAS[name].split(", "))]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{part}")
        return part

    def commit(self, corrections: DataFrame | None = None, words: DataFrame | None = None, sessions: DataFrame | None = None) -> int:
        """Adds ``corrections`` (original, corrected, confidence, session_id, created_at, seq), ``words`` (word, context, domain, ts, seq) and ``sessions`` (session_id,
        accuracy, processing_time, image_quality, created_at, seq), all or none; returns the version.

        Corrections and sessions take the next ids in the order of (created_at, seq), without gaps. A correction is also a sighting of its corrected word. Each
        sighting, in order, takes an id of the word list and replaces its word's row: frequency one more, the rest as it says, created_at its time; so a row's id is that of its
        word's last sighting. Ids come from counts of ranges, whatever the number of rows. Null words are not kept.
        """
        now = self.manifest()
        told = {"version": now["version"] + 1, "next": dict(now["next"]), "parts": {k: list(v) for k, v in now["parts"].items()}}
        version = told["version"]
        for name, rows in (("corrections", corrections), ("performance_log", sessions)):
            if rows is not None:
                rows = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], ["created_at", "seq"], "_n")
                part = self._write(name, rows.withColumn("id", F.col("_n") + now["next"][name]), version)
                told["parts"][name].append(part)
                told["next"][name] += self.spark.read.parquet(f"{self.folder}/{part}").count()
        seen = [] if words is None else [words.select("word", F.col("context").cast("string").alias("context"), F.col("domain").cast("string").alias("domain"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"))]
        if corrections is not None:
            context = F.concat(F.lit("교정됨: "), F.coalesce("original", F.lit("")))
            seen.append(corrections.select(F.col("corrected").alias("word"), context.alias("context"), F.lit("general").alias("domain"), F.col("created_at").cast("timestamp").alias("ts"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq")))
        if seen:
            every = seen[0] if len(seen) == 1 else seen[0].unionByName(seen[1])
            every = stored(numbered(every.where("word is not null").withColumn("_all", F.lit(0)), ["_all"], ["ts", "kind", "seq"], "_n"), "sightings")
            last = F.max(F.struct(F.col("_n"), F.struct("context", "domain", "ts").alias("r")))
            new = every.groupBy("word").agg(F.count("*").alias("n"), last.alias("l")).select("word", "n", (F.col("l._n") + now["next"]["user_words"]).alias("id"), "l.r.*")
            old = self.table("user_words", now)
            both = old.withColumnsRenamed({c: f"_{c}" for c in old.columns}).join(new, F.col("_word") == F.col("word"), "full")
            pick = lambda a, b: F.when(F.col("word").isNotNull(), F.col(a)).otherwise(F.col(b))
            rows = both.select(pick("id", "_id").alias("id"), F.coalesce("word", "_word").alias("word"), (F.coalesce("_frequency", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("frequency"), pick("context", "_context").alias("context"), pick("domain", "_domain").alias("domain"), pick("ts", "_created_at").alias("created_at"), pick("ts", "_last_used").alias("last_used"))
            told["parts"]["user_words"] = [self._write("user_words", rows, version)]
            told["next"]["user_words"] += every.count()
        self._commit(told)
        return version
