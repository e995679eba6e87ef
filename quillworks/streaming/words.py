"""The word list as a stream's state, a row a word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "id long, frequency long, context string, domain string, created_at timestamp, last_used timestamp"
OUT = f"word string, {ROW}"
#: What one task has of a word before the shuffle.
PART = "word string, n long, ts timestamp, seq long, context string, domain string"


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a word and batch of rows: how many, and the latest one. A very common word reaches its state as few rows."""
    for batch in batches:
        latest = batch.sort_values(["ts", "seq"]).drop_duplicates("word", keep="last")
        n = batch.groupby("word", as_index=False).size().rename(columns={"size": "n"})
        yield latest.merge(n, on="word")[["word", "n", "ts", "seq", "context", "domain"]]


class Words(StatefulProcessor):
    """Each event adds one to its word's frequency and replaces the row, as writing it again would: id (the event's number), context, domain and created_at are the latest event's."""

    def init(self, handle) -> None:
        self.row = handle.getValueState("row", f"{ROW}, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.row.get()) if self.row.exists() else None
        for batch in rows:
            for n, ts, seq, context, domain in zip(batch["n"], batch["ts"], batch["seq"], batch["context"], batch["domain"], strict=True):
                count, seq, ts = (now[1] if now else 0) + int(n), int(seq), ts.to_pydatetime()
                # An event older than the row counts and changes nothing else.
                newer = now is None or (ts, seq) > (now[5].replace(tzinfo=None) if now[5].tzinfo else now[5], now[6])
                now = (seq, count, context, domain, ts, ts, seq) if newer else (now[0], count, *now[2:])
        self.row.update(now)
        yield pd.DataFrame([(key[0], *now[:6])], columns=["word", "id", "frequency", "context", "domain", "created_at", "last_used"])

    def close(self) -> None:
        pass


def word_rows(events: DataFrame) -> DataFrame:
    """The rows of words as they change, from a stream of events (word, context, domain, ts, seq): word, id, frequency, context, domain, created_at, last_used.

    State is by word in a key-value store of each task, so a batch touches the words that it brings and no others; a query that restarts from
    its checkpoint goes on where it was. Events of any age are taken: their order among batches does not change the rows. Tasks combine events by word before they are
    shuffled. Null words go. The session needs ``STORE`` as spark.sql.streaming.stateStore.providerClass. Write it in update mode.
    """
    rows = events.where("word is not null").select("word", F.col("context").cast("string").alias("context"), F.col("domain").cast("string").alias("domain"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    parts = rows.mapInPandas(_combined, PART)
    return parts.groupBy("word").transformWithStateInPandas(Words(), OUT, "Update", "None")


def newest(updates: DataFrame) -> DataFrame:
    """The list from all updates: a word's row with its highest frequency."""
    columns = [c.split()[0] for c in ROW.split(", ")]
    return updates.groupBy("word").agg(F.max_by(F.struct(*columns), "frequency").alias("r")).select("word", "r.*")
