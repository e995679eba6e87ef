"""Token ids as flat unsigned integer files with 64-bit document offsets, written in id order and read back by memory map."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .common import Scratch, partitions

#: Pieces whose ids a Python worker keeps; beyond it, the memory starts anew.
REMEMBERED = 1_500_000
#: Ids and bytes of pieces that it keeps at most.
KEPT = 1 << 27
#: Pieces that are encoded end to end at once.
AT_ONCE = 4_096

_BYTES = np.arange(256)
#: Marks that may end a word; after a letter or digit they are a word of their own to a tokenizer that marks word ends.
MARKS = np.isin(_BYTES, list(b".,!?;:|#$%&*"))
ALNUM = ~textnum.LETTERS & (_BYTES < 128)
ASCII_LETTERS = ALNUM & (_BYTES >= 65)
#: First bytes of two-byte letters, U+00C0 to U+024F.
LATIN = (_BYTES >= 0xC3) & (_BYTES <= 0xC9)


def latin_letter(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether two bytes are such a letter: U+00D7 and U+00F7 are signs, and U+0130 becomes two characters in lower case."""
    return LATIN[first] & (second >= 0x80) & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) & ~((first == 0xC4) & (second == 0xB0))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[start : start + length] of all, end to end."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


class Pool:
    """An array that grows at its end."""

    def __init__(self, kind: np.dtype):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def keep(self, values: np.ndarray) -> int:
        """Where the values are from now on."""
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)


#: Bytes that are compared at once.
COMPARED = 1 << 20


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Whether a[start : start + size] and b[start : start + size] are the same, for each of both lists."""
    out = a_sizes == b_sizes
    asked = np.flatnonzero(out & ((a_starts != b_starts) if a is b else True))
    ends = np.cumsum(a_sizes[asked])
    at = 0
    while at < len(asked):  # runs of pieces of about so many bytes
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        some = asked[at:to]
        unlike = gather(a, a_starts[some], a_sizes[some]) != gather(b, b_starts[some], a_sizes[some])
        if unlike.any():
            wrong = np.searchsorted(np.cumsum(a_sizes[some]), np.flatnonzero(unlike), "right")
            out[some[wrong]] = False
        at = to
    return out


def by_word_of(spec: dict) -> bool:
    """Whether a tokenizer file turns white space into spaces and lowers letters first, then keeps only pieces without a space. Decided from the file."""
    flat = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    first = flat(spec.get("normalizer"), "normalizers")
    spaces = any(x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " " for x in first)
    split = next((x for x in flat(spec.get("pre_tokenizer"), "pretokenizers") if x["type"] == "Split"), None)
    # Removed and inverted: what the pattern does not match goes. None of its parts may match white space.
    parts = split["pattern"].get("Regex", " ").split("|") if split and split["behavior"] == "Removed" and split["invert"] else [" "]
    apart = all(re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s[^\]]*\]\+?", x) for x in parts)
    return spaces and apart and any(x["type"] == "Lowercase" for x in first)


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file, special tokens not added.

    Splitting at spaces before the library is exact where its first steps turn white space into spaces and lower letters,
    and its words never cross a space: by_word_of() reads that from the file. Then each different piece goes through the library once and is
    remembered by a 64-bit hash, with its bytes: a piece takes the ids of another only if both are the same bytes, and one that shares a hash
    with a different piece goes through the library by itself. Where the file marks word ends, a piece is a word without the marks after it, or these
    marks, and pieces of one kind go through the library many at a time, cut where a token ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word, suffix = by_word_of(spec), spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """hashes, sorted, with where their ids are in the pool; the newest in small arrays of their own."""
        none = np.zeros(0, np.int64)
        self.tiers = [(np.zeros(0, np.uint64), none, none, none, none) for _ in range(2)]
        self.pool, self.raw = Pool(self.kind), Pool(np.uint8)

    def _pieces(self, t: textnum.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text, plain) of each piece. Plain ones are one word to the library."""
        data, starts, ends = t.data, t.starts, t.ends
        if self.ends is None or not len(starts):
            return starts, ends, t.owners(), np.zeros(len(starts), bool)
        place = np.maximum.accumulate(np.where(MARKS[data], -1, np.arange(len(data))))[ends - 1]
        core = np.maximum(place + 1, starts)
        last, before = data[np.maximum(core - 1, 0)], data[np.maximum(core - 2, 0)]
        letter = ALNUM[last] | latin_letter(before, last) & (core - 2 >= starts)
        core = np.where((core > starts) & ~letter, ends, core)
        cut = (core > starts) & (core < ends)
        begin, end, own = np.repeat(starts, 1 + cut), np.repeat(ends, 1 + cut), np.repeat(t.owners(), 1 + cut)
        at = np.cumsum(1 + cut) - 1 - cut
        end[at[cut]] = begin[at[cut] + 1] = core[cut]
        good = ASCII_LETTERS[data]
        two = latin_letter(data[:-1], data[1:])
        good[:-1] |= two
        good[1:] |= two
        inside = lambda x: np.concatenate([[0], np.cumsum(x)])
        letters, marks = inside(good), inside(MARKS[data])
        size = end - begin
        return begin, end, own, (letters[end] - letters[begin] == size) | (marks[end] - marks[begin] == size)

    def _encode(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) in the pool of new pieces."""
        place, length = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        rest = [np.flatnonzero(~plain)]
        some = np.flatnonzero(plain)
        for k in range(0, len(some), AT_ONCE):
            at = some[k : k + AT_ONCE]
            size = end[at] - begin[at] + 1
            line = gather(data, begin[at], size)
            line[np.cumsum(size) - 1] = 32
            ids = np.asarray(self.tokenizer.encode(line.tobytes().decode(), add_special_tokens=False).ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(at) or cuts[-1] != len(ids):
                rest.append(at)
                continue
            length[at] = np.diff(cuts, prepend=0)
            place[at] = self.pool.keep(ids) + cuts - length[at]
        rest = np.concatenate(rest)
        raw = data.tobytes()
        for at, x in zip(rest.tolist(), self.tokenizer.encode_batch_fast([raw[begin[i] : end[i]].decode() for i in rest], add_special_tokens=False), strict=True):
            length[at] = len(x.ids)
            place[at] = self.pool.keep(np.asarray(x.ids, self.kind))
        return place, length

    def _find(self, t: textnum.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, text) of each piece's ids."""
        begin, end, own, plain = self._pieces(t)
        low = textnum.LOWER[t.data] if self.ends is not None else t.data
        hashes, first, back = np.unique(textnum.spans(low.astype(np.uint64) + np.uint64(1), begin, end), return_index=True, return_inverse=True)
        # A piece stands for all of its hash in this text; those that differ from it go alone.
        size = end - begin
        alone = ~same_bytes(low, begin, low, begin[first][back], size, size[first][back])
        place, length, new = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes), bool)
        other = np.zeros(len(hashes), bool)
        for known, places, lengths, raws, sizes in self.tiers:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                at = at[hit]
                good = same_bytes(low, begin[first[hit]], self.raw.data, raws[at], size[first[hit]], sizes[at])
                new[hit], other[hit[~good]] = False, True
                place[hit[good]], length[hit[good]] = places[at[good]], lengths[at[good]]
        low = np.append(low, np.uint8(32))  # a place for the separator of the last piece
        if new.any():
            at = first[new]
            place[new], length[new] = self._encode(low, begin[at], end[at], plain[at])
            raws = self.raw.keep(gather(low, begin[at], size[at])) + np.cumsum(size[at]) - size[at]
            joined = [np.concatenate(x) for x in zip(self.tiers[1], (hashes[new], place[new], length[new], raws, size[at]), strict=True)]
            order = np.argsort(joined[0], kind="stable")
            self.tiers[1] = tuple(x[order] for x in joined)
            if len(order) > 100_000:
                joined = [np.concatenate(x) for x in zip(*self.tiers, strict=True)]
                order = np.argsort(joined[0], kind="stable")
                self.tiers = [tuple(x[order] for x in joined), tuple(x[:0] for x in joined)]
        place, length = place[back], length[back]
        if len(alone := np.flatnonzero(alone | other[back])):
            place[alone], length[alone] = self._encode(low, begin[alone], end[alone], plain[alone])
        return place, length, own

    def arrays(self, column: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids with the end id, lengths) of some of the column's texts after others."""
        if not self.by_word:
            for at in range(0, len(column), 256):
                coded = [np.asarray([*x.ids, end_id], self.kind) for x in self.tokenizer.encode_batch_fast([x or "" for x in column.slice(at, 256).to_pylist()], add_special_tokens=False)]
                yield np.concatenate(coded), np.asarray(list(map(len, coded)))
            return
        for _, t in textnum.texts(column, SPACE, 2 * textnum.CHUNK):
            if len(self.tiers[0][0]) > REMEMBERED or self.pool.used + self.raw.used > KEPT:
                self._forget()
            place, length, own = self._find(t)
            sizes = np.bincount(own, weights=length, minlength=len(t)).astype(np.int64) + 1
            ids = np.full(sizes.sum(), end_id, self.kind)
            last = np.cumsum(sizes) - 1
            mine = np.ones(len(ids), bool)
            mine[last] = False
            ids[mine] = gather(self.pool.data, place, length)
            yield ids, sizes


SPACE = _BYTES == 32
#: One encoder a Python worker and file: a worker runs many tasks.
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write_shard(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = None, TaskContext.get().partitionId()
        ids, nulls, lengths, data, name = [], [], [], None, ""
        try:
            for batch in batches:
                if data is None:
                    encoder = encoder_of(path)
                    name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex[:8]}"
                    data = open(name + ".bin.part", "wb")
                ids.append(batch.column(0).fill_null(0).to_numpy())
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                for found, sizes in encoder.arrays(batch.column(1), end_id):
                    found.tofile(data)
                    lengths += sizes.tolist()
        finally:
            if data is not None:
                data.close()
        if data is not None:
            np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tofile(name + ".idx.part")
            np.concatenate([*ids, *nulls]).astype("<i8").tofile(name + ".ids.part")
            for kind in ("bin", "idx", "ids"):  # a file of its final name is whole; a task that runs again makes another
                os.replace(f"{name}.{kind}.part", f"{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [os.path.basename(name)], "docs": [len(lengths)], "tokens": [sum(lengths)], "wide": [encoder.wide]})

    return run


def local_folder(url: str) -> str:
    """A mounted folder's path. Memory maps need one; another store is refused rather than written to some local disk."""
    at = urlparse(url)
    if at.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped: {url} is not a mounted folder")
    return unquote(at.path)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes ``docs`` in ascending id order to ``folder`` (shared by all executors) and returns the manifest's path.

    Each range partition writes shard-*.bin (ids, 16 bits where the vocabulary allows, else 32), shard-*.idx (64-bit
    offsets within the shard, one more than documents) and shard-*.ids (64-bit ids, then null flags). The manifest
    names the shards in order with each one's base, the prefix sum of the tokens before it.

    Null or empty text: the end id alone. Null ids come first. Rows of one id are ordered by text hash. An empty table
    gives a manifest without shards. Other columns are ignored.
    """
    spark, folder = docs.sparkSession, local_folder(folder)
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    told = rows.mapInArrow(_write_shard(tokenizer, folder, end_id), "part long, file string, docs long, tokens long, wide boolean").collect()  # one row a shard
    base, shards = 0, []
    for x in sorted(told, key=lambda x: x["part"]):
        shards.append({"file": x["file"], "docs": x["docs"], "tokens": x["tokens"], "base": base, "wide": x["wide"]})
        base += x["tokens"]
    with open(f"{folder}/manifest.json", "w") as out:
        json.dump({"tokens": base, "end_id": end_id, "shards": shards}, out)
    return f"{folder}/manifest.json"


class Shard:
    """One shard, memory-mapped: len(), ids_of(k), doc_id(k), start(k)."""

    def __init__(self, folder: str, entry: dict):
        name = f"{folder}/{entry['file']}"
        self.data = np.memmap(f"{name}.bin", "<u4" if entry["wide"] else "<u2", "r")
        self.offsets, both = np.memmap(f"{name}.idx", "<i8", "r"), np.memmap(f"{name}.ids", "<i8", "r")
        self.doc_ids, self.nulls, self.base = both[: entry["docs"]], both[entry["docs"] :], entry["base"]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids_of(self, k: int) -> np.ndarray:
        return self.data[self.offsets[k] : self.offsets[k + 1]]

    def doc_id(self, k: int) -> int | None:
        return None if self.nulls[k] else int(self.doc_ids[k])

    def start(self, k: int) -> int:
        return self.base + int(self.offsets[k])


def read_token_files(spark: SparkSession, manifest: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers).

    Documents come as they were written: repeated ids each with a row, a null id as null, an empty text with its end id alone.
    A manifest without shards gives no rows.
    """
    folder = os.path.dirname(manifest)
    with open(manifest) as f:
        shards = json.load(f)["shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in map(json.loads, batch.column(0).to_pylist()):
                shard = Shard(folder, entry)
                for at in range(0, len(shard), 4096):
                    some = range(at, min(at + 4096, len(shard)))
                    crc = [zlib.crc32(shard.ids_of(k).astype("<u4").tobytes()) for k in some]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([shard.doc_id(k) for k in some], pa.int64()), "start": [shard.start(k) for k in some], "n_tokens": np.diff(shard.offsets[at : some[-1] + 2]), "ids_crc32": pa.array(crc, pa.int64())})

    listed = spark.createDataFrame([(json.dumps(x),) for x in shards], "shard string").repartition(max(1, len(shards)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return Scratch(spark, "tokens").root
