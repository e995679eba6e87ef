"""Operators whose groups may have any size, against plain Python: lists in order, rules as rows, medians, layouts, stores, streams, counters, files."""

import datetime as dt
import json
import os
import random
import re
import statistics
import struct
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillworks import job
from quillworks.functions import rules, text
from quillworks.operators import analytics, dictionary, engines, layout, metrics, results, rulebook, selection, store, stored, wordlist
from quillworks.sources import encoding, files, rasters
from quillworks.streaming import words as wordstream

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like(word, pattern):
    """word LIKE pattern || '%', A-Z in any case, no escapes."""
    parts = {"%": ".*", "_": "."}
    return re.fullmatch("".join(parts.get(c, re.escape(c)) for c in pattern.translate(LOW)) + ".*", word.translate(LOW), re.S) is not None


# ---- numbers and sums in order ----


def test_numbered_and_running(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(50) if rng.random() < 0.9 else None, k, rng.choice([1, 2, None])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, k int, v int")
    got = stored.numbered(df, ["g"], ["o", "k"]).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want, sums = {}, {}
    for g in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=order)):
            total += r[3] or 0
            want[r[2]], sums[r[2]] = n, total
    assert {r["k"]: r["n"] for r in got} == want
    assert {r["k"]: r["s"] for r in stored.running(df, ["g"], ["o", "k"], {"s": F.col("v")}).collect()} == sums
    assert stored.numbered(df.limit(0), ["g"], ["o"]).count() == 0 == stored.running(df.limit(0), ["g"], ["o"], {"s": F.col("v")}).count()


def test_numbered_spreads_equal_rows(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("g").alias("g"), F.lit(1).alias("o"))
    got = stored.numbered(rows, ["g"], ["o"])
    assert got.agg(F.count_distinct("n"), F.max("n")).first()[:] == (20_000, 19_999)
    ranged = max(Path(stored.folder(spark)).glob("ranged-*"), key=os.path.getmtime)
    assert max(r[1] for r in spark.read.parquet(str(ranged)).groupBy("_part").count().collect()) < 10_000


def test_stored_tables_go(spark):
    stored.clear(spark)
    assert stored.stored(spark.range(3), "three").count() == 3 and len(list(Path(stored.folder(spark)).glob("three-*"))) == 1
    assert stored.clear(spark) == 1 and not list(Path(stored.folder(spark)).glob("three-*")) and stored.clear(spark) == 0


# ---- words ----


def test_like_matches(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcABé_%\\") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    patterns = ["".join(rng.choice("abcAé_%\\") for _ in range(rng.randint(0, 4))) for _ in range(120)] + ["", "%", "_", "%%_", "\\", "a\\", "_b", "%bc", "%é%b"]
    a = spark.createDataFrame([(w,) for w in [*words, None]], "word string")
    b = spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")
    got = [tuple(r) for r in wordlist.like_matches(a, b).collect()]
    assert sorted(got) == sorted((p, w) for p in set(patterns) for w in set(words) if like(w, p))
    assert wordlist.like_matches(a, b.limit(0)).count() == 0 == wordlist.like_matches(a.limit(0), b).count()


def test_suggest_many(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("abc", 3, t(1)), ("abd", 3, t(2)), ("ab", 3, None), ("Abe", 9, t(1)), ("abf", 1, t(1)), ("b", 7, t(1))]
    got = wordlist.suggest_many(spark.createDataFrame(rows, "word string, frequency long, last_used timestamp"), spark.createDataFrame([("AB",), ("_",), ("zz",)], "pattern string"), 3)
    assert {(r["pattern"], r["place"]): r["word"] for r in got.collect()} == {("AB", 1): "Abe", ("AB", 2): "abd", ("AB", 3): "abc", ("_", 1): "Abe", ("_", 2): "b", ("_", 3): "abd"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def in_order(tokens, base):
    """One token after another."""
    seen = {w: (f, -1, used) for w, f, used in base}
    out = {}
    for n, (d, p, word, score) in enumerate(sorted(tokens, key=lambda r: r[:2])):
        if word is None or score is None:
            out[d, p] = word
        elif score >= 0.7:
            out[d, p] = word
            seen[word] = (seen.get(word, (0,))[0] + 1, n, 0)
        else:
            best = sorted((w for w in seen if like(w, word[:3])), key=lambda w: (-seen[w][0], -seen[w][1], -seen[w][2], w.encode()))[:5]
            out[d, p] = f"[{min(best, key=lambda w: (edits(word, w), best.index(w)))}]" if best else f"({word})"
    return out


@pytest.mark.parametrize("rows", [2, 7, 20_000])
def test_repaired_in_order(spark, rows):
    """Few rows a slice make each beginning go through many slices."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["a_c", "%b", "ABc", "\\a", "zzz"]
    tokens = [(d, p, rng.choice(vocabulary + [None]), rng.choice([0.1, 0.5, 0.7, 0.9, 0.9, None])) for d in range(12) for p in range(40)]
    base = [("abc", 4, 5), ("abd", 4, 9), ("bé", 1, 2), ("zzzz", 2, 1)]
    words = spark.createDataFrame([(w, f, dt.datetime(2024, 1, u)) for w, f, u in base], "word string, frequency long, last_used timestamp")
    df = spark.createDataFrame(tokens, "doc_id long, pos int, word string, score double")
    got = wordlist.repaired_in_order(df, words, slice_rows=rows).collect()
    assert len(got) == len(tokens) and {(r["doc_id"], r["pos"]): r["out"] for r in got} == in_order(tokens, base)
    assert wordlist.repaired_in_order(df.limit(0), words).count() == 0


def test_repaired_in_order_without_a_list(spark):
    tokens = [(1, 0, "hellp", 0.1), (1, 1, "hello", 0.9), (1, 2, "hellp", 0.1), (None, 0, "hel", 0.2)]
    words = spark.createDataFrame([], "word string, frequency long, last_used timestamp")
    got = wordlist.repaired_in_order(spark.createDataFrame(tokens, "doc_id long, pos int, word string, score double"), words)
    assert {(r["doc_id"], r["pos"]): r["out"] for r in got.collect()} == {(None, 0): "(hel)", (1, 0): "(hellp)", (1, 1): "hello", (1, 2): "[hello]"}


def test_a_token_without_a_score_stays(spark):
    words = spark.createDataFrame([("help", 9, dt.datetime(2024, 1, 1))], "word string, frequency long, last_used timestamp")
    tokens = spark.createDataFrame([(1, 0, "hellp", 0.1), (1, 1, "sure", 0.9), (1, 2, "hel", None)], "doc_id int, pos int, word string, score double")
    assert {r["pos"]: r["out"] for r in dictionary.repaired(tokens, words).collect()} == {0: "[help]", 1: "sure", 2: "hel"}


# ---- rules as rows ----


def test_rules_as_rows(spark):
    rules = [("u", 1, "plain", "a.b", "X"), ("u", 2, "regex", r"(\d+)-(\d+)", r"\2-\1$"), ("u", 3, "plain", "X", "YY"), ("u", 4, "plain", "a.b", "XX"), ("u", 5, "plain", None, "z"), ("u", 6, "plain", "", "z"), ("u", 7, "plain", "gone", None), ("v", 1, "regex", "[a-c]+", "<>"), (None, 1, "plain", "n", "m")]
    texts = [(1, "u", "a.b 12-3 axb gone"), (2, "v", "abcd cab"), (3, None, "nn"), (4, "w", "a.b"), (5, "u", None), (6, "u", "")]
    rules = spark.createDataFrame(rules, "owner string, seq int, kind string, pattern string, replacement string")
    df = spark.createDataFrame(texts, "id int, owner string, text string")
    got = {r["id"]: r["text"] for r in rulebook.apply_rows(df, rules).collect()}
    # The first rule keeps its place with its newest replacement, so the third one works on that.
    assert got == {1: "YYYY 3-12$ axb ", 2: "<>d <>", 3: "mm", 4: "a.b", 5: None, 6: ""}
    assert {r["id"]: r["text"] for r in rulebook.apply_rows(df, rules.limit(0)).collect()} == {k: t for k, _, t in texts}
    with pytest.raises(Exception, match="unknown kind"):
        rulebook.rulebooks(spark.createDataFrame([("u", 1, "glob", "a", "b")], rules.schema)).collect()


# ---- medians ----


def test_exact_medians(spark):
    rng = random.Random(4)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3001)], "even": [rng.random() for _ in range(3000)], "halves": [0.0] * 1000 + [1.0] * 1000, "one": [7.5] * 1500, "wide": [10.0 ** rng.randint(-300, 300) for _ in range(2500)],
        "ties": [float(rng.randrange(3)) for _ in range(2222)], "near": [0.0] * 999 + [0.5] + [1.0] * 1000, "few": [3.0, 1.0, 2.0], "two": [1.0, 4.0], "single": [9.0], None: [float(k) for k in range(-700, 700)], "lone": [-5.0] + [5.0] * 1200 + [6.0] * 1200,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None)]
    rng.shuffle(rows)
    got = {r["g"]: r["median"] for r in selection.exact_medians(spark.createDataFrame(rows, "g string, v double"), "g", "v", 40).collect()}
    assert got == {**{g: statistics.median(vs) for g, vs in groups.items()}, "none": None}


# ---- layout ----


def test_paragraph_lines(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["goes on", " ends. ", "ends!", "", "  ", "1. item", "- dash", "가) 항", "※ 끝?", "a"]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", "\n\n"]
    lines = [(k, n, x) for k, t in enumerate(texts) for n, x in enumerate(t.split("\n"))] + [(0, 10**6, None), (None, 0, "whose")]
    got = {}
    for r in layout.paragraph_lines(spark.createDataFrame(lines, "k int, n int, line string"), "k", "n").orderBy("k", "pos").collect():
        at = got.setdefault(r["k"], "")
        assert r["start"] == len(at) and r["paragraph"] == re.sub("\n+", "\n", at + r["before"]).count("\n") + 1
        got[r["k"]] = at + r["before"] + r["line"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = {r["k"]: r["p"] for r in df.select("k", text.paragraphs(F.col("t")).alias("p")).collect()}
    assert got == {None: "whose", **{k: p for k, p in want.items() if p}}


def test_paragraphs_of_many_lines_take_linear_time(spark):
    df = spark.createDataFrame([("line that goes on\nends.\n" * 20_000,)], "t string")
    began = time.time()
    assert df.select(F.length(text.paragraphs(F.col("t")))).first()[0] == 20_000 * 24 - 1 and time.time() - began < 20


def test_report_of_parts(spark, tmp_path):
    rows = [(k, f"name {k}", f"text é {k}\nmore" * (k % 4)) for k in range(50)] + [(None, None, None), (99, "last", None)]
    df = spark.createDataFrame(rows, "o int, name string, text string")
    parts = layout.write_report(df, str(tmp_path / "report"), "name", "text", "o")
    whole = b"".join(open(tmp_path / "report" / f, "rb").read() for f, _, _ in parts)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert whole.decode() == "".join(f"=== {n or ''} ===\n{t or ''}\n\n" for _, n, t in ordered) and len(parts) > 1
    assert [s for _, s, _ in parts] == [sum(b for _, _, b in parts[:k]) for k in range(len(parts))]
    for r in layout.report_places(df, "name", "text", "o").collect():
        assert whole[r["start"] : r["start"] + r["bytes"]].decode().startswith(f"=== {r['name'] or ''} ===\n")
    assert layout.write_report(df.limit(0), str(tmp_path / "none"), "name", "text", "o") == []


# ---- stored tables ----


def test_store(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    kept = store.Store(spark, str(tmp_path / "store"))
    assert kept.table("user_words").count() == 0
    seen = spark.createDataFrame([("w", "c1", "d", t(1), 1), ("v", "c2", "d", t(2), 2), ("w", "c3", "e", t(3), 3), (None, "x", "y", t(4), 4)], "word string, context string, domain string, ts timestamp, seq long")
    fixed = spark.createDataFrame([("teh", "the", 0.5, "s", t(5), 1), ("w2", "w", 0.6, "s", t(4), 2)], "original string, corrected string, confidence double, session_id string, created_at timestamp, seq long")
    log = spark.createDataFrame([("s", 0.9, 1.5, 0.8, t(1), 1)], "session_id string, accuracy double, processing_time double, image_quality double, created_at timestamp, seq long")
    assert kept.commit(words=seen) == 1 and kept.commit(corrections=fixed, sessions=log) == 2
    words = {r["word"]: (r["id"], r["frequency"], r["context"], r["domain"], r["created_at"]) for r in kept.table("user_words").collect()}
    assert words == {"v": (2, 1, "c2", "d", t(2)), "w": (4, 3, "교정됨: w2", "general", t(4)), "the": (5, 1, "교정됨: teh", "general", t(5))}
    assert [(r["id"], r["original"]) for r in kept.table("corrections").orderBy("id").collect()] == [(1, "w2"), (2, "teh")]
    assert kept.table("performance_log").first()["id"] == 1
    # A commit that stops before its manifest, and a writer that comes second.
    kept._write("corrections", fixed.withColumn("id", F.lit(9)), 3)
    assert kept.manifest()["version"] == 2 and kept.table("corrections").count() == 2
    with pytest.raises(RuntimeError, match="another writer"):
        kept._commit({**kept.manifest(), "version": 2})
    again = store.Store(spark, str(tmp_path / "store"))
    assert again.commit(corrections=fixed) == 3 and sorted(r["id"] for r in again.table("corrections").collect()) == [1, 2, 3, 4]


def test_word_stream(spark, tmp_path):
    """Batches, a late event, a restart from the checkpoint: the rows are those of all events at once."""
    rng = random.Random(6)
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    events = [(rng.choice(["hot"] * 8 + ["a", "b", None]), f"c{k}", "d", t(rng.randrange(300)), k) for k in range(200)]
    schema = "word string, context string, domain string, ts timestamp, seq long"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, wordstream.STORE)
    try:
        for k in range(2):
            for j in range(2):
                spark.createDataFrame(events[100 * k + 50 * j : 100 * k + 50 * j + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            rows = wordstream.word_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
            write = rows.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint")
            write.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    got = {r["word"]: tuple(r)[1:] for r in wordstream.newest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = {}
    for w in {e[0] for e in events} - {None}:
        mine = [e for e in events if e[0] == w]
        last = max(mine, key=lambda e: (e[3], e[4]))
        want[w] = (last[4], len(mine), last[1], "d", last[3], last[3])
    assert got == want


# ---- counters ----


def test_counters(spark, tmp_path):
    counters = metrics.text_counters("a", "b")
    df = spark.createDataFrame([("x  y", "x y"), ("z", "z"), (None, None)], "a string, b string")
    counters.watch(df).write.parquet(f"{tmp_path}/one")
    counters.watch(df).write.parquet(f"{tmp_path}/two")
    assert counters.totals() == {"rows": 6, "total_corrections": 2, "changed": 2}
    counters.reset()
    assert counters.totals() == {"rows": 0, "total_corrections": 0, "changed": 0}


def test_progress_of_an_action(spark):
    told = []
    df = spark.range(0, 1000, 1, 5).withColumn("k", F.col("id") % 7).groupBy("k").count()
    assert len(metrics.with_progress(spark, df.collect, lambda done, whole: told.append((done, whole)), 0.05)) == 7
    assert told and told[-1][0] == told[-1][1] > 0
    with pytest.raises(ZeroDivisionError):
        metrics.with_progress(spark, lambda: 1 / 0, lambda *_: 1 / 0)


# ---- files and encodings ----


def bmp(rows, bits=24, top=False):
    height, width = len(rows), len(rows[0])
    line = lambda r: b"".join(bytes(p[::-1]) + b"\0" * (bits == 32) for p in r)
    body = b"".join(line(r) + b"\0" * (-len(line(r)) % 4) for r in (rows if top else rows[::-1]))
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, width, -height if top else height, 1, bits, 0, len(body), 0, 0, 0, 0) + body


def test_image_files(spark):
    picture = [[(1, 2, 3), (4, 5, 6), (7, 8, 9)], [(10, 11, 12), (13, 14, 15), (16, 17, 18)]]
    flat = bytes(v for r in picture for p in r for v in p)
    good = {"a.bmp": bmp(picture), "b.bmp": bmp(picture, 32), "c.bmp": bmp(picture, 24, True), "d.ppm": b"P6 # note\n3 2\n255\n" + flat}
    bad = {"cut.bmp": bmp(picture)[:-1], "empty": b"", "null": None, "x.png": b"\x89PNG", "head": b"BM", "g16.pgm": b"P5 1 1 65535 \0\0", "short.pgm": b"P5 2 2 255 \1"}
    files = [*good.items(), *bad.items(), ("e.pgm", b"P5 2 1 255 \7\x08"), ("own.raw", b"RAW")]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r["image_id"]: r for r in rasters.decoded(df, readers={b"RAW": lambda raw: np.full((1, 1, 1), 5, np.uint8)}).collect()}
    assert len(got) == len(files)
    for name in good:
        assert tuple(got[name][:5]) == (name, 2, 3, 3, bytearray(flat)) and got[name]["error"] is None
    for name in bad:
        assert got[name]["data"] is None and got[name]["error"]
    assert got["e.pgm"]["data"] == b"\7\x08" and got["own.raw"]["data"] == b"\5"
    swapped = rasters.decoded(df.where("path = 'a.bmp'"), swap=True).first()["data"]
    assert bytes(swapped) == bytes(v for r in picture for p in r for v in p[::-1])
    assert rasters.decoded(df.limit(0)).count() == 0


def test_ascii_json(spark):
    texts = ["plain", 'quo"te\\', "\n\r\t\b\f\x00\x1f\x7f", "é가 ￿", "😀 𝄞", "", None, "é" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.orderBy("k").select(encoding.ascii_string(F.col("t")), encoding.unicode_escape(F.col("t")), encoding.representable(F.col("t"), "iso-8859-1")).collect()
    assert [json.loads(r[0]) for r in got] == texts and [r[0] for r in got] == [json.dumps(t).replace("\x7f", "\\u007f") for t in texts]
    assert [r[1] for r in got] == [t if t is None else t.encode("unicode_escape").decode() for t in texts]
    assert [r[2] for r in got] == [True, True, True, False, False, True, True, True]
    rows = [json.loads(r[0]) for r in encoding.safe_json(df, "t", "us-ascii").collect()]
    assert [(r["k"], r.get("t")) for r in rows] == list(enumerate(texts))
    assert all(r[0].isascii() for r in encoding.safe_json(df, "t", "us-ascii").collect())


# ---- text rules ----


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    return [r[0] for r in df.select("k", f(F.col("t")).alias("o")).orderBy("k").select("o").collect()]


def gaps(t):
    one = lambda m: " ".join(m.groups()) if len(m[1]) > 1 and len(m[3]) > 1 else m[0]
    return re.sub("([가-힣]+)([0-9]+)([가-힣]+)", one, t)


def test_number_gaps_keep_every_character(spark):
    rng = random.Random(7)
    texts = ["aa\x02b\x02cc", "a\x01b c", "가나1다라\x01마\x02바사3아자", "가1나2다", "가나12다라34마바", "", "가나1", "1가나"] + ["".join(rng.choice("가나다01 a\x01\x02.") for _ in range(40)) for _ in range(200)]
    assert column(spark, texts, text.number_gaps) == [gaps(t) for t in texts]


def test_shorter_rules_match_the_same_places(spark):
    """The rules as they would be written for whole runs."""
    h = "[가-힣]"
    long = [(rf"([0-9]+)({h}{{1,3}})(전|후|간|째|번|개|명|일|년|월|시|분|초)(?!{h})", r"\1\2 \3"), (rf"([A-Za-z]+)({h}{{2,}})(?!{h})", r"\1 \2"), (rf"({h}{{2,}})([A-Z]{{2,}})(?![A-Za-z])", r"\1 \2")]
    rng = random.Random(8)
    texts = ["".join(rng.choice("가나번년AB12b ") for _ in range(30)) for _ in range(400)]
    for (found, put), rule in zip(long, text.DYNAMIC, strict=False):
        assert column(spark, texts, rule.on) == [re.sub(found, put, t) for t in texts]


@pytest.mark.parametrize("run", ["a" * 80_000, "가" * 80_000, "1" * 80_000])
def test_long_runs_take_linear_time(spark, run):
    began = time.time()
    assert column(spark, [run], text.dynamic) == [run[:2]] and time.time() - began < 10
    began = time.time()
    assert column(spark, [run], text.number_gaps) == [run] and time.time() - began < 10


def test_enhanced_with_an_analyzer(spark):
    def analyze(sentence):
        if "bad" in sentence:
            raise ValueError(sentence)
        return [(w, "J" if w == "은" else "E" if w == "다" else "N") for w in sentence.split()]

    texts = ["그 은 책 을 쓴 다. 끝. ", "은 앞", "bad 은 text. x 은.", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r["t"] for r in text.joined_morphemes(df, "t", analyze).orderBy("k").collect()]
    assert got == ["그은 책 을 쓴다. 끝", "은 앞", "bad 은 text. x 은.", "", None]
    plain, told = (text.enhanced(df, "t", [("책", "글")], a).orderBy("k").collect() for a in (None, analyze))
    assert plain[0]["t"] == "그 은 글 을 쓴 다. 끝." and told[0]["t"].startswith("그은 글") and told[4]["t"] is None


def test_history_keeps_a_null_key(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), (None, 2, 0.5), (None, 3, 0.8)], "k string, o int, s double")
    assert {r["k"]: (r["total"], r["last_scores"]) for r in analytics.history_stats(rows, "k", "o", "s").collect()} == {"a": (1, [0.9]), None: (2, [0.5, 0.8])}


def test_optional_engines(spark):
    assert not engines.register_optional("none", "no_such_module_here", lambda m: None) and "none" not in engines.available()
    assert engines.register_optional("by_json", "json", lambda m: lambda image: [([], m.dumps(image["image_id"]), 0.5)])
    got = engines.recognise(spark.createDataFrame([("a", 1)], "image_id string, height int"), "by_json").first()
    assert got["text"] == '"a"' and got["error"] is None


def test_a_cluster_needs_its_shared_folder(spark):
    assert stored.folder(spark) == os.path.normpath(spark.conf.get("spark.checkpoint.dir"))


# ---- presets, options, shapes, languages, the job ----


def test_best_preset(spark):
    rows = [("a", "clean", 0, 0.0), ("a", "thin", 2, 0.5), ("a", "shadow", 1, 0.5), ("b", "thin", 2, 0.0), ("b", "shadow", 1, -1.0), (None, "thin", 2, 0.1), ("c", "shadow", 1, float("nan")), ("c", "thin", 2, None)]
    got = analytics.best_preset(spark.createDataFrame(rows, "k string, preset string, o int, score double"), "k", "preset", "o", "score").collect()
    assert {r["k"]: (r["preset"], r["score"]) for r in got} == {"a": ("shadow", 0.5), "b": ("clean", 0.0), None: ("thin", 0.1), "c": ("clean", 0.0)}


def test_options_shapes_and_languages(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}, [["box", "t"], ["box"], None, ["box", "t", "0.5"]], "ko+en+ko+"), (None, {"x": "1"}, None, ""), ({"a": "1"}, None, [], "fr, de")], "d map<string,string>, g map<string,string>, f array<array<string>>, s string")
    got = df.select(results.merged(F.col("d"), F.col("g")), results.well_formed(F.col("f")), files.sorted_languages(F.col("s"))).collect()
    assert [r[0] for r in got] == [{"a": "1", "b": "3", "c": None}, {"x": "1"}, {"a": "1"}]
    assert [r[1] for r in got] == [[["box", "t"], ["box", "t", "0.5"]], None, []] and [r[2] for r in got] == [["en", "ko"], [], ["de", "fr"]]


def test_occurrences_of_many_rules(spark):
    """As many rules as make one expression after another too large to compile."""
    many = [rules.Rule(f"w{k}x", f"w{k + 1}x", True) for k in range(60)] + [rules.Rule(r"w(\d+)x", r"\1")]
    values = ["w0x w0x w59x", "", "none", None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(rules.occurrences(F.col("t"), many)).collect()] == [2 * 60 + 1 + 3, 0, 0, None]
    assert spark.range(1).select(rules.occurrences(F.lit("x"), [])).first()[0] == 0


def test_job(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.BMP").write_bytes(bmp([[(1, 2, 3)] * 4] * 2))
    (tmp_path / "in" / "sub" / "b.png").write_bytes(b"\x89PNG")
    (tmp_path / "in" / "c.txt").write_bytes(b"no image")
    assert job.main([str(tmp_path / "in"), "ko, en", "--output", str(tmp_path / "out")], spark) == 0
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    got = {x["image_id"].rsplit("/", 1)[1]: x for x in lines}
    assert got.keys() == {"a.BMP", "b.png"} and got["a.BMP"]["success"] and got["a.BMP"]["text"] == "샘플 텍스트." and got["a.BMP"]["languages"] == "ko+en"
    assert not got["b.png"]["success"] and got["b.png"]["error"] == "no reader for this kind of file" and got["b.png"]["text"] == ""
    for wrong in ([], ["a", "b", "c"], ["a", "--engine"], ["a", "--what"], ["a", "--engine", "none"]):
        assert job.main(wrong, spark) == 1
    assert "usage" in capsys.readouterr().out
