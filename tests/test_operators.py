"""Blocks, words, logs, images, engines, files and streams on small written tables."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillworks.functions import quality, text
from quillworks.operators import analytics, blocks, dictionary, engines, images, results
from quillworks.sources import files, sinks
from quillworks.streaming import ingest


def test_cascade(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.6), ("b", 3, 0.6), ("b", 4, 0.4), ("c", 5, 0.35), ("d", 6, 0.1), ("e", 7, None), (None, 8, 0.7)]
    got = blocks.cascade(spark.createDataFrame(rows, "image_id string, pos int, confidence double")).select("pos").collect()
    assert sorted(r[0] for r in got) == [1, 3, 5, 7, 8]


def test_corner_and_reading_order(spark):
    rows = [("a", 0, [[50.0, 19.9]]), ("a", 1, [[10.0, 20.0]]), ("a", 2, [[5.0, 0.0]]), ("a", 3, None), ("a", 4, [[7.0]]), ("a", 5, [[1.0, 39.9]])]
    df = spark.createDataFrame(rows, "image_id string, pos int, bbox array<array<double>>")
    x, y = blocks.corner(F.col("bbox"))
    got = blocks.reading_rank(df.withColumns({"x": x, "y": y}), F.col("x"), F.col("y")).orderBy("rank")
    assert [r["pos"] for r in got.collect()] == [3, 2, 4, 0, 5, 1]


def test_assembled(spark):
    cases = [(["ab", "c", "longer text", "end-", "joined"], "abc\nlonger text\nend- joined"), (["x" * 101, "y"], "x" * 101 + "\ny"), ([" ", ""], ""), ([], "")]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t array<string>")
    assert [r[0] for r in df.orderBy("k").select(blocks.assembled(F.col("t"))).collect()] == [c[1] for c in cases]


def test_best_engine_ties(spark):
    df = spark.createDataFrame([("a", "one", 1, "xyz"), ("a", "two", 2, "abc"), ("b", "one", 1, " "), ("b", "two", 2, "q")], "image_id string, engine string, engine_pos int, text string")
    assert {tuple(r) for r in blocks.best_engine(df).collect()} == {("a", "one", "xyz"), ("b", "two", "q")}


def test_zip_is_cut(spark):
    df = spark.createDataFrame([(["a", "b"], [0.1, 0.2, 0.3])], "w array<string>, s array<double>")
    assert len(df.select(dictionary.zipped(F.col("w"), F.col("s"))).first()[0]) == 2


def test_upsert_and_suggest(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    events = spark.createDataFrame([("Word", "c1", "d", t(1), 1), ("Word", "c2", "d", t(3), 2), ("work", "c3", "d", t(2), 3)], "word string, context string, domain string, ts timestamp, seq long")
    state = dictionary.upsert(None, events)
    state = dictionary.upsert(state, events.where("seq = 1").withColumn("ts", F.lit(t(9))))
    got = {r["word"]: (r["frequency"], r["context"], r["created_at"]) for r in state.collect()}
    # Writing a word again replaces its row, the time of its making with it.
    assert got == {"Word": (3, "c1", t(9)), "work": (1, "c3", t(2))}
    assert [r["word"] for r in dictionary.suggestions(state, "wor").collect()] == ["Word", "work"]


def test_repaired(spark):
    words = spark.createDataFrame([("hello", 5, dt.datetime(2024, 1, 1)), ("help", 9, dt.datetime(2024, 1, 1))], "word string, frequency long, last_used timestamp")
    tokens = spark.createDataFrame([(1, 0, "hellp", 0.1), (1, 1, "sure", 0.9), (1, 2, "zzz", 0.2)], "doc_id int, pos int, word string, score double")
    assert {r["pos"]: r["out"] for r in dictionary.repaired(tokens, words).collect()} == {0: "[help]", 1: "sure", 2: "(zzz)"}


def test_running_mean_skips_nulls(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, 1.0, 3.0, None, 5.0])], "k long, v double")
    got = analytics.running_mean(df, "k", F.col("v"), parts=2).orderBy("k")
    assert [r["running_mean"] for r in got.collect()] == [None, 1.0, 2.0, 2.0, 3.0]
    assert analytics.running_mean(df.limit(0), "k", F.col("v")).count() == 0


def test_batch_stats_of_nothing(spark):
    df = spark.createDataFrame([], "ok boolean, s double")
    assert tuple(analytics.batch_stats(df, F.col("ok"), F.col("s")).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_trends_as_lists(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d), 0.5, float(d)) for d in (1, 2, 2)], "created_at timestamp, accuracy double, processing_time double")
    got = analytics.columnar(analytics.daily_trends(df)).first()
    assert got["n"] == [2, 1] and got["day"][0] == dt.date(2024, 1, 2)


@given(st.integers(0, 2**32 - 1))
def test_image_kernels(seed):
    a = np.random.default_rng(seed).integers(0, 256, (9, 12), dtype=np.uint8)
    k = 3
    slow = np.array([[np.median(np.pad(a, 1, mode="edge")[y : y + k, x : x + k]) for x in range(12)] for y in range(9)]).astype(np.uint8)
    assert (images.median_blur(a, k) == slow).all()
    mean = np.array([[np.pad(a, 1, mode="edge")[y : y + k, x : x + k].mean() for x in range(12)] for y in range(9)])
    assert np.allclose(images.box_mean(a, k), mean)
    assert set(np.unique(images.threshold(a))) <= {0, 255}
    assert (images.erode(a, 3) <= a).all() and (images.dilate(a, 3) >= a).all()
    assert 0 <= images.quality(a) <= 1
    assert images.invert_if_dark(a).mean() >= 127 or a.mean() >= 127
    assert images.level(a, 0).shape == a.shape and min(images.level(a, 1).shape) == 600


def test_specks():
    a = np.zeros((12, 12), np.uint8)
    a[0, 0], a[4:9, 4:9] = 255, 255
    out = images.drop_specks(a)
    assert out[0, 0] == 0 and (out[4:9, 4:9] == 255).all()


def test_image_pass(spark):
    good = bytes(range(200)) + bytes(100)
    df = spark.createDataFrame([("a", 10, 10, 3, good), ("b", 10, 10, 3, b"x")], "image_id string, height int, width int, channels int, data binary")
    got = {r["image_id"]: r for r in images.preprocess(df, (images.grey,)).collect()}
    assert got["a"]["channels"] == 1 and len(got["a"]["data"]) == 100 and got["b"]["data"] is None and got["b"]["quality"] == 0.5


def test_engines(spark):
    def broken():
        def read(image):
            raise OSError("no model")

        return read

    engines.register("broken", broken)
    df = spark.createDataFrame([("a",), ("b",)], "image_id string")
    assert engines.recognise(df, "broken", "stub").where("text is not null").count() == 4
    failed = engines.recognise(df, "broken").collect()
    assert all(r["error"] == "OSError: no model" and r["pos"] is None for r in failed)
    found = blocks.engine_result(engines.recognise(df, "stub"))
    assert found.first()["text"] == "샘플\n텍스트" and found.count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.PNG", "sub/b.jpeg", "c.txt", "noext"):
        (tmp_path / name).write_bytes(b"123")
    (tmp_path / "big.png").write_bytes(b"1" * 50)
    got = files.scan_folder(spark, str(tmp_path), largest=10).select(files.basename(F.col("path"))).collect()
    assert sorted(r[0] for r in got) == ["a.PNG", "b.jpeg"]
    stream = files.stream_folder(spark, str(tmp_path), largest=10).select("path").writeStream.format("memory").queryName("found_files").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("found_files").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x/a.png", 1, "one"), ("y/a.png", 2, "two"), ("b.png", 3, " ")], "path string, seq int, text string")
    assert {tuple(r) for r in sinks.latest(df, "path", "seq", "text").collect()} == {("a.png", "two"), ("b.png", " ")}
    assert sinks.report(df, "path", "text", "seq").first()[0].startswith("=== x/a.png ===\none\n\n=== y/a.png ===")
    assert df.where("seq = 3").select(sinks.message(F.col("text"))).first()[0] == sinks.NO_TEXT
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert '"seq":1' in sinks.as_json(df.where("seq = 1")).first()[0]


def test_word_stream(spark, tmp_path):
    schema = "word string, context string, domain string, ts timestamp, seq long"
    for k in range(2):
        spark.createDataFrame([("w", "c", "d", dt.datetime(2024, 1, 1 + k), k)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = ingest.merge_words(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    states = sorted((tmp_path / "state").iterdir())
    assert spark.read.parquet(str(states[-1])).first()["frequency"] == 2


@pytest.mark.parametrize("value, low, high", [("", 0, 0), ("한글 문장입니다.", 0.8, 1), ("？" * 200, 0, 0)])
def test_text_quality(spark, value, low, high):
    got = spark.createDataFrame([(value,)], "t string").select(quality.text_quality(F.col("t"))).first()[0]
    assert low <= got <= high


def test_more_kernels():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 60), dtype=np.uint8)
    flat = np.full((40, 60), 90, np.uint8)
    for f in (images.gaussian, images.bilateral, images.contrast, images.sharpness, images.sharpen_kernel, images.wavelet_shrink, lambda x: images.nonlocal_means(x, search=5)):
        assert f(a).shape == a.shape and (f(flat) == 90).all()
    assert images.clahe(a).shape == a.shape
    assert (images.rotate(a, 0) == a).all() and (images.rotate(a, 90) == np.rot90(a, 1)).all() or (images.rotate(a, 90) == np.rot90(a, -1)).all()
    page = np.full((200, 300), 255, np.uint8)
    page[20:180:20, 20:280] = 0
    assert images.skew(page) == 0
    leaning = images.rotate(page, 3)
    assert abs(abs(images.skew(leaning)) - 3) <= 0.5 and abs(images.skew(images.deskew(leaning))) <= 0.5
    assert 0 <= images.page_score(page) <= 100 and images.best_preset(page)[0] in images.PRESETS
    for name in images.PIPELINES:
        out = a
        for step in images.pipeline(name, leave_out=("scale", "fit")):
            out = step(out)
        assert out.ndim == 2


def test_tuner_and_stages(spark):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 256, (30, 40), dtype=np.uint8) for _ in range(3)]
    df = spark.createDataFrame([(str(k), 30, 40, 1, a.tobytes()) for k, a in enumerate(pages)] + [("x", 30, 40, 1, None)], "image_id string, height int, width int, channels int, data binary")
    sets = images.parameter_sets(4, 1)
    means = [np.mean([images.page_score(images.apply_preset(a, p)) for a in pages]) for p in sets]
    best, score = images.tune(df, 4, 1)
    assert best == sets[int(np.argmax(means))] and score == pytest.approx(max(means))
    assert images.tune(df.limit(0), 4, 1) == (images.PRESETS["clean"], 0.0)
    got = {(r["image_id"], r["stage"]): r["data"] for r in images.stages(df, "conservative").collect()}
    a = images.median_blur(images.clahe(pages[0], 1.2))
    assert len(got) == 12 and got["0", "denoise"] == a.tobytes() and got["0", "sharpen"] == images.mild_sharpen(a).tobytes()


def test_resizing():
    a = np.random.default_rng(1).integers(0, 256, (24, 36), dtype=np.uint8)
    flat = np.full((24, 36), 77, np.uint8)
    for kind in ("linear", "cubic", "area", "lanczos"):
        for scale in (0.5, 1.0, 1.7):
            out = images.resize(a, scale, kind)
            assert out.shape == (round(24 * scale), round(36 * scale)) and (images.resize(flat, scale, kind) == 77).all()
        assert (images.resize(a, 1.0, kind) == a).all()
    half = images.resize(a, 0.5, "area")
    assert (half == np.rint(a.reshape(12, 2, 18, 2).mean(axis=(1, 3)))).all()


def test_edges_and_lines():
    a = np.zeros((200, 160), np.uint8)
    a[:, 80:] = 255
    edges = images.canny(a, 50, 150)
    assert set(np.flatnonzero(edges.any(axis=0))) <= {79, 80} and (edges > 0).sum() >= 200
    rho, theta = images.hough_lines(edges)[0]
    assert theta == 0 and abs(rho - 79.5) <= 1
    page = np.full((300, 300), 255, np.uint8)
    page[30:270, 40:260:30] = 0
    page[30:270, 41:261:30] = 0
    for turn in (4, -4):
        leaning = images.rotate(page, turn)
        assert abs(abs(images.lean(leaning)) - 4) <= 1 and abs(images.lean(images.deskew(leaning))) <= 1
    assert images.deskew(np.full((50, 50), 9, np.uint8)).shape == (50, 50)


@given(st.integers(0, 2**32 - 1))
def test_spots(seed):
    a = np.random.default_rng(seed).random((7, 9)) < 0.5
    for corners in (False, True):
        number, seen = images.spots(a, corners), {}
        for y, x in np.argwhere(a):
            todo, spot = [(y, x)], {(y, x)}
            while todo:
                i, j = todo.pop()
                for u, v in ((-1, 0), (1, 0), (0, -1), (0, 1), *(((-1, -1), (-1, 1), (1, -1), (1, 1)) if corners else ())):
                    at = (i + u, j + v)
                    if 0 <= at[0] < 7 and 0 <= at[1] < 9 and a[at] and at not in spot:
                        spot.add(at)
                        todo.append(at)
            seen[frozenset(spot)] = None
            assert len({number[p] for p in spot}) == 1
        assert len(np.unique(number[a])) == len(seen) and (number[~a] == 0).all()


def test_specks_count_against_a_page():
    clean = np.full((100, 100), 255, np.uint8)
    clean[40:60, 40:60] = 0
    dirty = clean.copy()
    dirty[::3, ::3][dirty[::3, ::3] == 255] = 254  # specks without an edge
    loss = images.page_score(clean) - images.page_score(dirty)
    ink = (dirty == 254).sum()
    assert ink > 900 and loss > 9


def test_ranges_hold_like_many_rows(spark):
    """Orders that lie close together in one place and far apart in another."""
    rows = [(k, float(k)) for k in range(1000)] + [(10**9 + 10**6 * k, 1.0) for k in range(30)] + [(None, 2.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    sizes = df.groupBy(analytics._ranges(df, "k", 16).alias("p")).count().where("p >= 0").collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 2 * 1030 / 16
    got = {r["k"]: r["done"] for r in analytics.progress(df, "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted((k for k, _ in rows), key=lambda k: (k is not None, k)))}


def test_hooks(spark):
    df = spark.createDataFrame([(1, "안녕ㅋㅋㅋㅋ 하하하하.  좋다!"), (2, None)], "doc_id long, text string")
    got = text.sentences(df, "text", lambda t: [x + "." for x in t.split(".")]).orderBy("doc_id").collect()
    assert got[0]["text"] == "안녕ㅋㅋ 하하. 좋다!." and text.sentences(df, "text") is df
    docs = spark.createDataFrame([(1, "나는 학교 에 간다. 그것은 좋다.")], "doc_id long, text string")
    seen = text.worker(docs, analyze=lambda s: [("새말", "NNG"), ("은", "JX"), ("길고긴단어입니다", "NNG")], split=lambda t: [t]).first()["text"]
    assert "새말은" in seen and "새말은" not in text.worker(docs).first()["text"]


def test_snapshot(spark):
    got = spark.range(1).select(sinks.snapshot(F.lit("본문"), "결과", F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0]
    assert got == "결과 - 2024-01-02 03:04:05\n텍스트 길이: 2자\n" + "=" * 60 + "\n\n본문"


def test_stub_has_a_score_too_many():
    assert [(w, s) for _, w, s in engines.stub()(None)] == [("샘플", 0.8), ("텍스트", 0.9)] and len(engines.STUB_SCORES) == 3
    assert engines.PARAMETERS["page"]["paragraph"] and engines.PARAMETERS["plain"] == {}


def test_flat_results(spark):
    df = spark.createDataFrame([("a", True, "t", "r", None, 1.0, (0.5, 0.6, 0.55), (2, 1, True, False), None), ("b", False, None, None, None, 2.0, None, None, "broke")], results.NESTED)
    got = {r["image_id"]: r for r in results.flat(df).collect()}
    assert got["a"]["text"] == "t" and got["a"]["confidence"] == 0.55 and got["a"]["error"] is None
    assert got["b"]["text"] == "" and got["b"]["error"] == "broke" and not got["b"]["success"]
    assert results.options({"x": {"y": 1, "z": 2}, "k": 1}, {"x": {"y": 5}}) == {"x": {"y": 5}, "k": 1}
    assert results.availability(["legacy"])["recommended"] == "legacy"
