"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import os
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillworks.llm import decontaminate, licenses, mixing, quality, queries, sharding, simhash, substrings, tokens, topk, toxicity
from quillworks.llm.common import Scratch, components, id_filter, without

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, copies string, fold string"


def frame(spark, rows):
    """(doc_id, text, source) as documents, with more columns whose names the operators use."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y", "z", "w") for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = make(70), make(200)
    out = [(k, make(rng.choice([1, 3, 30, 120])), f"s{k % 5}") for k in range(40)]
    out += [(100 + k, make(40) + "\n" + shared + "\t" + make(20), "s0") for k in range(8)]
    near = base.split()
    for k in range(12):
        some = near[:]
        some[rng.randrange(len(some))] = "changed"
        out.append((200 + k, " ".join(some), "s0"))
    out += [(300 + k, base, "s1") for k in range(6)]
    out += [(400, None, None), (401, "", None), (402, "   \n", "s2"), (403, make(30_000), "s3"), (None, base, "s4"), (None, None, None), (5, "again", "s1"), (300, base, "s1"), (300, base, "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def bag(it):
    return sorted(map(repr, it))


# ---- op1 ----


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = tokens.write_token_files(docs, path, str(tmp_path), 2)
    got = tokens.read_token_files(spark, manifest).orderBy("start").collect()
    want, starts = {}, 0
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == bag((d, *x) for d, some in want.items() for x in some)
    assert [r["doc_id"] for r in got] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d))
    for r in got:
        assert r["start"] == starts
        starts += r["n_tokens"]
    assert json.loads(open(manifest).read())["tokens"] == starts


def test_encoder_is_the_library(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, alphabet = random.Random(1), "aAbBéÉßſİıΣσς ..,,!!''sStT12\t\n　́|#$ªºǅfi×÷»…̇ 中🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = tokens.Encoder(public_tokenizers.path(name))
        assert encoder.by_word == name.startswith("word")
        library = Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(2):  # fresh, then remembered
            got = [ids[b - n : b].tolist() for ids, sizes in encoder.arrays(pa.array(texts), 2) for b, n in zip(np.cumsum(sizes), sizes, strict=True)]
            assert got == [[*x.ids, 2] for x in library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_tells_words_of_one_hash_apart():
    """The Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64, whatever the base; in one text, in later ones, and after each other."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillworks.llm import textnum

    path = public_tokenizers.path("word_bpe_49k.json")
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    both = np.frombuffer((one + two).encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    assert len(set(textnum.spans(both, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    for texts in ([f"{one} {two} x {one}"], [one], [two, one], [f"{two} {two}", "x y", one]):
        got = [ids[b - n : b].tolist() for ids, sizes in encoder.arrays(pa.array(texts), 2) for b, n in zip(np.cumsum(sizes), sizes, strict=True)]
        assert got == [[*x.ids, 2] for x in library.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_nothing(spark, docs, tmp_path):
    import public_tokenizers

    manifest = tokens.write_token_files(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path), 2)
    assert tokens.read_token_files(spark, manifest).count() == 0
    with pytest.raises(ValueError):
        tokens.local_folder("hdfs://somewhere/x")


# ---- op2, op9 ----


def labelled(spark, n=600, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"w{rng.randrange(300)}" for _ in range(300)], ["vile", "nasty", "rotten"]
    texts, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.25
        some = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic):
            some.insert(rng.randrange(len(some)), rng.choice(bad))
        good = rng.random() < 0.6
        texts.append((k, " ".join(some if good else [w.upper() + "###" for w in some]), "s"))
        labels.append((k, int(good), int(toxic)))
    texts += [(n, None, "s"), (n + 1, "", "s"), (n + 2, "vile nasty rotten vile nasty", "s"), (None, "nasty", None)]
    labels += [(0, None, None), (None, 1, 1), (1, labels[1][1], labels[1][2])]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels[:n]


def area(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("what, at", [("toxic", 2), ("quality", 1)])
def test_classifiers_on_held_out_rows(spark, what, at):
    texts, labels, truth = labelled(spark)
    out = toxicity.toxicity(texts, labels) if what == "toxic" else quality.quality(texts, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == texts.count()
    folds, held = (5, 0) if what == "toxic" else (3, 1)
    for d, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (None if d is None else zlib.crc32(str(d).encode()) % folds == held)
    pairs = [(got[x[0]]["score"], x[at]) for x in truth if got[x[0]]["held_out"]]
    assert len(pairs) > 80 and area(pairs) > 0.95
    if what == "toxic":
        assert got[602]["predicted"] == 1 and got[601]["predicted"] == 0
        kept = toxicity.drop_toxic(texts, labels)
        assert kept.columns == texts.columns
        assert {r[0] for r in kept.select("doc_id").collect()} == {d for d, r in got.items() if not (r["predicted"] and d is not None)}


def test_classifiers_without_evidence(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity(docs, none), quality.quality(docs, none)):
        assert {r["score"] for r in out.collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0 and quality.quality(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("name, run, folds, held", [("toxic", toxicity.toxicity, 5, 0), ("quality", quality.quality, 3, 1)])
def test_held_out_labels_are_not_read(spark, name, run, folds, held):
    texts, labels, _ = labelled(spark, 300)
    turned = labels.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, 1 - F.col(name)).otherwise(F.col(name)))
    learnt = labels.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.col(name)).otherwise(1 - F.col(name)))
    scores = lambda x: {r["doc_id"]: round(r["score"], 12) for r in run(texts, x).collect()}
    assert scores(labels) == scores(turned) != scores(learnt)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_on_repeated_and_long_texts(spark, run):
    texts, labels, _ = labelled(spark, 200)
    rows = [(r["doc_id"], r["text"], "s") for r in texts.collect()]
    more = [*rows, (7, rows[7][1], "s"), (7, "another text of the same id", "s"), (900, " ".join(f"w{k % 300}" for k in range(50_000)), "s"), (901, "x" * 300_000, "s"), (902, "\u4f60\u597d" * 2000, "s")]
    got = run(frame(spark, more), labels).collect()
    assert bag(r["doc_id"] for r in got) == bag(d for d, _, _ in more)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 2 and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("ordinary, between", [(-1.0, 2.5), (-1.0, 3.5), (0.0, 3.5), (0.0, 1.0)])
def test_calibration_settles_on_classes_that_lie_far_apart(ordinary, between):
    """Whole Newton steps swing there and end with a slope of 0, which calls nothing toxic."""
    x, n, ones = np.array([ordinary, between, 4.5]), np.array([3845.0, 18, 357]), np.array([0.0, 3, 357])
    slope, base = toxicity.logistic(x, n, ones)
    p = 1 / (1 + np.exp(-(slope * x + base)))
    assert ((ones - n * p) * x).sum() - 1e-3 * slope == pytest.approx(0, abs=1e-3) and (ones - n * p).sum() == pytest.approx(0, abs=1e-3)
    assert (p >= 0.5).tolist() == [False, False, True]
    slope, base = toxicity.logistic(-x, n, ones)  # the wrong way round: the share of ones everywhere
    assert slope == 0 and base == pytest.approx(np.log(361 / 3861))


def plain_kneser_ney(docs, discount=0.75, weight=5.0, least=3):
    """(text, class) to each word's log ratio, step by step."""
    split = lambda t: [w for w in re.split(rb"[^a-z0-9\x80-\xff]+", t.lower().encode()) if w]
    contexts = {(c, p, w) for t, c in docs for p, w in zip([b"", *split(t)], split(t))}
    count = {}
    for c, _, w in contexts:
        for k in range(len(w) + 1):
            node = (*w, "end")[: k + 1]
            count.setdefault(node, [0, 0])[c] += 1
    kids = {}
    for node, n in count.items():
        kids.setdefault(node[:-1], []).append(n)

    def ratio(w):
        total, chain = 0.0, (*w, "end")
        for k in range(len(chain)):
            n, below = count.get(chain[: k + 1], [0, 0]), kids.get(chain[:k], [])
            whole = [sum(x[c] for x in below) for c in (0, 1)]
            if sum(n) < least or not all(whole) or sum(n) == sum(whole):
                continue
            shared = sum(n) / sum(whole)
            p = [(max(n[c] - discount, 0) + (discount * sum(x[c] > 0 for x in below) + weight) * shared) / (whole[c] + weight) for c in (0, 1)]
            total += np.log(p[1] / p[0])
        return total

    return lambda t: [ratio(w) for w in split(t)]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_margins_are_those_of_two_kneser_ney_models(spark, most):
    """With all nodes in memory, and with most of them left to the join."""
    texts, labels, _ = labelled(spark, 250)
    rows = {r["doc_id"]: r["text"] for r in texts.collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    y = {r["id"]: r["y"] for r in toxicity.clear_labels(labels, "toxic").collect()}
    model = plain_kneser_ney([(rows[d], c) for d, c in y.items() if d in rows and fold(d) > 1])
    odd = [(d, t) for d, t in rows.items() if d is not None] + [(1000, "vile rottenness vilely, nasty-nasty W7###"), (1001, "\u4f60\u597d vile")]
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, [(d, t, "s") for d, t in odd]), labels, most=most).collect()}
    for d, t in odd:
        ratios = model(t or "")
        assert got[d]["words"] == len(ratios)
        assert got[d]["margin"] == pytest.approx(float(np.mean(np.log1p(0.005 * np.expm1(ratios)))) if ratios else 0.0, abs=1e-12)


def test_quality_fits_what_numpy_fits(spark):
    """The normal equations by partition and the isotonic curve against plain numpy on the same features."""
    rng = np.random.default_rng(5)
    x, n = np.sort(rng.normal(size=40)), rng.integers(1, 9, 40)
    ones = rng.binomial(n, 1 / (1 + np.exp(-2 * x)))
    knots, share = quality.isotonic(x, n.astype(float), ones.astype(float))
    assert (np.diff(knots) > 0).all()
    fit = np.array([max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)])  # the min-max formula
    pools = [list(g) for g in np.split(np.arange(40), np.flatnonzero(np.diff(fit)) + 1)]
    assert knots == pytest.approx([np.average(x[g], weights=n[g]) for g in pools])
    assert share == pytest.approx([(ones[g].sum() + 0.5) / (n[g].sum() + 1) for g in pools])
    features = quality.Features(np.zeros(3), np.ones(3), count=2000, sigma=1.5)
    a, b = rng.normal(size=(2, 50, 3))
    kernel = np.exp(-((a - b) ** 2).sum(axis=1) / (2 * 1.5**2))
    assert np.abs((features(a)[:, :-1] * features(b)[:, :-1]).sum(axis=1) - kernel).max() < 0.12


# ---- op3 ----


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, None: 7}, {"a": 0, "b": 5}, {"a": 0}, {"a": 3, "b": 1, "c": 1, "d": 1000}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight, total = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, sum(sizes.values())
    target = {s: 0.0 for s in sizes}
    free, rest = [s for s in sizes if sizes[s]], total
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        for s in over or free:
            target[s] = 3 * sizes[s] if over else share[s]
        rest -= sum(3 * sizes[s] for s in over)
        free = [s for s in free if s in over] and [s for s in free if s not in over]
    assert got == pytest.approx(target)


def test_quality_is_a_plain_fit(spark):
    """The scores of quality() against numpy on one pile of rows: features, normal equations, curve."""
    texts, labels, _ = labelled(spark, 500, 3)
    got = {r["doc_id"]: r["score"] for r in quality.quality(texts, labels).where("doc_id is not null").collect()}
    stats = texts.select("doc_id", "text").mapInArrow(quality._statistics, "id long, x array<float>").where("id is not null or true").collect()
    every = np.array([r["x"] for r in stats], float)
    features = quality.Features(every.mean(axis=0), every.std(axis=0))
    x = {r["id"]: np.asarray(r["x"], float) for r in stats if r["id"] is not None}
    known = {r["id"]: r["y"] for r in toxicity.clear_labels(labels, "quality").collect() if zlib.crc32(str(r["id"]).encode()) % 3 != 1}
    part = {r[0]: r[1] for r in texts.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(5))).collect()}
    fit, curve = ([d for d in known if (part[d] > 0) == first] for first in (True, False))
    z = features(np.stack([x[d] for d in fit]))
    weights = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ np.array([known[d] for d in fit], float))
    raw = {d: float((features(v[None]) @ weights)[0]) for d, v in x.items()}
    bins = {}
    for d in curve:
        bins.setdefault(min(max(int(np.floor((raw[d] + 0.5) / 2 * 256)) + 1, 0), 257), []).append((raw[d], known[d]))
    told = np.array([(np.mean([a for a, _ in b]), len(b), sum(y for _, y in b)) for _, b in sorted(bins.items())])
    knots, share = quality.isotonic(*told.T)
    want = {d: 0.998 * np.interp(v, knots, share) + 0.002 / (1 + np.exp(-v)) for d, v in raw.items()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in got) < 1e-6


def test_mix_spreads_rows_without_an_id(spark):
    """They stand at different places of their source, so they share its ranges."""
    rows = frame(spark, [(None, "a b c", "s")] * 400 + [(k, "a b", "t") for k in range(100)])
    out = mixing.plan_mix(rows, rows_per_range=10, row=None)
    assert out.count() == 500 and out.agg(F.sum("taken")).first()[0] <= 1400
    heights = [r[0] for r in out.where("source = 's'").select("finish").collect()]
    assert len(set(heights)) == 400
    order = spark.range(1000).select(mixing.md5_order(F.lit(None).cast("long"), "mix", F.col("id")).alias("h"))
    assert order.distinct().count() == 1000


def test_mix(spark, docs, rows):
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    again = mixing.plan_mix(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["source"], r["size"], r["taken"])
    assert bag(map(key, got)) == bag(map(key, again))
    largest = max(r["size"] for r in got)
    for s in {r["source"] for r in got}:
        some = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in some) == some[0]["source_size"]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= largest
        assert all(r["taken"] <= 3 * r["size"] for r in some)
    assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


# ---- op4, op5 ----


def test_contaminated(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    common = [f"c{k}" for k in range(20)]
    prose = lambda n: [rng.choice(words) if rng.random() < 0.5 else rng.choice(common) for _ in range(n)]
    items = {k: prose(rng.choice([12, 30, 70, 300])) for k in range(30)}
    texts, want = [], set()
    for k in range(150):
        t = prose(rng.choice([20, 200, 900]))
        if k % 3 == 0:
            item = rng.randrange(30)
            leak = items[item][:]
            if k % 2:  # a paraphrase: a few words dropped or changed
                for _ in range(len(leak) // 12):
                    leak[rng.randrange(len(leak))] = "other"
            at = rng.randrange(len(t))
            t[at:at] = leak
            want.add((k, item))
        texts.append((k, " ".join(t).upper() if k % 5 == 0 else " ".join(t), "s"))
    texts += [(900, None, "s"), (901, "", "s"), (None, " ".join(items[3]), "s"), (0, "twice", "s")]
    bench = spark.createDataFrame([*((k, " ".join(v)) for k, v in items.items()), (99, None), (98, ""), (None, "x y z")], "item_id long, text string")
    docs = frame(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want | {(None, 3)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r[0] for r in kept.select("doc_id").collect()} == {d for d, _, _ in texts} - {d for d, _ in want} and kept.columns == docs.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_contaminated_finds_all_that_brute_force_finds(spark, monkeypatch):
    """Every pair above the limits, even where the basis tells little of its words: short items, 0.6 to 0.85 of whose words stay in order among rare words of other items."""
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda sample, rows, words, rank: np.linalg.qr(np.random.default_rng(1).normal(size=(words, 16)))[0])
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    common = [f"c{k}" for k in range(40)]
    prose = lambda n: [rng.choice(words) if rng.random() < 0.5 else rng.choice(common) for _ in range(n)]
    items = [prose(rng.choice([15, 18, 29])) for _ in range(120)]
    rare = [w for item in items for w in item if w not in common]
    texts = []
    for k in range(120):
        item = rng.choice(items)
        kept = sorted(rng.sample(range(len(item)), round(len(item) * rng.uniform(0.6, 0.85))))
        leak = [w for i in kept for w in ([rng.choice(rare)] if rng.random() < 0.3 else []) + [item[i]]]
        texts.append(rng.choices(rare, k=80) + leak + rng.choices(rare, k=80))
    docs = frame(spark, [(k, " ".join(t), "s") for k, t in enumerate(texts)])
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}

    df = {w: 0 for item in items for w in item}
    for t in texts:
        for w in set(t) & df.keys():
            df[w] += 1
    stride, want = {}, {}
    for block in decontaminate.blocks_of(bench):
        stride |= dict.fromkeys(block.items, block.stride)
    for k, t in enumerate(texts):
        for j, item in enumerate(items):
            # The rarest quarter; ties in the item's order, as of its inverse document frequencies.
            answer = {item[i] for i in sorted(range(len(item)), key=lambda i: (df[item[i]], i))[: -(-len(item) // 4)]}
            for at in range(0, max(1, len(t) - stride[j]), stride[j]):
                passage = t[at : at + 2 * stride[j]]
                held = set(passage)
                if len(held.intersection(item)) < 5 or sum(w in held for w in item) < 0.6 * len(item):
                    continue
                share = decontaminate.lcs(np.array(item), np.array(passage)) / len(item)
                if share >= 0.6 and (share >= 0.85 or len(answer & held) / len(answer) >= 0.75):
                    want[k, j] = max(share, want.get((k, j), 0))
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(r["lcs"] == want[p] for p, r in got.items())


def test_the_basis_comes_from_all_documents(spark, monkeypatch):
    """Every document with a word of the benchmark is a row of the matrix, weighed by the frequencies of all, and the sums by task give what numpy gives on the whole matrix."""
    rng = random.Random(8)
    items = [[f"w{rng.randrange(40) + 40 * k}" for _ in range(12)] for k in range(8)]
    texts = [[f"w{rng.randrange(40) + 40 * (k % 8)}" for _ in range(6 + k % 8)] + ["foreign"] for k in range(3000)] + [["foreign"], []]
    fit, seen = decontaminate.randomised_svd, []

    def told(corpus, rows, words, rank):
        got = corpus.collect()
        found = fit(corpus.repartition(7), rows, words, 8)
        seen.append((got, rows, found))
        return found

    monkeypatch.setattr(decontaminate, "randomised_svd", told)
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(items)], "item_id long, text string")
    decontaminate.contaminated(frame(spark, [(k, " ".join(t), "s") for k, t in enumerate(texts)]), bench).count()
    (block,) = decontaminate.blocks_of(bench)
    block.vocabulary, ((got, rows, found),) = sorted({w for v in items for w in v}), seen
    df = {w: sum(w in t for t in map(set, texts)) for w in block.vocabulary}
    want = []
    for t in texts:
        own = {w: (1 + np.log(t.count(w))) * np.log1p((len(texts) + 1) / (df[w] + 1)) for w in set(t) & df.keys()}
        if own:
            want.append([float(x / np.linalg.norm(list(own.values()))) for x in own.values()])
    assert len(got) == len(want) > 2500
    assert sorted(x for r in got for x in r["weight"]) == pytest.approx(sorted(x for w in want for x in w), abs=1e-5)
    dense = np.zeros((len(got), rows.shape[1]))
    for k, r in enumerate(got):
        dense[k, r["word"]] = r["weight"]
    whole = np.concatenate([rows, dense])
    basis = np.linalg.qr(np.random.default_rng(4).normal(size=(rows.shape[1], 20)))[0]
    for _ in range(3):
        total = whole.T @ (whole @ basis)
        basis, previous = np.linalg.qr(total)[0], basis
    values, vectors = np.linalg.eigh(previous.T @ total)
    right = (previous @ vectors)[:, np.argsort(-values)[:8]]
    assert np.linalg.svd(right.T @ found)[1] == pytest.approx(np.ones(8), abs=1e-3)


def test_items_of_odd_lengths(spark):
    """Items just over a piece leave no short tail; items under five words match nothing."""
    rng = random.Random(12)
    prose = lambda n: [f"q{rng.randrange(5000)}" for _ in range(n)]
    items = {k: prose(n) for k, n in enumerate([1, 2, 3, 4, 5, 6, 257, 385, 513, 1000])}
    texts = [(k, prose(300)) for k in range(40)] + [(100 + k, prose(50) + v + prose(50)) for k, v in items.items()]
    texts += [(200, prose(20) + items[9][240:510] + prose(20)), (300, items[6][:100]), (301, items[8][:90])]
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, [(d, " ".join(t), "s") for d, t in texts]), bench).collect()}
    assert got == {(100 + k, k) for k, v in items.items() if len(v) >= 5} | {(200, 9)}


@pytest.mark.parametrize("rank", [1, 64])
def test_the_gate_loses_no_match(rank):
    """Products in the completed basis are those of the TF-IDF vectors, and no match stays below its floor."""
    rng = np.random.default_rng(rank)
    words = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    block = decontaminate.Block(list(range(20)), [rng.choice(words, rng.integers(5, 40)) for _ in range(20)])
    block.idf = rng.uniform(0.5, 9, len(block.vocabulary))
    items = block.matrix()
    block.basis = decontaminate.completed(np.linalg.qr(rng.normal(size=(len(block.vocabulary), rank)))[0], items).astype(np.float32)
    block.ready(0.6)
    for j, piece in enumerate(block.pieces):
        for _ in range(20):
            kept = np.sort(rng.permutation(len(piece))[: block.needed[j]])
            word = np.searchsorted(block.vocabulary, np.concatenate([piece[kept], rng.choice(piece[kept], 3)]))
            _, word, weight, _ = block.weighted(np.zeros(len(word), np.int64), word, 1)
            product = weight @ block.basis[word] @ block.latent.T
            assert product == pytest.approx(weight @ items[:, word].T, rel=1e-5, abs=1e-3) and product[j] >= block.floor[j]


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 70))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b)) == table[-1][-1]


def test_licenses(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice(["lorem", "the", "software", "license", "of", "public", "rights"]) + str(rng.randrange(3) or "") for _ in range(n))
    texts, every = [], {**licenses.TEMPLATES, **licenses.WHOLE}
    for k in range(60):
        names = rng.sample(list(every), rng.choice([0, 1, 2]))
        texts.append((k, fill(rng.randint(0, 60)) + "".join("\n" + every[n] + "\n" + fill(rng.randint(0, 40)) for n in names), "s"))
    mit = licenses.TEMPLATES["mit-permission"].split()
    mit[8] = "CHANGED"
    texts += [(7, licenses.TEMPLATES["isc"], "s"), (104, fill(20_000) + " " + licenses.TEMPLATES["bsd"], "s"), (100, " ".join(mit), "s"), (101, None, "s"), (102, "", "s"), (103, "all RIGHTS, reserved", "s"), (None, licenses.TEMPLATES["mit"], "s")]
    texts += [(200 + k, fill(9) + "\nCopyright 2024\n" + t + "\n" + fill(9), "s") for k, t in enumerate(licenses.WHOLE.values())]
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = set()
    for d, t, _ in texts:
        w, held = split(t), []
        for name, template in every.items():
            p = split(template)
            width, step = min(5, len(p)), max(1, len(p) // 4)
            shingles = lambda x: {tuple(x[i : i + width]) for i in range(len(x) - width + 1)}  # noqa: B023, E731
            best = max(((len(shingles(p) & shingles(w[a : a + len(p) + step])) / len(shingles(p)), -a) for a in range(0, max(1, len(w) - width + 1), step)), default=(0, 0))
            if best[0] >= 0.8:
                held.append((name, best[0], -best[1], len(p)))
        want |= {(d, n) for n, c, a, m in held if not any(c2 > c and a2 < a + m and a < a2 + m2 for _, c2, a2, m2 in held)}
    docs = frame(spark, texts).withColumns({"license": F.lit("mine"), "word": F.lit(1)})
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()}
    assert got == want and len(want) > 50 and (100, "mit-permission") in want and {(200 + k, n) for k, n in enumerate(licenses.WHOLE)} <= want  # 20 of 25 shingles are left
    assert licenses.scan_licenses(frame(spark, texts).limit(0)).count() == 0


# ---- op6 ----


def test_shards(spark, docs, rows):
    got = sharding.shard_documents(docs).orderBy("start").collect()
    size = lambda t: len((t or "").encode()) + 8
    assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == bag((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in rows)
    total, start, slots = sum(r["size"] for r in got), 0, {}
    for r in got:
        assert r["start"] == start and r["shard"] == min(23, (2 * start + r["size"]) * 24 // (2 * total)) and r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        start += r["size"]
    assert [r["doc_id"] for r in got] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# ---- op7 ----


def test_shards_spread_equal_rows(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    for out in (sharding.shard_documents(rows), sharding.shard_rows(rows)):
        assert sorted(r[0] for r in out.groupBy("shard").count().select("count").collect())[0] >= 833
        assert out.groupBy("shard", "slot").count().where("count > 1").count() == 0
    made = max(Path(spark.conf.get("spark.checkpoint.dir")).glob("shards-*/rows"), key=os.path.getmtime)
    parts = [r[1] for r in spark.read.parquet(str(made)).groupBy(F.shiftright("_number", 33)).count().collect()]
    assert len(parts) == 4 and max(parts) < 10_000


def test_topk_of_empty_vectors(spark):
    """All scores are 0, so the smallest ids win."""
    rows = spark.createDataFrame([(k, []) for k in range(120)], "vec_id long, embedding array<float>")
    got = topk.exact_topk(rows).where("query_id = 100").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(k, 0) for k in range(10)]


def test_topk(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    vectors[rng.random(700) < 0.4] = vectors[1]
    rows = [(int(k), v.tolist(), 1) for k, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 16, 1), (1100, [None] + [0.0] * 15, 1), (1200, [float("inf")] * 16, 1), (None, vectors[2].tolist(), 1), (100, vectors[3].tolist(), 1), (1300, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = [(k, [int(np.floor(np.float64(x) * 1024)) for x in v]) for k, v, _ in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), k) for k, w in good if k != q)[:10]
            want += [(q, *x) for x in best]
    got = topk.exact_topk(df, rows=200, queries=3)
    one = [(r["query_id"], -r["score"], r["vec_id"]) for r in got.collect() if r["query_id"] != 100]
    assert bag(one) == bag(x for x in want if x[0] != 100)
    assert got.where("query_id = 100").count() == 10
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_components_that_overflow_are_refused(spark):
    for x in (1e15, -1e30, 3e7):
        with pytest.raises(ValueError):
            topk.exact_topk(spark.createDataFrame([(0, [x, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"))


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(3)
    for n, d in ((50, 8), (2500, 24), (900, 3)):
        v = np.floor(1024 * rng.normal(size=(n, d)) / np.sqrt(d)).astype(int)
        ids = rng.permutation(3 * n)[:n]
        index = topk.ImpactIndex(ids, v)
        for j in range(12):
            keep = np.arange(n) != j
            order = np.lexsort((ids[keep], -(v @ v[j])[keep]))[:10]
            assert index.search(v[j], int(ids[j]), 10) == list(zip(ids[keep][order].tolist(), (v @ v[j])[keep][order].tolist()))


# ---- op8 ----


def repeated(rows, window):
    first, out = {}, []
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_substrings(spark, docs, rows, batches):
    got = substrings.dedup_substrings(docs, batches=batches)
    assert bag((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == bag(repeated(rows, 50))


def test_scans_of_more_than_a_chunk():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 10, 400, 3000]))) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(1500)), "text": [None, *texts[1:]], "text_key": list(range(1500))})
    parts = list(substrings._scan(50)([batch]))
    out = pa.Table.from_batches(parts).to_pylist()
    assert len(parts) > 3 and [r["id"] for r in out] == list(range(1500))
    for r, t in zip(out[1:], texts[1:]):
        n = len(t.split())
        assert r["n_words"] == n and r["text"] == (t if n >= 50 else None) and bool(r["prints"]) == (n >= 50)
    shared = [[] if r["prints"] is None else r["prints"][:3] for r in out]
    rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([True] * 1500), batch.column(1), pa.array(shared, pa.list_(pa.int64()))], names=["id", "text_key", "mine", "text", "shared"])
    for part in substrings._windows(50)([rows]):
        for r in part.to_pylist()[:50]:
            words = texts[r["id"]].split()[r["start"] : r["start"] + 50]
            digest = np.frombuffer(hashlib.sha256(" ".join(words).encode()).digest()[:16], np.int64)
            assert (r["d1"], r["d2"]) == tuple(digest.tolist())


def test_runs_are_merged(docs, monkeypatch):
    """The registered query's number of batches compacts, and the next batch meets a merged run."""
    seen, drop = [], substrings.SubstringIndex.close

    def close(self):
        seen.append((self.merged, {k: [level for _, level in v] for k, v in self.runs.items()}))
        drop(self)

    monkeypatch.setattr(substrings.SubstringIndex, "close", close)
    substrings.dedup_substrings(docs).count()
    assert seen == [(2, {"h": [1, 0], "words_sha": [1, 0]})]


def test_an_index_is_reopened(spark, docs, rows, tmp_path):
    folder, got, some = str(tmp_path / "index"), [], docs.select(F.col("doc_id").alias("id"), "text")
    for k, part in enumerate((some.where("id < 102"), some.where("id >= 102 and id < 205"), some.where("id >= 205 or id is null"))):
        index = substrings.SubstringIndex(spark, folder)  # as another session would
        assert len(index.batches) == k
        got += index.add(part, Scratch(spark, "t")).collect()
        index.close()
    assert bag((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == bag(repeated(rows, 50))
    with pytest.raises(ValueError):
        substrings.SubstringIndex(spark, folder, window=20)


def test_windows_with_one_print_are_told_apart(spark):
    """Windows may share their least run of ten words and differ elsewhere: only equal words go."""
    rng = random.Random(6)
    core = [f"k{rng.randrange(1000)}" for _ in range(45)]
    rows = [(k, " ".join([f"a{k}{j}" for j in range(12)] + core + [f"z{k}{j}" for j in range(12)]), "s") for k in range(6)]
    rows += [(10, " ".join(["x", *core, *(f"t{j}" for j in range(9))]), "s"), (11, " ".join(["y", *core, *(f"t{j}" for j in range(9))]), "s")]
    got = substrings.dedup_substrings(frame(spark, rows), batches=2).collect()
    assert bag((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == bag(repeated(rows, 50))


def test_substrings_by_ids_that_are_text(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(f"id{k:02d}", " ".join(words[k : k + 60]) if k < 20 else " ".join(reversed(words)), "s") for k in range(30)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id string, text string")
    numbers = spark.createDataFrame([(int(d[2:]), t) for d, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:4] for r in substrings.dedup_substrings(docs).collect()}
    want = {f"id{r['doc_id']:02d}": tuple(r)[1:4] for r in substrings.dedup_substrings(numbers).collect()}
    assert got == want and any(x[1] for x in got.values())


def test_substrings_of_nothing(docs):
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


# ---- op10 ----


def simple_fingerprint(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_simhash(spark, docs, rows):
    fps = [simple_fingerprint(t) for _, t, _ in rows]
    roots = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (d, _, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    got = simhash.simhash_components(docs).collect()
    assert bag((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == bag((d, f, least.get(r)) for (d, _, _), f, r in zip(rows, fps, roots, strict=True))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_dense_runs_stay_connected():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(7) << rng.integers(0, 60, 300).astype(np.uint64)))
    links = [tuple(x) for part in simhash._spanning(fps, 4) for x in part.tolist()]
    at = {int(x): k for k, x in enumerate(fps)}
    n = len(fps)
    every = union(n, [(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1])
    some = union(n, [(at[a], at[b]) for a, b in links])
    groups = lambda r: {frozenset(np.flatnonzero(np.array(r) == x).tolist()) for x in set(r)}
    assert groups(every) == groups(some) and len(links) < n


def test_segments_find_four_bits():
    """Any two fingerprints that differ in up to four bits share a key: in some segment one bit differs at most."""
    rng = random.Random(8)
    for _ in range(500):
        bits = rng.sample(range(64), rng.randint(0, 4))
        assert min(sum(a <= b < z for b in bits) for a, z in simhash.SEGMENTS) <= 1


# ---- shared ----


def test_components_on_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(-5, 7)]
    got = {r["node"]: r["root"] for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == -5 for k in range(61)) and all(got[100 + k] == 100 for k in range(40))
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filters(spark, docs):
    ids = spark.createDataFrame([(300,), (5,)], "id long")
    assert {r[0] for r in without(docs, "doc_id", ids).select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - {300, 5}
    assert {300, 5} <= {r[0] for r in id_filter(docs, "doc_id", ids).select("doc_id").collect()}
    assert without(docs, "doc_id", ids.limit(0)).count() == docs.count()


def test_columns_keep_their_names(spark, docs, rows):
    """Columns named like the helpers' own come through, and so do maps."""
    names = ["_word", "_bits", "_maybe", "_id", "_place", "_n", "_copies", "_copy", "_amount", "_source", "_limits", "_row", "_h", "_crc", "_size", "_number", "_part", "_before", "bit", "fp", "pair"]
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, rows[0][1] or "a b c d e f")], "item_id long, text string")
    for out in (toxicity.drop_toxic(more, labels), simhash.drop_near_duplicates(more), decontaminate.drop_contaminated(more, bench), mixing.mix_documents(more), sharding.shard_rows(more)):
        assert [c for c in out.columns if c not in ("shard", "slot")] == more.columns
        for r in out.collect():
            assert all(r[n] == (None if r["doc_id"] is None else n + str(r["doc_id"])) for n in names) and r["m"] == {"a": r["doc_id"]}


def test_mix_is_its_plan(spark, docs, rows):
    """Texts are taken by the last row of their source: as often as the plan says, row by row."""
    plan = {}
    for r in mixing.plan_mix(docs).collect():
        key = (r["doc_id"], r["source"], r["size"])
        plan[key] = plan.get(key, 0) + r["copies"]
    got = {}
    for r in mixing.mix_documents(docs).collect():
        key = (r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in plan.items() if n}
    same = frame(spark, [(1, "one two three", "a")] * 9 + [(None, "four five", "a")] * 5 + [(2, "six", "b"), (3, "", "c"), (4, None, None)])
    assert mixing.mix_documents(same).count() == sum(r["copies"] for r in mixing.plan_mix(same).collect())
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_shard_rows_is_its_plan(docs):
    plan = bag((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs).collect())
    assert bag((r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in sharding.shard_rows(docs).collect()) == plan
    assert sharding.shard_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetch_df()
    got = queries.queries()[name](spark, data).toPandas()[list(want.columns)]
    assert bag(got.astype(str).values.tolist()) == bag(want.astype(str).values.tolist())
