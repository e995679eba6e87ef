"""The pipeline's stages on the smallest tables, each against what its operator decides, and on odd rows."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillworks.llm import decontaminate, mixing, simhash, toxicity


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def through(spark, docs, data, folder):
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(folder / name))
        seen[name] = docs, spark.read.parquet(str(folder / name))
        docs = seen[name][1]
    return seen


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    seen = through(spark, docs, data, tmp_path)
    before, after = seen["toxicity"]
    assert ids(after) == ids(toxicity.toxicity(before, labels).where("predicted = 0"))
    before, after = seen["near_duplicates"]
    assert ids(after) == ids(simhash.simhash_components(before).where("doc_id = component_id"))
    before, after = seen["decontamination"]
    gone = {r[0] for r in decontaminate.contaminated(before, bench).select("doc_id").collect()}
    assert ids(after) == [d for d in ids(before) if d not in gone]
    before, after = seen["mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(before).collect()}
    assert ids(after) == sorted(d for d, n in plan.items() for _ in range(n)) and before.columns == after.columns
    before, after = seen["sharding"]
    assert ids(after) == ids(before) and after.where("shard < 0 or shard > 23").count() == 0
    assert after.columns == [*before.columns, "shard", "slot"]
    assert sorted(r["text"] for r in after.collect()) == sorted(r["text"] for r in before.collect())


@pytest.fixture(scope="module")
def odd(spark, data):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like the operators' own."""
    rng = random.Random(4)
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first()["text"]
    words = [f"w{rng.randrange(500)}" for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copy = prose(80)
    rows = [(k, prose(60), "en", f"s{k % 3}", 1) for k in range(30)] + [(40 + k, copy, "en", "s0", 1) for k in range(6)]
    rows += [(50, prose(20_000), "en", "s1", 1), (51, "z" * 100_000, "en", "s1", 1), (60, f"{prose(30)} {item} {prose(30)}", "en", "s2", 1)]
    rows += [(70, None, "en", "s0", 1), (71, "", "en", "s0", 1), (72, " \n\t", None, None, None), (None, prose(40), "en", "s0", 1), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(80, "stupid idiot you worthless pathetic clown", "en", "s0", 1), (3, rows[3][1], "en", "s0", 1), (3, rows[3][1], "en", "s0", 1)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return out.withColumns({n: F.lit(n) for n in ("id", "size", "copies", "fp", "component_id", "_word", "_n", "score", "predicted", "_crc", "words")}), item


def test_stages_on_odd_rows(spark, data, odd, tmp_path):
    docs, item = odd
    seen = through(spark, docs, data, tmp_path)
    kept = {name: after for name, (_, after) in seen.items()}
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        assert kept[name].columns == docs.columns and kept[name].where("id <> 'id' or _word <> '_word' or _n <> '_n'").count() == 0
    assert kept["sharding"].columns == [*docs.columns, "shard", "slot"]
    some = ["toxicity", "near_duplicates", "decontamination"]
    left = {n: [r[0] for r in kept[n].select("doc_id").collect()] for n in some}
    # Rows with a null id stay; copies and repeated rows leave one; null, empty and blank texts are alike, and one stays.
    assert all(x.count(None) == 3 for x in left.values())
    before, after = seen["toxicity"]
    gone = {r[0] for r in toxicity.toxicity(before, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").select("doc_id").collect()} - {None}
    assert ids(after.where("doc_id is not null")) == sorted(d for d in ids(before.where("doc_id is not null")) if d not in gone) and 70 in left["toxicity"]
    assert left["near_duplicates"].count(3) == 1 and {40, 50, 51} <= set(left["near_duplicates"]) and not {41, 42, 43, 44, 45} & set(left["near_duplicates"])
    assert 70 in left["near_duplicates"] and 71 not in left["near_duplicates"] and 72 not in left["near_duplicates"]
    assert 60 in left["near_duplicates"] and 60 not in left["decontamination"]
    before, after = seen["mixing"]
    plan = sum(r["copies"] for r in mixing.plan_mix(before).collect())
    assert after.count() == plan > 0 and seen["sharding"][1].count() == plan
    slots = {}
    for r in seen["sharding"][1].collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_stages_on_an_empty_table(spark, data, odd, tmp_path):
    docs, _ = odd
    for name, (_, after) in through(spark, docs.limit(0), data, tmp_path).items():
        assert after.count() == 0 and after.columns[: len(docs.columns)] == docs.columns, name


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and out.where("text is null").count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
