"""Text rules against plain Python, on written cases and random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillworks.functions import rules, tables, text

ALPHABET = "가나다를은이사람들했었다습니까있고수할될 습 니 다그의것책을시작해읽고. .!?\"'()[]  AIabc019\n※-1."


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    return [r[0] for r in df.select("k", f(F.col("t")).alias("o")).orderBy("k").select("o").collect()]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 70))) for _ in range(150)] + ["", " ", "사 람 들 은 했었다.", "가1나나2다다", "가가1나나2다다"]


def python(some):
    def run(t):
        for r in some:
            t = t.replace(r.found, r.put) if r.plain else re.sub(r.found, r.put, t)
        return t

    return run


@pytest.mark.parametrize("name", ["DYNAMIC", "SPACING", "REJOIN", "WIDE_SPACING", "STRUCTURE", "SEPARATED", "SPECIAL", "NUMBER_LETTERS", "MISREAD", "CHARACTERS", "PHRASES", "FORMAL", "SPOKEN", "EXTENDED", "TIDY"])
def test_rules_as_python(spark, samples, name):
    some = getattr(text, name)
    assert column(spark, samples, lambda t: rules.apply(t, some)) == list(map(python(some), samples))


@pytest.mark.parametrize("group", list(text.ENDING_GROUPS))
def test_endings_as_python(spark, samples, group):
    texts = [*samples, "그가 했었다. 좋네요", "읽읍니다!", "할  거  다", "갔었고", "되었다고", "되었다"]
    assert column(spark, texts, lambda t: text.normal_endings(t, (group,))) == list(map(python(text.ENDING_GROUPS[group]), texts))


def test_number_gaps(spark, samples):
    def one(m):
        return " ".join(m.groups()) if len(m[1]) > 1 and len(m[3]) > 1 else m[0]

    assert column(spark, samples, text.number_gaps) == [re.sub("([가-힣]+)([0-9]+)([가-힣]+)", one, t) for t in samples]


def test_spoken_numbers(spark):
    said = dict(zip("123456789", tables.DIGITS, strict=True))

    def one(m):
        n = int(m[0])
        tens, ones = divmod(n, 10)
        return (said[str(tens)] if tens > 1 else "") + ("십" if tens else "") + (said[str(ones)] if ones else "")

    texts = ["1 9 10 11 20 99 100 05 0", "3.14", "l97o", "5개 5 개", "x1 1x 42-7", ""]
    assert column(spark, texts, text.spoken_numbers) == [re.sub(r"\b([1-9]|[1-9][0-9])\b", one, t) for t in texts]


def test_contextual_observed(spark):
    pairs = {
        "그래서나는 갔다! 하느님이 있다? 끝": "그래서 나는 갔다. 하느님이 있다. 끝",
        "기독교의 하느님. 즉그것": "기독교의 하나님. 즉 그것",
        "매우많은 것것 것 것 것 것것": "매우 많은 것 것 것것",
        "할수있고 할 수 있고 될수있고 수": "할 수 있고 할 수 있고 될 수 있고 수",
        "할수있고 수": "할수있고 수",
        "": "",
        "...": "",
        "가" * 101 + "에서는 좋다": "가" * 101 + " 에서는 좋다",
        "plain text. no Hangul  here": "plain text. no Hangul here",
    }
    assert column(spark, list(pairs), lambda t: text.contextual(t, True)) == list(pairs.values())


def test_contextual_keeps_marks(spark):
    assert column(spark, ["좋다! 그래서나는? 끝"], text.contextual) == ["좋다! 그래서 나는? 끝"]


def test_paragraphs(spark):
    assert column(spark, ["one\ntwo.\n1. first\nmore!\n- second\n\nplain", "", "x"], text.paragraphs) == ["one two.\n\n1. first more!\n\n- second plain", "", "x"]


def test_quirks(spark):
    assert column(spark, ["2019 a0b"], text.characters) == ["2019 aob"]
    assert column(spark, ["2019 a0b"], lambda t: text.characters(t, True)) == ["2ol9 aob"]
    assert column(spark, [""], text.spoken) == [""]
    assert column(spark, [""], lambda t: text.spoken(t, True)) == ["."]


def test_final_is_idempotent(spark, samples):
    once = column(spark, samples, text.final)
    assert column(spark, once, text.final) == once


def test_occurrences(spark):
    assert column(spark, ["teh teh adn"], lambda t: rules.occurrences(t, rules.plain("teh > the\nadn > and"))) == [3]


def test_morphology(spark):
    df = spark.createDataFrame([("나는 간다. 짧다",), (None,)], "t string")
    out = text.morphology(df, "t", lambda s: [(w, "J" if w == "는" else "N") for w in re.findall("나|는|간다|[^ ]", s)])
    assert [r[0] for r in out.collect()] == ["나는 간다. 짧다", None]
    assert text.morphology(df, "t") is df
