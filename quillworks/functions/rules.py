"""Ordered rewrite rules compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and only \n ends a line.
FLAGS = "(?Ud)"
HANGUL = "[가-힣]"
#: After an ending: white space, the end, or a mark.
ENDS = r"(?=\s|$|[.!?])"


@dataclass(frozen=True)
class Rule:
    """``found`` is a regular expression, or plain text if ``plain``; ``put`` refers to groups as \\1. Every match holds ``need``."""

    found: str
    put: str
    plain: bool = False
    need: str = ""

    def java(self) -> tuple[str, str]:
        return FLAGS + self.found, re.sub(r"\\(\d)", r"$\1", self.put.replace("$", r"\$"))

    def on(self, text: Column) -> Column:
        if self.plain:
            return F.replace(text, F.lit(self.found), F.lit(self.put))
        return F.regexp_replace(text, *self.java())


def let(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often ``then`` uses it. Within lambdas nothing else keeps it from being repeated."""
    return F.transform(F.array(value), then)[0]


def in_hangul(text: Column, then) -> Column:
    """The text with ``then`` on all from the first word with a Hangul syllable on.

    The same as on all of it for rules whose every match has a syllable and no white space before it, and that no anchor ties to the start.
    """
    head = lambda t: F.regexp_extract(t, r"(?s)\A(?:[^가-힣]*\s)?", 0)
    rest = lambda t, h: F.substring(t, F.length(h) + 1, F.length(t))
    return let(text, lambda t: let(head(t), lambda h: F.concat(h, then(rest(t, h)))))


def table(block: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" > ", 1)) for line in block.strip().split("\n")]


def plain(block: str) -> list[Rule]:
    return [Rule(a, b, True) for a, b in table(block) if a != b]


def apart(word: str) -> str:
    """The word with white space allowed between its syllables."""
    return r"\s*".join(map(re.escape, word))


def joined(block: str) -> list[Rule]:
    out = []
    for found, put in table(block):
        word, _, ahead = found.partition(" | ")
        out.append(Rule(apart(word) + ahead, put.replace("_", " "), need=word[0]))
    return out


def endings(block: str) -> list[Rule]:
    def pattern(found: str) -> str:
        return found.replace("~", f"({HANGUL}+)").replace("_", r"\s+")

    return [Rule(pattern(a) + ENDS, b.replace("~", r"\1"), need=a.strip("~_")[0]) for a, b in table(block)]


def _fold(text: Column, run: list[Rule]) -> Column:
    """A run of rules of one kind as a fold over a literal array: the plan stays small, and a regular expression is tried only where its ``need`` is."""
    if len(run) <= (12 if run[0].plain else 4):
        for rule in run:
            text = rule.on(text)
        return text
    if run[0].plain:
        pairs = F.array(*(F.struct(F.lit(r.found).alias("w"), F.lit(r.put).alias("r")) for r in run))
        return F.aggregate(pairs, text, lambda acc, x: F.replace(acc, x["w"], x["r"]))
    pairs = F.array(*(F.struct(F.lit(r.need).alias("n"), F.lit(r.java()[0]).alias("w"), F.lit(r.java()[1]).alias("r")) for r in run))
    return F.aggregate(pairs, text, lambda acc, x: F.when(F.contains(acc, x["n"]), F.regexp_replace(acc, x["w"], x["r"])).otherwise(acc))


def apply(text: Column, rules: Iterable[Rule]) -> Column:
    """All rules in order, as one expression."""
    for kind, run in groupby(rules, key=lambda r: ("hangul" if re.match(r"[^\s가-힣]*[가-힣]", r.found) else "plain") if r.plain else "needed" if r.need else "any"):
        run = list(run)
        if kind == "hangul" and len(run) > 12:
            text = in_hangul(text, lambda t, run=run: _fold(t, run))
        elif kind == "any":
            for rule in run:
                text = rule.on(text)
        else:
            text = _fold(text, run)
    return text


def occurrences(text: Column, rules: Iterable[Rule]) -> Column:
    """How many places the rules change, each rule counted on what those before it left. A fold, so the plan is as small for many rules as for few."""
    rules = list(rules)
    if not rules:
        return F.lit(0)
    kinds = F.array(*(F.struct(F.lit(r.plain).alias("p"), F.lit(r.found if r.plain else r.java()[0]).alias("w"), F.lit(r.put if r.plain else r.java()[1]).alias("r")) for r in rules))

    def step(acc: Column, x: Column) -> Column:
        gone = F.replace(acc["t"], x["w"], F.lit(""))
        n = F.when(x["p"], ((F.length(acc["t"]) - F.length(gone)) / F.length(x["w"])).cast("int")).otherwise(F.regexp_count(acc["t"], x["w"]))
        t = F.when(x["p"], F.replace(acc["t"], x["w"], x["r"])).otherwise(F.regexp_replace(acc["t"], x["w"], x["r"]))
        return F.struct(t.alias("t"), (acc["n"] + n).alias("n"))

    return F.aggregate(kinds, F.struct(text.alias("t"), F.lit(0).alias("n")), step)["n"]


def hits(text: Column, rules: Iterable[Rule]) -> Column:
    """How many different plain rules change something, each judged on what those before it left."""
    pairs = F.array(*(F.struct(F.lit(r.found).alias("w"), F.lit(r.put).alias("r")) for r in rules))
    start = F.struct(text.alias("t"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(F.replace(acc["t"], x["w"], x["r"]).alias("t"), (acc["n"] + F.contains(acc["t"], x["w"]).cast("int")).alias("n"))
    return F.aggregate(pairs, start, step)["n"]


def re2(rule: Rule) -> Rule:
    """The rule with what it looks ahead for at its end as a group of its own, for RE2. The same where no match starts with what that group takes."""
    found, n = rule.found, len(re.findall(r"(?<!\\)\((?!\?)", rule.found.split("(?=")[0].split("(?!")[0]))
    if not rule.plain and (m := re.search(r"\(\?=(.*)\)$", found)):
        return Rule(found[: m.start()] + f"({m[1]})", rule.put + f"\\{n + 1}")
    if not rule.plain and (m := re.search(r"\(\?!\[([^\]]*)\]\)$", found)):
        return Rule(found[: m.start()] + f"([^{m[1]}]|$)", rule.put + f"\\{n + 1}")
    return rule


def sql(text: str, rules: Iterable[Rule]) -> str:
    """The rules as DuckDB SQL over the expression ``text``; patterns must be ones that RE2 takes."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for r in rules:
        text = f"replace({text}, {quote(r.found)}, {quote(r.put)})" if r.plain else f"regexp_replace({text}, {quote(r.found)}, {quote(r.put)}, 'g')"
    return text
