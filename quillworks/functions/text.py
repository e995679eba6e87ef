"""Text repair as column functions: three pipelines and their stages.

``observed`` asks for what the rules literally do where that is plainly a slip: digits become letters everywhere,
! and ? become full stops, an empty text becomes a full stop.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables
from .rules import ENDS, FLAGS, HANGUL, Rule, apart, apply, endings, hits, in_hangul, joined, let, plain, table

H = HANGUL
SPACE_RUNS = Rule(r"\s+", " ")
DOTS = Rule(r"\.{2,}", ".")


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, FLAGS + r"^\s+|\s+\z", "")


def tokens(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.filter(F.split(text, FLAGS + r"\s+"), lambda w: w != "")


def trim_lines(text: Column) -> Column:
    """Lines stripped, blank ones gone."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), "\n")


# ---- first pipeline -------------------------------------------------------------------------------------------------

CLEANUP = [DOTS, SPACE_RUNS]
MISREAD = plain(tables.MISREAD)
BRACKET = r"[\(\)\[\]{}]"
QUOTE = "[\"']"
#: Latin next to Hangul, brackets, marks, quotes and runs of one character; the rule for digits within Hangul is apart. Before a gap, a rule
#: asks for as much of a run as decides and no more, so that a long run is not tried again from each of its places.
DYNAMIC = [
    Rule(rf"([0-9])({H}{{1,3}})(전|후|간|째|번|개|명|일|년|월|시|분|초)(?!{H})", r"\1\2 \3"),
    Rule(rf"([A-Za-z])({H}{{2,}})(?!{H})", r"\1 \2"),
    Rule(rf"({H}{{2}})([A-Z]{{2,}})(?![A-Za-z])", r"\1 \2"),
    Rule(rf"({H})({BRACKET})({H})", r"\1 \2 \3"),
    Rule(rf"({BRACKET})({H})", r"\1 \2"),
    Rule(rf"({H})({BRACKET})", r"\1 \2"),
    Rule(rf"({H})\s*([.!?])\s*({H})", r"\1\2 \3"),
    Rule(rf"({H})\s*({QUOTE})\s*({H})", r"\1 \2\3"),
    Rule(rf"({H})\s*({QUOTE})\s*({H})", r"\1\2 \3"),
    Rule(r"(.)\1{3,}", r"\1\1"),
]


#: Hangul, digits, Hangul. A match takes whole runs, so one starts where a run does; it is tried nowhere else.
GAPS = f"(?<!{H})({H}++)([0-9]++)({H}+)"


def number_gaps(text: Column) -> Column:
    """Gaps around digits between Hangul where both neighbours have two syllables or more.

    Matches are taken from the left and do not overlap, and the decision is per match: a shorter neighbour uses up its
    match. Matches run from Hangul to Hangul, so they are taken out and judged one by one, and the text between them stays whatever it has.
    """

    def one(match: Column) -> Column:
        before, digits, after = (F.regexp_extract(match, GAPS, k) for k in (1, 2, 3))
        return F.when((F.length(before) > 1) & (F.length(after) > 1), F.concat_ws(" ", before, digits, after)).otherwise(match)

    def mended(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(GAPS), F.lit(0)), one)
        return let(found, lambda m: F.array_join(F.transform(F.split(t, GAPS), lambda x, i: F.concat(x, F.coalesce(F.get(m, i), F.lit("")))), ""))

    return let(text, lambda t: F.when(t.rlike(f"{H}[0-9]+{H}"), mended(t)).otherwise(t))


def dynamic(text: Column) -> Column:
    return number_gaps(apply(text, DYNAMIC))


LONG_PARTICLES = Rule(rf"({H}{{3,}})(에서는|로부터는|에게서는|로써는)", r"\1 \2")
OPENERS = [Rule(rf"^{w}({H})", rf"{w} \1") for w in ("그래서", "하지만", "따라서", "즉")]
CLOSE_WORDS = plain("매우많은 > 매우 많은\n아주좋은 > 아주 좋은\n정말중요한 > 정말 중요한\n너무어려운 > 너무 어려운\n특히중요한 > 특히 중요한")


def contextual(text: Column, observed: bool = False) -> Column:
    """Per sentence: long particles, openers, close words and crowded nouns; sentences joined by ``. ``.

    ``observed`` loses the marks of the sentences; else each keeps its own.
    """
    holy = F.contains(text, F.lit("기독교")) | F.contains(text, F.lit("성경"))

    steps = (
        lambda s: strip(F.when(F.length(s) > 100, LONG_PARTICLES.on(s)).otherwise(s)),
        lambda s: apply(s, OPENERS),
        lambda s: apply(F.when(holy, F.replace(s, F.lit("하느님"), F.lit("하나님"))).otherwise(s), CLOSE_WORDS),
        lambda s: F.when(F.regexp_count(s, F.lit("것")) > 3, Rule(r"것\s*것", "것").on(s)).otherwise(s),
        lambda s: F.when(F.regexp_count(s, F.lit("수")) > 3, apply(s, [Rule(r"할\s*수\s*있", "할 수 있"), Rule(r"될\s*수\s*있", "될 수 있")])).otherwise(s),
    )

    def mended(s: Column) -> Column:
        """Every rule needs Hangul, so other sentences are but stripped."""
        done = s
        for step in steps:
            done = let(done, step)
        return F.when(s.rlike(H), done).otherwise(strip(s))

    if observed:
        parts = F.filter(F.transform(F.filter(F.split(text, "[.!?]+"), lambda s: strip(s) != ""), mended), lambda s: s != "")
        return strip(SPACE_RUNS.on(F.array_join(parts, ". ")))
    marked = F.regexp_extract_all(text, F.lit(r"(?s)([^.!?]+[.!?]*|[.!?]+)"), F.lit(1))
    mark = lambda s: F.regexp_extract(s, r"[.!?]*\z", 0)
    parts = F.transform(marked, lambda s: F.concat(mended(F.regexp_replace(s, r"[.!?]*\z", "")), mark(s)))
    return strip(SPACE_RUNS.on(F.array_join(F.filter(parts, lambda s: s != ""), " ")))


PARTICLE_GAP = r"은|는|이|가|을|를|과|와|에|에서|에게|로|으로|의|도|만|부터|까지|처럼|같이"
TENSES = [Rule(rf"({H}+)({x}있[는다습니까])(?!{H})", rf"\1{x} 있\2") for x in "고어아"]
ADVERBS = Rule(rf"(매우|정말|아주|너무|특히|항상|절대|전혀|모든|각각|여러)({H}{{2,}})", r"\1 \2")


def split_before(*words: str) -> list[Rule]:
    return [Rule(rf"({H}{{2,}})({w})", r"\1 \2") for w in words]


SPACING_NUMBERS = [Rule(rf"({H}{{2,}})([0-9]{{4}})", r"\1 \2"), Rule(rf"([0-9]{{1,}})({H}{{2,}})", r"\1 \2")]
SPACING_PARTICLES = split_before(PARTICLE_GAP)
SPACING_ENDINGS = split_before("했습니다|합니다|됩니다|입니다|있습니다|없습니다", "지만|에서|에도|에게|로서|로써|이나|거나")
SPACING_CONNECTIVES = split_before("하면서|하거나|하지만|한다면|했다면")
SPACING_COMPOUNDS = split_before("하기|되기|없이|있게|하게|되게")
SPACING_CONJUNCTIONS = split_before("그리고|또한|하지만|그러나|따라서|즉|예를들어")
SPACING = [*SPACING_NUMBERS, *SPACING_PARTICLES, *SPACING_ENDINGS, *TENSES, *SPACING_CONNECTIVES, *SPACING_COMPOUNDS, ADVERBS, *SPACING_CONJUNCTIONS]

REJOIN = [
    *joined(tables.JOINED),
    *(r for p in tables.PARTICLES.split() for r in (Rule(rf"({H}+)\s+{p}(?=\s)", rf"\1{p} ", need=p), Rule(rf"({H}+)\s+{p}(?=\.|$)", rf"\1{p}", need=p))),
    Rule(r"할\s+수\s+" + apart("있습니다"), "할 수 있습니다", need="할"),
    Rule(r"될\s+수\s+" + apart("있습니다"), "될 수 있습니다", need="될"),
    Rule(apart("해보겠습니다"), "해보겠습니다", need="해"),
    *joined(tables.JOINED_LATER),
    *(Rule(rf"{w[0]}\s+{w[1]}", w, need=w[0]) for w in tables.PAIRS.split()),
    SPACE_RUNS,
]


def rejoin(text: Column) -> Column:
    return strip(SPACE_RUNS.on(in_hangul(text, lambda t: apply(t, REJOIN[:-1]))))


CHARACTERS = plain(tables.CHARACTERS)
PHRASES = plain(tables.PHRASES)
FORMAL = [Rule(rf"({H}+){x}니다{ENDS}", r"\1습니다") for x in "슴씀"]


def characters(text: Column, observed: bool = False) -> Column:
    """Misread characters. Digits become letters between Latin letters; ``observed``: everywhere."""
    digits = lambda r: r.found.isdigit()
    rules = CHARACTERS if observed else [Rule(f"(?<=[A-Za-z]){r.found}(?=[A-Za-z])", r.put) if digits(r) else r for r in CHARACTERS]
    return in_hangul(apply(text, rules), lambda t: apply(t, [*PHRASES, *FORMAL]))


ENDING_GROUPS = {name: endings(block) for name, block in (("past", tables.PAST), ("contraction", tables.CONTRACTION), ("honorific", tables.HONORIFIC), ("connection", tables.CONNECTION), ("style", tables.STYLE))}


def normal_endings(text: Column, groups=tuple(ENDING_GROUPS)) -> Column:
    return in_hangul(text, lambda t: apply(t, [r for g in groups for r in ENDING_GROUPS[g]]))


def spacing(text: Column, rules: list[Rule] = SPACING) -> Column:
    return in_hangul(text, lambda t: apply(t, rules))


def spoken_numbers(text: Column) -> Column:
    """Standing numbers from 1 to 99 in words."""
    digit = lambda c: F.substring(F.lit(" " + tables.DIGITS), c + 1, F.lit(1))

    def word(x: Column) -> Column:
        n = x.try_cast("int")
        tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
        said = F.concat(F.when(tens > 1, digit(tens)).otherwise(F.lit("")), F.when(tens > 0, F.lit(tables.TEN)).otherwise(F.lit("")), F.when(ones > 0, digit(ones)).otherwise(F.lit("")))
        return F.when(x.rlike(r"\A[1-9][0-9]?\z"), said).otherwise(x)

    # Standing numbers are marked, so that few pieces are looked at one by one; a text that has the mark itself is cut at every word.
    few = F.split(F.regexp_replace(text, r"(?U)\b([1-9][0-9]?)\b", "\u0001$1\u0001"), "\u0001")
    return F.when(~text.rlike("[1-9]"), text).otherwise(F.array_join(F.transform(F.when(F.contains(text, F.lit("\u0001")), F.split(text, r"(?U)\b")).otherwise(few), word), ""))


SPOKEN = [Rule(rf"(?i)\b{a}\b", b) for a, b in table(tables.SPOKEN)]


def acronyms(text: Column) -> Column:
    """Standing acronyms, any case, as they are spoken. One is looked for only where its letters stand; what is put is Hangul, so none arises later."""
    names = [a for a, _ in table(tables.SPOKEN)]
    # Letters that any case of s and i may be besides those that lower() gives.
    low = F.lower(F.translate(text, "ſİı", "sii"))

    def one(lowered: Column, name: str, rule: Rule):
        return lambda t: F.when(F.contains(lowered, F.lit(name.lower())), rule.on(t)).otherwise(t)

    def on(lowered: Column) -> Column:
        out = text
        for name, rule in zip(names, SPOKEN, strict=True):
            out = let(out, one(lowered, name, rule))
        return out

    return let(low, on)


BREATHS = [Rule(f"({words.replace(' ', '|')})", r"\1,") for words in tables.BREATHS]


def breaths(text: Column, observed: bool = False) -> Column:
    """Commas in sentences of more than 50 characters; ``observed``: every mark becomes a full stop, an empty text too."""
    some = lambda s: F.when(F.length(s) > 50, apply(s, BREATHS)).otherwise(s)
    if observed:
        out = F.array_join(F.filter(F.transform(F.split(text, "[.!?]"), lambda s: strip(some(s))), lambda s: s != ""), ". ")
        return let(out, lambda x: F.when(F.endswith(x, F.lit(".")), x).otherwise(F.concat(x, F.lit("."))))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)([^.!?]+[.!?]*|[.!?]+)"), F.lit(1))
    out = F.array_join(F.filter(F.transform(parts, lambda s: strip(some(s))), lambda s: s != ""), " ")
    return let(out, lambda x: F.when((x == "") | x.rlike(r"[.!?]\z"), x).otherwise(F.concat(x, F.lit("."))))


def spoken(text: Column, observed: bool = False) -> Column:
    return let(let(let(text, spoken_numbers), acronyms), lambda t: breaths(t, observed))


def fallback(text: Column) -> Column:
    return trim_lines(apply(text, CLEANUP))


HINT = r"(?Ud)\A(\d+\.|[가-힣]\)|•|-|※)"


#: The end of a line that is finished.
FINISHED = r"(?Ud)[.!?]\s*\z"


def line_break(line: Column, before: Column) -> Column:
    """What stands between two lines: a space if the one before goes on, else a line end, and a blank line before a number, letter or bullet."""
    return F.when(~before.rlike(FINISHED), " ").when(line.rlike(HINT), "\n\n").otherwise("\n")


def paragraphs(text: Column) -> Column:
    """Lines that go on are joined; a line that starts with a number, letter or bullet after a finished one gets a blank line before it.

    What a line is joined to ends as the line before it does, so each line looks at that one alone.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return let(lines, lambda ls: F.array_join(F.transform(ls, lambda x, i: F.when(i == 0, x).otherwise(F.concat(line_break(x, F.get(ls, i - 1)), x))), ""))


#: Stages in order; boundary stages (morphology, sentence splitter) are identity unless an engine is given.
WORKER = ("cleanup", "misread", "dynamic", "contextual", "spacing", "rejoin", "characters", "endings", "paragraphs", "spoken", "lines")


def worker_stage(name: str, observed: bool = False):
    return {
        "cleanup": lambda t: apply(t, CLEANUP),
        "misread": lambda t: apply(t, MISREAD),
        "dynamic": dynamic,
        "contextual": lambda t: contextual(t, observed),
        "spacing": spacing,
        "rejoin": rejoin,
        "characters": lambda t: characters(t, observed),
        "endings": normal_endings,
        "paragraphs": paragraphs,
        "spoken": lambda t: spoken(t, observed),
        "lines": trim_lines,
    }[name]


# ---- second pipeline ------------------------------------------------------------------------------------------------

TIDY = [SPACE_RUNS, DOTS, Rule(r"\?{2,}", "?"), Rule(r"!{2,}", "!")]
EXTENDED = plain(tables.EXTENDED)
WIDE_SPACING = [
    *split_before(PARTICLE_GAP + "|마다|보다", "했습니다|합니다|됩니다|입니다|있습니다|없습니다|였습니다", "지만|에서|에도|에게|로서|로써|이나|거나|라도|라든지"),
    *TENSES,
    *split_before("하기|되기|없이|있게|하게|되게|하려|하면|한다"),
    ADVERBS,
    *split_before("그리고|또한|하지만|그러나|따라서|즉|예를들어|예를들면"),
]
STRUCTURE = [Rule(r"\s+([.!?,:;])", r"\1"), Rule(r"([.!?])([가-힣A-Za-z])", r"\1 \2"), Rule(r"\(\s+", "("), Rule(r"\s+\)", ")"), Rule(r'"\s+', '"'), Rule(r'\s+"', '"')]


def tidy(text: Column) -> Column:
    return strip(apply(text, TIDY))


def user_rules(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """A user's replacements in the order that they were added; one that is added again keeps its place with the new value."""
    return apply(text, [Rule(a, b, True) for a, b in dict(pairs).items()])


def final(text: Column) -> Column:
    return strip(trim_lines(SPACE_RUNS.on(text)))


def joined_morphemes(df: DataFrame, column: str, analyze=None) -> DataFrame:
    """The second pipeline's step by morphemes: ``analyze`` maps a sentence to (form, tag) pairs; particles and endings (tags J, E) join the form before.

    Sentences end at full stops; blank ones go, and a full stop at the end stays. A text that the analyzer fails on stays as it is, and so do all without an analyzer.
    """
    if analyze is None:
        return df

    def told(text: str) -> str:
        made = []
        for sentence in filter(None, map(str.strip, text.split("."))):
            words: list[str] = []
            for form, tag in analyze(sentence):
                if tag.startswith(("J", "E")) and words:
                    words[-1] += form
                else:
                    words.append(form)
            made.append(" ".join(words))
        return ". ".join(made) + ("." if text.endswith(".") else "")

    @F.pandas_udf("string")
    def spaced(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return text if text is None else told(text)
            except Exception:  # whatever the outside engine raises, the text is still a text
                return text

        return texts.map(one)

    return df.withColumn(column, spaced(F.col(column)))


def enhanced(df: DataFrame, column: str = "text", pairs: list[tuple[str, str]] = (), analyze=None) -> DataFrame:
    """The second pipeline over a column: clean-up, misread words, morphemes, spacing, sentence structure, the user's words, last checks.

    The column is replaced; ``hits`` (how many misread words were found) is added. ``analyze`` is an outside analyzer of morphemes, if there is one.
    """
    rest = [c for c in df.columns if c != column]
    step = lambda df, value, *more: df.select(*rest, F.explode(F.array(F.struct(value.alias("t"), *more))).alias("_s")).select(*rest, "_s.*")  # noqa: E731  each step worked out once
    out = step(df, tidy(F.col(column)))
    rest.append("hits")
    out = out.withColumn("hits", extended_hits(F.col("t")))
    out = joined_morphemes(step(out, apply(F.col("t"), EXTENDED)), "t", analyze)
    out = step(out, apply(F.col("t"), WIDE_SPACING))
    out = step(out, user_rules(apply(F.col("t"), STRUCTURE), pairs))
    return out.select(*rest[:-1], final(F.col("t")).alias(column), "hits")


def extended_hits(text: Column) -> Column:
    return hits(text, EXTENDED)


# ---- third pipeline -------------------------------------------------------------------------------------------------

NUMBER_LETTERS = [
    Rule(r"l\s*구십\s*칠\s*o\s*년대", "1970년대"),
    Rule(r"l\s*구십\s*칠\s*S\s*년", "1975년"),
    Rule(r"이\s*ol\s*이\s*년", "2012년"),
    Rule(r"베스트\s*설러\s*l\s*위", "베스트셀러 1위"),
    Rule(r"베스트\s*셀러\s*l\s*위", "베스트셀러 1위"),
    Rule(r"\bl\s+위", "1위"),
    Rule(r"(?<=\d)\s*o\s*년", "0년"),
    Rule(r"l\s*(?=\d)", "1"),
]
SEPARATED = [
    Rule(r"'\s*얼\s*물\s*없는", "얼굴 없는"),
    Rule(r"'\s*얼\s*물", "얼굴"),
    Rule(r"간곡\s*하\s*(\w)", r"간곡한 \1"),
    Rule(r"깊\s*은\s*(\w)", r"깊은 \1"),
    Rule(r"새로\s*운\s*(\w)", r"새로운 \1"),
    Rule(r"은\s*문\s*하어", "은둔하여"),
    Rule(r"돌\s*두\s*하었습니다", "몰두했습니다"),
    Rule(r"출\s*연\s*하어", "출연하여"),
    Rule(r"방\s*치\s*하어", "방치하여"),
    Rule(r"(\w)\s*틀\s*(\w)", r"\1를 \2"),
    Rule(r"체\s*험", "체험"),
    Rule(r"분\s*아에", "분야에"),
    Rule(apart("사람들"), "사람들"),
    Rule(apart("독자들"), "독자들"),
]
SPECIAL = [
    Rule(r"<\s*슈퍼\s*소울\s*서\s*이데\s*이\s*>", "《슈퍼 소울 선데이》"),
    Rule(r"<\s*([^>]+)\s*>", r"《\1》"),
    Rule(r"\(\s*상처\s*받지\s*않는\s*영혼\s*\)", "《상처받지 않는 영혼》"),
    Rule(r"\(\s*([^)]+)\s*\)", r"《\1》"),
    Rule(r"\s*;\s*", ", "),
    Rule(r"\s*:\s*", ". "),
    DOTS,
    Rule(r"\?{2,}", "?"),
    Rule("@GettyImages", "© Getty Images"),
    Rule(r"WWW\s*untetheredsoul\s*com", "www.untetheredsoul.com"),
]
TERMS = plain(tables.TERMS)
PLAIN_ENDINGS = plain(tables.PLAIN_ENDINGS)


def corrected(text: Column) -> Column:
    """The third pipeline: digits and letters, separated characters, special characters, terms, endings."""
    return apply(text, [*NUMBER_LETTERS, *SEPARATED, *SPECIAL, *TERMS, *PLAIN_ENDINGS])


def morphology(df: DataFrame, column: str, analyze=None) -> DataFrame:
    """Spacing by morphemes: ``analyze`` maps a sentence to (form, tag) pairs; particles and endings (tags J, E) join the word before.

    Without an analyzer the text stays. A sentence is changed only if at least 0.7 of its length is left.
    """
    if analyze is None:
        return df

    @F.pandas_udf("string")
    def spaced(texts: pd.Series) -> pd.Series:
        def one(sentence: str) -> str:
            s = sentence.strip()
            if len(s) <= 3:
                return s
            words: list[str] = []
            for form, tag in analyze(s):
                if tag[:1] in ("J", "E") and words:
                    words[-1] += form
                else:
                    words.append(form)
            out = " ".join(words)
            return out if len(out) > 0.7 * len(s) else s

        return texts.map(lambda t: None if t is None else ". ".join(x for x in map(one, re.split(r"\. ", t)) if x))

    return df.withColumn(column, spaced(F.col(column)))


REPEATS = Rule(r"(\w)\1{2,}", r"\1\1")


def sentences(df: DataFrame, column: str, split=None) -> DataFrame:
    """Sentence by sentence: ``split`` maps a text to its sentences; in each, a sign repeated more than twice stays twice, and spaces are single. Without a splitter the text stays."""
    if split is None:
        return df
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else list(split(t))), "array<string>")
    one = lambda s: strip(Rule(r"\s{2,}", " ").on(REPEATS.on(strip(s))))
    return df.withColumn(column, F.array_join(F.filter(F.transform(cut(F.col(column)), one), lambda s: s != ""), " "))


def worker(df: DataFrame, column: str = "text", observed: bool = False, analyze=None, split=None) -> DataFrame:
    """The first pipeline over a column. ``analyze`` and ``split`` are the outside engines for morphemes and sentences, if there are any."""
    for name in WORKER:
        if name == "paragraphs":  # both come after the rules and before paragraphs
            df = sentences(morphology(df, column, analyze), column, split)
        rest = [c for c in df.columns if c != column]
        # explode keeps the stages apart: in one expression the first would be repeated by each that reads it twice.
        df = df.select(*rest, F.explode(F.array(worker_stage(name, observed)(F.col(column)))).alias(column))
    return df
