"""Every query of the library by name, each with its SQL where SQL can express it.

The driver's tables stand in for the engine's own: documents are recognised texts, conversations are blocks (a
conversation an image, a turn a place), events are logs and scores. No table holds Hangul, so queries over Korean rules
append a seed sentence to each text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality, rules, text
from .. import job
from ..operators import analytics, blocks, dictionary, images, layout, metrics, results, rulebook, selection, store, stored, wordlist
from ..sources import encoding, files, rasters, sinks
from ..streaming import ingest, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: An input below this much for each core may lie in fewer row groups than there are cores; a shuffle of it costs little.
SMALL = 64 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A small table dealt out over all cores before work on its texts; a large one as it lies, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    small = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL
    return rows.repartition(cores, key) if small else rows


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id")


# ---- texts ----------------------------------------------------------------------------------------------------------

SEEDS = (
    "그는 2019년 5월에 책을 썼다.. 정말?? 네!! 그래요.",
    "사 람 들 은 마 이 클 싱 어 를 존경했었다. 헐 수 있다!",
    "우리나라는 연구를 시작했습니다 그리고 결과는 좋네요.",
    "학교에서 공부하면서 매우중요한 시험이 있습니다. 끝났다그리고 내면 적 하지만 공부하기 때문에",
    "읽 을 것 이 많다. 될 수 있 다. 그옷은 뜨문에 했슴니다.",
    "소율과 곧경을 이기 지 못했다 할수있는 teh Michacl; 쓸 것.",
    "베스트 셀러 l 위는 이 ol 이 년 < 영혼 > ( 상처 ) 받었습니다: 끝.",
    "연구했던2021 가지고있는 사람처럼 예를들어 하면서 걸어있습 있엤다.",
)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SEEDED_SQL = "(text || ' ' || [" + ", ".join(map(_sql_text, SEEDS)) + f"][(doc_id % {len(SEEDS)} + 1)::INTEGER])"


def seeded(docs: DataFrame) -> DataFrame:
    seed = F.element_at(F.array(*map(F.lit, SEEDS)), (F.col("doc_id") % len(SEEDS) + 1).cast("int"))
    return docs.withColumn("text", F.concat("text", F.lit(" "), seed))


def rewriting(name: str, rewrite: Callable[[Column], Column], sql: str | None, seed: bool = True) -> None:
    """A query (doc_id, out): one rewrite of each text. ``sql`` has {t} for the text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir)
        return (seeded(docs) if seed else docs).select("doc_id", rewrite(F.col("text")).alias("out"))

    QUERIES[name] = run
    if sql:
        SQL[name] = "SELECT doc_id, " + sql.replace("{t}", SEEDED_SQL if seed else "text") + " AS out FROM documents"


def _ruled(name: str, some: list[rules.Rule], seed: bool = True, sql_rules: list[rules.Rule] | None = None) -> None:
    rewriting(name, lambda t: rules.apply(t, some), rules.sql("{t}", some if sql_rules is None else sql_rules), seed)


TRIM_SQL = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_tidy_sql = TRIM_SQL.replace("{x}", rules.sql("{t}", text.TIDY))
rewriting("clean_basic", text.tidy, _tidy_sql)
rewriting("clean_fallback", text.fallback, TRIM_SQL.replace("{x}", rules.sql("{t}", text.CLEANUP)))
_ruled("sentence_structure", text.STRUCTURE)
_ruled("hangul_spacing_number", text.SPACING_NUMBERS)
_ruled("hangul_spacing_particle", text.SPACING_PARTICLES)
_ruled("hangul_spacing_ending", text.SPACING_ENDINGS)
_ruled("hangul_spacing_connective", text.SPACING_CONNECTIVES)
_ruled("hangul_spacing_compound", text.SPACING_COMPOUNDS)
_ruled("hangul_spacing_adverb", [text.ADVERBS])
_ruled("hangul_spacing_conjunction", text.SPACING_CONJUNCTIONS)
def _re2_sql(some: list[rules.Rule], t: str = "{t}") -> str:
    return rules.sql(t, list(map(rules.re2, some)))


rewriting("hangul_spacing_tense", lambda t: rules.apply(t, text.TENSES), _re2_sql(text.TENSES))
rewriting("hangul_spacing_all", text.spacing, _re2_sql(text.SPACING))
rewriting("hangul_spacing_wide", lambda t: text.spacing(t, text.WIDE_SPACING), _re2_sql(text.WIDE_SPACING))
_ruled("ocr_dictionary_fold", text.MISREAD)
_ruled("charfix_literal", [*text.CHARACTERS, *text.PHRASES])
# A digit between letters, each rule twice: a letter may be the neighbour of two digits, and a match takes it.
_between = [x for r in text.CHARACTERS for x in ([rules.Rule(f"([A-Za-z]){r.found}([A-Za-z])", "\\1" + r.put + "\\2")] * 2 if r.found.isdigit() else [r])]
rewriting("charfix_intended", text.characters, _re2_sql([*_between, *text.PHRASES, *text.FORMAL]))
_ruled("extended_fold", text.EXTENDED)
_ruled("term_fix", text.TERMS)
_ruled("plain_endings", text.PLAIN_ENDINGS)
_ruled("special_char_fix", text.SPECIAL)
_ruled("character_separation", text.SEPARATED, sql_rules=[rules.Rule(r.found.replace(r"(\w)", r"([\p{L}\p{N}_])"), r.put) for r in text.SEPARATED])
_letters_sql = [*text.NUMBER_LETTERS[:6], rules.Rule(r"(\d)\s*o\s*년", r"\10년"), rules.Rule(r"l\s*(\d)", r"1\1")]
_ruled("number_letter_fix", text.NUMBER_LETTERS, sql_rules=_letters_sql)


def _ahead(r: rules.Rule) -> rules.Rule:
    """The rule with the end that it looks ahead for as a group of its own, for RE2."""
    found = r.found.removesuffix(rules.ENDS)
    return rules.Rule(found + r"(\s|$|[.!?])", r.put + f"\\{found.count('([') + 1}")


for _name, _some in text.ENDING_GROUPS.items():
    _ruled(f"endings_{_name}", _some, sql_rules=list(map(_ahead, _some)))
# A name that goes on is kept apart by a mark in it.
_KEPT, _NAME = text.apart("마이클"), text.apart("마이클") + r"(?!\s*싱)"
_rejoin_sql = [
    x
    for r in text.REJOIN
    for x in ([rules.Rule(rf"(마\s*이)(\s*클\s*싱)", "\\1\x03\\2"), rules.Rule(_KEPT, r.put), rules.Rule("\x03", "", True)] if r.found == _NAME else [rules.re2(r)])
]
rewriting("overseparation_join", text.rejoin, TRIM_SQL.replace("{x}", rules.sql("{t}", _rejoin_sql)))
_fixed_joins = [r for r in rules.joined(text.tables.JOINED) if "(?" not in r.found]
_ruled("overseparation_fixed", _fixed_joins)
rewriting("dynamic_patterns", text.dynamic, None)
def _let(value: str, name: str, then: str) -> str:
    return f"list_transform([{value}], lambda {name}: {then})[1]"


def _gaps_sql(t: str) -> str:
    marked = f"regexp_replace({t}, '([가-힣]+)([0-9]+)([가-힣]+)', chr(1) || '\\1' || chr(2) || '\\2' || chr(2) || '\\3' || chr(1), 'g')"
    p = "string_split(x, chr(2))"
    return f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda x: CASE WHEN len({p}) = 3 AND length({p}[1]) > 1 AND length({p}[3]) > 1 THEN array_to_string({p}, ' ') ELSE replace(x, chr(2), '') END), '')"


def _squashed_sql(t: str, rest: str = "s", source: str = "documents") -> str:
    """Runs of four and more of one character but a line end are cut to two, by gaps and islands over the characters."""
    return f"""WITH d AS (SELECT doc_id, {t} AS t FROM {source}), c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM d),
e AS (SELECT *, CASE WHEN ch = lag(ch) OVER w AND ch <> chr(10) THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
k AS (SELECT doc_id, i, ch, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS p, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g),
j AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS s FROM k WHERE n < 4 OR p <= 2 GROUP BY doc_id)
SELECT d.doc_id, {rest} AS out FROM (SELECT doc_id, coalesce(s, '') AS s FROM d LEFT JOIN j USING (doc_id)) d"""


rewriting("number_gaps", text.number_gaps, _gaps_sql("{t}"))
rewriting("repeat_squash", lambda t: text.DYNAMIC[-1].on(t), None)
SQL["repeat_squash"] = _squashed_sql(SEEDED_SQL)
SQL["dynamic_patterns"] = _squashed_sql(_re2_sql(text.DYNAMIC[:-1], SEEDED_SQL), _gaps_sql("s"))
rewriting("contextual_corrections", text.contextual, None)
rewriting("contextual_observed", lambda t: text.contextual(t, True), None)
#: Word boundaries as classes, as DuckDB's are ASCII. A boundary character is taken by a match, so each rule goes twice.
_EDGE = r"[^\p{L}\p{M}\p{N}_]"
_spoken_rules = [rules.Rule(rf"(?i)(^|{_EDGE}){a}($|{_EDGE})", rf"\1{b}\2") for a, b in rules.table(text.tables.SPOKEN) for _ in range(2)]
rewriting("tts_acronyms", text.acronyms, rules.sql("{t}", _spoken_rules), seed=False)


def _numbers_sql(t: str) -> str:
    word = r"[\p{L}\p{M}\p{N}_]"
    digit = lambda n: f"substr(' {text.tables.DIGITS}', ({n}) + 1, 1)"
    said = f"CASE WHEN x::INTEGER >= 20 THEN {digit('x::INTEGER // 10')} ELSE '' END || CASE WHEN x::INTEGER >= 10 THEN '{text.tables.TEN}' ELSE '' END || CASE WHEN x::INTEGER % 10 > 0 THEN {digit('x::INTEGER % 10')} ELSE '' END"
    return f"array_to_string(list_transform(regexp_extract_all({t}, '{word}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: CASE WHEN regexp_full_match(x, '[1-9][0-9]?') THEN {said} ELSE x END), '')".replace("\\\\", "\\")


def _breaths_sql(t: str, observed: bool) -> str:
    some = TRIM_SQL.replace("{x}", f"CASE WHEN length(x) > 50 THEN {rules.sql('x', text.BREATHS)} ELSE x END")
    parts = f"string_split_regex({t}, '[.!?]')" if observed else f"regexp_extract_all({t}, '(?s)[^.!?]+[.!?]*|[.!?]+')"
    out = f"array_to_string(list_filter(list_transform({parts}, lambda x: {some}), lambda y: y <> ''), '{'. ' if observed else ' '}')"
    done = "suffix(z, '.')" if observed else "z = '' OR regexp_matches(z, '[.!?]$')"
    return _let(out, "z", f"CASE WHEN {done} THEN z ELSE z || '.' END")


def _sentences_sql(t: str, observed: bool) -> str:
    strip = lambda x: TRIM_SQL.replace("{x}", x)
    opened = [rules.Rule(rf"^{w}([가-힣])", rf"{w} \1") for w in ("그래서", "하지만", "따라서", "즉")]
    long = rules.sql("a", [text.LONG_PARTICLES])
    count = lambda x, w: f"(length({x}) - length(replace({x}, '{w}', '')))"
    last = f"CASE WHEN {count('d', '수')} > 3 THEN " + rules.sql("d", [rules.Rule(r"할\s*수\s*있", "할 수 있"), rules.Rule(r"될\s*수\s*있", "될 수 있")]) + " ELSE d END"
    things = f"CASE WHEN {count('c', '것')} > 3 THEN " + rules.sql("c", [rules.Rule(r"것\s*것", "것")]) + " ELSE c END"
    holy = "CASE WHEN contains(whole, '기독교') OR contains(whole, '성경') THEN replace(b, '하느님', '하나님') ELSE b END"
    mended = lambda s: _let(rules.sql(strip(f"CASE WHEN length({s}) > 100 THEN {long.replace('a, ', s + ', ', 1)} ELSE {s} END"), opened), "b", _let(rules.sql(holy, text.CLOSE_WORDS), "c", _let(things, "d", last)))
    if observed:
        parts = f"list_filter(list_transform(list_filter(string_split_regex(whole, '[.!?]+'), lambda s: {strip('s')} <> ''), lambda s: {mended('s')}), lambda y: y <> '')"
        joined = f"array_to_string({parts}, '. ')"
    else:
        bare, mark = "regexp_replace(s, '[.!?]*$', '')", "regexp_extract(s, '[.!?]*$')"
        parts = f"list_transform(regexp_extract_all(whole, '(?s)[^.!?]+[.!?]*|[.!?]+'), lambda s: {_let(bare, 'r', mended('r'))} || {mark})"
        joined = f"array_to_string(list_filter({parts}, lambda y: y <> ''), ' ')"
    return _let(t, "whole", strip(rules.sql(joined, [text.SPACE_RUNS])))


SQL["contextual_corrections"], SQL["contextual_observed"] = (f"SELECT doc_id, {_sentences_sql(SEEDED_SQL, x)} AS out FROM documents" for x in (False, True))
rewriting("tts_numbers", text.spoken_numbers, _numbers_sql("{t}"))
rewriting("tts_commas", text.breaths, _breaths_sql("{t}", False))
_said_sql = rules.sql(_numbers_sql("{t}"), _spoken_rules)
rewriting("tts_all", text.spoken, _breaths_sql(_said_sql, False))
rewriting("tts_observed", lambda t: text.spoken(t, True), _breaths_sql(_said_sql, True))
_lines_sql = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: " + TRIM_SQL.replace("{x}", "x") + "), lambda x: x <> '')"
_merged_sql = r"""CASE WHEN NOT regexp_matches(a[-1], '[.!?]\s*$') THEN list_concat(a[:-2], [a[-1] || ' ' || b[1]])
  WHEN regexp_matches(b[1], '^(\d+\.|[가-힣]\)|•|-|※)') THEN list_concat(a, ['', b[1]]) ELSE list_concat(a, b) END"""


def _paragraphs_sql(t: str) -> str:
    lines = _lines_sql.replace("{t}", t)
    return f"CASE WHEN len({lines}) = 0 THEN '' ELSE array_to_string(list_reduce(list_transform({lines}, lambda x: [x]), lambda a, b: {_merged_sql}), chr(10)) END"


rewriting("paragraph_merge", text.paragraphs, _paragraphs_sql("{t}"), seed=False)
rewriting("line_trim", text.trim_lines, r"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))", seed=False)
rewriting("final_validation", text.final, TRIM_SQL.replace("{x}", rules.sql("{t}", [text.SPACE_RUNS])))
USER = [("teh", "the"), ("소율", "소울"), ("학교", "대학교"), ("teh", "THE")]
rewriting("user_dictionary", lambda t: text.user_rules(t, USER), rules.sql("{t}", [rules.Rule(a, b, True) for a, b in dict(USER).items()]))


def _pipeline(name: str, observed: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return text.worker(seeded(documents(spark, sf_dir)), "text", observed).select("doc_id", F.col("text").alias("out"))

    QUERIES[name] = run


def _worker_sql(observed: bool) -> str:
    """The stages one after the other, a table each."""
    between = text.CHARACTERS if observed else _between
    steps = [rules.sql("t", text.CLEANUP), rules.sql("t", text.MISREAD), None, _sentences_sql("t", observed), _re2_sql(text.SPACING, "t"), TRIM_SQL.replace("{x}", rules.sql("t", _rejoin_sql)), _re2_sql([*between, *text.PHRASES, *text.FORMAL], "t")]
    steps += [rules.sql("t", [_ahead(r) for r in some]) for some in text.ENDING_GROUPS.values()]
    steps += [_paragraphs_sql("t"), _breaths_sql(rules.sql(_numbers_sql("t"), _spoken_rules), observed), f"array_to_string({_lines_sql.replace('{t}', 't')}, chr(10))"]
    out = [f"s0 AS (SELECT doc_id, {SEEDED_SQL} AS t FROM documents)"]
    for k, step in enumerate(steps):
        made = f"SELECT doc_id, {step} AS t FROM s{k}" if step else f"SELECT doc_id, out AS t FROM ({_squashed_sql(_re2_sql(text.DYNAMIC[:-1], 't'), _gaps_sql('s'), f's{k}')})"
        out.append(f"s{k + 1} AS MATERIALIZED ({made})")
    return "WITH " + ", ".join(out) + f" SELECT doc_id, t AS out FROM s{len(steps)}"


_pipeline("worker_pipeline", False)
_pipeline("worker_pipeline_observed", True)
SQL["worker_pipeline"], SQL["worker_pipeline_observed"] = _worker_sql(False), _worker_sql(True)
_unspaced = lambda some: [rules.Rule(r.found.replace(r"(\w)", r"([\p{L}\p{N}_])"), r.put, r.plain) for r in some]
rewriting("corrected_pipeline", text.corrected, rules.sql("{t}", [*_letters_sql, *_unspaced(text.SEPARATED), *text.SPECIAL, *text.TERMS, *text.PLAIN_ENDINGS]))


QUALITY_SQL = r"""CASE WHEN coalesce(x, '') = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.8::DOUBLE
  + coalesce(length(regexp_replace(x, '[^가-힣]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(x, '\s', '', 'g')), 0), 0.0) * 0.1::DOUBLE
  + CASE WHEN length(regexp_replace(x, '[^.]', '', 'g')) > 0 AND length(x)::DOUBLE / length(regexp_replace(x, '[^.]', '', 'g')) BETWEEN 10 AND 100 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
  - length(regexp_replace(x, '[^？！，；：]', '', 'g')) * 0.01::DOUBLE)) END"""


@query(f"""WITH d AS (SELECT lang, {_tidy_sql.replace('{t}', 'text')} AS x FROM documents)
SELECT lang, count(*) AS n, round(avg({QUALITY_SQL}), 6) AS quality, sum(length(regexp_replace(x, '[^가-힯]', '', 'g')))::BIGINT AS hangul,
  sum(length(regexp_replace(x, '[^A-Za-z]', '', 'g')))::BIGINT AS latin FROM d GROUP BY lang""")
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang").select("lang", text.tidy(F.col("text")).alias("x"))
    scored = docs.select("lang", quality.text_quality(F.col("x")).alias("q"), quality.hangul(F.col("x")).alias("h"), quality.latin(F.col("x")).alias("l"))
    return scored.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("quality"), F.sum("h").alias("hangul"), F.sum("l").alias("latin"))


@query(f"SELECT doc_id, round({QUALITY_SQL}, 9) AS quality FROM (SELECT doc_id, {SEEDED_SQL} AS x FROM documents)")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(documents(spark, sf_dir)).select("doc_id", F.round(quality.text_quality(F.col("text")), 9).alias("quality"))


@query(f"""SELECT doc_id, length(regexp_replace(t, '[^가-힯]', '', 'g'))::BIGINT AS hangul, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS latin,
  length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS digits FROM (SELECT doc_id, {SEEDED_SQL} AS t FROM documents)""")
def char_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return seeded(documents(spark, sf_dir)).select("doc_id", *(x.cast("long").alias(n) for n, x in (("hangul", quality.hangul(t)), ("latin", quality.latin(t)), ("digits", quality.count_chars(t, "0-9")))))


@query(rf"""WITH d AS (SELECT doc_id, {SEEDED_SQL} AS a FROM documents), e AS (SELECT doc_id, a, {_tidy_sql.replace('{t}', 'a')} AS b FROM d)
SELECT doc_id, (length(a) - length(b) + abs(len(regexp_extract_all(a, '\S+')) - len(regexp_extract_all(b, '\S+'))))::BIGINT AS corrections,
  round((length(b) - length(a)) * 100.0::DOUBLE / length(a), 6) AS change_rate FROM e""")
def correction_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(documents(spark, sf_dir)).select("doc_id", F.col("text").alias("a"), text.tidy(F.col("text")).alias("b"))
    return docs.select("doc_id", quality.corrections(F.col("a"), F.col("b")).cast("long").alias("corrections"), F.round(quality.change_rate(F.length("a"), F.length("b")), 6).alias("change_rate"))


_hit_steps = ", ".join(f"{rules.sql(f't{k}', [r])} AS t{k + 1}" for k, r in enumerate(text.EXTENDED))
_hit_total = " + ".join(f"contains(t{k}, {_sql_text(r.found)})::INTEGER" for k, r in enumerate(text.EXTENDED))
_final_sql = TRIM_SQL.replace("{x}", "array_to_string(" + _lines_sql.replace("{t}", rules.sql("y", [text.SPACE_RUNS])) + ", chr(10))")


@query(f"""WITH a AS (SELECT doc_id, {SEEDED_SQL} AS t FROM documents), b AS MATERIALIZED (SELECT doc_id, t, {_tidy_sql.replace('{t}', 't')} AS t0 FROM a),
c AS MATERIALIZED (SELECT doc_id, t, {_hit_steps}, {_hit_total} AS hits FROM b),
e AS MATERIALIZED (SELECT doc_id, t, hits, {rules.sql(_re2_sql(text.WIDE_SPACING, f't{len(text.EXTENDED)}'), text.STRUCTURE)} AS y FROM c),
f AS MATERIALIZED (SELECT doc_id, t, hits, {_final_sql} AS x FROM e)
SELECT doc_id, x AS out, hits, (length(t) - length(x) + abs(len(regexp_extract_all(t, '\\S+')) - len(regexp_extract_all(x, '\\S+'))))::BIGINT AS corrections, round({QUALITY_SQL}, 9) AS quality FROM f""")
def enhanced_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(documents(spark, sf_dir))
    out = text.enhanced(docs.withColumn("out", F.col("text")), "out")
    return out.select("doc_id", "out", "hits", quality.corrections(F.col("text"), F.col("out")).cast("long").alias("corrections"), F.round(quality.text_quality(F.col("out")), 9).alias("quality"))


@query(f"WITH d AS (SELECT doc_id, {SEEDED_SQL} AS t0, {_hit_steps} FROM documents) SELECT doc_id, {_hit_total} AS hits FROM d")
def extended_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(documents(spark, sf_dir)).select("doc_id", text.extended_hits(F.col("text")).alias("hits"))


PAIRS = (("teh", "the"), ("소율", "소울"), ("곧경", "곤경"), ("헐 수", "할 수"), ("그옷은", "그것은"), ("the", "The"), ("없는말", "있는말"))


@query("WITH p(wrong, correct) AS (VALUES " + ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in PAIRS) + f""")
SELECT wrong, count(*) FILTER (contains(t, correct) AND NOT contains(t, wrong)) AS fixed, count(*) FILTER (contains(t, wrong)) AS unfixed,
  count(*) FILTER (NOT contains(t, wrong) AND NOT contains(t, correct)) AS unknown,
  round(count(*) FILTER (contains(t, correct) AND NOT contains(t, wrong))::DOUBLE / count(*), 6) AS rate
FROM p, (SELECT {rules.sql(SEEDED_SQL, text.MISREAD)} AS t FROM documents) GROUP BY wrong""")
def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = seeded(documents(spark, sf_dir)).select(rules.apply(F.col("text"), text.MISREAD).alias("t"))
    # Counts of all pairs from one pass, then a row each: the pairs are a fixed list.
    t, counts = F.col("t"), []
    for wrong, correct in PAIRS:
        bad, good = F.contains(t, F.lit(wrong)), F.contains(t, F.lit(correct))
        counts.append(F.struct(F.lit(wrong).alias("wrong"), F.count_if(good & ~bad).alias("fixed"), F.count_if(bad).alias("unfixed"), F.count_if(~bad & ~good).alias("unknown"), F.count("*").alias("n")))
    told = done.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("p")).select("p.*")
    return told.select("wrong", "fixed", "unfixed", "unknown", F.round(F.col("fixed") / F.col("n"), 6).alias("rate"))


# ---- blocks ---------------------------------------------------------------------------------------------------------


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks: a user an image, value / 500 the confidence."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("pos"), (F.col("value") / 500).alias("confidence"))


@query("SELECT event_id AS pos FROM events WHERE value / 500 > 0.3")
def conf_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.strict(event_blocks(spark, sf_dir)).select("pos")


@query("SELECT event_id AS pos FROM events WHERE value / 500 >= 0.3")
def conf_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.inclusive(event_blocks(spark, sf_dir)).select("pos")


@query("""WITH b AS (SELECT user_id, event_id, value / 500 AS c, max(value / 500) OVER (PARTITION BY user_id) AS m FROM events)
SELECT user_id AS image_id, event_id AS pos FROM b WHERE c >= CASE WHEN m >= 0.7 THEN 0.7 WHEN m >= 0.5 THEN 0.5 ELSE 0.3 END""")
def conf_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.cascade(event_blocks(spark, sf_dir)).select("image_id", "pos")


@query(rf"""WITH b AS (SELECT conv_id, turn, {TRIM_SQL.replace('{x}', 'text')} AS t, CASE WHEN turn % 4 = 0 THEN NULL ELSE ((conv_id * 7 + turn * 3) % 10) / 10.0 END AS c FROM conversations)
SELECT conv_id AS image_id, turn AS pos, t AS text FROM b WHERE t <> '' AND coalesce(c, 1.0) >= 0.3""")
def conf_plainly(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("turn") % 4 != 0, (F.col("conv_id") * 7 + F.col("turn") * 3) % 10 / 10)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("pos"), "text", score.alias("confidence"))
    return blocks.plainly(rows).select("image_id", "pos", "text")


@query("""SELECT user_id AS image_id, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY floor((event_id % 300) / 20) * 20, value, event_id)::INTEGER AS rank FROM events""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("pos"), "value")
    return blocks.reading_rank(rows, F.col("value"), F.col("pos") % 300).select("image_id", "pos", "rank")


def _assembly_sql() -> str:
    """A fold over the blocks: (lines, line) after each."""
    strip = lambda x: TRIM_SQL.replace("{x}", x)
    state = lambda lines, line: f"struct_pack(lines := {lines}, line := {line})"
    push = lambda s: f"CASE WHEN {strip(s + '.line')} <> '' THEN list_append({s}.lines, {strip(s + '.line')}) ELSE {s}.lines END"
    grown = f"""CASE WHEN length(b.line) <= 2 THEN {state('a.lines', 'a.line || b.line')} WHEN a.line = '' THEN {state('a.lines', 'b.line')}
  WHEN NOT (suffix(a.line, ' ') OR suffix(a.line, '-')) THEN {state(push('a'), 'b.line')}
  ELSE {state('a.lines', "a.line || CASE WHEN starts_with(b.line, '-') THEN '' ELSE ' ' END || b.line")} END"""
    bounded = _let(grown, "g", f"CASE WHEN length(g.line) > 100 THEN {state(push('g'), chr(39) * 2)} ELSE g END")
    texts = f"list_filter(list_transform(texts, lambda x: {strip('x')}), lambda x: x <> '')"
    empty = state("[]::VARCHAR[]", "''")
    return f"""WITH t AS (SELECT conv_id, list(text ORDER BY turn, text) AS texts FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, list_reduce(list_transform({texts}, lambda x: {state('[]::VARCHAR[]', 'x')}), lambda a, b: {bounded}, {empty}) AS s FROM t)
SELECT conv_id, array_to_string({push('s')}, chr(10)) AS out FROM r"""


@query(_assembly_sql())
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("texts"))
    return rows.select("conv_id", blocks.assembled(F.col("texts")).alias("out"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS joined FROM conversations GROUP BY conv_id")
def block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.joined(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, string_agg('=== ' || role || ' ===' || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn, '=== ' || role || ' ===' || chr(10) || text || chr(10) || chr(10)) AS report FROM conversations GROUP BY conv_id")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report(table(spark, sf_dir, "conversations"), "role", "text", "turn", "conv_id")


@query(f"""WITH r AS (SELECT doc_id, 'raw' AS engine, 1 AS p, text AS t FROM documents UNION ALL
  SELECT doc_id, 'tidy', 2, {_tidy_sql.replace('{t}', 'text')} FROM documents UNION ALL
  SELECT doc_id, 'spaced', 3, {rules.sql('text', text.STRUCTURE)} FROM documents)
SELECT doc_id, engine, length(t)::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, p) AS k FROM r) WHERE k = 1""")
def best_engine_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    best = blocks.best_of({"raw": t, "tidy": text.tidy(t), "spaced": rules.apply(t, text.STRUCTURE)})
    # explode keeps the filter from working the texts out a second time.
    return documents(spark, sf_dir).select("doc_id", F.explode(F.filter(F.array(best), lambda b: b.isNotNull())).alias("b")).select("doc_id", "b.engine", F.length("b.text").alias("n"))


@query("""WITH s AS (SELECT user_id, ['clean', 'shadow', 'thin'][(event_id % 3 + 1)::INTEGER] AS preset, event_id % 3 AS p, max(value) AS score FROM events GROUP BY ALL)
SELECT user_id, preset, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, p) AS k FROM s) WHERE k = 1""")
def preset_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("clean"), F.lit("shadow"), F.lit("thin")), (F.col("event_id") % 3 + 1).cast("int"))
    scores = table(spark, sf_dir, "events").groupBy("user_id", name.alias("preset"), (F.col("event_id") % 3).alias("p")).agg(F.max("value").alias("score"))
    return analytics.best_preset(scores, "user_id", "preset", "p", "score")


@query("SELECT user_id, round(median(value - 245), 6) AS angle FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 20 GROUP BY user_id")
def median_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 lines of an image tell its angle."""
    out = analytics.first_median(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") - 245)
    return out.select("user_id", F.round("angle", 6).alias("angle"))


@query("""SELECT user_id, round(least(1.0, var_pop(value) / 1000) * 0.4 + stddev_pop(value) / 255 * 0.4 + (1 - abs(avg(value) / 255 - 0.5) * 2) * 0.2, 6) AS quality
FROM events GROUP BY user_id""")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.var_pop("value").alias("v"), F.stddev_pop("value").alias("s"), F.avg("value").alias("m"))
    return rows.select("user_id", F.round(quality.image_quality(F.col("v"), F.col("s"), F.col("m")), 6).alias("quality"))


def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an engine's nested results: those of one turn failed, some of them without saying why."""
    n, k = F.col("n"), F.col("conv_id")
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), said.alias("said"))
    return rows.select(
        k.cast("string").alias("image_id"), (n > 2).alias("success"), F.array_join("said", " ").alias("final_text"), F.array_join("said", "|").alias("raw_text"), (n / 8).alias("processing_time"),
        F.struct((k % 10 / 10).alias("image_quality"), (k % 7 / 7).alias("text_quality"), results.overall(k % 10 / 10, k % 7 / 7).alias("overall_quality")).alias("quality_metrics"),
        F.struct(n.cast("int").alias("total_blocks"), F.when(k % 3 > 0, (k % 3).cast("int")).alias("corrections_applied"), F.lit(True).alias("image_preprocessed"), F.lit(False).alias("morpheme_analyzed")).alias("processing_stats"),
        F.when((n <= 2) & (k % 2 == 0), F.concat(F.lit("only "), n.cast("string"))).alias("error"),
    )


@query("""WITH r AS (SELECT conv_id AS k, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS t, string_agg(text, '|' ORDER BY turn) AS raw FROM conversations GROUP BY conv_id)
SELECT k::VARCHAR AS image_id, n > 2 AS success, CASE WHEN n > 2 THEN left(t, 100) ELSE '' END AS preview, CASE WHEN n > 2 THEN round_even(((k % 10) / 10 + (k % 7) / 7) / 2, 3) ELSE 0.0 END AS confidence,
  n / 8 AS processing_time, md5(raw) AS raw, (k % 3)::INTEGER AS corrections, n::INTEGER AS blocks_count, coalesce(CASE WHEN n <= 2 THEN CASE WHEN k % 2 = 0 THEN 'only ' || n ELSE 'unknown error' END END, '-') AS error FROM r""")
def results_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results as plain columns, failures with their error, texts as previews."""
    out = results.flat(nested_results(spark, sf_dir))
    return out.select("image_id", "success", results.preview(F.col("text")).alias("preview"), "confidence", "processing_time", F.md5("raw_text").alias("raw"), "corrections", "blocks_count", F.coalesce("error", F.lit("-")).alias("error"))


@query("""SELECT conv_id, count(*) > 0 AS success, md5(string_agg(text, chr(10) ORDER BY turn)) AS text, count(*) AS total_blocks,
  round(avg(coalesce(CASE WHEN turn % 3 > 0 THEN (conv_id + turn) % 10 / 10 END, 1.0)), 9) AS confidence FROM conversations GROUP BY conv_id""")
def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result an image from its blocks; blocks without a confidence are certain."""
    score = F.when(F.col("turn") % 3 > 0, (F.col("conv_id") + F.col("turn")) % 10 / 10)
    found = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", score.alias("confidence"))
    return blocks.engine_result(found, "conv_id").select("conv_id", "success", F.md5("text").alias("text"), "total_blocks", F.round("confidence", 9).alias("confidence"))


#: What stands for particles in texts without Hangul.
PARTICLES = ("the", "of", "le", "la", "der", "die", "el", "que", "은", "는", "이", "가")
_PARTICLES_SQL = "(" + ", ".join(map(_sql_text, PARTICLES)) + ")"


@query(rf"""WITH d AS (SELECT doc_id, string_split({SEEDED_SQL}, '. ') AS ss FROM documents),
o AS (SELECT doc_id, list_transform(list_transform(ss, lambda x: {TRIM_SQL.replace('{x}', 'x')}), lambda x: CASE WHEN length(x) <= 3 THEN x ELSE
  list_reduce(regexp_split_to_array(x, '\s+'), lambda a, b: a || CASE WHEN b IN {_PARTICLES_SQL} THEN '' ELSE ' ' END || b) END) AS ss FROM d)
SELECT doc_id, array_to_string(list_filter(ss, lambda x: x <> ''), '. ') AS out FROM o""")
def morpheme_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing by an analyzer that takes words for forms and knows some particles."""
    known = set(PARTICLES)
    docs = seeded(documents(spark, sf_dir)).withColumnRenamed("text", "out")
    return text.morphology(docs, "out", lambda s: [(w, "J" if w in known else "N") for w in s.split()]).select("doc_id", "out")


_COUNTED = [r for r in text.MISREAD if r.plain][:40]
_count_steps = ", ".join(f"{rules.sql(f't{k}', [r])} AS t{k + 1}" for k, r in enumerate(_COUNTED))
_count_total = " + ".join(f"(length(t{k}) - length(replace(t{k}, {_sql_text(r.found)}, ''))) // {len(r.found)}" for k, r in enumerate(_COUNTED))


@query(f"WITH d AS (SELECT doc_id, {SEEDED_SQL} AS t0, {_count_steps} FROM documents) SELECT doc_id, ({_count_total})::BIGINT AS changed FROM d")
def rule_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places forty rules change in each text, each counted on what those before it left."""
    docs = seeded(documents(spark, sf_dir))
    return docs.select("doc_id", rules.occurrences(F.col("text"), _COUNTED).cast("long").alias("changed"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(replace(source || '+' || lang || '+ en+' || source, '+', ','), ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS langs FROM documents""")
def language_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat("source", F.lit("+"), "lang", F.lit("+ en+"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(files.sorted_languages(spec), "|").alias("langs"))


@query("""SELECT event_id, 'k=' || (CASE WHEN event_id % 4 = 0 THEN '1' ELSE props->>'$.k' END) || ' lang=' || (CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'ko' END) || ' size=' || '7' AS options FROM events""")
def options_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that events bring, over defaults: k in three of four, the language in one of three, the size never."""
    defaults = F.create_map(*map(F.lit, ("k", "1", "lang", "ko", "size", "7")))
    given = F.when(F.col("event_id") % 4 > 0, F.from_json("props", "map<string,string>"))
    more = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("lang"), F.col("event_type")))
    out = results.merged(results.merged(defaults, given), more)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_keys(out)), lambda k: F.concat(k, F.lit("="), F.try_element_at(out, k))), " ").alias("options"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter([string_split(text, ' ')[1:k::INTEGER] FOR k IN range(0, 4)], lambda x: len(x) >= 2) AS good FROM conversations)
SELECT conv_id, turn, len(good)::INTEGER AS n, coalesce(array_to_string(good[1], '_'), '-') AS first FROM w""")
def results_well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of no to three entries a block: those of two and more are results."""
    found = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(F.split("text", " "), F.lit(1), k))
    good = results.well_formed(F.concat(found, F.array(F.lit(None).cast("array<string>"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(good).alias("n"), F.coalesce(F.array_join(F.get(good, 0), "_"), F.lit("-")).alias("first"))


@query(f"""SELECT vec_id, (vec_id % 7 > 0 AND vec_id % 11 > 0) AS success, CASE WHEN vec_id % 7 > 0 AND vec_id % 11 > 0 THEN 2 ELSE 0 END AS total_blocks, 'stub' AS engine, 'ko+en' AS languages,
  CASE WHEN vec_id % 11 = 0 THEN 'an empty file' WHEN vec_id % 7 = 0 THEN 'the file ends before its pixels' ELSE '-' END AS error, CASE WHEN vec_id % 7 > 0 AND vec_id % 11 > 0 THEN '샘플 텍스트.' ELSE '' END AS text FROM embeddings""")
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files through the whole job: decoded, read, repaired, with errors as rows."""
    out = job.recognised(rasters.decoded(graymaps(spark, sf_dir), "vec_id"), "stub", "ko+ en")
    return out.select(F.col("image_id").cast("long").alias("vec_id"), "success", F.col("total_blocks").cast("int").alias("total_blocks"), "engine", "languages", F.coalesce("error", F.lit("-")).alias("error"), "text")


# ---- logs -----------------------------------------------------------------------------------------------------------


@query("SELECT sum(user_id % 5)::BIGINT AS total_corrections, sum(user_id % 3)::BIGINT AS morpheme_corrections, round_even(sum(value::DECIMAL(18,2))::DOUBLE / count(*), 3) AS average_processing_time, count(*) AS total_processed FROM events")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.text_stats(table(spark, sf_dir, "events"), F.col("user_id") % 5, F.col("user_id") % 3, F.col("value").cast("decimal(18,2)"))


@query(f"WITH c AS ({SQL['corrected_pipeline']}) SELECT count(*) FILTER (c.out <> t) AS applied, count(*) AS total FROM c JOIN (SELECT doc_id, {SEEDED_SQL} AS t FROM documents) d USING (doc_id)")
def corrections_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.applied(seeded(documents(spark, sf_dir)), F.col("text"), text.corrected(F.col("text")))


@query("""SELECT ts::DATE AS day, round(avg(value), 6) AS avg_accuracy, round(avg(user_id), 6) AS avg_time, count(*) AS n
FROM events WHERE ts::DATE >= DATE '2024-01-31' - 20 GROUP BY 1""")
def daily_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.daily_trends(analytics.since(table(spark, sf_dir, "events"), "ts", "2024-01-31", 20), "ts", "value", "user_id")
    return out.select("day", F.round("avg_accuracy", 6).alias("avg_accuracy"), F.round("avg_time", 6).alias("avg_time"), "n")


@query(f"""WITH t AS ({SQL['daily_trends']}) SELECT string_agg(day::VARCHAR, ',' ORDER BY day DESC) AS days, string_agg(n::VARCHAR, ',' ORDER BY day DESC) AS counts,
  string_agg(round(avg_time * 1000)::BIGINT::VARCHAR, ',' ORDER BY day DESC) AS times FROM t""")
def trend_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily trends as one row of lists, newest day first."""
    out = analytics.columnar(daily_trends(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",")
    return out.select(joined(F.col("day").cast("array<string>")).alias("days"), joined(F.col("n").cast("array<string>")).alias("counts"), joined(F.transform("avg_time", lambda x: F.round(x * 1000).cast("long").cast("string"))).alias("times"))


@query("""SELECT event_type AS original, 'u' || (user_id % 9) AS corrected, count(*) AS n, round(avg(value / 500), 6) AS confidence
FROM events GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""")
def error_patterns_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("original"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("corrected"), (F.col("value") / 500).alias("confidence"))
    return analytics.error_patterns(log).withColumn("confidence", F.round("confidence", 6))


@query("SELECT event_id, sum(value::DECIMAL(18,2)) OVER w::DOUBLE / count(*) OVER w AS running_mean FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_mean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return analytics.running_mean(rows, "event_id", F.col("value").cast("decimal(18,2)")).select("event_id", "running_mean")


@query("""SELECT event_id, sum(CASE WHEN value >= 100 THEN value::DECIMAL(18,2) END) OVER w::DOUBLE / nullif(count(CASE WHEN value >= 100 THEN 1 END) OVER w, 0) AS running_mean
FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_mean_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    value = F.when(F.col("value") >= 100, F.col("value").cast("decimal(18,2)"))
    return analytics.running_mean(rows, "event_id", value).select("event_id", "running_mean")


@query("""SELECT count(*) AS total, count(*) FILTER (value >= 100) AS successful, round_even(count(*) FILTER (value >= 100) * 100.0::DOUBLE / count(*), 1) AS success_rate,
  round_even(sum(value::DECIMAL(18,2))::DOUBLE, 3) AS total_time, round_even(sum(value::DECIMAL(18,2))::DOUBLE / count(*), 3) AS avg_time FROM events""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.batch_stats(table(spark, sf_dir, "events"), F.col("value") >= 100, F.col("value").cast("decimal(18,2)"))


@query("""WITH r AS (SELECT user_id, event_id, value / 500 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS total, round_even(avg(s), 3) AS avg_score, round_even(count(*) FILTER (s >= 0.7) * 100.0::DOUBLE / count(*), 1) AS high_share,
  string_agg(round(s * 10000)::BIGINT::VARCHAR, ',' ORDER BY event_id) FILTER (k <= 10) AS last_scores FROM r GROUP BY user_id""")
def image_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500).alias("s"))
    out = analytics.history_stats(rows, "user_id", "event_id", "s")
    return out.withColumn("last_scores", F.array_join(F.transform("last_scores", lambda x: F.round(x * 10000).cast("long").cast("string")), ","))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN coalesce(d.n_chars > 500, false) AND coalesce(l.quality = 1, false) THEN 'both'
  WHEN coalesce(d.n_chars > 500, false) THEN 'legacy_only' WHEN coalesce(l.quality = 1, false) THEN 'ultimate_only' ELSE 'both_failed' END AS outcome
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def legacy_vs_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("ok"))
    new = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return analytics.compare_systems(old, new, "doc_id")


@query(f"WITH o AS ({SQL['legacy_vs_new']}) SELECT outcome, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM o), 6) AS rate FROM o GROUP BY outcome")
def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outcome_rates(legacy_vs_new(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query("SELECT user_id, event_id, floor(row_number() OVER (ORDER BY event_id) * 100 / count(*) OVER ())::INTEGER AS percent FROM events")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.progress(table(spark, sf_dir, "events"), "event_id").select("user_id", "event_id", "percent")


# ---- words ----------------------------------------------------------------------------------------------------------


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id") % 40).alias("word"), F.col("props").alias("context"), F.lit("general").alias("domain"), "ts", F.col("event_id").alias("seq"))


@query("SELECT event_type || (user_id % 40) AS word, count(*) AS frequency, max(ts) AS created_at, max(ts) AS last_used FROM events GROUP BY 1")
def dictionary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_words(spark, sf_dir)
    # Even ids make the state that odd ids are merged into.
    state = dictionary.upsert(None, events.where("seq % 2 = 0"))
    return dictionary.upsert(state, events.where("seq % 2 = 1")).select("word", "frequency", "created_at", "last_used")


@query("""SELECT word, frequency FROM (SELECT event_type || (user_id % 40) AS word, count(*) AS frequency, max(ts) AS last_used FROM events GROUP BY 1)
WHERE word ILIKE 'Cli%' ORDER BY frequency DESC, last_used DESC, word LIMIT 5""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.suggestions(dictionary.upsert(None, event_words(spark, sf_dir)), "Cli").select("word", "frequency")


def scored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII words of conversations with made-up scores, one fewer than words: the last word has none."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0)).alias("words"))
    scores = F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: ((F.col("doc_id") * 7 + i * 3) % 10) / 10)
    pairs = F.posexplode(dictionary.zipped(F.col("words"), F.slice(scores, 1, F.greatest(F.lit(0), F.size("words") - 1)))).alias("pos", "p")
    return rows.where(F.size("words") > 1).select("doc_id", pairs).select("doc_id", "pos", "p.word", "p.score")


def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("frequency"), F.lit("2024-01-01").cast("timestamp_ntz").alias("last_used"))


@query(r"""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM c WHERE len(w) > 1),
s AS (SELECT doc_id, word, pos::INTEGER AS pos, ((doc_id * 7 + pos * 3) % 10) / 10 AS score FROM t WHERE pos < n - 1),
u AS (SELECT word, count(*) AS f FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark) GROUP BY word),
k AS (SELECT lower(substr(word, 1, 3)) AS prefix, word AS candidate, row_number() OVER (PARTITION BY lower(substr(word, 1, 3)) ORDER BY f DESC, word) AS place FROM u WHERE length(word) >= 3),
d AS (SELECT DISTINCT word FROM s WHERE score < 0.7),
b AS (SELECT word, candidate FROM (SELECT d.word, candidate, row_number() OVER (PARTITION BY d.word ORDER BY levenshtein(d.word, candidate), place) AS r FROM d JOIN k ON lower(substr(d.word, 1, 3)) = prefix WHERE place <= 5) WHERE r = 1)
SELECT doc_id, pos, s.word, CASE WHEN score >= 0.7 THEN s.word WHEN candidate IS NULL THEN '(' || s.word || ')' ELSE '[' || candidate || ']' END AS out
FROM s LEFT JOIN b ON s.word = b.word""")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.repaired(scored_tokens(spark, sf_dir), token_words(spark, sf_dir)).select("doc_id", "pos", "word", "out")


@query("""SELECT event_type AS original, 'u' || (user_id % 9) AS corrected, value / 500 AS confidence, user_id::VARCHAR AS session_id, ts AS created_at FROM events""")
def correction_log_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("original"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("corrected"), (F.col("value") / 500).alias("confidence"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("created_at"), "event_id")
    first, then = (rows.where(f"event_id % 2 = {k}").drop("event_id") for k in (0, 1))
    return dictionary.record_corrections(first, then)


@query("""SELECT 'u' || (user_id % 9) AS word, count(*) AS frequency, arg_max('교정됨: ' || event_type, event_id) AS context FROM events GROUP BY 1""")
def correction_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("original"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("corrected"), F.timestamp_seconds("event_id").alias("created_at"), F.col("event_id").alias("seq"))
    words = dictionary.corrected_words(None, rows.where("seq % 2 = 0"))
    return dictionary.corrected_words(words, rows.where("seq % 2 = 1")).select("word", "frequency", "context")


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of conversations, whatever its letters, with a made-up score; in one place of 13 it has none."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("pos", "word"))
    score = F.when(F.col("pos") % 13 == 5, F.lit(None)).otherwise((F.col("doc_id") * 7 + F.col("pos") * 3) % 10 / 10)
    return rows.select("doc_id", "pos", "word", score.cast("double").alias("score"))


#: A word: anything between ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALL_TOKENS_SQL = rf"""c AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '{WORDS}') AS w FROM conversations),
u AS (SELECT doc_id, unnest(w) AS word, (generate_subscripts(w, 1) - 1)::INTEGER AS pos FROM c),
s AS (SELECT *, CASE WHEN pos % 13 = 5 THEN NULL ELSE ((doc_id * 7 + pos * 3) % 10) / 10 END AS score, row_number() OVER (ORDER BY doc_id, pos) AS t FROM u)"""
_BASE_SQL = rf"base AS (SELECT word, count(*) AS f FROM (SELECT unnest(regexp_extract_all(text, '{WORDS}')) AS word FROM benchmark) GROUP BY word)"


def _edits(a: str, b: str) -> str:
    """Edits between words by characters; the engine's own function goes by bytes."""
    codes = lambda x: f"list_transform(string_split({x}, ''), lambda c: [unicode(c)])"
    cell = f"least(above[j[1] + 1] + 1, r[j[1]] + 1, above[j[1]] + (x[1] <> unicode(substr({b}, j[1], 1)))::INTEGER)"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda i: [i::INTEGER]), lambda r, j: list_append(r, {cell}), [above[1] + 1])"
    slow = f"list_reduce({codes(a)}, lambda above, x: {row}, range(0, length({b}) + 1)::INTEGER[])[length({b}) + 1]"
    return f"CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b}) ELSE {slow} END"


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("frequency"), F.lit("2024-01-01").cast("timestamp_ntz").alias("last_used"))


# Each version of a word holds from its sighting to the next; a doubtful word meets the version of its moment of every word that begins like it.
@query(rf"""WITH {_ALL_TOKENS_SQL}, {_BASE_SQL},
d AS (SELECT doc_id, pos, word, t, {_LOW.format('substr(word, 1, 3)')} AS p FROM s WHERE score < 0.7),
v AS (SELECT word, t, row_number() OVER (PARTITION BY word ORDER BY t) AS k FROM s WHERE score >= 0.7),
l AS MATERIALIZED (SELECT word, {_LOW.format('word')} AS low FROM (SELECT word FROM v UNION SELECT word FROM base)), e AS MATERIALIZED (SELECT DISTINCT p || '%' AS p FROM d),
m AS (SELECT p, word AS candidate FROM e JOIN l ON low LIKE p),
q AS (SELECT d.t, d.word, m.candidate FROM d JOIN m ON d.p || '%' = m.p),
n AS (SELECT q.t, q.word, q.candidate, coalesce(b.f, 0) + coalesce(v.k, 0) AS f, coalesce(v.t, -1) AS used FROM q ASOF LEFT JOIN v ON q.candidate = v.word AND q.t > v.t LEFT JOIN base b ON b.word = q.candidate),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f DESC, used DESC, candidate) AS place FROM n WHERE f > 0),
b AS (SELECT t, arg_min(candidate, {_edits('word', 'candidate')} * 10 + place) AS candidate FROM r WHERE place <= 5 GROUP BY t)
SELECT doc_id, pos, word, CASE WHEN score IS NULL OR score >= 0.7 THEN word WHEN candidate IS NULL THEN '(' || word || ')' ELSE '[' || candidate || ']' END AS out FROM s LEFT JOIN b USING (t)""")
def context_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful words by the list as the words before them left it."""
    return wordlist.repaired_in_order(all_tokens(spark, sf_dir), benchmark_words(spark, sf_dir)).select("doc_id", "pos", "word", "out")


@query(rf"""WITH w AS (SELECT unnest(regexp_extract_all(text, '{WORDS}')) AS word, doc_id FROM documents), l AS (SELECT word, count(*) AS frequency, max(doc_id) AS last_used FROM w GROUP BY word),
a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORDS}')) AS word FROM benchmark),
b AS MATERIALIZED (SELECT *, {_LOW.format('word')} AS low FROM l),
q AS (SELECT DISTINCT CASE length(word) % 4 WHEN 0 THEN substr(word, 1, 1) || '_' || substr(word, 3, 2) WHEN 1 THEN substr(word, 1, 2) WHEN 2 THEN '%' || substr(word, 2, 3) ELSE substr(word, 1, 5) END AS pattern FROM a),
k AS MATERIALIZED (SELECT pattern, {_LOW.format('pattern')} || '%' AS low FROM q),
m AS (SELECT pattern, word, frequency, row_number() OVER (PARTITION BY pattern ORDER BY frequency DESC, last_used DESC, word)::INTEGER AS place FROM k JOIN b ON b.low LIKE k.low)
SELECT pattern, place, word, frequency FROM m WHERE place <= 5""")
def suggestions_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, asked by a table of beginnings, some with wildcards."""
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(F.count("*").alias("frequency"), F.max("doc_id").alias("last_used"))
    word, n = F.col("word"), F.length("word") % 4
    cut = F.when(n == 0, F.concat(F.substring(word, 1, 1), F.lit("_"), F.substring(word, 3, 2))).when(n == 1, F.substring(word, 1, 2)).when(n == 2, F.concat(F.lit("%"), F.substring(word, 2, 3))).otherwise(F.substring(word, 1, 5))
    return wordlist.suggest_many(words, benchmark_words(spark, sf_dir).select(cut.alias("pattern")))


#: Rules that a source has at most.
RULES = 8
_STEPS = ", ".join(
    f"t{k} AS (SELECT t.doc_id, t.source, CASE WHEN r.seq IS NULL THEN t.t WHEN r.kind = 'plain' THEN replace(t.t, r.pattern, r.replacement) ELSE regexp_replace(t.t, r.pattern, r.replacement, 'g') END AS t"
    f" FROM t{k - 1} t LEFT JOIN rules r ON r.source = t.source AND r.seq = {k})"
    for k in range(1, RULES + 1)
)


def source_rules(docs: DataFrame) -> DataFrame:
    """Each source's commonest words of four letters and more as rules: one becomes the next common one, every other is put in marks where it starts a word."""
    words = docs.select("source", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "word")
    ranked = words.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= RULES + 1)
    ranked = ranked.withColumn("next", F.lead("word").over(Window.partitionBy("source").orderBy("seq"))).where(F.col("seq") <= RULES)
    odd = F.col("seq") % 2 == 1
    return ranked.select(F.col("source").alias("owner"), "seq", F.when(odd, "plain").otherwise("regex").alias("kind"), F.when(odd, F.col("word")).otherwise(F.concat(F.lit("( |^)"), "word", F.lit("([a-z]*)"))).alias("pattern"), F.when(odd, F.coalesce("next", F.lit(""))).otherwise(F.concat(F.lit("\\1<"), "word", F.lit("\\2>"))).alias("replacement"))


@query(rf"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS word FROM documents), n AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT source, word, row_number() OVER o AS seq, lead(word) OVER o AS next FROM n WINDOW o AS (PARTITION BY source ORDER BY n DESC, word)),
rules AS (SELECT source, seq, CASE WHEN seq % 2 = 1 THEN 'plain' ELSE 'regex' END AS kind, CASE WHEN seq % 2 = 1 THEN word ELSE '( |^)' || word || '([a-z]*)' END AS pattern,
  CASE WHEN seq % 2 = 1 THEN coalesce(next, '') ELSE '\1<' || word || '\2>' END AS replacement FROM k WHERE seq <= {RULES}),
t0 AS (SELECT doc_id, source, text AS t FROM documents), {_STEPS} SELECT doc_id, t AS out FROM t{RULES}""")
def rules_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the rules of its own source, which are rows."""
    docs = documents(spark, sf_dir, "source")
    return rulebook.apply_rows(docs, source_rules(docs), "source").select("doc_id", F.col("text").alias("out"))


@query("SELECT event_type, round(median(value), 9) AS median FROM events GROUP BY event_type")
def exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups of very many values each."""
    return selection.exact_medians(table(spark, sf_dir, "events"), "event_type", "value", 1000).select("event_type", F.round("median", 9).alias("median"))


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l),
s AS (SELECT doc_id, n, {TRIM_SQL.replace('{x}', 'line')} AS line FROM u),
p AS (SELECT doc_id, line, row_number() OVER o - 1 AS pos, lag(line) OVER o AS last FROM s WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT *, CASE WHEN last IS NULL THEN '' WHEN NOT regexp_matches(last, '[.!?]$') THEN ' ' WHEN regexp_matches(line, '^(\d+\.|[가-힣]\)|•|-|※)') THEN chr(10) || chr(10) ELSE chr(10) END AS before FROM p)
SELECT doc_id, pos, before, line, sum((before <> ' ')::INTEGER) OVER w::BIGINT AS paragraph, (sum(length(before) + length(line)) OVER w - length(before) - length(line))::BIGINT AS start
FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def paragraphs_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as rows, with what stands before each."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return layout.paragraph_lines(lines, "doc_id", "n")


@query(r"""WITH e AS (SELECT doc_id, strlen('=== ' || doc_id || ' ===' || chr(10) || text || chr(10)) + 1 AS bytes FROM documents)
SELECT doc_id, (sum(bytes) OVER (ORDER BY doc_id) - bytes)::BIGINT AS start, bytes::BIGINT AS bytes FROM e""")
def report_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's entry lies in the one report of all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("place"))
    return layout.report_places(docs, "doc_id", "text", "place").select("doc_id", "start", "bytes")


# The list after three commits: a row is its word's last sighting, and its id counts all sightings up to it.
@query("""WITH e AS (SELECT event_type || (user_id % 40) AS word, 0 AS kind, ts, event_id, props AS context, event_id % 3 AS part FROM events
  UNION ALL SELECT 'u' || (user_id % 9), 1, ts, event_id, '교정됨: ' || event_type, event_id % 3 FROM events),
o AS (SELECT *, row_number() OVER (ORDER BY part, ts, kind, event_id) AS id FROM e)
SELECT max(id) AS id, word, count(*) AS frequency, arg_max(context, id) AS context, arg_max(ts, id) AS last_used FROM o GROUP BY word""")
def store_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored word list after sightings and corrections came in three commits."""
    events, kept = table(spark, sf_dir, "events"), store.Store(spark, f"{stored.folder(spark)}/store-{uuid.uuid4().hex}")
    seen = events.select(F.concat("event_type", F.col("user_id") % 40).alias("word"), F.col("props").alias("context"), F.lit("general").alias("domain"), "ts", F.col("event_id").alias("seq"))
    fixed = events.select(F.col("event_type").alias("original"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("corrected"), (F.col("value") / 500).alias("confidence"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    for k in range(3):
        kept.commit(corrections=fixed.where(F.col("seq") % 3 == k), words=seen.where(F.col("seq") % 3 == k))
    return kept.table("user_words").select("id", "word", "frequency", "context", F.col("last_used").cast("timestamp_ntz").alias("last_used"))


@query("""SELECT row_number() OVER (ORDER BY event_id % 3, ts, event_id) AS id, event_type AS original, 'u' || (user_id % 9) AS corrected, round(value / 500, 9) AS confidence FROM events""")
def store_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored corrections of the same commits, their ids without gaps."""
    events, kept = table(spark, sf_dir, "events"), store.Store(spark, f"{stored.folder(spark)}/store-{uuid.uuid4().hex}")
    fixed = events.select(F.col("event_type").alias("original"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("corrected"), (F.col("value") / 500).alias("confidence"), F.lit("s").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    for k in range(3):
        kept.commit(corrections=fixed.where(F.col("seq") % 3 == k))
    return kept.table("corrections").select("id", "original", "corrected", F.round("confidence", 9).alias("confidence"))


@query(f"""WITH d AS (SELECT {SEEDED_SQL} AS a FROM documents), e AS (SELECT a, {_tidy_sql.replace('{t}', 'a')} AS b FROM d)
SELECT count(*) AS rows, sum(length(a) - length(b) + abs(len(regexp_extract_all(a, '\\S+')) - len(regexp_extract_all(b, '\\S+'))))::BIGINT AS total_corrections, count(*) FILTER (a <> b) AS changed FROM e""")
def counters_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pass that writes tidied documents counts on its way."""
    docs = seeded(documents(spark, sf_dir)).withColumn("out", text.tidy(F.col("text")))
    counters = metrics.text_counters("text", "out")
    stored.stored(counters.watch(docs).select("doc_id", "out"), "tidied")
    told = counters.totals()
    return spark.range(1).select(*(F.lit(told[n]).cast("long").alias(n) for n in ("rows", "total_corrections", "changed")))


# ---- images ---------------------------------------------------------------------------------------------------------

#: A vector of 64 as an image of 8 x 8, and its pixels as a table.
SIDE = 8
PIXELS_SQL = f"""p AS (SELECT vec_id, (i - 1) // {SIDE} AS y, (i - 1) % {SIDE} AS x, v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i,
  (floor(abs(e::DOUBLE) * 4096)::BIGINT % 256)::INTEGER AS v FROM embeddings))"""
_AROUND_SQL = f"""n AS (SELECT c.vec_id, c.y, c.x, c.v AS own, q.v FROM p c, (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b, p q
  WHERE q.vec_id = c.vec_id AND q.y = least({SIDE - 1}, greatest(0, c.y + dy)) AND q.x = least({SIDE - 1}, greatest(0, c.x + dx)))"""


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = F.transform("embedding", lambda e: F.lpad(F.hex(F.floor(F.abs(e.cast("double")) * 4096) % 256), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(pixel, "")).alias("data"))


def _kernel(name: str, step: Callable, pixel: str, more: str = "", rows: str = "p") -> None:
    """A query (vec_id, out): an image after one kernel, in hex. ``pixel`` is a pixel's value in SQL over ``rows``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return images.preprocess(small_images(spark, sf_dir), (step,)).select(F.col("image_id").cast("long").alias("vec_id"), F.lower(F.hex("data")).alias("out"))

    QUERIES[name] = run
    SQL[name] = f"WITH {PIXELS_SQL}{more}, o AS (SELECT vec_id, y, x, ({pixel})::INTEGER AS v FROM {rows}) SELECT vec_id, string_agg(printf('%02x', v), '' ORDER BY y, x) AS out FROM o GROUP BY vec_id"


_kernel("image_invert_dark", images.invert_if_dark, "CASE WHEN avg(v) OVER (PARTITION BY vec_id) < 127 THEN 255 - v ELSE v END")
_HISTOGRAM_SQL = """, h AS (SELECT vec_id, v, count(*) AS n FROM p GROUP BY vec_id, v), k AS (SELECT vec_id, v, sum(n) OVER (PARTITION BY vec_id ORDER BY v) AS c, first(n) OVER (PARTITION BY vec_id ORDER BY v) AS low, sum(n) OVER (PARTITION BY vec_id) AS total FROM h)"""
_kernel("image_equalize", images.equalize, "CASE WHEN total = low THEN v ELSE round_even((c - low) * 255.0::DOUBLE / (total - low), 0) END", _HISTOGRAM_SQL, "p JOIN k USING (vec_id, v)")
_OTSU_SQL = """, g AS (SELECT vec_id, unnest(range(256))::INTEGER AS t FROM (SELECT DISTINCT vec_id FROM p)),
w AS (SELECT g.vec_id, t, count(*) FILTER (v <= t) AS w, coalesce(sum(v) FILTER (v <= t), 0) AS m, count(*) AS n, sum(v) AS total FROM g JOIN p USING (vec_id) GROUP BY g.vec_id, t),
b AS (SELECT vec_id, t, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN w IN (0, n) THEN -1.0 ELSE (total::DOUBLE * w / n - m) ^ 2 / (w * (n - w)) END DESC, t) AS r FROM w)"""
_kernel("image_otsu", images.threshold, "CASE WHEN v > t THEN 255 ELSE 0 END", _OTSU_SQL, "p JOIN (SELECT vec_id, t FROM b WHERE r = 1) USING (vec_id)")
_kernel("image_median", images.median_blur, "v", f", {_AROUND_SQL}, m AS (SELECT vec_id, y, x, median(v) AS v FROM n GROUP BY vec_id, y, x)", "m")
_kernel("image_dilate", lambda a: images.dilate(a, 3), "v", f", {_AROUND_SQL}, m AS (SELECT vec_id, y, x, max(v) AS v FROM n GROUP BY vec_id, y, x)", "m")
_kernel("image_erode", lambda a: images.erode(a, 3), "v", f", {_AROUND_SQL}, m AS (SELECT vec_id, y, x, min(v) AS v FROM n GROUP BY vec_id, y, x)", "m")
_kernel("image_mean_threshold", lambda a: images.threshold(a, "mean", 3, 10), "CASE WHEN own > mean - 10 THEN 255 ELSE 0 END", f", {_AROUND_SQL}, m AS (SELECT vec_id, y, x, own, avg(v) AS mean FROM n GROUP BY vec_id, y, x, own)", "m")
_kernel("image_contrast", images.contrast, "least(255, greatest(0, round_even(mean + (v - mean) * 1.2::DOUBLE, 0)))", ", a AS (SELECT vec_id, round_even(avg(v), 0) AS mean FROM p GROUP BY vec_id)", "p JOIN a USING (vec_id)")
# Spots of white pixels joined at edges: the least place reachable, by recursion.
_SPOTS_SQL = f""", i AS (SELECT vec_id, y, x FROM p WHERE v > 150), r(vec_id, y, x, s) AS (SELECT vec_id, y, x, y * {SIDE} + x FROM i UNION SELECT i.vec_id, i.y, i.x, r.s FROM r JOIN i ON i.vec_id = r.vec_id AND abs(i.y - r.y) + abs(i.x - r.x) = 1 WHERE r.s < i.y * {SIDE} + i.x),
s AS (SELECT vec_id, y, x, min(s) AS s FROM r GROUP BY vec_id, y, x), z AS (SELECT vec_id, y, x, count(*) OVER (PARTITION BY vec_id, s) AS n FROM s)"""
_kernel("image_specks", lambda a: images.drop_specks(((a > 150) * 255).astype("uint8"), 4), "CASE WHEN n >= 4 THEN 255 ELSE 0 END", _SPOTS_SQL, "p LEFT JOIN z USING (vec_id, y, x)")
SQL["image_specks"] = SQL["image_specks"].replace("WITH p", "WITH RECURSIVE p", 1)


@query(f"""WITH {PIXELS_SQL}, l AS (SELECT c.vec_id, c.y, c.x, c.v, sum(q.v) - 4 * c.v AS e FROM p c, (SELECT unnest([-1, 1, 0, 0]) AS dy, unnest([0, 0, -1, 1]) AS dx) d, p q
  WHERE q.vec_id = c.vec_id AND q.y = least({SIDE - 1}, greatest(0, c.y + dy)) AND q.x = least({SIDE - 1}, greatest(0, c.x + dx)) GROUP BY c.vec_id, c.y, c.x, c.v)
SELECT vec_id, round(least(1.0, var_pop(e) / 1000) * 0.4 + stddev_pop(v) / 255 * 0.4 + (1 - abs(avg(v) / 255 - 0.5) * 2) * 0.2, 6) AS quality FROM l GROUP BY vec_id""")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.preprocess(small_images(spark, sf_dir), ()).select(F.col("image_id").cast("long").alias("vec_id"), F.round("quality", 6).alias("quality"))


@query()
def image_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of the conservative pipeline, a row each."""
    out = images.stages(small_images(spark, sf_dir), "conservative")
    return out.select(F.col("image_id").cast("long").alias("vec_id"), "place", "stage", F.lower(F.hex("data")).alias("out"))


@query(f"WITH {PIXELS_SQL} SELECT vec_id, 'none' AS level, string_agg(printf('%02x', v), '' ORDER BY y, x) AS out FROM p GROUP BY vec_id")
def image_level_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.preprocess(small_images(spark, sf_dir), (lambda a: images.level(a, 0),))
    return out.select(F.col("image_id").cast("long").alias("vec_id"), F.lit("none").alias("level"), F.lower(F.hex("data")).alias("out"))


def graymaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small images as files: graymaps and bitmaps of 8 bits, every seventh one cut short and every eleventh empty."""
    rows = small_images(spark, sf_dir).select(F.col("image_id").cast("long").alias("vec_id"), F.lower(F.hex("data")).alias("pixels"))
    colours = "".join(f"{k:02x}{k:02x}{k:02x}00" for k in range(256))
    lines = F.array_join(F.transform(F.sequence(F.lit(SIDE - 1), F.lit(0), F.lit(-1)), lambda y: F.substring("pixels", y * 2 * SIDE + 1, F.lit(2 * SIDE))), "")
    start, size = 54 + 1024, 54 + 1024 + SIDE * SIDE
    head = (b"BM" + size.to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little") + (40).to_bytes(4, "little") + SIDE.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(24)).hex()
    plain = F.concat(F.lit(f"P5\n{SIDE} {SIDE}\n255\n".encode().hex()), "pixels")
    whole = F.when(F.col("vec_id") % 2 == 0, plain).otherwise(F.concat(F.lit(head + colours), lines))
    content = F.when(F.col("vec_id") % 11 == 0, F.lit("")).when(F.col("vec_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    return rows.select("vec_id", F.unhex(content).alias("content"))


@query(f"""WITH {PIXELS_SQL}, i AS (SELECT vec_id, string_agg(printf('%02x', v), '' ORDER BY y, x) AS g, string_agg(printf('%02x%02x%02x', v, v, v), '' ORDER BY y, x) AS c FROM p GROUP BY vec_id)
SELECT vec_id, CASE WHEN bad IS NULL THEN {SIDE} ELSE 0 END::INTEGER AS height, CASE WHEN bad IS NULL THEN 1 + 2 * (vec_id % 2) ELSE 0 END::INTEGER AS channels, CASE WHEN bad IS NULL THEN CASE WHEN vec_id % 2 = 0 THEN g ELSE c END END AS pixels, bad AS error
FROM (SELECT *, CASE WHEN vec_id % 11 = 0 THEN 'an empty file' WHEN vec_id % 7 = 0 THEN 'the file ends before its pixels' END AS bad FROM i)""")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files read to pixels; unreadable ones are rows that say why."""
    out = rasters.decoded(graymaps(spark, sf_dir), "vec_id").na.fill(0, ["height", "channels"])
    return out.select(F.col("image_id").cast("long").alias("vec_id"), "height", "channels", F.lower(F.hex("data")).alias("pixels"), "error")


# ---- files and streams ----------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, url || ['.PNG', '.jpg', '.txt', '', '.Tiff'][(page_id % 5 + 1)::INTEGER] AS path, length(html) * 1000 AS size FROM pages)
SELECT page_id, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '\.([^.]+)$', 1)) AS suffix FROM p
WHERE lower(regexp_extract(path, '\.([^.]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'tiff') AND size <= 16777216""")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".PNG", ".jpg", ".txt", "", ".Tiff"))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("path"), (F.length("html") * 1000).alias("size"))
    rows = rows.where(files.allowed(F.col("path")) & (F.col("size") <= files.LARGEST))
    return rows.select("page_id", files.basename(F.col("path")).alias("name"), files.suffix(F.col("path")).alias("suffix"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(CASE WHEN contains(s, '+') THEN replace(s, '+', ',') ELSE s END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS langs
FROM (SELECT doc_id, [lang || '+en', lang || ', ko', lang][(doc_id % 3 + 1)::INTEGER] AS s FROM documents)""")
def language_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.element_at(F.array(F.concat("lang", F.lit("+en")), F.concat("lang", F.lit(", ko")), F.col("lang")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(files.languages(spec), "|").alias("langs"))


@query("SELECT ts::DATE AS day, round(avg(value), 6) AS avg_accuracy, round(avg(user_id), 6) AS avg_time, count(*) AS n FROM events GROUP BY 1")
def stream_ingest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, until all are in. A day is a row: the sink in memory stays small."""
    path = f"{sf_dir}/events.parquet"
    # A pattern, as the stream's path has to be a folder or one.
    log = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    name = f"daily_{uuid.uuid4().hex}"
    run = ingest.daily(log, "ts", "value", "user_id").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("day", F.round("avg_accuracy", 6).alias("avg_accuracy"), F.round("avg_time", 6).alias("avg_time"), "n")


def written_folder(spark: SparkSession, sf_dir: str) -> str:
    """Pages as files named like images and otherwise, in subfolders by the page's last digit."""
    folder = f"{stored.folder(spark)}/pages-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "pages").select(F.regexp_replace("html", "[\\r\\n\"]", " ").alias("line"), (F.col("page_id") % 10).alias("digit"))
    for ending, some in (("png", "digit < 4"), ("TIFF", "digit between 3 and 5"), ("csv", "digit > 5")):
        rows.where(some).write.mode("append").partitionBy("digit").option("extension", ending).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("escapeQuotes", "false").option("sep", "\x01").csv(folder)
    return folder


_FOLDER_SQL = """WITH p AS (SELECT page_id % 10 AS digit, strlen(html) + 1 AS bytes FROM pages), f AS (SELECT digit, 'png' AS suffix, bytes FROM p WHERE digit < 4 UNION ALL SELECT digit, 'tiff', bytes FROM p WHERE digit BETWEEN 3 AND 5)
SELECT digit, suffix, sum(bytes)::BIGINT AS bytes FROM f GROUP BY ALL"""


def folder_sizes(found: DataFrame) -> DataFrame:
    """Bytes of the images found in each subfolder, by suffix. Names of files depend on how many tasks wrote them."""
    digit = F.regexp_extract("path", "digit=([0-9]+)", 1).cast("long")
    return found.groupBy(digit.alias("digit"), files.suffix(F.col("path")).alias("suffix")).agg(F.sum("length").alias("bytes"))


@query(_FOLDER_SQL)
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a folder and its subfolders, any case of suffix; other files stay out."""
    return folder_sizes(files.scan_folder(spark, written_folder(spark, sf_dir)).select("path", "length"))


@query(_FOLDER_SQL)
def folder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files that came in."""
    folder, out = written_folder(spark, sf_dir), f"{stored.folder(spark)}/seen-{uuid.uuid4().hex}"
    found = files.stream_folder(spark, folder, files_per_batch=20).select("path", "length")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return folder_sizes(spark.read.parquet(out))


@query("""SELECT page_id, lower(m) AS mime FROM (SELECT page_id, ['image/PNG', 'image/jpeg', 'text/html', '', 'image/tiff', 'IMAGE/GIF', 'image/webp'][(page_id % 7 + 1)::INTEGER] AS m FROM pages)
WHERE lower(m) IN ('image/png', 'image/jpeg', 'image/jpg', 'image/gif', 'image/bmp', 'image/tiff')""")
def mime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("image/PNG", "image/jpeg", "text/html", "", "image/tiff", "IMAGE/GIF", "image/webp")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(kinds, (F.col("page_id") % 7 + 1).cast("int")).alias("m"))
    return rows.where(files.allowed_mime(F.col("m"))).select("page_id", F.lower("m").alias("mime"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN 'No text was found in the image.' ELSE text END AS text, n_chars FROM documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some of them blank, as JSON files with the message that a reader gets, and back."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.element_at(F.array(F.lit(""), F.lit("  "), F.lit(None)), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise(F.col("text")))
    rows, path = docs.select("doc_id", "lang", sinks.message(F.col("text")).alias("text"), "n_chars"), f"{stored.folder(spark)}/json-{uuid.uuid4().hex}"
    sinks.write_text(sinks.as_json(rows), "value", path)
    return spark.read.schema(rows.schema).json(path)


@query("""WITH l AS (SELECT unnest(string_split('OCR 결과 - ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '텍스트 길이: ' || length(props) || '자' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || props, chr(10))) AS line FROM events)
SELECT line, count(*) AS n FROM l GROUP BY line""")
def snapshots_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they are filed, from the text files: each line and how often it stands there."""
    path = f"{stored.folder(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(sinks.snapshot(F.col("props"), "OCR 결과", F.col("ts")).alias("s"))
    sinks.write_text(rows, "s", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY event_id % 2, ts, event_id) AS id, user_id::VARCHAR AS session_id, round(value / 500, 9) AS accuracy FROM events")
def sessions_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of sessions after two commits."""
    kept = store.Store(spark, f"{stored.folder(spark)}/store-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("value") / 500).alias("accuracy"), F.col("value").alias("processing_time"), F.lit(0.5).alias("image_quality"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    for k in range(2):
        kept.commit(sessions=rows.where(F.col("seq") % 2 == k))
    return kept.table("performance_log").select("id", "session_id", F.round("accuracy", 9).alias("accuracy"))


_ASCII_SQL = r"""array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'
  WHEN unicode(c) > 65535 THEN printf('\u%04x\u%04x', ((unicode(c) - 65536) >> 10) + 55296, ((unicode(c) - 65536) & 1023) + 56320) WHEN unicode(c) < 32 OR unicode(c) > 126 THEN printf('\u%04x', unicode(c)) ELSE c END), '')"""


@query(f"""WITH d AS (SELECT doc_id, {SEEDED_SQL} || chr((128512 + doc_id % 50)::INTEGER) AS t FROM documents) SELECT doc_id, '"' || {_ASCII_SQL} || '"' AS json FROM d""")
def json_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with a character beyond 16 bits, as JSON strings in ASCII."""
    faces = "".join(map(chr, range(128512, 128562)))
    docs = seeded(documents(spark, sf_dir)).withColumn("text", F.concat("text", F.substring(F.lit(faces), (F.col("doc_id") % 50 + 1).cast("int"), F.lit(1))))
    return docs.select("doc_id", encoding.ascii_string(F.col("text")).alias("json"))


_ESCAPED_SQL = r"""array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
  WHEN unicode(c) > 65535 THEN printf('\U%08x', unicode(c)) WHEN unicode(c) > 255 THEN printf('\u%04x', unicode(c)) WHEN unicode(c) < 32 OR unicode(c) > 126 THEN printf('\x%02x', unicode(c)) ELSE c END), '')"""


@query(f"""WITH d AS (SELECT doc_id, {SEEDED_SQL} || chr((128512 + doc_id % 50)::INTEGER) AS t FROM documents), e AS (SELECT doc_id, regexp_matches(t, '^[\\x00-\\xFF]*$') AS latin, {_ESCAPED_SQL} AS escaped FROM d)
SELECT doc_id, latin, escaped FROM e""")
def unicode_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the last resort of a writer: every character beyond ASCII as an escape."""
    faces = "".join(map(chr, range(128512, 128562)))
    docs = seeded(documents(spark, sf_dir)).withColumn("text", F.concat("text", F.substring(F.lit(faces), (F.col("doc_id") % 50 + 1).cast("int"), F.lit(1))))
    return docs.select("doc_id", encoding.representable(F.col("text"), "iso-8859-1").alias("latin"), encoding.unicode_escape(F.col("text")).alias("escaped"))


@query("""SELECT event_type || (user_id % 40) AS word, arg_max(event_id, (ts, event_id)) AS id, count(*) AS frequency, arg_max(props, (ts, event_id)) AS context, max(ts) AS created_at FROM events GROUP BY 1""")
def stream_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word list that a stream of events keeps in its state, from the updates that it wrote."""
    path, out = f"{sf_dir}/events.parquet", f"{stored.folder(spark)}/words-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    events = events.select(F.concat("event_type", F.col("user_id") % 40).alias("word"), F.col("props").alias("context"), F.lit("general").alias("domain"), "ts", F.col("event_id").alias("seq"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, words.STORE)
    try:
        write = words.word_rows(events).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
        write.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/updates/epoch={epoch}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    rows = words.newest(spark.read.parquet(f"{out}/updates"))
    return rows.select("word", "id", "frequency", "context", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
