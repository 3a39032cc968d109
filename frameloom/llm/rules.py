"""Quality rules as a short-circuit cascade; DataFrame functions only.

Method.  Each rule rejects a text on its own.  On a sample, a rule's selectivity
(share of texts it rejects) and its cost (seconds to evaluate it, net of what every
job and the shared words take) are measured; the cascade tries rules by rejection
per cost, highest first, and stops at the first that rejects.  The order changes the
work, never the verdict: a text is kept when no rule rejects it.  The sample (at
most ``SAMPLE_ROWS`` texts, chosen by a hash of the text) serves the order only.

``kept_only`` is one filter: the words of a text are split once and bound to a name,
and the rules stand one inside the other, so a measure is computed when its rule is
reached and never before.  ``cascade`` returns measures as columns; those that its
caller asks for are computed for every text, the others when their rule is reached.
Arrays of words and of 8-word window hashes stay inside one row, so there is no
shuffle and no explode.  Windows are compared by 64-bit hashes within a text.  Most
texts have no repeated window, which one distinct count over the hashes shows; only
the others pay for the sort that finds the words covered.

Defined cases: a null or empty text has no words, fails ``too_short`` and is
rejected; repeated rows are judged alike, each on its own; an
empty table gives an empty result and the rules keep their given order; other
columns are left alone (a prefix sets the added ones apart).
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SAMPLE_ROWS = 500

#: What separates words, and the characters counted as symbols.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``reject`` is SQL over the measures' names, and null-free."""

    name: str
    reject: str


BASE_RULES = (
    Rule("too_short", "n_words < 20"),
    Rule("repetitive", "100 * n_repeat_words > 30 * n_words"),
)

RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", "10 * n_bangs > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with a value bound to a name: computed once, however often the body uses it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: SQL of the arrays that measures are taken from; {t} is the text.
WORDS_SQL = f"array_remove(split({{t}}, r'{BLANK}'), '')"
LINES_SQL = r"filter(split({t}, r'\n'), x -> rtrim(r' ' || chr(9) || chr(11) || chr(12) || chr(13), x) <> '')"

_WINDOWS = f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'get(h, i + {k})' for k in range(WINDOW))}))"
_RANKED = "array_sort(transform(v, (x, i) -> struct(x AS h, i AS at)))"
_TWIN = "coalesce(x.h = get(r, i - 1).h, false) OR coalesce(x.h = get(r, i + 1).h, false)"
_PLACES = f"array_sort(transform(filter(r, (x, i) -> {_TWIN}), x -> x.at))"
_STEPS = f"transform(p, (x, i) -> least({WINDOW}, coalesce(get(p, i + 1) - x, {WINDOW})))"
_COVERED = _let("r", _RANKED, _let("p", _PLACES, f"aggregate({_STEPS}, 0L, (a, x) -> a + x)"))
_REPEATS = _let("h", "transform({w}, x -> xxhash64(x))", _let("v", _WINDOWS, f"CASE WHEN size(array_distinct(v)) < size(v) THEN {_COVERED} ELSE 0L END"))

#: SQL of the measures; {w} is the text's words, {l} its lines with a word.
MEASURES = {
    "n_words": "CAST(size({w}) AS BIGINT)",
    "word_chars": "CAST(length(array_join({w}, '')) AS BIGINT)",
    "n_symbols": f"CAST(regexp_count({{t}}, r'{SYMBOLS}') AS BIGINT)",
    "n_bangs": "CAST(length({t}) - length(replace({t}, '!', '')) AS BIGINT)",
    "n_lines": "CAST(size({l}) AS BIGINT)",
    "n_dup_lines": "CAST(size({l}) - size(array_distinct({l})) AS BIGINT)",
    "n_repeat_words": f"CASE WHEN size({{w}}) > {WINDOW} THEN {_REPEATS} ELSE 0L END",
}
NAMES = tuple(MEASURES)

#: Prefix of the columns that this module adds to a table of the caller's.
OWN = "__rule_"


def _text(text_col: str) -> str:
    return f"coalesce(`{text_col}`, '')"


def _filled(sql: str, **parts: str) -> str:
    for k, v in parts.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def with_measures(docs: DataFrame, names: tuple[str, ...] = NAMES, text_col: str = "text") -> DataFrame:
    """Add the named measures, each as a column with the prefix OWN."""
    arrays = {}
    for key, sql in (("w", WORDS_SQL), ("l", LINES_SQL)):
        if any("{" + key + "}" in MEASURES[n] for n in names):
            arrays[key] = sql
    out = docs.withColumns({OWN + k: F.expr(_filled(sql, t=_text(text_col))) for k, sql in arrays.items()})
    out = out.withColumns({OWN + n: F.expr(_filled(MEASURES[n], t=_text(text_col), w=f"`{OWN}w`", l=f"`{OWN}l`")) for n in names})
    return out.drop(*(OWN + k for k in arrays))


def needs(rule: Rule) -> tuple[str, ...]:
    return tuple(n for n in NAMES if re.search(rf"\b{n}\b", rule.reject))


def test_sql(rule: Rule, there: dict[str, str], text: str, words: str | None = None) -> str:
    """SQL of a rule's test: measures in ``there`` by those expressions, the others from the text (``words``: bound words)."""
    sql = re.sub(r"\b(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\b", lambda m: there.get(m[1], m[1]), rule.reject)
    for n in needs(rule):
        if n not in there:
            sql = _let(n, MEASURES[n], sql)
    if "{l}" in sql:
        sql = _let("lines", LINES_SQL, sql.replace("{l}", "lines"))
    if "{w}" in sql:
        sql = sql.replace("{w}", words) if words else _let("words", WORDS_SQL, sql.replace("{w}", "words"))
    return _filled(sql, t=text)


def rejects(rule: Rule) -> Column:
    """The rule's test over the columns of with_measures."""
    return F.expr(test_sql(rule, {n: f"`{OWN}{n}`" for n in NAMES}, ""))


def _seconds(frame: DataFrame, test: str) -> float:
    """Time of a job that counts a test's hits, run a second time (the first compiles it)."""
    for _ in range(2):
        began = time.perf_counter()
        frame.agg(F.count_if(F.expr(test))).collect()
    return time.perf_counter() - began


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejection per cost, both measured on a sample of the texts."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    n = docs.count()
    if not n:
        return rules
    share = min(1.0, 2.0 * rows / n)
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * share)).limit(rows)
    sample = picked.withColumn("words", F.expr(_filled(WORDS_SQL, t=_text("text")))).persist()
    try:
        # the words are there, so a rule is billed for what it adds to a job that only looks at their number
        found = with_measures(sample).agg(F.count(F.lit(1)).alias("n"), *(F.avg(rejects(r).cast("int")).alias(r.name) for r in rules)).first()
        if not found["n"]:
            return rules
        idle = _seconds(sample, "size(words) < 0")
        cost = {r.name: max(_seconds(sample, test_sql(r, {}, _text("text"), "words")) - idle, 1e-3) for r in rules}
        return tuple(sorted(rules, key=lambda r: -(found[r.name] or 0.0) / cost[r.name]))
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """Every row with the named measures (prefix OWN) and OWN + "rejected_by": the first rule that rejects it, or null."""
    there = {n: f"`{OWN}{n}`" for n in names}
    cases = " ".join(f"WHEN {test_sql(r, there, _text(text_col))} THEN '{r.name}'" for r in ordered(docs, rules, text_col))
    return with_measures(docs, names, text_col).withColumn(OWN + "rejected_by", F.expr(f"CASE {cases} END" if cases else "CAST(NULL AS STRING)"))


def kept_only(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their own columns: one filter, whose tests stop at the first that rejects."""
    text = _text(text_col)
    cases = " ".join(f"WHEN {test_sql(r, {}, text, 'words')} THEN true" for r in ordered(docs, rules, text_col))
    return docs.where("NOT " + _let("words", _filled(WORDS_SQL, t=text), f"CASE {cases} ELSE false END")) if cases else docs


QUERY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), tokens AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), spans AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER p AS run, count(*) OVER p AS n FROM tokens
  WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM spans WHERE n = 8
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM runs, range(8) r(k) WHERE times > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '!')) AS n_bangs,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
), f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_bangs, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * n_bangs > n_words
    OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words) AS kept
FROM f
"""
