"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

`measured` turns a text column into one struct of counts; `verdict` turns a threshold table into one
boolean column over ratios of these counts. Both are plain expressions: a scan, one projection, no shuffle.

Defined results: a null text counts as empty; an empty text has zero words and fails the word minimum;
a ratio whose denominator is zero is zero; repeated rows are judged separately and alike; null ids are kept
as they are; columns other than the id and the text are never read by `judged`, so their names cannot clash.
Repeated windows are found by 64-bit hashes of eight words, compared within one text only. Stop words are those of
four languages, in lower case; a text without any of them, such as one in another language, fails that rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with on by this be are was from at "
    "le la les de des du et en un une est que dans pour au par sur qui "
    "der die das und ist von zu den mit für auf dem ein eine im nicht "
    "el los las y un una del por con para su se lo al"
).split()


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie in [least, most]; both name fields of `measured`."""

    name: str
    numerator: str
    denominator: str
    least: float = float("-inf")
    most: float = float("inf")


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.1),
    Rule("exclamations_per_word", "n_exclaims", "n_words", most=0.3),
    Rule("upper_share", "n_upper", "word_chars", most=0.5),
    Rule("letter_share", "n_letters", "word_chars", least=0.5),
    Rule("stop_words_per_word", "n_stop", "n_words", least=0.005),
    Rule("echo_words", "n_echo", "n_words", most=0.3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.7),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value once inside an expression, so that it isn't computed for each use."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside eight-word windows that occur at least twice: sort (hash, position), keep runs, merge positions."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))))

    def merged(hashed: Column) -> Column:
        ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            twice = F.filter(
                F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
                lambda i: i.isNotNull(),
            )
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(F.sort_array(twice), start, step, lambda a: a["n"])

        return let(ordered, covered)

    repeats = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), merged(h)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) >= WINDOW, let(hashes, repeats)).otherwise(F.lit(0).cast("long"))


def measured(text: Column) -> Column:
    """One struct of counts of a text; every count covers the whole text."""
    body = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def counts(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeated_words(w).alias("n_repeat_words"),
            F.regexp_count(body, F.lit("!")).cast("long").alias("n_exclaims"),
            F.regexp_count(body, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(joined, "\\P{L}+", "")).cast("long").alias("n_letters"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))).cast("long").alias("n_echo"),
        )

    return let(words, counts)


def verdict(counts: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """True if every ratio of the table lies within its thresholds."""
    kept = F.lit(True)
    for rule in rules:
        n, d = counts[rule.numerator].cast("double"), counts[rule.denominator]
        ratio = F.when(d == 0, F.lit(0.0)).otherwise(n / d)
        if rule.least != float("-inf"):
            kept = kept & (ratio >= rule.least)
        if rule.most != float("inf"):
            kept = kept & (ratio <= rule.most)
    return kept


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_exclaims", "n_upper", "n_letters", "n_stop", "n_echo")


def _counts(m: Column) -> dict[str, Column]:
    return {c: m[c] for c in _FIELDS} | {"n_lines": m["lines"]["n"], "n_dup_lines": m["lines"]["dup"]}


def _base_failed(counts: dict[str, Column]) -> Column:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, the counts of BASE, base_failed and kept for each row."""

    def row(m: Column) -> Column:
        counts = _counts(m)
        failed = _base_failed(counts)
        return F.struct(*(counts[c].alias(c) for c in BASE), failed.alias("base_failed"), (~failed & verdict(counts, rules)).alias("kept"))

    return docs.select(F.col(id_col), F.inline(F.array(let(measured(F.col(text_col)), row))))


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass; one condition over the text, so columns of any name pass through."""
    return docs.where(let(measured(F.col(text_col)), lambda m: ~_base_failed(_counts(m)) & verdict(_counts(m), rules)))


def _oracle() -> str:
    sql = {
        "n_exclaims": "len(text) - len(replace(text, '!', ''))",
        "n_upper": r"len(regexp_extract_all(text, '\p{Lu}'))",
        "n_letters": r"len(regexp_extract_all(text, '\p{L}'))",
        "n_stop": "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in STOP_WORDS) + ")))",
        "n_echo": "len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x))",
    }
    tests = []
    for r in RULES:
        ratio = f"(CASE WHEN {r.denominator} = 0 THEN 0::DOUBLE ELSE {r.numerator}::DOUBLE / {r.denominator} END)"
        tests += [f"{ratio} >= {r.least}::DOUBLE"] if r.least != float("-inf") else []
        tests += [f"{ratio} <= {r.most}::DOUBLE"] if r.most != float("inf") else []
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT k, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM t WHERE len(w) >= {WINDOW}),
    x AS (SELECT k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM g),
    r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM x) WHERE c > 1),
    p AS (SELECT k, least({WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i), {WINDOW})) AS n FROM r),
    q AS (SELECT k, sum(n)::BIGINT AS n FROM p GROUP BY k),
    l AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS dup
          FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
    c AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                 coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0)::BIGINT AS n_lines,
                 coalesce(q.n, 0)::BIGINT AS n_repeat_words, {", ".join(f"{v} AS {k}" for k, v in sql.items())}
          FROM t LEFT JOIN q USING (k) LEFT JOIN l USING (k)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
    SELECT {", ".join(("doc_id",) + BASE)}, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


ORACLE_SQL = _oracle()
