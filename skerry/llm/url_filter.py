"""URL filters: rules first, then a character language-model ratio, all in DataFrame functions.

URLs that an allow rule or a block rule decides train two variable-order Markov models of the characters of host and
path. The probability of a character after a context of up to CONTEXT characters blends all orders by Witten-Bell
smoothing: contexts that are rare, or have many different successors, lean on the shorter one. Characters are taken as
they are and every context that occurs is kept, so what is gathered grows with the input. It stays in tables: one row
for each distinct gram (context and character) with its counts, summed for each lower order by its last characters,
and joined by shuffles. The mean log ratio over a URL's characters is its score. Grams are skewed: the most frequent
ones, HOT_GRAMS at most whatever the table, are broadcast; only what is rarer meets its ratio in a shuffle.

Scores are calibrated on URLs that their models have not seen: training URLs fall into two halves by hash, and each
half is scored by the counts of the other. The threshold lies between the mean scores of the two training sets, in
proportion to their deviations. All other URLs are scored by all counts.

Defined results: a null url, or one without "://", has an empty host and an empty path; an empty URL scores zero and
is allowed; without training URLs of both kinds every URL without a rule is allowed; where one half lacks a kind, its
URLs are scored by all counts; repeated rows each get a row; a score at the threshold allows; other columns are not
read. Of rules of equal length that fit, the later wins. Time and memory grow in line with a URL's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.hot_keys import is_hot
from skerry.session import durable

CONTEXT = 5
GRAM = CONTEXT + 1
HOT_GRAMS = 50_000
PAD = "\x02"  # stands before the first character
COUNTS = ("a0", "a1", "b0", "b1")  # of allowed and blocked training URLs of either half
# Counts of the allowed and of the blocked that make a model: all, and those without a half.
MODELS = ((("a0", "a1"), ("b0", "b1")), (("a1",), ("b1",)), (("a0",), ("b0",)))


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains, if the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed rules of the contract.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.coalesce(fold_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    found = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column) -> Column:
    """Each character of the text with the CONTEXT ones before it."""
    characters = F.concat(F.array(*[F.lit(PAD)] * CONTEXT), F.filter(F.split(text, ""), lambda c: c != ""))

    def joined(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(c) - CONTEXT), lambda i: F.array_join(F.slice(c, i, F.lit(GRAM)), ""))

    return F.when(text != "", F.transform(F.array(characters), joined)[0])


def positions(rows: DataFrame) -> DataFrame:
    """row, taught, half and gram: a row for each character of host and path."""
    return rows.select("row", "taught", "half", F.explode(_grams(F.concat("host", "path"))).alias("gram"))


def gram_counts(found: DataFrame) -> DataFrame:
    """gram, its number of positions n, and those among them in training URLs (COUNTS)."""
    one = lambda verdict, half: F.count_if((F.col("taught") == verdict) & (F.col("half") == half))
    kinds = (("allow", 0), ("allow", 1), ("block", 0), ("block", 1))
    return found.groupBy("gram").agg(F.count("*").alias("n"), *(one(v, h).alias(c) for c, (v, h) in zip(COUNTS, kinds)))


def probabilities(counts: DataFrame, symbols: int) -> DataFrame:
    """g (a gram) and p0, q0, p1, q1, p2, q2: its last character's probability after the others, allowed and blocked, by each of MODELS."""
    names = [f"{side}{m}" for m in range(len(MODELS)) for side in "pq"]
    parts = [side for model in MODELS for side in model]
    before = None
    for order in range(GRAM):
        held = counts.groupBy(F.substring("gram", GRAM - order, order + 1).alias("g")).agg(*(F.sum(c).alias(c) for c in COUNTS))
        held = held.select("g", *(sum(F.col(c) for c in part).alias(f"n_{x}") for x, part in zip(names, parts)))
        context = F.substring("g", 1, order).alias("context")
        after = [f(F.col(f"n_{x}")).alias(f"{y}_{x}") for x in names for f, y in ((F.sum, "t"), (lambda n: F.count_if(n > 0), "u"))]
        rows = held.withColumn("context", context).join(held.groupBy(context).agg(*after), "context")
        if before is None:
            lower = {x: F.lit(1.0 / symbols) for x in names}
        else:  # a gram without its first character is one of the lower order
            rows = rows.withColumn("shorter", F.substring("g", 2, order)).join(before, "shorter")
            lower = {x: F.col(x) for x in names}
        n, t, u = ({x: F.col(f"{y}_{x}") for x in names} for y in "ntu")
        blended = {x: F.when(t[x] == 0, lower[x]).otherwise((n[x] + u[x] * lower[x]) / (t[x] + u[x])) for x in names}
        before = rows.select(F.col("g").alias("shorter"), *(blended[x].alias(x) for x in names))
    return before.withColumnRenamed("shorter", "g")


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram, n and ratios: log p(accepted) - log p(rejected) by each of MODELS, all zero without training URLs of both kinds."""
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
    symbols = counts.select(F.substring("gram", GRAM, 1)).distinct().count() + 1
    taught = [all(sum(totals[c] for c in side) for side in model) for model in MODELS]
    p = probabilities(counts, symbols)
    ratio = [F.log(f"p{m}") - F.log(f"q{m}") for m in range(len(MODELS))]
    used = [F.lit(0.0) if not taught[0] else ratio[m] if taught[m] else ratio[0] for m in range(len(MODELS))]
    return counts.select("gram", "n").join(p.select(F.col("g").alias("gram"), F.array(*used).alias("ratios")), "gram")


def scored(rows: DataFrame) -> DataFrame:
    """rows with the mean log ratio of their characters, rounded, as `score`; zero without characters."""
    counts = durable(gram_counts(positions(rows)))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ratios = durable(log_ratios(counts))
    model = F.when(F.col("taught").isNull(), 0).otherwise(F.col("half") + 1)
    hot = is_hot(F.col("n"), total, 0, HOT_GRAMS)
    frequent = F.broadcast(ratios.where(hot))  # HOT_GRAMS rows at most
    found = positions(rows).select("row", "gram", model.alias("model"))
    met = found.join(frequent, "gram").select("row", "model", "ratios")
    rare = found.join(frequent, "gram", "left_anti").join(ratios.where(~hot), "gram").select("row", "model", "ratios")
    sums = met.unionAll(rare).groupBy("row").agg(F.avg(F.get("ratios", F.col("model"))).alias("mean"))
    return rows.join(sums, "row", "left").withColumn("score", F.round(F.coalesce("mean", F.lit(0.0)), 9)).drop("mean")


def threshold(scored: DataFrame) -> DataFrame:
    """One row: `cut`, between the means of allowed and blocked scores in proportion to their deviations."""
    stat = lambda v, f, name: f(F.when(F.col("taught") == v, F.col("score"))).alias(name)
    s = scored.agg(*(stat(v, f, v + n) for v in ("allow", "block") for f, n in ((F.avg, "_m"), (F.stddev_pop, "_s"))))
    a, b, x, y = F.col("allow_m"), F.col("block_m"), F.col("allow_s"), F.col("block_s")
    cut = F.when(x + y == 0, (a + b) / 2).otherwise((a * y + b * x) / (x + y))
    return s.select(F.coalesce(F.round(cut, 9), F.lit(float("-inf"))).alias("cut"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, host, path, rule, verdict and score of each row; a row that a rule decides has the score that calibrates."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    half = F.when(F.md5(F.concat("host", "path")) < "8", 0).otherwise(1)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "*", fit.alias("fit"), half.alias("half"))
    found = durable(scored(durable(rows.select("row", "id", "host", "path", "half", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("taught")))))
    cut = threshold(found)
    own = F.when((F.col("host") == "") & (F.col("path") == "") | (F.col("score") >= cut.scalar()), F.lit("allow")).otherwise(F.lit("block"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("taught", own).alias("verdict"), "score")


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    pick = lambda what: " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in sorted(rules, key=lambda r: -len(r.text)))
    names = [f"{side}{m}" for m in range(len(MODELS)) for side in "pq"]
    parts = dict(zip(names, (side for model in MODELS for side in model)))
    levels = []
    for order in range(GRAM):
        levels.append(f"h{order} AS (SELECT g[{GRAM - order}:] AS g, {', '.join(f'sum({" + ".join(parts[x])}) AS n_{x}' for x in names)} FROM c GROUP BY ALL)")
        levels.append(f"x{order} AS (SELECT g[:{order}] AS ctx, {', '.join(f'sum(n_{x}) AS t_{x}, count(*) FILTER (n_{x} > 0) AS u_{x}' for x in names)} FROM h{order} GROUP BY ALL)")
        low = (lambda x: "(SELECT 1.0::DOUBLE / (count(*) + 1) FROM h0)") if order == 0 else (lambda x: f"b.{x}")
        values = ", ".join(f"CASE WHEN t_{x} = 0 THEN {low(x)} ELSE (n_{x} + u_{x} * {low(x)}) / (t_{x} + u_{x})::DOUBLE END AS {x}" for x in names)
        lower = f" JOIN m{order - 1} b ON b.g = h{order}.g[2:]" if order else ""
        levels.append(f"m{order} AS (SELECT h{order}.g, {values} FROM h{order} JOIN x{order} ON x{order}.ctx = h{order}.g[:{order}]{lower})")
    total = lambda columns: f"(SELECT coalesce(sum({' + '.join(columns)}), 0) FROM c)"
    has = [f"({total(a)} > 0 AND {total(b)} > 0)" for a, b in MODELS]
    ratio = lambda m: f"ln(p{m}) - ln(q{m})"
    used = ", ".join(f"CASE WHEN NOT {has[0]} THEN 0 WHEN {has[m]} THEN {ratio(m)} ELSE {ratio(0)} END AS r{m}" for m in range(len(MODELS)))
    return f"""
    WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
    s0 AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    s AS (SELECT *, CASE {pick("text")} END AS rule, CASE {pick("verdict")} END AS v, CASE WHEN md5(host || path) < '8' THEN 0 ELSE 1 END AS half,
                 repeat(chr(2), {CONTEXT}) || host || path AS z FROM s0),
    g AS (SELECT k, v, half, unnest(list_transform(range(1, length(z) - {CONTEXT - 1}), lambda i: substr(z, i, {GRAM}))) AS g FROM s),
    c AS (SELECT g, {", ".join(f"count(*) FILTER (v = '{v}' AND half = {h}) AS {c}" for c, (v, h) in zip(COUNTS, (("allow", 0), ("allow", 1), ("block", 0), ("block", 1))))} FROM g GROUP BY g),
    {", ".join(levels)},
    r AS (SELECT g, {used} FROM m{CONTEXT}),
    x AS (SELECT k, avg(CASE WHEN v IS NULL THEN r0 WHEN half = 0 THEN r1 ELSE r2 END) AS score FROM g JOIN r USING (g) GROUP BY k),
    f AS (SELECT s.*, round(coalesce(score, 0), 9) AS score FROM s LEFT JOIN x USING (k)),
    t AS (SELECT avg(score) FILTER (v = 'allow') AS a, stddev_pop(score) FILTER (v = 'allow') AS x,
                 avg(score) FILTER (v = 'block') AS b, stddev_pop(score) FILTER (v = 'block') AS y FROM f),
    w AS (SELECT coalesce(round(CASE WHEN x + y = 0 THEN (a + b) / 2 ELSE (a * y + b * x) / (x + y) END, 9), '-inf'::DOUBLE) AS cut FROM t)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host = '' AND path = '' OR score >= (SELECT cut FROM w) THEN 'allow' ELSE 'block' END) AS verdict, score FROM f"""


ORACLE_SQL = _oracle()
