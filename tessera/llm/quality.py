"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Documents are counted by their pattern of votes (at
most 3 ** rules rows, whatever the corpus); expectation-maximisation over those counts estimates the share of good
documents and, for each rule, how often it is right about good and about bad ones; a document is kept if the
posterior probability that it is good is at least ``KEEP``. Each round is one aggregate over the pattern table, of
which only the sums return to the driver.

Null texts have no words: all counts 0, base_failed, not kept. Very long texts count whole. Repeated rows are judged
alike, each for itself. A posterior of exactly KEEP keeps. Rows are neither merged nor dropped; other columns are ignored
unless named in keep, whatever their names. With no rows to learn from, the starting values stand, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

SEPARATORS = r"[\x20\x09-\x0D]+"
#: Name, value, at or below this it is good, above this it is bad; or with LOW: at or above, below.
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", "<=", 0.02, ">", 0.1),
    ("letters", "n_letter_words / greatest(n_words, 1)", ">=", 0.95, "<", 0.8),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", "<=", 0.1, ">", 0.3),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", "<=", 0.1, ">", 0.35),
    ("capitals", "n_capitals / greatest(word_chars, 1)", "<=", 0.1, ">", 0.3),
    ("length", "abs(word_chars / greatest(n_words, 1) - 5.5)", "<=", 1.5, ">", 3.5),
)
ROUNDS = 12
#: Where a rule votes, it is taken to be right about good documents and about bad ones so often, until data say more:
#: good documents seldom break a rule, and most kinds of junk break but one or two. That counts as SMOOTH of the documents.
RIGHT = (0.99, 0.3)
PRIOR = 0.5
SMOOTH = 0.1
KEEP = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_capitals")


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id and the counts in FEATURES. Each step is a projection of its own, so that arrays are made once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = ["doc_id", *(c for c in keep if c != "doc_id")]
    solid = F.array_remove(F.split(text, SEPARATORS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*held, text.alias("t_"), solid.alias("w_"), lines.alias("l_"))
    df = df.select(
        *held,
        F.size("w_").cast("long").alias("n_words"),
        F.aggregate("w_", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("t_", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.size("l_").cast("long").alias("n_lines"),
        F.size(F.filter("w_", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.regexp_count("t_", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.transform("w_", lambda w: F.xxhash64(w)).alias("h_"),
    )
    here = [*held, *(c for c in FEATURES if c != "n_repeat_words")]
    window = F.transform(F.slice("h_", 1, F.greatest(F.size("h_") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h_", i + 1), F.get("h_", i + 2)))
    df = df.select(*here, window.alias("g_"))
    # Only texts in which a window recurs are sorted.
    order = F.when(F.size(F.array_distinct("g_")) < F.size("g_"), F.array_sort(F.transform("g_", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.select(*here, order.alias("s_"))
    again = F.filter("s_", lambda e, i: (F.get("s_", i - 1)["x"] == e["x"]) | (F.get("s_", i + 1)["x"] == e["x"]))
    df = df.select(*here, F.array_sort(F.transform(again, lambda e: e["i"])).alias("p_"))
    covered = F.aggregate(F.transform("p_", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("p_", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*here, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def votes() -> list[Column]:
    out = []
    for name, value, good, at, bad, over in RULES:
        out.append(F.expr(f"CASE WHEN {value} {good} {at}D THEN 1 WHEN {value} {bad} {over}D THEN -1 ELSE 0 END").alias(name))
    return out


def _logit(model: dict) -> Column:
    total = F.log(F.lit(model["share"]) / F.lit(1 - model["share"]))
    for name, *_ in RULES:
        a, b = model[name]
        total = total + F.when(F.col(name) == 1, F.log(F.lit(a) / F.lit(1 - b))).when(F.col(name) == -1, F.log(F.lit(1 - a) / F.lit(b))).otherwise(0.0)
    return total


def posterior(model: dict) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_logit(model)))


def fit(patterns: DataFrame) -> dict:
    """EM over (votes..., n): the share of good documents and per rule (right about good, right about bad)."""
    model: dict = {"share": PRIOR} | {name: RIGHT for name, *_ in RULES}
    for _ in range(ROUNDS):
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(good).alias("good"), F.sum("n").alias("n")]
        for name, *_r in RULES:
            v = F.col(name)
            sums += [F.sum(F.when(v == 1, good).otherwise(0.0)).alias(f"{name}_g1"), F.sum(F.when(v != 0, good).otherwise(0.0)).alias(f"{name}_g")]
            sums += [F.sum(F.when(v == -1, bad).otherwise(0.0)).alias(f"{name}_b1"), F.sum(F.when(v != 0, bad).otherwise(0.0)).alias(f"{name}_b")]
        row = patterns.withColumn("p", posterior(model)).agg(*sums).first()
        if not row.n:
            break
        weight = SMOOTH * row.n
        model = {"share": (row.good + weight) / (row.n + 2 * weight)}
        for name, *_r in RULES:
            model[name] = tuple((row[f"{name}_{k}1"] + weight * right) / (row[f"{name}_{k}"] + weight) for k, right in zip("gb", RIGHT, strict=True))
    return model


def judge(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    found = common.cut(spark, features(docs, keep), "quality")
    names = [name for name, *_ in RULES]
    voted = found.select("*", *votes())
    patterns = common.cut(spark, voted.filter("n_words > 0").groupBy(*names).count().withColumnRenamed("count", "n"), "quality-patterns")
    model = fit(patterns)
    common.drop(spark, patterns)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = voted.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (posterior(model) >= KEEP))
    more = [c for c in keep if c != "doc_id"]
    return out.select("doc_id", *FEATURES[:5], "base_failed", "kept", *more)


def _oracle() -> str:
    vote = ", ".join(f"CASE WHEN {v} {g} {x} THEN 1 WHEN {v} {b} {y} THEN -1 ELSE 0 END AS {n}" for n, v, g, x, b, y in RULES)
    names = [n for n, *_ in RULES]

    def p(m: str) -> str:
        terms = "".join(f" + CASE {n} WHEN 1 THEN ln({m}.{n}_a / (1 - {m}.{n}_b)) WHEN -1 THEN ln((1 - {m}.{n}_a) / {m}.{n}_b) ELSE 0.0 END" for n in names)
        return f"1.0 / (1.0 + exp(-(ln({m}.share / (1 - {m}.share)){terms})))"

    rounds = [f"m0 AS (SELECT CAST({PRIOR} AS DOUBLE) AS share, " + ", ".join(f"CAST({right} AS DOUBLE) AS {n}_{k}" for n in names for k, right in zip("ab", RIGHT, strict=True)) + ")"]
    for i in range(ROUNDS):
        fits = ", ".join(
            f"(sum(CASE WHEN {n} = {w} THEN n * {q} ELSE 0 END) + {SMOOTH} * sum(n) * {x}) / (sum(CASE WHEN {n} <> 0 THEN n * {q} ELSE 0 END) + {SMOOTH} * sum(n)) AS {n}_{k}"
            for n in names for k, w, q, x in (("a", 1, "p", RIGHT[0]), ("b", -1, "(1 - p)", RIGHT[1]))
        )
        rounds.append(f"m{i + 1} AS MATERIALIZED (SELECT (sum(n * p) + {SMOOTH} * sum(n)) / (sum(n) + 2 * ({SMOOTH} * sum(n))) AS share, {fits} FROM (SELECT pat.*, {p(f'm{i}')} AS p FROM pat, m{i}))")
    return rf"""
WITH w0 AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w0 WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM x),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY doc_id),
f AS MATERIALIZED (SELECT w0.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals FROM w0 LEFT JOIN r ON r.doc_id = w0.doc_id),
v AS MATERIALIZED (SELECT *, {vote} FROM f),
pat AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM v WHERE n_words > 0 GROUP BY ALL),
{', '.join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {p(f'm{ROUNDS}')} >= {KEEP} AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM v), m{ROUNDS}
"""


ORACLE = _oracle()
