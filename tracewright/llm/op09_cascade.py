"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is one predicate over a document's words, lines and text. On a random sample of bounded size the
share that each rule rejects and the time it takes beyond reading the sample are measured; rules then stand in one
CASE by rejection per cost, so most rejected documents meet a cheap, sharp rule first and the
dear ones run only on what is left. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

WORDS, LINES, TEXT = "__quality_words", "__quality_lines", "__quality_text"
SPACE = r"[\\x20\\x09-\\x0D]"
#: Rows of the sample (about) on which cost and selectivity are measured, and how often each is judged to tell the cost from a job's own time.
SAMPLE_ROWS, TURNS = 2_000, 8

N_WORDS = f"cast(size({WORDS}) AS bigint)"
WORD_CHARS = f"cast(length(translate({TEXT}, ' \t\n\x0b\x0c\r', '')) AS bigint)"
N_SYMBOLS = f"cast(length({TEXT}) - length(translate({TEXT}, '#*$%&|<>', '')) AS bigint)"
N_LINES = f"size({LINES})"
N_DUP_LINES = f"cast(size({LINES}) - size(array_distinct({LINES})) AS bigint)"
_WINDOWS = "transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)))"
#: Of the windows' hashes: sorted with their places, those equal to a neighbour, the places in order, and the words they cover.
_COVERED = """aggregate(sort_array(transform(filter(transform(array(sort_array(transform(hashes, (h, i) -> struct(h, i)))),
    s -> transform(sequence(0, size(s) - 1), k -> struct(get(s, k).i AS i, get(s, k).h <=> get(s, k - 1).h OR get(s, k).h <=> get(s, k + 1).h AS again)))[0],
    x -> x.again), x -> x.i)), struct(0L AS n, -5 AS last), (a, p) -> struct(a.n + least(5, p - a.last) AS n, p AS last), a -> a.n)"""
N_REPEAT_WORDS = f"""CASE WHEN size({WORDS}) < 6 THEN 0L ELSE transform(array({WORDS}), w -> transform(array({_WINDOWS}),
    hashes -> CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE {_COVERED} END)[0])[0] END"""


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str


BASE = [
    Rule("few_words", f"{N_WORDS} < 10"),
    Rule("repeated_windows", f"100 * ({N_REPEAT_WORDS}) > 20 * {N_WORDS}"),
]
RULES = [
    Rule("symbols", f"100 * ({N_SYMBOLS}) > 50 * {N_WORDS}"),
    Rule("repeated_lines", f"100 * ({N_DUP_LINES}) > 30 * {N_LINES}"),
    Rule("word_length", f"{WORD_CHARS} < 2 * {N_WORDS} OR {WORD_CHARS} > 20 * {N_WORDS}"),
    Rule("letterless", f"200 * cast(length(regexp_replace({TEXT}, '[^\\\\p{{L}}]', '')) AS bigint) < 100 * {WORD_CHARS}"),
]


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(TEXT, text)
    return out.withColumn(WORDS, F.expr(f"array_remove(split({TEXT}, '{SPACE}+'), '')")).withColumn(LINES, F.expr(f"filter(split({TEXT}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))


def order_rules(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, measured on about ``rows`` rows drawn from all partitions; as given if there are none."""
    scratch = Scratch(docs.sparkSession, "cascade")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    drawn = texts.sample(min(1.0, rows / max(1, texts.count())), seed=9)
    prepared = scratch.save(_prepared(drawn), "sample")
    counts = prepared.agg(F.count("*").alias("all"), *(F.count_if(F.expr(r.rejects)).alias(r.name) for r in rules)).first()
    if not counts["all"]:
        scratch.close()
        return rules
    turns = prepared.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(TURNS))))
    read = F.sum(F.length(TEXT) + F.size(WORDS) + F.size(LINES))

    def seconds(*measures: Column) -> float:
        began = time.perf_counter()
        turns.agg(read, *measures).collect()
        return time.perf_counter() - began

    seconds()  # the first job compiles
    idle = seconds()
    cost = {r.name: max(seconds(F.count_if(F.expr(r.rejects))) - idle, 1e-3) for r in rules}
    rank = {r.name: counts[r.name] / counts["all"] / cost[r.name] for r in rules}
    scratch.close()
    return sorted(rules, key=lambda r: -rank[r.name])


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects; later rules are not evaluated once one has."""
    out = F.when(F.lit(False), F.lit(False))
    for r in rules:
        out = out.when(F.expr(r.rejects), F.lit(False))
    return out.otherwise(F.lit(True))


def score_quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Null text counts as empty: no words, so base_failed. Repeated rows are judged alike. A text
    of any length is judged whole. Other columns are unused, whatever their names; an empty
    table gives an empty result. A null doc_id stays null.
    """
    docs = docs.select("doc_id", "text")
    ordered = order_rules(docs, RULES if rules is None else rules, sample_rows)
    measured = _prepared(docs).select(
        "doc_id", TEXT, WORDS, LINES, F.expr(N_WORDS).alias("n_words"), F.expr(WORD_CHARS).alias("word_chars"), F.expr(N_SYMBOLS).alias("n_symbols"), F.expr(N_DUP_LINES).alias("n_dup_lines"), F.expr(N_REPEAT_WORDS).alias("n_repeat_words")
    )
    # The measures are there already; rules read them instead of counting again.
    known = {N_REPEAT_WORDS: "n_repeat_words", N_DUP_LINES: "n_dup_lines", WORD_CHARS: "word_chars", N_SYMBOLS: "n_symbols", N_WORDS: "n_words"}

    def reuse(sql: str) -> str:
        for long, short in known.items():
            sql = sql.replace(long, short)
        return sql

    base = F.expr(" OR ".join(f"({reuse(r.rejects)})" for r in BASE))
    kept = F.when(base, F.lit(False)).otherwise(verdict([Rule(r.name, reuse(r.rejects)) for r in ordered]))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))


def keep_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, base rules in the cascade; same columns. Null and empty texts go."""
    ordered = order_rules(docs, BASE + RULES, sample_rows)
    cases = "".join(f" WHEN {r.rejects} THEN false" for r in ordered)
    # A filter is pushed below columns, so words and lines are bound inside it, once per text.
    text = "coalesce(cast(text AS string), '')"
    lines = f"filter(split({text}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    bound = f"struct({text} AS {TEXT}, array_remove(split({text}, '{SPACE}+'), '') AS {WORDS}, {lines} AS {LINES})"
    for name in (WORDS, LINES, TEXT):
        cases = cases.replace(name, f"d.{name}")
    return docs.where(F.expr(f"transform(array({bound}), d -> CASE{cases} ELSE true END)[0]"))


def op9_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def sql(source: str) -> str:
    """DuckDB: op9's rows over a table or subquery."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i:i+4] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, d.text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 200 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) < 100 * word_chars) AS kept
FROM m"""


SQL = sql("documents")
