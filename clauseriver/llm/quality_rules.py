"""Quality rules: per-document counts, and verdicts on whole hosts by shrunken failure rates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import WORD, cut, joined_small, own_names, read, small_batches

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Rules whose failures are counted by host, over the columns of MEASURES.
RULES = {
    "too_short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "n_dup_lines > 5 AND 20 * n_dup_lines > n_words",
}
BASE = ("too_short", "repeats")
#: Share of a host's documents (after shrinkage) that must fail one rule before its clean ones go too.
MAX_RATE = 0.8
_word = re.compile(WORD)
_symbols = "#*$%&|<>"


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of MEASURES over one whole text; null counts as empty."""
    text = text or ""
    words = _word.findall(text)
    symbols = sum(map(text.count, _symbols))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif _word.search(line):
            lines.add(line)
    repeated, n = 0, len(words) - 2
    if n > 1:
        number: dict[str, int] = {}
        w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
        # numbers of different pairs, then of different triples, stay below the number of words, so nothing overflows
        pairs = np.unique(w[:-2] * len(number) + w[1:-1], return_inverse=True)[1]
        _, which, times = np.unique(pairs * len(number) + w[2:], return_inverse=True, return_counts=True)
        hit = times[which] > 1
        if hit.any():
            cover = np.zeros(len(words), bool)
            for k in range(3):
                cover[k : n + k] |= hit
            repeated = int(cover.sum())
    return len(words), sum(map(len, words)), symbols, dup, repeated


def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for texts in batches:
        yield pd.DataFrame([measure_text(t) for t in texts], columns=names)


def with_measures(docs: DataFrame, text: str = "text", out: str = "_measures") -> DataFrame:
    """docs with the counts over its texts, as a struct; texts stay where they are."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(measure, MEASURES)(F.col(f"`{text}`")))


def fails(rule: str, measures: str) -> Column:
    """Whether a document fails a rule, by its measures."""
    return F.expr(re.sub(r"\b(n_\w+|word_chars)", rf"`{measures}`.\1", RULES[rule]))


def host_verdicts(measured: DataFrame, host: str, measures: str = "_measures", max_rate: float = MAX_RATE) -> DataFrame:
    """host, n, rate_<rule> for each rule, host_ok: no rule's shrunken failure rate is over max_rate.

    The failures of a rule follow a beta-binomial over hosts, so that hosts with few documents stay near the
    mean rate. Its prior is fitted to all hosts by moments: from the spread of the rates is taken what
    documents would differ by if all hosts were alike, and where nothing is left the hosts count as alike.
    Rows without a host take part in no verdict. Counts are summed before the shuffle, and only hosts (not
    documents) meet after it.
    """
    counts = [F.sum(F.when(fails(r, measures), 1).otherwise(0)).alias(f"fails_{r}") for r in RULES]
    known = measured.where(F.col(f"`{host}`").isNotNull())
    hosts = cut(known.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n"), *counts))
    moments = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.expr("CAST(n AS DOUBLE) * n")).alias("n_sq"),
        *[F.sum(f"fails_{r}").alias(r) for r in RULES],
        *[F.sum(F.expr(f"CAST(fails_{r} AS DOUBLE) * fails_{r} / n")).alias(f"{r}_sq") for r in RULES],
    ).first()
    ok = F.lit(True)
    k, n = moments["hosts"], moments["n"] or 1
    for r in RULES:
        mean = (moments[r] or 0) / n
        spread = (moments[f"{r}_sq"] or 0) - n * mean * mean
        noise, room = mean * (1 - mean), n - (moments["n_sq"] or 0) / n - (k - 1)
        alike = (spread / noise - (k - 1)) / room if noise > 1e-12 and room > 1e-9 else 0.0  # correlation within hosts
        weight = min(max(1 / alike - 1, 1.0), 1e6) if alike > 1e-6 else 1e6
        rate = (F.col(f"fails_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        hosts = hosts.withColumn(f"rate_{r}", rate)
        ok &= rate <= max_rate
    return hosts.select("host", "n", *[f"rate_{r}" for r in RULES], ok.alias("host_ok"))


def judge_measured(measured: DataFrame, host: str = "source", max_rate: float = MAX_RATE, measures: str = "_measures") -> DataFrame:
    """Rows with measures, as with_measures() gives them: with _base_failed and _kept added (see judge_documents)."""
    base, kept, verdict, key = own_names(measured, "_base_failed", "_kept", "_host_ok", "_host")
    verdicts = host_verdicts(measured, host, measures, max_rate).select(F.col("host").alias(key), F.col("host_ok").alias(verdict))
    failed = F.lit(False)
    for name in BASE:
        failed |= fails(name, measures)
    joined = joined_small(measured.withColumn(key, F.col(f"`{host}`")), verdicts, key)
    joined = joined.withColumn(base, failed).withColumn(kept, ~F.col(base) & F.coalesce(verdict, F.lit(True)))
    return joined.drop(key, verdict)


def judge_documents(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """docs (text, a host column, ...) with _measures (a struct of MEASURES), _base_failed and _kept added.

    Base rules reject texts under 50 words, and those where over half of the words stand in repeated
    3-word windows; null texts count as empty and are rejected. A document that passes is still dropped
    if its host is: where, after shrinkage, over max_rate of all its documents fail one of RULES. So a
    host must be bad nearly throughout before it takes a clean document with it. Documents without a
    host are judged by the base rules alone. Texts are read twice (hosts first) and never shuffled, unless
    the hosts are too many to broadcast. Rows that repeat are judged alike, each; all other columns stay (where docs
    has columns of these names, the added ones get more underscores; they are the last three). An empty table gives an
    empty result.
    """
    (measures,) = own_names(docs, "_measures")
    return judge_measured(with_measures(docs, out=measures), host, max_rate, measures)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = cut(with_measures(docs).drop("text"))  # a few numbers a document, so that texts are read once
    return judge_measured(measured).select(
        "doc_id", "_measures.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept")
    )


def _sql_rate(rule: str) -> str:
    return f"""
, m_{rule} AS (
  SELECT mean, CASE WHEN alike > 1e-6 THEN least(greatest(1 / alike - 1, 1.0), 1e6) ELSE 1e6 END AS weight
  FROM (SELECT *, CASE WHEN mean * (1 - mean) > 1e-12 AND room > 1e-9
      THEN ((sq - n * mean * mean) / (mean * (1 - mean)) - (k - 1)) / room ELSE 0 END AS alike
    FROM (SELECT *, n - n_sq / n - (k - 1) AS room
      FROM (SELECT sum({rule}) / sum(n) AS mean, sum({rule} * {rule} / n) AS sq, sum(n) AS n, sum(n * n) AS n_sq, count(*) AS k FROM h))))"""


OP8_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS text FROM documents)
, w AS (SELECT i, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)
, t AS (SELECT i, unnest(range(1, len(words) - 1)) AS k, words FROM w)
, g AS (SELECT i, k, count(*) OVER (PARTITION BY i, words[k], words[k + 1], words[k + 2]) AS c FROM t)
, p AS (SELECT i, count(DISTINCT k + o) AS n FROM g, range(3) AS s(o) WHERE c > 1 GROUP BY i)
, l AS (SELECT i, line, count(*) - 1 AS c FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i, line)
, q AS (SELECT i, sum(c) AS n FROM l GROUP BY i)
, m AS (
  SELECT d.i, doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    CAST(coalesce(q.n, 0) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d JOIN w USING (i) LEFT JOIN p USING (i) LEFT JOIN q USING (i))
, f AS (SELECT *, """
    + ", ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END AS {name}" for name, rule in RULES.items())
    + """ FROM m)
, h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, """
    + ", ".join(f"CAST(sum({r}) AS DOUBLE) AS {r}" for r in RULES)
    + " FROM f WHERE source IS NOT NULL GROUP BY source)"
    + "".join(map(_sql_rate, RULES))
    + """
, v AS (SELECT source, """
    + " AND ".join(
        f"({r} + (SELECT mean * weight FROM m_{r})) / (n + (SELECT weight FROM m_{r})) <= 0.8" for r in RULES
    )
    + """ AS host_ok FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  too_short + repeats > 0 AS base_failed, too_short + repeats = 0 AND coalesce(host_ok, true) AS kept
FROM f LEFT JOIN v USING (source)
"""
)
