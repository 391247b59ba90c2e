"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clauseriver.llm.common import WORD, cut, hex_slot, n_words, own_names, read, row_key, small_batches, sums_before

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Weight schedules over the course of training, given at equally spaced times, straight lines between.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size) with rank (from 0), weight and target.

    Sources rank by code point, null last, and take the weights in turn. Together they are to give
    share times all words; a target stops at repeats times its source, and what is cut off is shared
    again by weight until no target is above. That is a water level: with the sources in order of
    cap / weight, the first k are full for the least k where the next one isn't over its cap. Only
    sources, never documents, meet in the windows without a key.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", turn)
    cap = (F.col("source_size") * repeats).cast("double")
    by_level = W.orderBy(cap / F.col("weight"), "rank")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = F.coalesce(F.sum(cap).over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    levels = ranked.withColumn("_level", (total - full) / open_weight)
    # the level of the first source that its cap doesn't bind; none where all are empty or full
    free = F.min(F.when(F.col("_level") * F.col("weight") <= cap, F.struct(cap / F.col("weight"), F.col("rank"), F.col("_level"))))
    return levels.withColumn("_free", free.over(everything)["_level"]).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("_free").isNull(), cap).otherwise(F.least(cap, F.col("_free") * F.col("weight"))).alias("target"),
    )


def moment(part: Column, schedule: tuple[float, ...]) -> Column:
    """The time (0 to 1) by which the schedule's integral reaches `part` (0 to 1) of its whole.

    The integral is quadratic on each piece, and so is inverted in closed form.
    """
    step = 1 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:], strict=False)]
    out, done = None, 0.0
    for i, area in enumerate(areas):
        a, slope = schedule[i], (schedule[i + 1] - schedule[i]) / step
        need = part * sum(areas) - done
        ahead = need / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * need)) - a) / slope
        at = F.lit(i * step) + ahead
        reached = part * sum(areas) <= done + area if i < len(areas) - 1 else F.lit(True)
        out = F.when(reached, at) if out is None else out.when(reached, at)
        done += area
    return F.least(F.lit(1.0), out)


def assign(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, schedules=SCHEDULES, seed: int = 0) -> DataFrame:
    """Per row of docs (doc_id, source, text): size, source_size, target, taken, and its copies.

    Each source's documents are put in an order by digest and laid end to end, again and again, until
    their words fill the target; the last one taken may be cut. `copies` lists (part, words, position):
    part 0, 1, ... for each time round, the words of it that are taken (all, but for the last), and the
    training position: the time at which the source's integrated schedule has called for all that lies
    before. taken is the sum of words.

    Null and empty texts have no words and no copies; sources may be null or empty strings, which differ.
    Rows that repeat count each; documents of one digest (the same doc_id) go by size, then by a digest of the row.
    Two sources never tie, as they differ in name. Only counts of a long text are held. No documents, no rows.
    `_key` is common to rows that agree in all columns; extra columns of docs take part in it alone.
    """
    sized = cut(docs.select(
        row_key(docs).alias("_key"), "doc_id", "source", n_words(F.col("text")).alias("size"),
        F.sha2(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256).alias("_digest"),
    ))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    aims = cut(aims.withColumn("target_words", F.round("target").cast("long")))
    placed = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    placed = sums_before(placed, "rank", hex_slot("_digest"), ["_digest", "size", "_key"], "size", "_before")
    which = F.pmod("rank", F.lit(len(schedules)))

    def copy(r: int) -> Column:
        start = F.col("_before") + F.col("source_size") * r
        words = F.least(F.col("size"), F.col("target_words") - start)
        at = None
        for i, schedule in enumerate(schedules):
            t = moment(start / F.greatest(F.col("target"), F.lit(1.0)), schedule)
            at = F.when(which == i, t) if at is None else at.when(which == i, t)
        return F.when(words > 0, F.struct(F.lit(r).alias("part"), words.alias("words"), at.alias("position")))

    copies = F.array_compact(F.array(*[copy(r) for r in range(repeats)]))
    return placed.withColumn("copies", copies).select(
        "_key", "doc_id", "source", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"), "copies",
    )


def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """Each text up to the end of its count-th word."""
    word = re.compile(WORD)

    def cut_text(text: str, n: int) -> str:
        end = 0
        for k, m in enumerate(word.finditer(text), 1):
            end = m.end()
            if k == n:
                break
        return text[:end]

    return pd.Series([cut_text(t, n) for t, n in zip(texts, counts, strict=True)])


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: docs' columns, a row for each copy taken, range-sorted by training position.

    `_position` (0 to 1) is added as the last column (with more underscores if docs has one). The text of a copy
    that is cut ends after its last word taken. Ties in time go by a digest of the row.
    """
    small_batches(docs.sparkSession)
    key, position, copy, part, size = own_names(docs, "_key", "_position", "_copy", "_part", "_size")
    plan = assign(docs, **settings).where("size(copies) > 0")
    plan = plan.select(F.col("_key").alias(key), F.col("size").alias(size), F.explode("copies").alias(copy))
    once = docs.withColumn(key, row_key(docs)).dropDuplicates([key])
    rows = once.join(plan, key)
    cut_text = F.pandas_udf(first_words, "string")("text", F.col(f"{copy}.words"))
    text = F.when(F.col(f"{copy}.words") < F.col(size), cut_text).otherwise(F.col("text"))
    rows = rows.select(
        *[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns], key, F.col(f"{copy}.part").alias(part),
        F.col(f"{copy}.position").alias(position),
    )
    order = [position, key, part]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(key, part)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix as a row for each document, in the order of its first copy: `position` and `position_2` are the
    training positions of its copies (null where there is none)."""
    plan = assign(read(spark, sf_dir, "documents"))
    first, second = (F.round(F.get(F.col("copies.position"), F.lit(k)), 9) for k in range(REPEATS))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), second.alias("position_2"))
    return plan.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    sha256('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents)
, s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
, r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s)
, c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][rank % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM r)
, l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c)
, f AS (SELECT level AS free FROM l WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1)
, a AS (SELECT *, CASE WHEN (SELECT free FROM f) IS NULL THEN cap ELSE least(cap, (SELECT free FROM f) * weight) END AS target FROM l)
, o AS (
  SELECT doc_id, size, source_size, target, rank, CAST(round(target) AS BIGINT) AS words,
    coalesce(sum(size) OVER (PARTITION BY rank ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
, c2 AS (SELECT *, least(size, words - before - k * source_size) > 0 AS takes, (before + k * source_size) / greatest(target, 1.0) AS part
  FROM o, (VALUES (0), (1)) AS v(k))
, q AS (
  SELECT *, CASE WHEN takes THEN round(least(1.0, CASE rank % 3
    WHEN 0 THEN CASE WHEN part <= 0.625 THEN 1.5 - sqrt(greatest(0, 2.25 - 2 * part)) ELSE 0.5 + (1 - sqrt(greatest(0, 1 - 2 * (part - 0.625)))) END
    WHEN 1 THEN part
    ELSE CASE WHEN part <= 0.375 THEN sqrt(greatest(0, 0.25 + 2 * part)) - 0.5 ELSE 0.5 + sqrt(greatest(0, 1 + 2 * (part - 0.375))) - 1 END
  END), 9) END AS position FROM c2)
SELECT a.doc_id, a.size, a.source_size, a.target,
  CAST(greatest(0, least(a.size, a.words - a.before)) + greatest(0, least(a.size, a.words - a.before - a.source_size)) AS BIGINT) AS taken,
  a.position, b.position AS position_2
FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.k = 0 AND b.k = 1
"""
