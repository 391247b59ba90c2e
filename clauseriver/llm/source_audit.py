"""Divergence between the sources of a language, from joint tables of term counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clauseriver.llm.common import joined_small, read, small_batches, text_pieces, written

#: A term is in this many documents of its language at least.
LEAST_DOCS = 3
#: Probabilities are whole billionths; ALPHA is added to each count.
SCALE, ALPHA = 1_000_000_000, 1
TOP_TERMS = 200
#: Terms of a block, and columns of one matrix product.
BLOCK, COLUMNS = 4096, 512
#: Counts that a task holds before it passes them on.
MOST_HELD = 400_000
COUNTED = ["lang", "source", "term", "n", "docs"]
#: Bytes of terms: ASCII letters, lower-cased, and all beyond ASCII; the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences) and docs, summed as far as a task can hold them."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (ns, docs) in groups.items():
            if ns:
                names = [pa.repeat(pa.scalar(x, pa.string()), len(ns)) for x in (lang, source)]
                numbers = [pa.array(x, pa.int64()) for x in (list(ns.values()), [docs[t] for t in ns])]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(ns), pa.binary()).cast(pa.string()), *numbers], COUNTED)
        groups.clear()

    for batch in batches:
        lang, source, text = (batch.column(c) for c in ("lang", "source", "text"))
        for *group, data in zip(lang.to_pylist(), source.to_pylist(), text.cast(pa.binary()).to_pylist(), strict=True):
            ns, docs = groups.setdefault(tuple(group), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in text_pieces(data.translate(_LETTERS)):
                terms = piece.split()
                ns.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(ns) for ns, _ in groups.values()) > MOST_HELD:
            yield from out()
    yield from out()


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term and counts (source, n) of the terms in at least least_docs of the language's documents."""
    small_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = plain.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def level_p(level: int, total: int, v: int) -> int:
    return 1 + SCALE * (level + ALPHA) // (total + ALPHA * v)


def joint_values(counts: np.ndarray, totals: list[int], v: int, columns: int = COLUMNS) -> np.ndarray:
    """value[g, h]: the sum over the terms (rows of counts, a column for each group) of f with p of group g and q of group h.

    f depends on the two counts alone. So a block of terms is turned into indicator columns, one for each (group, count
    level); their transpose times themselves has, for each two columns, the number of terms with both levels: the joint
    tables of all pairs of groups, each entry of which is priced once. Terms go by their largest count, so that many of
    few levels share a product; a block takes as many as `columns` allows, and wide products go by tiles of that size.
    """
    size = counts.shape[1]
    out = np.zeros((size, size), dtype=np.int64)
    counts = counts[np.argsort(counts.max(axis=1), kind="stable")]
    at, step = 0, len(counts)
    while at < len(counts):
        step = min(step, len(counts) - at)
        found = [np.unique(counts[at : at + step, g], return_inverse=True) for g in range(size)]
        widths = [len(levels) for levels, _ in found]
        if sum(widths) > columns and step > 1:
            step = max(1, step // 2)
            continue
        starts = np.concatenate([[0], np.cumsum(widths)])
        group = np.repeat(np.arange(size), widths)
        p = np.array([level_p(int(x), totals[g], v) for g, (levels, _) in enumerate(found) for x in levels], dtype=np.int64)
        one_hot = np.zeros((step, starts[-1]), dtype=np.float32)  # products of up to BLOCK ones: exact
        for g, (_, place) in enumerate(found):
            one_hot[np.arange(step), starts[g] + place] = 1
        for a in range(0, starts[-1], columns):
            left = slice(a, a + columns)
            rows, first = np.unique(group[left], return_index=True)
            for b in range(0, starts[-1], columns):
                right = slice(b, b + columns)
                joint = (one_hot[:, left].T @ one_hot[:, right]).astype(np.int64)
                apart = p[left, None] - p[None, right]
                priced = joint * (apart * apart // p[None, right])
                cols, begin = np.unique(group[right], return_index=True)
                out[np.ix_(rows, cols)] += np.add.reduceat(np.add.reduceat(priced, first, axis=0), begin, axis=1)
        at, step = at + step, step * 2
    return out


def pair_values(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: partial sums of each block (lang, block, term, source, n) for all pairs of its language's groups."""

    def price(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # no term fell into this block
            return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []}).astype({"value": "int64"})
        own = own.sort_values("source")
        sources = own["source"].to_numpy()
        counts = np.zeros((rows["term"].nunique(), len(sources)), dtype=np.int64)
        counts[pd.factorize(rows["term"])[0], pd.Index(sources).get_indexer(rows["source"])] = rows["n"]
        values = joint_values(counts, [int(x) for x in own["total"]], int(own["v"].iloc[0]))
        g, h = np.nonzero(~np.eye(len(sources), dtype=bool))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": sources[g], "item": sources[h], "value": values[g, h]})

    sized = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("v") / BLOCK) - 1)))
    sums = blocks.groupBy("lang", "block").cogroup(sized.groupBy("lang", "block")).applyInPandas(price, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def probability(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + ALPHA) / (total + ALPHA * v)), exact for counts up to 10**18."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + ALPHA), whole(total + v * ALPHA))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """How far the sources (lang, source, text of docs) of each language differ: lang, source, part, item, value, rank.

    Part `pair` has each other source of the language, part `term` the terms that mark the source against its language.
    Nulls are empty strings; a language without kept terms has pairs of value 0; a source without terms is a group like
    others; a single source has no pairs. Ties go by item, bytewise. Repeated rows count each. Long texts are read
    in pieces. No documents, no rows. Other columns of docs take no part. A language's sources meet in all pairs, as
    that is the result; blocks of terms are dealt to tasks, each of which holds a number for each pair.
    """
    kept = written(kept_terms(docs, least_docs))
    flat = kept.select("lang", "term", F.aggregate("counts.n", F.lit(0).cast("long"), lambda s, n: s + n).alias("all_n"), F.inline("counts"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v")]))
    dealt = joined_small(flat.drop("all_n"), sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK))).drop("v")
    sums = pair_values(dealt, groups.where("v > 0"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    sized = joined_small(flat.withColumn("_key", F.struct("lang", "source")), groups.join(langs, "lang").select(F.struct("lang", "source").alias("_key"), "total", "v", "lang_total"), "_key")
    p, q = probability(F.col("n"), F.col("total"), F.col("v")), probability(F.col("all_n"), F.col("lang_total"), F.col("v"))
    marks = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = marks.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")).withColumn("rank", F.row_number().over(by_value))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs.withColumn("rank", F.row_number().over(by_value)), "pair").unionByName(part(terms.where(F.col("rank") <= top_terms), "term"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


_P = "(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + {v}))"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)
, w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
, kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3)
, c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL)
, v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang)
, g AS (
  SELECT x.lang, x.source, coalesce(t.total, 0) AS total, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source) LEFT JOIN v USING (lang))
, a AS (
  SELECT g.lang, g.source, kept.term, {_P.format(n="coalesce(c.n, 0)", total="g.total", v="g.v")} AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term)
, l AS (
  SELECT lang, term, {_P.format(n="n", total="total", v="v")} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang))
, s AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL)
, r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT a.lang, a.source, 'term', a.term, ((p - q) * (p - q)) // q FROM a JOIN c ON c.lang = a.lang AND c.source = a.source AND c.term = a.term JOIN l ON l.lang = a.lang AND l.term = a.term WHERE p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
