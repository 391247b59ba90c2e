"""Scores of texts by a log-bilinear neural language model, trained by noise-contrastive estimation."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import read, small_batches, text_pieces, written

#: Added to each count.
ALPHA = 0.1
#: Frequent words and endings of other words that are units of the model, and the words whose counts every task holds.
WORDS, ENDINGS, HELD = 1791, 256, 200_000
#: Components of an embedding, noise words for a batch of tokens, tokens of a batch.
SIZE, NOISE, BATCH = 16, 24, 1024
#: The training texts are dealt to so many rounds, after each of which the tasks' models become one; learning rate.
ROUNDS, RATE = 3, 0.07
#: Counts that a task holds before it passes them on; models that one task averages.
MOST_HELD, FAN = 400_000, 64
#: Stands for the end of a text in tables of words; no word has white space.
END = b"\n"


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, piece by piece: bytes.lower and bytes.split know ASCII only."""
    for piece in text_pieces(data.lower()):
        yield piece.split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: the tokens of training texts, summed as far as a task can hold them."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for data in batch.column(0).cast(pa.binary()).to_pylist():
            for words in words_of(data):
                held.update(words)
            held[END] += 1
        if len(held) > MOST_HELD:
            yield out()
    yield out()


class Units(dict):
    """The unit of each held word; any other word's is that of its last two bytes, or the last one."""

    def __init__(self, held: dict[bytes, int], endings: dict[bytes, int], last: int):
        super().__init__(held)
        self.endings, self.last = endings, last

    def __missing__(self, word: bytes) -> int:
        return self.endings.get(word[-2:], self.last)

    def __reduce__(self):
        return Units, (dict(self), self.endings, self.last)


@dataclass
class Lexicon:
    """The units of the model and what is known of words.

    Unit 0 is the end of a text; then come the frequent words, then classes of all other words by their last two
    bytes, the last one for endings that have no class. A word of a class has its share of the class by count:
    (c + ALPHA) / (tokens + ALPHA * (words + 1)), where the 1 is for what is unknown.
    """

    units: Units
    counts: dict[bytes, int]  # of held words
    tokens: np.ndarray  # of each unit
    words: np.ndarray  # of each unit
    n: int
    v: int

    @property
    def first_class(self) -> int:
        return len(self.tokens) - len(self.units.endings) - 1

    def class_base(self) -> np.ndarray:
        """log10 of what a class word's count is divided by; 0 for other units."""
        base = np.log10(self.tokens + ALPHA * (self.words + 1))
        base[: self.first_class] = 0
        return base


def lexicon(counts: DataFrame, words: int = WORDS, endings: int = ENDINGS, held: int = HELD) -> Lexicon:
    """From all counts (word, n). What comes to the driver is bounded: `held` words at most, a number for each pair of bytes, a histogram."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = counts.where(F.col("word") != END).groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect()
    least, total = None, 0
    for s in sizes:  # counts by sixteenths of a power of two: a few hundred rows
        total += s["words"]
        if total > held:
            break
        least = s["size"]
    rows = counts.where((F.col("word") == END) | ((size >= least) if least is not None else F.lit(False))).toPandas()
    end = int(rows.loc[rows["word"] == END, "n"].sum())
    rows = rows[rows["word"] != END]
    rows = sorted(zip(map(bytes, rows["word"]), map(int, rows["n"]), strict=True), key=lambda r: (-r[1], r[0]))
    tails = counts.where(F.col("word") != END).groupBy(F.substring("word", -2, 2).alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    by_tail = {bytes(t["tail"]): [t["n"], t["words"]] for t in tails}
    n, v = end + sum(t[0] for t in by_tail.values()), (end > 0) + sum(t[1] for t in by_tail.values())
    for word, c in rows[:words]:
        by_tail[word[-2:]][0] -= c
        by_tail[word[-2:]][1] -= 1
    common = sorted((t for t in by_tail if by_tail[t][1]), key=lambda t: (-by_tail[t][0], t))[: endings - 1]
    rest = [sum(x[i] for t, x in by_tail.items() if t not in set(common)) for i in (0, 1)] if len(common) < len(by_tail) else [0, 0]
    first = 1 + min(words, len(rows))
    classes = {t: first + i for i, t in enumerate(common)}
    last = first + len(common)
    units = Units({w: i + 1 if i < words else classes.get(w[-2:], last) for i, (w, _) in enumerate(rows)}, classes, last)
    per_class = [by_tail[t] for t in common] + [rest]
    tokens = np.array([end, *(c for _, c in rows[:words]), *(t[0] for t in per_class)], dtype=np.float64)
    kinds = np.array([1] * first + [t[1] for t in per_class], dtype=np.float64)
    return Lexicon(units, dict(rows), tokens, kinds, n, v)


@dataclass
class LogBilinear:
    """Score of unit w after units a and then b: (r[b] @ c[0] + r[a] @ c[1]) @ q[w] + bias[w]."""

    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    bias: np.ndarray
    seen: list[np.ndarray]  # sums of squared gradients, of r, q, c, bias

    @classmethod
    def start(cls, tokens: np.ndarray, size: int = SIZE, seed: int = 0) -> LogBilinear:
        """Small random embeddings; the biases are the units' log shares, so that training starts at unigram probabilities."""
        rng, n = np.random.default_rng(seed), len(tokens)
        r, q = (rng.normal(0, 0.1, (n, size)).astype(np.float32) for _ in range(2))
        c = np.stack([np.eye(size, dtype=np.float32)] * 2)
        bias = np.log((tokens + 1) / (tokens + 1).sum()).astype(np.float32)
        return cls(r, q, c, bias, [np.full(n, 1e-2, np.float32), np.full(n, 1e-2, np.float32), np.full((2, size, size), 1.0, np.float32), np.full(n, 1e-2, np.float32)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c, self.bias, *self.seen)])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        """A model of this one's shape with the numbers of `flat`."""
        out, at = [], 0
        for x in (self.r, self.q, self.c, self.bias, *self.seen):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out[:4], out[4:])

    def learn(self, flat: np.ndarray, token: np.ndarray, share: np.ndarray, noise: np.ndarray, rate: float = RATE) -> None:
        """One step of noise-contrastive estimation on the units of `flat` from the third on that are tokens.

        `noise` is common to the batch, `share` has the log probabilities it is drawn by. A unit's gradients as a target, as
        the one before and as the one two before are added up by place, then by unit, in one sum. Step sizes
        are divided by the root of the squared gradients that a row has had so far.
        """
        k, size, n = np.float32(np.log(len(noise))), self.r.shape[1], len(flat)
        r, target = self.r.take(flat, axis=0), flat[2:]
        qw, qn, over = self.q.take(target, axis=0), self.q[noise], self.bias - share
        ahead = r[1:-1] @ self.c[0] + r[:-2] @ self.c[1]
        real = np.einsum("ij,ij->i", ahead, qw) + over.take(target) - k
        made = ahead @ qn.T + (over[noise] - k)
        up = token[2:] / (1 + np.exp(np.minimum(real, 30)))
        down = -token[2:, None] / (1 + np.exp(np.minimum(-made, 30)))
        d_ahead = up[:, None] * qw + down @ qn
        step = np.zeros((n + len(noise), 2 * size + 1), dtype=np.float32)
        step[1 : n - 1, :size] = d_ahead @ self.c[0].T
        step[: n - 2, :size] += d_ahead @ self.c[1].T
        np.multiply(up[:, None], ahead, out=step[2:n, size:-1])
        step[2:n, -1] = up
        step[n:, size:-1] = down.T @ ahead
        step[n:, -1] = down.sum(axis=0)
        d_c = np.stack([r[1:-1].T @ d_ahead, r[:-2].T @ d_ahead])
        ids = np.concatenate([flat, noise])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows, sums = ids[first], np.add.reduceat(step.take(order, axis=0), first, axis=0)
        squares = sums * sums
        for table, seen, at in ((self.r, self.seen[0], slice(0, size)), (self.q, self.seen[1], slice(size, 2 * size)), (self.bias[:, None], self.seen[3], slice(2 * size, None))):
            seen[rows] += squares[:, at].mean(axis=1)
            table[rows] += sums[:, at] * (rate / np.sqrt(seen[rows]))[:, None]
        self.seen[2] += d_c * d_c
        self.c += rate * d_c / np.sqrt(self.seen[2])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near[b, w], far[a, w], norm[a, b]: ln of the probability of w after a, b is near[b, w] + far[a, w] - norm[a, b].

        The sum over all w of exp(near) * exp(far) is one matrix product for all contexts.
        """
        q = self.q.T.astype(np.float64)
        near = self.r.astype(np.float64) @ self.c[0] @ q + self.bias
        far = self.r.astype(np.float64) @ self.c[1] @ q
        near_top, far_top = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        norm = np.log(np.exp(far - far_top) @ np.exp(near - near_top).T) + far_top + near_top.T
        return near.astype(np.float32), far.astype(np.float32), norm.astype(np.float32)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The units of texts one after the other, each after two ends, and which of them are tokens."""
    flat = np.concatenate([x for u in texts for x in ((0, 0), u)]).astype(np.uint16)
    token = np.ones(len(flat), dtype=np.float32)
    starts = np.cumsum([0] + [len(u) + 2 for u in texts[:-1]])
    token[starts] = token[starts + 1] = 0
    return flat, token


def train(docs: DataFrame, lex: Lexicon, size: int = SIZE, noise: int = NOISE, rounds: int = ROUNDS, rate: float = RATE, seed: int = 0) -> LogBilinear:
    """A model of all training texts (column text, no nulls).

    In each round, every task goes on from the common model with its part of a hash's share of the texts; the tasks' models
    are averaged, by tokens, in groups of FAN. The numbers of one model meet the driver.
    """
    model = LogBilinear.start(lex.tokens, size, seed)
    sc = docs.sparkSession.sparkContext
    share = model.bias.copy()
    width = 8192
    for turn in range(rounds):
        told = sc.broadcast((lex, model, share))

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            lex, model, share = told.value
            model = model.filled(model.flat())
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, turn, task])
            edges = np.cumsum(np.exp(share.astype(np.float64)))
            done = 0
            for batch in batches:
                for texts in _some(batch.column(0).cast(pa.binary()).to_pylist(), lex.units):
                    flat, token = laid_out(texts)
                    for i in range(0, len(flat) - 2, BATCH):
                        draw = np.minimum(np.searchsorted(edges, rng.random(noise) * edges[-1]), len(edges) - 1).astype(np.uint16)
                        model.learn(flat[i : i + BATCH + 2], token[i : i + BATCH + 2], share, draw, rate)
                    done += int(token.sum())
            if done:
                flat = model.flat().astype(np.float64) * done
                parts = [flat[i : i + width] for i in range(0, len(flat), width)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([float(done)] * n), pa.array(parts, pa.list_(pa.float64()))], ["task", "part", "weight", "sums"])

        part = docs.where(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(rounds)) == turn).select("text")
        sums = part.mapInArrow(learn, "task long, part int, weight double, sums array<double>")
        sums = written(sums)
        most = (sums.agg(F.max("task")).first()[0] or 0) + 1
        while True:
            most = -(-most // FAN)
            sums = sums.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "part").applyInPandas(_added, sums.schema)
            if most <= 1:
                break
        rows = sums.orderBy("part").toPandas()
        if len(rows):
            model = model.filled(np.concatenate([np.asarray(s) / w for s, w in zip(rows["sums"], rows["weight"], strict=True)]))
        told.unpersist()
    return model


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["task", "weight"])
    first = rows.iloc[:1].copy()
    first["weight"] = rows["weight"].sum()
    first["sums"] = [np.sum(np.stack(rows["sums"].to_list()), axis=0)]
    return first


def _some(texts: list[bytes], units: Units, most: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The texts' units with ends, by about `most` tokens; a longer text comes in parts, each with an end."""
    out, n = [], 0
    for data in texts:
        for words in words_of(data):
            out.append(np.fromiter(itertools.chain(map(units.__getitem__, words), (0,)), np.uint16, len(words) + 1))
            n += len(words)
            if n >= most:
                yield out
                out, n = [], 0
    if out:
        yield out


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10))


def score_texts(docs: DataFrame, lex: Lexicon, model: LogBilinear) -> DataFrame:
    """Per row of docs (key, doc_id, held_out, text): n_tokens, n_known, the sum of log10 (count + ALPHA) over held words
    (base), the score without the counts of words that aren't held, and those words with their numbers."""
    told = docs.sparkSession.sparkContext.broadcast((lex, *model.tables()))
    names = docs.columns[:3]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, near, far, norm = told.value
        ln10, end, class_base, first = np.log(10), lex.tokens[0], lex.class_base(), lex.first_class
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(3).cast(pa.binary()).to_pylist():
                units, counts, rare = [np.zeros(2, np.uint16)], [], Counter()
                for words in words_of(data):
                    units.append(np.fromiter(map(lex.units.__getitem__, words), np.uint16, len(words)))
                    counts.append(np.fromiter(map(lex.counts.get, words, itertools.repeat(0)), np.float64, len(words)))
                    rare.update(words[i] for i in np.flatnonzero(counts[-1] == 0))
                flat, c = np.concatenate([*units, units[0][:1]]), np.concatenate([*counts, [end]])
                a, b, w = flat[:-2], flat[1:-1], flat[2:]
                logs = np.log10(c + ALPHA)
                logs[:-1][c[:-1] == 0] = 0
                total = ((near[b, w] + far[a, w]).astype(np.float64) - norm[a, b]).sum() / ln10 - class_base[w].sum() + logs[w >= first].sum()
                out.append((len(w), int((c > 0).sum()), logs.sum(), total, list(rare), list(rare.values())))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            arrays = [*batch.columns[:3], *[pa.array(x, t) for x, t in zip(columns, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens", "n_known", "base", "score", "rare", "rare_n"])

    kept = ", ".join(f"{c} {t}" for c, t in docs.dtypes[:3])
    return docs.mapInArrow(score, f"{kept}, n_tokens long, n_known long, base double, score double, rare array<binary>, rare_n array<long>")


def score_corpus(docs: DataFrame, words: int = WORDS, endings: int = ENDINGS, held: int = HELD, **training) -> DataFrame:
    """Scores for each row of docs (doc_id, text), learned from those whose crc32 of doc_id isn't divisible by 10.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10; see the module's model). Counts
    cover all training texts; words whose counts tasks don't hold meet them in a join of (document, word) rows.

    A null text is empty: one token, its end. A null doc_id is not held out. Rows that repeat count and score each. Long texts
    are split into words piece by piece and scored whole. Without training texts every token has probability 1 in the base, and an
    end and an unknown word are about as likely in the model. No documents, no rows. Other columns of docs take no part.
    """
    small_batches(docs.sparkSession)
    key = "_row"
    out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    plain = docs.select(F.monotonically_increasing_id().alias(key), "doc_id", out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    learned = plain.where("NOT held_out").select("text")
    counts = learned.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 0"))
    lex = lexicon(counts, words, endings, held)
    model = train(learned, lex, **training)
    rows = written(score_texts(plain, lex, model))
    rare = rows.select(key, F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select(key, "x.rare", "x.rare_n")
    c = F.coalesce("n", F.lit(0))
    met = rare.join(counts, rare["rare"] == counts["word"], "left")
    sums = met.groupBy(key).agg(F.sum(F.col("rare_n") * F.log10(c + F.lit(ALPHA))).alias("more"), F.sum(F.when(c > 0, F.col("rare_n")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    all_base = F.lit(float(np.log10(lex.n + ALPHA * (lex.v + 1))))
    return rows.join(sums, key, "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(lex.n)).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * all_base).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(read(spark, sf_dir, "documents"))
