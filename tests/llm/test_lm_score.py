"""The language model: counts against a plain count, probabilities that add up to 1, held-out texts better than by counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from clauseriver.llm import lm_score as L

DOCS = "doc_id long, text string, word string, n long, score double"


def tokens(text):
    return ("".join(c.lower() if c.isascii() else c for c in text or "")).encode().split() + [L.END]


def language(rng, n):
    """Texts in which a word mostly tells the next."""
    words = [[f"{p}{i}" for i in range(30)] for p in ("Ka", "lo", "mé")]
    out = []
    for i in range(n):
        own, at, text = words[i % 3], rng.randrange(30), []
        for _ in range(rng.randrange(3, 60)):
            at = (at * 7 + 1) % 30 if rng.random() < 0.8 else rng.randrange(30)
            text.append(own[at] if rng.random() < 0.95 else f"x{rng.randrange(500)}{own[0][-1]}")
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    texts = language(rng, 600) + [None, "", " \n\t", "Ka1\x0bKA1\x1cka1 É é", "unknown-word " * 50, "Ka1 " * 400_000]
    rows = [(i, t, "w", 1, 0.5) for i, t in enumerate(texts)] + [(None, "lo1 lo2", "w", 1, 0.5), (3, texts[3], "w", 1, 0.5)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return rows, L.score_corpus(df, words=40, endings=5, held=60).collect()


def test_counts(scored):
    rows, got = scored
    held_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(t for i, text, *_ in rows if not held_out(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = []
    for i, text, *_ in rows:
        ts = tokens(text)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        want.append((str(i), held_out(i), len(ts), sum(c[t] > 0 for t in ts), n, round(base, 3)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == sorted(want)


def test_beats_counts(scored):
    _, got = scored
    held = [r for r in got if r["held_out"] and 1 < r["n_tokens"] < 100]
    per_token = lambda k: sum(r[k] for r in held) / sum(r["n_tokens"] for r in held)
    assert len(held) > 30 and per_token("score") > per_token("base_score") + 0.1
    assert all(r["score"] < 0 for r in got)


def test_probabilities_add_up(spark):
    texts = language(random.Random(5), 60)
    c = Counter(t for text in texts for t in tokens(text))
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in c.items()], "word binary, n long")
    lex = L.lexicon(counts, words=20, endings=4, held=50)
    assert (lex.n, lex.v, len(lex.counts) <= 50, len(lex.tokens)) == (sum(c.values()), len(c), True, 1 + 20 + 4)
    model = L.LogBilinear.start(lex.tokens)
    model.r += np.random.default_rng(0).normal(0, 2, model.r.shape).astype(np.float32)
    near, far, norm = model.tables()
    for a, b in ((0, 0), (3, 7), (24, 1)):
        p = np.exp(near[b].astype(float) + far[a] - norm[a, b])
        assert abs(p.sum() - 1) < 1e-4
        share = 10.0 ** -lex.class_base()
        by_word = sum(p[u := lex.units[w]] * ((n + 0.1) * share[u] if u >= lex.first_class else 1) for w, n in c.items() if w != L.END)
        unknown = sum(p[u] * 0.1 * share[u] for u in range(lex.first_class, len(p)))
        assert abs(by_word + unknown + p[0] - 1) < 1e-4


def test_same_model_again(spark):
    docs = spark.createDataFrame([(t,) for t in language(random.Random(1), 90)], "text string")
    counts = docs.mapInArrow(L.count_words, "word binary, n long").groupBy("word").agg(L.F.sum("n").alias("n"))
    lex = L.lexicon(counts, words=30)
    one, two = (L.train(docs, lex, rounds=2).flat() for _ in range(2))
    assert np.allclose(one, two) and not np.allclose(one, L.LogBilinear.start(lex.tokens).flat())


def test_nothing_to_learn(spark):
    assert L.score_corpus(spark.createDataFrame([], DOCS)).count() == 0
    held_out = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = L.score_corpus(spark.createDataFrame([(held_out, "a b", "w", 1, 0.5)], DOCS)).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert abs(row["score"] - 3 * math.log10(0.5)) < 0.05
