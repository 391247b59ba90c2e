"""The divergence audit against a plain count of every term, in whole numbers."""

import re
from collections import defaultdict

import numpy as np
import pytest

from clauseriver.llm import source_audit as A

DOCS = "doc_id long, text string, lang string, source string, value long, term string"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def expected(rows, least=3, top=200):
    counts, docs, groups = defaultdict(int), defaultdict(int), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        for t in found:
            counts[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        number = {s: [counts[lang, s, t] for t in kept] for s in sources}
        number[None] = [sum(number[s][i] for s in sources) for i in range(len(kept))]
        p = {s: [1 + 10**9 * (n + 1) // (sum(ns) + len(kept)) for n in ns] for s, ns in number.items()}
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s]
            terms = [(-((a - b) ** 2 // b), t.encode(), t) for n, a, b, t in zip(number[s], p[s], p[None], kept, strict=True) if n and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows, **settings):
    df = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], DOCS).repartition(3)
    got = A.audit(df, **({"top_terms": settings["top"]} if settings else {}))
    assert [f for f, _ in got.dtypes] == ["lang", "source", "part", "item", "value", "rank"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == expected(rows, **settings)
    return found


def test_odd_rows(spark):
    words = ["Éa", "éa", "a", "A", "b-c", "ß", "\x00z", "Ünder_score", "ünder", "日本", "x1y"]
    rows = [(" ".join(words[(i * k) % len(words)] for k in range(i % 9)), ["en", "de", None, ""][i % 4], ["s", None, "", "t", "日"][i % 5]) for i in range(120)]
    rows += [(None, "en", "nothing"), ("only once", "fr", "a"), ("", "fr", "b"), ("same same same", "one", "x"), ("same", "one", "x"), ("same", "one", "x")]
    rows += [("word " * 300_000 + "x" * 2_000_000, "en", "long"), ("xy " * 7, "en", "long")]
    found = check(spark, rows)
    assert ("fr", "a", "pair", "b", 0, 1) in found and not any(r[0] == "one" and r[2] == "pair" for r in found)
    check(spark, rows, top=2)


def test_empty(spark):
    assert A.audit(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("columns", [3, 16, 512])
def test_joint_values(columns):
    rng = np.random.default_rng(1)
    counts = np.minimum(rng.zipf(1.3, (300, 7)) - 1, 10**6).astype(np.int64)
    counts[:, 3] = 0
    totals = [int(x) for x in counts.sum(axis=0)]
    p = [[A.level_p(int(n), t, 300) for n in counts[:, g]] for g, t in enumerate(totals)]
    want = [[sum((a - b) ** 2 // b for a, b in zip(x, y, strict=True)) for y in p] for x in p]
    assert A.joint_values(counts, totals, 300, columns).tolist() == want


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 2)
    monkeypatch.setattr(A, "MOST_HELD", 5)
    check(spark, [(f"a b c w{i % 7} v{i % 3}", "en", f"s{i % 4}") for i in range(60)])
