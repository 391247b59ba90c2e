"""The Merkle log against trees built level by level, and its proofs on odd tables."""

import hashlib

import pytest

from clauseriver.llm import merkle_log as M

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, `index` long"


def levels_of(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([M.digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


@pytest.mark.parametrize("n", [*range(1, 70), 127, 128, 129, 1000])
def test_log_positions(n):
    leaves = [M.digest(str(i)) for i in range(n)]
    want, height = levels_of(leaves), M.levels(n, 20)
    log = M.append_log(leaves, height)
    seen = set()
    for level, nodes in enumerate(want):
        for i, node in enumerate(nodes):
            at = M.position(level, i, n)
            assert log[at * M.RECORD : (at + 1) * M.RECORD] == node
            seen.add(at)
    assert len(log) == M.RECORD * len(seen) and log[-M.RECORD :] == want[-1][0]


def test_unfinished_builder_is_closed_to_its_height():
    leaves = [M.digest(str(i)) for i in range(3)]
    log = M.append_log(leaves, 4)
    root = M.digest(M.digest(M.digest(M.digest(leaves[0] + leaves[1]) + M.digest(leaves[2]))))
    assert log[-M.RECORD :] == root
    at = M.position(4, 0, 3) * M.RECORD
    assert log[at : at + M.RECORD] == root


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def expected(rows):
    """doc row -> (leaf, subroot, root, proof) by plain trees."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, hashlib.sha256(encoded(*r[:5]).encode()).hexdigest()))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([leaf for *_, leaf in sorted(by_lang[x])]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])

    def way(tree, i):
        return [level[(i >> k) ^ 1] for k, level in enumerate(tree[:-1]) if (i >> k) ^ 1 < len(level)]

    out = []
    for k, x in enumerate(langs):
        for i, (known, doc_id, leaf) in enumerate(sorted(by_lang[x])):
            out.append((doc_id if known else None, leaf, trees[x][-1][0], top[-1][0], tuple(way(trees[x], i) + way(top, k))))
    return out


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits):
    rows = [(i, f"s{i % 3}", ["en", "de", "é", None, ""][i % 5 if i % 4 else 0], i if i % 6 else None, f"text {i}" * (i % 7), "x", i) for i in range(90)]
    rows += [(None, None, None, None, None, "x", 1), (7, "s", "one", 3, "abc", "x", 2), (5, None, "en", 1, "tie", "x", 1), (5, None, "en", 1, "tie", "x", 1), (6, "x", "de", 2, "y" * 1_000_000, "x", 3)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = M.manifest(df, bits=bits).withColumn("up", M.folded(M.F.col("digest"), M.F.col("way"), M.F.col("siblings"))).collect()
    assert all(r["up"] == r["root"] for r in got)
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2:])
    assert sorted([(r["doc_id"], r["digest"], r["subroot"], r["root"], tuple(r["siblings"])) for r in got], key=key) == sorted(expected(rows), key=key)


def test_small_and_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert M.manifest(none).count() == 0
    (one,) = M.manifest(spark.createDataFrame([(1, None, None, None, None, "x", 1)], DOCS)).collect()
    assert one["digest"] == one["subroot"] == one["root"] and one["siblings"] == [] and one["way"] == ""


def test_tampering_shows(spark):
    rows = [(i, "s", "en", 10, "t", "x", i) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    wrong = M.leaf_digest(*[M.F.col(c) + 1 if c == "n_chars" else M.F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    got = M.manifest(df, {"wrong": wrong}).select((M.folded(M.F.col("wrong"), M.F.col("way"), M.F.col("siblings")) != M.F.col("root")).alias("x")).collect()
    assert all(r["x"] for r in got)
