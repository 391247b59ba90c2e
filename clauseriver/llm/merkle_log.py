"""Merkle manifest of a dataset as a postorder append log, with proofs read from it by address."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clauseriver.llm.common import joined_small, own_names, read, written

#: A builder hashes 2 ** BITS consecutive nodes, from a multiple of that number on.
BITS = 10
#: Characters of a record of the log: a digest in hex.
RECORD = 64


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def append_log(leaves: list[str], height: int) -> str:
    """The nodes of the tree over the leaves, in the order in which they are complete, RECORD characters each.

    A node is complete with its last child; those that lack leaves at the end are closed from the lowest up. `height`
    levels stand above the leaves, so the last record is the one node of the highest.
    """
    log, waiting = [], [None] * height
    for node in leaves:
        log.append(node)
        level = 0
        while level < height and waiting[level] is not None:
            node, waiting[level] = digest(waiting[level] + node), None
            log.append(node)
            level += 1
        if level < height:
            waiting[level] = node
    last = None
    for left in waiting:
        if left is not None or last is not None:
            last = digest((left or "") + (last or ""))
            log.append(last)
    return "".join(log)


def position(level: int, index: int, n: int) -> int:
    """The record of the index-th node of a level (leaves: level 0) in the log of a tree over n leaves.

    Before its last leaf, k, there are k // 2**l complete nodes on each level l, 2k - popcount(k) in all; the node
    follows that leaf and the `level` nodes that end with it below. Nodes that lack leaves stand after all of the
    2n - popcount(n) complete ones; there is one on every level that n isn't divisible by.
    """
    end = (index + 1) << level
    if end <= n:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    divisible = (n & -n).bit_length() - 1
    return 2 * n - n.bit_count() + level - divisible - 1


def siblings(log: str, slot: int, n: int, height: int) -> tuple[str, list[str]]:
    """The way up from a leaf: for each level L or R, as the sibling stands left or right, or - without one; and the siblings."""
    way, found = [], []
    for level in range(height):
        other = (slot >> level) ^ 1
        if other << level < n:
            at = RECORD * position(level, other, n)
            found.append(log[at : at + RECORD])
            way.append("L" if slot >> level & 1 else "R")
        else:
            way.append("-")
    return "".join(way), found


def levels(n: int, bits: int) -> int:
    """Levels above the nodes of a builder, of a tree's n nodes: all until one remains, `bits` at most."""
    return min(bits, (n - 1).bit_length())


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 over the fields: '-' for null, else the UTF-8 byte count, ':' and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def folded(leaf: Column, way: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof give."""
    start = F.struct(leaf.alias("node"), F.lit(1).alias("next"))

    def up(s: Column, side: Column) -> Column:
        other = F.get(siblings, s["next"] - 1)
        text = F.when(side == "L", F.concat(other, s["node"])).when(side == "R", F.concat(s["node"], other)).otherwise(s["node"])
        return F.struct(F.sha2(text.cast("binary"), 256).alias("node"), (s["next"] + (side != "-").cast("int")).alias("next"))

    sides = F.when(F.length(way) > 0, F.split(way, "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(sides, start, up, lambda s: s["node"])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) written in order, with `index`, the place in its tree from 0, and `n`, the tree's size.

    Ranges of the sorted rows, not trees, are the unit of work. Rows that tie in `order` are spread by their place in the
    input. A range is numbered as it is written; how many rows of a tree earlier ranges hold is a small table.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = ["tree", *order, "_tie"]
    numbered = written(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by_tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(by_tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by_tree).alias("n"))
    key = F.struct("tree", "_part")
    placed = joined_small(numbered.withColumn("_key", F.struct("tree", part.alias("_part"))), sizes.select(key.alias("_key"), "_shift", "n"), "_key")
    return placed.withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_key")


@dataclass(frozen=True)
class MerkleLog:
    """Trees over the members of each `tree`, in tiers: the builders' roots of one are the members of the next.

    members: tree, index, n, digest and other columns; segments: tree, block, n, log, root; block b of a tier starts at
    record b * (2 ** (bits + 1) - 1) of the tree's log of that tier, as every builder before it wrote a whole subtree.
    """

    tiers: list[tuple[DataFrame, DataFrame]]
    bits: int

    @property
    def roots(self) -> DataFrame:
        """tree, root."""
        done = [s.where(F.col("n") <= 1 << self.bits).select("tree", "root") for _, s in self.tiers]
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out


def build(members: DataFrame, bits: int = BITS) -> MerkleLog:
    """The log of the trees over members (tree, index, n, digest). Each tier has 2 ** bits times fewer rows than the last."""
    tiers = []
    while True:

        def segment(rows: pd.DataFrame) -> pd.DataFrame:
            rows, n = rows.sort_values("index"), int(rows["n"].iloc[0])
            log = append_log(list(rows["digest"]), levels(n, bits))
            return pd.DataFrame({"tree": rows["tree"].iloc[:1], "block": rows["block"].iloc[:1], "n": [n], "log": [log], "root": [log[-RECORD:]]})

        members = members.withColumn("block", F.shiftright("index", bits))
        slim = members.select("tree", "block", "index", "n", "digest")
        segments = written(slim.groupBy("tree", "block").applyInPandas(segment, "tree string, block long, n long, log string, root string"))
        tiers.append((members, segments))
        above = segments.where(F.col("n") > 1 << bits)
        if above.isEmpty():
            return MerkleLog(tiers, bits)
        size = F.shiftright(F.col("n") + ((1 << bits) - 1), bits)
        members = above.select("tree", F.col("block").alias("index"), size.alias("n"), F.col("root").alias("digest"))


def proofs(log: MerkleLog, above: DataFrame | None = None) -> DataFrame:
    """The members of the lowest tier with `way` and `siblings` up to the root; `above` (tree, way, siblings) goes on from there.

    Every task holds one builder's records and members; what lies above them is common to all of these.
    """
    bits, up = log.bits, None
    for members, segments in reversed(log.tiers):
        top = segments.where(F.col("n") <= 1 << bits)
        tops = top.withColumns({"way": F.lit(""), "siblings": F.array().cast("array<string>")}) if above is None else top.join(above, "tree")
        if up is not None:
            lower = segments.where(F.col("n") > 1 << bits).join(up.select("tree", F.col("index").alias("block"), "way", "siblings"), ["tree", "block"])
            tops = tops.unionByName(lower)
        plain = members.drop("way", "siblings")

        def extract(rows: pd.DataFrame, logs: pd.DataFrame) -> pd.DataFrame:
            s = logs.iloc[0]
            first, n, height = int(s["block"]) << bits, len(s["log"]), levels(int(s["n"]), bits)
            n = min(1 << bits, int(s["n"]) - first)
            ways, others = [], []
            rest = list(s["siblings"])
            for index in rows["index"]:
                way, found = siblings(s["log"], int(index) - first, n, height)
                ways.append(way + s["way"])
                others.append(found + rest)
            return rows.assign(way=ways, siblings=others)

        schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", way string, siblings array<string>"
        up = plain.groupBy("tree", "block").cogroup(tops.select("tree", "block", "n", "log", "way", "siblings").groupBy("tree", "block")).applyInPandas(extract, schema)
    return up


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """A leaf for each row of docs (doc_id, source, lang, n_chars, text) with its proof.

    Returns doc_id, lang, digest (the leaf), the columns of `extra`, subroot (of its lang's tree), root, way (per
    level up to the root: L, R or -) and siblings (from the leaf up; as many as way has letters).

    Nulls in any field are fields of their own ('-'); a null lang is a tree of its own and the first; a null doc_id comes
    first in its tree. Rows of one doc_id go by their leaf, and those that agree in all fields are leaves each, in any order. A lone
    leaf is its subroot, a lone subroot the root. Long texts are hashed whole, in the JVM. No documents, no rows.
    Columns of docs beyond the five take no part.
    """
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = written(docs.select(tree.alias("tree"), "doc_id", "lang", leaf_digest(*fields).alias("digest"), *[c.alias(k) for k, c in (extra or {}).items()]))
    log = build(ranked(leaves, ["doc_id", "digest"]), bits)
    names = log.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    whole = build(ranked(names, ["name"]), bits)
    above = proofs(whole).join(F.broadcast(whole.roots), "tree")  # one tree, hence one root
    above = written(above.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "way", "siblings"))
    found = proofs(log, above.drop("subroot", "root"))
    return joined_small(found, above.select("tree", "subroot", "root"), "tree").drop("tree", "index", "n", "block")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    shown = F.when(tampered, leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    rows = manifest(docs, {"shown": shown})
    root = folded(F.coalesce("shown", "digest"), F.col("way"), F.col("siblings"))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat_ws("", "siblings").cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_SHOWN = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF}) AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN sha256({_SHOWN}) ELSE sha256({_LEAF}) END AS shown
  FROM documents)
, r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d)
, nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS node FROM r
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n)
, subroots AS (SELECT tree, level AS height, node, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1)
, tops AS (
  SELECT 0 AS level, idx, n, node FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n)
, steps AS (
  SELECT r.doc_id, r.leaf, r.tree, r.idx AS slot, x.level, x.idx % 2 AS side, x.node FROM r JOIN nodes x ON x.tree = r.tree AND x.idx = xor(r.idx >> x.level, 1) AND x.n > 1
  UNION ALL
  SELECT r.doc_id, r.leaf, r.tree, r.idx, s.height + x.level, x.idx % 2, x.node FROM r JOIN subroots s ON s.tree = r.tree JOIN tops x ON x.idx = xor(s.idx >> x.level, 1) AND x.n > 1)
, paths AS (SELECT tree, slot, sha256(string_agg(node, '' ORDER BY level)) AS proof FROM steps GROUP BY tree, slot)
, fold AS (
  SELECT r.tree, r.idx AS slot, 0 AS level, s.height + (SELECT max(level) FROM tops) AS height, r.shown AS node FROM r JOIN subroots s ON s.tree = r.tree
  UNION ALL
  SELECT f.tree, f.slot, f.level + 1, f.height, sha256(CASE WHEN t.side = 0 THEN t.node ELSE '' END || f.node || CASE WHEN t.side = 1 THEN t.node ELSE '' END)
  FROM fold f LEFT JOIN steps t ON t.tree = f.tree AND t.slot = f.slot AND t.level = f.level WHERE f.level < f.height)
SELECT r.doc_id, r.leaf, s.node AS subroot, t.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM r JOIN subroots s ON s.tree = r.tree JOIN tops t ON t.n = 1 JOIN fold f ON f.tree = r.tree AND f.slot = r.idx AND f.level = f.height
LEFT JOIN paths p ON p.tree = r.tree AND p.slot = r.idx
"""
