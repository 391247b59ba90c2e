"""MinHash near-dedup: BagMinHash signatures of shingle multisets, banded, then verified exactly."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import WORD, cut, own_names, read, small_batches
from clauseriver.llm.substring_dedup import WordHashes, mixed

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares none of 25 bands of 5 with probability 0.00005.
BANDS, ROWS = 25, 5
_word = re.compile(WORD)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(float) + 1) * 2.0**-53


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; one of all words if there are fewer."""
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * _GOLD + words[k : len(words) - size + 1 + k]
    return mixed(out)


def bag_minhash(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures (docs x m, 64-bit) of weighted sets given as rows doc, feature, weight.

    Weights are discretised to whole numbers, and [0, w) is cut at the powers of two. Each feature has a
    Poisson process of its own on each of these intervals: points in time at a rate of m times the
    interval's width, each with a signature component and a level within the interval. A document sees
    the points whose level is below its weight, and keeps the first point of each component. As equal
    features bring the same points, two documents agree on a component with the probability of their
    weighted Jaccard similarity. Points come in order of time, so a process ends once it is past the
    last component's time; a large weight costs its logarithm, not its size.
    """
    times = np.full(docs * m, np.inf)
    marks = np.zeros(docs * m, np.uint64)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(int) + 1  # intervals that begin below the weight
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1, low)
    state = mixed(feature[row] + (level + 1).astype(np.uint64) * _GOLD)
    owner, limit = doc[row], weight[row]
    now = -np.log(uniform(state)) / (m * width)
    last = np.full(docs, np.inf)
    while len(now):
        alive = now < last[owner]
        state, owner, limit, low, width, now = (x[alive] for x in (state, owner, limit, low, width, now))
        mark = mixed(state + _GOLD)
        seen = low + np.floor(uniform(mixed(mark + _GOLD)) * width * (1 - 2**-40)) < limit
        slot = owner[seen] * m + (mark[seen] % np.uint64(m)).astype(np.int64)
        np.minimum.at(times, slot, now[seen])
        won = times[slot] == now[seen]
        marks[slot[won]] = mark[seen][won]
        last = times.reshape(docs, m).max(axis=1)
        state = mixed(mark ^ np.uint64(0x5851F42D4C957F2D))
        now = now - np.log(uniform(state)) / (m * width)
    return marks.reshape(docs, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each document and band; the band's number takes part."""
    keys = np.tile(mixed(np.arange(bands, dtype=np.uint64) + _GOLD), (len(signatures), 1))
    for r in range(rows):
        keys = mixed(keys * _GOLD + signatures[:, r::rows][:, :bands])
    return keys.view(np.int64)


SIGNED = "d1 long, d2 long, keys array<long>, odd array<long>, weight long"
#: Bits of a text's parities, in numbers of 64.
PARITIES = 1024
#: Shingles that are signed together, at most (one text may hold more); bounds the memory of a task whatever the texts' lengths.
AT_ONCE = 100_000


def features(h: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a text (given the hashes of its words), with their number."""
    return np.unique(shingle_hashes(h, shingle), return_counts=True)


def parities(feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each of PARITIES places, whether an odd number of a text's shingles falls there.

    A shingle more or less turns one of them, so two texts differ by at least as many shingles as places.
    """
    odd = np.bincount((feature >> np.uint64(33)).astype(np.int64) % PARITIES, weight, PARITIES).astype(np.int64) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def by_words(texts: Iterable[str], hashes: WordHashes, most: int = AT_ONCE) -> Iterator[list[np.ndarray]]:
    """Hashes of the words of each text, in lists of at most `most` words (or one text)."""
    out, held = [], 0
    for text in texts:
        h = hashes.of(_word.findall(text))
        if out and held + len(h) > most:
            yield out
            out, held = [], 0
        out.append(h)
        held += len(h)
    if out:
        yield out


def sign_texts(batches: Iterator[pd.Series], shingle: int, bands: int, rows: int) -> Iterator[pd.DataFrame]:
    """Digest of the words, band keys, parities and number of shingles of each text; every text has a word."""
    hashes = WordHashes()
    for batch in batches:
        out = []
        for words in by_words(batch, hashes):
            bags = [features(h, shingle) for h in words]
            owner = np.repeat(np.arange(len(bags)), [len(f) for f, _ in bags])
            feature, weight = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
            signatures = bag_minhash(owner, feature, weight.astype(float), len(bags), bands * rows)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h) for h in words), "<i8").reshape(-1, 2)
            out.append(pd.DataFrame({
                "d1": digests[:, 0], "d2": digests[:, 1], "keys": list(band_keys(signatures, bands, rows)),
                "odd": [parities(f, w) for f, w in bags], "weight": [int(w.sum()) for _, w in bags],
            }))
        yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[x.split()[0] for x in SIGNED.split(", ")])


def shingle_rows(batches: Iterator[pd.DataFrame], shingle: int) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        at = 0
        for words in by_words(batch["text"], hashes):
            bags = [features(h, shingle) for h in words]
            yield pd.DataFrame({
                "node": np.repeat(batch["node"].to_numpy()[at : at + len(bags)], [len(f) for f, _ in bags]),
                "shingle": np.concatenate([f for f, _ in bags]).view(np.int64),
                "weight": np.concatenate([w for _, w in bags]),
            })
            at += len(bags)


def bag_similarity(left: str, right: str, shingle: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the multisets of shingles, exactly."""

    def bag(text: str) -> Counter:
        words = _word.findall(text)
        size = min(shingle, len(words)) or 1
        return Counter(zip(*(words[k:] for k in range(size)), strict=False))

    a, b = bag(left), bag(right)
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if a or b else 0.0


def similarities(left: pd.Series, right: pd.Series, shingle: int) -> pd.Series:
    return pd.Series([bag_similarity(x, y, shingle) for x, y in zip(left, right, strict=True)], dtype=float)


def components(pairs: DataFrame) -> DataFrame:
    """node, label of every node in pairs (x, y): the least node of its connected component.

    Each round, labels hop to the least label around and then to that label's own label, so the rounds
    grow with the logarithm of the longest chain; each is cut into the shared checkpoint folder.
    """
    edges = cut(pairs.select("x", "y").union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(edges.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).withColumnRenamed("x", "node"))
    while True:
        around = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        hop = labels.join(around, F.col("node") == F.col("x")).select("node", F.least("label", "near").alias("hop"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("hop"), F.col("label").alias("next"))
        new = hop.join(jump, "hop", "left").select("node", F.least("hop", "next").alias("label"), "old")
        new = cut(new)
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels


def scored(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (x, y) of nodes with the similarity of their texts."""

    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return similarities(left, right, shingle)

    left = texts.select(F.col("node").alias("x"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("y"), F.col("text").alias("right"))
    rows = pairs.join(left, "x").join(right, "y")
    return rows.select("x", "y", F.pandas_udf(score, "double")("left", "right").alias("similarity"))


def own_weights(texts: DataFrame, shingle: int) -> DataFrame:
    """node, own: the weight of the shingles that no other of the texts has."""
    rows = texts.select("node", "text").mapInPandas(lambda it: shingle_rows(it, shingle), "node long, shingle long, weight long")
    once = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("high"), F.sum("weight").alias("weight"))
    return once.where("node = high").groupBy("node").agg(F.sum("weight").alias("own"))


#: Nodes of one band that meet those of another such part in one task.
PART = 1000


def least_difference(left: str, right: str) -> Column:
    """At least so many shingles are in one of two texts only, by their parities."""
    return sum((F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))


def open_pairs(rows: DataFrame, similarity: float, part: int = PART) -> DataFrame:
    """Pairs (x, y) of nodes that share a band, are in different components and may be similar enough.

    rows: band, node, label, away (distance to the band's first node), weight, own, keys, odd. Left out is
    only what cannot be similar: shingles of one's own bound the overlap, and so does the number of
    shingles that are in one of both alone; distances (a metric) to a third node differ by no more than the
    distance of the two. A pair comes from the least band that it shares. A band of many nodes is cut into
    parts of about `part` nodes, and each two of them meet under a key of their own.
    """
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = rows.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left, right = dealt.withColumn("other", every), dealt.withColumnRenamed("part", "other").withColumn("part", every)
    both = F.least(F.col("l.weight") - F.col("l.own"), F.col("r.weight") - F.col("r.own"))
    weights = F.col("l.weight") + F.col("r.weight")
    may = (
        (F.col("l.node") < F.col("r.node"))
        & (F.col("l.label") != F.col("r.label"))
        & (both >= similarity * (weights - both) - 1e-9)
        & (F.abs(F.col("l.away") - F.col("r.away")) <= 1 - similarity + 1e-9)
        & (least_difference("l.odd", "r.odd") <= (1 - similarity) / (1 + similarity) * weights + 1e-9)
        & (F.array_min(F.array_intersect(F.col("l.keys"), F.col("r.keys"))) == F.col("l.band"))
    )
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("band", "part", "other")]
    joined = left.alias("l").join(right.alias("r"), same[0] & same[1] & same[2] & may)
    return joined.select(F.col("l.node").alias("x"), F.col("r.node").alias("y"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near-duplicates among docs (doc_id, text, _t1, _t2), where _t1 and _t2 are a digest of the text and
    every text has a word: _t1, _t2, class_id, first (doc_id, _t1, _t2), a row for each different text.

    Two texts are near-duplicates if the weighted Jaccard similarity of their multisets of shingles is
    at least `similarity`; classes are the connected components of that relation. class_id is the least
    doc_id in the class, and first is the document that has it.

    Texts of the same words fold into one node first. The nodes' band keys deal them into buckets. In
    each, every node is compared with the bucket's oldest one; then, with components at hand, nodes of a
    bucket that are in different components are compared with each other, but for pairs that can't be
    similar enough (open_pairs). So a comparison is left out only where both nodes are in one component
    already or where bounds rule it out.
    """

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from sign_texts(batches, shingle, bands, rows)

    small_batches(docs.sparkSession)
    signed = docs.select("doc_id", "_t1", "_t2", F.pandas_udf(sign, SIGNED)("text").alias("s"))
    signed = cut(signed.select("doc_id", "_t1", "_t2", "s.*"))
    first = F.min(F.struct("doc_id", "_t1", "_t2")).alias("first")
    nodes = signed.groupBy("d1", "d2").agg(first, F.any_value(F.struct("keys", "odd", "weight")).alias("s"))
    nodes = cut(nodes.select("d1", "d2", "first", "s.*", F.monotonically_increasing_id().alias("node")))
    banded = nodes.select("node", "first.doc_id", F.explode("keys").alias("band"))
    oldest = F.min(F.struct("doc_id", "node"))["node"].alias("x")  # the likeliest original of a group of copies
    buckets = banded.groupBy("band").agg(oldest, F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = cut(banded.select("node", "band").join(buckets.select("band", "x"), "band"))

    involved = nodes.join(shared.select("node").distinct(), "node").select("node", "first.*")
    texts = cut(docs.join(involved, ["doc_id", "_t1", "_t2"]).select("node", "text").dropDuplicates(["node"]))
    stars = shared.where("node <> x").select("x", F.col("node").alias("y")).distinct()
    stars = cut(scored(stars, texts, shingle))
    links = stars.where(F.col("similarity") >= similarity).select("x", "y")
    labels = components(links)

    named = shared.join(labels, "node", "left").select("band", "node", "x", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    away = stars.select("x", F.col("y").alias("node"), (1 - F.col("similarity")).alias("away"))
    apart = cut(named.join(several.select("band"), "band").join(away, ["x", "node"], "left").select("band", "node", "label", F.coalesce("away", F.lit(0.0)).alias("away")))
    lone = apart.select("node").distinct()
    facts = nodes.join(lone, "node").select("node", "weight", "keys", "odd")
    for _ in range(2):  # nodes that can have no partner go; without them more shingles have one owner
        own = own_weights(texts.join(facts.select("node"), "node"), shingle)
        facts = facts.drop("own").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        facts = cut(facts.where(F.col("own") <= (1 - similarity) * F.col("weight") + 1e-9))
    rest = cut(open_pairs(apart.join(facts, "node"), similarity))
    if not rest.isEmpty():
        more = cut(scored(rest, texts, shingle).where(F.col("similarity") >= similarity).select("x", "y"))
        if not more.isEmpty():
            labels = merged(labels, more)

    found = nodes.join(labels, "node", "left").select("d1", "d2", "first", F.coalesce("label", "node").alias("label"))
    least = found.groupBy("label").agg(F.min("first").alias("least"))
    found = found.join(least, "label").select("d1", "d2", F.col("least.doc_id").alias("class_id"), F.col("least").alias("first"))
    return signed.select("_t1", "_t2", "d1", "d2").distinct().join(found, ["d1", "d2"]).drop("d1", "d2")


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """labels (node, label) after pairs (x, y) of nodes join components: only the components meet in rounds."""
    named = pairs
    for side in ("x", "y"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        named = named.join(own, side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    joined = components(named.select(F.col("label_x").alias("x"), F.col("label_y").alias("y")).where("x <> y").distinct())
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    renamed = labels.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    # components of one node have no row in labels yet
    single = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti")
    return cut(renamed.union(single.select(F.col("label").alias("node"), F.col("new").alias("label"))))


def classified(docs: DataFrame, **settings) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs in two parts, those that may have copies and the rest; the first one with four more columns, whose
    names are returned: class id, whether the row is the class's first document, and a digest of the text."""
    names = own_names(docs, "_class_id", "_is_first", "_t1", "_t2", "_first")
    class_id, is_first, t1, t2, first = names
    rows = docs.withColumn(t1, F.xxhash64("text")).withColumn(t2, F.xxhash64(F.lit(71), "text"))
    known = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(WORD), F.lit(False))
    slim = rows.where(known).select("doc_id", "text", F.col(t1).alias("_t1"), F.col(t2).alias("_t2"))
    found = near_duplicates(slim, **settings)
    found = found.select(F.col("_t1").alias(t1), F.col("_t2").alias(t2), F.col("class_id").alias(class_id), F.col("first").alias(first))
    own = F.struct(F.col("doc_id"), F.col(t1).alias("_t1"), F.col(t2).alias("_t2"))
    joined = rows.where(known).join(found, [t1, t2]).withColumn(is_first, own == F.col(first)).drop(first)
    return joined, docs.where(~known), names[:4]


def classes(docs: DataFrame, **settings) -> DataFrame:
    """docs (doc_id, text, ...) with _class_id and _is_first (with more underscores if docs has such columns).

    _class_id is the least doc_id of the row's class of near-duplicates; _is_first marks the document of
    that doc_id, which is the one to keep. Texts that are null or have no word, and rows without a
    doc_id, are no one's copy: they are a class of their own and stay. Rows that share doc_id and text
    are one document and are marked alike; of two texts with the class's least doc_id, that of the lesser
    digest is first. Texts of fewer words than a shingle are one shingle; long texts are signed one at a
    time, whole. An empty table gives an empty result.
    """
    joined, rest, (class_id, is_first, t1, t2) = classified(docs, **settings)
    rest = rest.withColumn(class_id, F.col("doc_id")).withColumn(is_first, F.lit(True))
    return joined.drop(t1, t2).unionByName(rest)


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each class of near-duplicates, and all rows that are no one's copy (see classes)."""
    joined, rest, (_, is_first, t1, t2) = classified(docs, **settings)
    kept = joined.where(F.col(is_first)).dropDuplicates(["doc_id", t1, t2])
    return kept.select(*[kept[c] for c in docs.columns]).unionByName(rest)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_class_id").alias("class_id"), F.col("_is_first").alias("is_first"))
