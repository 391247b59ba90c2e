"""Substring dedup: windows of words that repeat across documents, found by super-k-mers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import WORD, cut, read, small_batches, written

WINDOW = 50
#: Words in the grams among which a window's minimiser is sought.
GRAM = 5
#: Windows of the distinct packed strings of one bucket that are sorted in one task; those of larger buckets meet one by one.
MOST = 50_000
_word = re.compile(WORD)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    """Word -> 64-bit hash; holds at most 100,000 words, so that workers stay small."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def super_kmers(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one document with the same minimiser: it, first window, windows."""
    n = len(hashes) - window + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * _MIX[0] + hashes[k : len(hashes) - gram + 1 + k]
    least, width, wide = mixed(grams), 1, window - gram + 1
    while width < wide:  # least[i] is the minimum over `width` grams from i on
        step = min(width, wide - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[starts].view(np.int64), starts, np.diff(np.append(starts, n))


KMERS = "bucket long, k long, a long, start int, n int, digest_a long, digest_b long"


def find_kmers(batches: Iterator[pd.DataFrame], window: int, gram: int, at_once: int = 100_000) -> Iterator[pd.DataFrame]:
    """The super-k-mers of each document (text, k, a): their buckets, place and the digest of their words."""
    hashes = WordHashes()
    names = [x.split()[0] for x in KMERS.split(", ")]
    for batch in batches:
        parts, held = [], 0
        for text, k, a in batch.itertuples(index=False):
            words = _word.findall(text)
            if len(words) < window:
                continue
            h = hashes.of(words)
            buckets, starts, n = super_kmers(h, window, gram)
            raw = memoryview(h).cast("B")
            ends = starts + n + window - 1
            digests = b"".join(xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True))
            same = np.broadcast_to(np.array([[k], [a]], np.int64), (2, len(n)))
            parts.append(np.vstack([buckets, same, starts, n, np.frombuffer(digests, "<i8").reshape(-1, 2).T]))
            held += len(n)
            if held >= at_once:
                yield pd.DataFrame(np.hstack(parts).T, columns=names)
                parts, held = [], 0
        if parts:
            yield pd.DataFrame(np.hstack(parts).T, columns=names)


#: Either a packed string of words, or the digest of one window with its places in the string.
PIECES = "bucket long, digest_a long, digest_b long, first long, packed string, window_a long, window_b long, places array<int>"


def cut_out(batches: Iterator[pd.DataFrame], window: int, at_once: int = 20_000) -> Iterator[pd.DataFrame]:
    """The words of each super-k-mer in `needed` (of rows k, text, needed): packed, or window by window where its bucket is large."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        for c in ("window_a", "window_b"):
            out[c] = out[c].astype("Int64")
        rows.clear()
        return out

    rows: list[tuple] = []
    for batch in batches:
        for k, text, needed in batch.itertuples(index=False):
            words = _word.findall(text)
            for x in needed:
                key, start = (x["bucket"], x["digest_a"], x["digest_b"], k), x["start"]
                if not x["large"]:
                    rows.append((*key, " ".join(words[start : start + x["n"] + window - 1]), None, None, None))
                else:  # a window that repeats within the string is one row
                    seen: dict[bytes, list[int]] = {}
                    for i in range(x["n"]):
                        seen.setdefault(xxhash.xxh3_128_digest(" ".join(words[start + i : start + i + window])), []).append(i)
                    for digest, at in seen.items():
                        rows.append((*key, None, *np.frombuffer(digest, "<i8").tolist(), at))
                        if len(rows) >= 5 * at_once:
                            yield frame()
            if len(rows) >= at_once:
                yield frame()
    if rows:
        yield frame()


RUNS = "bucket long, digest_a long, digest_b long, first long, lo int, hi int"


def sort_buckets(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket. Of each bucket's distinct strings: the runs of windows (words
    lo to hi of the string) that also start in a document smaller than the string's first one."""
    names = [x.split()[0] for x in RUNS.split(", ")]

    def rows():
        for batch in batches:
            yield from batch.itertuples(index=False)

    out = []
    for _, group in groupby(rows(), key=lambda r: r.bucket):
        group = list(group)
        if all(r.first == group[0].first for r in group):
            continue
        windows = []  # text, first document, string, place
        for k, r in enumerate(group):
            words = r.packed.split(" ")
            for i in range(len(words) - window + 1):
                windows.append((" ".join(words[i : i + window]), r.first, k, i))
        windows.sort()
        covered: dict[int, list[int]] = {}
        for _, same in groupby(windows, key=lambda w: w[0]):
            same = list(same)
            for _, first, k, i in same:
                if first > same[0][1]:
                    covered.setdefault(k, []).append(i)
        for k, places in covered.items():
            r, places = group[k], sorted(set(places))
            cuts = [0, *(j for j in range(1, len(places)) if places[j] > places[j - 1] + 1), len(places)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                out.append((r.bucket, r.digest_a, r.digest_b, r.first, places[x], places[y - 1] + window))
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=names)
            out = []
    if out:
        yield pd.DataFrame(out, columns=names)


def keep_words(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Each text's words that no span (lo, hi) covers, joined by one space; how many words, how many removed."""
    rows = []
    for text, cover in zip(texts, spans, strict=True):
        words = _word.findall(text)
        n = len(words)
        if cover is not None and len(cover):
            gone = np.zeros(n + 1, np.int64)
            for s in cover:
                gone[s["lo"]] += 1
                gone[s["hi"]] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
        rows.append((" ".join(words), n, n - len(words)))
    return pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """k, a, spans: the words to remove in rows of docs (text, k, a; k the doc_id, a a digest of the row).

    1. Each document's windows are cut into super-k-mers: runs of windows that share their minimiser,
       the least hash of their grams. Equal windows share it, so a bucket (a minimiser) that occurs in
       one document only holds no repeat, and no text of it travels. The texts are read once for this; what
       is found is written to the shared folder.
    2. Equal super-k-mers (by a 128-bit digest of the 64-bit hashes of their words, which is trusted) fold into
       the one in the smallest document; any other document that holds it loses all of it.
    3. Where a bucket has several different super-k-mers, one of each travels as a packed string to its
       bucket. There their windows are sorted, so that equal windows meet, and those that a smaller
       document holds too go from the string's own document. No string of a bucket with more than `most`
       windows travels: there each window's 128-bit digest does, and the least document of each digest is found
       by an aggregation, so that no task holds a bucket, nor all windows of a long monotonous text.
    """
    kmers = written(docs.mapInPandas(partial(find_kmers, window=window, gram=gram), KMERS))
    shared = kmers.groupBy("bucket").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high")
    places = cut(kmers.join(shared.select("bucket"), "bucket"))

    same = ["bucket", "digest_a", "digest_b"]
    firsts = places.groupBy(*same).agg(F.min(F.struct("k", "a", "start", "n")).alias("f")).select(*same, "f.*")
    several = firsts.groupBy("bucket").agg(F.count("*").alias("count"), (F.sum("n") > most).alias("large")).where("count > 1")
    needed = firsts.join(several.select("bucket", "large"), "bucket").groupBy("k", "a").agg(F.collect_list(F.struct("start", "n", "large", *same)).alias("needed"))
    pieces = written(docs.join(needed, ["k", "a"]).select("k", "text", "needed").mapInPandas(partial(cut_out, window=window), PIECES))
    packed = pieces.where("packed IS NOT NULL").select(*same, "first", "packed").repartition("bucket").sortWithinPartitions("bucket")
    runs = packed.mapInPandas(partial(sort_buckets, window=window), RUNS)
    windows, key = pieces.where("packed IS NULL"), ["window_a", "window_b"]
    least = windows.groupBy(*key).agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high")
    later = windows.join(least, key).where("first > low").groupBy(*same, "first").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("at"))
    begins = F.expr("filter(at, (x, i) -> i = 0 OR x > at[i - 1] + 1)")
    ends = F.expr("filter(at, (x, i) -> i = size(at) - 1 OR at[i + 1] > x + 1)")
    later = later.select(*same, "first", F.explode(F.arrays_zip(begins.alias("lo"), ends.alias("hi"))).alias("r"))
    runs = runs.unionByName(later.select(*same, "first", "r.lo", (F.col("r.hi") + window).alias("hi")))

    whole = places.join(firsts.select(*same, F.col("k").alias("first")), same).where("k > first")
    part = places.join(runs, same).where("k = first")
    spans = whole.select("k", "a", F.col("start").alias("lo"), (F.col("start") + F.col("n") + window - 1).alias("hi")).union(
        part.select("k", "a", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    )
    return spans.groupBy("k", "a").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, kept, n_words, n_removed of every row of docs (doc_id, text).

    Removed are the words in windows (of `window` consecutive words of one document) whose word sequence
    also starts in a document with a smaller doc_id, as judged on the input. kept is what is left,
    joined by single spaces. Texts of fewer words than a window lose nothing, null texts have no words.
    Rows with a null doc_id lose nothing and take nothing from others; rows of the same doc_id don't
    take from each other. Rows that repeat each keep their row. Very long texts are taken whole. An empty table gives
    an empty result; other columns of docs are dropped, whatever their names.
    """
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("k"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("a"))
    spans = repeated_spans(keyed.where("k IS NOT NULL").select("text", "k", "a"), window, gram, most)
    kept = F.pandas_udf(keep_words, "kept string, n_words long, n_removed long")("text", "spans")
    return keyed.join(spans, ["k", "a"], "left").select(F.col("k").alias("doc_id"), kept.alias("_k")).select("doc_id", "_k.*")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
