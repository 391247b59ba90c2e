"""Packing token pieces into fixed-length sequences: shortest pack first over the length histogram."""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import hex_slot, read, small_batches, sums_before, written

LENGTH = 1024
VOCABULARY = "byte_bpe_50k"
#: Most slots that are broadcast; their number depends on the sequence length, not on the data.
MOST_SLOTS = 500_000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PUNCTUATION = "!-&(-/:-@\\[-`{-~"  # ASCII's, but for the apostrophe, which may begin a suffix such as 's
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: The vocabulary's own splitting never joins characters across these chunks: letters after at most one white space,
#: if nothing but punctuation stands between them and the next white space; a run of white space but for its last
#: character; or a run of other characters with at most one white space before it.
_spaces = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_SPACE}]", chr(c)))
_chunk = re.compile(
    f"[{_SPACE}]?[{_LETTERS}]++(?=[{_PUNCTUATION}]*+(?![^{_SPACE}]))|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+"
)


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder(dict):
    """Chunk of text -> its ids as little-endian bytes; holds at most `most` chunks.

    A text is cut at the vocabulary's added tokens (such as <|endoftext|>), whose ids stand for them, and then
    into chunks. The ids of chunks are those of the tokenizers library. Chunks come in two generations: when
    half of `most` are held, they become the old ones, of which those met again come back, and the others go.
    """

    def __init__(self, vocabulary: str, most: int = 600_000, long: int = 400, at_once: int = 200):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {t: as_bytes([i]) for t, i in added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.most, self.long, self.at_once = most, long, at_once
        self.old: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=False)
        self.widths = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)])  # bytes of each id

    def learn(self, chunks: set[str]) -> None:
        """Takes in the ids of those of the chunks, none of them held, that begin with one white space, many in a call.

        Such chunks are told apart wherever they stand, so they are encoded end to end, and their ids are parted by
        the number of their bytes. Chunks among the old ones come back from there.
        """
        back = self.old.keys() & chunks
        self.keep([(c, self.old[c]) for c in back])
        new = [c for c in chunks - back if 1 < len(c) <= self.long and c[0] in _spaces and c[-1] not in _spaces]
        for at in range(0, len(new), self.at_once):
            part = new[at : at + self.at_once]
            ids = np.array(self.tokenizer.encode("".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.cumsum(self.widths[ids])
            wanted = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in part])
            cuts = np.searchsorted(ends, wanted)
            if (ends[cuts] != wanted).any():
                raise ValueError("a chunk shares an id with the next one")
            whole, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
            self.keep([(c, whole[i:j]) for c, i, j in zip(part, [0, *stops], stops, strict=False)])

    def keep(self, chunks: list[tuple[str, bytes]]) -> None:
        if len(self) + len(chunks) > self.most // 2:
            self.old = dict(self)
            self.clear()
        self.update(chunks)

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what none of them has shown before is encoded together."""
        chunks = list(map(_chunk.findall, texts))
        found = [list(map(self.get, c)) for c in chunks]
        gaps = [[i for i, x in enumerate(f) if x is None] for f in found]
        self.learn({c[i] for c, g in zip(chunks, gaps, strict=True) for i in g})
        for c, f, g in zip(chunks, found, gaps, strict=True):
            for i in g:
                f[i] = self[c[i]]
        return list(map(b"".join, found))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk) or as_bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= self.long:
            self.keep([(chunk, ids)])
        return ids

    def ids(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self.of([text])[0]
        parts = self.cuts.split(text)
        parts[::2] = self.of(parts[::2])
        return b"".join(self.added[p] if i % 2 else p for i, p in enumerate(parts))

    def each(self, texts: list[str], together: int = 1 << 16) -> Iterator[bytes]:
        """The ids of each text, in the order of the texts; neighbours of some `together` characters learn at once."""
        group, size = [], 0
        for text in texts:
            if any(t in text for t in self.added):
                yield from self.of(group)
                yield self.ids(text)
                group, size = [], 0
                continue
            group.append(text)
            size += len(text)
            if size >= together:
                yield from self.of(group)
                group, size = [], 0
        yield from self.of(group)


encoder = lru_cache(maxsize=1)(Encoder)
PIECES = "doc_id long, position long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(batches: Iterator[pd.DataFrame], vocabulary: str, length: int, keep_ids: bool, at_once: int = 2000) -> Iterator[pd.DataFrame]:
    encode = encoder(vocabulary)
    size = 4 * length

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    for batch in batches:
        rows = []
        texts = [x or "" for x in batch["text"]]
        for doc_id, position, ids in zip(batch["doc_id"].tolist(), batch["position"].tolist(), encode.each(texts), strict=True):
            ids += b"\0\0\0\0"
            for at in range(0, len(ids), size):
                piece = ids[at : at + size]
                row = (doc_id, position, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                rows.append((*row, piece) if keep_ids else row)
            if len(rows) >= at_once:
                yield frame(rows)
                rows = []
        yield frame(rows)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of the pieces in a sequence) with the number of sequences of each.

    Lengths go longest first, each to the shortest open patterns; a pattern that is needed less often
    than it occurs is split in two. Each length splits or opens one pattern at most, so the work and
    the result depend on the number of lengths alone.
    """
    patterns: list[tuple[list[int], int]] = []
    heap: list[tuple[int, int]] = []  # filled so far, pattern
    for size in sorted(histogram, reverse=True):
        left, grown = histogram[size], []
        while left:
            if not heap or heap[0][0] + size > length:
                patterns.append(([size], left))
                grown.append((size, len(patterns) - 1))
                break
            filled, k = heapq.heappop(heap)
            parts, count = patterns[k]
            if count <= left:
                patterns[k] = ([*parts, size], count)
                grown.append((filled + size, k))
                left -= count
            else:
                patterns[k] = (parts, count - left)
                heapq.heappush(heap, (filled, k))
                patterns.append(([*parts, size], left))
                grown.append((filled + size, len(patterns) - 1))
                left = 0
            if heap and heap[0][0] + size > length or not heap:
                # what this length has filled is open to it again
                for x in grown:
                    heapq.heappush(heap, x)
                grown = []
        for x in grown:
            heapq.heappush(heap, x)
    return patterns


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """length, first and last rank among the pieces of that length, sequence of the first rank, offset."""
    out, ranks, sequence = [], {}, 0
    for parts, count in patterns:
        offset = 0
        for size in parts:
            rank = ranks.get(size, 0)
            out.append((size, rank, rank + count - 1, sequence, offset))
            ranks[size] = rank + count
            offset += size
        sequence += count
    return out


def file_position() -> Column:
    """Where a row of a written table stands: number of its file, of the file's part, and of the row in it."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    split = F.coalesce(F.regexp_extract("_metadata.file_name", r"-c(\d+)\.", 1).cast("long"), F.lit(0))
    return F.coalesce(part, F.lit(0)) * 2**40 + split * 2**32 + F.col("_metadata.row_index")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, keep_ids: bool = False, position: Column | None = None) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `length` ids.

    Result, a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; the ids
    as little-endian 32-bit numbers if keep_ids; and position if one is given. A document is its ids and then
    id 0 (null and empty text: id 0 alone); it is cut after every `length` ids, so only its last piece can be
    shorter. The driver gets the histogram (at most `length` numbers) and makes patterns of it; pieces find
    their places by their rank among those of the same length. They rank by position (a whole number, such
    as file_position(); it tells copies of a document apart), so that a pattern's sequences hold pieces that
    stand near each other, else by a digest; either way they are counted by ranges, so that the commonest length
    doesn't meet in one task. Null ids are kept; documents that repeat are packed each time; other columns of
    docs are dropped, whatever their names. No documents, no pieces.
    """
    small_batches(docs.sparkSession)
    ordered = position is not None
    run = partial(cut_pieces, vocabulary=vocabulary, length=length, keep_ids=keep_ids, at_once=500 if keep_ids else 2000)
    at = position.cast("long") if ordered else F.lit(0).cast("long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), at.alias("position"), F.col("text").cast("string").alias("text"))
    pieces = written(texts.mapInPandas(run, PIECES + ", ids binary" * keep_ids)).withColumn("_one", F.lit(1))
    if ordered:  # ranges of 4096 rows of one file each
        slot, order = F.shiftright("position", 12), ["position", "start"]
    else:  # equal rows, that no digest tells apart, are dealt by where they stand
        key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "ids_crc32")
        pieces = pieces.withColumn("_digest", F.sha2(key, 256))
        twin = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % 4096).otherwise(0)
        slot, order = F.pmod(hex_slot("_digest") + twin, F.lit(4096)), ["_digest", "doc_id", "start"]
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = slots(shortest_pack_first(histogram, length))
    places = docs.sparkSession.createDataFrame(rows, "length long, _first long, _last long, _sequence long, offset long")
    if len(rows) <= MOST_SLOTS:
        places = F.broadcast(places)
    ranked = sums_before(pieces, "length", slot, order, "_one", "_rank")
    inside = (ranked["length"] == places["length"]) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    return ranked.join(places, inside).select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset",
        *["position"] * ordered, *["ids"] * keep_ids,
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
