"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

DataFrame functions only. All positions are code points, from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import cut, own_names, read

#: Kinds with the patterns of the contract in a form without backtracking: a match is only tried where
#: the run of its first class begins (or where the last match ended), as it fails alike anywhere later
#: in that run; greedy runs that nothing could shorten are possessive.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CONTEXT = "context"
#: A whole run of value characters, a digit among them; the ends are trimmed afterwards. Tried only where a run begins.
RUN = r"(?<![\p{L}0-9_./+@-])(?=[\p{L}_./+@-]*+[0-9])[\p{L}0-9_./+@-]{8,}+(?:={1,2}+(?![\p{L}0-9=]))?+"
LEADING, TRAILING = r"^[_./+@-]+", r"[_./+@-]+$"
#: What the fixed patterns have judged and rejected is no candidate: numbers as long as a card's, four dotted numbers.
REJECTED = r"^(?:[0-9](?:-?[0-9]){15,18}|[0-9]+(?:\.[0-9]+){3})$"
#: Characters on either side of a value in which its words are sought (words cut off by that are none), and words a side.
WIDE, WORDS = 96, 3
#: First character of a pattern: words on the left, words on the right, shape of the value.
LEFT, RIGHT, SHAPE = "<", ">", "s"
#: Rounds of scoring, least score of a pattern, least number of different instances that support it.
ROUNDS, LEAST_SCORE, LEAST_SUPPORT = 3, 0.5, 3


SPANS = "array<struct<start:int,end:int,value:string>>"
#: Matches whose places are added up together; code points of the pieces that a long text is seen in.
BLOCK, PIECE = 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value): their places follow from the lengths of what lies between.

    Lengths are added up in blocks and the blocks' sums after that, so that the work grows with the matches.
    """

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["n"]
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    def in_blocks(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
        return F.transform(numbers, lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, BLOCK), start, step))

    def placed(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(
            blocks, start, lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"]
        )
        moved = lambda x, by: F.transform(x["out"], lambda e: F.struct((e["start"] + by).alias("start"), (e["end"] + by).alias("end"), e["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, bases, moved))

    def of_matches(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(between, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("m")))
        return F.when(F.size(found) > 0, let(let(pairs, in_blocks), placed)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_matches)


def width_of(text: Column) -> Column:
    """Code points of a piece of the text: more for very long ones, so that neither pieces nor what is in one get too many."""
    return F.greatest(F.lit(PIECE), F.ceil(F.sqrt(F.length(text)) * 10).cast("int"))


def by_piece(text: Column, width: Column, of_piece: Callable[[Column], Column]) -> Column:
    """of_piece(number) for each piece of the text, from 0; one for an empty text."""
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), last), of_piece)


def in_piece(spans: Column, number: Column, width: Column) -> Column:
    """The spans that touch a piece."""
    return F.filter(spans, lambda s: (s["start"] < (number + 1) * width) & (s["end"] > number * width))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        number = digits(value)
        return F.length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def _valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: is_valid(kind, s["value"]))


def base_spans(text: Column) -> dict[str, Column]:
    """Valid matches of each kind."""
    out = {}
    for kind, pattern in KINDS.items():
        candidates = _valid(kind, located(text, pattern))
        none = F.array().cast(SPANS)
        out[kind] = F.when(F.contains(text, F.lit(NEEDS[kind])), candidates).otherwise(none) if NEEDS[kind] else candidates
    return out


def _normal_words(window: Column) -> Column:
    """Words in lower case with 0 for each digit, without what delimits them."""
    plain = F.regexp_replace(F.lower(window), "[0-9]", "0")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shape(value: Column) -> Column:
    """Length and kinds of characters."""
    kinds = [F.when(value.rlike(c), F.lit(n)).otherwise(F.lit("")) for n, c in (("a", r"\p{Ll}"), ("A", r"\p{Lu}"), ("0", "[0-9]"))]
    return F.concat(F.lit(SHAPE + " "), F.length(value), F.lit(" "), *kinds, F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(value, r"[\p{L}0-9]", ""), ""))), ""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the row, the base spans by kind, and its instances (start, end, value, seed, patterns).

    Instances are the base spans, as seeds, and the candidates: runs of value characters of any length that
    could be identifiers and touch no base span. Patterns of an instance are the one to three words before
    it, the word before it with its delimiter, the one to three words after it, and the value's shape; a
    mere number next to the value gives no pattern on that side.
    """
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64(F.lit(71), "doc_id", "text").alias("_b"),
    )
    found = rows.select(
        "doc_id", "text", "_a", "_b", *[c.alias(k) for k, c in base_spans(F.col("text")).items()],
        located(F.col("text"), RUN).alias("runs"), width_of(F.col("text")).alias("width"),
    )
    every, width = F.concat(*KINDS), F.col("width")

    def instance(start: Column, value: Column, seed: bool) -> Column:
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lit(seed).alias("seed"))

    def trimmed(r: Column) -> Column:
        value = F.regexp_replace(r["value"], LEADING, "")
        return instance(r["start"] + F.length(r["value"]) - F.length(value), F.regexp_replace(value, TRAILING, ""), False)

    def untouched(runs: Column, spans: Column) -> Column:
        """Runs that touch no span; only those of the same pieces are looked at."""

        def free(near: Column) -> Column:
            def touches(x: Column) -> Column:
                first, last = F.floor(x["start"] / width).cast("int"), F.floor((x["end"] - 1) / width).cast("int")
                around = F.slice(near, first + 1, last - first + 1)
                return F.exists(around, lambda n: F.exists(n, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))

            return F.filter(runs, lambda x: ~touches(x))

        near = by_piece(F.col("text"), width, lambda b: in_piece(spans, b, width))
        return F.when(F.size(spans) == 0, runs).otherwise(let(near, free))

    def could_be(x: Column) -> Column:
        return (F.length(x["value"]) >= 8) & x["value"].rlike("[0-9]") & ~x["value"].rlike(REJECTED)

    runs = F.filter(F.transform("runs", trimmed), could_be)
    free_runs = let(every, lambda spans: let(runs, lambda r: untouched(r, spans)))
    seeds = F.transform(every, lambda s: instance(s["start"], s["value"], True))
    found = found.withColumn("instances", F.concat(seeds, free_runs))

    def with_words(x: Column, pieces: Column) -> Column:
        def around(start: Column, size: Column) -> Column:  # seen in the pieces where it begins and ends
            b = F.floor(start / width).cast("int")
            local = F.concat(F.coalesce(F.get(pieces, b), F.lit("")), F.coalesce(F.get(pieces, b + 1), F.lit("")))
            return F.substring(local, start - b * width + 1, size)

        before = around(F.greatest(x["start"] - WIDE, F.lit(0)), F.least(x["start"], F.lit(WIDE)))
        before = F.when(x["start"] > WIDE, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
        after = around(x["end"], F.lit(WIDE))
        after = F.when(F.length(after) == WIDE, F.regexp_replace(after, r"[\p{L}\p{N}]++$", "")).otherwise(after)
        mark = F.regexp_extract(before, r"([:=#])[\s\"']*+$", 1)
        return F.struct(x.alias("x"), F.reverse(_normal_words(before)).alias("before"), _normal_words(after).alias("after"), mark.alias("mark"))

    def with_patterns(y: Column) -> Column:
        of = lambda side, words, k: F.when((F.size(words) >= k) & F.get(words, F.lit(0)).rlike(r"\p{L}"), F.concat(F.lit(f"{side}{k} "), F.array_join(F.slice(words, 1, k), " ")))
        marked = F.when((y["mark"] != "") & (F.size(y["before"]) > 0), F.concat(F.lit(LEFT), y["mark"], F.lit(" "), F.get(y["before"], F.lit(0))))
        texts = [of(side, y[words], k) for side, words in ((LEFT, "before"), (RIGHT, "after")) for k in range(1, WORDS + 1)]
        patterns = F.array_compact(F.array(*texts, marked, _shape(y["x"]["value"])))
        return F.struct(*[y["x"][c].alias(c) for c in ("start", "end", "value", "seed")], patterns.alias("patterns"))

    cut_up = by_piece(F.col("text"), width, lambda b: F.substring(F.col("text"), b * width + 1, width))
    worded = let(cut_up, lambda pieces: F.transform("instances", lambda x: with_words(x, pieces)))
    return found.select("doc_id", "_a", "_b", *KINDS, F.transform(worded, with_patterns).alias("instances"))


def score_patterns(scanned: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """pattern and score of the trusted patterns.

    The graph links each pattern to the different values seen with it. Seeds score 1. In each round a
    pattern scores the mean of its values (with one more worth 0, against chance), and a candidate the
    chance that its best pattern of one of the families (words on the left, words on the right, shape) is
    right, families being taken as independent: so patterns that share values or shapes back each other.
    Trusted are patterns of words with the least score and enough values that are seeds or that the other
    families alone give at least half. Edges are made distinct before they meet, with a partial
    aggregation on each side.
    """
    edges = scanned.select(F.explode("instances").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.value", "x.seed")
    edges = cut(edges.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("int")).alias("seed")))
    family = F.substring("pattern", 1, 1)
    scored = edges.withColumn("score", F.col("seed").cast("double")).withColumn("others", F.col("score"))
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("p"), F.sum(F.expr("IF(others >= 0.5, 1, 0)")).alias("support")
        )
        if k == rounds - 1:
            break
        useful = patterns.where("p > 0").select("pattern", "p")
        reached = edges.where("seed = 0").join(useful, "pattern")
        reached = reached.groupBy("value", family.alias("family")).agg(F.max("p").alias("p"))
        values = reached.groupBy("value").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score"), F.map_from_entries(F.collect_list(F.struct("family", "p"))).alias("by")
        )
        settled = edges.where("seed = 1").withColumn("score", F.lit(1.0)).withColumn("others", F.lit(1.0))
        guessed = edges.where("seed = 0").join(values, "value", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        own = F.coalesce(F.element_at("by", family), F.lit(0.0))
        guessed = guessed.withColumn("others", 1 - (1 - F.col("score")) / (1 - own)).drop("by")
        scored = cut(settled.unionByName(guessed))
    trusted = patterns.where((F.col("p") >= least_score) & (F.col("support") >= least_support) & ~F.startswith("pattern", F.lit(SHAPE)))
    return trusted.select("pattern", F.col("p").alias("score"))


def find_personal_data(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, _a, _b, base (kind -> spans as columns) and `context`, the spans that the method adds.

    docs needs doc_id and text; null texts count as empty. _a and _b are a key of (doc_id, text); rows
    that repeat have the same key and the same spans. Texts are read once and never shuffled: all that
    is kept of them are spans, candidates and the words around them.
    """
    scanned = cut(scan(docs))
    trusted = cut(score_patterns(scanned, **settings))
    found = scanned.select("_a", "_b", F.explode("instances").alias("x")).where("NOT x.seed")
    found = found.select("_a", "_b", "x.start", "x.end", "x.value", F.explode("x.patterns").alias("pattern"))
    added = found.join(trusted, "pattern", "left_semi")
    added = added.groupBy("_a", "_b").agg(F.array_sort(F.collect_set(F.struct("start", "end", "value"))).alias(CONTEXT))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return scanned.join(added, ["_a", "_b"], "left").select("doc_id", "_a", "_b", *KINDS, F.coalesce(CONTEXT, none).alias(CONTEXT))


def named(*kinds: str) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""

    def of_kind(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(of_kind, kinds)), ",")


def redact(docs: DataFrame, **settings) -> DataFrame:
    """docs with every span in text replaced by [KIND]; where spans overlap, by the first one's kind.

    Null texts stay null, all rows and all columns stay, repeated rows change alike; an empty table stays empty.
    A long text is rewritten piece by piece.
    """
    a, b, spans = own_names(docs, "_a", "_b", "_spans")
    found = find_personal_data(docs, **settings).dropDuplicates(["_a", "_b"])

    def of_kind(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind")))

    every = F.array_sort(F.concat(*map(of_kind, (*KINDS, CONTEXT))))
    found = found.select(F.col("_a").alias(a), F.col("_b").alias(b), every.alias(spans)).where(F.size(spans) > 0)
    keyed = docs.withColumn(a, F.xxhash64("doc_id", "text")).withColumn(b, F.xxhash64(F.lit(71), "doc_id", "text"))
    rows = keyed.join(found, [a, b], "left")

    def rewritten(number: Column, width: Column) -> Column:
        low = number * width

        def of_text(piece: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                gap = F.substring(piece, s["at"] - low + 1, x["start"] - s["at"])
                label = F.concat(s["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
                return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], label).otherwise(s["out"]).alias("out"))

            start = F.struct(low.alias("at"), F.lit("").alias("out"))
            return F.aggregate(
                in_piece(F.col(spans), number, width), start, step, lambda s: F.concat(s["out"], F.substring(piece, s["at"] - low + 1, width))
            )

        return let(F.substring(F.col("text"), low + 1, width), of_text)

    pieces = let(width_of(F.col("text")), lambda w: by_piece(F.col("text"), w, lambda number: rewritten(number, w)))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return rows.select(*[text.alias(c) if c == "text" else rows[f"`{c}`"] for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(named(*KINDS), 256).alias("base_sha256"),
        named(*KINDS, CONTEXT).alias("spans"),
    )
