"""Column helpers: text, patterns, urls. All stay native expressions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseriver.functions import rules as R

#: \b between ASCII letters, digits and _ only, as the rules mean it (the JVM's own is wider). In the rules it
#: stands before a word where a letter, digit, group or class follows, and after one elsewhere.
_BEGIN = re.compile(r"\\b(?=[A-Za-z0-9(\[]|\\d)")


def pattern(p: str, flags: str = "(?i)") -> str:
    return flags + _BEGIN.sub(r"(?<!\\w)", p).replace(r"\b", r"(?!\w)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, p: str, flags: str = "(?i)") -> Column:
    return F.rlike(text, F.lit(pattern(p, flags)))


@lru_cache(maxsize=None)
def needs(p: str) -> tuple[str, ...]:
    """Lower-case strings one of which stands in every text that the pattern matches; empty if there are none of use.

    They follow from the pattern's parts: of parts in a row the one with the longest strings serves, of alternatives all do.
    """
    try:
        return _needs(list(_parser.parse(p))) or ()
    except re.error:
        return ()


@lru_cache(maxsize=None)
def needs_all(p: str, most: int = 3) -> tuple[tuple[str, ...], ...]:
    """As needs, but several such groups, each of which has a string in every text that the pattern matches: `most` at most, longest first."""
    try:
        found = dict.fromkeys(g for g in _groups(list(_parser.parse(p))) if _useful(g))
    except re.error:
        return ()
    return tuple(sorted(found, key=_worth, reverse=True)[:most])


def _worth(group: tuple[str, ...]) -> tuple[float, int]:
    return min(map(len, group)) - len(group) / 4, -len(group)


def _useful(group: tuple[str, ...]) -> bool:
    return min(map(len, group)) >= 3 and len(group) <= 12


def _needs(parts: list) -> tuple[str, ...] | None:
    best = max(_groups(parts), key=_worth)
    return best if _useful(best) else None


def _groups(parts: list) -> list[tuple[str, ...]]:
    """Groups of strings, of each of which one stands in every match of the parts in a row."""
    found, run = [], ""
    queue = deque(parts)
    while queue:
        op, arg = queue.popleft()
        name = str(op)
        if name == "LITERAL" and len(chr(arg).lower()) == 1:
            run += chr(arg).lower()
        elif name == "SUBPATTERN":
            queue.extendleft(reversed(list(arg[3])))
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):  # these take no room
            found.append((run,))
            run = ""
            if name == "BRANCH":
                each = [_needs(list(x)) for x in arg[1]]
                if all(each):
                    found.append(tuple(dict.fromkeys(y for x in each for y in x)))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                found.append(_needs(list(arg[2])) or ("",))
    found.append((run,))
    return found


def may_match(low: Column, p: str) -> Column:
    """Whether a text, given in lower case, has all that the pattern cannot do without: cheap, and true wherever the pattern matches."""
    groups = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in group]) for group in needs_all(p)]
    return reduce(lambda a, b: a & b, groups) if groups else F.lit(True)


def any_match(text: Column, patterns: Iterable[str], flags: str = "(?i)") -> Column:
    """One alternation: the engine walks the text once for all patterns."""
    return matches(text, "|".join(f"(?:{p})" for p in patterns), flags)


def any_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """Whether the (lower-case) text has any of the phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def count_matches(text: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur."""
    return sum((matches(text, p).cast("int") for p in patterns), F.lit(0))


def count_phrases(text: Column, phrases: Iterable[str]) -> Column:
    return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def first_match(text: Column, patterns: Iterable[str]) -> Column:
    """Position (from 0) of the first pattern that occurs; later ones aren't tried."""
    return F.coalesce(*[F.when(matches(text, p), F.lit(i)) for i, p in enumerate(patterns)], F.lit(None).cast("int"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def normalize(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_quotes(text: Column) -> Column:
    """As normalize, but quotes and _ stay."""
    plain = F.regexp_replace(F.lower(text), "[^\\w\"'`]+", " ")
    return F.trim(F.replace(F.replace(plain, F.lit("'"), F.lit('"')), F.lit("`"), F.lit('"')))


def cap_words(text: Column, most: int = 60, more: str = "...") -> Column:
    words = F.split(text, r"\s+")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(more))).otherwise(text)


def clean_source(text: Column) -> Column:
    """Line ends and no-break spaces as the rules expect them."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(unix, F.lit("\u00a0"), F.lit(" "))


def split_at_match(text: Column, p: str | Column) -> Column:
    """What stands before and after the first match of a pattern, which may be a column (as pattern(p, "") leaves it), as an array.

    The text is walked once; without a match all of it stands after.
    """
    parts = F.split(text, F.concat(F.lit("(?i)"), p) if isinstance(p, Column) else F.lit(pattern(p)), 2)
    return let(parts, lambda s: F.when(F.size(s) > 1, s).otherwise(F.array(F.lit(""), text)))


def _after_last(text: Column, *ends: str) -> Column:
    return reduce(lambda t, end: F.substring_index(t, end, -1), ends, text)


def quote_around(text: Column, p: str | Column, variant: str = "denial") -> Column:
    """The sentence around the pattern's first match. The pattern of variant evidence may be a column.

    denial: from the last full stop to the next one (200 characters from the match if there is none),
    240 characters at most. clause: a line feed also begins it, 300 at most. evidence: the text must be
    stripped and its white space collapsed; semicolons end it too, else 180 before and 220 after; empty
    if under 24 characters.
    """
    if variant == "evidence":

        def ends(t: Column) -> Column:
            return F.contains(t, F.lit(".")) | F.contains(t, F.lit(";"))

        def evidence(s: Column) -> Column:
            head, at = s[0], F.length(s[0])
            left = F.when(ends(head), _after_last(head, ".", ";")).otherwise(F.substring(head, F.greatest(F.lit(1), at - 179), F.lit(180)))
            after = F.substring(text, at + 1, F.length(text))
            upto = lambda a: F.length(F.substring_index(F.substring_index(a, ".", 1), ";", 1)) + 1
            right = let(after, lambda a: F.when(ends(a), F.substring(a, F.lit(1), upto(a))).otherwise(F.substring(a, 1, 220)))
            return let(strip(F.concat(left, right)), lambda q: F.when(F.length(q) >= 24, F.substring(q, 1, 300)).otherwise(F.lit("")))

        return let(split_at_match(text, p), evidence)
    begin, most = ((".",), 240) if variant == "denial" else ((".", "\n"), 300)

    def sentence(s: Column) -> Column:
        head, after, at = s[0], s[1], F.length(s[0])
        hit = F.substring(text, at + 1, F.length(text) - at - F.length(after))
        right = F.when(F.contains(after, F.lit(".")), F.concat(hit, F.substring_index(after, ".", 1), F.lit(".")))
        right = F.coalesce(right, F.substring(text, at + 1, F.lit(200)))
        return F.substring(collapse(strip(F.concat(_after_last(head, *begin), right))), 1, most)

    return let(split_at_match(text, p), sentence)


def strong_negation(sentence: Column) -> Column:
    return matches(sentence, R.STRONG_NEGATION)


def conditional_denial(quote: Column) -> Column:
    return matches(quote, R.CONDITIONAL)


def null_citation(citation: Column) -> Column:
    c = F.lower(strip(F.coalesce(citation, F.lit(""))))
    return c.isin(R.NULL_CITATIONS) | matches(c, R.NULL_CITATION)


def is_paraphrase(citation: Column) -> Column:
    c = strip(F.coalesce(citation, F.lit("")))
    return any_match(c, R.PARAPHRASE_STRICT) | any_match(F.substring(c, 1, 80), R.PARAPHRASE_LEADING)


def strip_wrapper(citation: Column) -> Column:
    inner = F.regexp_replace(citation, pattern(R.WRAPPER_PREFIX), "")
    inner = F.regexp_replace(inner, pattern(R.WRAPPER_SUFFIX), "")
    inner = strip(F.regexp_replace(inner, "[\"'”’]+$", ""))
    return F.when(F.length(inner) >= 20, inner).otherwise(citation)


def is_grounded(citation: Column, src: Column) -> Column:
    """Whether the citation's beginning, or any five of its words in a row, stand in the source, given as normalize_quotes leaves it."""
    cit = normalize_quotes(citation)
    head = F.substring(cit, 1, 60)
    words = F.filter(F.split(cit, " "), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 4)), lambda i: F.array_join(F.slice(words, i, 5), " "))
    window = (F.size(words) >= 5) & F.exists(runs, lambda w: (F.length(w) >= 18) & F.contains(src, w))
    absent = citation.isNull() | (citation == R.NOT_ADDRESSED) | (citation == "")
    return ~absent & (F.length(cit) >= 25) & (F.contains(src, head) | window)


def classify_citation(citation: Column, grounded: Column) -> Column:
    """grounded: what is_grounded says of the citation."""
    c = strip(F.coalesce(citation, F.lit("")))
    return (
        F.when((c == "") | (c == R.NOT_ADDRESSED), F.lit("ABSENT"))
        .when(is_paraphrase(c), F.lit("PARAPHRASE"))
        .when(F.length(c) < 25, F.lit("TOO_SHORT"))
        .when(~grounded, F.lit("NOT_FOUND"))
        .otherwise(F.lit("GROUNDED"))
    )


def citation_confidence(citation: Column, src: Column) -> Column:
    """src: the source as normalize leaves it."""
    cit = normalize(citation)
    prefix = F.substring(cit, 1, 50)
    words = F.filter(F.split(cit, " "), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(words, lambda w: F.contains(src, w)))
    none = citation.isNull() | citation.isin("", R.NOT_FOUND, R.NOT_ADDRESSED)
    return (
        F.when(none, F.lit("MEDIUM"))
        .when((F.length(prefix) >= 20) & F.contains(src, prefix), F.lit("HIGH"))
        .when(F.size(words) == 0, F.lit("LOW"))
        .when(hits / F.size(words) >= 0.6, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def conf_rank(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", 3).when(confidence == "MEDIUM", 2).when(confidence == "LOW", 1).otherwise(0)
