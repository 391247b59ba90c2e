"""HTML extraction by consensus: hosts vote on the paths of their main containers."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import joined_small, read, small_batches, written
from clauseriver.llm.url_filter import host_of

#: A tag that another one begins in, or that never ends, is no tag but text: so each character is looked at a few times only.
_token = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|title|svg|xmp)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*)>"
    r"|<[!?][^<>]*>",
    re.S | re.I,
)
#: One attribute after the other, so that a name is never sought inside another name or a value.
_attr = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_name = re.compile(r"[a-z]+")
CONTAINERS = set(
    "body div section article main td th tr table tbody ul ol li dl dt dd blockquote figure figcaption center details "
    "summary fieldset address hgroup".split()
)
BREAKS = set("p h1 h2 h3 h4 h5 h6 pre hr html head thead tfoot caption option".split())
DROPPED = set("nav header footer aside form button select dialog menu embed".split())
INLINE = set("span a small ins em i b strong".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in a class, id or role that mark what isn't the article.
NOISE = set(
    "nav navbar navigation menu sidebar footer header masthead banner ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus reply replies respond discussion share "
    "sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget skip "
    "search complementary contentinfo dialog".split()
)
#: Words that only say which one or how a noisy element is, as in site-footer or sidebar-left. With any other word beside it,
#: as in sidebar-free, a word of NOISE is no more than a hint.
NEUTRAL = set(
    "site page main top bottom left right box boxes list area wrap wrapper container block section bar inner outer primary secondary global "
    "post posts article articles link links item items group row col column content body panel module text title icon icons button buttons btn "
    "form field fields count meta info holder region zone unit slot the and our your more also you may like read see all new latest popular "
    "mobile desktop sticky fixed js is".split()
)
#: Of these, words that also name parts of an article: inside one, they count only where the host's pages agree.
DOUBTFUL = set(
    "nav menu header notice notices alert overlay promotion reply replies discussion share sharing social related "
    "recommended recommendations widget search registration".split()
)
#: Share of a host's pages, and least number of them, on which a doubtful element must stand at one path to be dropped.
AGREED, LEAST_PAGES = 0.5, 2
#: Beginnings of such words, and of words that only look like them.
NOISE_STEMS = tuple("cookie advert sidebar comment newsletter footer popup sponsor breadcrumb navig subscri".split())
NOT_NOISE = ("commentary", "commented")
#: "with-sidebar" and the like say what stands beside.
_beside = re.compile(r"\b(?:has|with|without|no|hide|show)[-_][a-z]+", re.I)
_hump = re.compile(r"([a-z])([A-Z])")
#: Words in a class, id, role or itemprop that mark the article.
ARTICLE = set("article articlebody content main post entry story body text page blog".split())


def _is_noise(word: str) -> bool:
    return word in NOISE or word.startswith(NOISE_STEMS) and word not in NOT_NOISE


def _marks(attrs: str) -> tuple[list[list[str]], str, bool]:
    """The words of each name in the marking attributes, the generalised class (or id), and whether the element is hidden."""
    names, label, ident, hidden = [], "", "", False
    for name, value in _attr.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name in ("class", "id", "role", "itemprop"):
            hidden |= name == "class" and "hidden" in value.lower().split()
            names += [_name.findall(_hump.sub(r"\1 \2", x).lower()) for x in _beside.sub(" ", value).split()]
            if name == "class" and value.split():
                label = "." + re.sub(r"\d+", "0", value.split()[0])
            elif name == "id":
                ident = "#" + re.sub(r"\d+", "0", value)
    return names, label or ident, hidden


def noise(tag: str, names: list[list[str]]) -> str | None:
    """How sure an element's names mark it as boilerplate: "sure", "doubtful" (its name also stands for parts of articles), "hint"
    (a noisy word among others) or None; of main and article, only those that hold a comment."""
    if tag == "body" or not names:
        return None
    if tag in ("main", "article"):
        return "sure" if any(x and x[0].startswith("comment") and x[0] not in NOT_NOISE and set(x[1:]) <= NEUTRAL for x in names) else None
    noisy = [x for x in names if any(map(_is_noise, x))]
    whole = [x for x in noisy if all(_is_noise(w) or w in NEUTRAL for w in x)]
    if any(any(_is_noise(w) and w not in DOUBTFUL for w in x) for x in whole):
        return "sure"
    return "doubtful" if whole else "hint" if noisy else None


def step_of(parent: int, step: str) -> int:
    """64-bit number of a path: that of the path above and one more step."""
    return xxhash.xxh3_64_intdigest(f"{parent}>{step}") - 2**63


class Page:
    """One page's text blocks without boilerplate, and its containers, found in one pass over its tokens.

    A container is its path (tags and generalised classes from the body down), its score, and the range of
    blocks inside. The score is the share of the page's text outside links that it holds, plus a bonus if it
    or what it stands in is marked as an article, plus a little for depth: so the deepest one that still
    holds the whole article wins. Paths are kept as numbers with a link to the container above; only the
    best one's is written out. A block inside an element that only votes can tell has that element's path as a mark; so has a
    container that stands in one. `spared` has the numbers of elements that aren't dropped, whatever their marks; with None,
    none is.
    """

    def __init__(self, html: str, spared: frozenset[int] | None = frozenset()):
        self.spared, self.number, self.above, self.lost = spared, 0, [0], False
        self.blocks: list[str] = []
        self.marks: list[int] = []  # of each block, 0 for none
        self.plain: list[int] = []  # characters of each block outside links
        self.found: list[list] = []  # path, container above, step, bonus, first block, end, depth, mark, number
        # open elements: tag, place in found (or None), whether it is dropped, path, bonus, in an article, mark, number
        self.stack: list[tuple] = [("", None, False, 0, 0.0, False, 0, 0)]
        self.open_tags: Counter = Counter()
        self.text: list[str] = []
        self.dropped, self.links, self.in_link = 0, 0, False  # dropped: how many open elements are
        at = 0
        for m in _token.finditer(html):
            if not self.dropped and m.start() > at:
                piece = html[at : m.start()]
                self.text.append(piece)
                if self.in_link:
                    self.links += len(piece)
            at = m.end()
            if m[3]:
                self.take(m[3].lower(), bool(m[2]), m[4])
        if not self.dropped:
            self.text.append(html[at:])
        self.flush()
        while len(self.stack) > 1:
            self.close()
        self.rank()

    def flush(self) -> None:
        if self.text:
            block = " ".join(entities.unescape("".join(self.text)).split())
            if block:
                self.blocks.append(block)
                self.marks.append(self.stack[-1][6])
                self.plain.append(max(0, len(block) - self.links))
            self.text.clear()
        self.links = 0

    def push(self, tag: str, *rest) -> None:
        self.open_tags[tag] += 1
        self.stack.append((tag, *rest))

    def close(self) -> None:
        tag, place, dropped, *_ = self.stack.pop()
        self.open_tags[tag] -= 1
        self.dropped -= dropped
        if place is not None:
            self.found[place][5] = len(self.blocks)

    def take(self, tag: str, ends: bool, attrs: str) -> None:
        if tag == "a":
            self.in_link = not ends
        if tag == "br":
            if not self.dropped:
                self.text.append(" ")
            return
        block = tag in CONTAINERS or tag in BREAKS or tag in DROPPED
        if block and not self.dropped:
            self.flush()
        if ends:
            if self.open_tags[tag] > 0:
                while self.stack[-1][0] != tag:
                    self.close()
                self.close()
            return
        if tag not in INLINE and not block:
            return
        if block and self.stack[-1][0] in BREAKS:
            self.close()
        if block and tag in SELF_CLOSING and self.stack[-1][0] in SELF_CLOSING[tag]:
            self.close()
        names, label, hidden = _marks(attrs) if attrs else ([], "", False)
        if attrs.endswith("/") or tag in ("hr", "html", "head", "embed"):
            return
        _, _, _, path, bonus, article, mark, _ = self.stack[-1]
        self.number += 1
        number, main = self.number, tag in ("article", "main") or ["articlebody"] in names or ["article", "body"] in names
        self.above.append(self.stack[-1][7])
        self.lost |= main and self.dropped > 0
        if self.dropped and tag not in DROPPED:
            self.push(tag, None, False, path, bonus, article, mark, number)  # so that its end tag closes nothing else
            return
        judged = noise(tag, names)
        drops = tag in DROPPED or hidden or judged == "sure" or judged == "doubtful" and not article
        if drops and self.spared is not None and number not in self.spared:
            self.dropped += 1
            self.push(tag, None, True, path, bonus, article, mark, number)
        elif tag in CONTAINERS:
            step = tag + label.replace(">", "")
            own = step_of(path, step)
            more = 0.5 if main else 0.25 * any(w in ARTICLE for x in names for w in x)
            bonus = max(bonus, more if tag != "body" else 0.0)
            above = next((x[1] for x in (self.stack[-1], self.stack[-2] if len(self.stack) > 1 else self.stack[-1]) if x[1] is not None), None)
            mark = mark or (own if judged else 0)
            self.found.append([own, above, step, bonus, len(self.blocks), -1, len(self.stack), mark, number])
            self.push(tag, len(self.found) - 1, False, own, bonus, article or main, mark, number)
        elif tag in DROPPED:
            self.push(tag, None, False, path, bonus, article, mark, number)
        elif tag in BREAKS:
            self.push(tag, None, False, path, bonus, article, mark or (step_of(path, tag + label) if judged else 0), number)

    def rank(self) -> None:
        """paths, firsts and ends: of each path its best container with text outside links, the best of all first."""
        sums = [0, *accumulate(self.plain)]
        total, best = sums[-1] or 1, {}
        for i, (path, _, _, bonus, first, end, depth, *_) in enumerate(self.found):
            if sums[end] > sums[first]:
                key = ((sums[end] - sums[first]) / total + bonus + 0.001 * min(depth, 100), -first, -i)
                if path not in best or key > best[path]:
                    best[path] = key
        order = sorted(best, key=best.get, reverse=True)
        places = [-best[p][2] for p in order]
        self.paths, self.firsts, self.ends, self.helds = order, *([self.found[i][k] for i in places] for k in (4, 5, 7))
        self.best = self.found[places[0]] if places else None
        steps, i = [], places[0] if places else None
        while i is not None:
            steps.append(self.found[i][2])
            i = self.found[i][1]
        self.path = ">".join(reversed(steps)) if steps else None


def best_page(html: str) -> Page:
    """The page, with no element dropped that holds its best container.

    What that is can only be in doubt if an article stands in what was dropped, or if nothing is left. Then the page is read
    without dropping anything; if an article (or anything, where nothing was left) is best, what it stands in is spared.
    """
    page = Page(html)
    if page.lost or not page.blocks:
        bare = Page(html, None)
        if bare.best is not None and (bare.best[3] >= 0.5 or not page.blocks):
            holds, number = set(), bare.best[8]
            while number:
                holds.add(number)
                number = bare.above[number]
            page = Page(html, frozenset(holds))
    return page


PARSED = (
    "page_id long, url string, host string, blocks array<string>, marks array<long>, paths array<long>, firsts array<int>, "
    "ends array<int>, helds array<long>, path string"
)


def parse_pages(batches: Iterator[pd.DataFrame], at_once: int = 200) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PARSED.split(", ")]
    for batch in batches:
        rows = []
        for page_id, url, host, html in zip(batch["page_id"].tolist(), batch["url"], batch["host"], batch["html"], strict=True):
            p = best_page(html or "")
            rows.append((page_id, url, host, p.blocks, p.marks if any(p.marks) else None, p.paths, p.firsts, p.ends, p.helds, p.path))
            if len(rows) == at_once:
                yield as_frame(rows, names)
                rows = []
        yield as_frame(rows, names)


def as_frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["page_id"] = out["page_id"].astype("Int64")
    return out


def host_votes(parsed: DataFrame, least_share: float) -> DataFrame:
    """host, winners (numbers of its winning paths, most votes first), winning (the paths), agreed (paths of doubtful
    elements that stand on enough of the host's pages)."""
    named = parsed.where("host <> ''")
    votes = named.where("path IS NOT NULL").groupBy("host", F.col("paths")[0].alias("number")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    totals = votes.groupBy("host").agg(F.sum("n").alias("all_n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path", "number")))
    winners = votes.join(totals, "host").where(F.col("n") >= least_share * F.col("all_n")).groupBy("host").agg(ranked.alias("r"))
    winners = winners.select("host", F.col("r.number").alias("winners"), F.col("r.path").alias("winning"))
    pages = named.groupBy("host").agg(F.count("*").alias("pages"))
    doubts = named.where("marks IS NOT NULL").select("host", F.explode(F.array_distinct("marks")).alias("mark")).where("mark <> 0")
    doubts = doubts.groupBy("host", "mark").agg(F.count("*").alias("n")).join(pages, "host")
    agreed = doubts.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= AGREED * F.col("pages"))).groupBy("host").agg(F.collect_list("mark").alias("agreed"))
    return winners.join(agreed, "host", "left")


def extract_main(pages: DataFrame, least_share: float = 0.1, most_broadcast: int = 32_000_000) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    Each page votes for the path of its best container. A host's winning paths are those with at least
    least_share of its votes, most votes first; each page is then extracted by the first winning path
    that it has. Pages without a host or without any winning path go by their own best container. Elements whose names
    are doubtful (`related` and the like inside an article; a noisy word among others, as `sidebar-free`, anywhere) are dropped where
    at least half of the host's pages, and two, have one at that path, but for those that hold the container; else they stay.
    Pages are parsed once: their blocks are written to the shared folder (and stay there, as the result reads them). Votes are summed before
    the shuffle, so a hot host is a few rows there. The winners are broadcast if their measured size allows it,
    so that no page travels; else a hot host's pages are salted. Paths are compared as 64-bit numbers.
    Blocks are joined by one line feed in page order; white space within a block (br and no-break space
    included) becomes one space. Null or empty html gives an empty text. Repeated pages keep a row each; other columns of pages are
    dropped; ties between containers go to the one that begins first. A page is parsed with work in proportion to its length.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    parsed = written(rows.mapInPandas(parse_pages, PARSED))
    joined = joined_small(parsed, host_votes(parsed, least_share).drop("winning"), "host", most_broadcast)
    none = F.array().cast("array<bigint>")
    hit = F.get(F.filter(F.coalesce("winners", none), lambda w: F.array_contains("paths", w)), F.lit(0))
    joined = joined.withColumn("_at", F.coalesce(F.array_position("paths", hit) - 1, F.lit(0)).cast("int"))
    first = F.coalesce(F.get("firsts", F.col("_at")), F.lit(0))
    size = F.coalesce(F.get("ends", F.col("_at")), F.size("blocks")) - first
    inside, marks = F.slice("blocks", first + 1, size), F.slice("marks", first + 1, size)
    # a mark that the container itself has is of what holds it
    dropped = F.array_remove(F.coalesce("agreed", none), F.coalesce(F.get("helds", F.col("_at")), F.lit(0).cast("long")))
    clean = F.array_compact(F.zip_with(inside, marks, lambda b, m: F.when((m == 0) | ~F.array_contains(dropped, m), b)))
    text = F.array_join(F.when(F.col("marks").isNull(), inside).otherwise(clean), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(read(spark, sf_dir, "pages"))
