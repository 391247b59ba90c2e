"""Policies and web pages: text from html, cleaning, page signals, links, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clauseriver.functions import duck as D
from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.operators.detect import sentences_of
from clauseriver.sources import corpus as C

DROPPED = r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</(script|style|nav|header|footer|noscript)\s*>"
MAIN = [("main", r"(?is)<main\b[^>]*>(.*?)</main>"), ("article", r"(?is)<article\b[^>]*>(.*?)</article>"),
        ("role", r"(?is)<div\b[^>]*role=[\"']main[\"'][^>]*>(.*?)</div>"),
        ("class", r"(?is)<div\b[^>]*(?:class|id)=[\"'](?:terms|privacy|legal|policy|content|main-content|page-content|post-content|entry-content)[\"'][^>]*>(.*?)</div>")]


def read_policies(docs: DataFrame, min_chars: int = 100) -> DataFrame:
    return docs.where(F.length("text") >= min_chars)


def plain(html: Column) -> Column:
    """Tags become line feeds, runs of three or more line feeds two."""
    return T.strip(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", "\n"), r"\n{3,}", "\n\n"))


def pages_to_text(pages: DataFrame, cap: int = 120_000) -> DataFrame:
    """page_id, text without scripts, styles and page furniture. cap is the feature's limit; None keeps all."""
    text = plain(F.regexp_replace("html", DROPPED, ""))
    return pages.select("page_id", (F.substring(text, 1, cap) if cap else text).alias("text"))


def main_content(pages: DataFrame, min_chars: int = 500) -> DataFrame:
    """page_id, text of the first main container with more than min_chars, else of the whole page."""
    html = F.regexp_replace("html", DROPPED, "")
    tries = [plain(F.regexp_extract(html, p, 1)) for _, p in MAIN]
    return pages.select("page_id", F.coalesce(*[F.when(F.length(t) > min_chars, t) for t in tries], plain(html)).alias("text"))


def strip_cookie_banners(docs: DataFrame, min_hits: int = 3) -> DataFrame:
    """docs without the paragraphs that show min_hits signs of a cookie banner."""
    kept = F.filter(F.split("text", r"\n{2,}"), lambda p: T.count_matches(p, R.COOKIE_INDICATORS) < min_hits)
    possible = T.let(F.lower("text"), lambda low: sum((T.may_match(low, p).cast("int") for p in R.COOKIE_INDICATORS), F.lit(0)))
    # a text without the words of so many signs has no such paragraph
    return docs.withColumn("text", F.when(possible < min_hits, F.regexp_replace("text", r"\n{2,}", "\n\n")).otherwise(F.array_join(kept, "\n\n")))


def clean_page_text(docs: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("text", r"\n{3,}", "\n\n"), r"[ \t]{4,}", "   ")
    text = F.regexp_replace(text, r"(?im)^(Home|About|Contact|Sign in|Log in|Sign up|Menu|Search)\s*$", "")
    return docs.withColumn("text", T.strip(text))


def promote_tier(requests: DataFrame, limit: int = 30_000) -> DataFrame:
    long = F.coalesce("force", F.lit(False)) | (F.length("text") > limit)
    return requests.withColumn("tier", F.coalesce("tier", F.when(long, "deep").otherwise("quick")))


def exclude_blocked_hosts(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(~T.any_phrase(T.host(F.col(url)), R.BLOCKED_HOSTS))


def _has_keyword(text: Column) -> Column:
    return T.any_phrase(F.lower(F.coalesce(text, F.lit(""))), R.LEGAL_KEYWORDS)


def legal_page_score(pages: DataFrame, threshold: int = 30) -> DataFrame:
    """page_id, score and reasons of pages that look like legal pages. h2 counts only below 60 points."""
    s, html = R.PAGE_SIGNALS, F.coalesce("html", F.lit(""))
    tags = lambda t: F.array_join(F.regexp_extract_all(html, F.lit(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), 1), " ")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    modal = F.regexp_extract(html, r"(?is)<(?:dialog\b[^>]*open|[a-z]+[^>]*(?:role=[\"'](?:dialog|alertdialog)|class=[\"'][^\"']*(?:modal|dialog|overlay)))[^>]*>(.*?)</", 1)
    meta = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*(?:name=[\"']description|property=[\"']og:description)[\"'][^>]*>"), 0), " ")
    signs = [("url", T.any_match(path, R.LEGAL_URLS)), ("title", _has_keyword(tags("title"))), ("h1", _has_keyword(tags("h1")))]
    rows = pages.select("page_id", *[c.alias(f"_{n}") for n, c in signs], _has_keyword(tags("h2")).alias("_h2"), _has_keyword(modal).alias("_modal"), T.matches(html, R.COOKIE_BANNER).alias("_banner"), _has_keyword(meta).alias("_meta"))
    early = sum((F.when(F.col(f"_{n}"), s[n]).otherwise(0) for n, _ in signs), F.lit(0))
    rows = rows.withColumn("_h2", F.col("_h2") & (early < 60))
    named = [("url", "_url"), ("title", "_title"), ("h1", "_h1"), ("h2", "_h2"), ("modal", "_modal"), ("cookie-banner", "_banner"), ("meta", "_meta")]
    total = sum((F.when(F.col(c), s[n]).otherwise(0) for n, c in named), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in named]))
    return rows.select("page_id", total.alias("score"), reasons.alias("reasons")).where(F.col("score") >= threshold)


def is_pdf_url(url: Column) -> Column:
    return F.rlike(url, F.lit(r"(?i)\.pdf(\?.*)?$"))


def site_category(url: Column) -> Column:
    h = T.host(url)
    return F.coalesce(*[F.when(T.matches(h, p), F.lit(n)) for n, p in R.SITE_CATEGORIES.items()])


def chunk_documents(docs: DataFrame, size: int = 40_000, overlap: int = 5_000, max_chunks: int = 3) -> DataFrame:
    """doc_id, chunk_no, chunk_text: sentences packed up to size, each chunk begun with the last sentences of the
    one before (overlap characters at most). Texts up to 1.2 x size stay whole. The operator's own limit is
    max_chunks; None keeps every chunk.

    The fold over a text's sentences carries numbers only: how many characters lie before the sentence and before the chunk.
    Where a chunk is full, the sentences at its end are counted that the next one repeats. Texts are cut once, at the
    boundaries that it leaves: for each chunk its first new sentence, and how many before it are repeated.
    """
    sentences = F.filter(F.transform(F.split(F.regexp_replace("text", "([.!?])\\s+(?=[A-Z“‘\"])", "$1\n"), "\n"), T.strip), lambda s: s != "")

    def state(n: Column, p: Column, base: Column, first: Column, marks: Column) -> Column:
        """n: sentences so far; p: their characters, each with a space; base: characters before the chunk; first: its first new sentence."""
        return F.struct(n.cast("int").alias("n"), p.cast("long").alias("p"), base.cast("long").alias("base"), first.cast("int").alias("first"), marks.alias("marks"))

    def mark(first: Column, again: Column) -> Column:
        return F.array(F.struct(first.cast("int").alias("first"), again.cast("int").alias("again")))

    def repeated(s: Column) -> Column:
        """How many of the chunk's new sentences at its end fit into the overlap, and their characters."""
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("p"), F.lit(True).alias("open"))

        def one(t: Column, x: Column) -> Column:
            fits = t["open"] & (t["p"] + F.length(x) + 1 <= overlap)
            return F.struct((t["n"] + fits.cast("int")).alias("n"), F.when(fits, t["p"] + F.length(x) + 1).otherwise(t["p"]).alias("p"), fits.alias("open"))

        return F.aggregate(F.reverse(F.slice("_s", s["first"] + 1, s["n"] - s["first"])), zero, one)

    def step(s: Column, x: Column) -> Column:
        after = s["p"] + F.length(x) + 1
        again = lambda r: state(s["n"] + 1, after, s["p"] - r["p"], s["n"], F.concat(s["marks"], mark(s["n"], r["n"])))
        return F.when((s["n"] > 0) & (after - s["base"] > size), T.let(repeated(s), again)).otherwise(state(s["n"] + 1, after, s["base"], s["first"], s["marks"]))

    begin = state(F.lit(0), F.lit(0), F.lit(1), F.lit(0), mark(F.lit(0), F.lit(0)))
    whole = F.length("text") <= int(size * 1.2)
    rows = docs.select("doc_id", "text", F.when(~whole, sentences).alias("_s")).withColumn("_m", F.when(F.size("_s") > 0, F.aggregate("_s", begin, step, lambda s: s["marks"])))
    rows = rows.withColumn("_m", F.slice("_m", 1, max_chunks + 1) if max_chunks else F.col("_m"))

    def cut(m: Column, i: Column) -> Column:
        new = F.slice("_s", m["first"] + 1, F.coalesce(F.get("_m", i + 1)["first"], F.size("_s")) - m["first"])
        again = F.slice("_s", m["first"] - m["again"] + 1, m["again"])
        return F.concat(F.when(m["again"] > 0, F.concat(F.array_join(again, " "), F.lit("  "))).otherwise(""), F.array_join(new, " "))

    chunks = F.when(whole, F.array("text")).otherwise(F.transform("_m", cut))
    chunks = F.slice(chunks, 1, max_chunks) if max_chunks else chunks
    return rows.select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk_text"))


def segment_fixed(docs: DataFrame, n: int = 512, cap: int | None = 5_000) -> DataFrame:
    """doc_id, segment_no, segment: slices of n characters (of the first cap; None: of all)."""
    size = F.least(F.length("text"), F.lit(cap)) if cap else F.length("text")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    rows = docs.select("doc_id", "text", size.alias("_size"), F.posexplode(starts).alias("segment_no", "_at"))
    return rows.select("doc_id", "segment_no", F.substring("text", F.col("_at") + 1, F.least(F.lit(n), F.col("_size") - F.col("_at"))).alias("segment"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, link_no, path, label of links to the page's own site: as written, lower-cased, no closing slash."""
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    found = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?href=[\"']([^\"']*)[\"'][^>]*>.*?</a>"), 0)
    rows = pages.select("page_id", "url", origin.alias("_o"), F.posexplode(found).alias("link_no", "_a"))
    href = F.regexp_extract("_a", r"(?is)href=[\"']([^\"']*)[\"']", 1)
    label = F.lower(T.strip(F.regexp_replace("_a", r"(?s)<[^>]*>", "")))
    local = F.when(F.startswith(href, F.col("_o")), F.substring(href, F.length("_o") + 1, F.length(href))).when(F.startswith(href, F.lit("/")), href)
    path = F.regexp_replace(F.lower(F.regexp_extract(local, r"^([^?#]*)", 1)), "/$", "")
    own = F.regexp_replace(F.lower(T.url_path(F.col("url"))), "/$", "")
    rows = rows.select("page_id", "link_no", "_o", path.alias("path"), label.alias("label"), own.alias("_own"))
    return rows.where("path IS NOT NULL AND path <> '' AND path <> _own").select("page_id", "link_no", F.col("_o").alias("origin"), "path", "label")


def legal_links(pages: DataFrame, keep: int = 5) -> DataFrame:
    """page_id, rank, url, label: the first `keep` different paths with a legal keyword."""
    rows = links(pages)
    hay = F.concat("path", F.lit(" "), "label")
    legal = T.any_phrase(F.col("path"), R.LINK_KEYWORDS) | T.any_phrase(F.col("label"), R.LINK_KEYWORDS)
    blocked = T.any_phrase(hay, R.LINK_BLOCKLIST) & ~T.any_phrase(hay, R.LINK_KEYWORDS)
    first = rows.where(legal & ~blocked).groupBy("page_id", "path").agg(F.min(F.struct("link_no", "origin", "label")).alias("l"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("l.link_no"))
    return first.withColumn("rank", rank).where(F.col("rank") <= keep).select("page_id", "rank", F.concat("l.origin", "path").alias("url"), F.col("l.label").alias("label"))


def policy_suite(pages: DataFrame, found: DataFrame, cap: int = 40_000, min_chars: int = 500) -> DataFrame:
    """page_id, text: a page's own text and that of the legal pages that its links (page_id, rank, url, label) name."""
    texts = pages_to_text(pages, None)
    body = pages.select("page_id", F.regexp_replace(F.lower(F.regexp_extract("url", r"^([^?#]*)", 1)), "/$", "").alias("_u")).join(texts, "page_id")
    target = body.where(F.length("text") > min_chars).groupBy("_u").agg(F.min_by(F.substring("text", 1, cap), "page_id").alias("_t"))
    rows = found.withColumn("_u", F.lower("url")).join(target, "_u")
    part = F.concat(F.lit("\n\n=== PAGE: "), F.col("url"), F.lit(" ("), F.col("label"), F.lit(") ===\n"), F.col("_t"))
    suites = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda r: r["t"]), "\n").alias("_s"))
    own = pages.select("page_id", "url").join(texts, "page_id").join(suites, "page_id", "left")
    text = F.when(F.col("_s").isNotNull(), F.concat(F.lit("=== PAGE: "), F.col("url"), F.lit(" ===\n"), F.col("text"), F.lit("\n"), F.col("_s"))).otherwise(F.col("text"))
    return own.select("page_id", text.alias("text"))


def stitch_pages(pages: DataFrame, max_pages: int = 8) -> DataFrame:
    """page_id, n_pages, text of a page and those that follow it by next_url, each at most once.

    pages has page_id, url (unique), text, next_url. One self-join of urls for each further page, a bounded chain;
    texts are joined once, when all chains are known.
    """
    nodes = pages.select(F.col("url").alias("_u"), F.col("next_url").alias("_n"))
    rows = pages.select("page_id", F.array("url").alias("seen"), F.col("next_url").alias("next"))
    for _ in range(max_pages - 1):
        more = rows.join(nodes, (F.col("next") == F.col("_u")) & ~F.array_contains("seen", F.col("_u")), "left")
        go = F.col("_u").isNotNull()
        rows = more.select("page_id", F.when(go, F.concat("seen", F.array("_u"))).otherwise(F.col("seen")).alias("seen"), F.when(go, F.col("_n")).alias("next"))
    parts = rows.select("page_id", F.posexplode("seen").alias("at", "url")).join(pages.select("url", "text"), "url")
    whole = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return whole.select("page_id", F.size("parts").alias("n_pages"), F.array_join("parts.text", "\n\n--- [Page Break] ---\n\n").alias("text"))


# -- queries ------------------------------------------------------------------------------------------


def _docs(run):
    return lambda s, d: run(C.policies(s, d))


def _pages(run):
    return lambda s, d: run(C.read(s, d, "pages"))


BANNER = "We use targeting cookies and performance cookies.\nReject all cookies or set your cookie preferences."


def _banner(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.concat("text", F.lit("\n\n"), F.when(F.col("doc_id") % 2 == 0, F.lit(BANNER)).otherwise(F.lit("Set your cookie preferences here.")), F.lit("\n\n\n\nMenu\nTail    \t end.  ")))


def _legal_pages(pages: DataFrame) -> DataFrame:
    """The given pages with a legal url, heading or banner on some."""
    n = F.col("page_id")
    extra = F.when(n % 3 == 0, F.lit('<h2>Terms of Service</h2><a href="/legal/privacy">Privacy policy</a><a href="/help/">Help</a><a href="/legal/terms/">Terms</a>')).when(n % 3 == 1, F.lit('<meta name="description" content="our cookie policy"><div id="cookie-banner">x</div><a href="/tos?x=1">The rules</a>')).otherwise(F.lit("<h1>End User License</h1>"))
    return pages.select("page_id", F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.when(n % 4 == 0, F.lit("/terms_of_use")).otherwise(F.lit(""))).alias("url"), F.concat(F.col("html"), extra).alias("html"))


def _suite(pages: DataFrame) -> DataFrame:
    """Each page linked to the two with the next ids."""
    links_ = pages.select((F.col("page_id") - 1).alias("page_id"), F.lit(1).alias("rank"), "url").union(pages.select((F.col("page_id") - 2).alias("page_id"), F.lit(2).alias("rank"), "url"))
    plain_urls = pages.withColumn("url", F.concat(F.lit("https://site.example/p"), F.col("page_id").cast("string")))
    links_ = links_.withColumn("url", F.concat(F.lit("https://site.example/p"), (F.col("page_id") + F.col("rank")).cast("string"))).withColumn("label", F.lit("terms"))
    return policy_suite(plain_urls, links_)


def _stitch(pages: DataFrame) -> DataFrame:
    url = lambda c: F.concat(F.lit("p"), c.cast("string"))
    n = F.col("page_id")
    nodes = pages.select("page_id", url(n).alias("url"), F.col("html").alias("text"), F.when(n % 10 == 9, url(n - 4)).when(n % 7 != 0, url(n + 1)).alias("next_url"))
    return stitch_pages(nodes).select("page_id", "n_pages", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


QUERIES = {
    "a1_read_policies": _docs(lambda d: read_policies(d, 400).select("doc_id", F.length("text").alias("n"))),
    "a2_pages_to_text": _pages(pages_to_text),
    "a3_main_content": _pages(main_content),
    "b1_strip_cookie_banners": _docs(lambda d: strip_cookie_banners(_banner(d)).select("doc_id", "text")),
    "b2_clean_page_text": _docs(lambda d: clean_page_text(_banner(d)).select("doc_id", "text")),
    "b3_promote_tier": _docs(lambda d: promote_tier(d.withColumn("tier", F.when(F.col("doc_id") % 4 == 0, "quick")).withColumn("force", F.col("doc_id") % 5 == 0), 2000).select("doc_id", "tier")),
    "b4_exclude_blocked_hosts": _docs(lambda d: exclude_blocked_hosts(d).select("doc_id", "url")),
    "b5_legal_page_score": _pages(lambda p: legal_page_score(_legal_pages(p)).select("page_id", "score", F.array_join("reasons", ",").alias("reasons"))),
    "b6_is_pdf_url": _docs(lambda d: d.select("doc_id", is_pdf_url(F.col("url")).alias("is_pdf"))),
    "b16_site_category": _docs(lambda d: d.select("doc_id", site_category(F.col("url")).alias("category"))),
    "c3_chunk_documents": _docs(lambda d: chunk_documents(d, 400, 50, None)),
    "c4_segment_fixed": _docs(lambda d: segment_fixed(d, 512, None)),
    "c5_legal_links": _pages(lambda p: legal_links(_legal_pages(p))),
    "c6_policy_suite": _pages(lambda p: _suite(p).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))),
    "c7_stitch_pages": _pages(_stitch),
}
_drop = f"regexp_replace(html, {D.lit(DROPPED)}, '', 'g')"


def _plain_sql(h: str) -> str:
    return D.strip(rf"regexp_replace(regexp_replace({h}, '(?s)<[^>]*>', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_banner_sql = f"""{C.POLICIES_SQL}, b AS (SELECT doc_id, text || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN {D.lit(BANNER)} ELSE 'Set your cookie preferences here.' END
  || chr(10) || chr(10) || chr(10) || chr(10) || 'Menu' || chr(10) || 'Tail    ' || chr(9) || ' end.  ' AS text FROM policies)"""
_legal_sql = """lp AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN page_id % 4 = 0 THEN '/terms_of_use' ELSE '' END AS url, html ||
  CASE page_id % 3 WHEN 0 THEN '<h2>Terms of Service</h2><a href="/legal/privacy">Privacy policy</a><a href="/help/">Help</a><a href="/legal/terms/">Terms</a>'
  WHEN 1 THEN '<meta name="description" content="our cookie policy"><div id="cookie-banner">x</div><a href="/tos?x=1">The rules</a>' ELSE '<h1>End User License</h1>' END AS html FROM pages)"""


def _tags_sql(t: str) -> str:
    return D.any_in(rf"lower(array_to_string(regexp_extract_all(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1), ' '))", R.LEGAL_KEYWORDS)


_path = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
_meta = r"""regexp_extract_all(html, '(?is)<meta\b[^>]*(?:name=["'']description|property=["'']og:description)["''][^>]*>', 0)"""
_modal = r"""regexp_extract(html, '(?is)<(?:dialog\b[^>]*open|[a-z]+[^>]*(?:role=["''](?:dialog|alertdialog)|class=["''][^"'']*(?:modal|dialog|overlay)))[^>]*>(.*?)</', 1)"""
def _chunks_sql(size: int, overlap: int, source: str = "policies") -> str:
    """Chunks by boundaries: from each chunk's first new sentence, the next chunk's is the first whose end lies beyond the size."""
    cut = "regexp_replace(text, '([.!?])\\s+([A-Z“‘\"])', '\\1' || chr(10) || '\\2', 'g')"
    return f"""
c3_lists AS (SELECT doc_id, list_filter(list_transform(string_split({cut}, chr(10)), lambda s: {D.strip("s")}), lambda s: s <> '') AS list FROM {source} WHERE length(text) > {int(size * 1.2)}),
c3_rows AS (SELECT doc_id, unnest(range(0, len(list))) AS i, unnest(list) AS s FROM c3_lists),
c3_ends AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c3_rows),
c3_sent AS (SELECT a.doc_id, a.i, any_value(a.s) AS s, any_value(a.p) AS p, any_value(a.p) - length(any_value(a.s)) - 1 AS q, coalesce(min(b.p - length(b.s) - 1), any_value(a.p)) AS again
  FROM c3_ends a LEFT JOIN c3_ends b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.p - (b.p - length(b.s) - 1) <= {overlap} GROUP BY a.doc_id, a.i),
c3_next AS (SELECT *, lag(again) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c3_sent),
c3_chunks AS (
  SELECT doc_id, 0 AS c, CAST(0 AS BIGINT) AS f, CAST(1 AS BIGINT) AS base, CAST(0 AS BIGINT) AS q FROM c3_sent WHERE i = 0
  UNION ALL
  SELECT r.doc_id, r.c + 1, CAST(min(n.i) AS BIGINT), CAST(arg_min(greatest(r.q, n.before), n.i) AS BIGINT), CAST(arg_min(n.q, n.i) AS BIGINT)
  FROM c3_chunks r JOIN c3_next n ON n.doc_id = r.doc_id AND n.i > r.f AND n.p - r.base > {size} GROUP BY r.doc_id, r.c),
c3_spans AS (SELECT *, coalesce(lead(f) OVER (PARTITION BY doc_id ORDER BY c), 1000000000000) AS g FROM c3_chunks),
c3_texts AS (
  SELECT x.doc_id, c AS chunk_no, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (i < f) || '  ', '') || string_agg(s, ' ' ORDER BY i) FILTER (i >= f) AS chunk_text
  FROM c3_spans x JOIN c3_sent n ON n.doc_id = x.doc_id AND n.i < x.g AND (n.i >= x.f OR x.c > 0 AND n.q >= x.base) GROUP BY x.doc_id, c),
c3 AS (SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk_text FROM c3_texts UNION ALL SELECT doc_id, 0, text FROM {source} WHERE length(text) <= {int(size * 1.2)})"""


ORACLES = {
    "c3_chunk_documents": f"WITH RECURSIVE {C.POLICIES_SQL}, {_chunks_sql(400, 50)} SELECT doc_id, chunk_no, chunk_text FROM c3",
    "a1_read_policies": f"WITH {C.POLICIES_SQL} SELECT doc_id, length(text) AS n FROM policies WHERE length(text) >= 400",
    "a2_pages_to_text": f"SELECT page_id, substr({_plain_sql(_drop)}, 1, 120000) AS text FROM pages",
    "a3_main_content": f"""WITH h AS (SELECT page_id, {_drop} AS html FROM pages), t AS (SELECT page_id, {", ".join(f"{_plain_sql(f'regexp_extract(html, {D.lit(p)}, 1)')} AS {n}_" for n, p in MAIN)}, {_plain_sql("html")} AS body FROM h)
    SELECT page_id, CASE {" ".join(f"WHEN length({n}_) > 500 THEN {n}_" for n, _ in MAIN)} ELSE body END AS text FROM t""",
    "b1_strip_cookie_banners": f"WITH {_banner_sql} SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: {D.count_rx('p', R.COOKIE_INDICATORS)} < 3), chr(10) || chr(10)) AS text FROM b",
    "b2_clean_page_text": rf"""WITH {_banner_sql} SELECT doc_id, {D.strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{4,}', '   ', 'g'), '(?im)^(Home|About|Contact|Sign in|Log in|Sign up|Menu|Search)\s*$', '', 'g')")} AS text FROM b""",
    "b3_promote_tier": f"WITH {C.POLICIES_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'quick' WHEN doc_id % 5 = 0 OR length(text) > 2000 THEN 'deep' ELSE 'quick' END AS tier FROM policies",
    "b4_exclude_blocked_hosts": f"WITH {C.POLICIES_SQL} SELECT doc_id, url FROM policies WHERE NOT {D.any_in(D.host('url'), R.BLOCKED_HOSTS)}",
    "b5_legal_page_score": f"""WITH {_legal_sql}, s AS (SELECT page_id, {D.any_rx(_path, R.LEGAL_URLS)} AS u, {_tags_sql("title")} AS t, {_tags_sql("h1")} AS h1, {_tags_sql("h2")} AS h2,
      {D.any_in(f"lower({_modal})", R.LEGAL_KEYWORDS)} AS mo, {D.rx("html", R.COOKIE_BANNER)} AS cb, {D.any_in(f"lower(array_to_string({_meta}, ' '))", R.LEGAL_KEYWORDS)} AS me FROM lp),
    k AS (SELECT *, h2 AND 40 * u::INT + 25 * t::INT + 20 * h1::INT < 60 AS g2 FROM s),
    z AS (SELECT page_id, 40 * u::INT + 25 * t::INT + 20 * h1::INT + 15 * g2::INT + 30 * mo::INT + 20 * cb::INT + 10 * me::INT AS score,
      concat_ws(',', CASE WHEN u THEN 'url' END, CASE WHEN t THEN 'title' END, CASE WHEN h1 THEN 'h1' END, CASE WHEN g2 THEN 'h2' END, CASE WHEN mo THEN 'modal' END, CASE WHEN cb THEN 'cookie-banner' END, CASE WHEN me THEN 'meta' END) AS reasons FROM k)
    SELECT * FROM z WHERE score >= 30""",
    "b6_is_pdf_url": f"WITH {C.POLICIES_SQL} SELECT doc_id, regexp_matches(url, '(?i)\\.pdf(\\?.*)?$') AS is_pdf FROM policies",
    "b16_site_category": f"WITH {C.POLICIES_SQL} SELECT doc_id, CASE {' '.join(f'WHEN {D.rx(D.host("url"), p)} THEN {D.lit(n)}' for n, p in R.SITE_CATEGORIES.items())} END AS category FROM policies",
    "c4_segment_fixed": f"WITH {C.POLICIES_SQL}, s AS (SELECT doc_id, text, unnest(range(0, length(text), 512)) AS pos FROM policies) SELECT doc_id, pos // 512 AS segment_no, substr(text, pos + 1, 512) AS segment FROM s",
    "c5_legal_links": rf"""WITH {_legal_sql}, a AS (SELECT page_id, url, unnest(range(0, len(l))) AS link_no, unnest(l) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?href=["''][^"'']*["''][^>]*>.*?</a>', 0) AS l FROM lp)),
    h AS (SELECT page_id, link_no, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS o, regexp_extract(a, '(?is)href=["'']([^"'']*)["'']', 1) AS href, lower({D.strip("regexp_replace(a, '(?s)<[^>]*>', '', 'g')")}) AS label FROM a),
    p AS (SELECT *, regexp_replace(lower(regexp_extract(CASE WHEN starts_with(href, o) THEN substr(href, length(o) + 1) WHEN starts_with(href, '/') THEN href END, '^([^?#]*)', 1)), '/$', '') AS path, regexp_replace(lower({D.url_path("url")}), '/$', '') AS own FROM h),
    k AS (SELECT page_id, path, min(link_no) AS link_no, arg_min(o, link_no) AS o, arg_min(label, link_no) AS label FROM p WHERE path <> '' AND path <> own AND ({D.any_in("path", R.LINK_KEYWORDS)} OR {D.any_in("label", R.LINK_KEYWORDS)})
      AND NOT ({D.any_in("path || ' ' || label", R.LINK_BLOCKLIST)} AND NOT {D.any_in("path || ' ' || label", R.LINK_KEYWORDS)}) GROUP BY page_id, path),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link_no) AS rank FROM k) SELECT page_id, rank, o || path AS url, label FROM r WHERE rank <= 5""",
    "c6_policy_suite": f"""WITH t AS (SELECT page_id, {_plain_sql(_drop)} AS text FROM pages), l AS (SELECT a.page_id, r AS rank, b.text, b.page_id AS target FROM t a, (VALUES (1), (2)) v(r), t b WHERE b.page_id = a.page_id + r AND length(b.text) > 500),
    s AS (SELECT page_id, string_agg(chr(10) || chr(10) || '=== PAGE: https://site.example/p' || target || ' (terms) ===' || chr(10) || substr(text, 1, 40000), chr(10) ORDER BY rank) AS s FROM l GROUP BY page_id),
    f AS (SELECT page_id, CASE WHEN s IS NOT NULL THEN '=== PAGE: https://site.example/p' || page_id || ' ===' || chr(10) || text || chr(10) || s ELSE text END AS text FROM t LEFT JOIN s USING (page_id))
    SELECT page_id, length(text) AS n_chars, sha256(text) AS sha FROM f""",
    "c7_stitch_pages": """WITH RECURSIVE n AS (SELECT page_id, 'p' || page_id AS url, html AS text, CASE WHEN page_id % 10 = 9 THEN 'p' || (page_id - 4) WHEN page_id % 7 <> 0 THEN 'p' || (page_id + 1) END AS next_url FROM pages),
    r AS (SELECT page_id, [url] AS seen, next_url FROM n
      UNION ALL SELECT r.page_id, list_append(seen, n.url), n.next_url FROM r JOIN n ON r.next_url = n.url WHERE NOT list_contains(seen, n.url) AND len(seen) < 8),
    c AS (SELECT page_id, unnest(seen) AS url, unnest(range(0, len(seen))) AS k FROM (SELECT page_id, arg_max(seen, len(seen)) AS seen FROM r GROUP BY page_id)),
    t AS (SELECT c.page_id, count(*) AS n_pages, string_agg(text, chr(10) || chr(10) || '--- [Page Break] ---' || chr(10) || chr(10) ORDER BY k) AS text FROM c JOIN n USING (url) GROUP BY c.page_id)
    SELECT page_id, n_pages, length(text) AS n_chars, sha256(text) AS sha FROM t""",
}
