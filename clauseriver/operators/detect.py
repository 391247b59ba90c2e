"""Detection scans: rules over policy texts.

Each scan reads a text once, in one projection, and leaves only hits; findings (document x pillar)
join those slim hits, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseriver.functions import duck as D
from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.sources import corpus as C

KEY = ["doc_id", "pillar"]


def _by_pillar(docs: DataFrame, of_pillar, pillars=R.PILLARS) -> DataFrame:
    """A row for each document and pillar, with the struct that of_pillar gives."""
    rows = F.array(*[F.struct(F.lit(p).alias("pillar"), of_pillar(p).alias("hit")) for p in pillars])
    return docs.select("doc_id", F.inline(rows)).select("doc_id", "pillar", "hit.*")


# -- splitting ----------------------------------------------------------------------------------------


def sentences_of(text: Column, mode: str = "simple") -> Column:
    """simple: cut after . ! ? ; and white space, 30 to 600 characters. strict: cut after . ! ? only where an
    upper-case letter or a quote follows, 20 to 1000."""
    if mode == "simple":
        cut, low, high = F.regexp_replace(text, r"([.!?;])\s+", "$1\n"), 30, 600
    else:
        cut, low, high = F.regexp_replace(text, "([.!?])\\s+(?=[A-Z“‘\"])", "$1\n"), 20, 1000
    trimmed = F.transform(F.split(cut, "\n"), T.strip)
    return F.filter(trimmed, lambda s: F.length(s).between(low, high))


def split_sentences(docs: DataFrame, mode: str = "simple") -> DataFrame:
    """doc_id, sent_no (from 0), sentence."""
    return docs.select("doc_id", F.posexplode(sentences_of(F.col("text"), mode)).alias("sent_no", "sentence"))


def _sentences_sql(mode: str) -> str:
    if mode == "simple":
        cut, low, high = r"regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g')", 30, 600
    else:
        cut, low, high = "regexp_replace(text, '([.!?])\\s+([A-Z“‘\"])', '\\1' || chr(10) || '\\2', 'g')", 20, 1000
    s = f"list_filter(list_transform(string_split({cut}, chr(10)), lambda s: {D.strip('s')}), lambda s: length(s) BETWEEN {low} AND {high})"
    return f"""
sent_lists AS (SELECT doc_id, {s} AS list FROM policies),
sentences AS (SELECT doc_id, unnest(range(0, len(list))) AS sent_no, unnest(list) AS sentence FROM sent_lists)"""


# -- D1, D11: sentence rules --------------------------------------------------------------------------


def _first_violation(sentences: Column, low: Column, pillar: str) -> Column:
    """(pattern, sentence) of the first pattern, in order, that has a sentence; a null struct if none has.

    low is the whole text in lower case: sentences are only looked at for patterns that it may match.
    """
    tries = []
    for i, (p, negatable) in enumerate(R.HARD_VIOLATIONS[pillar]):
        tries.append(F.when(T.may_match(low, p), _violation(sentences, i, p, negatable)))
    return F.coalesce(*tries)


def _violation(sentences: Column, i: int, p: str, negatable: bool) -> Column:
    def fits(s: Column) -> Column:
        hit = T.matches(s, p)
        return hit & ~T.strong_negation(s) if negatable else hit

    found = F.filter(sentences, fits)
    return F.when(F.size(found) > 0, F.struct(F.lit(i).alias("pattern_ord"), F.get(found, F.lit(0)).alias("sentence")))


def hard_violation_hits(docs: DataFrame) -> DataFrame:
    """doc_id, pillar, pattern_ord, sentence: the first pattern with a sentence that isn't negated."""
    cut = docs.select("doc_id", sentences_of(F.col("text"), "strict").alias("s"), F.lower("text").alias("low"))
    hits = _by_pillar(cut, lambda p: _first_violation(F.col("s"), F.col("low"), p), list(R.HARD_VIOLATIONS))
    return hits.where("pattern_ord IS NOT NULL")


def hard_violations(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings that are clear, or violated with LOW confidence, become HIGH violations where a sentence proves it."""
    hits = hard_violation_hits(docs).withColumn("quote", T.cap_words(F.col("sentence")))
    joined = findings.join(hits.select(*KEY, "quote"), KEY, "left")
    up = F.col("quote").isNotNull() & ~(F.col("violation") & (F.col("confidence") != "LOW"))
    return joined.select(
        *[c for c in findings.columns if c not in ("violation", "confidence", "citation")],
        (F.col("violation") | up).alias("violation"),
        F.when(up, "HIGH").otherwise(F.col("confidence")).alias("confidence"),
        F.when(up, F.col("quote")).otherwise(F.col("citation")).alias("citation"),
    )


def _hard_sql(rules: dict = R.HARD_VIOLATIONS) -> str:
    cases = []
    for p, patterns in rules.items():
        first = " ".join(
            f"WHEN {D.rx('sentence', x)}" + (f" AND NOT {D.rx('sentence', R.STRONG_NEGATION)}" if neg else "") + f" THEN {i}"
            for i, (x, neg) in enumerate(patterns)
        )
        # the least pattern of a sentence isn't enough: an earlier one may be barred by a negation, which CASE passes over
        cases.append(f"SELECT doc_id, '{p}' AS pillar, CASE {first} END AS pattern_ord, sent_no, sentence FROM sentences")
    return f"""
hard_all AS ({" UNION ALL ".join(cases)}),
hard AS (SELECT doc_id, pillar, min(pattern_ord) AS pattern_ord, arg_min(sentence, pattern_ord * 100000 + sent_no) AS sentence
  FROM hard_all WHERE pattern_ord IS NOT NULL GROUP BY ALL)"""


def _best_sentence(sentences: Column, low: Column, pillar: str, least: int) -> Column:
    """The sentence with most points, in texts (low: in lower case) that have what it takes for `least` points at all."""
    patterns = [(p, n) for kind, n in (("high", 3), ("low", 1)) for p in R.BACKFILL[pillar][kind]]

    def points(of: Callable[[int, str], Column]) -> Column:
        return sum((of(i, p).cast("int") * n for i, (p, n) in enumerate(patterns)), F.lit(0))

    def best(may: Column) -> Column:
        scored = F.transform(sentences, lambda s, i: F.struct(points(lambda k, p: may[k] & T.matches(s, p)).alias("score"), (-i).alias("earlier"), s.alias("sentence")))
        return F.when(points(lambda k, _: may[k]) >= least, F.array_max(scored))

    # what the whole text has is asked once, not for each sentence
    return T.let(F.array(*[T.may_match(low, p) for p, _ in patterns]), best)


def backfill_citations(findings: DataFrame, docs: DataFrame, min_score: int = 6) -> DataFrame:
    """Clean findings without a citation get the sentence with most keyword points, if it has min_score."""
    cut = docs.select("doc_id", sentences_of(F.col("text")).alias("s"), F.lower("text").alias("low"))
    best = _by_pillar(cut, lambda p: _best_sentence(F.col("s"), F.col("low"), p, min_score)).where(F.col("score") >= min_score)
    joined = findings.join(best.select(*KEY, T.cap_words(F.col("sentence")).alias("quote")), KEY, "left")
    empty = F.trim(F.coalesce("citation", F.lit(""))).isin(R.NOT_FOUND, "", R.NOT_ADDRESSED)
    fill = ~F.col("violation") & empty & F.col("quote").isNotNull()
    return joined.withColumn("citation", F.when(fill, F.col("quote")).otherwise(F.col("citation"))).drop("quote")


def _backfill_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS pillar, sent_no, sentence, 3 * {D.count_rx('sentence', w['high'])} + {D.count_rx('sentence', w['low'])} AS score FROM sentences"
        for p, w in R.BACKFILL.items()
    )
    return f"""
scored AS ({rows}),
best AS (SELECT doc_id, pillar, arg_max(sentence, score * 1000000 - sent_no) AS sentence FROM scored WHERE score >= 6 GROUP BY ALL)"""


# -- D2: phrases --------------------------------------------------------------------------------------


def phrase_hits(docs: DataFrame) -> DataFrame:
    """doc_id, pillar, phrase (the first unambiguous one), standard_hits."""
    low = docs.select("doc_id", F.lower("text").alias("t"))

    def of(p: str) -> Column:
        first = F.coalesce(*[F.when(F.contains("t", F.lit(x)), F.lit(x)) for x in R.HIGH_PHRASES.get(p, [])], F.lit(None).cast("string"))
        return F.struct(first.alias("phrase"), T.count_phrases(F.col("t"), R.STANDARD_PHRASES[p]).alias("standard_hits"))

    return _by_pillar(low, of)


def cross_check(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """An unambiguous phrase makes a violation and confirms it; two standard ones confirm an existing one."""
    joined = findings.join(phrase_hits(docs), KEY, "left")
    forced = F.col("phrase").isNotNull() & ~F.col("violation")
    confirmed = F.col("phrase").isNotNull() | (F.col("violation") & (F.coalesce("standard_hits", F.lit(0)) >= 2))
    return joined.select(
        *[c for c in findings.columns if c not in ("violation", "confidence", "citation")],
        (F.col("violation") | forced).alias("violation"),
        F.when(forced, "HIGH").otherwise(F.col("confidence")).alias("confidence"),
        F.when(forced, F.col("phrase")).otherwise(F.col("citation")).alias("citation"),
        confirmed.alias("confirmed"),
    )


def _cross_sql(source: str = "findings") -> str:
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS pillar, "
        + (("CASE " + " ".join(f"WHEN contains(t, {D.lit(x)}) THEN {D.lit(x)}" for x in R.HIGH_PHRASES[p]) + " END") if p in R.HIGH_PHRASES else "NULL")
        + f" AS phrase, {D.count_in('t', R.STANDARD_PHRASES[p])} AS standard_hits FROM low"
        for p in R.PILLARS
    )
    return f"""
low AS (SELECT doc_id, lower(text) AS t FROM policies), phrases AS ({rows}),
crossed AS (
  SELECT f.doc_id, f.pillar, f.pillar_ord, violation OR phrase IS NOT NULL AS violation,
    CASE WHEN phrase IS NOT NULL AND NOT violation THEN 'HIGH' ELSE confidence END AS confidence,
    CASE WHEN phrase IS NOT NULL AND NOT violation THEN phrase ELSE citation END AS citation,
    phrase IS NOT NULL OR (violation AND standard_hits >= 2) AS confirmed
  FROM {source} f JOIN phrases USING (doc_id, pillar))"""


# -- D3, D4, D5, D12: patterns over the whole text ----------------------------------------------------


def _with_low(docs: DataFrame) -> DataFrame:
    """doc_id and text, also in lower case."""
    return docs.select("doc_id", "text", F.lower("text").alias("low"))


def _quoted(text: Column, low: Column, patterns: list[str], variant: str, least: int = 0) -> Column:
    """(pattern_ord, quote) of the first pattern that occurs with a quote of at least `least` characters."""
    return F.coalesce(*[F.when(T.may_match(low, p) & T.matches(text, p), _hit(i, T.quote_around(text, p, variant), least)) for i, p in enumerate(patterns)])


def _hit(i: int, quote: Column, least: int) -> Column:
    def struct(q: Column) -> Column:
        row = F.struct(F.lit(i).alias("pattern_ord"), q.alias("quote"))
        return F.when(F.length(q) >= least, row) if least else row

    return T.let(quote, struct)


def denial_hits(docs: DataFrame) -> DataFrame:
    return _by_pillar(_with_low(docs), lambda p: _quoted(F.col("text"), F.col("low"), R.DENIALS[p], "denial")).where("pattern_ord IS NOT NULL")


def denial_veto(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """An explicit denial clears its pillar (MEDIUM if it is conditional); every finding gets a status."""
    return vetoed(findings.join(denial_hits(docs).select(*KEY, F.lit(True).alias("denied"), "quote"), KEY, "left"), findings.columns)


def vetoed(joined: DataFrame, columns: list[str]) -> DataFrame:
    """denial_veto of findings that have denied and quote beside them."""
    denied = F.coalesce("denied", F.lit(False))
    conditional = denied & T.conditional_denial(F.coalesce("quote", F.lit("")))
    return joined.select(
        *[c for c in columns if c not in ("violation", "confidence", "citation", "status")],
        (F.col("violation") & ~denied).alias("violation"),
        F.when(conditional, "MEDIUM").when(denied, "HIGH").otherwise(F.col("confidence")).alias("confidence"),
        F.when(denied & (F.col("quote") != ""), F.col("quote")).otherwise(F.col("citation")).alias("citation"),
        F.when(denied, "EXPLICITLY_DENIES").when(F.col("violation"), "VIOLATES").otherwise("NOT_MENTIONED").alias("status"),
        conditional.alias("conditional_denial"),
    )


def count_denials(docs: DataFrame) -> DataFrame:
    """doc_id, n: pillars with an explicit denial."""
    def any_of(ps: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [T.may_match(F.col("low"), p) & T.matches(F.col("text"), p) for p in ps])

    n = sum((any_of(ps).cast("int") for ps in R.DENIALS.values()), F.lit(0))
    return _with_low(docs).select("doc_id", n.cast("long").alias("n"))


def clause_hits(docs: DataFrame) -> DataFrame:
    """doc_id, pillar, pattern_ord, quote of the first clause pattern with a quote of 20 characters or more."""
    return _by_pillar(_with_low(docs), lambda p: _quoted(F.col("text"), F.col("low"), R.CLAUSES[p], "clause", 20)).where("pattern_ord IS NOT NULL")


def apply_clauses(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Clean findings that nothing denies become HIGH violations where a clause proves it."""
    return with_clauses(findings.join(clause_hits(docs).select(*KEY, "quote"), KEY, "left"), findings.columns)


def with_clauses(joined: DataFrame, columns: list[str]) -> DataFrame:
    """apply_clauses of findings that have the clause's quote beside them."""
    status = F.coalesce(F.col("status"), F.lit("")) if "status" in columns else F.lit("")
    up = F.col("quote").isNotNull() & (status != "EXPLICITLY_DENIES") & ~F.col("violation")
    return joined.select(
        *[c for c in columns if c not in ("violation", "confidence", "citation", "status")],
        (F.col("violation") | up).alias("violation"),
        F.when(up, "HIGH").otherwise(F.col("confidence")).alias("confidence"),
        F.when(up, F.col("quote")).otherwise(F.col("citation")).alias("citation"),
        F.when(up, "VIOLATES").otherwise(status).alias("status"),
        up.alias("promoted"),
    )


def _quoted_sql(name: str, patterns: dict, variant: str, least: int = 0) -> str:
    parts = []
    for p, ps in patterns.items():
        test = [D.rx("text", x) + (f" AND length({D.quote_around('text', x, variant)}) >= {least}" if least else "") for x in ps]
        ord_ = " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(test))
        quote = " ".join(f"WHEN {i} THEN {D.quote_around('text', x, variant)}" for i, x in enumerate(ps))
        parts.append(f"SELECT doc_id, '{p}' AS pillar, pattern_ord, CASE pattern_ord {quote} END AS quote FROM (SELECT doc_id, text, CASE {ord_} END AS pattern_ord FROM policies) WHERE pattern_ord IS NOT NULL")
    return f"\n{name} AS ({' UNION ALL '.join(parts)})"


DENIAL_SQL = _quoted_sql("denials", R.DENIALS, "denial")
VETO_SQL = f"""{DENIAL_SQL},
veto AS (
  SELECT f.doc_id, f.pillar, pillar_ord, violation AND quote IS NULL AS violation,
    CASE WHEN quote IS NULL THEN confidence WHEN {D.rx("quote", R.CONDITIONAL)} THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
    CASE WHEN coalesce(quote, '') <> '' THEN quote ELSE citation END AS citation,
    CASE WHEN quote IS NOT NULL THEN 'EXPLICITLY_DENIES' WHEN violation THEN 'VIOLATES' ELSE 'NOT_MENTIONED' END AS status,
    coalesce({D.rx("quote", R.CONDITIONAL)}, false) AS conditional_denial
  FROM findings f LEFT JOIN denials USING (doc_id, pillar))"""
CLAUSE_SQL = _quoted_sql("clause_rows", R.CLAUSES, "clause", 20)


# -- D6, D7: the scan without a model -----------------------------------------------------------------


def _evidence_of(low: Column, flat: Column, dark_patterns: bool) -> Column:
    """What a scan by patterns alone finds, as an array (pillar, pillar_ord, violation, confidence, citation)."""

    def of(p: str) -> Column:
        quotes = [F.when(T.may_match(low, x) & T.matches(flat, x), T.let(T.quote_around(flat, x, "evidence"), lambda q: F.when(q != "", q))) for x in R.EVIDENCE[p]]
        return F.struct(F.lit(p).alias("pillar"), F.lit(R.PILLARS.index(p) + 1).alias("pillar_ord"), F.coalesce(*quotes, F.lit(R.NOT_ADDRESSED)).alias("citation"))

    found = F.array(*[of(p) for p in R.PILLARS if dark_patterns or p != "dark_patterns"])
    return F.transform(found, lambda f: F.struct(f["pillar"].alias("pillar"), f["pillar_ord"].alias("pillar_ord"), (f["citation"] != R.NOT_ADDRESSED).alias("violation"), F.lit("LOW").alias("confidence"), f["citation"].alias("citation")))


def _flattened(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", T.strip(T.collapse(F.col("text"))).alias("_flat")).withColumn("low", F.lower("_flat"))


def evidence(docs: DataFrame, dark_patterns: bool = True) -> DataFrame:
    """doc_id, pillar, pillar_ord, violation, confidence, citation of a scan by patterns alone."""
    return _flattened(docs).select("doc_id", F.inline(_evidence_of(F.col("low"), F.col("_flat"), dark_patterns)))


def signs(docs: DataFrame, *keep: str) -> DataFrame:
    """evidence with what a scan without a model needs beside it, from one walk through each text: category (D8), denial and
    clause (D3, D5; null structs if there are none), and the columns to keep of docs."""
    rows = docs.where("doc_id IS NOT NULL").withColumn("_lower", F.lower("text")).withColumn("_flat", T.strip(T.collapse(F.col("text")))).withColumn("_flat_lower", F.lower("_flat"))
    rows = rows.withColumn("category", _category(F.col("url"), F.col("text"))).withColumn("_found", _evidence_of(F.col("_flat_lower"), F.col("_flat"), True))
    quoted = lambda p, rules, *how: _quoted(F.col("text"), F.col("_lower"), rules[p], *how)
    each = [F.struct(F.get("_found", F.lit(i)).alias("f"), quoted(p, R.DENIALS, "denial").alias("denial"), quoted(p, R.CLAUSES, "clause", 20).alias("clause")) for i, p in enumerate(R.PILLARS)]
    return rows.select("doc_id", *keep, "category", F.inline(F.array(*each))).select("doc_id", *keep, "category", "f.*", "denial", "clause")


def veto_signs(signs: DataFrame) -> DataFrame:
    return vetoed(signs.withColumn("denied", F.col("denial").isNotNull()).withColumn("quote", F.col("denial.quote")), signs.columns)


def clause_signs(findings: DataFrame) -> DataFrame:
    return with_clauses(findings.withColumn("quote", F.col("clause.quote")), findings.columns).drop("category", "denial", "clause")


def positive_signals(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.any_match(F.col("text"), R.POSITIVE_SIGNALS).alias("positive"))


def fallback_scan(docs: DataFrame, dark_patterns: bool = True) -> DataFrame:
    """doc_id, score, rating, n_violations, deductions (reason, points), tldr, findings (the evidence) of a scan without a model.

    Scored as usual if anything is found, else 75 or 60 and OKAY, as the text protects or doesn't. A document is one row
    throughout, so nothing is shuffled and a stream takes it as it is.
    """
    from clauseriver.operators.merge import score_array

    rows = _flattened(docs).withColumn("findings", _evidence_of(F.col("low"), F.col("_flat"), dark_patterns))
    rows = rows.withColumn("_s", score_array(F.col("findings"))).withColumn("_n", F.size("_s.deductions"))
    rows = rows.withColumn("_good", F.when(F.col("_n") == 0, T.any_match(F.col("text"), R.POSITIVE_SIGNALS)))
    names = F.array_join(F.transform(F.filter("findings", lambda f: f["violation"]), lambda f: f["pillar"]), ", ")
    before, after = R.FALLBACK_TLDR[0].split("{}")
    clean = F.when(F.col("_good"), 75).otherwise(60)
    return rows.select(
        "doc_id", F.when(F.col("_n") > 0, F.col("_s.score")).otherwise(clean).alias("score"), F.when(F.col("_n") > 0, F.col("_s.rating")).otherwise(F.lit("OKAY")).alias("rating"), F.col("_n").alias("n_violations"),
        F.when(F.col("_n") > 0, F.col("_s.deductions")).otherwise(F.array(F.struct(F.lit(R.FALLBACK_DEDUCTION).alias("reason"), (100 - clean).alias("points")))).alias("deductions"),
        F.when(F.col("_n") > 0, F.concat(F.lit(before), names, F.lit(after))).when(F.col("_good"), R.FALLBACK_TLDR[1]).otherwise(R.FALLBACK_TLDR[2]).alias("tldr"), "findings",
    )


def _fallback_sql() -> str:
    """The tail of a query over `evidence`: doc_id, score, rating, n_violations, deductions as text, tldr."""
    from clauseriver.operators.merge import _score_sql

    before, after = R.FALLBACK_TLDR[0].split("{}")
    return f"""{_score_sql("prod", "evidence")},
    fb AS (SELECT doc_id, count(*) FILTER (violation) AS n, string_agg(pillar, ', ' ORDER BY pillar_ord) FILTER (violation) AS names FROM evidence GROUP BY doc_id),
    fallback AS (SELECT doc_id, CAST(n AS INTEGER) AS n_violations, CASE WHEN n > 0 THEN score WHEN good THEN 75 ELSE 60 END AS score, CASE WHEN n > 0 THEN rating ELSE 'OKAY' END AS rating,
      CASE WHEN n > 0 THEN deductions ELSE '{R.FALLBACK_DEDUCTION}=' || CASE WHEN good THEN 25 ELSE 40 END END AS deductions,
      CASE WHEN n > 0 THEN {D.lit(before)} || names || {D.lit(after)} WHEN good THEN {D.lit(R.FALLBACK_TLDR[1])} ELSE {D.lit(R.FALLBACK_TLDR[2])} END AS tldr
      FROM fb JOIN scores_prod USING (doc_id) JOIN (SELECT doc_id, {D.any_rx("text", R.POSITIVE_SIGNALS)} AS good FROM policies) USING (doc_id))"""


def _evidence_sql() -> str:
    # the text is collapsed once here; the quote's own collapsing then changes nothing
    parts = []
    for i, (p, ps) in enumerate(sorted(R.EVIDENCE.items(), key=lambda x: R.PILLARS.index(x[0]))):
        quotes = ", ".join(f"CASE WHEN {D.rx('text', x)} THEN nullif({D.quote_around('text', x, 'evidence')}, '') END" for x in ps)
        parts.append(f"SELECT doc_id, '{p}' AS pillar, {i + 1} AS pillar_ord, coalesce({quotes}, '{R.NOT_ADDRESSED}') AS citation FROM flat")
    return f"""
flat AS (SELECT doc_id, {D.strip(D.collapse("text"))} AS text FROM policies),
evidence AS (SELECT doc_id, pillar, pillar_ord, citation <> '{R.NOT_ADDRESSED}' AS violation, 'LOW' AS confidence, citation FROM ({" UNION ALL ".join(parts)}))"""


# -- D8, D9, D10, D13, D14 ----------------------------------------------------------------------------


def classify_policy(docs: DataFrame) -> DataFrame:
    """doc_id, category: by url, else by at least two signs in the first 20,000 characters."""
    return docs.select("doc_id", _category(F.col("url"), F.col("text")).alias("category"))


def _category(url: Column, text: Column) -> Column:
    url = F.lower(F.coalesce(url, F.lit("")))
    by_url = F.coalesce(*[F.when(T.matches(url, c["url"]), F.lit(name)) for name, c in R.CATEGORIES.items()])

    def best(h: Column) -> Column:
        def count(ps: list[str]) -> Column:
            return sum(((T.may_match(h["low"], p) & T.matches(h["head"], p)).cast("int") for p in ps), F.lit(0))

        return F.array_max(F.array(*[F.struct(count(c["text"]).alias("n"), F.lit(-i).alias("ord"), F.lit(name).alias("name")) for i, (name, c) in enumerate(R.CATEGORIES.items())]))

    head = T.let(F.substring(text, 1, 20000), lambda h: F.struct(h.alias("head"), F.lower(h).alias("low")))
    by_text = T.let(T.let(head, best), lambda b: F.when(b["n"] >= 2, b["name"]))
    return F.coalesce(by_url, by_text, F.lit("general"))


def apply_applicability(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Silent pillars that a category cannot concern become NOT_APPLICABLE; violations and real citations stand."""
    return with_applicability(findings.join(categories, "doc_id"), findings.columns)


def with_applicability(joined: DataFrame, columns: list[str]) -> DataFrame:
    """apply_applicability of findings that have their document's category beside them."""
    out = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(p).alias("pillar")) for n, c in R.CATEGORIES.items() for p in c["not_applicable"]])
    named = F.array_contains(out, F.struct(F.col("category"), F.col("pillar")))
    c = F.trim(F.coalesce("citation", F.lit("")))
    real = (c != "") & ~T.matches(c, R.NO_REAL_CITATION) & ~T.matches(c, "^this practice is not ")
    na = named & ~F.col("violation") & ~real
    label = F.coalesce(*[F.when(F.col("category") == n, F.lit(x["label"])) for n, x in R.CATEGORIES.items()], F.lit(R.GENERAL_LABEL))
    return joined.select(
        *[x for x in columns if x not in ("citation", "status")],
        F.when(na & (F.coalesce("citation", F.lit("")) == ""), F.concat(F.lit("Not applicable to "), label, F.lit("."))).otherwise(F.col("citation")).alias("citation"),
        F.when(na, "NOT_APPLICABLE").otherwise(F.col("status") if "status" in columns else F.lit(None).cast("string")).alias("status"),
        (~na).alias("applicable"),
    )


CLASSIFY_SQL = f"""
classified AS (SELECT doc_id, coalesce(
    CASE {" ".join(f"WHEN {D.rx('lower(url)', c['url'])} THEN '{n}'" for n, c in R.CATEGORIES.items())} END,
    CASE WHEN list_max([{", ".join(D.count_rx("substr(text, 1, 20000)", c["text"]) for c in R.CATEGORIES.values())}]) >= 2 THEN
      {str(list(R.CATEGORIES))}[list_position([{", ".join(D.count_rx("substr(text, 1, 20000)", c["text"]) for c in R.CATEGORIES.values())}],
        list_max([{", ".join(D.count_rx("substr(text, 1, 20000)", c["text"]) for c in R.CATEGORIES.values())}]))] END,
    'general') AS category FROM policies)"""


def prominence_of(citation: Column, text: Column, lowered: Column) -> Column:
    """score and signals of a citation by where and how it stands in the text, which is also given in lower case."""
    cit = T.strip(citation)

    def judged(at: Column) -> Column:
        found = at >= 0
        start = F.greatest(F.lit(0), at - 400)
        context = F.when(found, F.substring(text, start + 1, at + F.length(cit) + 200 - start)).otherwise(cit)
        letters = F.length(F.regexp_replace(cit, "[^A-Za-z]", ""))
        caps = (letters > 20) & (F.length(F.regexp_replace(cit, "[^A-Z]", "")) / letters > 0.6)
        before = F.substring(text, F.greatest(F.lit(0), at - 80) + 1, at - F.greatest(F.lit(0), at - 80))
        bullet = found & T.matches(F.concat(F.lit("\n"), before, F.substring(cit, 1, 10)), R.BULLET, "")
        by_context = lambda c: F.struct(T.matches(c, R.NUMBERED_HEADING, "").alias("numbered"), T.any_match(c, R.HEADINGS).alias("heading"))
        flags = lambda c: F.struct(caps.alias("caps"), c["numbered"].alias("numbered"), c["heading"].alias("heading"), bullet.alias("bullet"), (found & (at / F.length(text) > 0.75)).alias("low"))
        return T.let(T.let(context, by_context), lambda c: T.let(flags(c), points))

    def points(s: Column) -> Column:
        buried = s["low"] & ~s["heading"] & ~s["numbered"] & ~s["caps"]
        signs = [(s["caps"], 25, "all_caps"), (s["numbered"], 20, "numbered_heading"), (s["heading"], 20, "heading_keyword"), (s["bullet"], 15, "standalone_bullet"), (F.length(cit) < 40, -20, "short_fragment"), (buried, -15, "buried_deep")]
        total = sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n, _ in signs), F.lit(50))
        signals = F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, _, x in signs]))
        return F.struct(F.least(F.lit(100), F.greatest(F.lit(0), total)).alias("score"), signals.alias("signals"))

    none = citation.isNull() | (F.length(citation) < 10)
    at = F.position(F.lower(F.substring(cit, 1, 80)), lowered) - 1
    return F.when(none, F.struct(F.lit(30).alias("score"), F.array(F.lit("no_citation_or_too_short")).alias("signals"))).otherwise(T.let(at, judged))


def with_text(findings: DataFrame, docs: DataFrame, key: tuple[str, ...] = ("doc_id",), **once: Column) -> DataFrame:
    """Findings with the text of their document (or of what else has the key), and with the columns `once` of it, which are
    computed once a text.

    A document's findings travel as one row, so its text moves once."""
    rows = findings.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in findings.columns if c not in key])).alias("_rows"))
    joined = docs.select(*key, "text").join(rows, list(key)).select(*key, "text", *[c.alias(k) for k, c in once.items()], "_rows")
    return joined.select(*key, "text", *once, F.inline("_rows"))


def prominence(findings: DataFrame, docs: DataFrame) -> DataFrame:
    return prominent(with_text(findings, docs, _low=F.lower("text")), findings.columns)


def prominent(rows: DataFrame, columns: list[str]) -> DataFrame:
    """prominence of findings that have the text beside them, also in lower case (_low)."""
    rows = rows.withColumn("_p", prominence_of(F.col("citation"), F.col("text"), F.col("_low")))
    return rows.select(*columns, F.col("_p.score").alias("prominence_score"), F.col("_p.signals").alias("prominence_signals"))


def _prominence_sql(source: str = "findings") -> str:
    """As a table prominent; source has doc_id, pillar and citation."""
    context = f"CASE WHEN pos >= 0 THEN substr(text, greatest(0, pos - 400) + 1, pos + length(cit) + 200 - greatest(0, pos - 400)) ELSE cit END"
    before = "substr(text, greatest(0, pos - 80) + 1, pos - greatest(0, pos - 80))"
    return f"""
probe AS (SELECT f.*, text, {D.strip("citation")} AS cit FROM {source} f JOIN policies USING (doc_id)),
placed AS (SELECT *, strpos(lower(text), lower(substr(cit, 1, 80))) - 1 AS pos FROM probe),
context AS (SELECT *, {context} AS context FROM placed),
signs AS (SELECT *,
  length(regexp_replace(cit, '[^A-Za-z]', '', 'g')) > 20 AND length(regexp_replace(cit, '[^A-Z]', '', 'g')) / length(regexp_replace(cit, '[^A-Za-z]', '', 'g')) > 0.6 AS caps,
  {D.rx("context", R.NUMBERED_HEADING, "")} AS numbered, {D.any_rx("context", R.HEADINGS)} AS heading,
  pos >= 0 AND {D.rx(f"chr(10) || {before} || substr(cit, 1, 10)", R.BULLET, "")} AS bullet, length(cit) < 40 AS short FROM context),
signs2 AS (SELECT *, pos >= 0 AND pos / length(text) > 0.75 AND NOT heading AND NOT numbered AND NOT caps AS buried FROM signs),
prominent AS (SELECT doc_id, pillar, CASE WHEN coalesce(length(citation), 0) < 10 THEN 30 ELSE least(100, greatest(0, 50 + 25 * caps::INT + 20 * numbered::INT + 20 * heading::INT + 15 * bullet::INT - 20 * short::INT - 15 * buried::INT)) END AS prominence_score,
  CASE WHEN coalesce(length(citation), 0) < 10 THEN ['no_citation_or_too_short'] ELSE list_filter([CASE WHEN caps THEN 'all_caps' END, CASE WHEN numbered THEN 'numbered_heading' END, CASE WHEN heading THEN 'heading_keyword' END,
    CASE WHEN bullet THEN 'standalone_bullet' END, CASE WHEN short THEN 'short_fragment' END, CASE WHEN buried THEN 'buried_deep' END], lambda x: x IS NOT NULL) END AS prominence_signals
FROM signs2)"""


def has_trade_words(low: Column) -> Column:
    return T.any_phrase(low, R.COMMERCIAL_WORDS) | T.any_phrase(low, R.SHARING_WORDS)


def pp_prefilter(docs: DataFrame) -> DataFrame:
    """doc_id, needs_scan: whether a policy has any word of trade or sharing at all."""
    return docs.select("doc_id", has_trade_words(F.lower("text")).alias("needs_scan"))


def apply_pp_finding(findings: DataFrame, found: DataFrame) -> DataFrame:
    """found (doc_id, pp_found): data_selling becomes a MEDIUM violation where the privacy policy shows it."""
    joined = findings.join(found, "doc_id", "left")
    up = (F.col("pillar") == "data_selling") & ~F.col("violation") & F.coalesce("pp_found", F.lit(False))
    return joined.select(
        *[c for c in findings.columns if c not in ("violation", "confidence", "citation")],
        (F.col("violation") | up).alias("violation"),
        F.when(up, "MEDIUM").otherwise(F.col("confidence")).alias("confidence"),
        F.when(up, "[Found in Privacy Policy]").otherwise(F.col("citation")).alias("citation"),
    )


# -- D15, D16: overrides ------------------------------------------------------------------------------


def _override_cases(any_in, rx, both, version: int) -> dict[str, list[tuple[str, object]]]:
    """Ordered (rule, condition) by pillar; any_in, rx and both build conditions of either engine."""
    later = version >= 3
    published = any_in(R.PUBLISHED_WORDS + (R.PUBLISHED_WORDS_LATER if version >= 2 else []))
    published = both("or", published, rx(r"\bcontents?\b"))
    incoming = both("or", any_in(R.FEEDBACK_WORDS), any_in(R.INCOMING_WORDS))
    has_train = any_in(["train", "fine-tune", "fine tune"])
    utility = both("and", any_in(["perpetual"]), any_in(["non-exclusive"]), any_in(["irrevocable"]), both("not", published))
    hosting = both("and", any_in(["non-exclusive"]), any_in(["royalty-free"]), any_in(R.HOSTING_WORDS), both("not", any_in(R.NOT_HOSTING_WORDS)))
    cap = both("or", any_in(["shall not exceed", "aggregate", "total liability"]), rx(r"\$\d+"))
    cases = {
        "ai_training": [("D1", both("not", has_train)), ("D2", any_in(R.BAN_WORDS + (R.BAN_WORDS_LATER if later else [])))],
        "transparency": [("D3", any_in(R.SCOPING_WORDS))],
        "content_ownership": [("D4", both("and", incoming, both("not", published)))],
    }
    if later:
        cases["content_ownership"].insert(0, ("D4-business", any_in(R.BUSINESS_WORDS)))
        cases["content_ownership"].append(("D4b-hosting", hosting))
    if version >= 2:
        cases["content_ownership"].append(("D4b", utility))
        cases["dark_patterns"] = [("D6", any_in(R.SCOPED_ARBITRATION + (R.SCOPED_ARBITRATION_LATER if later else [])))]
    if later:
        cases["content_ownership"].append(("D4c", any_in(R.OPEN_LICENSE_WORDS)))
        cases["data_retention"] = [("D5", any_in(R.PUBLIC_CONTENT_WORDS))]
        cases["dark_patterns"].append(("D7", both("and", any_in(R.CAP_WORDS), cap, both("not", any_in(["arbitration"])), both("not", any_in(["class action", "class-action"])))))
    return cases


def rule_id(pillar: Column, citation: Column, version: int = 3) -> Column:
    """The override that a violation's citation meets. Version 3 needs a citation; 1 and 2 have fewer rules."""
    c = F.lower(F.coalesce(citation, F.lit("")))

    def both(op: str, *xs: Column) -> Column:
        out = xs[0]
        for x in xs[1:]:
            out = out & x if op == "and" else out | x
        return ~out if op == "not" else out

    cases = _override_cases(lambda ws: T.any_phrase(c, ws), lambda p: T.matches(c, p), both, version)
    rules = [F.when((pillar == p) & cond, F.lit(name)) for p, xs in cases.items() for name, cond in xs]
    found = F.coalesce(*rules)
    return F.when(c != "", found) if version >= 3 else found


def rule_overrides(findings: DataFrame, version: int = 3) -> DataFrame:
    """Violations that an override meets are cleared (MEDIUM); rule_id names it."""
    rows = findings.withColumn("rule_id", F.when(F.col("violation"), rule_id(F.col("pillar"), F.col("citation"), version)))
    cleared = F.col("rule_id").isNotNull()
    return rows.withColumn("violation", F.col("violation") & ~cleared).withColumn("confidence", F.when(cleared, "MEDIUM").otherwise(F.col("confidence")))


def rule_override_variants(findings: DataFrame, left: int = 1, right: int = 3) -> DataFrame:
    """Findings that two versions of the overrides treat differently."""
    a = rule_overrides(findings, left).select(*KEY, F.col("rule_id").alias("left_rule"))
    b = rule_overrides(findings, right).select(*KEY, F.col("rule_id").alias("right_rule"))
    return a.join(b, KEY, "full").where(~F.col("left_rule").eqNullSafe(F.col("right_rule")))


def _rule_sql(version: int, c: str = "lower(coalesce(citation, ''))") -> str:
    def both(op: str, *xs: str) -> str:
        return f"NOT {xs[0]}" if op == "not" else "(" + f" {op.upper()} ".join(xs) + ")"

    cases = _override_cases(lambda ws: D.any_in(c, ws), lambda p: D.rx(c, p), both, version)
    rules = " ".join(f"WHEN pillar = '{p}' AND {cond} THEN '{name}'" for p, xs in cases.items() for name, cond in xs)
    return f"CASE WHEN NOT violation{f" OR {c} = ''" if version >= 3 else ''} THEN NULL {rules} END"


# -- queries ------------------------------------------------------------------------------------------


def _q(run):
    def query(spark, sf_dir):
        docs = C.policies(spark, sf_dir)
        return run(C.findings(docs), docs)

    return query


#: Citations on some of which the versions of the overrides differ.
VARIED = ["", *C.CLAUSES]


def _fallback_rows(rows: DataFrame) -> DataFrame:
    from clauseriver.operators.merge import deductions_text

    return rows.select("doc_id", "score", "rating", "n_violations", deductions_text().alias("deductions"), "tldr")


def _varied(findings: DataFrame) -> DataFrame:
    """All findings as violations, each with one of the citations VARIED."""
    at = ((F.col("doc_id") + F.col("pillar_ord")) % len(VARIED)).cast("int")
    return findings.withColumn("violation", F.lit(True)).withColumn("citation", F.get(F.array(*map(F.lit, VARIED)), at))


BASE = f"WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}"
F_COLS = ["doc_id", "pillar", "violation", "confidence", "citation"]
QUERIES = {
    "c1_split_sentences": _q(lambda f, d: split_sentences(d)),
    "c2_split_sentences_strict": _q(lambda f, d: split_sentences(d, "strict")),
    "d1_hard_violations": _q(lambda f, d: hard_violations(f, d).select(*F_COLS)),
    "d2_cross_check": _q(lambda f, d: cross_check(f, d).select(*F_COLS, "confirmed")),
    "d3_denial_veto": _q(lambda f, d: denial_veto(f, d).select(*F_COLS, "status", "conditional_denial")),
    "d4_count_denials": _q(lambda f, d: count_denials(d)),
    "d5_clause_hits": _q(lambda f, d: clause_hits(d)),
    "d5_apply_clauses": _q(lambda f, d: apply_clauses(denial_veto(f, d), d).select(*F_COLS, "status", "promoted")),
    "d6_evidence": _q(lambda f, d: evidence(d).drop("pillar_ord")),
    "d6_fallback_scan": _q(lambda f, d: _fallback_rows(fallback_scan(d))),
    "d7_positive_signals": _q(lambda f, d: positive_signals(d)),
    "d8_classify_policy": _q(lambda f, d: classify_policy(d)),
    "d9_apply_applicability": _q(lambda f, d: apply_applicability(f, classify_policy(d)).select(*F_COLS, "status", "applicable")),
    "d10_prominence": _q(lambda f, d: prominence(f, d).select("doc_id", "pillar", "prominence_score", "prominence_signals")),
    "d11_backfill_citations": _q(lambda f, d: backfill_citations(f, d).select(*F_COLS)),
    "d13_pp_prefilter": _q(lambda f, d: pp_prefilter(d)),
    "d14_apply_pp_finding": _q(lambda f, d: apply_pp_finding(f, pp_prefilter(d).withColumnRenamed("needs_scan", "pp_found")).select(*F_COLS)),
    "d15_rule_overrides": _q(lambda f, d: rule_overrides(f).select(*F_COLS, "rule_id")),
    "d16_rule_override_variants": _q(lambda f, d: rule_override_variants(_varied(f))),
}
ORACLES = {
    "c1_split_sentences": f"{BASE}, {_sentences_sql('simple')} SELECT * FROM sentences",
    "c2_split_sentences_strict": f"{BASE}, {_sentences_sql('strict')} SELECT * FROM sentences",
    "d1_hard_violations": f"""{BASE}, {_sentences_sql("strict")}, {_hard_sql()}, u AS (
      SELECT f.*, sentence, sentence IS NOT NULL AND NOT (violation AND confidence <> 'LOW') AS up FROM findings f LEFT JOIN hard USING (doc_id, pillar))
    SELECT doc_id, pillar, violation OR up AS violation, CASE WHEN up THEN 'HIGH' ELSE confidence END AS confidence,
      CASE WHEN up THEN {D.cap_words("sentence")} ELSE citation END AS citation FROM u""",
    "d2_cross_check": f"{BASE}, {_cross_sql()} SELECT doc_id, pillar, violation, confidence, citation, confirmed FROM crossed",
    "d3_denial_veto": f"{BASE}, {VETO_SQL} SELECT doc_id, pillar, violation, confidence, citation, status, conditional_denial FROM veto",
    "d4_count_denials": f"WITH {C.POLICIES_SQL} SELECT doc_id, CAST({' + '.join(f'CAST({D.any_rx("text", ps)} AS INT)' for ps in R.DENIALS.values())} AS BIGINT) AS n FROM policies",
    "d5_clause_hits": f"{BASE}, {CLAUSE_SQL} SELECT * FROM clause_rows",
    "d5_apply_clauses": f"""{BASE}, {VETO_SQL}, {CLAUSE_SQL}, u AS (
      SELECT v.*, quote, quote IS NOT NULL AND status <> 'EXPLICITLY_DENIES' AND NOT violation AS promoted FROM veto v LEFT JOIN clause_rows USING (doc_id, pillar))
    SELECT doc_id, pillar, violation OR promoted AS violation, CASE WHEN promoted THEN 'HIGH' ELSE confidence END AS confidence,
      CASE WHEN promoted THEN quote ELSE citation END AS citation, CASE WHEN promoted THEN 'VIOLATES' ELSE status END AS status, promoted FROM u""",
    "d6_evidence": f"{BASE}, {_evidence_sql()} SELECT doc_id, pillar, violation, confidence, citation FROM evidence",
    "d6_fallback_scan": f"{BASE}, {_evidence_sql()}, {_fallback_sql()} SELECT doc_id, score, rating, n_violations, deductions, tldr FROM fallback",
    "d7_positive_signals": f"WITH {C.POLICIES_SQL} SELECT doc_id, {D.any_rx('text', R.POSITIVE_SIGNALS)} AS positive FROM policies",
    "d8_classify_policy": f"WITH {C.POLICIES_SQL}, {CLASSIFY_SQL} SELECT * FROM classified",
    "d9_apply_applicability": f"""{BASE}, {CLASSIFY_SQL}, a AS (SELECT f.*, category, trim(citation) AS c FROM findings f JOIN classified USING (doc_id)), n AS (
      SELECT *, category || ' ' || pillar IN ({", ".join(f"'{n} {p}'" for n, c in R.CATEGORIES.items() for p in c["not_applicable"])}) AND NOT violation
        AND NOT (c <> '' AND NOT {D.rx("c", R.NO_REAL_CITATION)} AND NOT {D.rx("c", "^this practice is not ")}) AS na FROM a)
    SELECT doc_id, pillar, violation, confidence, citation, CASE WHEN na THEN 'NOT_APPLICABLE' END AS status, NOT na AS applicable FROM n""",
    "d10_prominence": f"{BASE}, {_prominence_sql()} SELECT * FROM prominent",
    "d11_backfill_citations": f"""{BASE}, {_sentences_sql("simple")}, {_backfill_sql()}
    SELECT f.doc_id, f.pillar, violation, confidence, CASE WHEN NOT violation AND citation IN ('{R.NOT_FOUND}', '', '{R.NOT_ADDRESSED}') AND sentence IS NOT NULL
      THEN {D.cap_words("sentence")} ELSE citation END AS citation FROM findings f LEFT JOIN best USING (doc_id, pillar)""",
    "d13_pp_prefilter": f"WITH {C.POLICIES_SQL} SELECT doc_id, {D.any_in('lower(text)', R.COMMERCIAL_WORDS)} OR {D.any_in('lower(text)', R.SHARING_WORDS)} AS needs_scan FROM policies",
    "d14_apply_pp_finding": f"""{BASE}, p AS (SELECT doc_id, {D.any_in("lower(text)", R.COMMERCIAL_WORDS)} OR {D.any_in("lower(text)", R.SHARING_WORDS)} AS pp FROM policies), u AS (
      SELECT f.*, pillar = 'data_selling' AND NOT violation AND pp AS up FROM findings f JOIN p USING (doc_id))
    SELECT doc_id, pillar, violation OR up AS violation, CASE WHEN up THEN 'MEDIUM' ELSE confidence END AS confidence, CASE WHEN up THEN '[Found in Privacy Policy]' ELSE citation END AS citation FROM u""",
    "d15_rule_overrides": f"""{BASE}, u AS (SELECT *, {_rule_sql(3)} AS rule_id FROM findings)
    SELECT doc_id, pillar, violation AND rule_id IS NULL AS violation, CASE WHEN rule_id IS NOT NULL THEN 'MEDIUM' ELSE confidence END AS confidence, citation, rule_id FROM u""",
    "d16_rule_override_variants": f"""{BASE}, f AS (SELECT doc_id, pillar, true AS violation, {C._list(VARIED)}[CAST((doc_id + pillar_ord) % {len(VARIED)} AS INT) + 1] AS citation FROM findings),
    u AS (SELECT doc_id, pillar, {_rule_sql(1)} AS left_rule, {_rule_sql(3)} AS right_rule FROM f)
    SELECT * FROM u WHERE left_rule IS DISTINCT FROM right_rule""",
}
