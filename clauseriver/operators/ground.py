"""Citation grounding: is what a finding quotes really in its source, and where."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clauseriver.functions import duck as D
from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.operators.detect import BASE, _cross_sql, cross_check, with_text
from clauseriver.operators.merge import QUICK_FLAG
from clauseriver.sources import corpus as C


def _positions(pieces: Column, begins: Column) -> Column:
    """Where the pieces start, from 0; the first one counts only if it begins with what was split on."""
    lengths = F.transform(pieces, lambda p: F.length(p))
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    return T.let(ends, lambda e: F.slice(e, F.when(begins, 1).otherwise(2), F.greatest(F.lit(0), F.size(e) - F.when(begins, 1).otherwise(2))))


@F.pandas_udf(StructType([StructField("at", IntegerType()), StructField("most", IntegerType())]))
def _densest(places: pd.Series) -> pd.DataFrame:
    """Of each list of sorted positions per term: the first position that has the most terms within 150 characters, and how many.

    Each position looks up its neighbours by binary search, so that many occurrences don't all meet.
    """

    def densest(lists) -> tuple[int | None, int]:
        lists = [np.asarray(x) for x in (lists if lists is not None else []) if len(x)]
        if not lists:
            return None, 0
        every = np.concatenate(lists)
        near = sum((np.searchsorted(x, every + 150, "right") > np.searchsorted(x, every - 150, "left")).astype(int) for x in lists)
        first = int(near.argmax())
        return int(every[first]), int(near[first])

    return pd.DataFrame([densest(x) for x in places], columns=["at", "most"]).astype({"at": "Int32", "most": "Int32"})


def with_grounded(df: DataFrame, citation: str = "citation", text: str = "text", out: str = "_grounded") -> DataFrame:
    """df with the citation if its beginning is in the text; else the part of the text where most of the citation's
    first six telling words stand within 150 characters of each other, from a sentence start, 60 words at most;
    else as it is.

    White space in the text is collapsed throughout (positions and excerpt refer to the same text). Each step is a
    column, so that none is computed twice; df may bring _src (the text as normalize leaves it) and _flat (collapsed).
    """
    c = F.col(citation)
    none = c.isNull() | c.isin("", R.NOT_FOUND, R.NOT_ADDRESSED)
    words = F.transform(F.split(F.lower(citation), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    terms = F.slice(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(R.STOPWORDS)), 1, 6)
    given = {k: v for k, v in (("_src", T.normalize(F.col(text))), ("_flat", T.collapse(F.col(text)))) if k not in df.columns}
    rows = df.withColumns(given).withColumn("_prefix", F.substring(T.normalize(c), 1, 50))
    rows = rows.withColumn("_exact", none | ((F.length("_prefix") >= 20) & F.contains("_src", "_prefix")))
    rows = rows.withColumn("_terms", F.when(~F.col("_exact"), terms)).withColumn("_low", F.when(~F.col("_exact"), F.lower("_flat")))
    spot = lambda t: F.when(F.contains(F.col("_low"), t), _positions(F.call_function("split", F.col("_low"), F.concat(F.lit("(?="), t, F.lit(")"))), F.startswith(F.col("_low"), t))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_places", F.transform("_terms", spot))
    rows = rows.withColumn("_spot", _densest(F.when(F.size("_places") >= 2, F.col("_places"))))
    rows = rows.withColumn("_anchor", F.col("_spot")["at"]).withColumn("_most", F.col("_spot")["most"])
    start = F.greatest(F.lit(0), F.col("_anchor") - 100)
    rows = rows.withColumn("_snippet", F.substring("_flat", start + 1, F.col("_anchor") + 300 - start))
    lead = F.regexp_extract("_snippet", r'^([\s\S]*?[.!?;]\s{1,2})[A-Z"]', 1)
    cut = F.when(F.rlike("_snippet", F.lit('^[A-Z"]')), F.col("_snippet")).otherwise(F.substring("_snippet", F.length(lead) + 1, F.length("_snippet")))
    rows = rows.withColumn("_cut", cut).withColumn("_cut", T.strip(T.cap_words(F.col("_cut"), more="")))
    use = (F.size("_terms") >= 2) & (F.col("_most") >= 2) & (F.length("_cut") >= 30)
    bare = T.strip(F.regexp_replace(citation, "^[\"'“‘]+|[\"'”’]+$", ""))
    best = F.when(none, c).when(F.col("_exact"), bare).when(F.coalesce(use, F.lit(False)), F.col("_cut")).otherwise(c)
    return rows.withColumn(out, best)


def ground_citation(findings: DataFrame, chunks: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Citations of violations, corrected to what the source with the same key (a document, or one chunk of it) says; the mark
    of quick answers isn't sought."""
    text, real = F.col("text"), F.col("violation") & (F.coalesce("citation", F.lit("")) != QUICK_FLAG)
    rows = with_text(findings.where(real), chunks, key, _src=T.normalize(text), _flat=T.collapse(text))
    rows = with_grounded(rows).withColumn("citation", F.col("_grounded")).select(*findings.columns)
    return rows.unionByName(findings.where(~real))


def citation_confidence(findings: DataFrame, docs: DataFrame) -> DataFrame:
    rows = with_text(findings, docs, _src=T.normalize(F.col("text")))
    return rows.select(*findings.columns, T.citation_confidence(F.col("citation"), F.col("_src")).alias("citation_confidence"))


def assign_confidence(findings: DataFrame) -> DataFrame:
    """Needs confirmed and citation_confidence; clear findings are MEDIUM."""
    conf = (
        F.when(~F.col("violation"), "MEDIUM")
        .when(F.col("citation_confidence") == "HIGH", "HIGH")
        .when(F.col("confirmed") | (F.col("citation_confidence") == "MEDIUM"), "MEDIUM")
        .otherwise("LOW")
    )
    return findings.withColumn("confidence", conf)


def verify_citations(df: DataFrame, citations: str = "citations", text: str = "text", max_n: int = 5) -> DataFrame:
    """The first max_n citations, without those that the text doesn't hold."""
    held = T.let(T.normalize_quotes(F.col(text)), lambda src: F.filter(F.slice(citations, 1, max_n), lambda c: T.is_grounded(c, src)))
    return df.withColumn(citations, held)


def classify_citations(findings: DataFrame, docs: DataFrame) -> DataFrame:
    rows = with_text(findings, docs, _src=T.normalize_quotes(F.col("text")))
    rows = rows.select(*findings.columns, T.is_grounded(F.col("citation"), F.col("_src")).alias("grounded"))
    return rows.select(*findings.columns, T.classify_citation(F.col("citation"), F.col("grounded")).alias("trust"), "grounded")


def sanitize_citations(findings: DataFrame) -> DataFrame:
    """Violations lose the wrapping around their quote; clear findings that only talk about the policy lose it all."""
    c = T.strip(F.coalesce("citation", F.lit("")))
    skip = F.coalesce("citation", F.lit("")).isin("", R.NOT_ADDRESSED)
    talk = T.any_match(c, R.PARAPHRASE_STRICT + R.PARAPHRASE_LEADING)
    clean = F.when(skip, F.col("citation")).when(F.col("violation"), T.strip_wrapper(c)).when(talk, F.lit(R.NOT_ADDRESSED)).otherwise(F.col("citation"))
    return findings.withColumn("citation", clean)


def derive_status(findings: DataFrame) -> DataFrame:
    now = F.upper(F.coalesce("status", F.lit("")))
    status = (
        F.when(now.isin("EXPLICITLY_DENIES", "NOT_APPLICABLE"), F.col("status"))
        .when(F.col("violation"), "VIOLATES")
        .when(~T.null_citation(F.col("citation")), "EXPLICITLY_DENIES")
        .otherwise("NOT_MENTIONED")
    )
    return findings.withColumn("status", status)


def typographic(text: Column) -> Column:
    return F.trim(T.collapse(F.translate(text, "–—‘’“” ", "--''\"\" ")))


def candidates_of(citation: Column) -> Column:
    """What to look for on the page, most specific first: the quote, its plain form, its beginnings."""
    clean = T.strip(F.regexp_replace(citation, "^[\"'“‘]|[\"'”’]$", ""))
    plain = typographic(clean)
    starts = F.transform(F.array(*[F.trim(F.substring(plain, 1, n)) for n in (80, 60, 40, 25)]), lambda s: F.when((F.length(s) >= 20) & (s != plain), s))
    found = F.concat(F.array(clean, F.when(plain != clean, plain)), starts)
    return F.when((citation != R.NOT_ADDRESSED) & (clean != ""), F.filter(F.array_compact(found), lambda c: F.length(c) >= 15))


def highlight_candidates(findings: DataFrame) -> DataFrame:
    return findings.select("doc_id", "pillar", F.posexplode(candidates_of(F.col("citation"))).alias("candidate_no", "candidate"))


def locate_citation(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, pillar, start, end of the first candidate that the text holds, in its typographically plain form."""
    rows = with_text(findings, docs, _t=typographic(F.col("text")))
    hits = F.filter(candidates_of(F.col("citation")), lambda c: F.contains(F.col("_t"), c))
    rows = rows.withColumn("_c", F.get(hits, F.lit(0))).where("_c IS NOT NULL")
    start = F.position(F.col("_c"), F.col("_t")) - 1
    return rows.select("doc_id", "pillar", start.alias("start"), (start + F.length("_c")).alias("end"))


# -- queries ------------------------------------------------------------------------------------------


def _q(run):
    def query(spark, sf_dir):
        docs = C.policies(spark, sf_dir)
        return run(C.findings(docs), docs)

    return query


def _assign(f: DataFrame, d: DataFrame) -> DataFrame:
    return assign_confidence(citation_confidence(cross_check(f, d), d))


def _verify(f: DataFrame, d: DataFrame) -> DataFrame:
    lists = f.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pillar_ord", "citation"))), lambda r: r["citation"]).alias("citations"))
    return verify_citations(d.select("doc_id", "text").join(lists, "doc_id")).select("doc_id", F.array_join("citations", " | ").alias("verified"))


QUERIES = {
    "e1_ground_citation": _q(lambda f, d: ground_citation(f, d).select("doc_id", "pillar", "citation")),
    "e2_citation_confidence": _q(lambda f, d: citation_confidence(f, d).select("doc_id", "pillar", "citation_confidence")),
    "e3_assign_confidence": _q(lambda f, d: _assign(f, d).select("doc_id", "pillar", "violation", "confidence")),
    "e4_strip_wrapper": _q(lambda f, d: f.select("doc_id", "pillar", T.strip_wrapper(F.col("citation")).alias("citation"))),
    "e6_verify_citations": _q(_verify),
    "e7_classify_citation": _q(lambda f, d: classify_citations(f, d).select("doc_id", "pillar", "trust", "grounded")),
    "e8_sanitize_citations": _q(lambda f, d: sanitize_citations(f).select("doc_id", "pillar", "citation")),
    "e9_derive_status": _q(lambda f, d: derive_status(f.withColumn("status", F.when(F.col("doc_id") % 5 == 0, "NOT_APPLICABLE"))).select("doc_id", "pillar", "status")),
    "e10_locate_citation": _q(locate_citation),
    "c8_highlight_candidates": _q(lambda f, d: highlight_candidates(f)),
    "b7_b10_predicates": _q(lambda f, d: f.select("doc_id", "pillar", T.strong_negation(F.col("citation")).alias("negated"), T.null_citation(F.col("citation")).alias("absent"), T.conditional_denial(F.col("citation")).alias("conditional"), T.is_paraphrase(F.col("citation")).alias("paraphrase"))),
}
_FT = "ft AS (SELECT f.*, text FROM findings f JOIN policies USING (doc_id))"
_terms = f"""list_filter(list_transform(regexp_split_to_array(lower(citation), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')),
  lambda w: length(w) >= 4 AND NOT list_contains([{", ".join(map(D.lit, R.STOPWORDS))}], w))[1:6]"""


def _grounded_sql(source: str, key: str) -> str:
    """grounded (the key, citation) for the violations of source (key, citation, violation, text)."""
    return f"""
gr_t AS (SELECT *, {_terms} AS terms, {D.collapse("text")} AS flat, {D.normalize("citation")} AS cit, {D.normalize("text")} AS src FROM {source} WHERE violation),
gr_o AS (SELECT {key}, k, t AS term, unnest(list_filter(range(0, length(flat)), lambda i: substr(low, i + 1, length(t)) = t)) AS pos
  FROM (SELECT {key}, flat, lower(flat) AS low, unnest(range(1, len(terms) + 1)) AS k, unnest(terms) AS t FROM gr_t WHERE len(terms) >= 2
    AND citation NOT IN ('{R.NOT_FOUND}', '{R.NOT_ADDRESSED}') AND NOT (length(substr(cit, 1, 50)) >= 20 AND contains(src, substr(cit, 1, 50))))),
gr_c AS (SELECT {key}, k, pos, len(list_distinct(list(k) OVER (PARTITION BY {key} ORDER BY pos RANGE BETWEEN 150 PRECEDING AND 150 FOLLOWING))) AS n FROM gr_o),
gr_a AS (SELECT {key}, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, k, pos) AS r FROM gr_c) WHERE r = 1 AND n >= 2),
gr_s AS (SELECT gr_t.*, substr(flat, greatest(0, pos - 100) + 1, pos + 300 - greatest(0, pos - 100)) AS sn FROM gr_t LEFT JOIN gr_a USING ({key})),
gr_s2 AS (SELECT *, CASE WHEN regexp_matches(sn, '^[A-Z"]') THEN sn ELSE substr(sn, length(regexp_extract(sn, '^([\\s\\S]*?[.!?;]\\s{{1,2}})[A-Z"]', 1)) + 1) END AS cut FROM gr_s),
gr_s3 AS (SELECT *, {D.strip(D.cap_words("cut", more=""))} AS snippet FROM gr_s2),
grounded AS (SELECT {key}, CASE WHEN citation IN ('', '{R.NOT_FOUND}', '{R.NOT_ADDRESSED}') THEN citation
  WHEN length(substr(cit, 1, 50)) >= 20 AND contains(src, substr(cit, 1, 50)) THEN {D.strip("regexp_replace(citation, '^[\"''“‘]+|[\"''”’]+$', '', 'g')")}
  WHEN length(snippet) >= 30 THEN snippet ELSE citation END AS citation FROM gr_s3)"""


_cands = r"""(SELECT doc_id, pillar, clean, trim(regexp_replace(translate(clean, '–—‘’“” ', '--''''"" '), '\s+', ' ', 'g')) AS plain
  FROM (SELECT *, regexp_replace(regexp_replace(citation, '^["''“‘]|["''”’]$', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM findings) WHERE citation <> 'Not addressed in document.' AND clean <> '')"""
CANDIDATES_SQL = f"""
cand_lists AS (SELECT doc_id, pillar, list_filter([clean, CASE WHEN plain <> clean THEN plain END] ||
  list_transform([80, 60, 40, 25], lambda n: CASE WHEN length(trim(substr(plain, 1, n))) >= 20 AND trim(substr(plain, 1, n)) <> plain THEN trim(substr(plain, 1, n)) END),
  lambda c: c IS NOT NULL AND length(c) >= 15) AS list FROM {_cands}),
candidates AS (SELECT doc_id, pillar, unnest(range(0, len(list))) AS candidate_no, unnest(list) AS candidate FROM cand_lists)"""
ORACLES = {
    "e1_ground_citation": f"""{BASE}, {_FT}, {_grounded_sql("ft", "doc_id, pillar")} SELECT doc_id, pillar, citation FROM grounded
    UNION ALL SELECT doc_id, pillar, citation FROM findings WHERE NOT violation""",
    "e2_citation_confidence": f"{BASE}, {_FT} SELECT doc_id, pillar, {D.citation_confidence('citation', 'text')} AS citation_confidence FROM ft",
    "e3_assign_confidence": f"""{BASE}, {_cross_sql()}, x AS (SELECT c.*, {D.citation_confidence("citation", "text")} AS cc FROM crossed c JOIN policies USING (doc_id))
    SELECT doc_id, pillar, violation, CASE WHEN NOT violation THEN 'MEDIUM' WHEN cc = 'HIGH' THEN 'HIGH' WHEN confirmed OR cc = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM x""",
    "e4_strip_wrapper": f"{BASE} SELECT doc_id, pillar, {D.strip_wrapper('citation')} AS citation FROM findings",
    "e6_verify_citations": f"""{BASE}, {_FT} SELECT doc_id, coalesce(string_agg(citation, ' | ' ORDER BY pillar_ord) FILTER (pillar_ord <= 5 AND {D.is_grounded("citation", "text")}), '') AS verified FROM ft GROUP BY doc_id""",
    "e7_classify_citation": f"{BASE}, {_FT} SELECT doc_id, pillar, {D.classify_citation('citation', 'text')} AS trust, {D.is_grounded('citation', 'text')} AS grounded FROM ft",
    "e8_sanitize_citations": f"""{BASE}, c AS (SELECT *, {D.strip("citation")} AS c FROM findings)
    SELECT doc_id, pillar, CASE WHEN citation IN ('', '{R.NOT_ADDRESSED}') THEN citation WHEN violation THEN {D.strip_wrapper("c")} WHEN {D.any_rx("c", R.PARAPHRASE_STRICT + R.PARAPHRASE_LEADING)} THEN '{R.NOT_ADDRESSED}' ELSE citation END AS citation FROM c""",
    "e9_derive_status": f"""{BASE} SELECT doc_id, pillar, CASE WHEN doc_id % 5 = 0 THEN 'NOT_APPLICABLE' WHEN violation THEN 'VIOLATES' WHEN NOT {D.null_citation("citation")} THEN 'EXPLICITLY_DENIES' ELSE 'NOT_MENTIONED' END AS status FROM findings""",
    "e10_locate_citation": f"""{BASE}, {CANDIDATES_SQL}, p AS (SELECT doc_id, trim(regexp_replace(translate(text, '–—‘’“” ', '--''''"" '), '\\s+', ' ', 'g')) AS t FROM policies),
    h AS (SELECT c.doc_id, pillar, candidate_no, candidate, t FROM candidates c JOIN p USING (doc_id) WHERE contains(t, candidate)),
    b AS (SELECT doc_id, pillar, arg_min(candidate, candidate_no) AS candidate, any_value(t) AS t FROM h GROUP BY doc_id, pillar)
    SELECT doc_id, pillar, strpos(t, candidate) - 1 AS start, strpos(t, candidate) - 1 + length(candidate) AS "end" FROM b""",
    "c8_highlight_candidates": f"{BASE}, {CANDIDATES_SQL} SELECT * FROM candidates",
    "b7_b10_predicates": f"""{BASE} SELECT doc_id, pillar, {D.rx("citation", R.STRONG_NEGATION)} AS negated, {D.null_citation("citation")} AS absent, {D.rx("citation", R.CONDITIONAL)} AS conditional, {D.is_paraphrase("citation")} AS paraphrase FROM findings""",
}
