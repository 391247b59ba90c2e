"""Composite pipelines: the operators in the order that production, evaluation and monitoring use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.functions import rules as R
from clauseriver.operators import detect, evaluate, ground, history, merge, pages
from clauseriver.sources import corpus as C

KEY = ["doc_id", "pillar"]


def _with_ord(findings: DataFrame) -> DataFrame:
    return findings.withColumn("pillar_ord", F.array_position(F.array(*map(F.lit, R.PILLARS)), F.col("pillar")).cast("int"))


def rules_only_findings(docs: DataFrame, *keep: str) -> DataFrame:
    """Findings of a scan that needs no model, over texts without cookie banners: pattern evidence, denials, statuses,
    applicability, then clauses. A text is walked once, and none is joined; columns to keep stay beside the findings."""
    found = ground.derive_status(detect.veto_signs(detect.signs(docs, *keep)))
    return detect.clause_signs(detect.with_applicability(found, found.columns))


def _by_document(found: DataFrame) -> DataFrame:
    """doc_id, its findings as rows, and s: their score."""
    rows = found.groupBy("doc_id").agg(F.collect_list(F.struct("pillar", "violation", "confidence")).alias("rows"))
    return rows.withColumn("s", merge.score_array(F.col("rows")))


def scan_rules_only(docs: DataFrame) -> DataFrame:
    """doc_id, score, rating, violations of a scan that needs no model."""
    names = F.array_sort(F.transform(F.filter("rows", lambda r: r["violation"]), lambda r: r["pillar"]))
    return _by_document(rules_only_findings(pages.strip_cookie_banners(docs))).select("doc_id", "s.score", "s.rating", F.array_join(names, ",").alias("violations"))


def rules_only_report(docs: DataFrame) -> DataFrame:
    """Findings of a scan that needs no model, with how prominently each quote stands in its text."""
    docs = pages.strip_cookie_banners(docs).withColumn("_low", F.lower("text"))
    found = rules_only_findings(docs, "text", "_low")
    return detect.prominent(found, [c for c in found.columns if c not in ("text", "_low")])


def server_chunks(docs: DataFrame, size: int = 40_000, overlap: int = 5_000) -> DataFrame:
    """doc_id, chunk_no, chunk_text: what the model is asked about, three chunks of the text without cookie banners at most."""
    return pages.chunk_documents(pages.strip_cookie_banners(docs), size, overlap)


def server_findings(outputs: DataFrame, docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of a scan: from the answers (doc_id, chunk_no, model, tier, raw_json), and as the text rules leave them.

    A deep scan joins two models' answers of a chunk; what they cite is sought in that very chunk. Quick answers are flags of
    one model. Chunks are merged; phrases confirm, citations give confidence; then quotes lose their wrapping, clear findings
    get a sentence, and plain violations are added.
    """
    key = ("doc_id", "chunk_no", "pillar")
    deep = merge.output_findings(merge.parse_model_output(outputs.where("tier = 'deep'")))
    union = merge.ensemble_merge(*[deep.where(F.col("model") == m) for m in ("primary", "corroborator")], key=key)
    grounded = ground.ground_citation(union, chunks.withColumnRenamed("chunk_text", "text"), ("doc_id", "chunk_no"))
    quick = merge.normalize_quick(merge.parse_model_output(outputs.where("tier = 'quick'"), "quick"))
    merged = _with_ord(merge.merge_chunks(grounded.unionByName(quick.select(*grounded.columns))))
    checked = detect.cross_check(merged, docs)
    sure = ground.assign_confidence(ground.citation_confidence(checked, docs)).drop("confirmed", "citation_confidence")
    clean_docs = pages.strip_cookie_banners(docs)
    return sure, detect.hard_violations(detect.backfill_citations(ground.sanitize_citations(sure), clean_docs), clean_docs)


def scan_server(outputs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Score of a scan after the text rules."""
    return merge.score(server_findings(outputs, docs, chunks)[1]).select("doc_id", "score", "rating")


def server_summary(outputs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, tldr of a scan: the primary model's, else one from the score before the text rules."""
    first = server_findings(outputs, docs, chunks)[0]
    answers = [merge.parse_model_output(outputs.where(f"model = 'primary' AND tier = '{t}'"), t).where("parse_ok").select("doc_id", "chunk_no", "tldr") for t in ("deep", "quick")]
    return merge.build_tldr(answers[0].unionByName(answers[1]), first, merge.score(first))


def scan_battery(outputs: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings of the battery: chunks by confidence, gated ensemble, privacy policy, overrides, score."""
    long = merge.output_findings(merge.parse_model_output(outputs))
    sides = [merge.merge_chunks(long.where(F.col("model") == m), "confidence") for m in ("primary", "corroborator")]
    found = _with_ord(merge.ensemble_merge(*sides, gate="HIGH"))
    shown = detect.pp_prefilter(docs).withColumnRenamed("needs_scan", "pp_found")
    return merge.score(detect.rule_overrides(detect.apply_pp_finding(found, shown)), "battery").select("doc_id", "score", "rating")


def evaluate_rules(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """Accuracy of the scan without a model against cases (id, pillar, expected, expected_rating)."""
    found = _by_document(detect.clause_signs(detect.veto_signs(detect.signs(docs))))
    predicted = found.select(F.col("doc_id").alias("id"), F.col("s.rating").alias("rating"), F.inline("rows")).select("id", "pillar", "violation", "rating")
    return evaluate.eval_accuracy(predicted, cases)


def monitor(scans: DataFrame, cache: DataFrame) -> DataFrame:
    """Changes among the scans that no cached result answers, with each url's latest state."""
    requests = scans.select(F.col("scan_id").alias("req_id"), F.concat_ws(":", "url", "tier").alias("cache_key"), "content_hash", F.col("created_at").alias("req_ts"))
    fresh = history.cache_lookup(requests, cache).where("scanned_at IS NULL").select(F.col("req_id").alias("scan_id"))
    rows = scans.join(fresh, "scan_id")
    changes = history.policy_changes(rows).groupBy("url").agg(F.count("*").alias("changes"))
    latest = rows.groupBy("url").agg(F.max_by("score", F.struct("created_at", "scan_id")).alias("score"))
    return latest.join(changes, "url", "left").select("url", "score", F.coalesce("changes", F.lit(0)).alias("changes"))


def rating_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents get each rating from the scan without a model."""
    return scan_rules_only(C.policies(spark, sf_dir)).groupBy("rating").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 6).alias("avg_score"))


def _cache(scans: DataFrame) -> DataFrame:
    old = scans.where("tier = 'deep'").select(F.concat_ws(":", "url", "tier").alias("cache_key"), "content_hash", "tier", F.col("created_at").alias("scanned_at")).distinct()
    return old.withColumn("expires_at", F.col("scanned_at") + F.expr("INTERVAL 1 HOUR")).withColumn("scanned_at", F.col("scanned_at") - F.expr("INTERVAL 1 MINUTE"))


#: Chunks of the queries, so that the given texts have several.
CHUNK, OVERLAP = 3000, 300


def _server(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = C.policies(spark, sf_dir)
        chunks = C.stored(server_chunks(docs, CHUNK, OVERLAP))
        return run(C.stored(C.server_outputs(chunks)), docs, chunks)

    return query


QUERIES = {
    "p3_rating_counts": rating_counts,
    "p1_scan_server": _server(scan_server),
    "p1_server_findings": _server(lambda *x: server_findings(*x)[1].select("doc_id", "pillar", "violation", "confidence", "citation")),
    "p1_server_summary": _server(server_summary),
    "p2_scan_battery": lambda s, d: scan_battery(C.model_outputs(C.policies(s, d)), C.policies(s, d)),
    "p3_scan_rules_only": lambda s, d: scan_rules_only(C.policies(s, d)),
    "p3_rules_only_report": lambda s, d: rules_only_report(C.policies(s, d)).select("doc_id", "pillar", "violation", "confidence", "citation", "prominence_score", "prominence_signals"),
    "p4_evaluate_rules": lambda s, d: evaluate_rules(C.policies(s, d), evaluate._cases(s, d)[1]),
    "p5_monitor": lambda s, d: monitor(C.scans(s, d), _cache(C.scans(s, d))),
}


def _rules_sql() -> str:
    """The scan without a model as one statement: each step reads the one before."""
    from clauseriver.functions import duck as D

    classify = detect.CLASSIFY_SQL
    na = ", ".join(f"'{n} {p}'" for n, c in R.CATEGORIES.items() for p in c["not_applicable"])
    return f"""WITH {C.POLICIES_SQL}, {detect._evidence_sql()}, {detect.DENIAL_SQL}, {classify}, {detect.CLAUSE_SQL},
    v AS (SELECT e.doc_id, e.pillar, pillar_ord, violation AND quote IS NULL AS violation, CASE WHEN quote IS NULL THEN 'LOW' WHEN {D.rx("quote", R.CONDITIONAL)} THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
      CASE WHEN coalesce(quote, '') <> '' THEN quote ELSE citation END AS citation, quote IS NOT NULL AS denied FROM evidence e LEFT JOIN denials USING (doc_id, pillar)),
    s AS (SELECT *, CASE WHEN denied THEN 'EXPLICITLY_DENIES' WHEN violation THEN 'VIOLATES' WHEN NOT {D.null_citation("citation")} THEN 'EXPLICITLY_DENIES' ELSE 'NOT_MENTIONED' END AS status FROM v),
    k AS (SELECT s.*, q.quote, q.quote IS NOT NULL AND NOT violation AND NOT (status = 'EXPLICITLY_DENIES'
        AND NOT (category || ' ' || s.pillar IN ({na}) AND NOT violation AND NOT (trim(citation) <> '' AND NOT {D.rx("trim(citation)", R.NO_REAL_CITATION)} AND NOT {D.rx("trim(citation)", "^this practice is not ")}))) AS up
      FROM s JOIN classified USING (doc_id) LEFT JOIN clause_rows q ON q.doc_id = s.doc_id AND q.pillar = s.pillar),
    found AS (SELECT doc_id, pillar, pillar_ord, violation OR up AS violation, CASE WHEN up THEN 'HIGH' ELSE confidence END AS confidence, CASE WHEN up THEN quote ELSE citation END AS citation FROM k), {merge._score_sql("prod", "found")},
    names AS (SELECT doc_id, coalesce(string_agg(pillar, ',' ORDER BY pillar) FILTER (violation), '') AS violations FROM found GROUP BY doc_id)"""


def _battery_sql() -> str:
    from clauseriver.functions import duck as D

    pp = f"{D.any_in('lower(text)', R.COMMERCIAL_WORDS)} OR {D.any_in('lower(text)', R.SHARING_WORDS)}"
    return f"""{merge._ensemble_ctes("HIGH")}, shown AS (SELECT doc_id, {pp} AS pp FROM policies),
    withpp AS (SELECT e.doc_id, e.pillar, pillar_ord, violation OR up AS violation, CASE WHEN up THEN 'MEDIUM' ELSE confidence END AS confidence, CASE WHEN up THEN '[Found in Privacy Policy]' ELSE citation END AS citation
      FROM (SELECT ens.*, pillar_ord, ens.pillar = 'data_selling' AND NOT violation AND pp AS up FROM ens JOIN pillar_list USING (pillar) JOIN shown USING (doc_id)) e),
    over AS (SELECT *, {detect._rule_sql(3)} AS rule_id FROM withpp),
    cleared AS (SELECT doc_id, pillar, pillar_ord, violation AND rule_id IS NULL AS violation, CASE WHEN rule_id IS NOT NULL THEN 'MEDIUM' ELSE confidence END AS confidence FROM over), {merge._score_sql("battery", "cleared")}
    SELECT doc_id, score, rating FROM scores_battery"""


def _evaluate_sql() -> str:
    from clauseriver.functions import duck as D

    return f"""WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}, {detect._evidence_sql()}, {detect.DENIAL_SQL}, {detect.CLAUSE_SQL},
    k AS (SELECT e.doc_id, e.pillar, e.pillar_ord, violation AND n.quote IS NULL OR (q.quote IS NOT NULL AND n.quote IS NULL AND NOT violation) AS violation,
        CASE WHEN q.quote IS NOT NULL AND n.quote IS NULL AND NOT violation THEN 'HIGH' WHEN n.quote IS NULL THEN 'LOW' WHEN {D.rx("n.quote", R.CONDITIONAL)} THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
      FROM evidence e LEFT JOIN denials n ON n.doc_id = e.doc_id AND n.pillar = e.pillar LEFT JOIN clause_rows q ON q.doc_id = e.doc_id AND q.pillar = e.pillar), {merge._score_sql("prod", "k")},
    c AS (SELECT k.doc_id AS id, k.pillar, CASE WHEN (k.doc_id + k.pillar_ord) % 9 <> 0 THEN (k.doc_id + k.pillar_ord) % 4 = 0 END AS expected, ['SAFE', 'OKAY', 'RISKY'][CAST(k.doc_id % 3 AS INT) + 1] AS er, violation, rating FROM k JOIN scores_prod USING (doc_id)),
    g AS (SELECT id, count(*) FILTER (violation = expected) AS ok, count(expected) AS total, bool_or(rating = er) AS hit FROM c GROUP BY id)
    SELECT round(100 * sum(ok) / sum(total), 6) AS pillars_pct, round(100 * count(*) FILTER (hit) / count(*), 6) AS rating_pct, 0 AS parse_fails FROM g"""


def _server_sql() -> str:
    from clauseriver.functions import duck as D

    simple = f"{detect._sentences_sql('simple')}, {detect._backfill_sql()}".replace("sent_lists", "sent_lists_simple").replace("sentences", "sentences_simple")
    sanitized = f"""CASE WHEN citation IN ('', '{R.NOT_ADDRESSED}') THEN citation WHEN violation THEN {D.strip_wrapper("c")} WHEN {D.any_rx("c", R.PARAPHRASE_STRICT + R.PARAPHRASE_LEADING)} THEN '{R.NOT_ADDRESSED}' ELSE citation END"""
    return f"""WITH RECURSIVE {C.POLICIES_SQL}, {C.FINDINGS_SQL}, {pages._chunks_sql(CHUNK, OVERLAP).replace("c3 AS (", "c3_all AS (")}, c3 AS MATERIALIZED (SELECT * FROM c3_all WHERE chunk_no < 3), {C.SERVER_SQL},
    {detect._sentences_sql("strict")}, {detect._hard_sql()}, {simple},
    a AS (SELECT * FROM said WHERE tier = 'deep' AND model = 'primary'), b AS (SELECT * FROM said WHERE tier = 'deep' AND model = 'corroborator'),
    e AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.chunk_no, b.chunk_no) AS chunk_no, coalesce(a.pillar, b.pillar) AS pillar, coalesce(a.chunk_text, b.chunk_text) AS text,
        coalesce(b.doc_id IS NOT NULL AND CASE WHEN a.doc_id IS NULL OR (b.violation AND NOT a.violation) THEN true ELSE a.violation AND b.violation AND {D.conf_rank("b.confidence")} > {D.conf_rank("a.confidence")} END, false) AS take,
        a.violation AS av, a.confidence AS ac, a.citation AS aq, b.violation AS bv, b.confidence AS bc, b.citation AS bq
      FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.pillar = b.pillar),
    g AS MATERIALIZED (SELECT doc_id, chunk_no, pillar, text, CASE WHEN take THEN bv ELSE av END AS violation, CASE WHEN take THEN bc ELSE ac END AS confidence, CASE WHEN take THEN bq ELSE aq END AS citation FROM e),
    {ground._grounded_sql("g", "doc_id, chunk_no, pillar")},
    h AS (SELECT g.doc_id, g.chunk_no, g.pillar, violation, confidence, CASE WHEN violation THEN grounded.citation ELSE g.citation END AS citation FROM g LEFT JOIN grounded USING (doc_id, chunk_no, pillar)
      UNION ALL SELECT doc_id, chunk_no, pillar, violation, 'MEDIUM', CASE WHEN violation THEN '{merge.QUICK_FLAG}' ELSE '{R.NOT_FOUND}' END FROM said WHERE tier = 'quick' AND model = 'primary'),
    m AS (SELECT doc_id, pillar, pillar_ord, violation, confidence, citation FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pillar ORDER BY violation DESC, chunk_no) AS k FROM h) JOIN pillar_list USING (pillar) WHERE k = 1),
    {detect._cross_sql("m")},
    x AS (SELECT c.*, {D.citation_confidence("citation", "text")} AS cc FROM crossed c JOIN policies USING (doc_id)),
    y AS (SELECT doc_id, pillar, pillar_ord, violation, CASE WHEN NOT violation THEN 'MEDIUM' WHEN cc = 'HIGH' THEN 'HIGH' WHEN confirmed OR cc = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, citation FROM x),
    y2 AS (SELECT doc_id, pillar, pillar_ord, violation, confidence, {sanitized} AS citation FROM (SELECT *, {D.strip("citation")} AS c FROM y)),
    y3 AS (SELECT y2.* EXCLUDE (citation), CASE WHEN NOT violation AND citation IN ('{R.NOT_FOUND}', '', '{R.NOT_ADDRESSED}') AND sentence IS NOT NULL THEN {D.cap_words("sentence")} ELSE citation END AS citation FROM y2 LEFT JOIN best USING (doc_id, pillar)),
    up AS (SELECT y3.*, sentence, sentence IS NOT NULL AND NOT (violation AND confidence <> 'LOW') AS up FROM y3 LEFT JOIN hard USING (doc_id, pillar)),
    z AS (SELECT doc_id, pillar, pillar_ord, violation OR up AS violation, CASE WHEN up THEN 'HIGH' ELSE confidence END AS confidence, CASE WHEN up THEN {D.cap_words("sentence")} ELSE citation END AS citation FROM up)"""


def _summary_sql() -> str:
    tldr = "CASE whole % 4 WHEN 0 THEN 'Analysis complete.' WHEN 1 THEN 'Short.' ELSE 'Summary number ' || whole || ' of the policy' END"
    return f"""{_server_sql()}, {merge._score_sql("prod", "y")},
    good AS (SELECT doc_id, arg_min(t, chunk_no) AS best FROM (SELECT DISTINCT doc_id, chunk_no, {tldr} AS t FROM said WHERE model = 'primary') WHERE length(t) > 20 AND t <> '{merge.PLACEHOLDER}' GROUP BY doc_id),
    v AS (SELECT doc_id, count(*) FILTER (violation) AS n, array_to_string((list(replace(pillar, '_', ' ') ORDER BY pillar_ord) FILTER (violation))[1:3], ', ') AS names FROM y GROUP BY doc_id)
    SELECT doc_id, coalesce(best, CASE WHEN n = 0 THEN 'This policy scored ' || score || '/100. No major privacy violations were detected.'
      ELSE 'This ' || rating || ' policy scored ' || score || '/100. Privacy concerns found in: ' || names || '.' END) AS tldr FROM scores_prod JOIN v USING (doc_id) LEFT JOIN good USING (doc_id)"""


ORACLES = {
    "p1_scan_server": f"{_server_sql()}, {merge._score_sql('prod', 'z')} SELECT doc_id, score, rating FROM scores_prod",
    "p1_server_findings": f"{_server_sql()} SELECT doc_id, pillar, violation, confidence, citation FROM z",
    "p1_server_summary": _summary_sql(),
    "p4_evaluate_rules": _evaluate_sql(),
    "p3_rating_counts": f"{_rules_sql()} SELECT rating, count(*) AS documents, round(avg(score), 6) AS avg_score FROM scores_prod GROUP BY rating",
    "p2_scan_battery": _battery_sql(),
    "p3_scan_rules_only": f"{_rules_sql()} SELECT doc_id, score, rating, violations FROM scores_prod JOIN names USING (doc_id)",
    "p3_rules_only_report": f"{_rules_sql()}, {detect._prominence_sql('found')} SELECT doc_id, pillar, violation, confidence, citation, prominence_score, prominence_signals FROM found JOIN prominent USING (doc_id, pillar)",
    "p5_monitor": f"""WITH {C.SCANS_SQL}, c AS (SELECT DISTINCT url || ':' || tier AS k, content_hash, created_at - INTERVAL 1 MINUTE AS a, created_at + INTERVAL 1 HOUR AS b FROM scans WHERE tier = 'deep'),
    r AS (SELECT * FROM scans s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = s.url || ':' || s.tier AND c.content_hash = s.content_hash AND c.a <= s.created_at AND s.created_at < c.b)),
    l AS (SELECT url, lag(content_hash) OVER (PARTITION BY url ORDER BY created_at, scan_id) AS old, content_hash, score, created_at, scan_id FROM r)
    SELECT url, arg_max(score, (created_at, scan_id)) AS score, count(*) FILTER (old <> content_hash) AS changes FROM l GROUP BY url""",
}
