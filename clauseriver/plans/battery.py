"""The battery: services scanned twice, by quick answers and by an ensemble of deep ones, and held against what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.functions import duck as D
from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.operators import detect, evaluate, merge, pages
from clauseriver.sources import corpus as C

SCAN = ("doc_id", "scan_type")
#: Characters of a privacy policy that are fetched, and of these, that the model sees.
POLICY_FETCHED, POLICY_SHOWN = 60_000, 55_000


def battery_requests(services: DataFrame, web: DataFrame) -> DataFrame:
    """doc_id, kind, text: what the models are asked about.

    services (doc_id, policy_id, cut), web (page_id, html). Of a service's page the models see the first cut characters. A
    privacy policy is asked about once, whatever the number of its services, and only if it has a word of trade or sharing. A page
    is made a text once, whatever it is asked for.
    """
    asked = services.select("doc_id", "cut", F.lit(False).alias("policy")).unionByName(services.select(F.col("policy_id").alias("doc_id"), F.lit(None).cast("int").alias("cut"), F.lit(True).alias("policy")))
    asked = asked.groupBy("doc_id").agg(F.max("cut").alias("cut"), F.bool_or("policy").alias("policy"))
    texts = pages.pages_to_text(web).withColumnRenamed("page_id", "doc_id").join(asked, "doc_id")
    text = F.col("text")
    gate = T.let(F.lower(F.substring(text, 1, POLICY_FETCHED)), detect.has_trade_words)
    head = F.when(F.col("cut").isNotNull(), F.struct(F.lit("service").alias("kind"), F.substring(text, F.lit(1), F.col("cut")).alias("text")))
    shown = F.when(F.col("policy") & gate, F.struct(F.lit("policy").alias("kind"), F.substring(text, 1, POLICY_SHOWN).alias("text")))
    return texts.select("doc_id", F.inline(F.array_compact(F.array(head, shown))))


def policy_found(services: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, pp_found: whether the answer about the service's privacy policy finds a sale of data."""
    said = F.from_json(merge.json_body(F.col("raw_json")), "data_selling boolean, reason string")
    found = answers.where("tier = 'policy'").groupBy(F.col("doc_id").alias("policy_id")).agg(F.bool_or(F.coalesce(said["data_selling"], F.lit(False))).alias("pp_found"))
    return services.select("doc_id", "policy_id").join(found, "policy_id", "left").select("doc_id", F.coalesce("pp_found", F.lit(False)).alias("pp_found"))


def battery_findings(services: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, scan_type, pillar, violation, confidence, citation, rule_id.

    answers (doc_id, chunk_no, model, tier, raw_json) of tier quick, deep or policy. DEEP: each model's chunks by confidence, a gated
    ensemble. BASIC: the OR of the quick answers, HIGH and without a citation. Both learn from the privacy policy, then the overrides
    apply. A deep scan always has its six pillars, as clear ones where no answer can be read; a basic scan without any
    answer exists only if the privacy policy says something.
    """
    long = merge.output_findings(merge.parse_model_output(answers.where("tier = 'deep'")))
    deep = merge.ensemble_merge(*[merge.merge_chunks(long.where(F.col("model") == m), "confidence") for m in ("primary", "corroborator")], gate="HIGH")
    quick = merge.parse_model_output(answers.where("tier = 'quick'"), "quick")
    flat = merge.merge_quick(quick).unpivot(["doc_id"], R.PILLARS, "pillar", "violation").where("violation IS NOT NULL")
    flat = flat.select("doc_id", "pillar", "violation", F.lit("HIGH").alias("confidence"), F.lit("").alias("citation"))
    found = deep.withColumn("scan_type", F.lit("DEEP")).unionByName(flat.withColumn("scan_type", F.lit("BASIC")))

    shown = policy_found(services, answers)
    heard = quick.where("parse_ok OR tldr IS NOT NULL").select("doc_id").distinct().withColumn("heard", F.lit(True))
    known = shown.join(heard, "doc_id", "left")
    kinds = F.when(F.col("pp_found") | F.col("heard"), F.array(F.lit("BASIC"), F.lit("DEEP"))).otherwise(F.array(F.lit("DEEP")))
    grid = known.select("doc_id", F.explode(kinds).alias("scan_type")).withColumn("pillar", F.explode(F.array(*map(F.lit, R.PILLARS))))
    rows = grid.join(found, [*SCAN, "pillar"], "full").withColumn("violation", F.coalesce("violation", F.lit(False)))
    rows = detect.apply_pp_finding(rows, shown)
    basic = F.col("scan_type") == "BASIC"
    rows = rows.withColumn("confidence", F.when(basic, "HIGH").otherwise(F.col("confidence"))).withColumn("citation", F.when(basic, "").otherwise(F.col("citation")))
    return detect.rule_overrides(rows)


def battery_results(services: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per service and scan type: score, rating, precision, recall, what was missed and over-flagged, seconds and tokens."""
    found = battery_findings(services, answers)
    seen = found.groupBy(*SCAN).agg(F.array_compact(F.collect_list(F.when(F.col("violation"), F.col("pillar")))).alias("detected"))
    seen = seen.join(merge.score(found, "battery", SCAN).select(*SCAN, "score", "rating"), list(SCAN))
    kind = F.when(F.col("tier") == "quick", "BASIC").otherwise("DEEP")
    spent = answers.where("tier <> 'policy'").groupBy("doc_id", kind.alias("scan_type")).agg(F.sum("latency_s").alias("latency_s"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"))
    truth = services.withColumn("scan_type", F.explode(F.array(F.lit("BASIC"), F.lit("DEEP")))).join(seen.select(*SCAN, "score", "rating"), list(SCAN)).join(spent, list(SCAN), "left")
    rows = evaluate.accuracy_check(seen.select(*SCAN, "detected"), truth, SCAN)
    return rows.select(
        "doc_id", "service", "scan_type", "grade", "expected_rating", "score", "rating", (F.col("rating") == F.col("expected_rating")).alias("rating_match"),
        "precision", "recall", "false_negatives", "false_positives", F.round("latency_s", 1).alias("latency_s"), "tokens_in", "tokens_out",
    )


# -- queries ------------------------------------------------------------------------------------------


def services(web: DataFrame) -> DataFrame:
    """A service for each page; three neighbours share a privacy policy."""
    n = F.col("page_id")
    known = F.array_compact(F.array(*[F.when((n + i + 1) % 4 < 2, F.lit(p)) for i, p in enumerate(R.PILLARS)]))
    return web.select(
        n.alias("doc_id"), F.concat(F.lit("svc"), n.cast("string")).alias("service"), (n - n % 3).alias("policy_id"), F.when(n % 5 == 0, 2500).otherwise(2000).alias("cut"),
        F.get(F.array(*map(F.lit, "ABCDEF")), (n % 6).cast("int")).alias("grade"), F.when(n % 6 < 2, "SAFE").when(n % 6 < 4, "OKAY").otherwise("RISKY").alias("expected_rating"),
        F.when(n % 6 == 0, F.array().cast("array<string>")).otherwise(known).alias("known"),
    )


def answers(requests: DataFrame) -> DataFrame:
    """A quick and two deep answers about each service, one about each policy; some broken, some silent on a pillar."""
    kinds = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(m).alias("model")) for t, m in (("quick", "primary"), ("deep", "primary"), ("deep", "corroborator"))])
    policy = F.array(F.struct(F.lit("policy").alias("tier"), F.lit("primary").alias("model")))
    rows = requests.select("doc_id", "text", F.inline(F.when(F.col("kind") == "policy", policy).otherwise(kinds)))
    own = (F.col("model") == "primary").cast("int") + F.when(F.col("tier") == "quick", 3).otherwise(0)
    whole, flags, entries = F.col("doc_id") * 5 + own, [], []
    for i, p in enumerate(R.PILLARS):
        n = F.col("doc_id") * 7 + 13 * (i + 1) + own
        silent, yes, kind = (F.col("doc_id") + i + 1) % 10 == 0, n % 3 == 0, n % 7
        cited = (
            F.when(kind <= 2, C._pick(C.CLAUSES, (F.col("doc_id") + 5 * (i + 1)) % len(C.CLAUSES))).when(kind == 3, F.lit("[NOT_FOUND]"))
            .when(kind == 4, F.right(F.col("text"), F.lit(80))).when(kind == 5, F.substring("text", 1, 80)).otherwise(F.lit("Feedback is licensed to the company."))
        )
        sure = C._pick(["HIGH", "MEDIUM", "LOW"], F.floor(n / 3) % 3)
        flags.append(F.when(~silent, yes).alias(p))
        entries.append(F.when(~silent, F.struct(F.lit(p).alias("key"), F.struct(yes.alias("violation"), cited.alias("citation"), sure.alias("confidence")).alias("value"))))
    tldr = F.lit("Short.").alias("tldr")
    body = (
        F.when(F.col("tier") == "policy", F.to_json(F.struct((whole % 2 == 0).alias("data_selling"), F.lit("As it says.").alias("reason"))))
        .when(F.col("tier") == "quick", F.to_json(F.struct(tldr, *flags)))
        .otherwise(F.to_json(F.struct(tldr, F.map_from_entries(F.array_compact(F.array(*entries))).alias("pillars"))))
    )
    return rows.select(
        "doc_id", F.lit(0).alias("chunk_no"), "model", "tier", F.when(whole % 11 == 0, F.lit("Sorry, I can not do that.")).otherwise(body).alias("raw_json"),
        (whole % 40 / 4).alias("latency_s"), (whole % 900 + 100).alias("input_tokens"), (whole % 90 + 10).alias("output_tokens"),
    )


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, each with two clauses."""
    n = len(C.CLAUSES)
    clause = lambda k: F.concat(F.lit("<p>"), C._pick(C.CLAUSES, k), F.lit("</p>"))
    web = C.read(spark, sf_dir, "pages")
    return web.select("page_id", F.concat(clause(F.col("page_id") % n), F.coalesce("html", F.lit("")), clause((F.col("page_id") * 7 + 3) % n)).alias("html"))


def _battery(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        web = _web(spark, sf_dir)
        all_services = services(web)
        return run(all_services, C.stored(answers(battery_requests(all_services, web))))

    return query


def _results(run):
    return _battery(lambda s, a: run(battery_results(s, a)))


def _shown(results: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(c, ",").alias(c)
    return results.select("doc_id", "scan_type", "score", "rating", "rating_match", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), text("false_negatives"), text("false_positives"), "latency_s", "tokens_in", "tokens_out")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = _web(spark, sf_dir)
    return battery_requests(services(web), web).select("doc_id", "kind", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


QUERIES = {
    "p2_battery_requests": _requests,
    "p2_battery_findings": _battery(lambda s, a: battery_findings(s, a).select("doc_id", "scan_type", "pillar", "violation", "confidence", "citation", "rule_id")),
    "p2_battery_results": _results(_shown),
    "p2_battery_summary": _results(evaluate.battery_summary),
    "p2_battery_rates": _results(evaluate.confusion_rates),
    "p2_battery_gain": _results(evaluate.ensemble_gain),
    "p2_battery_errors": _results(evaluate.error_breakdown),
}


def _clause_sql(k: str) -> str:
    return f"'<p>' || {C._list(C.CLAUSES)}[CAST({k} % {len(C.CLAUSES)} AS INT) + 1] || '</p>'"


REQUESTS_SQL = f"""WITH web AS (SELECT page_id AS doc_id, {_clause_sql("page_id")} || coalesce(html, '') || {_clause_sql("(page_id * 7 + 3)")} AS html FROM pages),
texts AS MATERIALIZED (SELECT doc_id, substr({pages._plain_sql(pages._drop)}, 1, 120000) AS text FROM web),
pillar_list AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {i + 1})" for i, p in enumerate(R.PILLARS))}) AS t(pillar, pillar_ord)),
services AS (SELECT page_id AS doc_id, page_id - page_id % 3 AS policy_id, CASE WHEN page_id % 5 = 0 THEN 2500 ELSE 2000 END AS cut, substr('ABCDEF', CAST(page_id % 6 AS INT) + 1, 1) AS grade,
  CASE WHEN page_id % 6 < 2 THEN 'SAFE' WHEN page_id % 6 < 4 THEN 'OKAY' ELSE 'RISKY' END AS expected_rating FROM pages),
fetched AS (SELECT doc_id, substr(text, 1, {POLICY_FETCHED}) AS text FROM texts WHERE doc_id IN (SELECT policy_id FROM services)),
requests AS (SELECT doc_id, 'service' AS kind, substr(text, 1, cut) AS text FROM texts JOIN services USING (doc_id)
  UNION ALL SELECT doc_id, 'policy', substr(text, 1, {POLICY_SHOWN}) FROM fetched WHERE {D.any_in("lower(text)", R.COMMERCIAL_WORDS + R.SHARING_WORDS)})"""
#: Answers as rows, without the detour by JSON; broken ones and silence are left out.
FOUND_SQL = f"""{REQUESTS_SQL},
asked AS (SELECT doc_id, text, tier, model, CAST(model = 'primary' AS INT) + CASE WHEN tier = 'quick' THEN 3 ELSE 0 END AS own FROM requests, (VALUES ('quick', 'primary'), ('deep', 'primary'), ('deep', 'corroborator')) AS m(tier, model) WHERE kind = 'service'),
said AS (SELECT doc_id, tier, model, pillar, n % 3 = 0 AS violation, ['HIGH', 'MEDIUM', 'LOW'][CAST((n // 3) % 3 AS INT) + 1] AS confidence,
    CASE WHEN n % 7 <= 2 THEN {C._list(C.CLAUSES)}[CAST((doc_id + 5 * pillar_ord) % {len(C.CLAUSES)} AS INT) + 1] WHEN n % 7 = 3 THEN '[NOT_FOUND]' WHEN n % 7 = 4 THEN right(text, 80) WHEN n % 7 = 5 THEN substr(text, 1, 80)
      ELSE 'Feedback is licensed to the company.' END AS citation
  FROM (SELECT *, doc_id * 7 + 13 * pillar_ord + own AS n FROM asked, pillar_list) WHERE (doc_id * 5 + own) % 11 <> 0 AND (doc_id + pillar_ord) % 10 <> 0),
shown AS (SELECT s.doc_id, coalesce((r.doc_id * 5 + 1) % 11 <> 0 AND (r.doc_id * 5 + 1) % 2 = 0, false) AS pp FROM services s LEFT JOIN requests r ON r.doc_id = s.policy_id AND r.kind = 'policy'),
scans AS (SELECT doc_id, 'DEEP' AS scan_type, pp FROM shown UNION ALL SELECT doc_id, 'BASIC', pp FROM shown WHERE pp OR (doc_id * 5 + 4) % 11 <> 0),
a AS (SELECT * FROM said WHERE tier = 'deep' AND model = 'primary'), b AS (SELECT * FROM said WHERE tier = 'deep' AND model = 'corroborator'),
both_models AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.pillar, b.pillar) AS pillar, a.doc_id IS NOT NULL AS has_a,
    b.doc_id IS NOT NULL AND CASE WHEN a.doc_id IS NULL OR (b.violation AND NOT a.violation) THEN NOT (b.violation AND b.confidence <> 'HIGH') ELSE a.violation AND b.violation AND {D.conf_rank("b.confidence")} > {D.conf_rank("a.confidence")} END AS take,
    a.violation AS av, a.confidence AS ac, a.citation AS aq, b.violation AS bv, b.confidence AS bc, b.citation AS bq FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pillar = b.pillar),
found AS (SELECT doc_id, 'DEEP' AS scan_type, pillar, CASE WHEN take THEN bv ELSE av END AS violation, CASE WHEN take THEN bc ELSE ac END AS confidence, CASE WHEN take THEN bq ELSE aq END AS citation FROM both_models WHERE take OR has_a
  UNION ALL SELECT doc_id, 'BASIC', pillar, violation, NULL, NULL FROM said WHERE tier = 'quick'),
rows AS (SELECT doc_id, scan_type, pillar, pillar_ord, pillar = 'data_selling' AND pp AND NOT coalesce(violation, false) AS up, coalesce(violation, false) AS violation, confidence, citation
  FROM scans CROSS JOIN pillar_list LEFT JOIN found USING (doc_id, scan_type, pillar)),
raised AS (SELECT doc_id, scan_type, pillar, pillar_ord, violation OR up AS violation, CASE WHEN scan_type = 'BASIC' THEN 'HIGH' WHEN up THEN 'MEDIUM' ELSE confidence END AS confidence,
  CASE WHEN scan_type = 'BASIC' THEN '' WHEN up THEN '[Found in Privacy Policy]' ELSE citation END AS citation FROM rows),
ruled AS (SELECT *, {detect._rule_sql(3)} AS rule_id FROM raised),
final AS (SELECT doc_id, scan_type, pillar, pillar_ord, violation AND rule_id IS NULL AS violation, CASE WHEN rule_id IS NOT NULL THEN 'MEDIUM' ELSE confidence END AS confidence, citation, rule_id FROM ruled)"""
BATTERY_SQL = f"""{FOUND_SQL}, {merge._score_sql("battery", "final", "doc_id, scan_type")},
marks AS (SELECT *, violation AS d, (doc_id + pillar_ord) % 4 < 2 AND doc_id % 6 <> 0 AS k FROM final),
hits AS (SELECT doc_id, scan_type, count(*) FILTER (d AND k) AS tp, count(*) FILTER (d) AS nd, count(*) FILTER (k) AS nk,
  coalesce(list(pillar ORDER BY pillar) FILTER (k AND NOT d), []) AS false_negatives, coalesce(list(pillar ORDER BY pillar) FILTER (d AND NOT k), []) AS false_positives FROM marks GROUP BY ALL),
spent AS (SELECT doc_id, CASE WHEN tier = 'quick' THEN 'BASIC' ELSE 'DEEP' END AS scan_type, round(sum((doc_id * 5 + own) % 40 / 4), 1) AS latency_s, CAST(sum((doc_id * 5 + own) % 900 + 100) AS BIGINT) AS tokens_in,
  CAST(sum((doc_id * 5 + own) % 90 + 10) AS BIGINT) AS tokens_out FROM asked GROUP BY ALL),
results AS (SELECT doc_id, scan_type, grade, expected_rating, score, rating, rating = expected_rating AS rating_match, CASE WHEN nd > 0 THEN tp / nd WHEN nk = 0 THEN 1.0 ELSE 0.0 END AS precision,
  CASE WHEN nk > 0 THEN tp / nk ELSE 1.0 END AS recall, false_negatives, false_positives, latency_s, tokens_in, tokens_out FROM hits JOIN scores_battery USING (doc_id, scan_type) JOIN services USING (doc_id) LEFT JOIN spent USING (doc_id, scan_type))"""
ORACLES = {
    "p2_battery_requests": f"{REQUESTS_SQL} SELECT doc_id, kind, length(text) AS n_chars, sha256(text) AS sha FROM requests",
    "p2_battery_findings": f"{FOUND_SQL} SELECT doc_id, scan_type, pillar, violation, confidence, citation, rule_id FROM final",
    "p2_battery_results": f"""{BATTERY_SQL} SELECT doc_id, scan_type, score, rating, rating_match, round(precision, 6) AS precision, round(recall, 6) AS recall, array_to_string(false_negatives, ',') AS false_negatives,
      array_to_string(false_positives, ',') AS false_positives, latency_s, tokens_in, tokens_out FROM results""",
    "p2_battery_summary": f"{BATTERY_SQL} SELECT scan_type, grade, count(*) FILTER (rating_match) AS correct, count(*) AS total, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(latency_s), 6) AS avg_latency_s FROM results GROUP BY GROUPING SETS ((scan_type), (scan_type, grade))",
    "p2_battery_rates": f"{BATTERY_SQL} SELECT scan_type, round(avg(rating_match::INT) FILTER (expected_rating = 'SAFE'), 6) AS true_negative_rate, round(avg(rating_match::INT) FILTER (expected_rating = 'RISKY'), 6) AS true_positive_rate, count(*) FILTER (expected_rating = 'SAFE' AND len(false_positives) > 0) AS safe_flagged FROM results GROUP BY scan_type",
    "p2_battery_gain": f"{BATTERY_SQL} SELECT round(avg(recall) FILTER (scan_type = 'DEEP') - avg(recall) FILTER (scan_type = 'BASIC'), 6) AS recall_gain, round(avg(precision) FILTER (scan_type = 'DEEP') - avg(precision) FILTER (scan_type = 'BASIC'), 6) AS precision_gain FROM results",
    "p2_battery_errors": f"{BATTERY_SQL}, e AS (SELECT 'missed' AS kind, unnest(false_negatives) AS pillar FROM results UNION ALL SELECT 'over-flagged', unnest(false_positives) FROM results) SELECT kind, pillar, count(*) AS count FROM e GROUP BY ALL",
}
