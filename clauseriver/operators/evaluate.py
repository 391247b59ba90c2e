"""Measures of predictions against what is known: accuracy, stability, latency, golden gates."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.operators.merge import rating_of, score
from clauseriver.sources import corpus as C


def read_eval_cases(spark, path: str) -> DataFrame:
    """Labelled cases, one JSON object a line."""
    pillars = ", ".join(f"{p}: boolean" for p in R.PILLARS)
    schema = f"id string, text string, service string, source string, category string, complexity string, size string, notes string, expected struct<rating: string, pillars: struct<{pillars}>>"
    return spark.read.schema(schema).json(path)


def read_text_files(spark, path: str) -> DataFrame:
    """One row for each whole file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def accuracy_check(detected: DataFrame, truth: DataFrame, key: tuple[str, ...] = ("service",)) -> DataFrame:
    """service (or the key), true_positives, false_negatives, false_positives, precision, recall.

    detected (service, detected array) and truth (service, known array). Nothing known and nothing found is perfect;
    finding nothing of what is known has precision 0.
    """
    rows = truth.join(detected, list(key), "left").withColumn("detected", F.coalesce("detected", F.array().cast("array<string>")))
    tp = F.array_sort(F.array_intersect("known", "detected"))
    n, k = F.size("detected"), F.size("known")
    rows = rows.withColumn("true_positives", tp).withColumn("false_negatives", F.array_sort(F.array_except("known", "detected"))).withColumn("false_positives", F.array_sort(F.array_except("detected", "known")))
    precision = F.when(n > 0, F.size("true_positives") / n).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
    recall = F.when(k > 0, F.size("true_positives") / k).otherwise(1.0)
    return rows.withColumn("precision", precision).withColumn("recall", recall)


def battery_summary(results: DataFrame) -> DataFrame:
    """By scan type, and by scan type and grade (null: all grades)."""
    both = results.groupingSets([["scan_type"], ["scan_type", "grade"]], "scan_type", "grade")
    return both.agg(F.count_if("rating_match").alias("correct"), F.count("*").alias("total"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("precision", "recall", "latency_s")])


def confusion_rates(results: DataFrame) -> DataFrame:
    """scan_type, true_negative_rate over services expected SAFE, true_positive_rate over RISKY, safe services flagged."""
    safe, risky = F.col("expected_rating") == "SAFE", F.col("expected_rating") == "RISKY"
    hit = F.col("rating_match").cast("int")
    return results.groupBy("scan_type").agg(
        F.round(F.avg(F.when(safe, hit)), 6).alias("true_negative_rate"), F.round(F.avg(F.when(risky, hit)), 6).alias("true_positive_rate"),
        F.count_if(safe & (F.size("false_positives") > 0)).alias("safe_flagged"),
    )


def ensemble_gain(results: DataFrame) -> DataFrame:
    mean = lambda c, t: F.avg(F.when(F.col("scan_type") == t, F.col(c)))
    return results.agg(*[F.round(mean(c, "DEEP") - mean(c, "BASIC"), 6).alias(f"{c}_gain") for c in ("recall", "precision")])


def error_breakdown(results: DataFrame) -> DataFrame:
    """kind (missed, over-flagged), pillar, count."""
    rows = [results.select(F.lit(k).alias("kind"), F.explode(c).alias("pillar")) for k, c in (("missed", "false_negatives"), ("over-flagged", "false_positives"))]
    return rows[0].union(rows[1]).groupBy("kind", "pillar").count()


def grade_profile(results: DataFrame) -> DataFrame:
    deep = F.col("scan_type") == "DEEP"
    return results.groupBy("grade").agg(F.count_distinct("service").alias("services"), F.round(F.avg(F.when(deep, F.col("recall"))), 6).alias("deep_recall"))


def accuracy_grid(results: DataFrame) -> DataFrame:
    return results.groupBy("service").pivot("scan_type", ["BASIC", "DEEP"]).agg(F.bool_and("rating_match")).withColumnsRenamed({"BASIC": "basic", "DEEP": "deep"})


def eval_accuracy(predicted: DataFrame, cases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pillars_pct over labelled pillars (0 without any), rating_pct over all cases, parse_fails; for each of by, if given.

    predicted (id, pillar, violation, rating; null pillar where parsing failed), cases (id, pillar, expected, expected_rating). An answer
    without a rating counts as unparsed, unless predicted says parse_ok.
    """
    if "parse_ok" not in predicted.columns:
        predicted = predicted.withColumn("parse_ok", F.col("rating").isNotNull())
    rows = cases.join(predicted, [*by, "id", "pillar"], "left")
    case = rows.groupBy(*by, "id").agg(
        F.count_if(F.coalesce("violation", F.lit(False)) == F.col("expected")).alias("ok"), F.count("expected").alias("total"),
        F.max(F.col("rating") == F.col("expected_rating")).alias("rating_ok"), F.max("parse_ok").alias("parse_ok"),
    )
    parsed = F.coalesce("parse_ok", F.lit(False))
    right = F.try_divide(100 * F.sum(F.when(parsed, F.col("ok")).otherwise(0)), F.sum(F.when(parsed, F.col("total")).otherwise(0)))
    return case.groupBy(*by).agg(
        F.round(F.coalesce(right, F.lit(0.0)), 6).alias("pillars_pct"),
        F.round(100 * F.count_if("rating_ok") / F.count("*"), 6).alias("rating_pct"), F.count_if(~parsed).alias("parse_fails"),
    )


def latency_percentiles(df: DataFrame, by: list[str], points: list[int], value: str = "latency_ms") -> DataFrame:
    """The value at index min(n - 1, floor(p * n / 100)) of each group's sorted values, as p50, p90, ...; min and max.

    Ranks come from counts of equal values, which are summed before the shuffle.
    """
    counts = df.groupBy(*by, value).count()
    w = W.partitionBy(*by)
    upto = F.sum("count").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = counts.withColumn("_upto", upto).withColumn("_n", F.sum("count").over(w))
    pick = lambda p: F.min(F.when(F.col("_upto") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * p / 100)), F.col(value))).alias(f"p{p}")
    return rows.groupBy(*by).agg(*map(pick, points), F.min(value).alias("min"), F.max(value).alias("max"))


def normalize_rating(rating: Column, computed: Column, own: Column) -> Column:
    """By the score computed from pillars (50, 90) if there is one; else only labels that contradict the own score."""
    by_own = F.when(own < 50, "RISKY").when((own < 90) & (rating == "SAFE"), "OKAY").when((own >= 90) & (rating == "RISKY"), "OKAY").otherwise(rating)
    return F.when(rating.isNull(), rating).when(computed.isNotNull(), F.when(computed < 50, "RISKY").when(computed < 90, "OKAY").otherwise("SAFE")).when(own.isNull(), rating).otherwise(by_own)


def stability(trials: DataFrame, n_trials: int) -> DataFrame:
    """id, stable, score_range; trials (id, trial, rating, score). A trial without a row is MISSING, without a rating NULL."""
    case = trials.groupBy("id").agg(F.count_distinct(F.coalesce("rating", F.lit("NULL"))).alias("d"), F.count_distinct("trial").alias("t"), (F.max("score") - F.min("score")).alias("score_range"))
    return case.select("id", ((F.col("d") == 1) & (F.col("t") == n_trials)).alias("stable"), "score_range")


def stability_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), F.count_if("stable").alias("stable_cases"), F.round(100 * F.count_if("stable") / F.count("*"), 2).alias("stability_pct"), F.round(F.avg("score_range"), 2).alias("avg_range"))


def model_bench(runs: DataFrame) -> DataFrame:
    """model, avg_latency, parse_pct, accuracy_pct over runs (latency, parse_ok, correct, total, error) without errors."""
    pct = lambda x: F.floor(100 * x + 0.5).cast("long")
    return runs.where("error IS NULL").groupBy("model").agg(F.floor(F.avg("latency") + 0.5).cast("long").alias("avg_latency"), pct(F.count_if("parse_ok") / F.count("*")).alias("parse_pct"), pct(F.sum("correct") / F.sum("total")).alias("accuracy_pct"))


def citation_verified(citation: Column, source: Column) -> Column:
    """The first 50 normalised characters stand in the source; shorter ones than 20 pass."""
    prefix = F.substring(T.normalize(citation), 1, 50)
    return (F.length(prefix) < 20) | F.contains(T.normalize(source), prefix)


def golden_gate(findings: DataFrame, scores: DataFrame, cases: DataFrame) -> DataFrame:
    """doc_id, passed, reasons; cases (doc_id, text, must array, clear array, low, high)."""
    rows = findings.groupBy("doc_id").agg(F.collect_list(F.when(F.col("violation"), F.struct("pillar", "citation"))).alias("v"))
    rows = cases.join(rows, "doc_id").join(scores.select("doc_id", "score"), "doc_id")
    found = F.transform("v", lambda x: x["pillar"])
    false_quote = F.exists("v", lambda x: F.array_contains("must", x["pillar"]) & ~citation_verified(x["citation"], F.col("text")))
    tests = [("missed", F.size(F.array_except("must", found)) > 0), ("ungrounded", false_quote), ("false positive", F.size(F.array_intersect("clear", found)) > 0), ("score", ~F.col("score").between(F.col("low"), F.col("high")))]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))
    return rows.select("doc_id", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def category_accuracy(cases: DataFrame) -> DataFrame:
    """cases (category, rating, ok): counts and accuracy over the cube of category and rating."""
    return cases.cube("category", "rating").agg(F.count("*").alias("cases"), F.count_if("ok").alias("correct"))


def leakage(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Holdout ids whose text is in the training split too."""
    key = lambda d: d.withColumn("_h", F.sha2("text", 256))
    return key(holdout).join(key(train).select("_h"), "_h", "left_semi").select("doc_id")


# -- queries ------------------------------------------------------------------------------------------


def _results(s, d) -> DataFrame:
    """Scan results by service and type: what the model found against what the rules of the corpus plant."""
    f = C.findings(C.policies(s, d)).withColumn("service", F.concat(F.lit("svc"), (F.col("doc_id") % 25).cast("string")))
    share = f.groupBy("service", "pillar", "pillar_ord").agg(F.count("*").alias("n"), F.count_if("violation").alias("v"), F.count_if(F.expr("violation AND confidence = 'HIGH'")).alias("h"))
    number = F.substring("service", 4, 9).cast("int")
    sets = share.groupBy("service").agg(
        F.collect_set(F.when((number + F.col("pillar_ord")) % 4 < 2, F.col("pillar"))).alias("known"),
        F.collect_set(F.when(F.col("h") * 9 > F.col("n"), F.col("pillar"))).alias("basic"),
        F.collect_set(F.when(F.col("v") * 3 > F.col("n"), F.col("pillar"))).alias("deep"),
    )
    types = [accuracy_check(sets.select("service", F.col(c).alias("detected")), sets.select("service", "known")).withColumn("scan_type", F.lit(t)) for t, c in (("BASIC", "basic"), ("DEEP", "deep"))]
    out = types[0].unionByName(types[1])
    n = F.substring("service", 4, 9).cast("int")
    lost = F.size("detected") * (F.when(F.col("scan_type") == "BASIC", 20).otherwise(15))
    points = 100 - lost
    grade = F.get(F.array(*map(F.lit, "ABCDEF")), n % 6)
    expected = F.when(n % 6 < 2, "SAFE").when(n % 6 < 4, "OKAY").otherwise("RISKY")
    rating = rating_of(points, R.PROFILES["prod"])
    return out.select("service", "scan_type", grade.alias("grade"), expected.alias("expected_rating"), rating.alias("rating"), (rating == expected).alias("rating_match"), "precision", "recall", "false_negatives", "false_positives", (n * 1.5 + F.size("detected")).alias("latency_s"), "detected", "known")


def _cases(s, d):
    f = C.findings(C.policies(s, d))
    cases = f.select(F.col("doc_id").alias("id"), "pillar", F.when((F.col("doc_id") + F.col("pillar_ord")) % 9 != 0, (F.col("doc_id") + F.col("pillar_ord")) % 4 == 0).alias("expected"), F.get(F.array(*map(F.lit, ["SAFE", "OKAY", "RISKY"])), (F.col("doc_id") % 3).cast("int")).alias("expected_rating"))
    sc = score(f).select("doc_id", "rating")
    pred = f.join(sc, "doc_id").where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), "pillar", "violation", "rating")
    return pred, cases


def _split(s, d, name: str, of: str) -> DataFrame:
    return C.policies(s, d).where(of).select("doc_id", F.lit(name).alias("split"))


def _trials(s, d):
    p = C.policies(s, d).select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("trial"))
    n = F.col("id") + F.when(F.col("id") % 4 == 0, F.col("trial")).otherwise(0)
    rows = p.where("NOT (id % 17 = 0 AND trial = 2)")
    return rows.select("id", "trial", F.when(F.col("id") % 19 != 0, F.get(F.array(*map(F.lit, ["SAFE", "OKAY", "RISKY"])), (n % 3).cast("int"))).alias("rating"), (n * 7 % 100).alias("score"))


def _golden(s, d):
    docs = C.policies(s, d)
    f = C.findings(docs)
    arr = lambda k: F.array_compact(F.array(*[F.when((F.col("doc_id") * 7 + (i + 1) * 13) % 3 == k, F.lit(p)) for i, p in enumerate(R.PILLARS)]))
    some = F.when(F.col("doc_id") % 5 == 0, F.lit("dark_patterns"))
    cases = docs.select("doc_id", "text", F.array_distinct(F.array_compact(F.concat(arr(0), F.array(some)))).alias("must"), arr(F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1)).alias("clear"), F.lit(20).alias("low"), F.lit(90).alias("high"))
    return golden_gate(f, score(f), cases)


def _read_back(s, d) -> DataFrame:
    """Cases that were written as files, a JSON object a line, with what is read from them."""
    docs = C.policies(s, d)
    found = C.findings(docs).groupBy("doc_id").agg(*[F.bool_or(F.when(F.col("pillar") == p, F.col("violation"))).alias(p) for p in R.PILLARS])
    expected = F.struct(F.when(F.col("doc_id") % 3 == 0, "SAFE").otherwise("RISKY").alias("rating"), F.struct(*R.PILLARS).alias("pillars"))
    cases = docs.join(found, "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", "service", expected.alias("expected"))
    path = f"{C.shared_folder(s)}/cases-{uuid4().hex}"
    cases.write.json(path)
    back = read_eval_cases(s, path)
    return back.select("id", "service", "expected.rating", F.sha2("text", 256).alias("sha"), *[F.col(f"expected.pillars.{p}").alias(p) for p in R.PILLARS])


def _files(s, d) -> DataFrame:
    """The texts of each language as one file, read whole: characters without line ends, by language."""
    path = f"{C.shared_folder(s)}/texts-{uuid4().hex}"
    plain = C.policies(s, d).select(F.coalesce("lang", F.lit("none")).alias("lang"), F.regexp_replace("text", "\n", " ").alias("value"))
    plain.write.partitionBy("lang").text(path)
    files = read_text_files(s, f"{path}/*/*.txt").withColumn("lang", F.regexp_extract("path", "/lang=([^/]*)/", 1))
    return files.groupBy("lang").agg(F.sum(F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_chars"))


QUERIES = {
    "a4_read_eval_cases": _read_back,
    "a10_read_text_files": _files,
    "f13_accuracy_check": lambda s, d: _results(s, d).select("service", "scan_type", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.array_join("false_negatives", ",").alias("fn"), F.array_join("false_positives", ",").alias("fp")),
    "f14_battery_summary": lambda s, d: battery_summary(_results(s, d)),
    "f15_confusion_rates": lambda s, d: confusion_rates(_results(s, d)),
    "f16_ensemble_gain": lambda s, d: ensemble_gain(_results(s, d)),
    "f17_error_breakdown": lambda s, d: error_breakdown(_results(s, d)),
    "f18_grade_profile": lambda s, d: grade_profile(_results(s, d)),
    "f18_accuracy_grid": lambda s, d: accuracy_grid(_results(s, d)),
    "f19_eval_accuracy": lambda s, d: eval_accuracy(*_cases(s, d)),
    "f20_latency_percentiles": lambda s, d: latency_percentiles(C.scans(s, d), ["tier"], [50, 90]),
    "f21_normalize_rating": lambda s, d: C.scans(s, d).select("scan_id", normalize_rating(F.col("rating"), F.when(F.col("scan_id") % 3 == 0, F.col("scan_id") % 101), F.when(F.col("scan_id") % 5 != 0, (F.col("scan_id") * 3) % 101)).alias("rating")),
    "f22_stability": lambda s, d: stability(_trials(s, d), 3),
    "f22_stability_summary": lambda s, d: stability_summary(stability(_trials(s, d), 3)),
    "f23_model_bench": lambda s, d: model_bench(C.scans(s, d).select(F.col("tier").alias("model"), F.col("latency_ms").alias("latency"), (F.col("scan_id") % 7 != 0).alias("parse_ok"), (F.col("scan_id") % 6).alias("correct"), F.lit(6).alias("total"), F.when(F.col("scan_id") % 23 == 0, "timeout").alias("error"))),
    "f24_golden_gate": lambda s, d: _golden(s, d).select("doc_id", "passed", F.array_join("reasons", ",").alias("reasons")),
    "f26_category_accuracy": lambda s, d: category_accuracy(C.scans(s, d).select(F.col("tier").alias("category"), "rating", (F.col("scan_id") % 3 == 0).alias("ok"))),
    "x1_union_splits": lambda s, d: _split(s, d, "real", "lang = 'en'").unionByName(_split(s, d, "adversarial", "lang IS DISTINCT FROM 'en'")),
    "x2_pillar_sets": lambda s, d: C.findings(C.policies(s, d)).where("violation").select("doc_id", "pillar").exceptAll(C.findings(C.policies(s, d)).where("confidence = 'LOW'").select("doc_id", "pillar")),
    "x3_leakage": lambda s, d: leakage(C.read(s, d, "documents").where("doc_id % 2 = 0"), C.read(s, d, "documents").where("doc_id % 2 = 1")),
}
_score = "100 - len(detected) * CASE WHEN scan_type = 'BASIC' THEN 20 ELSE 15 END"
RESULTS_SQL = f"""WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}, fs AS (SELECT *, 'svc' || (doc_id % 25) AS service FROM findings),
sh AS (SELECT service, pillar, pillar_ord, count(*) AS n, count(*) FILTER (violation) AS v, count(*) FILTER (violation AND confidence = 'HIGH') AS h FROM fs GROUP BY ALL),
t AS (SELECT service, coalesce(list(pillar) FILTER ((CAST(substr(service, 4) AS INT) + pillar_ord) % 4 < 2), []) AS known,
  coalesce(list(pillar) FILTER (h * 9 > n), []) AS basic, coalesce(list(pillar) FILTER (v * 3 > n), []) AS deep FROM sh GROUP BY service),
u AS (SELECT service, 'BASIC' AS scan_type, known, basic AS detected FROM t UNION ALL SELECT service, 'DEEP', known, deep FROM t),
r0 AS (SELECT *, CAST(substr(service, 4) AS INT) AS n, len(list_intersect(known, detected)) AS tp, list_sort(list_filter(known, lambda p: NOT list_contains(detected, p))) AS false_negatives, list_sort(list_filter(detected, lambda p: NOT list_contains(known, p))) AS false_positives FROM u),
r1 AS (SELECT *, CASE WHEN {_score} < 50 THEN 'RISKY' WHEN {_score} < 80 THEN 'OKAY' ELSE 'SAFE' END AS rating, CASE WHEN n % 6 < 2 THEN 'SAFE' WHEN n % 6 < 4 THEN 'OKAY' ELSE 'RISKY' END AS expected_rating,
  substr('ABCDEF', n % 6 + 1, 1) AS grade, CASE WHEN len(detected) > 0 THEN tp / len(detected) WHEN len(known) = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN len(known) > 0 THEN tp / len(known) ELSE 1.0 END AS recall, n * 1.5 + len(detected) AS latency_s FROM r0),
results AS (SELECT *, rating = expected_rating AS rating_match FROM r1)"""


def _prod_scores() -> str:
    from clauseriver.operators.merge import _score_sql

    return _score_sql("prod")


_trials_sql = f"""WITH {C.POLICIES_SQL}, t0 AS (SELECT doc_id AS id, trial, doc_id + CASE WHEN doc_id % 4 = 0 THEN trial ELSE 0 END AS n FROM policies, (VALUES (1), (2), (3)) v(trial) WHERE NOT (doc_id % 17 = 0 AND trial = 2)),
trials AS (SELECT id, trial, CASE WHEN id % 19 <> 0 THEN ['SAFE', 'OKAY', 'RISKY'][CAST(n % 3 AS INT) + 1] END AS rating, n * 7 % 100 AS score FROM t0),
st AS (SELECT id, count(DISTINCT coalesce(rating, 'NULL')) = 1 AND count(DISTINCT trial) = 3 AS stable, max(score) - min(score) AS score_range FROM trials GROUP BY id)"""


def _golden_sql() -> str:
    from clauseriver.functions import duck as D

    pre = f"substr({D.normalize('citation')}, 1, 50)"
    return f"""WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}, {_prod_scores()}, j AS (SELECT f.*, text, score, violation AS v, (doc_id * 7 + pillar_ord * 13) % 3 AS m FROM findings f JOIN policies USING (doc_id) JOIN scores_prod USING (doc_id)),
    k AS (SELECT doc_id, any_value(score) AS score,
      bool_or((m = 0 OR (doc_id % 5 = 0 AND pillar = 'dark_patterns')) AND NOT v) AS missed,
      bool_or((m = 0 OR (doc_id % 5 = 0 AND pillar = 'dark_patterns')) AND v AND NOT (length({pre}) < 20 OR contains({D.normalize("text")}, {pre}))) AS ungrounded,
      bool_or(m = CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AND v) AS fp FROM j GROUP BY doc_id)
    SELECT doc_id, NOT missed AND NOT ungrounded AND NOT fp AND score BETWEEN 20 AND 90 AS passed,
      concat_ws(',', CASE WHEN missed THEN 'missed' END, CASE WHEN ungrounded THEN 'ungrounded' END, CASE WHEN fp THEN 'false positive' END, CASE WHEN score NOT BETWEEN 20 AND 90 THEN 'score' END) AS reasons FROM k"""


ORACLES = {
    "a4_read_eval_cases": f"""WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}
    SELECT CAST(doc_id AS VARCHAR) AS id, any_value(service) AS service, CASE WHEN doc_id % 3 = 0 THEN 'SAFE' ELSE 'RISKY' END AS rating, sha256(any_value(text)) AS sha,
      {", ".join(f"bool_or(violation) FILTER (pillar = '{p}') AS {p}" for p in R.PILLARS)} FROM findings JOIN policies USING (doc_id) GROUP BY doc_id""",
    "a10_read_text_files": f"WITH {C.POLICIES_SQL} SELECT coalesce(lang, 'none') AS lang, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM policies GROUP BY ALL",
    "f13_accuracy_check": f"{RESULTS_SQL} SELECT service, scan_type, round(precision, 6) AS precision, round(recall, 6) AS recall, array_to_string(false_negatives, ',') AS fn, array_to_string(false_positives, ',') AS fp FROM results",
    "f14_battery_summary": f"{RESULTS_SQL} SELECT scan_type, grade, count(*) FILTER (rating_match) AS correct, count(*) AS total, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(latency_s), 6) AS avg_latency_s FROM results GROUP BY GROUPING SETS ((scan_type), (scan_type, grade))",
    "f15_confusion_rates": f"{RESULTS_SQL} SELECT scan_type, round(avg(rating_match::INT) FILTER (expected_rating = 'SAFE'), 6) AS true_negative_rate, round(avg(rating_match::INT) FILTER (expected_rating = 'RISKY'), 6) AS true_positive_rate, count(*) FILTER (expected_rating = 'SAFE' AND len(false_positives) > 0) AS safe_flagged FROM results GROUP BY scan_type",
    "f16_ensemble_gain": f"{RESULTS_SQL} SELECT round(avg(recall) FILTER (scan_type = 'DEEP') - avg(recall) FILTER (scan_type = 'BASIC'), 6) AS recall_gain, round(avg(precision) FILTER (scan_type = 'DEEP') - avg(precision) FILTER (scan_type = 'BASIC'), 6) AS precision_gain FROM results",
    "f17_error_breakdown": f"{RESULTS_SQL}, e AS (SELECT 'missed' AS kind, unnest(false_negatives) AS pillar FROM results UNION ALL SELECT 'over-flagged', unnest(false_positives) FROM results) SELECT kind, pillar, count(*) AS count FROM e GROUP BY ALL",
    "f18_grade_profile": f"{RESULTS_SQL} SELECT grade, count(DISTINCT service) AS services, round(avg(recall) FILTER (scan_type = 'DEEP'), 6) AS deep_recall FROM results GROUP BY grade",
    "f18_accuracy_grid": f"{RESULTS_SQL} SELECT service, bool_and(rating_match) FILTER (scan_type = 'BASIC') AS basic, bool_and(rating_match) FILTER (scan_type = 'DEEP') AS deep FROM results GROUP BY service",
    "f19_eval_accuracy": f"""WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}, {_prod_scores()}, c AS (SELECT doc_id AS id, pillar, CASE WHEN (doc_id + pillar_ord) % 9 <> 0 THEN (doc_id + pillar_ord) % 4 = 0 END AS expected, ['SAFE', 'OKAY', 'RISKY'][CAST(doc_id % 3 AS INT) + 1] AS er, violation FROM findings),
    p AS (SELECT doc_id AS id, rating FROM scores_prod WHERE doc_id % 10 <> 0), k AS (SELECT id, count(*) FILTER (violation = expected) AS ok, count(expected) AS total, any_value(er) AS er FROM c GROUP BY id)
    SELECT round(100 * sum(CASE WHEN rating IS NOT NULL THEN ok ELSE 0 END) / sum(CASE WHEN rating IS NOT NULL THEN total ELSE 0 END), 6) AS pillars_pct, round(100 * count(*) FILTER (rating = er) / count(*), 6) AS rating_pct, count(*) FILTER (rating IS NULL) AS parse_fails FROM k LEFT JOIN p USING (id)""",
    "f20_latency_percentiles": f"""WITH {C.SCANS_SQL}, k AS (SELECT tier, latency_ms, row_number() OVER (PARTITION BY tier ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY tier) AS n FROM scans)
    SELECT tier, max(latency_ms) FILTER (i = least(n - 1, floor(n * 50 / 100))) AS p50, max(latency_ms) FILTER (i = least(n - 1, floor(n * 90 / 100))) AS p90, min(latency_ms) AS min, max(latency_ms) AS max FROM k GROUP BY tier""",
    "f21_normalize_rating": f"""WITH {C.SCANS_SQL}, k AS (SELECT scan_id, rating, CASE WHEN scan_id % 3 = 0 THEN scan_id % 101 END AS c, CASE WHEN scan_id % 5 <> 0 THEN (scan_id * 3) % 101 END AS o FROM scans)
    SELECT scan_id, CASE WHEN c IS NOT NULL THEN CASE WHEN c < 50 THEN 'RISKY' WHEN c < 90 THEN 'OKAY' ELSE 'SAFE' END WHEN o IS NULL THEN rating WHEN o < 50 THEN 'RISKY' WHEN o < 90 AND rating = 'SAFE' THEN 'OKAY' WHEN o >= 90 AND rating = 'RISKY' THEN 'OKAY' ELSE rating END AS rating FROM k""",
    "f22_stability": f"{_trials_sql} SELECT * FROM st",
    "f22_stability_summary": f"{_trials_sql} SELECT count(*) AS cases, count(*) FILTER (stable) AS stable_cases, round(100 * count(*) FILTER (stable) / count(*), 2) AS stability_pct, round(avg(score_range), 2) AS avg_range FROM st",
    "f23_model_bench": f"""WITH {C.SCANS_SQL} SELECT tier AS model, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency, CAST(floor(100 * (count(*) FILTER (scan_id % 7 <> 0) / count(*)) + 0.5) AS BIGINT) AS parse_pct, CAST(floor(100 * (sum(scan_id % 6) / (6 * count(*))) + 0.5) AS BIGINT) AS accuracy_pct FROM scans WHERE scan_id % 23 <> 0 GROUP BY tier""",
    "f24_golden_gate": _golden_sql(),
    "f26_category_accuracy": f"WITH {C.SCANS_SQL} SELECT tier AS category, rating, count(*) AS cases, count(*) FILTER (scan_id % 3 = 0) AS correct FROM scans GROUP BY CUBE (tier, rating)",
    "x1_union_splits": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'real' ELSE 'adversarial' END AS split FROM documents",
    "x2_pillar_sets": f"WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL} SELECT doc_id, pillar FROM findings WHERE violation EXCEPT ALL SELECT doc_id, pillar FROM findings WHERE confidence = 'LOW'",
    "x3_leakage": "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
}
