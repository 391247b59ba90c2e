"""Evaluation of a model on labelled cases: cases are read from files, answers parsed and put right, then measured."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.functions import rules as R
from clauseriver.operators import evaluate, merge
from clauseriver.sources import corpus as C

ANSWER = f"rating string, score double, {merge.DEEP}"


def predictions(answers: DataFrame) -> DataFrame:
    """answers (id, tier, raw_json, ...) with pillars, rating, score and parse_ok.

    The rating follows the score of the pillars where there are any; else only labels that contradict the model's own score change.
    """
    parsed = answers.withColumn("_a", F.from_json(merge.json_body(F.col("raw_json"), repair=True), ANSWER))
    entries = F.transform(F.map_entries("_a.pillars"), lambda e: F.struct(e["key"].alias("pillar"), F.coalesce(e["value"]["violation"], F.lit(False)).alias("violation"), e["value"]["confidence"].alias("confidence")))
    computed = F.when(F.col("_a.pillars").isNotNull(), merge.score_array(entries)["score"])
    ok = F.coalesce(F.col("_a.rating").isNotNull() | F.col("_a.score").isNotNull() | F.col("_a.tldr").isNotNull() | F.col("_a.pillars").isNotNull(), F.lit(False))
    rating = evaluate.normalize_rating(F.col("_a.rating"), computed, F.col("_a.score"))
    return parsed.select(*answers.columns, "_a.pillars", rating.alias("rating"), F.col("_a.score").alias("score"), ok.alias("parse_ok"))


def model_report(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per tier: samples, pillars_pct, rating_pct, parse_fails, p50, p90, min, max of the milliseconds.

    cases as read from files; answers (id, tier, raw_json, latency_ms), one per case and tier; a case without an answer counts as unparsed.
    Quick answers are judged by their rating alone.
    """
    said = predictions(answers)
    violation = lambda p: F.struct(F.lit(p).alias("pillar"), F.coalesce(F.col("pillars")[p]["violation"], F.lit(False)).alias("violation"))
    predicted = said.select("tier", "id", "rating", "parse_ok", F.inline(F.array(*map(violation, R.PILLARS))))
    label = lambda p: F.struct(F.lit(p).alias("pillar"), F.col("expected.pillars")[p].alias("expected"))
    rows = cases.select("id", F.col("expected.rating").alias("expected_rating"), F.inline(F.array(*map(label, R.PILLARS))))
    rows = rows.withColumn("tier", F.explode(F.array(F.lit("quick"), F.lit("deep"))))
    rows = rows.withColumn("expected", F.when(F.col("tier") == "deep", F.col("expected")))
    sizes = rows.groupBy("tier").agg(F.count_distinct("id").alias("samples"))
    accuracy = evaluate.eval_accuracy(predicted, rows, ("tier",))
    times = evaluate.latency_percentiles(answers, ["tier"], [50, 90])
    return sizes.join(accuracy, "tier").join(times, "tier", "left")


def model_stability(answers: DataFrame, n_trials: int) -> DataFrame:
    """id, stable, score_range over trials of one tier; answers (id, trial, tier, raw_json). Ratings are those put right, scores the
    model's own."""
    return evaluate.stability(predictions(answers).select("id", "trial", "rating", "score"), n_trials)


# -- queries ------------------------------------------------------------------------------------------


def _cases(s: SparkSession, d: str) -> DataFrame:
    """Labelled cases, written as files and read back; some pillars have no label."""
    n = F.col("doc_id")
    labels = F.struct(*[F.when((n + i + 1) % 9 != 0, (n + i + 1) % 4 == 0).alias(p) for i, p in enumerate(R.PILLARS)])
    expected = F.struct(C._pick(["SAFE", "OKAY", "RISKY"], n % 3).alias("rating"), labels.alias("pillars"))
    path = f"{C.shared_folder(s)}/cases-{uuid4().hex}"
    C.policies(s, d).select(n.cast("string").alias("id"), "text", "service", expected.alias("expected")).write.json(path)
    return evaluate.read_eval_cases(s, path)


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Three trials of both tiers: a few broken, some without a rating or a score, a fourth changing from trial to trial."""
    rows = C.policies(s, d).select("doc_id", F.explode(F.array(F.lit("quick"), F.lit("deep"))).alias("tier"))
    rows = rows.withColumn("trial", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("NOT (doc_id % 19 = 0 AND trial = 2)")
    n = F.col("doc_id") * 7 + F.when(F.col("doc_id") % 4 == 0, F.col("trial")).otherwise(0)
    rating = F.when(F.col("doc_id") % 13 != 0, C._pick(["SAFE", "OKAY", "RISKY"], n % 3)).alias("rating")
    score = F.when(F.col("doc_id") % 11 != 0, n % 101).alias("score")
    entries = [F.struct(F.lit(p), F.struct(((n + 13 * (i + 1)) % 3 == 0).alias("violation"), F.lit("quote").alias("citation"), C._pick(["HIGH", "MEDIUM", "LOW"], F.floor(n / 3 + i) % 3).alias("confidence"))) for i, p in enumerate(R.PILLARS)]
    tldr = F.lit("Short.").alias("tldr")
    body = F.when(F.col("tier") == "quick", F.to_json(F.struct(rating, score, tldr))).otherwise(F.to_json(F.struct(rating, score, tldr, F.map_from_entries(F.array(*entries)).alias("pillars"))))
    raw = F.when((F.col("doc_id") + F.col("trial")) % 17 == 0, "Sorry.").when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<think>{so}</think>```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select(F.col("doc_id").cast("string").alias("id"), "tier", "trial", raw.alias("raw_json"), (n % 1000 + F.col("trial")).alias("latency_ms"))


def _stability(s: SparkSession, d: str) -> DataFrame:
    return model_stability(_answers(s, d).where("tier = 'deep'"), 3)


QUERIES = {
    "p4_model_report": lambda s, d: model_report(_cases(s, d), _answers(s, d).where("trial = 1")),
    "p4_model_stability": _stability,
    "p4_model_stability_summary": lambda s, d: evaluate.stability_summary(_stability(s, d)),
}
_penalty = R.PROFILES["prod"]["penalty"]
_points = "CASE pillar " + " ".join(f"WHEN '{p}' THEN CASE WHEN sure = 'LOW' THEN {low} ELSE {full} END" for p, (full, low) in _penalty.items()) + " END"
_SQL = f"""WITH pillar_list AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {i + 1})" for i, p in enumerate(R.PILLARS))}) AS t(pillar, pillar_ord)),
asked AS (SELECT doc_id, tier, trial, doc_id * 7 + CASE WHEN doc_id % 4 = 0 THEN trial ELSE 0 END AS n, (doc_id + trial) % 17 <> 0 AS ok
  FROM documents, (VALUES ('quick'), ('deep')) AS a(tier), (VALUES (1), (2), (3)) AS b(trial) WHERE NOT (doc_id % 19 = 0 AND trial = 2)),
marks AS (SELECT doc_id, trial, pillar, pillar_ord, (n + 13 * pillar_ord) % 3 = 0 AS violation, ['HIGH', 'MEDIUM', 'LOW'][CAST(floor(n / 3 + pillar_ord - 1) % 3 AS INT) + 1] AS sure FROM asked, pillar_list WHERE tier = 'deep' AND ok),
points AS (SELECT doc_id, trial, greatest({R.PROFILES["prod"]["floor"]}, 100 - coalesce(sum({_points}) FILTER (violation), 0)) AS computed FROM marks GROUP BY ALL),
own AS (SELECT *, CASE WHEN ok AND doc_id % 13 <> 0 THEN ['SAFE', 'OKAY', 'RISKY'][CAST(n % 3 AS INT) + 1] END AS said, CASE WHEN ok AND doc_id % 11 <> 0 THEN n % 101 END AS score FROM asked),
rated AS (SELECT doc_id, tier, trial, ok, n, score, CASE WHEN said IS NULL THEN NULL
    WHEN tier = 'deep' THEN CASE WHEN computed < 50 THEN 'RISKY' WHEN computed < 90 THEN 'OKAY' ELSE 'SAFE' END
    WHEN score < 50 THEN 'RISKY' WHEN score < 90 AND said = 'SAFE' THEN 'OKAY' WHEN score >= 90 AND said = 'RISKY' THEN 'OKAY' ELSE said END AS rating
  FROM own LEFT JOIN points USING (doc_id, trial)),
st AS (SELECT doc_id, count(DISTINCT coalesce(rating, 'NULL')) = 1 AND count(*) = 3 AS stable, max(score) - min(score) AS score_range FROM rated WHERE tier = 'deep' GROUP BY doc_id)"""
ORACLES = {
    "p4_model_report": f"""{_SQL}, good AS (SELECT 'deep' AS tier, count(*) FILTER (violation = ((doc_id + pillar_ord) % 4 = 0)) AS hit, count(*) AS labels FROM marks WHERE trial = 1 AND (doc_id + pillar_ord) % 9 <> 0),
    lat AS (SELECT tier, n % 1000 + trial AS ms, row_number() OVER (PARTITION BY tier ORDER BY n % 1000) - 1 AS i, count(*) OVER (PARTITION BY tier) AS k FROM asked WHERE trial = 1),
    times AS (SELECT tier, max(ms) FILTER (i = least(k - 1, k * 50 // 100)) AS p50, max(ms) FILTER (i = least(k - 1, k * 90 // 100)) AS p90, min(ms) AS min, max(ms) AS max FROM lat GROUP BY tier)
    SELECT tier, count(*) AS samples, round(coalesce(any_value(100 * hit / labels), 0), 6) AS pillars_pct, round(100 * count(*) FILTER (rating = ['SAFE', 'OKAY', 'RISKY'][CAST(doc_id % 3 AS INT) + 1]) / count(*), 6) AS rating_pct,
      count(*) FILTER (NOT ok) AS parse_fails, any_value(p50) AS p50, any_value(p90) AS p90, any_value(min) AS min, any_value(max) AS max
    FROM rated LEFT JOIN good USING (tier) JOIN times USING (tier) WHERE trial = 1 GROUP BY tier""",
    "p4_model_stability": f"{_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, stable, CAST(score_range AS DOUBLE) AS score_range FROM st",
    "p4_model_stability_summary": f"{_SQL} SELECT count(*) AS cases, count(*) FILTER (stable) AS stable_cases, round(100 * count(*) FILTER (stable) / count(*), 2) AS stability_pct, round(avg(score_range), 2) AS avg_range FROM st",
}
