"""Evaluation of answers: ratings put right, labels, latencies and trials."""

import json

from clauseriver.plans import evaluation


def _answers(spark, rows):
    return spark.createDataFrame([(i, t, k, raw if isinstance(raw, str) else json.dumps(raw), ms) for i, t, k, raw, ms in rows], "id string, tier string, trial int, raw_json string, latency_ms long")


def _pillars(*names, sure="HIGH"):
    return {n: {"violation": True, "citation": "q", "confidence": sure} for n in names}


def test_ratings_follow_the_pillars_else_the_own_score(spark):
    four = _pillars("ai_training", "data_selling", "data_retention", "dark_patterns")
    rows = [
        ("a", "deep", 1, {"rating": "SAFE", "score": 99, "pillars": four}, 1),
        ("b", "deep", 1, {"rating": "RISKY", "pillars": {}}, 1),
        ("c", "quick", 1, {"rating": "SAFE", "score": 70}, 1),
        ("d", "quick", 1, {"rating": "RISKY", "score": 95}, 1),
        ("e", "quick", 1, {"rating": "OKAY"}, 1),
        ("f", "quick", 1, {"score": 10}, 1),
        ("g", "quick", 1, "nothing", 1),
    ]
    got = {r.id: (r.rating, r.parse_ok) for r in evaluation.predictions(_answers(spark, rows)).collect()}
    assert got == {"a": ("RISKY", True), "b": ("SAFE", True), "c": ("OKAY", True), "d": ("OKAY", True), "e": ("OKAY", True), "f": (None, True), "g": (None, False)}


def test_report(spark):
    schema = "id string, expected struct<rating: string, pillars: struct<ai_training: boolean, data_selling: boolean, transparency: boolean, data_retention: boolean, content_ownership: boolean, dark_patterns: boolean>>"
    cases = spark.createDataFrame([("a", ("OKAY", (True, False, None, None, None, None))), ("b", ("SAFE", (False, None, None, None, None, None))), ("c", ("SAFE", (None,) * 6))], schema)
    said = _answers(spark, [("a", "deep", 1, {"rating": "SAFE", "pillars": _pillars("ai_training", "data_selling")}, 30), ("b", "deep", 1, "none", 10), ("a", "quick", 1, {"rating": "OKAY", "score": 60}, 5)])
    rows = {r.tier: r for r in evaluation.model_report(cases, said).collect()}
    deep, quick = rows["deep"], rows["quick"]
    assert (deep.samples, deep.pillars_pct, round(deep.rating_pct, 2), deep.parse_fails, deep.p50, deep.max) == (3, 50.0, 33.33, 2, 30, 30)  # c has no answer
    assert (quick.pillars_pct, round(quick.rating_pct, 2), quick.parse_fails) == (0.0, 33.33, 2)


def test_stability_counts_missing_and_unrated_trials(spark):
    same = {"rating": "OKAY", "score": 60}
    said = _answers(spark, [("a", "quick", 1, same, 1), ("a", "quick", 2, same, 1), ("b", "quick", 1, same, 1), ("c", "quick", 1, "x", 1), ("c", "quick", 2, "y", 1), ("d", "quick", 1, {"rating": "SAFE", "score": 90}, 1), ("d", "quick", 2, {"rating": "SAFE", "score": 97}, 1)])
    got = {r.id: (r.stable, r.score_range) for r in evaluation.model_stability(said, 2).collect()}
    assert got == {"a": (True, 0), "b": (False, 0), "c": (True, None), "d": (True, 7)}
