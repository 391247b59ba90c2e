"""The battery on answers that are broken, silent or missing."""

import json

from clauseriver.operators import evaluate
from clauseriver.plans import battery

ANSWER = "doc_id long, chunk_no int, model string, tier string, raw_json string, latency_s double, input_tokens long, output_tokens long"


def _services(spark, policy=100):
    schema = "doc_id long, service string, policy_id long, cut int, grade string, expected_rating string, known array<string>"
    return spark.createDataFrame([(1, "one", policy, 10, "A", "SAFE", []), (2, "two", policy, 99, "E", "RISKY", ["data_selling", "ai_training"])], schema)


def _answers(spark, rows):
    return spark.createDataFrame([(i, 0, model, tier, raw if isinstance(raw, str) else json.dumps(raw), 1.5, 10, 3) for i, model, tier, raw in rows], ANSWER)


def _deep(**pillars):
    return {"tldr": "x", "pillars": {k: {"violation": v, "citation": c, "confidence": s} for k, (v, c, s) in pillars.items()}}


def test_requests_cut_and_gate(spark):
    web = spark.createDataFrame([(1, "<p>abcdefghijklmno</p>"), (2, "<p>short</p>"), (100, "<p>We show you advertising.</p>"), (5, "<p>nobody's</p>")], "page_id long, html string")
    rows = {(r.doc_id, r.kind): r.text for r in battery.battery_requests(_services(spark), web).collect()}
    assert rows == {(1, "service"): "abcdefghij", (2, "service"): "short", (100, "policy"): "We show you advertising."}
    plain = web.replace("<p>We show you advertising.</p>", "<p>Nothing of the kind.</p>")
    assert ("policy" not in {r.kind for r in battery.battery_requests(_services(spark), plain).collect()})


def test_unreadable_answers_leave_a_clear_deep_scan_only(spark):
    bad = _answers(spark, [(1, "primary", "quick", "no"), (1, "primary", "deep", "no"), (1, "corroborator", "deep", "no"), (2, "primary", "quick", "no")])
    rows = {(r.doc_id, r.scan_type): r for r in battery.battery_results(_services(spark, None), bad).collect()}
    assert set(rows) == {(1, "DEEP"), (2, "DEEP")}
    assert all(r.score == 100 and r.rating == "SAFE" for r in rows.values())
    assert rows[1, "DEEP"].precision == 1.0 and rows[2, "DEEP"].recall == 0.0 and rows[2, "DEEP"].latency_s is None


def test_policy_makes_a_basic_scan_and_fills_a_silent_pillar(spark):
    said = _answers(spark, [(100, "primary", "policy", {"data_selling": True, "reason": "r"}), (1, "primary", "quick", "no"), (2, "primary", "quick", {"tldr": "t", "ai_training": False}), (2, "primary", "deep", _deep(ai_training=(True, "We train our models on it", "LOW")))])
    found = {(r.doc_id, r.scan_type, r.pillar): r for r in battery.battery_findings(_services(spark), said).collect()}
    assert len(found) == 24
    sold = found[1, "BASIC", "data_selling"]
    assert (sold.violation, sold.confidence, sold.citation) == (True, "HIGH", "")
    sold = found[2, "DEEP", "data_selling"]
    assert (sold.violation, sold.confidence, sold.citation) == (True, "MEDIUM", "[Found in Privacy Policy]")
    rows = {(r.doc_id, r.scan_type): r for r in battery.battery_results(_services(spark), said).collect()}
    assert rows[1, "BASIC"].score == 70 and rows[1, "BASIC"].false_positives == ["data_selling"]
    assert rows[2, "DEEP"].score == 55 and rows[2, "DEEP"].recall == 1.0 and rows[2, "DEEP"].precision == 1.0
    assert {r.scan_type: r.safe_flagged for r in evaluate.confusion_rates(battery.battery_results(_services(spark), said)).collect()} == {"BASIC": 1, "DEEP": 1}


def test_corroborator_counts_only_when_sure_and_overrides_clear(spark):
    said = _answers(spark, [
        (1, "primary", "deep", _deep(ai_training=(False, "", "HIGH"), data_retention=(True, "Data is kept long", "LOW"))),
        (1, "corroborator", "deep", _deep(ai_training=(True, "Content feeds our systems", "HIGH"), transparency=(True, "We change it", "MEDIUM"), data_retention=(True, "Kept for ever", "MEDIUM"))),
    ])
    found = {r.pillar: r for r in battery.battery_findings(_services(spark, None), said).where("doc_id = 1 AND scan_type = 'DEEP'").collect()}
    assert found["ai_training"].rule_id == "D1" and not found["ai_training"].violation  # nothing there is trained
    assert not found["transparency"].violation
    assert found["data_retention"].violation and found["data_retention"].citation == "Kept for ever"


def test_empty_tables(spark):
    none = _services(spark).limit(0)
    assert battery.battery_results(none, _answers(spark, []).limit(0)).count() == 0
