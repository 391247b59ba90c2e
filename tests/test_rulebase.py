"""Rules as rows: what a pillar that only rows name finds, against the rules of the package."""

import random

import pytest

from clauseriver.operators import detect, rulebase
from clauseriver.sources import corpus

ROWS = [
    ("evidence", "biometric_data", 0, r"\b(fingerprint|face scan|voice print)s?\b.{0,60}\bcollect", False, False, 0),
    ("evidence", "biometric_data", 1, r"\bbiometric", False, False, 0),
    ("high_phrase", "biometric_data", 0, "facial recognition", True, False, 0),
    ("hard", "biometric_data", 0, r"\bretinal scans?\b", False, True, 0),
    ("hard", "biometric_data", 1, r"(?:a|b)?", False, False, 0),  # needs no literal: always a candidate
]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        "We keep little here. A fingerprint that you give may be collected by our partners at any time. That is all there is.",
        "There is facial recognition in our shops and it is used at the door.",
        "We do not use retinal scans in any of our shops, and we never did so.",
        "Retinal scans are taken from every guest who enters the building.",
        "Nothing of interest stands in here", None, "", "BIOMETRIC templates are stored for the time that we need them, and then erased.",
    ]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)


def test_a_pillar_by_rows_alone(spark, docs):
    rules = spark.createDataFrame(ROWS[:4], rulebase.RULES)
    got = {r["doc_id"]: r for r in rulebase.scan(docs, rules).collect()}
    assert {k: (r["violation"], r["confidence"]) for k, r in got.items()} == {
        0: (True, "LOW"), 1: (True, "HIGH"), 2: (False, "LOW"), 3: (True, "HIGH"), 4: (False, "LOW"), 5: (False, "LOW"), 6: (False, "LOW"), 7: (True, "LOW"),
    }
    assert got[0]["citation"].startswith("A fingerprint that you give") and got[1]["citation"] == "facial recognition" and got[3]["citation"].startswith("Retinal scans are taken")
    assert {r["pillar_ord"] for r in got.values()} == {7} and {r["pillar"] for r in got.values()} == {"biometric_data"}


def test_more_rows_leave_other_pillars_alone(spark, docs):
    few, many = (rulebase.scan(docs, rulebase.rules_frame(spark, more)).where("pillar <> 'biometric_data'") for more in ([], ROWS))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_rows_are_the_operators(spark):
    """The scan by rows is evidence, phrases and hard violations of the operators, one after the other."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(corpus.CLAUSES) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = detect.hard_violations(detect.cross_check(detect.evidence(df), df).drop("confirmed"), df)
    names = ["doc_id", "pillar", "pillar_ord", "violation", "confidence", "citation"]
    assert sorted(map(tuple, rulebase.scan(df, rulebase.rules_frame(spark)).select(*names).collect())) == sorted(map(tuple, plain.select(*names).collect()))


def test_counts_and_limits(spark, docs, monkeypatch):
    rules = spark.createDataFrame(ROWS, rulebase.RULES)
    got = {(r["rule_set"], r["ord"]): r["documents"] for r in rulebase.rule_hits(docs, rules).collect()}
    assert got == {("evidence", 0): 1, ("evidence", 1): 1, ("high_phrase", 0): 1, ("hard", 0): 2, ("hard", 1): 7}
    assert rulebase.scan(docs, rules.limit(0)).count() == 0
    monkeypatch.setattr(rulebase, "MOST_RULES", 4)
    with pytest.raises(ValueError):
        rulebase.rule_hits(docs, rules)
