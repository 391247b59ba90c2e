import re

import pytest
from pyspark.sql import functions as F

from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.operators import detect, ground, merge


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("url", F.lit(None).cast("string"))


def findings(spark, rows):
    """rows: doc_id, pillar, violation, confidence, citation."""
    full = [(d, p, R.PILLARS.index(p) + 1, v, c, q) for d, p, v, c, q in rows]
    return spark.createDataFrame(full, "doc_id long, pillar string, pillar_ord int, violation boolean, confidence string, citation string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def all_patterns():
    for group in (R.HARD_VIOLATIONS, R.DENIALS, R.CLAUSES, R.EVIDENCE):
        for ps in group.values():
            yield from (p[0] if isinstance(p, tuple) else p for p in ps)
    yield from [*R.PARAPHRASE_STRICT, *R.PARAPHRASE_LEADING, *R.HEADINGS, *R.COOKIE_INDICATORS, *R.LEGAL_URLS, R.STRONG_NEGATION, R.CONDITIONAL]


def test_every_pattern_compiles_and_edges_are_ascii(spark):
    df = spark.range(1).select(*[T.matches(F.lit("x"), p).alias(f"c{i}") for i, p in enumerate(all_patterns())])
    assert not any(df.collect()[0])
    edge = spark.createDataFrame([("éclass action",), ("class actioné",), ("xclass action",), ("class actions",)], "t string")
    assert [r[0] for r in edge.select(T.matches(F.col("t"), r"\bclass\s+action\b")).collect()] == [True, True, False, False]
    for p in all_patterns():  # an edge that begins a word has a word behind it
        for m in re.finditer(r"\\b(?=[A-Za-z0-9(\[]|\\d)", p):
            assert not re.match(r"\((?:\?:)?\\\$", p[m.end() :])


@pytest.mark.parametrize(
    ("text", "pillar", "violated", "confidence"),
    [
        ("We do not sell your data. Really.", "data_selling", False, "HIGH"),
        ("We do not sell your data, except when a partner asks.", "data_selling", False, "MEDIUM"),
        ("You may opt out of the sale of your data.", "data_selling", True, "HIGH"),
        ("Your content will not be used to train models.", "ai_training", False, "HIGH"),
        ("Data is deleted within 30 days.", "data_retention", False, "HIGH"),
        ("We claim no ownership of it.", "content_ownership", False, "HIGH"),
        ("There is no mandatory arbitration here.", "dark_patterns", False, "HIGH"),
        ("We do not sell your data.", "ai_training", True, "HIGH"),
    ],
)
def test_denials_veto_their_pillar_only(spark, text, pillar, violated, confidence):
    r = one(detect.denial_veto(findings(spark, [(0, pillar, True, "HIGH", "some citation")]), docs(spark, text)))
    assert (r["violation"], r["confidence"]) == (violated, confidence)
    assert r["status"] == ("VIOLATES" if violated else "EXPLICITLY_DENIES")
    assert violated or r["citation"] in text


def test_hard_violations_respect_order_negation_and_confidence(spark):
    text = "We never fine-tune anything at all. We train our models on what you write. Class action is waived here, forever."
    rows = [(0, "ai_training", False, "MEDIUM", ""), (0, "dark_patterns", True, "LOW", "x"), (0, "transparency", False, "MEDIUM", "t"), (0, "content_ownership", True, "HIGH", "own")]
    out = {r["pillar"]: r for r in detect.hard_violations(findings(spark, rows), docs(spark, text)).collect()}
    assert out["ai_training"]["violation"] and out["ai_training"]["citation"] == "We train our models on what you write."
    assert out["dark_patterns"]["confidence"] == "HIGH" and out["dark_patterns"]["citation"].startswith("Class action")
    assert not out["transparency"]["violation"] and out["content_ownership"]["citation"] == "own"


def test_cross_check_forces_and_confirms(spark):
    rows = [(0, "content_ownership", False, "LOW", "c"), (0, "dark_patterns", True, "LOW", "mine"), (0, "ai_training", True, "LOW", "a"), (0, "data_retention", False, "LOW", "r")]
    text = "It is IRREVOCABLE. Arbitration and liability. Retention, deletion."
    out = {r["pillar"]: r for r in detect.cross_check(findings(spark, rows), docs(spark, text)).collect()}
    assert (out["content_ownership"]["citation"], out["content_ownership"]["confidence"]) == ("irrevocable", "HIGH")
    assert out["dark_patterns"]["confirmed"] and out["dark_patterns"]["citation"] == "mine"
    assert not out["ai_training"]["confirmed"] and not out["data_retention"]["confirmed"]


@pytest.mark.parametrize(
    ("pillar", "citation", "rule"),
    [
        ("ai_training", "We use it to improve things", "D1"),
        ("ai_training", "You may not train anything with it", "D2"),
        ("ai_training", "We train on it", None),
        ("transparency", "This solely applies to games", "D3"),
        ("content_ownership", "Business listing content is licensed", "D4-business"),
        ("content_ownership", "Feedback you send us is ours", "D4"),
        ("content_ownership", "Feedback on a photo you send us is ours", None),
        ("content_ownership", "a non-exclusive, royalty-free right to host your files", "D4b-hosting"),
        ("content_ownership", "perpetual, irrevocable, non-exclusive right", "D4b"),
        ("content_ownership", "your post is under Creative Commons", "D4c"),
        ("data_retention", "cached copies may remain", "D5"),
        ("dark_patterns", "arbitration only in connection with fees", "D6"),
        ("dark_patterns", "total liability shall not exceed $100", "D7"),
        ("dark_patterns", "total liability shall not exceed $100; no class action", None),
        ("ai_training", "", None),
    ],
)
def test_overrides(spark, pillar, citation, rule):
    r = one(detect.rule_overrides(findings(spark, [(0, pillar, True, "HIGH", citation)])))
    assert r["rule_id"] == rule and r["violation"] == (rule is None)


def test_override_versions_differ(spark):
    f = findings(spark, [(0, "ai_training", True, "HIGH", ""), (1, "dark_patterns", True, "HIGH", "only in connection with fees"), (2, "ai_training", True, "HIGH", "we train")])
    assert {(r["doc_id"], r["left_rule"], r["right_rule"]) for r in detect.rule_override_variants(f).collect()} == {(0, "D1", None), (1, None, "D6")}


def test_prominence(spark):
    text = "Intro text.\n12. LIMITATION OF LIABILITY APPLIES TO ALL OF YOUR CLAIMS HERE\n" + "filler words " * 200 + "a small remark at the end of it all, easily missed."
    f = findings(spark, [(0, "dark_patterns", True, "HIGH", "LIMITATION OF LIABILITY APPLIES TO ALL OF YOUR CLAIMS HERE"), (0, "data_selling", True, "HIGH", "a small remark at the end of it all, easily missed"), (0, "ai_training", True, "HIGH", "short")])
    out = {r["pillar"]: r for r in detect.prominence(f, docs(spark, text)).collect()}
    assert out["dark_patterns"]["prominence_score"] == 100
    assert out["data_selling"]["prominence_signals"] == ["buried_deep"]
    assert out["ai_training"]["prominence_score"] == 30


@pytest.mark.parametrize(
    ("citation", "trust"),
    [
        (None, "ABSENT"), ("Not addressed in document.", "ABSENT"), ("The policy does not say", "PARAPHRASE"), ("too short", "TOO_SHORT"),
        ("We keep all of your records for ten years after you leave", "GROUNDED"), ("we   KEEP all of your RECORDS, for ten", "GROUNDED"),
        ("Words that nobody wrote anywhere in this long text", "NOT_FOUND"), ("somebody said: records for ten years after you", "GROUNDED"),
    ],
)
def test_citation_trust(spark, citation, trust):
    text = "Preface. We keep all of your records for ten years after you leave. End."
    r = one(ground.classify_citations(findings(spark, [(0, "data_retention", True, "HIGH", citation)]), docs(spark, text)))
    assert r["trust"] == trust


def test_grounding_finds_the_passage(spark):
    text = "Start here. " + "noise and more noise. " * 30 + "Your   account records stay\nwith partners for marketing purposes. The end."
    f = findings(spark, [(0, "data_selling", True, "HIGH", "account records given to marketing partners"), (0, "ai_training", True, "HIGH", '"Start here. noise and more noise."'), (0, "transparency", False, "HIGH", "account records marketing")])
    out = {r["pillar"]: r["citation"] for r in ground.ground_citation(f, docs(spark, text)).collect()}
    assert "Your account records stay with partners for marketing purposes." in out["data_selling"]
    assert out["ai_training"] == "Start here. noise and more noise."
    assert out["transparency"] == "account records marketing"


def test_scores_by_profile(spark):
    rows = [(0, "ai_training", True, "HIGH", ""), (0, "data_selling", True, "LOW", ""), (0, "transparency", True, "HIGH", ""), (0, "dark_patterns", True, None, ""), (1, "ai_training", False, "HIGH", "")]
    out = {(p, r["doc_id"]): r for p in R.PROFILES for r in merge.score(findings(spark, rows), p).collect()}
    assert (out["prod", 0]["score"], out["prod", 0]["rating"]) == (100 - 15 - 8 - 0 - 20, "OKAY")
    assert [d["points"] for d in out["prod", 0]["deductions"]] == [15, 8, 0, 20]
    assert (out["battery", 0]["score"], out["battery", 0]["rating"]) == (100 - 30 - 15 - 20 - 40 if 100 - 105 > 0 else 0, "RISKY")
    assert (out["prod", 1]["score"], out["prod", 1]["rating"], out["prod", 1]["deductions"]) == (100, "SAFE", [])


def test_model_answers(spark):
    raw = [
        'Sure: {"tldr":"t","pillars":{"ai_training":{"violation":true,"citation":"q","confidence":"HIGH"}}} done',
        '```json\n{"tldr":"t","pillars":{}}\n```', '{"tldr":"t","pillars":{"ai_training":{"violation":true,},}}', "no", '{"tldr": "cut', None,
        '<think>{"a":1}</think>{"tldr":"t","pillars":{"ai_training":{"violation":false}}}', '{"tldr":"t","ai_training":true}',
    ]
    df = spark.createDataFrame([(i, 0, "m", r) for i, r in enumerate(raw)], "doc_id long, chunk_no int, model string, raw_json string")
    ok = lambda **k: [r["parse_ok"] for r in merge.parse_model_output(df, **k).orderBy("doc_id").collect()]
    assert ok() == [True, True, False, False, False, False, False, False]
    assert ok(repair=True) == [True, True, True, False, False, False, True, False]
    assert ok(shape="quick")[7]
    assert one(merge.output_findings(merge.parse_model_output(df.where("doc_id = 0"))))["citation"] == "q"


def test_merges(spark):
    rows = [(0, 0, "m", "ai_training", False, "LOW", "a"), (0, 1, "m", "ai_training", True, "LOW", "b"), (0, 2, "m", "ai_training", True, "HIGH", "c"), (0, 0, "m", "data_selling", False, "LOW", "d"), (0, 1, "m", "data_selling", False, "HIGH", "e")]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no int, model string, pillar string, violation boolean, confidence string, citation string")
    pick = lambda policy: {r["pillar"]: r["citation"] for r in merge.merge_chunks(df, policy).collect()}
    assert pick("first") == {"ai_training": "b", "data_selling": "d"}
    assert pick("confidence") == {"ai_training": "c", "data_selling": "d"}
    p = findings(spark, [(0, "ai_training", False, "HIGH", "p"), (0, "data_selling", True, "LOW", "p"), (0, "transparency", True, "HIGH", "p")])
    c = findings(spark, [(0, "ai_training", True, "LOW", "c"), (0, "data_selling", True, "HIGH", "c"), (0, "transparency", True, "HIGH", "c"), (0, "dark_patterns", False, "LOW", "c")])
    got = lambda gate: {r["pillar"]: r["citation"] for r in merge.ensemble_merge(p, c, gate).collect()}
    assert got(None) == {"ai_training": "c", "data_selling": "c", "transparency": "p", "dark_patterns": "c"}
    assert got("HIGH") == {"ai_training": "p", "data_selling": "c", "transparency": "p", "dark_patterns": "c"}


def test_scan_without_a_model_reads_each_text_once(spark):
    """One scan of the documents and no join, however many rules look at a text."""
    from clauseriver.plans import pipelines

    rows = [(1, "https://x.com/en/tos", "We sell your personal data to partners. We never sell user data."), (2, None, "Binding arbitration applies. " * 3), (3, "https://a.example", "")]
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string")
    for of in (pipelines.scan_rules_only, pipelines.rules_only_report):
        plan = of(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Join" not in plan
    assert {r["doc_id"]: r["violations"] for r in pipelines.scan_rules_only(docs).collect()} == {1: "", 2: "dark_patterns", 3: ""}


def test_may_match_asks_for_every_part(spark):
    p = r"\b(?:sell|sold)\b.{0,60}\b(?:data|information)\b"
    assert T.needs_all(r"\bretain\b.{0,9}\bforever\b") == (("forever",), ("retain",))
    texts = [("we sell data",), ("data only",), ("we sold it: no information",), ("",)]
    rows = spark.createDataFrame(texts, "t string").select("t", T.may_match(F.lower("t"), p).alias("may"), T.matches(F.col("t"), p).alias("is")).collect()
    assert all(r["may"] or not r["is"] for r in rows)


def test_quotes_end_where_sentences_do(spark):
    """Matches at the ends of a text, with no full stop, in the midst of characters of four bytes."""
    texts = ["sold. B", "A. it is sold", "x;😀 y sold here; z. w", "a\nb sold\nc. d", "sold" + "k" * 400, "a" * 500 + " sold " + "b" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", *[T.quote_around(F.col("t"), "sold", v) for v in ("denial", "clause", "evidence")]).collect()}
    assert got[0] == ("sold.", "sold.", "") and got[1] == ("it is sold", "it is sold", "")
    assert got[2] == ("x;😀 y sold here; z.",) * 2 + ("",)
    assert got[3] == ("a b sold c.", "b sold c.", "")
    assert got[4] == (("sold" + "k" * 196),) * 2 + ("sold" + "k" * 216,)
    assert got[5][2] == ("a" * 179 + " sold " + "b" * 215)[:300]


def test_backfill_asks_the_whole_text_once(spark):
    """Where sentences are gone through, only the sentence is searched and not the whole text again."""
    df = docs(spark, "Nothing. Our neural network uses training data of our large language model here.")
    best = df.select(detect._best_sentence(detect.sentences_of(F.col("text")), F.lower("text"), "ai_training", 6).alias("b"))
    literals = sum(len(group) for p in R.BACKFILL["ai_training"]["high"] for group in T.needs_all(p))
    assert best._jdf.queryExecution().analyzed().toString().lower().count("contains(") == literals
    assert best.first()["b"]["score"] == 12


def test_texts_are_normalized_in_one_pass(spark):
    odd = ["a\r\r\n\n\rb   c", "  It`s 'A' \"b\"_c\x0b\x0c d é ß ', ` '", "", None, "\x85x\x1cy ''``", "\r", "İ z\n"]
    df = spark.createDataFrame([(x,) for x in odd], "text string")
    rows = df.select("text", T.normalize(F.col("text")).alias("plain"), T.normalize_quotes(F.col("text")).alias("quotes"), T.clean_source(F.col("text")).alias("clean"))
    for r in rows.collect():
        t = r["text"]
        low = t and t.lower()
        assert r["plain"] == (t and re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", low, flags=re.A), flags=re.A).strip(" "))
        assert r["quotes"] == (t and re.sub(r"\s+", " ", re.sub(r'[^\w\s"]', " ", re.sub("[\"'`]", '"', low), flags=re.A), flags=re.A).strip(" "))
        assert r["clean"] == (t and re.sub("\r\n?", "\n", t).replace(" ", " "))
    passes = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert [passes(f(F.col("text")).alias("x")) for f in (T.normalize, T.normalize_quotes, T.clean_source)] == [1, 1, 0]


def test_a_citation_is_sought_once(spark):
    docs = spark.createDataFrame([(1, "We may keep your data for as long as we like, and sell it to anyone.")], "doc_id long, text string")
    cited = ["  we may keep your data for as long as we like ", "We never keep any of the data that you give us", None, "  ", "Not addressed in document.", "too short"]
    findings = spark.createDataFrame([(1, str(i), c) for i, c in enumerate(cited)], "doc_id long, pillar string, citation string")
    rows = ground.classify_citations(findings, docs)
    got = {r["pillar"]: (r["trust"], r["grounded"]) for r in rows.collect()}
    assert [got[str(i)] for i in range(6)] == [("GROUNDED", True), ("NOT_FOUND", False), ("ABSENT", False), ("ABSENT", False), ("ABSENT", False), ("TOO_SHORT", False)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("exists(") == 1
