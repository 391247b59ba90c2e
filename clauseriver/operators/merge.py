"""Model outputs to findings, merges over chunks and models, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseriver.functions import duck as D
from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.sources import corpus as C

KEY = ["doc_id", "pillar"]
FINDING = ["violation", "confidence", "citation"]
DEEP = "tldr string, pillars map<string, struct<violation: boolean, citation: string, confidence: string>>"
QUICK = "tldr string, " + ", ".join(f"{p} boolean" for p in R.PILLARS)
PLACEHOLDER = "Analysis complete."


#: What stands in for a quote where a quick answer says yes.
QUICK_FLAG = "Flagged by quick analysis"


def json_body(raw: Column, repair: bool = False) -> Column:
    """From the first { to the last }. repair also drops a thinking block, and commas before a closing bracket."""
    if repair:
        raw = F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r",\s*([}\]])", "$1")
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def parse_model_output(outputs: DataFrame, shape: str = "deep", repair: bool = False) -> DataFrame:
    """outputs with tldr, pillars (or the flat booleans of a quick answer) and parse_ok."""
    parsed = outputs.withColumn("_j", F.from_json(json_body(F.col("raw_json"), repair), DEEP if shape == "deep" else QUICK))
    if shape == "deep":
        return parsed.select(*outputs.columns, "_j.tldr", "_j.pillars", F.col("_j.pillars").isNotNull().alias("parse_ok"))
    ok = F.coalesce(*[F.col(f"_j.{p}") for p in R.PILLARS]).isNotNull()
    return parsed.select(*outputs.columns, "_j.tldr", *[F.col(f"_j.{p}") for p in R.PILLARS], ok.alias("parse_ok"))


def output_findings(parsed: DataFrame) -> DataFrame:
    """Long rows of a deep answer."""
    rows = parsed.where("parse_ok").select("doc_id", "chunk_no", "model", F.explode("pillars").alias("pillar", "v"))
    return rows.select("doc_id", "chunk_no", "model", "pillar", F.coalesce("v.violation", F.lit(False)).alias("violation"), F.col("v.confidence").alias("confidence"), F.col("v.citation").alias("citation"))


def normalize_quick(parsed: DataFrame) -> DataFrame:
    """Findings of flat answers; answers without any boolean are left out."""
    rows = parsed.where("parse_ok").unpivot(["doc_id", "chunk_no", "model"], R.PILLARS, "pillar", "violation").where("violation IS NOT NULL")
    return rows.select("doc_id", "chunk_no", "model", "pillar", "violation", F.lit("MEDIUM").alias("confidence"), F.when(F.col("violation"), QUICK_FLAG).otherwise(R.NOT_FOUND).alias("citation"))


def merge_chunks(findings: DataFrame, policy: str = "first", by: list[str] | None = None) -> DataFrame:
    """One finding per key over chunks. first: the first violation, else the first chunk. confidence: the most
    confident violation, earliest on ties; without one, the first chunk."""
    by = by or KEY
    row = F.struct(*FINDING)
    if policy == "first":
        best = F.min_by(row, F.struct(~F.col("violation"), "chunk_no"))
    else:
        rank = F.when(F.col("violation"), T.conf_rank(F.col("confidence"))).otherwise(0)
        best = F.max_by(row, F.struct("violation", rank, -F.col("chunk_no")))
    return findings.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def ensemble_merge(primary: DataFrame, corroborator: DataFrame, gate: str | None = None, key: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """The corroborator's violation counts where the primary has none (with a gate, only at that confidence);
    where both have one, the strictly more confident wins; else the primary stands."""
    p = primary.select(*key, F.struct(*FINDING).alias("p"))
    c = corroborator.select(*key, F.struct(*FINDING).alias("c"))
    new = F.col("p").isNull() | (F.col("c.violation") & ~F.col("p.violation"))
    barred = F.lit(False) if gate is None else F.col("c.violation") & (F.coalesce("c.confidence", F.lit("")) != gate)
    surer = F.col("p.violation") & F.col("c.violation") & (T.conf_rank(F.col("c.confidence")) > T.conf_rank(F.col("p.confidence")))
    take = F.col("c").isNotNull() & F.when(new, ~barred).otherwise(F.coalesce(surer, F.lit(False)))
    merged = p.join(c, list(key), "full").select(*key, F.when(take, F.col("c")).otherwise(F.col("p")).alias("best"))
    return merged.where("best IS NOT NULL").select(*key, "best.*")


def merge_quick(parsed: DataFrame) -> DataFrame:
    """doc_id, tldr of the first chunk, and the OR of each boolean."""
    return parsed.where("parse_ok").groupBy("doc_id").agg(F.min_by("tldr", "chunk_no").alias("tldr"), *[F.bool_or(p).alias(p) for p in R.PILLARS])


def _points(profile: dict) -> Column:
    low = F.upper(F.coalesce("confidence", F.lit(profile["default_confidence"]))) == "LOW"
    full, part = F.lit(profile["other"][0]), F.lit(profile["other"][1])
    for p, (a, b) in profile["penalty"].items():
        full, part = F.when(F.col("pillar") == p, a).otherwise(full), F.when(F.col("pillar") == p, b).otherwise(part)
    return F.when(low, part).otherwise(full)


def rating_of(score: Column, profile: dict) -> Column:
    return F.when(score < profile["okay"], "RISKY").when(score < profile["safe"], "OKAY").otherwise("SAFE")


def score(findings: DataFrame, profile: str = "prod", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id (or by), score, rating, deductions (reason, points) in the order of pillars."""
    p = R.PROFILES[profile]
    low = F.upper(F.coalesce("confidence", F.lit(p["default_confidence"]))) == "LOW"
    name = F.replace("pillar", F.lit("_"), F.lit(" "))
    reason = F.when(low, F.concat(F.lit("Low-confidence flag in "), name, F.lit(" (reduced penalty)"))).otherwise(F.concat(F.lit("Flagged risk in "), name))
    if profile == "prod":
        reason = F.when(F.col("pillar") == "transparency", "Transparency flag (informational — not scored)").otherwise(reason)
    ord_ = F.array_position(F.array(*map(F.lit, R.PILLARS)), F.col("pillar"))
    row = F.when(F.col("violation"), F.struct(ord_.alias("ord"), reason.alias("reason"), _points(p).alias("points")))
    sums = findings.groupBy(*by).agg(F.sum(F.when(F.col("violation"), _points(p)).otherwise(0)).alias("lost"), F.array_sort(F.collect_list(row)).alias("rows"))
    points = F.greatest(F.lit(p["floor"]), F.least(F.lit(100), 100 - F.col("lost"))).cast("int")
    rows = F.transform("rows", lambda r: F.struct(r["reason"].alias("reason"), r["points"].alias("points")))
    return sums.select(*by, points.alias("score"), rating_of(points, p).alias("rating"), rows.alias("deductions"))


def score_array(findings: Column, profile: str = "prod") -> Column:
    """(score, rating, deductions) of one document's findings as an array (pillar, violation, confidence): no grouping, so also for streams."""
    p = R.PROFILES[profile]

    def lost(f: Column) -> Column:
        low = F.upper(F.coalesce(f["confidence"], F.lit(p["default_confidence"]))) == "LOW"
        full, part = F.lit(p["other"][0]), F.lit(p["other"][1])
        for name, (a, b) in p["penalty"].items():
            full, part = F.when(f["pillar"] == name, a).otherwise(full), F.when(f["pillar"] == name, b).otherwise(part)
        name = F.replace(f["pillar"], F.lit("_"), F.lit(" "))
        reason = F.when(low, F.concat(F.lit("Low-confidence flag in "), name, F.lit(" (reduced penalty)"))).otherwise(F.concat(F.lit("Flagged risk in "), name))
        if profile == "prod":
            reason = F.when(f["pillar"] == "transparency", "Transparency flag (informational — not scored)").otherwise(reason)
        return F.struct(reason.alias("reason"), F.when(low, part).otherwise(full).alias("points"))

    def scored(rows: Column) -> Column:
        total = F.aggregate(rows, F.lit(0), lambda s, r: s + r["points"])
        points = F.greatest(F.lit(p["floor"]), F.least(F.lit(100), 100 - total)).cast("int")
        return T.let(points, lambda x: F.struct(x.alias("score"), rating_of(x, p).alias("rating"), rows.alias("deductions")))

    return T.let(F.transform(F.filter(findings, lambda f: f["violation"]), lost), scored)


def deductions_text(deductions: str | Column = "deductions") -> Column:
    return F.array_join(F.transform(deductions, lambda d: F.concat(d["reason"], F.lit("="), d["points"].cast("string"))), "; ")


def build_tldr(parsed: DataFrame, findings: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, tldr: the first summary worth its name, else one made from the score and three violations."""
    good = parsed.where((F.length("tldr") > 20) & (F.col("tldr") != PLACEHOLDER)).groupBy("doc_id").agg(F.min_by("tldr", "chunk_no").alias("best"))
    ord_ = F.array_position(F.array(*map(F.lit, R.PILLARS)), F.col("pillar"))
    names = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("violation"), F.struct(ord_.alias("o"), F.replace("pillar", F.lit("_"), F.lit(" ")).alias("n"))))).alias("v"))
    some = F.array_join(F.transform(F.slice("v", 1, 3), lambda r: r["n"]), ", ")
    points = F.col("score").cast("string")
    made = F.when(F.size("v") == 0, F.concat(F.lit("This policy scored "), points, F.lit("/100. No major privacy violations were detected."))).otherwise(
        F.concat(F.lit("This "), F.col("rating"), F.lit(" policy scored "), points, F.lit("/100. Privacy concerns found in: "), some, F.lit("."))
    )
    return scores.join(names, "doc_id").join(good, "doc_id", "left").select("doc_id", F.coalesce("best", made).alias("tldr"))


def pillar_status_counts(findings: DataFrame) -> DataFrame:
    """doc_id, hazards, not_applicable, silent, safe, applicable_total; a finding counts under the first that fits."""
    hazard = F.col("violation") & (F.upper(F.coalesce("confidence", F.lit("MEDIUM"))) != "LOW")
    status = F.upper(F.coalesce("status", F.lit("")))
    na = ~hazard & ((status == "NOT_APPLICABLE") | ~F.coalesce("applicable", F.lit(True)))
    silent = ~hazard & ~na & ((status == "NOT_MENTIONED") | ((status == "") & ~F.col("violation") & (F.coalesce("citation", F.lit("")) == "")))
    kinds = findings.select("doc_id", hazard.alias("h"), na.alias("n"), silent.alias("s"))
    return kinds.groupBy("doc_id").agg(
        F.count_if("h").alias("hazards"), F.count_if("n").alias("not_applicable"), F.count_if("s").alias("silent"),
        F.count_if(~F.col("h") & ~F.col("n") & ~F.col("s")).alias("safe"), F.count_if(~F.col("n")).alias("applicable_total"),
    )


def token_totals(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("doc_id", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def segment_rollup(segments: DataFrame) -> DataFrame:
    """segments (doc_id, stars; null counts 3) -> doc_id, score, rating."""
    rows = segments.groupBy("doc_id").agg(F.avg(F.coalesce("stars", F.lit(3))).alias("avg"))
    rating = F.when(F.col("avg") <= 2, "RISKY").when(F.col("avg") <= 3, "OKAY").otherwise("SAFE")
    return rows.select("doc_id", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("avg") * 20 + 0.5))).cast("int").alias("score"), rating.alias("rating"))


# -- queries ------------------------------------------------------------------------------------------


def quick_outputs(outputs: DataFrame) -> DataFrame:
    """The deep answers flattened, as a quick scan would give them; primary model only."""
    pillars = parse_model_output(outputs.where("model = 'primary'")).where("parse_ok")
    flat = F.concat_ws(",", *[F.concat(F.lit(f'"{p}":'), F.col("pillars")[p]["violation"].cast("string")) for p in R.PILLARS])
    return pillars.select("doc_id", "chunk_no", "model", F.concat(F.lit('{"tldr":"'), F.col("tldr"), F.lit('",'), flat, F.lit("}")).alias("raw_json"))


def _outputs(spark, sf_dir):
    return C.model_outputs(C.policies(spark, sf_dir))


def _deep(spark, sf_dir, model=None):
    rows = output_findings(parse_model_output(_outputs(spark, sf_dir)))
    return rows.where(F.col("model") == model) if model else rows


def _scored(profile):
    def query(spark, sf_dir):
        return score(C.findings(C.policies(spark, sf_dir)), profile).select("doc_id", "score", "rating", deductions_text().alias("deductions"))

    return query


def _ensemble(gate):
    def query(spark, sf_dir):
        both = [merge_chunks(_deep(spark, sf_dir, m), "confidence") for m in ("primary", "corroborator")]
        return ensemble_merge(*both, gate)

    return query


def _tldr(spark, sf_dir):
    parsed = parse_model_output(_outputs(spark, sf_dir).where("model = 'primary'"))
    found = C.findings(C.policies(spark, sf_dir))
    return build_tldr(parsed, found, score(found))


def _status(spark, sf_dir):
    from clauseriver.operators import detect

    docs = C.policies(spark, sf_dir)
    return pillar_status_counts(detect.apply_applicability(detect.denial_veto(C.findings(docs), docs), detect.classify_policy(docs)))


QUERIES = {
    "a6_parse_model_output": lambda s, d: parse_model_output(_outputs(s, d)).select("doc_id", "chunk_no", "model", "tldr", "parse_ok"),
    "a6_output_findings": _deep,
    "f1_normalize_quick": lambda s, d: normalize_quick(parse_model_output(quick_outputs(_outputs(s, d)), "quick")),
    "f2_merge_chunks_first": lambda s, d: merge_chunks(_deep(s, d, "primary")),
    "f3_ensemble_union": _ensemble(None),
    "f4_ensemble_gated": _ensemble("HIGH"),
    "f5_merge_chunks_confidence": lambda s, d: merge_chunks(_deep(s, d, "primary"), "confidence"),
    "f6_merge_quick": lambda s, d: merge_quick(parse_model_output(quick_outputs(_outputs(s, d)), "quick")),
    "f7_score_prod": _scored("prod"),
    "f7_score_battery": _scored("battery"),
    "f8_build_tldr": _tldr,
    "f10_pillar_status_counts": _status,
    "f11_token_totals": lambda s, d: token_totals(_outputs(s, d)),
    "f25_segment_rollup": lambda s, d: segment_rollup(_outputs(s, d).select("doc_id", F.nullif((F.col("input_tokens") % 6).cast("int"), F.lit(0)).alias("stars"))),
}

_js = r"regexp_extract(raw_json, '(?s)\{.*\}')"
PARSED_SQL = f"""{C.POLICIES_SQL}, {C.FINDINGS_SQL}, {C.OUTPUTS_SQL},
parsed AS (SELECT *, {_js} <> '' AS parse_ok, CASE WHEN {_js} <> '' THEN {_js} END AS js FROM model_outputs),
deep AS (
  SELECT doc_id, chunk_no, model, pillar, CAST(json_extract_string(js, '$.pillars.' || pillar || '.violation') AS BOOLEAN) AS violation,
    json_extract_string(js, '$.pillars.' || pillar || '.confidence') AS confidence, json_extract_string(js, '$.pillars.' || pillar || '.citation') AS citation
  FROM parsed, pillar_list WHERE parse_ok)"""
_best = f"CASE WHEN violation THEN {D.conf_rank('confidence')} ELSE 0 END"
_by_conf = f"""SELECT doc_id, pillar, violation, confidence, citation FROM (
  SELECT *, row_number() OVER (PARTITION BY model, doc_id, pillar ORDER BY violation DESC, {_best} DESC, chunk_no) AS k FROM deep WHERE model = '%s') WHERE k = 1"""


def _score_sql(profile: str, source: str = "findings", by: str = "doc_id") -> str:
    p = R.PROFILES[profile]
    points = "CASE WHEN confidence = 'LOW' THEN CASE pillar " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in p["penalty"].items()) + " END ELSE CASE pillar " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in p["penalty"].items()) + " END END"
    reason = "CASE WHEN confidence = 'LOW' THEN 'Low-confidence flag in ' || replace(pillar, '_', ' ') || ' (reduced penalty)' ELSE 'Flagged risk in ' || replace(pillar, '_', ' ') END"
    if profile == "prod":
        reason = f"CASE WHEN pillar = 'transparency' THEN 'Transparency flag (informational — not scored)' ELSE {reason} END"
    return f"""
points_{profile} AS (SELECT *, {points} AS points, {reason} AS reason FROM {source}),
sums_{profile} AS (SELECT {by}, CAST(greatest({p["floor"]}, least(100, 100 - coalesce(sum(points) FILTER (violation), 0))) AS INT) AS score,
  coalesce(string_agg(reason || '=' || points, '; ' ORDER BY pillar_ord) FILTER (violation), '') AS deductions FROM points_{profile} GROUP BY {by}),
scores_{profile} AS (SELECT {by}, score, CASE WHEN score < {p["okay"]} THEN 'RISKY' WHEN score < {p["safe"]} THEN 'OKAY' ELSE 'SAFE' END AS rating, deductions FROM sums_{profile})"""


def _ensemble_ctes(gate: str | None) -> str:
    """The ensemble as a table ens."""
    barred = f"c.violation AND coalesce(c.confidence, '') <> '{gate}'" if gate else "false"
    take = f"c.doc_id IS NOT NULL AND CASE WHEN p.doc_id IS NULL OR (c.violation AND NOT p.violation) THEN NOT ({barred}) ELSE p.violation AND c.violation AND {D.conf_rank('c.confidence')} > {D.conf_rank('p.confidence')} END"
    return f"""WITH {PARSED_SQL}, p AS ({_by_conf % "primary"}), c AS ({_by_conf % "corroborator"}),
    j AS (SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, coalesce(p.pillar, c.pillar) AS pillar, {take} AS take, p.doc_id IS NOT NULL AS has_p,
      p.violation AS pv, p.confidence AS pc, p.citation AS pq, c.violation AS cv, c.confidence AS cc, c.citation AS cq
      FROM p FULL JOIN c ON p.doc_id = c.doc_id AND p.pillar = c.pillar),
    ens AS (SELECT doc_id, pillar, CASE WHEN take THEN cv ELSE pv END AS violation, CASE WHEN take THEN cc ELSE pc END AS confidence, CASE WHEN take THEN cq ELSE pq END AS citation FROM j WHERE take OR has_p)"""


def _ensemble_sql(gate: str | None) -> str:
    return f"{_ensemble_ctes(gate)} SELECT * FROM ens"


def _status_sql() -> str:
    from clauseriver.operators import detect

    return f"""{detect.BASE}, {detect.VETO_SQL}, {detect.CLASSIFY_SQL}, a AS (SELECT v.*, category, trim(citation) AS c FROM veto v JOIN classified USING (doc_id)), n AS (
      SELECT *, category || ' ' || pillar IN ({", ".join(f"'{n} {p}'" for n, c in R.CATEGORIES.items() for p in c["not_applicable"])}) AND NOT violation
        AND NOT (c <> '' AND NOT {D.rx("c", R.NO_REAL_CITATION)} AND NOT {D.rx("c", "^this practice is not ")}) AS na FROM a),
    k AS (SELECT doc_id, violation AND confidence <> 'LOW' AS h, na, CASE WHEN na THEN 'NOT_APPLICABLE' ELSE status END AS status FROM n)
    SELECT doc_id, count(*) FILTER (h) AS hazards, count(*) FILTER (NOT h AND na) AS not_applicable, count(*) FILTER (NOT h AND NOT na AND status = 'NOT_MENTIONED') AS silent,
      count(*) FILTER (NOT h AND NOT na AND status <> 'NOT_MENTIONED') AS safe, count(*) FILTER (h OR NOT na) AS applicable_total FROM k GROUP BY doc_id"""


ORACLES = {
    "a6_parse_model_output": f"WITH {PARSED_SQL} SELECT doc_id, chunk_no, model, json_extract_string(js, '$.tldr') AS tldr, parse_ok FROM parsed",
    "a6_output_findings": f"WITH {PARSED_SQL} SELECT * FROM deep",
    "f1_normalize_quick": f"WITH {PARSED_SQL} SELECT doc_id, chunk_no, model, pillar, violation, 'MEDIUM' AS confidence, CASE WHEN violation THEN 'Flagged by quick analysis' ELSE '[NOT_FOUND]' END AS citation FROM deep WHERE model = 'primary'",
    "f2_merge_chunks_first": f"""WITH {PARSED_SQL} SELECT doc_id, pillar, violation, confidence, citation FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, pillar ORDER BY violation DESC, chunk_no) AS k FROM deep WHERE model = 'primary') WHERE k = 1""",
    "f3_ensemble_union": _ensemble_sql(None),
    "f4_ensemble_gated": _ensemble_sql("HIGH"),
    "f5_merge_chunks_confidence": f"WITH {PARSED_SQL} {_by_conf % 'primary'}",
    "f6_merge_quick": f"""WITH {PARSED_SQL} SELECT doc_id, arg_min(json_extract_string(js, '$.tldr'), chunk_no) AS tldr,
      {", ".join(f"bool_or(CAST(json_extract_string(js, '$.pillars.{p}.violation') AS BOOLEAN)) AS {p}" for p in R.PILLARS)} FROM parsed WHERE parse_ok AND model = 'primary' GROUP BY doc_id""",
    "f7_score_prod": f"WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}, {_score_sql('prod')} SELECT * FROM scores_prod",
    "f7_score_battery": f"WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL}, {_score_sql('battery')} SELECT * FROM scores_battery",
    "f8_build_tldr": f"""WITH {PARSED_SQL}, {_score_sql("prod")},
    good AS (SELECT doc_id, arg_min(t, chunk_no) AS best FROM (SELECT doc_id, chunk_no, json_extract_string(js, '$.tldr') AS t FROM parsed WHERE model = 'primary') WHERE length(t) > 20 AND t <> '{PLACEHOLDER}' GROUP BY doc_id),
    v AS (SELECT doc_id, count(*) FILTER (violation) AS n, array_to_string((list(replace(pillar, '_', ' ') ORDER BY pillar_ord) FILTER (violation))[1:3], ', ') AS names FROM findings GROUP BY doc_id)
    SELECT doc_id, coalesce(best, CASE WHEN n = 0 THEN 'This policy scored ' || score || '/100. No major privacy violations were detected.'
      ELSE 'This ' || rating || ' policy scored ' || score || '/100. Privacy concerns found in: ' || names || '.' END) AS tldr FROM scores_prod JOIN v USING (doc_id) LEFT JOIN good USING (doc_id)""",
    "f10_pillar_status_counts": _status_sql(),
    "f11_token_totals": f"WITH {PARSED_SQL} SELECT doc_id, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM model_outputs GROUP BY ALL",
    "f25_segment_rollup": f"""WITH {PARSED_SQL}, s AS (SELECT doc_id, avg(coalesce(nullif(input_tokens % 6, 0), 3)) AS a FROM model_outputs GROUP BY doc_id)
    SELECT doc_id, CAST(greatest(0, least(100, floor(a * 20 + 0.5))) AS INT) AS score, CASE WHEN a <= 2 THEN 'RISKY' WHEN a <= 3 THEN 'OKAY' ELSE 'SAFE' END AS rating FROM s""",
}
