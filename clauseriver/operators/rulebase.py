"""The rules as a table: an index of the literals that patterns cannot do without, and the text rules that read it.

A rule is a row (rule_set, pillar, ord, pattern, phrase, negatable, points). Nothing about it is in the code of a plan, so
a pillar is added by adding rows. Texts meet the rules by one automaton over all literals, whose walk takes as long for a
thousand rules as for one; what it lets through is confirmed by the patterns themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from clauseriver.functions import duck as D
from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.operators import detect
from clauseriver.sources import corpus as C

RULES = "rule_set string, pillar string, ord int, pattern string, phrase boolean, negatable boolean, points int"
#: Rules are held by every task; more than this many are refused.
MOST_RULES = 50_000


def rule_rows() -> list[tuple[str, str, int, str, bool, bool, int]]:
    """Every rule set of the package that is tried on texts, as rows of RULES."""
    rows = [("hard", p, i, x, False, neg, 0) for p, xs in R.HARD_VIOLATIONS.items() for i, (x, neg) in enumerate(xs)]
    for name, rules, phrase in (("denial", R.DENIALS, False), ("clause", R.CLAUSES, False), ("evidence", R.EVIDENCE, False), ("high_phrase", R.HIGH_PHRASES, True), ("standard_phrase", R.STANDARD_PHRASES, True)):
        rows += [(name, p, i, x, phrase, False, 0) for p, xs in rules.items() for i, x in enumerate(xs)]
    rows += [("backfill", p, 1000 * (points == 1) + i, x, False, False, points) for p, kinds in R.BACKFILL.items() for kind, points in (("high", 3), ("low", 1)) for i, x in enumerate(kinds[kind])]
    return rows + [("positive", "", i, x, False, False, 0) for i, x in enumerate(R.POSITIVE_SIGNALS)]


def rules_frame(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame([*rule_rows(), *more], RULES)


def with_candidates(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """docs with _rules: the rules (rows of RULES, with `java`, the pattern as the JVM takes it) that the text may match, in
    the order of rule_set, pillar and ord; always those whose literals it has, and those that need none."""
    rows = rules.orderBy("rule_set", "pillar", "ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    spark = docs.sparkSession
    literals: dict[str, list[int]] = {}
    always = []
    for k, r in enumerate(rows):
        needed = (r["pattern"].lower(),) if r["phrase"] else T.needs(r["pattern"])
        for x in needed:
            literals.setdefault(x, []).append(k)
        if not needed:
            always.append(k)
    told = spark.sparkContext.broadcast((literals, always))

    @F.pandas_udf(ArrayType(IntegerType()))
    def candidates(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        literals, always = told.value
        automaton = ahocorasick.Automaton()
        for x, ks in literals.items():
            automaton.add_word(x, ks)
        if literals:
            automaton.make_automaton()

        def of(text: str | None) -> list[int] | None:
            if text is None:
                return None
            found = set(always)
            if literals:
                for _, ks in automaton.iter(text):
                    found.update(ks)
            return sorted(found)

        for series in texts:
            yield series.map(of)

    java = [(*r, r["pattern"] if r["phrase"] else T.pattern(r["pattern"], "")) for r in rows]
    table = spark.createDataFrame([(0, java)], f"_one int, _table array<struct<{RULES.replace(' ', ':').replace(',:', ', ')}, java:string>>")
    met = docs.withColumn("_ids", candidates(F.lower(text))).withColumn("_one", F.lit(0))
    joined = met.join(F.broadcast(table), "_one")  # one row, of at most MOST_RULES rules
    return joined.withColumn("_rules", F.transform("_ids", lambda i: F.get("_table", i))).drop("_one", "_table", "_ids")


def rlike(text: Column, rule: Column) -> Column:
    return F.rlike(text, F.concat(F.lit("(?i)"), rule["java"]))


def fits(text: Column, lowered: Column, rule: Column) -> Column:
    return F.when(rule["phrase"], F.contains(lowered, rule["java"])).otherwise(rlike(text, rule))


def rule_hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_set, pillar, ord, documents: how many texts each rule matches."""
    rows = with_candidates(docs, rules).withColumn("_low", F.lower("text"))
    hits = rows.select(F.explode(F.filter("_rules", lambda r: fits(F.col("text"), F.col("_low"), r))).alias("r")).select("r.rule_set", "r.pillar", "r.ord")
    key = ["rule_set", "pillar", "ord"]
    return rules.select(*key).join(hits.groupBy(*key).agg(F.count("*").alias("documents")), key, "left").select(*key, F.coalesce("documents", F.lit(0)).alias("documents"))


def _pillar_ord(pillar: Column) -> Column:
    known = F.array(*map(F.lit, R.PILLARS))
    return F.when(F.array_contains(known, pillar), F.array_position(known, pillar)).otherwise(len(R.PILLARS) + 1).cast("int")


def scan(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, pillar, pillar_ord, violation, confidence, citation of every pillar that the rules name: evidence, then
    unambiguous phrases (D2), then hard violations (D1). The text is read in one projection; its hits leave it as slim rows.

    Null texts have no hits. Pillars that only rows name come after the others. No rules, no rows.
    """
    of = lambda name: F.filter("_rules", lambda r: r["rule_set"] == name)
    # one column after the other: what the collapsed text lacks between words is found in the raw one, and the other way round
    flat = docs.select("doc_id", "text", T.strip(T.collapse(F.col("text"))).alias("_flat"))
    rows = with_candidates(flat.withColumn("_both", F.concat_ws("\n", "text", "_flat")), rules.where("rule_set IN ('evidence', 'high_phrase', 'hard')"), "_both")
    rows = rows.withColumn("_low", F.lower("text"))
    row = lambda r, at, quote: F.struct(r["pillar"].alias("pillar"), r["rule_set"].alias("rule_set"), r["ord"].alias("ord"), quote.alias("quote"))
    evidence = F.transform(F.filter(of("evidence"), lambda r: rlike(F.col("_flat"), r)), lambda r: row(r, 0, T.quote_around(F.col("_flat"), r["java"], "evidence")))
    phrases = F.transform(F.filter(of("high_phrase"), lambda r: F.contains("_low", r["java"])), lambda r: row(r, 0, r["pattern"]))
    sentences = detect.sentences_of(F.col("text"), "strict")

    def proof(r: Column) -> Column:
        return F.get(F.filter("_sentences", lambda s: rlike(s, r) & ~(r["negatable"] & T.strong_negation(s))), F.lit(0))

    rows = rows.withColumn("_sentences", F.when(F.size(of("hard")) > 0, sentences))
    hard = F.transform(of("hard"), lambda r: row(r, 0, T.cap_words(proof(r))))
    hits = rows.select("doc_id", F.inline(F.filter(F.concat(evidence, phrases, hard), lambda h: F.coalesce(h["quote"], F.lit("")) != "")))
    first = lambda name: F.min_by(F.when(F.col("rule_set") == name, F.col("quote")), F.when(F.col("rule_set") == name, F.col("ord")))
    best = hits.groupBy("doc_id", "pillar").agg(first("evidence").alias("e"), first("high_phrase").alias("p"), first("hard").alias("h"))
    pillars = rules.where("rule_set IN ('evidence', 'high_phrase', 'hard')").agg(F.collect_set("pillar").alias("_p")).withColumn("_one", F.lit(0))
    every = docs.select("doc_id", F.lit(0).alias("_one")).join(F.broadcast(pillars), "_one").select("doc_id", F.explode("_p").alias("pillar"))
    found = every.join(best, ["doc_id", "pillar"], "left")
    # evidence is LOW, so that both a phrase and a proof raise it
    return found.select(
        "doc_id", "pillar", _pillar_ord(F.col("pillar")).alias("pillar_ord"), F.coalesce("e", "p", "h").isNotNull().alias("violation"),
        F.when(F.col("h").isNotNull() | (F.col("e").isNull() & F.col("p").isNotNull()), "HIGH").otherwise("LOW").alias("confidence"),
        F.when(F.col("h").isNotNull() & (F.col("e").isNotNull() | F.col("p").isNull()), F.col("h")).otherwise(F.coalesce("e", "p", F.lit(R.NOT_ADDRESSED))).alias("citation"),
    )


# -- queries ------------------------------------------------------------------------------------------

#: A seventh pillar by rows alone, of words that the given policies have.
ADDED = [
    ("evidence", "account_profile", 0, r"\b(shipping address|payment method)\b.{0,80}\bmethod\b", False, False, 0),
    ("evidence", "account_profile", 1, r"\baccount balance\b", False, False, 0),
    ("high_phrase", "account_profile", 0, "order history", True, False, 0),
    ("hard", "account_profile", 0, r"\bqueries are not logged\b", False, True, 0),
    ("hard", "account_profile", 1, r"\bclaim(?:s)? must be brought within\b", False, False, 0),
]
QUERIES = {
    "a5_rule_hits": lambda s, d: rule_hits(C.policies(s, d), rules_frame(s)),
    "a5_scan_by_rules": lambda s, d: scan(C.policies(s, d), rules_frame(s, ADDED)),
}


def _scan_sql() -> str:
    parts = []
    own = {k: {} for k in ("evidence", "high_phrase", "hard")}
    for name, p, _, x, _, neg, _ in [*rule_rows(), *ADDED]:
        if name in own:
            own[name].setdefault(p, []).append((x, neg))
    pillars = sorted({p for rules in own.values() for p in rules})
    ords = {p: R.PILLARS.index(p) + 1 if p in R.PILLARS else len(R.PILLARS) + 1 for p in pillars}
    for p in pillars:
        quotes = ", ".join(f"CASE WHEN {D.rx('flat', x)} THEN nullif({D.quote_around('flat', x, 'evidence')}, '') END" for x, _ in own["evidence"].get(p, []))
        phrases = " ".join(f"WHEN contains(lower(text), {D.lit(x)}) THEN {D.lit(x)}" for x, _ in own["high_phrase"].get(p, []))
        parts.append(f"SELECT doc_id, '{p}' AS pillar, {ords[p]} AS pillar_ord, {f'coalesce({quotes}, NULL)' if quotes else 'CAST(NULL AS VARCHAR)'} AS e, {f'CASE {phrases} END' if phrases else 'CAST(NULL AS VARCHAR)'} AS p FROM flat")
    return f"""WITH {C.POLICIES_SQL}, {detect._sentences_sql("strict")}, {detect._hard_sql(own["hard"])},
    flat AS (SELECT doc_id, text, {D.strip(D.collapse("text"))} AS flat FROM policies), tried AS ({" UNION ALL ".join(parts)}),
    found AS (SELECT t.*, CASE WHEN sentence IS NOT NULL THEN {D.cap_words("sentence")} END AS h FROM tried t LEFT JOIN hard USING (doc_id, pillar))
    SELECT doc_id, pillar, pillar_ord, coalesce(e, p, h) IS NOT NULL AS violation, CASE WHEN h IS NOT NULL OR (e IS NULL AND p IS NOT NULL) THEN 'HIGH' ELSE 'LOW' END AS confidence,
      CASE WHEN e IS NULL AND p IS NOT NULL THEN p WHEN h IS NOT NULL THEN h ELSE coalesce(e, '{R.NOT_ADDRESSED}') END AS citation FROM found"""


def _count(rule: tuple) -> str:
    name, p, i, x, phrase, *_ = rule
    hit = f"contains(lower(text), {D.lit(x)})" if phrase else D.rx("text", x)
    return f"SELECT '{name}' AS rule_set, '{p}' AS pillar, {i} AS ord, count(*) FILTER ({hit}) AS documents FROM policies"


ORACLES = {
    "a5_rule_hits": f"WITH {C.POLICIES_SQL} " + " UNION ALL ".join(map(_count, rule_rows())),
    "a5_scan_by_rules": _scan_sql(),
}
