"""Derived tables: policies, findings, model outputs and scans, made by Spark from the given tables.

The given prose holds no policy language, so each document gets two clauses by its id.
"""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.functions import duck as D
from clauseriver.functions.rules import PILLARS
from clauseriver.functions.text import clean_source

CLAUSES = [
    "We train our models on your content and may fine-tune them later.",
    "Your content will not be used to train any system. We do not train ai with it.",
    "We may use your content to improve and to train our machine learning models, unless you opt out.",
    "We sell your personal data to advertisers and share personal details with third-party marketing partners.",
    "We do not sell your personal information, except when a partner pays for it.",
    "We never sell personal data to anyone.",
    "A data broker may receive it; we share your information with advertising partners for their commercial purposes.",
    "We retain your data for up to 7 years after deletion of the account.",
    "Data is deleted within 30 days of your request and retained only as long as necessary.",
    "Logs are stored permanently, and we keep personal information indefinitely.",
    "You grant us a perpetual, irrevocable, royalty-free and sublicensable license for any purpose.",
    "You retain ownership of everything you post; we claim no ownership of it.",
    "You give us a non-exclusive worldwide license to your content, including derivative works.",
    "You agree to binding individual arbitration and to a class action waiver on an individual basis.",
    "There is no mandatory arbitration, and you may join class action suits.",
    "Our total liability shall not exceed $100; any claim must be brought within 30 days.",
    "We may change these terms from time to time at our sole discretion, including but not limited to prices.",
    "This policy is written in plain language and easy to understand.",
    "We do not share your data unless we are asked to share it.",
    "Our search engine keeps nothing: queries are not logged. Privacy is by design first.",
    "Messages are end-to-end encrypted with zero-knowledge storage; we cannot read your messages.",
    "Your account balance and order history show the shipping address and payment method.",
    "SECTION 12. LIMITATION OF LIABILITY APPLIES TO ALL CLAIMS AND TO ALL DISPUTES YOU MAY BRING.",
    "Feedback that you send us is licensed to us without any limit.",
]
SITES = [
    "https://www.spotify.com/legal/terms-of-service",
    "https://x.com/en/tos",
    "https://www.dropbox.com/privacy",
    "https://www.paypal.com/us/legal/user-agreement",
    "https://signal.org/legal/",
    "https://news.example.org/today?page=2",
    "https://kagi.com/privacy.pdf",
    "https://github.com/site/terms",
    "https://www.amazon.com/gp/help",
    "https://slack.com/terms",
    "https://www.netflix.com/legal",
    "https://store.steampowered.com/subscriber_agreement",
    "https://mybank.example.com/privacy_policy",
    "https://example.com/about",
    "https://www.notion.so/terms.PDF?x=1",
]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only where the driver is the executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what several steps read is made once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of texts, whose rows cost far more to work on than to move.
TEXTS = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts in fewer files than there are cores are dealt to all of them; larger tables stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and len(df.inputFiles()) < cores else df


def _pick(items: list[str], index):
    return F.get(F.array(*map(F.lit, items)), index.cast("int"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, url, service, lang, text."""
    return as_policies(read(spark, sf_dir, "documents"))


def as_policies(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    n = len(CLAUSES)
    first, second = _pick(CLAUSES, F.col("doc_id") % n), _pick(CLAUSES, (F.col("doc_id") * 7 + 3) % n)
    return docs.select(
        "doc_id",
        _pick(SITES, F.col("doc_id") % len(SITES)).alias("url"),
        F.concat(F.lit("svc"), (F.col("doc_id") % 25).cast("string")).alias("service"),
        "lang",
        clean_source(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), first, F.lit(" "), second)).alias("text"),
    )


def findings(policies: DataFrame) -> DataFrame:
    """A model's findings by document and pillar: some right, some vague, some made up. The text isn't kept."""
    n = F.col("doc_id") * 7 + F.col("pillar_ord") * 13
    kind = n % 8
    cited = (
        F.when(kind <= 1, _pick(CLAUSES, F.col("doc_id") % len(CLAUSES)))
        .when(kind == 2, F.lit("[NOT_FOUND]"))
        .when(kind == 3, F.lit("Not addressed in document."))
        .when(kind == 4, F.lit("The policy does not mention this practice in the document."))
        .when(kind == 5, F.concat(F.lit('The policy states that "'), _pick(CLAUSES, (F.col("doc_id") * 7 + 3) % len(CLAUSES)), F.lit('", indicating a risk.')))
        .when(kind == 6, F.col("head"))
        .otherwise(F.lit("Data is retained long by the company for feedback"))
    )
    ords = F.array(*[F.struct(F.lit(p).alias("pillar"), F.lit(i + 1).alias("pillar_ord")) for i, p in enumerate(PILLARS)])
    rows = policies.select("doc_id", F.substring("text", 1, 120).alias("head"), F.inline(ords))
    return rows.select(
        "doc_id", "pillar", "pillar_ord",
        (n % 3 == 0).alias("violation"),
        _pick(["HIGH", "MEDIUM", "LOW"], F.floor(n / 3) % 3).alias("confidence"),
        cited.alias("citation"),
    )


def model_outputs(policies: DataFrame) -> DataFrame:
    """doc_id, chunk_no, model, raw_json and tokens: two models, one to three chunks, some answers broken."""
    chunks = policies.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)).alias("chunk_no"))
    rows = chunks.select("doc_id", "chunk_no", F.explode(F.array(F.lit("primary"), F.lit("corroborator"))).alias("model"))
    n = F.col("doc_id") * 5 + F.col("chunk_no") * 3 + (F.col("model") == "primary").cast("int")
    parts = []
    for i, p in enumerate(PILLARS):
        value = F.concat(
            F.lit(f'"{p}":{{"violation":'), F.when((n + i) % 4 == 0, F.lit("true")).otherwise(F.lit("false")),
            F.lit(',"citation":"quote '), (n % 7).cast("string"), F.lit('","confidence":"'),
            _pick(["HIGH", "MEDIUM", "LOW"], (n + i) % 3), F.lit('"}'),
        )
        parts.append(value)
    body = F.concat(F.lit('{"tldr":"Summary number '), n.cast("string"), F.lit(' of the policy","pillars":{'), F.concat_ws(",", *parts), F.lit("}}"))
    raw = F.when(n % 11 == 0, F.lit("Sorry, I can not do that.")).when(n % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), "model", raw.alias("raw_json"), (n % 900 + 100).alias("input_tokens"), (n % 90 + 10).alias("output_tokens"))


def server_outputs(chunks: DataFrame) -> DataFrame:
    """Answers about chunks (doc_id, chunk_no, chunk_text): doc_id, chunk_no, model, tier, raw_json.

    A sixth of the documents are quick scans with flat answers of one model; for the others two models cite: right, cut short,
    wrapped, vague, made up or not at all. Some answers are broken or fenced.
    """
    rows = chunks.withColumn("model", F.explode(F.array(F.lit("primary"), F.lit("corroborator"))))
    own = (F.col("model") == "primary").cast("int")
    whole, quick = F.col("doc_id") * 5 + F.col("chunk_no") * 3 + own, F.col("doc_id") % 6 == 0
    flags, entries = [], []
    for i, p in enumerate(PILLARS):
        n = F.col("doc_id") * 7 + F.col("chunk_no") * 5 + 13 * (i + 1) + own
        yes, kind = n % 3 == 0, n % 8
        cited = (
            F.when(kind <= 1, _pick(CLAUSES, F.col("doc_id") % len(CLAUSES))).when(kind == 2, F.lit("[NOT_FOUND]")).when(kind == 3, F.lit("Not addressed in document."))
            .when(kind == 4, F.lit("The policy does not mention this practice in the document."))
            .when(kind == 5, F.concat(F.lit('The policy states that "'), _pick(CLAUSES, (F.col("doc_id") * 7 + 3) % len(CLAUSES)), F.lit('", indicating a risk.')))
            .when(kind == 6, F.substring("chunk_text", 1, 120)).otherwise(F.lit("Data is retained long by the company for feedback"))
        )
        flags.append(yes.alias(p))
        entries.append(F.struct(F.lit(p), F.struct(yes.alias("violation"), cited.alias("citation"), _pick(["HIGH", "MEDIUM", "LOW"], F.floor(n / 3) % 3).alias("confidence"))))
    tldr = F.when(whole % 4 == 0, "Analysis complete.").when(whole % 4 == 1, "Short.").otherwise(F.concat(F.lit("Summary number "), whole.cast("string"), F.lit(" of the policy"))).alias("tldr")
    body = F.when(quick, F.to_json(F.struct(tldr, *flags))).otherwise(F.to_json(F.struct(tldr, F.map_from_entries(F.array(*entries)).alias("pillars"))))
    raw = F.when(whole % 11 == 0, F.lit("Sorry, I can not do that.")).when(whole % 5 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.where(~quick | (own == 1)).select("doc_id", "chunk_no", "model", F.when(quick, "quick").otherwise("deep").alias("tier"), raw.alias("raw_json"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan records from the events."""
    return as_scans(read(spark, sf_dir, "events"))


def as_scans(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    score = (n * 37 + 11) % 101
    return e.select(
        n.alias("scan_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        _pick(SITES, (n * 7) % len(SITES)).alias("url"),
        F.when(F.col("event_type") == "purchase", "deep").when(F.col("event_type").isin("view", "click"), "quick").when(F.col("event_type") == "error", "failed").otherwise("account").alias("tier"),
        score.cast("int").alias("score"),
        F.when(score >= 80, "SAFE").when(score >= 50, "OKAY").otherwise("RISKY").alias("rating"),
        F.sha2(F.floor(n / 300).cast("string"), 256).alias("content_hash"),
        F.concat(F.lit("Summary of scan "), n.cast("string")).alias("tldr"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("created_at"),
    )


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(D.lit, items)) + "]"


POLICIES_SQL = f"""
policies AS (
  SELECT doc_id, {_list(SITES)}[CAST(doc_id % {len(SITES)} AS INT) + 1] AS url, 'svc' || (doc_id % 25) AS service, lang,
    regexp_replace(regexp_replace(coalesce(text, '') || chr(10) || {_list(CLAUSES)}[CAST(doc_id % {len(CLAUSES)} AS INT) + 1] || ' '
      || {_list(CLAUSES)}[CAST((doc_id * 7 + 3) % {len(CLAUSES)} AS INT) + 1], '\\r\\n?', chr(10), 'g'), chr(160), ' ', 'g') AS text
  FROM documents)"""
FINDINGS_SQL = f"""
pillar_list AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {i + 1})" for i, p in enumerate(PILLARS))}) AS t(pillar, pillar_ord)),
findings AS (
  SELECT doc_id, pillar, pillar_ord, n % 3 = 0 AS violation, ['HIGH', 'MEDIUM', 'LOW'][CAST((n // 3) % 3 AS INT) + 1] AS confidence,
    CASE n % 8
      WHEN 0 THEN {_list(CLAUSES)}[CAST(doc_id % {len(CLAUSES)} AS INT) + 1] WHEN 1 THEN {_list(CLAUSES)}[CAST(doc_id % {len(CLAUSES)} AS INT) + 1]
      WHEN 2 THEN '[NOT_FOUND]' WHEN 3 THEN 'Not addressed in document.'
      WHEN 4 THEN 'The policy does not mention this practice in the document.'
      WHEN 5 THEN 'The policy states that "' || {_list(CLAUSES)}[CAST((doc_id * 7 + 3) % {len(CLAUSES)} AS INT) + 1] || '", indicating a risk.'
      WHEN 6 THEN substr(text, 1, 120) ELSE 'Data is retained long by the company for feedback' END AS citation
  FROM (SELECT *, doc_id * 7 + pillar_ord * 13 AS n FROM policies, pillar_list))"""
_SQL_PARTS = " || ',' || ".join(
    f"""'"{p}":{{"violation":' || CASE WHEN (n + {i}) % 4 = 0 THEN 'true' ELSE 'false' END || ',"citation":"quote ' || (n % 7) || '","confidence":"' || ['HIGH', 'MEDIUM', 'LOW'][CAST((n + {i}) % 3 AS INT) + 1] || '"}}'"""
    for i, p in enumerate(PILLARS)
)
OUTPUTS_SQL = f"""
outputs_n AS (
  SELECT doc_id, chunk_no, model, doc_id * 5 + chunk_no * 3 + CAST(model = 'primary' AS INT) AS n
  FROM (SELECT doc_id, unnest(range(0, doc_id % 3 + 1)) AS chunk_no FROM policies), (VALUES ('primary'), ('corroborator')) AS m(model)),
model_outputs AS (
  SELECT doc_id, chunk_no, model, CASE WHEN n % 11 = 0 THEN 'Sorry, I can not do that.' WHEN n % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw_json,
    n % 900 + 100 AS input_tokens, n % 90 + 10 AS output_tokens
  FROM (SELECT *, '{{"tldr":"Summary number ' || n || ' of the policy","pillars":{{' || {_SQL_PARTS} || '}}}}' AS body FROM outputs_n))"""
#: The same answers as rows (c3: doc_id, chunk_no, chunk_text), without the detour by JSON; broken ones are left out.
SERVER_SQL = f"""
said AS (
  SELECT doc_id, chunk_no, model, pillar, CASE WHEN doc_id % 6 = 0 THEN 'quick' ELSE 'deep' END AS tier, chunk_text, whole, n % 3 = 0 AS violation, ['HIGH', 'MEDIUM', 'LOW'][CAST((n // 3) % 3 AS INT) + 1] AS confidence,
    CASE n % 8
      WHEN 0 THEN {_list(CLAUSES)}[CAST(doc_id % {len(CLAUSES)} AS INT) + 1] WHEN 1 THEN {_list(CLAUSES)}[CAST(doc_id % {len(CLAUSES)} AS INT) + 1]
      WHEN 2 THEN '[NOT_FOUND]' WHEN 3 THEN 'Not addressed in document.' WHEN 4 THEN 'The policy does not mention this practice in the document.'
      WHEN 5 THEN 'The policy states that "' || {_list(CLAUSES)}[CAST((doc_id * 7 + 3) % {len(CLAUSES)} AS INT) + 1] || '", indicating a risk.'
      WHEN 6 THEN substr(chunk_text, 1, 120) ELSE 'Data is retained long by the company for feedback' END AS citation
  FROM (SELECT *, doc_id * 7 + chunk_no * 5 + pillar_ord * 13 + CAST(model = 'primary' AS INT) AS n, doc_id * 5 + chunk_no * 3 + CAST(model = 'primary' AS INT) AS whole
    FROM c3, pillar_list, (VALUES ('primary'), ('corroborator')) AS m(model)) WHERE whole % 11 <> 0)"""
SCANS_SQL = f"""
scans AS (
  SELECT event_id AS scan_id, 'u' || user_id AS uid, {_list(SITES)}[CAST((event_id * 7) % {len(SITES)} AS INT) + 1] AS url,
    CASE WHEN event_type = 'purchase' THEN 'deep' WHEN event_type IN ('view', 'click') THEN 'quick' WHEN event_type = 'error' THEN 'failed' ELSE 'account' END AS tier,
    (event_id * 37 + 11) % 101 AS score,
    CASE WHEN (event_id * 37 + 11) % 101 >= 80 THEN 'SAFE' WHEN (event_id * 37 + 11) % 101 >= 50 THEN 'OKAY' ELSE 'RISKY' END AS rating,
    sha256(CAST(event_id // 300 AS VARCHAR)) AS content_hash, 'Summary of scan ' || event_id AS tldr, value AS latency_ms, ts AS created_at
  FROM events)"""
