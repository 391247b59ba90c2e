"""Scan history, caches, credits, watches and rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from clauseriver.functions import duck as D
from clauseriver.functions import rules as R
from clauseriver.functions import text as T
from clauseriver.operators.pages import site_category
from clauseriver.sources import corpus as C
from clauseriver.sources.upserts import UpsertLog

TTL_HOURS = {"quick": 48, "deep": 168}
MONTHLY_CREDITS = 400
COSTS = {"quick": 10, "deep": 20, "email": 5}


def ttl(tier: Column) -> Column:
    """How long a result of the tier holds; unknown tiers count as quick."""
    return F.when(tier == "deep", F.expr("INTERVAL 168 HOURS")).otherwise(F.expr("INTERVAL 48 HOURS"))


def upsert_cache(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """The last write of each cache_key wins; scan_count adds up; expires_at follows the tier."""
    cols = ["cache_key", "content_hash", "tier", "scanned_at", "scan_count"]
    rows = cache.select(*cols).unionByName(updates.select(*cols))
    last = rows.groupBy("cache_key").agg(F.max(F.struct("scanned_at", "content_hash", "tier")).alias("l"), F.sum("scan_count").alias("scan_count"))
    return last.select("cache_key", "l.content_hash", "l.tier", "l.scanned_at", "scan_count", (F.col("l.scanned_at") + ttl(F.col("l.tier"))).alias("expires_at"))


def cache_log(path: str) -> UpsertLog:
    """upsert_cache batch by batch: counts add up over spans of batches as over single ones."""
    cols = "cache_key string, content_hash string, tier string, scanned_at timestamp_ntz, scan_count long, expires_at timestamp_ntz"
    return UpsertLog(path, cols, lambda rows: upsert_cache(rows, rows.limit(0)))


def cache_healthy(tier: Column, want_tier: Column, pillars: Column, tldr: Column, version: Column, current: str, want_dark: Column, has_dark: Column) -> Column:
    """Whether a cached result may answer a request: right tier and version, pillars for deep scans, a real summary."""
    return (
        (tier.isNull() | (tier == want_tier))
        & ~((want_tier == "deep") & (F.coalesce(pillars, F.lit(0)) == 0))
        & (F.coalesce(tldr, F.lit("")) != "Analysis complete.")
        & ~(want_dark & pillars.isNotNull() & ~has_dark)
        & (F.coalesce(version, F.lit("")) == current)
    )


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (req_id, cache_key, content_hash, req_ts) with scanned_at of the newest unexpired entry of the same
    content, null if there is none.

    Requests and entries of a key are laid along one line of time, on which each request meets the newest entry before it; the
    hours of a key hand theirs over, so no task holds a hot key. As a key's entries hold equally long, the newest is the one that
    expires last. Where it has expired and an older one has not, and only there, the request is joined with the key's entries.
    """
    key = ["cache_key", "content_hash"]
    c = cache.select(*key, "scanned_at", "expires_at").where("cache_key IS NOT NULL AND content_hash IS NOT NULL AND scanned_at < expires_at")
    none = lambda like, name: F.lit(None).cast(like.schema[name].dataType).alias(name)
    line = requests.select(*requests.columns, F.col("req_ts").alias("_at"), none(c, "scanned_at"), none(c, "expires_at"), F.lit(1).alias("_kind"))
    line = line.unionByName(c.select(*key, "scanned_at", "expires_at", F.col("scanned_at").alias("_at"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    entry = F.when(F.col("_kind") == 0, F.struct("scanned_at", "expires_at"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    each = F.struct(F.max(entry).alias("last"), F.max("expires_at").alias("most"))
    rows = _handed_over(line, key, "_at", each, lambda w: F.struct(F.max("_each.last").over(before(w)).alias("last"), F.max("_each.most").over(before(w)).alias("most")))
    w = W.partitionBy("_key", "_hour").orderBy("_at", "_kind", "expires_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_last", F.coalesce(F.max(entry).over(w), F.col("_carried.last"))).withColumn("_most", F.greatest(F.max("expires_at").over(w), F.col("_carried.most")))
    rows = rows.where("_kind = 1").withColumn("_older", (F.col("_last.expires_at") <= F.col("req_ts")) & (F.col("_most") > F.col("req_ts")))
    rows = rows.select(*requests.columns, F.when(F.col("_last.expires_at") > F.col("req_ts"), F.col("_last.scanned_at")).alias("_found"), F.coalesce("_older", F.lit(False)).alias("_older"))
    hit = rows.where("_older").join(c, key).where((F.col("scanned_at") <= F.col("req_ts")) & (F.col("req_ts") < F.col("expires_at")))
    best = hit.groupBy("req_id").agg(F.max("scanned_at").alias("_best"))
    return rows.join(best, "req_id", "left").select(*requests.columns, F.coalesce("_found", "_best").alias("scanned_at"))


def golden_lookup(requests: DataFrame, golden: DataFrame) -> DataFrame:
    """requests with the prepared result of the very same url, or null."""
    return requests.join(golden.select("url", "result"), "url", "left")


def write_scans(scans: DataFrame, path: str) -> None:
    """Appends scan records by tier; a missing rating counts as RISKY, a missing score as 0."""
    filled = scans.withColumn("rating", F.coalesce("rating", F.lit("RISKY"))).withColumn("score", F.coalesce("score", F.lit(0)))
    filled.write.mode("append").partitionBy("tier").parquet(path)


def reports_by_url(reports: DataFrame, scans: DataFrame) -> DataFrame:
    """url, reports, avg_score: disputed results joined to their scans."""
    return reports.join(scans.select(F.col("scan_id").alias("request_id"), "url", "score"), "request_id").groupBy("url").agg(F.count("*").alias("reports"), F.avg("score").alias("avg_score"))


def search_history(scans: DataFrame, rating: str = "all", text: str = "") -> DataFrame:
    rows = scans if rating == "all" else scans.where(F.col("rating") == rating)
    return rows.where(F.contains(F.lower("url"), F.lit(text.lower())) | F.contains(F.lower("tldr"), F.lit(text.lower()))) if text else rows


def due_watches(watches: DataFrame, as_of: str) -> DataFrame:
    """Watches whose next check (by default a week after they began) has come."""
    at = F.coalesce("next_check_at", F.col("created_at") + F.expr("INTERVAL 7 DAYS"))
    return watches.where(at <= F.lit(as_of).cast("timestamp_ntz"))


def display_flags(scans: DataFrame) -> DataFrame:
    return scans.withColumn("extreme", (F.col("rating") == "RISKY") & (F.col("score") <= 15)).withColumn("cautious", (F.col("rating") == "OKAY") & (F.col("score") < 60))


def low_confidence_warning(findings: DataFrame) -> DataFrame:
    """doc_id, all_low: whether a document has violations and all of them are LOW."""
    return findings.where("violation").groupBy("doc_id").agg(F.bool_and(F.col("confidence") == "LOW").alias("all_low"))


def freshness_label(ts: Column, as_of: str) -> Column:
    minutes = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))) / 60)
    say = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m")).when(minutes < 1440, say(F.floor(minutes / 60), "h")).otherwise(say(F.floor(minutes / 1440), "d"))


def rating_counts(scans: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scans.groupBy(*(by or [])).agg(*[F.count_if(F.col("rating") == r).alias(r.lower()) for r in ("SAFE", "OKAY", "RISKY")])


def category_benchmarks(scans: DataFrame) -> DataFrame:
    """category, scans, avg_score, riskiest, safest site of each category of sites (by least and greatest mean score)."""
    rows = scans.withColumn("category", site_category(F.col("url"))).where("category IS NOT NULL")
    sites = rows.groupBy("category", T.host(F.col("url")).alias("site")).agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    mean = F.col("s") / F.col("n")
    return sites.groupBy("category").agg(
        F.sum("n").alias("scans"), F.round(F.sum("s") / F.sum("n"), 6).alias("avg_score"),
        F.min_by("site", F.struct(mean, "site")).alias("riskiest"), F.max_by("site", F.struct(mean, "site")).alias("safest"),
    )


def vs_benchmark(scans: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """scan_id, difference: the scan's score against its category's mean."""
    rows = scans.withColumn("category", site_category(F.col("url"))).join(benchmarks.select("category", "avg_score"), "category")
    diff = F.floor(F.col("score") - F.col("avg_score") + 0.5).cast("long")
    text = F.when(diff > 0, F.concat(diff.cast("string"), F.lit(" above average"))).when(diff < 0, F.concat((-diff).cast("string"), F.lit(" below average"))).otherwise("average")
    return rows.select("scan_id", text.alias("difference"))


def user_history(scans: DataFrame) -> DataFrame:
    return scans.withColumn("n", F.row_number().over(W.partitionBy("uid").orderBy(F.desc("created_at"), "scan_id")))


def latest_scan(scans: DataFrame) -> DataFrame:
    """The last scan of each url and tier."""
    last = F.max(F.struct("created_at", "scan_id", "score", "rating")).alias("l")
    return scans.groupBy(F.sha2("url", 256).alias("url_hash"), "tier").agg(last).select("url_hash", "tier", "l.*")


def _hour(at: str) -> Column:
    """Hours since 1970; no time counts as before all others."""
    return F.coalesce(F.expr(f"unix_seconds(CAST({at} AS TIMESTAMP)) DIV 3600"), F.lit(-(2**40)))


def _handed_over(rows: DataFrame, key: list[str], at: str, each: Column, carry: Callable[[WindowSpec], Column]) -> DataFrame:
    """rows with _key, _hour and _carried: what `carry` makes of the column _each of the key's hours.

    A key's rows meet by the hour only, and its hours in one small table, so that a hot key isn't one task.
    """
    placed = rows.withColumn("_key", F.to_json(F.struct(*key))).withColumn("_hour", _hour(at))
    hours = placed.groupBy("_key", "_hour").agg(each.alias("_each"))
    return placed.join(hours.select("_key", "_hour", carry(W.partitionBy("_key").orderBy("_hour")).alias("_carried")), ["_key", "_hour"])


def policy_changes(scans: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Consecutive scans of a url whose content differs: old and new score."""
    value, order = F.struct("content_hash", "score"), ["created_at", "scan_id"]
    rows = _handed_over(scans, ["url"], "created_at", F.max_by(value, F.struct(*order)), lambda w: F.lag("_each").over(w))
    old = F.coalesce(F.lag(value).over(W.partitionBy("_key", "_hour").orderBy(*order)), F.col("_carried"))
    rows = rows.withColumn("_old", old).where("_old.content_hash IS NOT NULL AND _old.content_hash <> content_hash")
    return rows.select("scan_id", "url", F.col("_old.score").alias("old_score"), F.col("score").alias("new_score"), "rating", "tldr", *(extra or []))


def scan_count(scans: DataFrame) -> DataFrame:
    before = lambda w: F.sum("_each").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = _handed_over(scans, ["url", "tier"], "created_at", F.count("*"), before)
    inside = F.row_number().over(W.partitionBy("_key", "_hour").orderBy("created_at", "scan_id"))
    return rows.withColumn("scan_count", F.coalesce("_carried", F.lit(0)) + inside).drop("_key", "_hour", "_carried")


def _balances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs, sorted by key and time -> what each finds as balance, and how many of its events are accepted."""
    key, balance = None, 0
    for batch in batches:
        before, taken = [], []
        for k, kind, amount, n, opening in zip(batch["_key"], batch["kind"], batch["amount"].tolist(), batch["n"].tolist(), batch["opening"].tolist(), strict=True):
            if k != key:
                key, balance = k, opening
            before.append(balance)
            if kind == "refund":
                taken.append(n)
                balance += n * amount
                continue
            can = n if balance >= amount else 0
            taken.append(min(can, balance // amount) if amount > 0 else can)
            balance -= taken[-1] * amount
        yield batch[["_key", "_hour", "_run"]].assign(before=before, taken=taken)


def credit_ledger(events: DataFrame, monthly: int = MONTHLY_CREDITS, opening: DataFrame | None = None) -> DataFrame:
    """events (uid, ts, seq, kind deduct or refund, amount) with accepted and balance.

    A deduction beyond the balance is rejected and changes nothing, so balances follow one another. Equal events in a
    row within an hour are one run first; only runs are sorted by user and month, and pass by one at a time. A month begins
    with its balance in `opening` (uid, month, balance), if it has one, else with `monthly`. No amount counts as 0.
    """
    rows = events.select("uid", F.date_format("ts", "yyyy-MM").alias("month"), "ts", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("deduct")).alias("kind"), F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"))
    rows = rows.withColumn("_key", F.to_json(F.struct("uid", "month"))).withColumn("_hour", _hour("ts"))
    order, what = ["ts", "seq", "kind", "amount"], F.struct("kind", "amount")
    w = W.partitionBy("_key", "_hour").orderBy(*order)
    rows = rows.withColumn("_new", (~F.lag(what).over(w).eqNullSafe(what)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy("_key", "_hour", "_run").orderBy(*order)))
    runs = rows.groupBy("_key", "_hour", "_run", "kind", "amount").agg(F.count("*").alias("n"))
    if opening is None:
        runs = runs.withColumn("opening", F.lit(monthly).cast("long"))
    else:
        known = opening.select(F.to_json(F.struct("uid", "month")).alias("_key"), F.col("balance").cast("long").alias("opening"))
        runs = runs.join(known, "_key", "left").withColumn("opening", F.coalesce("opening", F.lit(monthly).cast("long")))
    runs = runs.repartition("_key").sortWithinPartitions("_key", "_hour", "_run")
    runs = runs.mapInPandas(_balances, "_key string, _hour long, _run long, before long, taken long")
    moved = F.when(F.col("kind") == "refund", F.col("amount") * F.col("_i")).otherwise(-F.col("amount") * F.least("_i", "taken"))
    return rows.join(runs, ["_key", "_hour", "_run"]).select("uid", "month", "seq", (F.col("_i") <= F.col("taken")).alias("accepted"), (F.col("before") + moved).cast("int").alias("balance"))


def rate_limit_audit(requests: DataFrame, n: int = 10, window: str = "1 minute") -> DataFrame:
    """Keys (uid) with more than n requests in a window."""
    return requests.groupBy("uid", F.window(F.col("created_at").cast("timestamp"), window).alias("w")).count().where(F.col("count") > n).select("uid", F.col("w.start").alias("start"), F.col("count").alias("requests"))


def sliding_rate(requests: DataFrame, seconds: int = 60) -> DataFrame:
    w = W.partitionBy("uid").orderBy(F.unix_seconds(F.col("created_at").cast("timestamp"))).rangeBetween(-seconds, 0)
    return requests.withColumn("recent", F.count("*").over(w))


def recent_errors(errors: DataFrame, n: int = 20) -> DataFrame:
    """The newest n; a top-k, never a full sort."""
    return errors.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(n)


def content_dedupe(docs: DataFrame) -> DataFrame:
    """One document of each content (its first 10,000 characters, by hash): the least doc_id, and how many share it."""
    return docs.groupBy(F.sha2(F.substring("text", 1, 10_000), 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def watched(scans: DataFrame, watches: DataFrame, has: bool = True) -> DataFrame:
    return scans.join(watches.select("url"), "url", "left_semi" if has else "left_anti")


# -- queries ------------------------------------------------------------------------------------------

AS_OF = "2024-01-20 12:00:00"


def _s(run):
    return lambda s, d: run(C.scans(s, d))


def _cache(scans: DataFrame) -> DataFrame:
    return scans.select(F.concat_ws(":", "url", "tier").alias("cache_key"), "content_hash", "tier", F.col("created_at").alias("scanned_at"), F.lit(1).cast("long").alias("scan_count"))


def _upsert(scans: DataFrame) -> DataFrame:
    c = _cache(scans)
    return upsert_cache(c.where(F.dayofmonth("scanned_at") <= 10), c.where(F.dayofmonth("scanned_at") > 10))


def _cache_store(spark, sf_dir: str) -> DataFrame:
    """The cache as nine batches of events leave it, of some days each."""
    log = cache_log(f"{C.shared_folder(spark)}/cache-{uuid4().hex}")
    rows = _cache(C.scans(spark, sf_dir)).withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    for n in range(9):
        log.upsert(rows.where(F.floor(F.dayofmonth("scanned_at") / 4) == n), n)
    return log.rows(spark)


def _lookup(scans: DataFrame) -> DataFrame:
    c = _cache(scans).withColumn("scanned_at", F.col("scanned_at") + F.expr("INTERVAL 1 MINUTE")).withColumn("expires_at", F.col("scanned_at") + ttl(F.col("tier")))
    r = scans.select(F.col("scan_id").alias("req_id"), F.concat_ws(":", "url", "tier").alias("cache_key"), "content_hash", F.col("created_at").alias("req_ts"))
    return cache_lookup(r, c.groupBy("cache_key", "content_hash", "scanned_at").agg(F.max("expires_at").alias("expires_at")))


#: Credits of a month in the queries, so that the events of the given tables overdraw them.
QUERY_CREDITS = 150


def credit_events(scans: DataFrame) -> DataFrame:
    """Every scan as a credit event, half a month later, so that the month changes: deep ones cost 20, quick ones 10,
    failed ones are charged 5 for their report by mail; what concerns the account refunds 15."""
    amount = F.when(F.col("tier") == "deep", COSTS["deep"]).when(F.col("tier") == "quick", COSTS["quick"]).when(F.col("tier") == "failed", COSTS["email"]).otherwise(15)
    kind = F.when(F.col("tier") == "account", "refund").otherwise("deduct")
    return scans.select("uid", (F.col("created_at") + F.expr("INTERVAL 15 DAYS")).cast("timestamp").alias("ts"), F.col("scan_id").alias("seq"), kind.alias("kind"), amount.alias("amount"))


def _healthy(scans: DataFrame) -> DataFrame:
    n = F.col("scan_id")
    ok = cache_healthy(
        F.col("tier"), F.when(n % 2 == 0, "deep").otherwise("quick"), F.when(n % 5 != 0, n % 7), F.when(n % 11 == 0, "Analysis complete.").otherwise(F.col("tldr")),
        F.when(n % 13 != 0, "v3"), "v3", n % 3 == 0, n % 4 != 0,
    )
    return scans.select("scan_id", ok.alias("healthy"))


def _watches(scans: DataFrame) -> DataFrame:
    return scans.select(F.col("scan_id").alias("watch_id"), "uid", "url", "created_at", F.when(F.col("scan_id") % 80 == 0, F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("next_check_at"))


def _written(spark, sf_dir) -> DataFrame:
    """Scan records after they have been written and read back."""
    path = f"{C.shared_folder(spark)}/scans-{uuid4().hex}"
    rows = C.scans(spark, sf_dir).select("scan_id", "url", "tier", F.when(F.col("score") >= 20, F.col("rating")).alias("rating"), F.when(F.col("score") < 90, F.col("score")).alias("score"))
    write_scans(rows, path)
    return spark.read.parquet(path).select("scan_id", "url", "tier", "rating", "score")


QUERIES = {
    "a7_write_scans": _written,
    "a8_upsert_cache": _s(_upsert),
    "a8_cache_store": _cache_store,
    "a9_golden_lookup": _s(lambda x: golden_lookup(x.select("scan_id", "url"), x.where("tier = 'deep'").groupBy("url").agg(F.max_by("tldr", "scan_id").alias("result")))),
    "a11_reports_by_url": _s(lambda x: reports_by_url(x.select(F.col("scan_id").alias("request_id")), x)),
    "b11_search_history": _s(lambda x: search_history(x, "RISKY", "SPOTIFY").select("scan_id", "url", "rating")),
    "b12_cache_healthy": _s(_healthy),
    "b13_due_watches": _s(lambda x: due_watches(_watches(x), AS_OF).select("watch_id", "url")),
    "b14_display_flags": _s(lambda x: display_flags(x).select("scan_id", "extreme", "cautious")),
    "b14_low_confidence_warning": lambda s, d: low_confidence_warning(C.findings(C.policies(s, d))),
    "b15_freshness_label": _s(lambda x: x.select("scan_id", freshness_label(F.col("created_at"), "2024-02-01 00:00:00").alias("label"))),
    "f9_rating_counts": _s(lambda x: rating_counts(x, ["uid"])),
    "f12_category_benchmarks": _s(category_benchmarks),
    "f12_vs_benchmark": _s(lambda x: vs_benchmark(x, category_benchmarks(x))),
    "g1_cache_lookup": _s(_lookup),
    "g4_watched": _s(lambda x: watched(x, _watches(x).where("url LIKE '%legal%'")).select("scan_id", "url")),
    "g4_not_watched": _s(lambda x: watched(x, _watches(x).where("url LIKE '%legal%'"), False).select("scan_id", "url")),
    "w1_user_history": _s(lambda x: user_history(x).select("scan_id", "uid", "n")),
    "w2_latest_scan": _s(latest_scan),
    "w3_policy_changes": _s(policy_changes),
    "w4_scan_count": _s(lambda x: scan_count(x).select("scan_id", "scan_count")),
    "w5_credit_ledger": _s(lambda x: credit_ledger(credit_events(x), QUERY_CREDITS)),
    "w6_rate_limit_audit": _s(lambda x: rate_limit_audit(x, 1, "1 hour").select("uid", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "requests")),
    "w6_sliding_rate": _s(lambda x: sliding_rate(x, 3600).select("scan_id", "recent")),
    "w7_recent_errors": _s(lambda x: recent_errors(x.where("tier = 'failed'")).select("scan_id", "uid", "created_at")),
    "x4_content_dedupe": lambda s, d: content_dedupe(C.read(s, d, "documents")),
}
S = f"WITH {C.SCANS_SQL}"
_site = f"CASE {' '.join(f'WHEN {D.rx(D.host("url"), p)} THEN {D.lit(n)}' for n, p in R.SITE_CATEGORIES.items())} END"
_bench = f"""bs AS (SELECT *, {_site} AS category, {D.host("url")} AS site FROM scans),
bm AS (SELECT category, site, sum(score) AS s, count(*) AS n FROM bs WHERE category IS NOT NULL GROUP BY ALL),
bench AS (SELECT category, CAST(sum(n) AS BIGINT) AS scans, round(sum(s) / sum(n), 6) AS avg_score, arg_min(site, (s / n, site)) AS riskiest, arg_max(site, (s / n, site)) AS safest FROM bm GROUP BY category)"""
_ttl = "CASE WHEN tier = 'deep' THEN INTERVAL 168 HOURS ELSE INTERVAL 48 HOURS END"
_watch_sql = "watches AS (SELECT scan_id AS watch_id, uid, url, created_at, CASE WHEN scan_id % 80 = 0 THEN created_at + INTERVAL 1 DAY END AS next_check_at FROM scans)"
ORACLES = {
    "a7_write_scans": f"{S} SELECT scan_id, url, tier, CASE WHEN score >= 20 THEN rating ELSE 'RISKY' END AS rating, CASE WHEN score < 90 THEN score ELSE 0 END AS score FROM scans",
    "a8_upsert_cache": f"""{S}, c AS (SELECT url || ':' || tier AS cache_key, content_hash, tier, created_at AS scanned_at FROM scans),
    r AS (SELECT *, count(*) OVER (PARTITION BY cache_key) AS scan_count, row_number() OVER (PARTITION BY cache_key ORDER BY scanned_at DESC, content_hash DESC) AS k FROM c)
    SELECT cache_key, content_hash, tier, scanned_at, scan_count, scanned_at + {_ttl} AS expires_at FROM r WHERE k = 1""",
    "a9_golden_lookup": f"{S}, g AS (SELECT url, arg_max(tldr, scan_id) AS result FROM scans WHERE tier = 'deep' GROUP BY url) SELECT scan_id, url, result FROM scans LEFT JOIN g USING (url)",
    "a11_reports_by_url": f"{S} SELECT url, count(*) AS reports, avg(score) AS avg_score FROM scans GROUP BY url",
    "b11_search_history": f"{S} SELECT scan_id, url, rating FROM scans WHERE rating = 'RISKY' AND (contains(lower(url), 'spotify') OR contains(lower(tldr), 'spotify'))",
    "b12_cache_healthy": f"""{S} SELECT scan_id, tier = CASE WHEN scan_id % 2 = 0 THEN 'deep' ELSE 'quick' END AND NOT (scan_id % 2 = 0 AND (scan_id % 5 = 0 OR scan_id % 7 = 0)) AND scan_id % 11 <> 0
      AND NOT (scan_id % 3 = 0 AND scan_id % 5 <> 0 AND scan_id % 4 = 0) AND scan_id % 13 <> 0 AS healthy FROM scans""",
    "b13_due_watches": f"{S}, {_watch_sql} SELECT watch_id, url FROM watches WHERE coalesce(next_check_at, created_at + INTERVAL 7 DAY) <= TIMESTAMP '{AS_OF}'",
    "b14_display_flags": f"{S} SELECT scan_id, rating = 'RISKY' AND score <= 15 AS extreme, rating = 'OKAY' AND score < 60 AS cautious FROM scans",
    "b14_low_confidence_warning": f"WITH {C.POLICIES_SQL}, {C.FINDINGS_SQL} SELECT doc_id, bool_and(confidence = 'LOW') AS all_low FROM findings WHERE violation GROUP BY doc_id",
    "b15_freshness_label": f"""{S}, m AS (SELECT scan_id, CAST(floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(created_at))) / 60) AS BIGINT) AS m FROM scans)
    SELECT scan_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS label FROM m""",
    "f9_rating_counts": f"{S} SELECT uid, count(*) FILTER (rating = 'SAFE') AS safe, count(*) FILTER (rating = 'OKAY') AS okay, count(*) FILTER (rating = 'RISKY') AS risky FROM scans GROUP BY uid",
    "f12_category_benchmarks": f"{S}, {_bench} SELECT * FROM bench",
    "f12_vs_benchmark": f"""{S}, {_bench}, v AS (SELECT scan_id, CAST(floor(score - avg_score + 0.5) AS BIGINT) AS d FROM bs JOIN bench USING (category))
    SELECT scan_id, CASE WHEN d > 0 THEN d || ' above average' WHEN d < 0 THEN -d || ' below average' ELSE 'average' END AS difference FROM v""",
    "g1_cache_lookup": f"""{S}, c AS (SELECT DISTINCT url || ':' || tier AS cache_key, content_hash, created_at + INTERVAL 1 MINUTE AS scanned_at, created_at + INTERVAL 1 MINUTE + {_ttl} AS expires_at FROM scans)
    SELECT scan_id AS req_id, url || ':' || tier AS cache_key, s.content_hash, created_at AS req_ts, (SELECT max(scanned_at) FROM c WHERE c.cache_key = s.url || ':' || s.tier AND c.content_hash = s.content_hash AND scanned_at <= s.created_at AND s.created_at < expires_at) AS scanned_at FROM scans s""",
    "g4_watched": f"{S}, {_watch_sql} SELECT scan_id, url FROM scans WHERE url IN (SELECT url FROM watches WHERE url LIKE '%legal%')",
    "g4_not_watched": f"{S}, {_watch_sql} SELECT scan_id, url FROM scans WHERE url NOT IN (SELECT url FROM watches WHERE url LIKE '%legal%')",
    "w1_user_history": f"{S} SELECT scan_id, uid, row_number() OVER (PARTITION BY uid ORDER BY created_at DESC, scan_id) AS n FROM scans",
    "w2_latest_scan": f"{S} SELECT sha256(url) AS url_hash, tier, created_at, scan_id, score, rating FROM (SELECT *, row_number() OVER (PARTITION BY url, tier ORDER BY created_at DESC, scan_id DESC) AS k FROM scans) WHERE k = 1",
    "w3_policy_changes": f"""{S}, l AS (SELECT *, lag(content_hash) OVER w AS old_hash, lag(score) OVER w AS old_score FROM scans WINDOW w AS (PARTITION BY url ORDER BY created_at, scan_id))
    SELECT scan_id, url, old_score, score AS new_score, rating, tldr FROM l WHERE old_hash <> content_hash""",
    "w4_scan_count": f"{S} SELECT scan_id, count(*) OVER (PARTITION BY url, tier ORDER BY created_at, scan_id ROWS UNBOUNDED PRECEDING) AS scan_count FROM scans",
    "w5_credit_ledger": f"""WITH RECURSIVE {C.SCANS_SQL},
    k AS (SELECT uid, strftime(created_at + INTERVAL 15 DAY, '%Y-%m') AS month, scan_id AS seq, CASE tier WHEN 'deep' THEN -20 WHEN 'quick' THEN -10 WHEN 'failed' THEN -5 ELSE 15 END AS d, row_number() OVER (PARTITION BY uid, strftime(created_at + INTERVAL 15 DAY, '%Y-%m') ORDER BY created_at, scan_id) AS i FROM scans),
    b AS (SELECT uid, month, seq, i, {QUERY_CREDITS} + d >= 0 AS accepted, {QUERY_CREDITS} + CASE WHEN {QUERY_CREDITS} + d >= 0 THEN d ELSE 0 END AS balance FROM k WHERE i = 1
      UNION ALL SELECT k.uid, k.month, k.seq, k.i, b.balance + k.d >= 0, b.balance + CASE WHEN b.balance + k.d >= 0 THEN k.d ELSE 0 END FROM b JOIN k ON k.uid = b.uid AND k.month = b.month AND k.i = b.i + 1)
    SELECT uid, month, seq, accepted, balance FROM b""",
    "w6_rate_limit_audit": f"{S} SELECT uid, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M') AS start, count(*) AS requests FROM scans GROUP BY ALL HAVING count(*) > 1",
    "w6_sliding_rate": f"{S}, e AS (SELECT *, CAST(floor(epoch(created_at)) AS BIGINT) AS t FROM scans) SELECT scan_id, count(*) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM e",
    "w7_recent_errors": f"{S} SELECT scan_id, uid, created_at FROM scans WHERE tier = 'failed' ORDER BY created_at DESC, scan_id DESC LIMIT 20",
    "x4_content_dedupe": "SELECT sha256(substr(text, 1, 10000)) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL",
}
ORACLES["a8_cache_store"] = ORACLES["a8_upsert_cache"]
