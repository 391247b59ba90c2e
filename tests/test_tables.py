import datetime as dt
import random
from collections import Counter
import json

import pytest
from pyspark.sql import functions as F

from clauseriver.operators import evaluate, history, pages
from clauseriver.sources import upserts
from clauseriver.streaming import jobs, keyed

TS = dt.datetime(2024, 1, 31, 23, 0)


def ledger_events():
    h = lambda n: TS + dt.timedelta(hours=n)
    return [
        ("u", h(0), 1, "deduct", 390), ("u", h(0), 2, "deduct", 20), ("u", h(0), 3, "deduct", 10), ("u", h(0), 4, "refund", 500),
        ("u", h(0), 5, "deduct", 450), ("u", h(2), 6, "deduct", 400), ("u", h(2), 7, "deduct", 5), ("v", h(0), 8, "refund", 5),
    ]


EXPECTED = {1: (True, 10), 2: (False, 10), 3: (True, 0), 4: (True, 500), 5: (True, 50), 6: (True, 0), 7: (False, 0), 8: (True, 405)}


def test_credit_ledger(spark):
    df = spark.createDataFrame(ledger_events(), "uid string, ts timestamp, seq long, kind string, amount int")
    rows = history.credit_ledger(df).collect()
    assert {r["seq"]: (r["accepted"], r["balance"]) for r in rows} == EXPECTED
    assert {r["seq"]: r["month"] for r in rows}[6] == "2024-02"


LEDGER = "uid string, ts timestamp, seq long, kind string, amount int"


def emitted(spark, folder, parts, schema, job):
    """What the stream emits for the parts, each a file and a run of its own from the same checkpoint."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = job(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        keyed.with_rocks(spark, lambda stream=stream: jobs.run_once(stream, str(folder)))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def test_streamed_ledger_over_several_runs(spark, tmp_path):
    events = ledger_events()
    closing = ("end", TS + dt.timedelta(days=1), 99, "refund", 0)
    # 3 and 2 come in the wrong order, but within the watermark
    rows = emitted(spark, tmp_path, (events[:1] + events[2:3] + events[7:], events[1:2] + events[3:6], events[6:7], [closing]), LEDGER, keyed.stream_credits)
    assert {r["seq"]: (r["accepted"], r["balance"]) for r in rows if r["uid"] != "end"} == EXPECTED
    assert {r["seq"]: r["month"] for r in rows}[6] == "2024-02"


def test_streamed_ledger_drops_late_rows_and_forgets(spark, tmp_path):
    h = lambda n: TS + dt.timedelta(hours=n)
    parts = (
        [("u", h(0), 1, "deduct", 100)], [("w", h(1), 2, "deduct", 1)],
        [("u", h(0.5), 3, "deduct", 100), ("u", h(1), 4, "deduct", 50)],  # 3 is later than the watermark
        [("w", h(24 * 40), 5, "deduct", 1)], [("w", h(24 * 41), 6, "deduct", 1)],
    )
    rows = emitted(spark, tmp_path, parts, LEDGER, lambda x: keyed.stream_credits(x, keep_days=2))
    assert {r["seq"]: r["balance"] for r in rows} == {1: 300, 2: 399, 4: 350, 5: 399}
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/state")
    assert {r["key"][0] for r in state.select("key").collect()} == {"w"}  # u has been silent for too long


SCANS = "scan_id long, url string, created_at timestamp, content_hash string, score int, rating string, tldr string"


def test_streamed_changes_keep_state_between_runs(spark, tmp_path):
    rows = [(i, "u", TS + dt.timedelta(hours=i), h, 10 * i, "OKAY", "t") for i, h in enumerate("aabba")]
    rows += [(10, None, TS, "x", 5, "OKAY", "t"), (11, None, TS, "y", 6, "OKAY", None), (12, "u", None, "q", 1, "OKAY", "t")]
    late = [(20, "u", TS + dt.timedelta(hours=1), "z", 1, "OKAY", "t")]
    closing = [(99, "end", TS + dt.timedelta(days=1), "a", 0, "OKAY", "t")]
    got = emitted(spark, tmp_path, (rows[5:] + rows[:2], rows[2:4], late + rows[4:5], closing), SCANS, keyed.stream_policy_changes)
    out = sorted((r["scan_id"], r["old_score"], r["new_score"]) for r in got)
    batch = history.policy_changes(spark.createDataFrame([r for r in rows if r[2]], SCANS)).collect()
    assert out == sorted((r["scan_id"], r["old_score"], r["new_score"]) for r in batch) == [(2, 10, 20), (4, 30, 40), (11, 5, 6)]


def test_rows_wait_in_bunches(spark, tmp_path):
    """Thousands of rows that wait are few values of the state, and come out whole and in order."""
    n = 2 * keyed.BUNCH + 10
    events = [("u", TS + dt.timedelta(milliseconds=(7 * i) % n), (7 * i) % n, "deduct" if i % 3 else "refund", 3) for i in range(n)]
    emitted(spark, tmp_path, (events,), LEDGER, keyed.stream_credits)
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/state")
    assert 1 <= state.count() <= 3
    rows = emitted(spark, tmp_path, ([("end", TS + dt.timedelta(days=1), n, "refund", 0)],), LEDGER, keyed.stream_credits)
    batch = history.credit_ledger(spark.createDataFrame(events, LEDGER)).collect()
    assert len(rows) == n and {(r["seq"], r["accepted"], r["balance"]) for r in rows} == {(r["seq"], r["accepted"], r["balance"]) for r in batch}


def test_stream_in_parts_is_the_batch(spark):
    rng = random.Random(9)
    rows = [(i, f"u{rng.randrange(4)}", TS + dt.timedelta(minutes=7 * i), rng.choice("ab"), i, "OKAY", "t") for i in range(300)]
    df = spark.createDataFrame(rows, SCANS)
    got = {r["scan_id"] for r in jobs.run_in_parts(df, "created_at", keyed.stream_policy_changes).collect()}
    assert got == {r["scan_id"] for r in history.policy_changes(df).collect() if r["scan_id"] <= 297}


def test_spans():
    assert upserts.spans(0, 4) == [] and upserts.spans(1, 4) == [(0, 1)]
    assert upserts.spans(23, 4) == [(0, 16), (16, 20), (20, 21), (21, 22), (22, 23)]
    for n in range(200):
        found = upserts.spans(n, 3)
        assert [a for a, _ in found] == [0, *(b for _, b in found)][: len(found)] and (not found or found[-1][1] == n)
        assert len(found) <= 2 * 6


def test_notifications_follow_a_dict(spark, tmp_path):
    """Nine batches, one of them repeated, against a dict; spans that were taken in go, and the rest says the same."""
    rng = random.Random(2)
    log, want, schema = jobs.notifications(str(tmp_path / "log")), {}, "id string, uid string, created_at timestamp, read boolean"
    for n in range(9):
        rows = [(f"n{rng.randrange(30)}", f"u{n % 3}", TS + dt.timedelta(hours=n), rng.random() < 0.5) for _ in range(12)]
        for again in range(2 if n in (3, 5) else 1):
            log.upsert(spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), n)
        new = {}
        for i, uid, _, read in rows:
            new[i] = max(new.get(i, (False, "")), (read, uid))
        want |= new
    said = lambda: {r["id"]: (r["read"], r["uid"]) for r in log.rows(spark).collect()}
    assert said() == want and log.committed(spark) == 9
    assert log.vacuum(spark) > 0 and said() == want and log.vacuum(spark) == 0
    assert {r["uid"]: r["unread"] for r in jobs.unread(log.rows(spark)).collect()} == dict(Counter(u for read, u in want.values() if not read))


def test_cost_follows_the_batch(spark, tmp_path):
    """Most batches write their own rows only."""
    log = jobs.notifications(str(tmp_path / "log"))
    schema = "id string, uid string, created_at timestamp_ntz, read boolean"
    written = []
    for n in range(8):
        log.upsert(spark.createDataFrame([(f"n{n}-{i}", "u", TS, False) for i in range(10)], schema), n)
        a, b = upserts.spans(n + 1, 4)[-1]
        written.append(spark.read.parquet(f"{tmp_path}/log/span={a}-{b}").count())
    assert written == [10, 10, 10, 40, 10, 10, 10, 40]


def test_cache_expires_and_counts(spark):
    at = lambda h: TS + dt.timedelta(hours=h)
    schema = "cache_key string, content_hash string, tier string, scanned_at timestamp, scan_count long"
    old = spark.createDataFrame([("k", "h1", "quick", at(0), 3)], schema)
    new = spark.createDataFrame([("k", "h2", "quick", at(1), 1), ("z", "h", "odd", at(0), 1), ("d", "h", "deep", at(0), 1)], schema)
    cache = history.upsert_cache(old, new)
    got = {r["cache_key"]: (r["content_hash"], r["scan_count"], r["expires_at"]) for r in cache.collect()}
    assert got == {"k": ("h2", 4, at(49)), "z": ("h", 1, at(48)), "d": ("h", 1, at(168))}
    req = spark.createDataFrame([(1, "k", "h2", at(2)), (2, "k", "h2", at(49)), (3, "k", "h1", at(2)), (4, "k", "h2", at(0))], "req_id long, cache_key string, content_hash string, req_ts timestamp")
    assert {r["req_id"]: r["scanned_at"] for r in history.cache_lookup(req, cache).collect()} == {1: at(1), 2: None, 3: None, 4: None}


def test_scans_are_written_by_tier(spark, tmp_path):
    history.write_scans(spark.createDataFrame([(1, "deep", None, None), (2, "quick", "SAFE", 90)], "scan_id long, tier string, rating string, score int"), f"{tmp_path}/scans")
    rows = {r["scan_id"]: (r["tier"], r["rating"], r["score"]) for r in spark.read.parquet(f"{tmp_path}/scans").collect()}
    assert rows == {1: ("deep", "RISKY", 0), 2: ("quick", "SAFE", 90)}


def test_files_in(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text(json.dumps({"id": "x", "text": "t", "expected": {"rating": "SAFE", "pillars": {"ai_training": False}}}) + "\n")
    row = evaluate.read_eval_cases(spark, f"{tmp_path}/cases.jsonl").collect()[0]
    assert row["expected"]["rating"] == "SAFE" and row["expected"]["pillars"]["ai_training"] is False
    assert row["expected"]["pillars"]["dark_patterns"] is None
    (tmp_path / "a.txt").write_text("two\nlines")
    assert [r["text"] for r in evaluate.read_text_files(spark, f"{tmp_path}/a.txt").collect()] == ["two\nlines"]


@pytest.mark.parametrize(("size", "overlap", "most"), [(60, 20, None), (60, 0, None), (25, 10, 2), (1000, 10, 3)])
def test_chunks(spark, size, overlap, most):
    sentences = [f"Sentence number {i} is here." for i in range(20)] + ["X" * 90 + ".", "The last one."]
    text = " ".join(sentences)
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string")
    rows = pages.chunk_documents(df, size, overlap, most).where("doc_id = 1").orderBy("chunk_no").collect()
    chunks = [r["chunk_text"] for r in rows]
    if size == 1000:
        assert chunks == [text]
        return
    if most:
        assert len(chunks) == most
    else:
        at = -1
        for s in sentences:  # every sentence is there, in order
            at = next(i for i in range(max(at, 0), len(chunks)) if s in chunks[i])
    for a, b in zip(chunks, chunks[1:], strict=False):
        begun = b.split(". ")[0]
        assert overlap == 0 or begun.rstrip(".") in a or len(a.split(". ")[-1]) + 1 > overlap
    assert all(len(c) <= size + overlap + 1 or "X" * 90 in c or max(map(len, sentences)) > size for c in chunks)


def test_percentiles_use_the_floor_index(spark):
    df = spark.createDataFrame([("t", float(v)) for v in [5, 1, 1, 9, 7]], "tier string, latency_ms double")
    r = evaluate.latency_percentiles(df, ["tier"], [50, 90, 0]).collect()[0]
    assert (r["p50"], r["p90"], r["p0"], r["min"], r["max"]) == (5.0, 9.0, 1.0, 1.0, 9.0)


def test_stability_counts_missing_trials(spark):
    rows = [("a", t, "SAFE", 90 + t) for t in (1, 2, 3)] + [("b", 1, "SAFE", 90), ("b", 2, "SAFE", 90)] + [("c", t, None if t == 2 else "SAFE", None) for t in (1, 2, 3)]
    out = {r["id"]: (r["stable"], r["score_range"]) for r in evaluate.stability(spark.createDataFrame(rows, "id string, trial int, rating string, score int"), 3).collect()}
    assert out == {"a": (True, 2), "b": (False, 0), "c": (False, None)}


def test_accuracy_of_nothing(spark):
    known = spark.createDataFrame([("clean", []), ("blind", ["x"]), ("over", [])], "service string, known array<string>")
    seen = spark.createDataFrame([("over", ["y"])], "service string, detected array<string>")
    out = {r["service"]: (r["precision"], r["recall"]) for r in evaluate.accuracy_check(seen, known).collect()}
    assert out == {"clean": (1.0, 1.0), "blind": (0.0, 0.0), "over": (0.0, 1.0)}


def test_freshness(spark):
    df = spark.createDataFrame([(s, TS - dt.timedelta(seconds=s)) for s in (59, 60, 3599, 3600, 86399, 86400, 200000)], "s int, t timestamp")
    out = [r[0] for r in df.orderBy("s").select(history.freshness_label(F.col("t"), str(TS))).collect()]
    assert out == ["just now", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "2d ago"]


def test_ledger_follows_a_plain_loop(spark):
    rng = random.Random(5)
    events = [(rng.choice(["u", "v", None]), TS + dt.timedelta(minutes=rng.randrange(90_000)), i, rng.choice(["deduct"] * 5 + ["refund", None]), rng.choice([0, 20, 20, 20, 70, None])) for i in range(3000)]
    balances, expected = {}, {}
    for uid, ts, seq, kind, amount in sorted(events, key=lambda e: (e[1], e[2])):
        month = (uid, ts.strftime("%Y-%m"))
        now, amount = balances.get(month, 400), amount or 0
        ok = kind == "refund" or now >= amount
        balances[month] = now + amount if kind == "refund" else now - amount * ok
        expected[seq] = (ok, balances[month])
    df = spark.createDataFrame(events, "uid string, ts timestamp, seq long, kind string, amount int")
    assert {r["seq"]: (r["accepted"], r["balance"]) for r in history.credit_ledger(df).collect()} == expected


def test_changes_and_counts_follow_a_plain_loop(spark):
    rng = random.Random(6)
    schema = "scan_id long, url string, tier string, created_at timestamp, content_hash string, score int, rating string, tldr string"
    rows = [(i, rng.choice(["hot"] * 5 + ["b", None]), rng.choice(["quick", "deep"]), TS + dt.timedelta(minutes=rng.randrange(5000)), rng.choice(["x", "x", "y", None]), rng.randrange(100), "OKAY", "t") for i in range(2000)]
    last, counts, changes, numbers = {}, Counter(), set(), {}
    for scan_id, url, tier, _, content, score, *_ in sorted(rows, key=lambda r: (r[3], r[0])):
        old = last.get(url)
        if old and old[0] and content and old[0] != content:
            changes.add((scan_id, old[1], score))
        last[url] = (content, score)
        counts[url, tier] += 1
        numbers[scan_id] = counts[url, tier]
    df = spark.createDataFrame(rows, schema)
    assert {(r["scan_id"], r["old_score"], r["new_score"]) for r in history.policy_changes(df).collect()} == changes
    assert {r["scan_id"]: r["scan_count"] for r in history.scan_count(df).collect()} == numbers
    assert history.policy_changes(df.limit(0)).count() == 0


def test_lookup_follows_a_plain_search(spark):
    """Entries that hold equally long, and entries that an older one outlives; ties, nulls and requests without a time."""
    rng = random.Random(8)
    at = lambda m: TS + dt.timedelta(minutes=m)
    entries = [(rng.choice(["k"] * 6 + ["l", None]), rng.choice("xy"), at(m := rng.randrange(3000)), at(m + rng.choice([30, 30, 30, 600, 0]))) for _ in range(400)]
    requests = [(i, rng.choice(["k"] * 6 + ["l", None]), rng.choice(["x", "y", None]), at(rng.randrange(3200)) if i % 50 else None) for i in range(500)]
    want = {
        i: max((s for k, c, s, e in entries if k and ts and (k, c) == (key, content) and s <= ts < e), default=None)
        for i, key, content, ts in requests
    }
    cache = spark.createDataFrame(entries, "cache_key string, content_hash string, scanned_at timestamp, expires_at timestamp")
    asked = spark.createDataFrame(requests, "req_id long, cache_key string, content_hash string, req_ts timestamp")
    got = history.cache_lookup(asked, cache)
    assert got.columns == ["req_id", "cache_key", "content_hash", "req_ts", "scanned_at"]
    rows = got.collect()
    assert len(rows) == 500 and {r["req_id"]: r["scanned_at"] for r in rows} == want and sum(v is not None for v in want.values()) > 100
    assert history.cache_lookup(asked, cache.limit(0)).where("scanned_at IS NOT NULL").count() == 0


def test_alerts_over_restarts(spark, tmp_path):
    """Both streams are stopped and started again between files; each change is told to each watcher once."""
    rng = random.Random(12)
    rows = [(i, f"u{rng.randrange(3)}", TS + dt.timedelta(minutes=30 * i), rng.choice("ab"), i, "OKAY", "t") for i in range(60)]
    watches = spark.createDataFrame([("x", "u0"), ("x", "u0"), ("x", "u1"), ("y", "u1"), ("z", "none")], "uid string, url string")
    for k in range(4):
        spark.createDataFrame(rows[15 * k : 15 * k + 15], SCANS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        log = jobs.run_alerts(spark.readStream.schema(SCANS).parquet(f"{tmp_path}/in"), watches, str(tmp_path))
    changes = [r for r in history.policy_changes(spark.createDataFrame(rows, SCANS)).collect() if r["scan_id"] < 59]
    want = Counter(u for r in changes for u, url in {("x", "u0"), ("x", "u1"), ("y", "u1")} if url == r["url"])
    assert {r["uid"]: r["unread"] for r in jobs.unread(log.rows(spark)).collect()} == dict(want) and len(want) == 2


def test_alerts_are_counted_without_a_row_for_each_watcher(spark, tmp_path):
    """Many watchers of a url that changes often: what is stored follows changes and watches, and the counts are those of the rows."""
    schema = "scan_id long, url string, changed_at timestamp_ntz"
    watches = spark.createDataFrame([(f"u{i}", url) for i in range(50) for url in ("x", "quiet")] + [("late", "x")], "uid string, url string")
    alerts = jobs.Alerts(str(tmp_path / "log"))
    for n, who in ((0, watches.where("uid <> 'late'")), (1, watches), (1, watches)):  # the second batch is repeated
        changes = [(100 * n + i, "x", TS + dt.timedelta(hours=100 * n + i)) for i in range(40)]
        alerts.tell(spark.createDataFrame(changes, schema), who, n)
    stored = alerts.told.rows(spark).count() + alerts.watched.rows(spark).count()
    assert stored == 80 + 50 + 51
    got = {tuple(r) for r in alerts.unread(spark).collect()}
    assert got == {tuple(r) for r in jobs.unread(alerts.rows(spark)).collect()} and len(got) == 51
    assert {n for u, n, _ in got if u == "late"} == {40} and {n for u, n, _ in got if u == "u1"} == {80}


DOCS = "doc_id long, text string, lang string"


def some_documents(spark):
    return spark.createDataFrame([(n, f"Text {n}.  We share your data\n with a partner now and then." if n % 3 else None, "en") for n in range(24)], DOCS)


def test_streamed_scan_works_a_text_out_once(spark):
    """A filter that asks whether a document has findings would find them all before they are found."""
    node, kinds = jobs.stream_scan_pipeline(some_documents(spark))._jdf.queryExecution().optimizedPlan(), []
    while node:
        kinds.append(node.nodeName())
        node = node.children().head() if node.children().nonEmpty() else None
    assert "Generate" in kinds and "Filter" not in kinds


def test_streamed_texts_of_one_file_go_to_all_cores(spark, tmp_path):
    some_documents(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = jobs.read_stream(spark, str(tmp_path), "documents")
    assert rows._jdf.queryExecution().analyzed().nodeName() == "RepartitionByExpression"  # in turn, texts would be sorted first
    got = jobs.run_to_end(jobs.stream_scan_pipeline(rows))
    assert len(got.inputFiles()) == spark.sparkContext.defaultParallelism > 1
    want = jobs.stream_scan_pipeline(some_documents(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 24 * 6
    assert [(c.name, c.dataType) for c in got.schema] == [(c.name, c.dataType) for c in want.schema]
