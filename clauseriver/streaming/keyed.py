"""Streams with a state for each key: the last scan of a url, the balance of a user.

Rows of a key are taken in the order of event time, whatever batch brings them: a row waits in the key's state until
the watermark has passed it, and rows that come later than the watermark are dropped. A key that stays silent for `keep`
is forgotten by a timer. A key's state is its waiting rows (those of about the watermark's delay) and one record.

A call for a key asks the state store for little: rows wait in bunches, each a single value; new rows are added unread, and
a timer takes them once the watermark has passed.
"""

from __future__ import annotations

import datetime as dt
import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clauseriver.operators.history import MONTHLY_CREDITS

LATE = "10 minutes"
DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
#: Rows in one value of the state, and in one row of output.
BUNCH = 2000


class InOrder(StatefulProcessor):
    """Feeds a key's rows to step() by event time. Subclasses name the rows' columns, the record and the output, and take the steps.

    A row is a tuple: its time in milliseconds, its number (rows of a time go by it) and the other columns. It comes and waits
    as JSON, so that only what is ready is taken apart. Found rows are put out in bunches, an array for each column.
    """

    columns: list[str]  # of a row: its time and its number first
    record: str  # DDL of what is kept; at_ms first
    key: str  # DDL of the key
    found: dict[str, str]  # type of each column that is found

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def out(self) -> str:
        return ", ".join([self.key, *(f"{name} array<{kind}>" for name, kind in self.found.items())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "bunch string")
        self.kept = handle.getValueState("kept", f"{self.record}, until_ms long")

    def step(self, rows: list[tuple], kept: tuple | None) -> tuple[list[tuple], tuple]:
        """What the sorted rows give after the record, and the next record."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        mark, first = timerValues.getCurrentWatermarkInMs(), None
        while bunch := list(islice(rows, BUNCH)):
            least = min(r["at"] for r in bunch)
            first = least if first is None else min(first, least)
            self.waiting.appendValue((f"[{','.join([r['row'] for r in bunch])}]",))
        first = (first - EPOCH) // dt.timedelta(milliseconds=1)
        if first > mark:
            self.handle.registerTimer(first)
            return iter(())
        return self.advance(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        return self.advance(key, timerValues.getCurrentWatermarkInMs())

    def advance(self, key: tuple, mark: int) -> Iterator[Row]:
        rows = [tuple(r.values()) for (bunch,) in self.waiting.get() for r in json.loads(bunch)]
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1]))
        at = bisect_right(rows, mark, key=lambda r: r[0])
        ready, later = rows[:at], rows[at:]
        kept, found = self.kept.get(), []
        until = kept[-1] if kept else None  # the one timer by which the record may be forgotten
        if ready:
            found, record = self.step(ready, kept[:-1] if kept else None)
            kept = (*record, until)
            self.waiting.clear()
            for k in range(0, len(later), BUNCH):
                self.waiting.appendValue((json.dumps([dict(zip(self.columns, r, strict=True)) for r in later[k : k + BUNCH]]),))
        if later:
            self.handle.registerTimer(later[0][0])
        if kept is not None and (until is None or until <= mark):
            end = max(int(kept[0]) + self.keep_ms, later[0][0] if later else mark)
            if end > mark:
                self.handle.registerTimer(end)
                kept = (*kept[:-1], end)
                self.kept.update(kept)
            else:
                self.kept.clear()
        elif ready:
            self.kept.update(kept)
        names = [self.key.split()[0], *self.found]
        for k in range(0, len(found), BUNCH):
            yield Row(**dict(zip(names, (key[0], *map(list, zip(*found[k : k + BUNCH], strict=True))), strict=True)))

    def close(self) -> None:
        pass


class Changes(InOrder):
    """Scans whose content differs from the url's last one."""

    columns = ["at_ms", "scan_id", "content_hash", "score", "rating", "tldr"]
    record = "at_ms long, content_hash string, score int"
    key = "url string"
    found = {"scan_id": "long", "old_score": "int", "new_score": "int", "rating": "string", "tldr": "string", "at_ms": "long"}

    def step(self, rows, kept):
        found = []
        _, old_hash, old_score = kept or (None, None, None)
        for at_ms, scan_id, content_hash, score, rating, tldr in rows:
            if old_hash is not None and content_hash is not None and old_hash != content_hash:
                found.append((scan_id, old_score, score, rating, tldr, at_ms))
            old_hash, old_score = content_hash, score
        return found, (rows[-1][0], old_hash, old_score)


class Credits(InOrder):
    """Balances: a month begins with `monthly`, a deduction beyond the balance is rejected, a refund adds."""

    columns = ["at_ms", "seq", "kind", "amount", "month"]
    record = "at_ms long, month string, balance long"
    key = "uid string"
    found = {"month": "string", "seq": "long", "accepted": "boolean", "balance": "int"}

    def __init__(self, keep_ms: int, monthly: int):
        super().__init__(keep_ms)
        self.monthly = monthly

    def step(self, rows, kept):
        found = []
        _, month, balance = kept or (None, None, 0)
        for _, seq, kind, amount, own in rows:
            if own != month:
                month, balance = own, self.monthly
            ok = kind == "refund" or balance >= amount
            if ok:
                balance += amount if kind == "refund" else -amount
            found.append((month, seq, ok, balance))
        return found, (rows[-1][0], month, balance)


def _stateful(rows: DataFrame, key: str, at: str, late: str, processor: InOrder) -> DataFrame:
    """What the processor finds for each key, a row each."""
    timed = rows.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    row = F.to_json(F.struct(*processor.columns), {"ignoreNullFields": "false"}).alias("row")
    grouped = timed.select(key, "at", row).groupBy(key)
    bunches = grouped.transformWithState(statefulProcessor=processor, outputStructType=processor.out(), outputMode="Append", timeMode="EventTime")
    return bunches.select(key, F.inline(F.arrays_zip(*processor.found)))


def stream_policy_changes(scans: DataFrame, late: str = LATE, keep_days: int = 365) -> DataFrame:
    """A row for each scan whose content differs from the one before of its url, with its time; rows without a time don't take part."""
    rows = scans.where("created_at IS NOT NULL").select("url", "scan_id", "created_at", "content_hash", F.col("score").cast("int").alias("score"), "rating", "tldr")
    found = _stateful(rows, "url", "created_at", late, Changes(keep_days * DAY_MS))
    return found.withColumn("changed_at", F.timestamp_millis("at_ms").cast("timestamp_ntz")).drop("at_ms")


def stream_credits(events: DataFrame, monthly: int = MONTHLY_CREDITS, late: str = LATE, keep_days: int = 32) -> DataFrame:
    """events (uid, ts, seq, kind deduct or refund, amount) with accepted and balance; the twin of history.credit_ledger.

    Months are those of the session's time zone. A user who is silent for keep_days is forgotten: over a month, so that what
    is forgotten would begin anew anyway.
    """
    rows = events.where("ts IS NOT NULL").select(
        "uid", "ts", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("deduct")).alias("kind"),
        F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"), F.date_format("ts", "yyyy-MM").alias("month"),
    )
    return _stateful(rows, "uid", "ts", late, Credits(keep_days * DAY_MS, monthly))


def with_rocks(spark: SparkSession, run):
    """run() with the state store that keyed state needs; the session's own one is set again after it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
