"""Lifecycle state that expires by event time, on the RocksDB state store.

What a row does to a finding hangs on the rows before it and their event times,
never on the clock or on how the rows fall into batches: a sighting that comes
later than the keeping time after the last one starts the finding anew, whether
its timer has run by then or not. The timer only frees the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnish.streaming.jobs import BUCKETS, bucketed, names_of, told_of

COLUMNS = "repo string, finding_key string, state string, first_seen long, last_seen long, times_seen int, times_reintroduced int"
#: A list of (repo, finding_key, state, first_seen, last_seen, times_seen, times_reintroduced, told_ms) as JSON.
STATES = "states string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that this state needs, for streams that start inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def folded(now: tuple | None, rows: list[tuple[int, int, bool]], keep_ms: int | None) -> tuple | None:
    """State after rows (event ms, seq, seen) in their order; none as long as the finding was never seen."""
    for at, seq, seen in sorted(rows):
        if now is not None and keep_ms is not None and at - now[5] > keep_ms:
            now = None
        if now is None:
            now = ("open", seq, seq, 1, 0, at) if seen else None
        elif seq > now[2] and seen:
            now = ("open", now[1], seq, now[3] + 1, now[4] + (now[0] == "fixed"), max(at, now[5]))
        elif seq > now[2] and now[0] == "open":
            now = ("fixed", *now[1:5], max(at, now[5]))
        else:
            now = (*now[:5], max(at, now[5]))
    return now


class Lifecycle(StatefulProcessor):
    """States of the findings of a bucket, and a timer at the end of the shortest keeping time among them."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("findings", STATES)

    def read(self) -> dict[tuple, tuple]:
        return {(repo, finding): tuple(now) for repo, finding, *now in json.loads(self.kept.get()[0])} if self.kept.exists() else {}

    def write(self, states: dict[tuple, tuple]) -> None:
        if not states:
            self.kept.clear()
            return
        self.kept.update((json.dumps([(*k, *now) for k, now in states.items()]),))
        if self.keep_ms is not None:
            self.handle.registerTimer(min(now[5] for now in states.values()) + self.keep_ms + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = self.read()
        changed = {k: now for k, told in told_of(rows, "told_ms", "seq", "seen").items() if (now := folded(states.get(k), told, self.keep_ms)) is not None}
        if not changed:
            return
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.write(states | changed)
        yield pd.DataFrame([(*k, *now[:5]) for k, now in changed.items()], columns=names_of(COLUMNS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        self.write({k: now for k, now in self.read().items() if now[5] + self.keep_ms + 1 > now_ms})
        yield from ()

    def close(self) -> None:
        pass


def lifecycle(sightings: DataFrame, keep_days: float | None = None, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """State of findings from (repo, finding_key, seq, seen, ts), one row per scan and key: update mode, RocksDB.

    seen is false where a scan ran and did not find the key. With keep_days, a
    key of which no row tells for so long, by the rows' own time, is forgotten.
    Rows later than the watermark by `late` may be lost; within it, rows of one
    key are taken in order inside a batch. For `buckets` see `jobs.lifecycle`.
    """
    keep_ms = None if keep_days is None else int(keep_days * 86_400_000)
    rows = sightings.select("repo", "finding_key", "seq", "seen", "ts", F.unix_millis("ts").alias("told_ms")).withWatermark("ts", late)
    return bucketed(rows, buckets).transformWithStateInPandas(Lifecycle(keep_ms), COLUMNS, "update", "none" if keep_ms is None else "eventTime")
