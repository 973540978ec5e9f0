"""Structured Streaming forms: filters, counters, keyed state, dedup, ingest.

Event times must be TIMESTAMP; the tables' TIMESTAMP_NTZ is cast at the read.
Late rows up to the watermark count, later ones are dropped.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIFECYCLE = "repo string, finding_key string, state string, first_seen long, last_seen long, times_seen int, times_reintroduced int"
LIFECYCLE_STATE = "state string, first_seen long, last_seen long, times_seen int, times_reintroduced int"
#: Parts of the state of a stream of findings.
BUCKETS = 1024


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a folder of Parquet files as they come, event time as TIMESTAMP."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def read_uploads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of a folder; counters that are missing become zero, malformed records are dropped."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.fillna(0)


def allowed_webhooks(events: DataFrame, repos: DataFrame) -> DataFrame:
    """Events of repositories that have webhooks on and a plan that allows them: stream-static join."""
    return events.join(repos.where("webhook_enabled and plan_allows").select("repo"), "repo", "left_semi")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 day", by: str = "event_type") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are remembered as long as the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def presence(events: DataFrame, interval: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """At most one row per user and interval."""
    slots = events.withColumn("slot", F.window("ts", interval)["start"])
    return slots.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "slot"]).select("user_id", "slot")


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts of reports per key: update mode."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("report_count"), F.min("ts").alias("first_reported_at"), F.max("ts").alias("last_reported_at"))


def advanced(now: list | None, told: Iterable[tuple[int, bool]]) -> list | None:
    """State of a finding after what scans (seq, seen) tell of it; none as long as it was never seen."""
    now = ["", -1, -1, 0, 0] if now is None else list(now)
    for seq, seen in sorted({(int(s), bool(x)) for s, x in told}):
        if seen and seq > now[2]:
            now[4] += now[0] == "fixed"
            now = ["open", seq if now[1] < 0 else now[1], seq, now[3] + 1, now[4]]
        elif not seen and now[0] == "open" and seq > now[2]:
            now[0] = "fixed"
    return now if now[1] >= 0 else None


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches))
    if keep_ms is not None:
        state.setTimeoutDuration(keep_ms)
    now = advanced(state.get if state.exists else None, zip(rows["seq"].tolist(), rows["seen"].tolist(), strict=True))
    if now is None:
        return
    state.update(tuple(now))
    yield pd.DataFrame([(*key, *now)], columns=names_of(LIFECYCLE))


def told_of(batches: Iterator[pd.DataFrame], *columns: str) -> dict[tuple, list[tuple]]:
    """What the rows of a bucket tell of each (repo, finding_key)."""
    told: dict[tuple, list[tuple]] = {}
    for rows in batches:
        for repo, finding, *x in zip(*[rows[c].tolist() for c in ("repo", "finding_key", *columns)], strict=True):
            told.setdefault((repo, finding), []).append(tuple(x))
    return told


def _fold_bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = {(repo, finding): now for repo, finding, *now in json.loads(state.get[0])} if state.exists else {}
    changed = {k: now for k, told in told_of(batches, "seq", "seen").items() if (now := advanced(kept.get(k), told)) is not None}
    if changed:
        state.update((json.dumps([(*k, *now) for k, now in (kept | changed).items()]),))
        yield pd.DataFrame([(*k, *now) for k, now in changed.items()], columns=names_of(LIFECYCLE))


def bucketed(sightings: DataFrame, buckets: int) -> GroupedData:
    """Sightings grouped by a bucket of their keys: calls of Python and of the state store are then one a bucket, not one a finding."""
    return sightings.withColumn("_bucket", F.pmod(F.xxhash64("repo", "finding_key"), F.lit(buckets)).cast("int")).groupBy("_bucket")


def lifecycle(sightings: DataFrame, keep_days: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """State of findings from (repo, finding_key, seq, seen), one row per scan and key: keyed state, update mode.

    seen is false where a scan ran and did not find the key. States are kept in
    `buckets` of keys; a batch rewrites those of its keys, so one should hold
    some thousands, and their number stays as a checkpoint began. With
    keep_days, a key that no scan has told of for so long, by the clock, is
    forgotten, so that state does not grow for ever; if it comes back, it counts
    as new. Each key then has its own timeout and so its own state, which costs
    some milliseconds a key and batch.
    """
    sightings = sightings.select("repo", "finding_key", "seq", "seen")
    if keep_days is None:
        return bucketed(sightings, buckets).applyInPandasWithState(_fold_bucket, LIFECYCLE, "states string", "update", GroupStateTimeout.NoTimeout)
    fold = functools.partial(_fold, keep_ms=max(1, int(keep_days * 86_400_000)))
    return sightings.groupBy("repo", "finding_key").applyInPandasWithState(fold, LIFECYCLE, LIFECYCLE_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_into(merge: Callable[[DataFrame | None, DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch into the snapshots at `path`; a batch that is run again changes nothing twice."""
    from tarnish.sources.sinks import read_state, write_state

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, path)
        done = -1 if state is None else state.agg(F.max("_epoch")).first()[0]
        if done is not None and epoch <= done:
            return
        merged = merge(None if state is None else state.drop("_epoch"), batch)
        write_state(merged.withColumn("_epoch", F.lit(epoch).cast("long")), path)

    return run


def drain(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now into Parquet at `path`, and reads that: nothing passes the driver.

    In complete mode the rows are those of the last batch. In update mode they
    are all that were given out, with the number of their `batch`.
    """
    spark, out = stream.sparkSession, stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    out.foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(path)
    return rows if mode == "update" else rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
