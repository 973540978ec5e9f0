"""Findings over successive scans: reconciliation, replay, deltas and small state machines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnish.functions.scalar import identity_key

STATE = "repo string, finding_key string, kind string, state string, first_seen long, last_seen long, fixed_at long, reintroduced_at long, times_seen int, times_reintroduced int, note string"


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], STATE)


def reconcile(state: DataFrame, found: DataFrame, scan: int) -> DataFrame:
    """State after one scan, and `event` for this scan: new, reintroduced, persisting, resolved or null.

    found: (repo, finding_key, kind), repeats count once. A fixed finding that
    is there again reopens; an open one that isn't is fixed; what people have
    set (ignored, acknowledged) stays. Repositories that weren't scanned keep
    their state.
    """
    seen = found.dropDuplicates(["repo", "finding_key"]).select("repo", "finding_key", F.col("kind").alias("_kind"), F.lit(True).alias("_seen"))
    scanned = found.select("repo").distinct().withColumn("_scanned", F.lit(True))
    both = state.join(seen, ["repo", "finding_key"], "full").join(scanned, "repo", "left")
    new, there = F.col("state").isNull(), F.col("_seen").isNotNull()
    again, gone = there & (F.col("state") == "fixed"), ~there & (F.col("state") == "open") & F.col("_scanned").isNotNull()
    event = F.when(new, "new").when(again, "reintroduced").when(there, "persisting").when(gone, "resolved")
    now = F.lit(scan).cast("long")
    columns = {
        "kind": F.coalesce("_kind", "kind"), "state": F.when(new | again, "open").when(gone, "fixed").otherwise(F.col("state")), "first_seen": F.coalesce("first_seen", now),
        "last_seen": F.when(there, now).otherwise(F.col("last_seen")), "fixed_at": F.when(gone, now).when(again, None).otherwise(F.col("fixed_at")),
        "reintroduced_at": F.when(again, now).otherwise(F.col("reintroduced_at")), "times_seen": F.coalesce("times_seen", F.lit(0)) + there.cast("int"),
        "times_reintroduced": F.coalesce("times_reintroduced", F.lit(0)) + F.coalesce(again.cast("int"), F.lit(0)), "note": F.col("note"),
    }
    return both.select("repo", "finding_key", *[e.alias(n) for n, e in columns.items()], event.alias("event"))


def identities(dependencies: DataFrame, dead_code: DataFrame, secrets: DataFrame, agent: DataFrame) -> DataFrame:
    """(repo, kind, finding_key, title, location): what a scan found, of four kinds, each once; for `reconcile`.

    dependencies: (repo, ecosystem, name, status), healthy ones are no finding;
    dead_code: (repo, path, name); secrets, those of the history included:
    (repo, fingerprint, provider, path); agent: (repo, path, rule). Of what
    shares a key, the first by title stays.
    """
    say = lambda *parts: F.concat(*[F.lit(p) if p.startswith(" ") or p in "()" else F.col(p) for p in parts])
    row = lambda df, kind, key, title, location: df.select("repo", F.lit(kind).alias("kind"), identity_key(F.lit(kind), *key).alias("finding_key"), title.alias("title"), location.alias("location"))
    every = [
        row(dependencies.where("status <> 'healthy'"), "dependency", ["ecosystem", "name", "status"], say("name", " (", "status", ")"), F.lit(None).cast("string")),
        row(dead_code, "dead_code", ["path", "name"], say("name", " in ", "path"), F.col("path")), row(secrets, "secret", ["fingerprint"], say("provider", " in ", "path"), F.col("path")),
        row(agent, "agent_config", ["path", "rule"], say("rule", " in ", "path"), F.col("path")),
    ]
    first = F.min(F.struct("title", "location")).alias("_first")
    return reduce(DataFrame.unionByName, every).groupBy("repo", "kind", "finding_key").agg(first).select("repo", "kind", "finding_key", "_first.*")


def transition(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """State after people's decisions (repo, finding_key, to_state, note); a null note keeps the old one."""
    d = decisions.select("repo", "finding_key", "to_state", F.col("note").alias("_note")).where(F.col("to_state").isin("open", "ignored", "acknowledged"))
    out = state.join(d, ["repo", "finding_key"], "left")
    return out.withColumns({"state": F.coalesce("to_state", "state"), "note": F.coalesce("_note", "note")}).select(*state.columns)


def delta(reconciled: DataFrame) -> DataFrame:
    """Per repo and kind: new, resolved, reintroduced and persisting findings of the scan, and those open after it."""
    count = lambda e: F.count_if(F.col("event") == e).alias(e)
    return reconciled.groupBy("repo", "kind").agg(*[count(e) for e in ("new", "resolved", "reintroduced", "persisting")], F.count_if(F.col("state") == "open").alias("open_total"))


def replay(found: DataFrame, scans: DataFrame) -> DataFrame:
    """State after all scans, without decisions by people: one pass, no loop over scans.

    found: (repo, finding_key, seq); scans: (repo, seq), seq without gaps. A key
    that was away for a scan was fixed at the first it missed.
    """
    seen = found.select("repo", "finding_key", "seq").distinct()
    before = F.lag("seq").over(Window.partitionBy("repo", "finding_key").orderBy("seq"))
    last = scans.groupBy("repo").agg(F.max("seq").alias("_last"))
    per = seen.withColumn("_before", before).groupBy("repo", "finding_key").agg(
        F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"), F.count(F.lit(1)).alias("times_seen"), F.count_if(F.col("seq") > F.col("_before") + 1).alias("times_reintroduced"))
    open_ = F.col("last_seen") == F.col("_last")
    return per.join(last, "repo").select("repo", "finding_key", "first_seen", "last_seen", "times_seen", "times_reintroduced",
        F.when(open_, "open").otherwise("fixed").alias("state"), F.when(~open_, F.col("last_seen") + 1).alias("fixed_at"))


def one_per_request(entries: DataFrame) -> DataFrame:
    """One log entry per request: a semantic one before the generic one."""
    order = F.struct(F.when(F.col("generic"), 1).otherwise(0).alias("g"), F.col("id"))
    rest = [c for c in entries.columns if c != "request_id"]
    return entries.groupBy("request_id").agg(F.min_by(F.struct(*rest), order).alias("_e")).select("request_id", "_e.*")


def throttled(events: DataFrame, key: str, at: str, seconds: int = 120) -> DataFrame:
    """First event of each key in each interval: presence written at most once an interval."""
    bucket = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)).alias("bucket")
    return events.groupBy(key, bucket).agg(F.min(at).alias("first_at"))


def scan_status(steps: DataFrame) -> DataFrame:
    """Status of each scan: that of its latest step; an ended scan stays ended."""
    order = F.struct(F.when(F.col("status").isin("complete", "failed"), 1).otherwise(0).alias("ended"), F.col("at"))
    return steps.groupBy("scan").agg(F.max_by("status", order).alias("status"), F.max("at").alias("at"))
