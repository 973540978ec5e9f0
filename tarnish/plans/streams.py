"""Streaming jobs run to the end of what is there: results of their final state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnish.operators import relational as R
from tarnish.plans.analysis import SCANS, scan_findings
from tarnish.plans.registry import query
from tarnish.plans.standins import table, with_views
from tarnish.session import shared_dir
from tarnish.streaming import ingress, jobs, timed_state
from tarnish.streaming.store import BucketStore, into


def events_stream(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def result(stream, mode):
    spark = stream.sparkSession
    return jobs.drain(stream, shared_dir(spark, "stream-result"), mode, shared_dir(spark, "stream"))


@query("stream_daily_counts", """WITH w AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, n FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_daily_counts(spark, d):
    return result(jobs.windowed_counts(events_stream(spark, d)), "append").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("stream_counters", "SELECT event_type, count(*) AS report_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1")
def stream_counters(spark, d):
    at = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return result(jobs.counters(events_stream(spark, d), ["event_type"]), "complete").select("event_type", "report_count", at("first_reported_at", "first_at"), at("last_reported_at", "last_at"))


@query("stream_first_of_key", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_of_key(spark, d):
    return result(jobs.first_of_key(events_stream(spark, d), ["user_id", "event_type"], "60 days"), "append").select("user_id", "event_type")


@query("stream_webhooks", "SELECT event_id FROM events WHERE user_id % 3 = 0 AND user_id % 2 = 0")
def stream_webhooks(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), (F.col("c_custkey") % 3 == 0).alias("webhook_enabled"), (F.col("c_custkey") % 2 == 0).alias("plan_allows"))
    return result(jobs.allowed_webhooks(events_stream(spark, d).withColumnRenamed("user_id", "repo"), users), "append").select("event_id")


@query("stream_presence", "SELECT DISTINCT user_id, floor(epoch(ts) / 120)::BIGINT AS slot FROM events")
def stream_presence(spark, d):
    return result(jobs.presence(events_stream(spark, d), late="60 days"), "append").select("user_id", F.floor(F.unix_timestamp("slot") / 120).alias("slot"))


def told(spark, d):
    """(repo, finding_key, seq, seen): what each scan reports, and the first scan that no longer does."""
    found = scan_findings(spark, d).select("repo", "finding_key", "seq")
    last = found.agg(F.max("seq")).first()[0] or 0
    after = F.lead("seq").over(Window.partitionBy("repo", "finding_key").orderBy("seq"))
    missed = (F.col("seq") < last) & (F.coalesce(after, F.lit(last + 1)) > F.col("seq") + 1)
    marks = F.array(F.struct("seq", F.lit(True).alias("seen")), F.when(missed, F.struct((F.col("seq") + 1).alias("seq"), F.lit(False).alias("seen"))))
    return found.withColumn("_told", F.array_compact(marks)).select("repo", "finding_key", F.inline("_told"))


@query("stream_lifecycle", with_views(f"""
    WITH {SCANS}, l AS (SELECT max(seq) AS last FROM f), g AS (SELECT *, lag(seq) OVER (PARTITION BY repo, finding_key ORDER BY seq) AS before FROM f)
    SELECT repo, finding_key, CASE WHEN max(seq) = last THEN 'open' ELSE 'fixed' END AS state, min(seq) AS first_seen, max(seq) AS last_seen, count(*) AS times_seen,
        count(*) FILTER (seq > before + 1) AS times_reintroduced FROM g, l GROUP BY repo, finding_key, last""", "log"))
def stream_lifecycle(spark, d):
    sightings = told(spark, d)
    path = shared_dir(spark, "sightings")
    sightings.write.parquet(path)
    stream = spark.readStream.schema(sightings.schema).parquet(path)
    return R.last_per(result(jobs.lifecycle(stream), "update"), ["repo", "finding_key"], ["batch"]).drop("batch")


#: Rows of a file that a stream takes up.
FILE_ROWS = 100_000


def laid(rows, by, parts, path):
    """The rows as files of a folder, in the order of `by`, so many files to each of the parts; a stream that takes that many at a time sees the parts one by one.

    Returns the number of files. No part has fewer rows than that, unless it is one.
    """
    low, high = rows.agg(F.min(by), F.max(by)).first()
    step = ((high - low) // parts + 1) if high is not None else 1
    within = lambda k: (F.col(by) >= F.lit(low or 0) + k * step) & (F.col(by) < F.lit(low or 0) + (k + 1) * step)
    files = max(1, min(rows.agg(*[F.count_if(within(k)) for k in range(parts)]).first()) // FILE_ROWS)
    for k in range(parts):
        part = rows.where(within(k))
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return files


@query("stream_store", """SELECT user_id, event_type, count(*) AS report_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY ALL""")
def stream_store(spark, d):
    """Counters of users and kinds of events, merged batch by batch into buckets."""
    keys, root = ["user_id", "event_type"], shared_dir(spark, "store")
    events = table(spark, d, "events").select(*keys, F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(4, "ts").write.parquet(f"{root}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    store = BucketStore(spark, f"{root}/state", "user_id long, event_type string, report_count long, first_reported_at timestamp, last_reported_at timestamp", keys, 16)
    merge = lambda old, batch: R.merge_counter(old, R.upsert_counter(batch, keys, "ts"), keys)
    stream.writeStream.foreachBatch(into(store, merge)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    at = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return store.read().select(*keys, "report_count", at("first_reported_at", "first_at"), at("last_reported_at", "last_at"))


@query("stream_ingress", """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN repeat(p_name, 40) WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 11 = 0 THEN 'cargo' WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem FROM part),
    j AS (SELECT *, '{"name":"' || name || '","ecosystem":"' || ecosystem || '","k":' || k || '}' AS raw FROM r),
    c AS (SELECT *, CASE WHEN k % 7 = 0 THEN ['not an object of the schema'] ELSE list_filter([CASE WHEN length(name) NOT BETWEEN 1 AND 214 THEN 'name: 1 to 214 characters' END, CASE WHEN ecosystem = 'cargo' THEN 'ecosystem: npm or pypi' END], lambda x: x IS NOT NULL) END AS reasons FROM j)
    SELECT CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'quarantined' END AS went, CASE WHEN len(reasons) = 0 THEN name || '/' || ecosystem WHEN k % 7 = 0 THEN left(raw, length(raw) - 3) ELSE raw END AS what, reasons FROM c""")
def stream_ingress(spark, d):
    """Reports of unknown packages as JSON lines, some cut short, some against the rules."""
    k, root = F.col("p_partkey"), shared_dir(spark, "ingress")
    name = F.when(k % 13 == 0, F.expr("repeat(p_name, 40)")).when(k % 17 == 0, "").otherwise(F.col("p_name"))
    ecosystem = F.when(k % 11 == 0, "cargo").when(k % 2 == 0, "npm").otherwise("pypi")
    raw = F.to_json(F.struct(name.alias("name"), ecosystem.alias("ecosystem"), k.alias("k")))
    whole = table(spark, d, "part").select(raw.alias("value"), k.alias("k"))
    whole.select(F.when(F.col("k") % 7 == 0, F.expr("left(value, length(value) - 3)")).otherwise(F.col("value")).alias("value")).repartition(4).write.text(f"{root}/in")
    lines = ingress.read_lines(spark, f"{root}/in", files_per_batch=2, glob="part-*")
    accepted, quarantined = ingress.ingest(lines, ingress.PHANTOM_REPORT, ingress.PHANTOM_CHECKS, f"{root}/out", f"{root}/checkpoint")
    none = F.array().cast("array<string>").alias("reasons")
    good = accepted.select(F.lit("accepted").alias("went"), F.concat("name", F.lit("/"), "ecosystem").alias("what"), none)
    return good.unionByName(quarantined.select(F.lit("quarantined").alias("went"), F.col("raw").alias("what"), "reasons"))


#: Scans come a day apart; a finding of which none tells for so many days is forgotten.
KEPT_DAYS = 3


@query("stream_lifecycle_timed", with_views(f"""
    WITH {SCANS}, l AS (SELECT max(seq) AS last FROM f), g AS (SELECT *, lag(seq) OVER w AS before, lead(seq) OVER w AS after FROM f WINDOW w AS (PARTITION BY repo, finding_key ORDER BY seq)),
    told AS (SELECT repo, finding_key, seq, true AS seen FROM g UNION ALL SELECT repo, finding_key, seq + 1, false FROM g, l WHERE seq < last AND coalesce(after, last + 1) > seq + 1),
    s AS (SELECT *, lag(seq) OVER (PARTITION BY repo, finding_key ORDER BY seq) AS told_before FROM told),
    i AS (SELECT *, sum(CASE WHEN seq - told_before > {KEPT_DAYS} THEN 1 ELSE 0 END) OVER (PARTITION BY repo, finding_key ORDER BY seq) AS island FROM s),
    n AS (SELECT *, max(island) OVER (PARTITION BY repo, finding_key) AS newest, lag(seq) OVER (PARTITION BY repo, finding_key, island, seen ORDER BY seq) AS seen_before FROM i)
    SELECT repo, finding_key, CASE WHEN arg_max(seen, seq) THEN 'open' ELSE 'fixed' END AS state, min(seq) FILTER (seen) AS first_seen, max(seq) FILTER (seen) AS last_seen, count(*) FILTER (seen) AS times_seen,
        count(*) FILTER (seen AND seq > seen_before + 1) AS times_reintroduced FROM n WHERE island = newest GROUP BY repo, finding_key""", "log"))
def stream_lifecycle_timed(spark, d):
    sightings = told(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 86_400))
    once, path = shared_dir(spark, "timed-told"), shared_dir(spark, "timed-sightings")
    sightings.write.parquet(once)
    files = laid(spark.read.schema(sightings.schema).parquet(once), "seq", 3, path)
    stream = spark.readStream.schema(sightings.schema).option("maxFilesPerTrigger", files).parquet(path)
    with timed_state.rocksdb(spark):
        return R.last_per(result(timed_state.lifecycle(stream, KEPT_DAYS), "update"), ["repo", "finding_key"], ["batch"]).drop("batch")
