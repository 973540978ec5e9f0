"""Keyed store, ingress with quarantine, and state by event time."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tarnish.operators import relational
from tarnish.plans import streams
from tarnish.streaming import ingress, jobs, timed_state
from tarnish.streaming.store import BucketStore, into

KEYS = ["name"]
F_BASE = 1_700_000_000_000


def merge(old, batch):
    return relational.merge_counter(old, relational.upsert_counter(batch, KEYS, "at"), KEYS)


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, f"{tmp_path}/state", "name string, report_count long, first_reported_at long, last_reported_at long", KEYS, 8)


def files(store):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(store.path) for n in names if n.endswith(".parquet")}


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, at long")


def counts(store):
    return {r["name"]: r["report_count"] for r in store.read().collect()}


def test_only_touched_buckets_are_written(spark, store):
    assert store.read().count() == 0
    many = [(f"k{k}", k) for k in range(200)]
    assert store.merge(batch(spark, *many), 0, merge) == list(range(8))
    before = files(store)
    touched = store.merge(batch(spark, ("k5", 900), ("k5", 901)), 1, merge)
    after = files(store)
    assert len(touched) == 1 and before.items() <= after.items()
    assert {f.split("_bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(touched[0])}
    assert counts(store) == {f"k{k}": 1 + 2 * (k == 5) for k in range(200)}
    store.merge(batch(spark, ("new", 1)), 2, merge)
    store.vacuum(keep=1)
    assert len(files(store)) == 8 and len(counts(store)) == 201
    assert {r["name"] for r in store.read(touched).collect()} < counts(store).keys()


def test_batches_count_once_and_half_written_ones_not_at_all(spark, store):
    run = into(store, merge)
    for epoch in (0, 0, 1):
        run(batch(spark, ("a", 1), ("a", 2), ("b", 3)), epoch)
    assert counts(store) == {"a": 4, "b": 2}

    def broken(old, new):
        return merge(old, new).withColumn("report_count", F.when(F.col("name") == "b", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("report_count")))

    with pytest.raises(Exception, match="lost"):
        store.merge(batch(spark, ("a", 5), ("b", 6)), 2, broken)
    # What a task wrote before the job failed is not read, and the next try replaces it.
    store.read([]).write.mode("append").parquet(f"{store.path}/_bucket=0/_epoch=2")
    assert counts(store) == {"a": 4, "b": 2}
    store.merge(batch(spark, ("a", 5), ("b", 6)), 2, merge)
    assert counts(store) == {"a": 5, "b": 3}
    store.merge(batch(spark), 3, merge)
    assert counts(store) == {"a": 5, "b": 3} and store.epochs() == [0, 1, 2, 3]


def test_old_values_and_deletions_through_the_store(spark, tmp_path):
    rows = "id long, a string, b string"
    store = BucketStore(spark, f"{tmp_path}/kept", rows, ["id"], 4)
    give = lambda *r: spark.createDataFrame(list(r), rows)
    store.merge(give((1, "x", None), (2, "y", "z")), 0, lambda old, new: relational.upsert_keep_old(old, new, ["id"]))
    store.merge(give((1, None, "w"), (3, "n", None)), 1, lambda old, new: relational.upsert_keep_old(old, new, ["id"]))
    store.merge(give((2, "gone", None)), 2, lambda old, new: old.join(new, "id", "left_anti"))
    assert {tuple(r) for r in store.read().collect()} == {(1, "x", "w"), (3, "n", None)}


LINES = [
    ('{"name": "left-pad", "ecosystem": "npm"}', []), ('{"name": "", "ecosystem": "npm"}', ["name: 1 to 214 characters"]), ('{"name": "x", "ecosystem": "cargo", "more": [1]}', ["ecosystem: npm or pypi"]),
    ('{"ecosystem": "npm"}', ["name: 1 to 214 characters"]), ("not json", ["not an object of the schema"]), ("", ["not an object of the schema"]), ("[]", ["not an object of the schema"]), ("null", ["not an object of the schema"]),
    ('{"name": {"a": 1}, "ecosystem": 5}', None), (json.dumps({"name": "n" * 214, "ecosystem": "pypi"}), []), (json.dumps({"name": "n" * 215, "ecosystem": "x"}), ["name: 1 to 214 characters", "ecosystem: npm or pypi"]), ("{}", None), ('{"name": "cut', ["not an object of the schema"]),
]


def test_every_line_received_is_accepted_or_quarantined(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingress.ingest(ingress.read_lines(spark, f"{tmp_path}/in", files_per_batch=1), ingress.PHANTOM_REPORT, ingress.PHANTOM_CHECKS, f"{tmp_path}/out", f"{tmp_path}/cp")
    for k, part in enumerate((LINES[:5], LINES[5:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(x for x, _ in part) + "\n")
        accepted, quarantined = run()
    assert accepted.count() + quarantined.count() == len(LINES)
    assert sorted(len(r["name"]) for r in accepted.collect()) == [8, 214]
    held = {r["raw"]: r["reasons"] for r in quarantined.collect()}
    for line, reasons in LINES:
        assert (line in held) == (reasons != []) and (not reasons or held[line] == reasons), line
    assert all(r["file"].endswith(".json") and r["modified"] is not None for r in quarantined.collect())
    again, _ = run()
    assert again.count() == 2  # offsets are kept: nothing comes twice


DAY = 86_400_000


def test_state_hangs_on_the_rows_times_however_they_are_cut():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(k * DAY, k, rng.random() < 0.5) for k in sorted(rng.sample(range(30), 12))]
        whole = timed_state.folded(None, rows, 3 * DAY)
        cut = None
        for n in itertools.batched(rows, rng.randint(1, 5)):
            cut = timed_state.folded(cut, list(n), 3 * DAY)
        assert cut == whole
    assert timed_state.folded(None, [(0, 0, False)], None) is None
    assert timed_state.folded(None, [(0, 0, True), (4 * DAY, 4, True)], 3 * DAY)[1:4] == (4, 4, 1)
    assert timed_state.folded(None, [(0, 0, True), (4 * DAY, 4, True)], None)[1:4] == (0, 4, 2)
    assert timed_state.folded(None, [(0, 0, True), (DAY, 1, False), (2 * DAY, 2, True)], 3 * DAY)[:5] == ("open", 0, 2, 2, 1)


def run_timed(spark, tmp_path, name, batches):
    for rows in batches:
        frame = spark.createDataFrame(rows, "repo string, finding_key string, seq long, seen boolean, at long")
        frame.withColumn("ts", F.timestamp_millis(F.col("at") + 1_700_000_000_000)).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    stream = spark.readStream.schema("repo string, finding_key string, seq long, seen boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
    with timed_state.rocksdb(spark):
        out = jobs.drain(timed_state.lifecycle(stream, 3, "1 hour"), f"{tmp_path}/{name}/out", "update", f"{tmp_path}/{name}/cp")
    return {tuple(r)[1:] for r in relational.last_per(out, ["repo", "finding_key"], ["batch"]).drop("batch").collect()}


def test_replayed_data_give_the_same_state_whatever_the_batches(spark, tmp_path):
    rows = [("r", key, k, seen, k * DAY) for key, seq in {"a": [(0, 1), (1, 1), (9, 1), (10, 0)], "b": [(0, 1), (2, 0), (4, 1)], "c": [(3, 0)], "z": [(12, 1)]}.items() for k, seen in [(k, bool(s)) for k, s in seq]]
    rows.sort(key=lambda r: r[2])
    want = {("a", "fixed", 9, 9, 1, 0), ("b", "open", 0, 4, 2, 1), ("z", "open", 12, 12, 1, 0)}
    assert run_timed(spark, tmp_path, "one", [rows]) == want
    assert run_timed(spark, tmp_path, "many", [rows[k : k + 2] for k in range(0, len(rows), 2)]) == want


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    first, late = [("r", "a", 5, True, 5 * DAY), ("r", "b", 6, True, 6 * DAY)], [("r", "a", 4, False, 4 * DAY), ("r", "n", 4, True, 4 * DAY), ("r", "b", 7, False, 7 * DAY)]
    assert run_timed(spark, tmp_path, "late", [first, first[1:], late]) == {("a", "open", 5, 5, 1, 0), ("b", "fixed", 6, 6, 1, 0)}


def test_states_of_findings_share_buckets(spark, tmp_path):
    """Two batches of 40 findings: what is kept is a row a bucket, and the states carry over."""
    schema = "repo string, finding_key string, seq long, seen boolean"
    for told in ([(k, 0, True) for k in range(40)], [(k, 1, False) for k in range(20)] + [(k, 1, True) for k in range(20, 40)], [(k, 2, True) for k in range(10)]):
        rows = [("r" if k else None, f"k{k}", seq, seen) for k, seq, seen in told]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = jobs.lifecycle(stream, buckets=4).writeStream.outputMode("update").format("memory").queryName("shared_buckets").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    got = {r["finding_key"]: tuple(r)[2:] for r in sorted(spark.table("shared_buckets").collect(), key=lambda r: (r["last_seen"], r["state"] == "fixed"))}
    assert got == {f"k{k}": ("open", 0, 2, 2, 1) if k < 10 else ("fixed", 0, 0, 1, 0) if k < 20 else ("open", 0, 1, 2, 0) for k in range(40)}


def test_a_bucket_forgets_only_what_is_due(spark, tmp_path):
    at = lambda key, k, seen: ("r", key, k, seen, F_BASE + k * DAY)
    schema = "repo string, finding_key string, seq long, seen boolean, at long"
    for rows in ([at("a", 0, True), at("b", 0, True)], [at("b", 2, True)], [at("b", 5, False)], [at("a", 6, True), at("b", 6, True)]):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("repo string, finding_key string, seq long, seen boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with timed_state.rocksdb(spark):
        out = jobs.drain(timed_state.lifecycle(stream, 3, "1 hour", buckets=1), f"{tmp_path}/out", "update", f"{tmp_path}/cp")
    assert {tuple(r)[1:] for r in relational.last_per(out, ["repo", "finding_key"], ["batch"]).drop("batch").collect()} == {("a", "open", 6, 6, 1, 0), ("b", "open", 0, 6, 3, 1)}


def test_parts_of_a_stream_lie_in_equally_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    rows = spark.range(100).select(F.floor(F.col("id") / 34).alias("seq"), "id").repartition(3)
    files = streams.laid(rows, "seq", 3, f"{tmp_path}/in")
    names = sorted((os.stat(f"{tmp_path}/in/{n}").st_mtime_ns, n) for n in os.listdir(f"{tmp_path}/in") if n.endswith(".parquet"))
    assert files == 3 and len(names) == 9
    for k in range(3):
        part = spark.read.parquet(*[f"{tmp_path}/in/{n}" for _, n in names[3 * k : 3 * k + 3]])
        assert {r[0] for r in part.select("seq").distinct().collect()} == {k}
