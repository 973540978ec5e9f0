import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnish.llm import exact_dedup, simhash, substring_dedup

from .conftest import SCHEMA, words


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[normal(r[1])].append(r[0])
    return by


@pytest.mark.parametrize(("hot_bytes", "hot_part"), [(exact_dedup.HOT_BYTES, exact_dedup.HOT_PART), (1, 0.0)])
def test_exact_groups(spark, docs, rows, monkeypatch, hot_bytes, hot_part):
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(exact_dedup, "HOT_PART", hot_part)
    got = exact_dedup.exact_groups(docs, carry=["doc_id", "text"]).collect()
    by = brute_groups(rows)
    assert len(got) == len(rows)
    for r in got:
        group = by[normal(r["text"])]
        assert (r["keep_id"], r["group_size"]) == (min(group), len(group))
        assert r["text_sha256"] == hashlib.sha256(normal(r["text"]).encode()).hexdigest()
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(min(g) for g in by.values())


def test_exact_hot_groups_are_salted_and_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", 10_000)
    monkeypatch.setattr(exact_dedup, "HOT_PART", 0.0)
    rows = [(i, "same text" if i % 3 else f"text {i}", "en", "s", 1) for i in range(6300)] + [(None, "same text", "en", "s", 1)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA), carry=["doc_id"]).collect()
    hot = [r for r in got if r["group_size"] > 1]
    assert len(hot) == 4201 and {(r["keep_id"], r["group_size"]) for r in hot} == {(1, 4201)}
    assert sum(r["kept"] for r in got) == 2101


def test_exact_nulls_and_clashing_columns(spark, empty):
    rows = [(None, "a"), (None, "a"), (4, "a"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, keep_id int, kept string")
    got = exact_dedup.exact_groups(df).collect()
    assert sorted((r["text"] or "", r["keep_id"], r["group_size"], r["kept"]) for r in got if r["kept"]) == [("", None, 2, True), ("a", 4, 3, True)]
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and {(r["keep_id"], r["kept"]) for r in kept.collect()} == {(9, "x")}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_hot_rows_of_no_id_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", 50_000)
    df = spark.range(8000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = exact_dedup.exact_groups(df, carry=["text"]).where("text = 'same text'").collect()
    assert len(got) == 4000 and {(r["keep_id"], r["group_size"]) for r in got} == {(None, 4000)} and sum(r["kept"] for r in got) == 1


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, ids, reach):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_against_brute_force(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    expected = sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows], 2), strict=True))
    got = simhash.near_groups(docs, carry=["doc_id"]).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == expected


def links_of(fps, reach):
    """Pairs of indices within reach."""
    out = set()
    for i in range(len(fps)):
        out |= {(i, int(j)) for j in np.flatnonzero(simhash.distance(fps[i + 1 :], fps[i]) <= reach) + i + 1}
    return out


def near_fingerprints(reach):
    """Spread ones, chains, a ball, and a family that agrees on a third of its bits."""
    rng = np.random.default_rng(reach)
    flip = lambda n, hi=64: np.uint64(1) << rng.integers(0, hi, n).astype(np.uint64)
    fps = rng.integers(0, 1 << 63, 3000, np.uint64)
    family = fps[1] ^ rng.integers(0, 1 << 20, 900, np.uint64)
    ball = fps[0] ^ flip(200) ^ flip(200)
    return np.unique(np.concatenate([fps, fps[:600] ^ flip(600), ball, ball ^ np.uint64(3), family, family[:200] ^ flip(200, 40)]))


def united(n, pairs):
    root = np.arange(n)
    for a, b in pairs:
        simhash.unite(root, np.array([a]), np.array([b]))
    return root


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_vantage_shards_lose_no_link(reach):
    fps = near_fingerprints(reach)
    found = []
    for mask in simhash.parts(simhash.ALL, reach + 1):
        nodes = simhash.fit_tree(fps[::3], len(fps), mask, shard=200)
        assert len(nodes) > 3
        shard = simhash.route(fps, nodes, mask)
        for k in np.unique(shard):
            index = np.flatnonzero(shard == k)
            found += [(index[i], index[j]) for i, j in zip(*simhash.linked(fps[index], mask, simhash.ALL, reach), strict=True)]
    assert all(simhash.distance(fps[i], fps[j]) <= reach for i, j in found)
    assert np.array_equal(united(len(fps), found), united(len(fps), links_of(fps, reach)))


def test_large_shards_are_cut_until_they_are_small(spark):
    from tarnish.llm.common import Scratch

    fps = near_fingerprints(2)
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    shards = simhash.sharded(distinct, 2, Scratch(spark, "test"), sample=300, shard=3000, most=700)
    assert shards.groupBy("key").count().agg(F.max("count")).first()[0] <= 700
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    found = [(at[r["a"]], at[r["b"]]) for r in simhash.links(shards, 2).collect()]
    assert np.array_equal(united(len(fps), found), united(len(fps), links_of(fps, 2)))


def test_a_million_fingerprints_in_bounded_shards(spark):
    """Three copies of each, whatever their number; the largest shard stays near what is aimed at."""
    from tarnish.llm.common import Scratch

    n = 1_000_000
    distinct = spark.range(n).select(F.xxhash64("id").alias("fp")).distinct()
    shards = simhash.sharded(distinct, 2, Scratch(spark, "test"), shard=16_384, most=65_536)
    sizes = shards.groupBy("key").count()
    figures = sizes.agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert figures[0] <= 32_768 and figures[1] == 3 * n and figures[2] >= 3 * n // 32_768


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (39, 300)]
    from tarnish.llm.common import Scratch

    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()))
    assert {got[k] for k in range(101, 161)} == {100} and {got[k] for k in [*range(2, 40), 300]} == {1}


def test_near_duplicates_dropped(spark, docs, rows, empty):
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(fps, [r[0] for r in rows], 2)))
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near(empty).count() == 0
    clashing = [(None, "a b c d", "y", 1), (None, "a b c d", "x", 1), (None, None, "z", 1), (3, "", "w", 1), (1, "e f g h i", "v", 1), (1, "j k l m n", "u", 1), (1, "j k l m n", "u", 1)]
    got = simhash.drop_near(spark.createDataFrame(clashing, "doc_id long, text string, fp string, _keep int"))
    assert got.columns == ["doc_id", "text", "fp", "_keep"]
    kept = [tuple(r) for r in got.collect()]
    assert (3, "", "w", 1) in kept and (1, "e f g h i", "v", 1) in kept and (1, "j k l m n", "u", 1) in kept and len(kept) == 4


def brute_removed(rows, width):
    found = Counter()
    for r in rows:
        w = words(r[1])
        found.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if found[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("width", "chunk", "bucket"), [(35, 1 << 22, 1 << 21), (35, 3000, 500), (6, 2000, 300), (1, 2000, 300)])
def test_repeats_against_brute_force(docs, rows, width, chunk, bucket):
    got = substring_dedup.remove_repeats(docs, width, chunk_bytes=chunk, bucket_windows=bucket).collect()
    flat = sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in got)
    assert flat == brute_removed(rows, width)


def test_repeats_edge_cases(spark, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    body = " ".join(["y" * 300] + [f"w{i}" for i in range(40)])
    rows = [(None, body), (None, body + " end"), (1, None), (2, "")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["kept"]) for r in got) == [(0, ""), (0, ""), (41, ""), (42, "end")]


@pytest.mark.parametrize("length", [64, 3_000_000])
def test_long_words_repeat_whatever_follows(spark, length):
    run = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{run} {'y' * length} one way on"), (2, f"{run} {'y' * length}"), (3, f"a b {run} {'y' * length} another end"), (4, "z" * length)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: "one way on", 2: "", 3: "a b another end", 4: "z" * length}


def doubling(k):
    """Two words over a and b whose polynomial hashes modulo a power of two agree for every base."""
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("chunk", [1 << 22, 50])
def test_words_made_to_collide_are_told_apart(spark, chunk):
    one, two = doubling(10)
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, " ".join(doubling(5)[0])), (4, " ".join(doubling(5)[1]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk).collect()
    assert all(not r["removed"] for r in got) and {r["doc_id"]: r["kept"] for r in got} == dict(rows)


@pytest.mark.parametrize("chunk", [1 << 22, 400])
def test_windows_of_one_hash_are_told_apart_by_their_words(spark, docs, rows, monkeypatch, chunk):
    """With hashes of two bits nearly all windows collide; the result stays exact."""
    whole = substring_dedup.rolling
    monkeypatch.setattr(substring_dedup, "rolling", lambda words, width: whole(words, width) >> np.uint64(62) << np.uint64(62))
    few = [r for r in rows if len(r[1] or "") < 3000]
    df = spark.createDataFrame(few, SCHEMA)
    chunks = [substring_dedup.Chunk(b"\n".join((r[1] or "").encode() for r in few) + b"\n", np.array([len((r[1] or "").encode()) + 1 for r in few]))]
    at, keys, which, _ = chunks[0].anchors(4)
    windows, keys, one, which = chunks[0].suspects(7, 4, np.ones(len(keys), bool), at, which)
    words_ = chunks[0].words
    assert len(keys) == len({tuple(words_[w : w + 7]) for w in windows}) and (np.diff(keys.astype(float)) >= 0).all()
    assert all(words_[w : w + 7] == words_[one[k] : one[k] + 7] for w, k in zip(windows, which, strict=True))
    got = substring_dedup.remove_repeats(df, 7, chunk_bytes=chunk).collect()
    flat = sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in got)
    assert flat == brute_removed(few, 7)


def test_work_of_a_chunk_is_free_of_the_number_of_buckets():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64)) << np.uint64(1)
    for buckets in (1, 7, 10**9):
        held, bounds = substring_dedup.buckets_of(keys, buckets)
        assert len(bounds) == len(held) + 1 <= 1001 and bounds[-1] == 1000 and sorted(set(held)) == held and max(held) < buckets
