import functools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tarnish.llm import near_jaccard, simhash

from .conftest import SCHEMA


def brute_groups(rows, least=0.8):
    """Components of rows (id, text)."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_jaccard.jaccard(rows[i][1] or "", rows[j][1] or "", 5) >= least:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return groups.values()


def near_rows():
    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for n in (60, 100, 200, 500):
        for _ in range(12):
            w = draw(n)
            texts.append(w)
            texts += [[*w[:at], "Changed", *w[at + 1 :]] for at in (rng.randrange(5, n - 5),)]
            texts.append([*w[: n * 2 // 3], *draw(n // 3)])  # too far
    hot = draw(120)
    texts += [[*hot[:k], f"x{k}", *hot[k + 1 :]] for k in range(5, 75)]
    texts += [["a", "b"], ["A", "b"], ["a", "c"], [], hot[:110] + draw(2)]
    return [(7 if k % 10 == 0 else k, " ".join(w)) for k, w in enumerate(texts)]


def test_stage_drops_only_near_copies_and_most_of_them(spark):
    """What goes is in a group of Jaccard 0.8 whose smallest id stays; fingerprints find at least nine in ten."""
    rows = near_rows()
    groups = list(brute_groups(rows))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, "").collect()]
    assert sum(len(g) > 1 for g in groups) >= 48
    for g in groups:
        mine = [r for r in got if r in g]
        assert mine and min(i for i, _ in mine) == min(i for i, _ in g)
    assert len(rows) - len(got) >= 0.9 * (len(rows) - len(groups))


def test_confirmation_spares_what_fingerprints_alone_would_drop(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert near_jaccard.drop_near(df, least=1.1).count() == len(rows)


def test_null_ids_and_empty_tables(spark, empty):
    assert near_jaccard.drop_near(empty).count() == 0
    df = spark.createDataFrame([(None, "A b c"), (None, "a b c"), (None, None), (3, ""), (1, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in near_jaccard.drop_near(df).collect())
    assert ("None", "a b c") in got and ("1", "x") in got and sum(t == "a b c" for _, t in got) == 1


def variants(seed=5):
    """A base, variants whose similarity to it and to each other is below 0.8, and a near copy of each variant."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = [base]
    for k in range(40):
        own = list(base)
        for at in range(10):
            own[(k * 7 + at * 30) % 300] = word()
        texts.append(own)
        copy = list(own)
        copy[(k * 7 + 3) % 300] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_links_that_fail_do_not_hide_those_that_hold(spark):
    texts = variants()
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"] for r in near_jaccard.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 10 and near_jaccard.jaccard(rows[i][1], rows[j][1], 5) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {k for k in range(len(rows)) if top(k) == k}
    assert len(got) == 41


def test_parts_of_large_blocks_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_jaccard, "SIDE", 4)
    texts = variants(6)
    got = near_jaccard.drop_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert got.count() == 41

def test_rows_handed_on_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Texts within reach of each other, all of them below 0.8: sketches rule their pairs out."""
    made, save = {}, near_jaccard.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_jaccard.Scratch, "save", counted)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = []
    for k in range(600):
        own = list(base)
        for at in range(10):
            own[(k * 7 + at * 30) % 300] = word()
        rows.append((k, " ".join(own)))
    assert near_jaccard.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == 600
    assert made["texts"] > 500 and made["block-nodes"] < 60


def test_bound_rules_out_no_similar_pair():
    rng = random.Random(4)
    sets = []
    for n in (1, 3, 40, 120, 127, 129, 300, 1000, 5000):
        own = [b"%d-%d" % (n, k) for k in range(n)]
        sets += [set(own), set(own) | {b"more"}, set(own[: -(-n * 8 // 10)]), set(own[: n * 9 // 10 + 1]) | {b"x%d" % rng.randrange(1 << 40) for _ in range(n // 20)}, set(own[: n // 2 + 1])]
    for least in (0.5, 0.8, 1.0):
        bound = near_jaccard.Bound(np.array([len(s) for s in sets]), [near_jaccard.sketch(s) for s in sets], least)
        i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
        far = bound(i, j)
        alike = np.array([len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True)])
        assert (far[alike] <= 1).all() and (far > 1).sum() > len(far) // 2
    assert len({len(near_jaccard.sketch(s)) for s in sets}) > 3


def test_trees_and_equal_fingerprints_hold_all_pairs_apart():
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.repeat(centres, 300)
    for _ in range(6):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64))
    fps = np.concatenate([fps, fps[:200], np.repeat(fps[:1], 300)])
    group = np.where(rng.random(len(fps)) < 0.3, 0, rng.integers(1, 400, len(fps)))
    group = np.unique(group, return_inverse=True)[1]
    bound = near_jaccard.Bound(np.ones(len(fps), np.int64), [near_jaccard.sketch({b"a"})] * len(fps), 0.8)
    found = []
    for mask in simhash.parts(simhash.ALL, 11):
        for value in np.unique(fps & np.uint64(mask)):
            at = np.flatnonzero((fps & np.uint64(mask)) == value)
            own = np.unique(group[at], return_inverse=True)[1]
            for i, j, _ in near_jaccard.apart(fps[at], own, mask, simhash.ALL & ~mask, 10, bound):
                found += zip(at[i].tolist(), at[j].tolist(), strict=True)
    for value in np.unique(fps):
        at = np.flatnonzero(fps == value)
        own = np.unique(group[at], return_inverse=True)[1]
        for i, j, _ in near_jaccard.apart(fps[at], own, 0, 0, 10, bound):
            found += zip(at[i].tolist(), at[j].tolist(), strict=True)
    i, j = np.nonzero((simhash.distance(fps[:, None], fps[None, :]) <= 10) & (group[:, None] != group[None, :]))
    assert {(min(x), max(x)) for x in found} == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}


def test_parts_of_large_shards_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_jaccard, "cells", functools.partial(near_jaccard.cells, most=8))
    texts = variants(7)
    got = near_jaccard.drop_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert got.count() == 41


def test_equal_fingerprints_of_unlike_texts_are_compared(spark, monkeypatch):
    """All fingerprints equal: the first round ties each text to one only."""
    monkeypatch.setattr(near_jaccard, "fingerprints", lambda rows, text, width: rows.drop(text).withColumn("fp", F.lit(5).cast("long")))
    rng = random.Random(2)
    draw = lambda: [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = []
    for k in range(20):
        w = draw()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-1], "x"]))]
    got = near_jaccard.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 40, 2))
