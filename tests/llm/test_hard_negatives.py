import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor):
    """`rows` of (id, vector, label); rows of their own whatever their ids."""
    sound = [(k, i, [math.floor(256 * x) for x in v], y) for k, (i, v, y) in enumerate(rows) if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v, y in sound:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, z) for m, j, w, z in sound if m != k)
        for s, j, _, _ in [x for x in scored if x[3] == y][:5]:
            fit = [x for x in scored if x[3] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, seed, dim=6, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        rows.append((k, [float(np.float32(x + rng.gauss(0, 0.4))) for x in c], rng.randrange(labels)))
    hot = rows[3][1]
    rows += [(n + k, hot, k % 3) for k in range(n // 3)]  # a third of all rows are one vector
    rows += [(4, rows[0][1], 1), (4, rows[0][1], 1), (None, hot, 1), (9001, None, 1), (9002, [1.0, None], 1), (9003, [float("nan")] * dim, 1), (9004, [float("inf")] * dim, 1), (9005, hot, None), (9006, [], 2), (9010, [1.0], 1)]
    return rows


@pytest.mark.parametrize(("cells", "block", "pack"), [(256, 4096, 256), (8, 20, 4), (16, 7, 1), (1, 10, 3)])
def test_agrees_with_scoring_all_pairs(spark, cells, block, pack):
    rows = vectors(300, 7)
    data = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("extra", F.lit(1))
    got = hard_negatives.mine(data, F.col("vec_id") % 10 == 0, cells=cells, block=block, pack=pack).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 10 == 0)


def test_scores_beyond_what_balls_can_bound(spark):
    rng = random.Random(8)
    rows = [(k, [float(rng.randrange(-(1 << 22), 1 << 22)) for _ in range(3)], k % 3) for k in range(60)]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, cells=4, block=9, pack=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 5 == 0)


def test_empty_tables_and_few_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], [(0, None, None)]):
        got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 5 == 0)
        assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_nodes_are_pruned_and_none_that_is_needed():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.3, (400, 8)) for c in rng.normal(0, 20, (12, 8))])
    tree = hard_negatives.fit(points, 64)
    cells = tree.route(points)
    assert len(tree.centres) > 32 and np.bincount(cells).max() < 4 * len(points) / len(tree.centres)
    radius = {int(c): hard_negatives.far(points[cells == c], tree.centres[c]) for c in np.unique(cells)}
    scores = points @ points.T
    low = int(np.quantile(scores, 0.98))
    asks = {c: (low, hard_negatives.HIGH) for c in radius}
    left = {(a, c) for a, c, _ in hard_negatives.cell_pairs(hard_negatives.Balls(tree, radius, asks), hard_negatives.Balls(tree, radius))}
    needed = {(int(cells[i]), int(cells[j])) for i, j in zip(*np.nonzero(scores >= low), strict=True)}
    assert needed <= left and len(left) < len(radius) ** 2 / 3


def test_query_over_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["label"] is not None and r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, path).collect())) == brute(rows, lambda i: i % 100 == 0)
