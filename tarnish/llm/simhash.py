"""SimHash near-dedup by vantage-point trees.

Fingerprints linked by at most `reach` differing bits agree whole on one of
`reach + 1` parts of their bits. Each part has a tree of vantage points, fitted
by the Hamming distance of that part on a bounded sample of the distinct
fingerprints, that cuts the space into shards. In the tree of the part they
agree on, the search ball has radius zero: the triangle bound prunes every
branch but one, no ball overlaps a boundary, and the pair meets in one shard.
So a fingerprint goes to `reach + 1` shards, however many there are; a tree on
all bits would send it to ever more, as its distances lie close to 32.

Shards are counted. One that is too large is cut again by its part's value, and
where all of it has one value by trees' parts of the bits that are still free,
until each is small. In a shard, vantage points cut on until blocks are small
enough to compare whole. The sample decides only where the cuts lie; links are
exact with any tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, filled, restored, shuffle_partitions

SEED = 42
#: Fingerprints the trees are fitted on, at most about; of a shard, aimed at and at most.
SAMPLE, SHARD, MOST = 131_072, 65_536, 524_288
#: Fingerprints compared whole.
BLOCK = 256
ALL = (1 << 64) - 1


def fingerprint(text: str, width: int = 3, step: int = 1 << 16) -> int:
    """64 bits, one set where it is in over half the XXH64 hashes of the shingles."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n), step)


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The bits set in over half of the hashes."""
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        set_ += np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """`docs` with the text replaced by `fp`, a long whose 64 bits are the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=[*rest, "fp"])

    rest = [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + ["fp long"])
    return docs.select(filled(docs[text]).alias("_text"), *[docs[c] for c in rest]).mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def parts(free: int, n: int) -> list[int]:
    """The set bits of `free` in at most `n` masks of equal width."""
    bits = [1 << k for k in range(64) if free >> k & 1]
    return [sum(x) for k in range(n) if (x := bits[len(bits) * k // n : len(bits) * (k + 1) // n])]


def fit_tree(sample: np.ndarray, total: int, mask: int, shard: int = SHARD) -> list[tuple[int, int, int, int]]:
    """Inner nodes (vantage, radius, near, far); a child below 0 is shard ~child.

    Distances count the bits of `mask`. Each radius is the distance that comes
    nearest to halving the sample, of a few vantage points the one that does so best.
    """
    rng = np.random.default_rng(SEED)
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        best = None
        if len(points) * total > shard * len(sample) and len(points) >= 8:
            for v in rng.choice(points, 4):
                d = distance(points, v)
                upto = np.cumsum(np.bincount(d, minlength=65))[:64]
                radius = int(np.argmin(abs(2 * upto - len(points))))
                if best is None or abs(2 * int(upto[radius]) - len(points)) < best[0]:
                    best = (abs(2 * int(upto[radius]) - len(points)), v, radius, d)
        if best is None or best[0] == len(points):
            shards += 1
            return -shards
        _, v, radius, d = best
        at = len(nodes)
        nodes.append((int(v), radius, 0, 0))
        nodes[at] = (int(v), radius, grow(points[d <= radius]), grow(points[d > radius]))
        return at

    grow(sample & np.uint64(mask))
    return nodes


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], mask: int) -> np.ndarray:
    """The shard of each fingerprint in the tree of `mask`."""
    out, masked = np.zeros(len(fps), np.int64), fps & np.uint64(mask)
    stack = [(0, np.arange(len(fps)))] if nodes else []
    while stack:
        at, index = stack.pop()
        if at < 0:
            out[index] = ~at
        elif len(index):
            v, radius, near, far = nodes[at]
            inside = distance(masked[index], np.uint64(v)) <= radius
            stack += [(near, index[inside]), (far, index[~inside])]
    return out


def linked(fps: np.ndarray, mask: int, free: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of the distinct `fps`, within reach, that connect all that are and agree on `mask`.

    All agree on the bits outside `free`. Where most are near one vantage point
    they are tied to it, and only the others compared with all. Vantage points
    cut the rest by the distance on `mask`; what agrees on all of it is cut by
    the parts of the other free bits.
    """
    root, found = np.arange(len(fps)), [(np.zeros(0, np.int64),) * 2]
    stack = [(np.arange(len(fps)), np.arange(len(fps)), mask, free, True)]
    while stack:
        own, every, mask, free, first = stack.pop()
        if not len(own) or len(every) < 2:
            continue
        if len(own) * len(every) <= BLOCK * BLOCK:
            i, j = np.nonzero(distance(fps[own, None], fps[None, every]) <= reach)
            found.append(tied(root, own[i], every[j]))
            continue
        if first:
            tried = own[:: -(-len(own) // 8)]
            near = [distance(fps[own], fps[v]) <= reach for v in tried]
            best = int(np.argmax([x.sum() for x in near]))
            if 2 * near[best].sum() > len(own):
                ball = own[near[best]]
                found.append(tied(root, np.full(len(ball), tried[best]), ball))
                stack.append((own[~near[best]], every, mask, free, False))
                continue
        bits, v = np.uint64(mask), fps[own[len(own) // 2]]
        d, own_d = (distance(fps[x] & bits, v & bits) for x in (every, own))
        if d.max() == 0:  # the vantage point itself is at 0
            free &= ~mask
            stack += [(own, every, part, free, first) for part in parts(free, reach + 1)]
            continue
        radius = min(int(np.median(own_d)), int(d.max()) - 1)
        stack += [(own[own_d <= radius], every[d <= radius], mask, free, first), (own[own_d > radius], every[d > radius], mask, free, first)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def tied(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a[k], b[k] enough to connect what they connect and `root` doesn't yet; joins the sets in `root`."""
    kept = [(a[:0], b[:0])]
    while len(a):
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        one = np.unique(np.maximum(root[a], root[b]), return_index=True)[1]
        kept.append((a[one], b[one]))
        unite(root, a[one], b[one])
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[k] and b[k]; `root` stays flat, its roots the smallest index."""
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = lo != hi
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while not np.array_equal(flat := root[root], root):
            root[:] = flat


def further(keys: np.ndarray, mask: int, value: np.ndarray) -> np.ndarray:
    """Keys for what stands under a key at a value of a mask. Two that are equal by chance make one larger shard."""
    h = (keys ^ np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + value * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def sharded(distinct: DataFrame, reach: int, scratch: Scratch, sample: int = SAMPLE, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Rows (key, mask, free, fp), a few for each distinct `fp`: those of a key make up a shard of at most about `most`.

    Two linked fingerprints meet in a shard in which they agree on `mask`; all
    of a shard agree on the bits outside `free`.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    taken = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30)))
    points = np.sort(taken.select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64))  # about `sample` at most
    trees = spark.sparkContext.broadcast([(m, fit_tree(points, total, m, shard)) for m in parts(ALL, reach + 1)])
    schema = "key long, mask long, free long, fp long"

    def rows_of(keys: np.ndarray, mask: int, free: int, fps: np.ndarray) -> pa.RecordBatch:
        same = lambda x: np.full(len(fps), x, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, same(mask), same(free), fps)], names=["key", "mask", "free", "fp"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for mask, nodes in trees.value:
                yield rows_of(further(np.zeros(len(fps), np.uint64), mask, route(fps, nodes, mask).astype(np.uint64)), mask, ALL, fps)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a further key: the value of their mask; those of one value by the parts of what is free."""
        for batch in batches:
            key, mask, free, fps = (batch.column(k).to_numpy().view(np.uint64) for k in range(4))
            for m, f in {(int(m), int(f)) for m, f in zip(mask, free, strict=True)}:
                own = (mask == m) & (free == f)
                for part in [m] if f & m else parts(f, reach + 1):
                    # What agrees on a part has it no longer free, and is next cut by what is.
                    yield rows_of(further(key[own], part, fps[own] & np.uint64(part)), part, f & ~part, fps[own])

    now, done, k = scratch.save(distinct.select("fp").mapInArrow(send, schema), "shards0"), None, 0
    while True:
        large = scratch.save(now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), f"large-shards{k}")
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        small = now.join(large, "key", "left_anti")
        done, k = small if done is None else done.unionByName(small), k + 1
        now = scratch.save(now.join(large, "key", "left_semi").select(*[c.split()[0] for c in schema.split(", ")]).mapInArrow(again, schema), f"shards{k}")


def links(shards: DataFrame, reach: int, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) over the `fp` of shards that are within `reach` and connect all that are: a forest per shard.

    A task takes shards together until they make up about `shard` rows.
    """

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        key, mask, free, fps = (rows[c].to_numpy().view(np.uint64) for c in ("key", "mask", "free", "fp"))
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        pairs = [(fps[lo:hi][i], fps[lo:hi][j]) for lo, hi in zip(edges, edges[1:], strict=False) if hi - lo > 1 for i, j in [linked(fps[lo:hi], int(mask[lo]), int(free[lo]), reach)]]
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    groups = max(1, -(-shards.count() // shard))
    return shards.withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("_group").applyInPandas(meet, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the component's smallest node.

    Large-star and small-star rounds in turn, each written to the shared folder;
    the edges left at the end are a star per component. A star's centre may have
    any number of edges: minima are pre-aggregated, the joins back can be split.
    """
    edges = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    before, k = None, 0
    while True:
        sums = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(sums) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, k = tuple(sums), k + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = scratch.save(large, f"large{k}")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = scratch.save(small, f"edges{k}")


def near_groups(docs: DataFrame, width: int = 3, reach: int = 2, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs` with the columns of `carry` (all but the text by default).

    Adds fp (long), fingerprint (16 lowercase hex digits), component_fp (the fp
    that stands for the component) and component_id, the smallest id reachable
    over links of at most `reach` differing bits, itself included; columns of
    these names are replaced. Null text counts as empty;
    texts without words have fingerprint zero and link like any other. Repeated
    and null ids are ordinary rows; component_id is null if no row of the
    component has an id. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "simhash")
    added = ["fp", "fingerprint", "component_fp", "component_id"]
    carried = [c for c in ([c for c in docs.columns if c != text] if carry is None else carry) if c not in added]
    rows = docs.select(F.struct(*[docs[c] for c in carried]).alias("_row"), docs[id_col].alias("_id"), docs[text].alias("_text"))
    rows = scratch.save(fingerprints(rows, "_text", width), "fingerprints")
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("_id").alias("least")).repartition(shuffle_partitions(spark)), "distinct")
    stars = components(links(sharded(distinct, reach, scratch), reach), scratch)
    # Least id of each component, over its other fingerprints and its root.
    of = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = scratch.save(of, "roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = scratch.save(of.join(least, "root").select("fp", F.col("root").alias("component_fp"), "component_id"), "labels")
    out = rows.join(labels, "fp", "left")
    return out.select("_row.*", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_fp", "component_id")


def drop_near(docs: DataFrame, width: int = 3, reach: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` with its own columns, one of each group: the first by id (nulls last), then by all columns.

    Groups are those of `near_groups`: rows belong together by their texts,
    never by their ids. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-rows")
    whole = F.struct(*[docs[c] for c in docs.columns])
    rows = scratch.save(docs.select(whole.alias("_whole"), F.monotonically_increasing_id().alias("_at")), "rows")
    row = F.col("_whole")
    groups = near_groups(rows.select(row[id_col].alias("_id"), row[text].alias("_text"), F.xxhash64("_whole").alias("_order"), "_at"), width, reach, "_text", "_id", carry=["_id", "_order", "_at"])
    groups = scratch.save(groups.select("_id", "_order", "_at", "component_fp"), "groups")
    first = groups.groupBy("component_fp").agg(F.min(F.struct(F.col("_id").isNull().alias("nameless"), F.col("_id").alias("id"), F.col("_order").alias("order"), F.col("_at").alias("at"))).alias("first"))
    return restored(rows.join(first.select(F.col("first.at").alias("_at")).hint("merge"), "_at", "left_semi"), "_whole", docs)
