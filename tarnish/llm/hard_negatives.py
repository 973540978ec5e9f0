"""Hard-negative mining by dual-tree search.

Two trees, one over anchors and one over candidates, cut the space at medians
of projections, fitted on bounded samples. Each cell, each inner node and each
block of rows in a cell has a ball round all its rows, so the inner products of
two nodes lie in an interval; a pair of nodes whose interval misses what every
anchor below still asks for is pruned as a whole. The upper trees have a fixed
bound of cells and are walked on the driver; cell pairs that are left are joined
on Spark, where the balls of blocks and single anchors prune on, and leaf pairs
are scored exactly. The samples decide only where the cuts lie.

A search runs in two rounds: each anchor cell meets its most promising cell
first, and what that finds raises the scores the second round has to look for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

SEED = 42
#: Rows that a tree is fitted on, about and at most; cells of a tree at most.
SAMPLE, CELLS = 32_768, 256
#: Rows of a block and anchors of a pack, about; blocks of a cell that one key of the join holds; packs whose results a task holds.
BLOCK, PACK, UNIT, HELD = 4096, 256, 256, 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Inner products beyond this are not held against balls, and are sorted by score and row in turn.
WIDE = 1 << 50


@dataclass
class Tree:
    """Inner nodes (direction, threshold, left, right), a child below 0 being cell ~child, and a reference point for each cell."""

    nodes: list[tuple[np.ndarray, float, int, int]]
    centres: np.ndarray

    def route(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))] if self.nodes else []
        while stack:
            at, index = stack.pop()
            if at < 0:
                out[index] = ~at
            elif len(index):
                direction, threshold, left, right = self.nodes[at]
                inside = points[index] @ direction <= threshold
                stack += [(left, index[inside]), (right, index[~inside])]
        return out


def fit(sample: np.ndarray, cells: int) -> Tree:
    """A tree of at most `cells` cells that hold about as many of the sample, cut across the direction in which a node's points spread most."""
    nodes: list[tuple[np.ndarray, float, int, int]] = []
    centres: list[np.ndarray] = []
    rng = np.random.default_rng(SEED)

    def grow(points: np.ndarray, most: int) -> int:
        if most > 1 and len(points) >= 16:
            spread = points - points.mean(axis=0)
            direction = rng.standard_normal(points.shape[1])
            for _ in range(6):
                direction = spread.T @ (spread @ direction)
                direction /= np.linalg.norm(direction) or 1.0
            along = points @ direction
            threshold = float(np.median(along))
            inside = along <= threshold
            if inside.any() and not inside.all():
                at = len(nodes)
                nodes.append((direction, threshold, 0, 0))
                nodes[at] = (direction, threshold, grow(points[inside], most - most // 2), grow(points[~inside], most // 2))
                return at
        centres.append(points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
        return -len(centres)

    grow(sample, max(1, cells))
    return Tree(nodes, np.array(centres))


@dataclass
class Balls:
    """A ball for each node of a tree, inner nodes first, then cells that have rows; and what the anchors of each ask for."""

    tree: Tree
    radius: dict[int, float]
    asks: dict[int, tuple[int, int]] | None = None

    def __post_init__(self):
        self.balls: dict[int, tuple[np.ndarray, float]] = {}
        self.wants: dict[int, tuple[int, int]] = {}
        self.enclose(0 if self.tree.nodes else -1)

    def children(self, node: int) -> list[int]:
        return [k for k in self.tree.nodes[node][2:] if k in self.balls]

    def enclose(self, node: int) -> None:
        if node < 0:
            if ~node in self.radius and (self.asks is None or ~node in self.asks):
                self.balls[node] = (self.tree.centres[~node], self.radius[~node])
                self.wants[node] = self.asks[~node] if self.asks else (LOW, HIGH)
            return
        below = self.tree.nodes[node][2:]
        for k in below:
            self.enclose(k)
        if held := [k for k in below if k in self.balls]:
            centre = np.mean([self.balls[k][0] for k in held], axis=0)
            self.balls[node] = (centre, max(np.linalg.norm(self.balls[k][0] - centre) + self.balls[k][1] for k in held))
            self.wants[node] = (min(self.wants[k][0] for k in held), max(self.wants[k][1] for k in held))


def interval(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float]) -> tuple[float, float]:
    """Bounds of the inner products between two balls."""
    (p, r), (q, s) = a, b
    middle, n, m = float(p @ q), float(np.linalg.norm(p)), float(np.linalg.norm(q))
    width = n * s + m * r + r * s + 1e-9 * (n + r) * (m + s) + 1e-6
    return middle - width, middle + width


def cell_pairs(anchors: Balls, candidates: Balls) -> list[tuple[int, int, float]]:
    """Pairs of cells (anchor's, candidate's, upper bound) that the walk down both trees does not prune."""
    found = []
    roots = [0 if x.tree.nodes else -1 for x in (anchors, candidates)]
    stack = [tuple(roots)] if roots[0] in anchors.balls and roots[1] in candidates.balls else []
    while stack:
        a, c = stack.pop()
        low, high = interval(anchors.balls[a], candidates.balls[c])
        if high < anchors.wants[a][0] or low > anchors.wants[a][1]:
            continue
        if a < 0 and c < 0:
            found.append((~a, ~c, high))
        elif c < 0 or a >= 0 and anchors.balls[a][1] > candidates.balls[c][1]:
            stack += [(k, c) for k in anchors.children(a)]
        else:
            stack += [(a, k) for k in candidates.children(c)]
    return found


def matrix(vectors, dim: int) -> np.ndarray:
    """Vectors below one another; missing components at the end are zero."""
    out = np.zeros((len(vectors), dim), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
    centre = rows.mean(axis=0)
    return centre, float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) * (1 + 1e-12)


def far(rows: np.ndarray, centre: np.ndarray) -> float:
    return float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) * (1 + 1e-12)


BLOCK_FIELDS = "cell long, block long, ats binary, ids binary, labels binary, vectors binary, centre binary, radius double, cell_radius double"


def packer(tree: Tree, dim: int, cell: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows of one block of a cell as one row, in the order of ids; `windows` of anchors become flat arrays."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "at"], ignore_index=True)
        vectors = matrix(rows["q"], dim)
        real = vectors.astype(np.float64)
        centre, radius = ball(real)
        k = int(rows[cell][0])
        raw = lambda x: np.ascontiguousarray(x, np.int64).tobytes()
        out = {
            "cell": k, "block": int(rows["block"][0]), "ats": raw(rows["at"]), "ids": raw(rows["id"]), "labels": raw(rows["label"]), "vectors": raw(vectors),
            "centre": centre.tobytes(), "radius": radius, "cell_radius": far(real, tree.centres[k]),
        }
        if "windows" in rows:
            windows = [(i, w["low"], w["high"]) for i, ws in enumerate(rows["windows"]) for w in ws]
            asker, low, high = (raw([w[k] for w in windows]) for k in range(3))
            out |= {"asker": asker, "low": low, "high": high, "ask_low": min(w[1] for w in windows), "ask_high": max(w[2] for w in windows)}
        return pd.DataFrame([out])

    return pack


def first_of(scores: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """For each row of `scores` the columns of its first `k` by score, then column, of those that fit; -1 where there are fewer."""
    n = scores.shape[1]
    out = np.full((len(scores), k), -1, np.int64)
    if n == 0:
        return out
    if np.abs(scores).max(initial=0) < WIDE:
        keys = np.where(fits, scores * n + (n - 1 - np.arange(n)), LOW)
        top = np.argpartition(~keys, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(scores), 1))
        order = np.argsort(~np.take_along_axis(keys, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        out[:, : top.shape[1]] = np.where(np.take_along_axis(fits, top, 1), top, -1)
        return out
    for row in range(len(scores)):
        held = np.flatnonzero(fits[row])
        best = held[np.argsort(scores[row, held].astype(object) * -1, kind="stable")[:k]]
        out[row, : len(best)] = best
    return out


class Found:
    """The best so far for each window of a pack, and the score it still has to beat or equal."""

    def __init__(self, pack: dict, k: int):
        self.k, self.low = k, np.frombuffer(pack["low"], np.int64).copy()
        self.asker, self.high = np.frombuffer(pack["asker"], np.int64), np.frombuffer(pack["high"], np.int64)
        self.ats, self.labels = np.frombuffer(pack["ats"], np.int64), np.frombuffer(pack["labels"], np.int64)
        self.best: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, window: int, found: list[tuple[int, int, int]]) -> None:
        """`found` holds (-score, id, at)."""
        self.best[window] = best = sorted(self.best.get(window, []) + found)[: self.k]
        if len(best) == self.k:
            self.low[window] = max(self.low[window], -best[-1][0])

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        return [(int(self.ats[self.asker[w]]), int(self.high[w]), -score, i, at) for w, best in self.best.items() for score, i, at in best]


def score_pair(pack: dict, block: dict, found: Found, dim: int, same: bool, exact: bool) -> None:
    """Holds a pack of anchors against a block of candidates; what the balls rule out is not scored."""
    anchors = np.frombuffer(pack["vectors"], np.int64).reshape(-1, dim)
    centre, radius = np.frombuffer(block["centre"], np.float64), block["radius"]
    windows = np.arange(len(found.low))
    if exact:
        low, high = interval((np.frombuffer(pack["centre"], np.float64), pack["radius"]), (centre, radius))
        windows = windows[(high >= found.low) & (low <= found.high)]
        if not len(windows):
            return
        real = anchors.astype(np.float64)
        norm = np.sqrt((real**2).sum(axis=1))
        middle, width = real @ centre, norm * radius * (1 + 1e-9) + 1e-9 * norm * (np.linalg.norm(centre) + 1) + 1e-6
        windows = windows[((middle + width)[found.asker[windows]] >= found.low[windows]) & ((middle - width)[found.asker[windows]] <= found.high[windows])]
    if not len(windows):
        return
    asked, of = np.unique(found.asker[windows], return_inverse=True)
    rows = np.frombuffer(block["vectors"], np.int64).reshape(-1, dim)
    scores = (real[asked] @ rows.astype(np.float64).T).astype(np.int64) if exact else anchors[asked] @ rows.T
    ats, ids, labels = (np.frombuffer(block[c], np.int64) for c in ("ats", "ids", "labels"))
    fits = ((labels[None, :] == found.labels[asked, None]) == same) & (ats[None, :] != found.ats[asked, None])
    for lo in range(0, len(windows), 512):  # some 16 MB at a time
        own = windows[lo : lo + 512]
        part = scores[of[lo : lo + 512]]
        top = first_of(part, fits[of[lo : lo + 512]] & (part >= found.low[own, None]) & (part <= found.high[own, None]), found.k)
        for row in np.flatnonzero(top[:, 0] >= 0):
            cols = top[row][top[row] >= 0]
            found.add(int(own[row]), list(zip((-part[row, cols]).tolist(), ids[cols].tolist(), ats[cols].tolist(), strict=True)))


class Search:
    """Rows, trees and blocks of one table, made once for all rounds."""

    def __init__(self, rows: DataFrame, scratch: Scratch, cells: int, block: int, pack: int):
        """`rows` has at, id, label, q (array of long) and anchor."""
        self.scratch, self.pack_rows, self.rounds = scratch, pack, 0
        self.rows = scratch.save(rows, "rows")
        facts = self.rows.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(F.size("q")).alias("dim"),
            F.max(F.greatest(F.abs(F.array_max("q").cast("double")), F.abs(F.array_min("q").cast("double")))).alias("most"),
        ).first()
        self.n, self.anchors, self.dim = facts["n"], facts["anchors"] or 0, max(facts["dim"] or 0, 1)
        self.exact = self.dim * float(facts["most"] or 0) ** 2 < WIDE
        if not self.anchors:
            return
        trees = [self.tree(self.rows, self.n, min(cells, -(-self.n // block))), self.tree(self.rows.where("anchor"), self.anchors, min(cells, -(-self.anchors // pack)))]
        routed = scratch.save(self.routed(trees), "routed")
        self.candidates, self.trees = self.blocked(routed, "ccell", block), trees
        self.asking = scratch.save(self.blocked(routed.where("anchor"), "acell", pack), "anchors")
        packed = self.candidates.groupBy("ccell", "block").applyInPandas(packer(trees[0], self.dim, "ccell"), BLOCK_FIELDS)
        self.blocks = scratch.save(packed.withColumn("unit", F.floor(F.col("block") / UNIT)), "blocks")
        self.radii = self.cell_radii(self.blocks)
        self.units = self.blocks.select(F.col("cell").alias("ccell"), "unit").distinct()

    def tree(self, rows: DataFrame, n: int, cells: int) -> Tree:
        share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
        taken = rows.where(F.pmod(F.xxhash64("at"), F.lit(1 << 30)) < share).select("at", "q").toPandas() if cells > 1 else pd.DataFrame({"at": [], "q": []})  # about SAMPLE at most
        return fit(matrix(taken.sort_values("at")["q"], self.dim).astype(np.float64), cells)

    def routed(self, trees: list[Tree]) -> DataFrame:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = matrix([v.as_py() for v in batch.column("q")], dim).astype(np.float64)
                cells = [pa.array(t.route(points), pa.int64()) for t in trees]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*batch.schema.names, "ccell", "acell"])

        return self.rows.mapInArrow(run, "at long, id long, label long, q array<long>, anchor boolean, ccell long, acell long")

    def blocked(self, rows: DataFrame, cell: str, most: int) -> DataFrame:
        """Adds `block`: a cell's rows are dealt over blocks of about `most`. Counts are of at most CELLS cells."""
        counts = F.broadcast(rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")))
        return rows.join(counts, cell).withColumn("block", F.pmod(F.xxhash64("at"), F.ceil(F.col("_n") / most))).drop("_n")

    def cell_radii(self, packed: DataFrame) -> dict[int, float]:
        return {r["cell"]: r["radius"] for r in packed.groupBy("cell").agg(F.max("cell_radius").alias("radius")).collect()}

    def first(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """Rows (at, high, score, id, cat, rank): for each window (at, low, high) of an anchor row its first `k` rows of the same label, or of others."""
        self.rounds += 1
        name = f"search{self.rounds}"
        packs = self.packs(windows, f"{name}-packs0")
        pairs = self.pairs(packs)
        best: dict[int, tuple[float, int]] = {}
        for a, c, high in pairs:
            best[a] = max(best.get(a, (-np.inf, 0)), (high, c))
        seeds = [(a, c) for a, (_, c) in best.items()]
        if not seeds:
            return self.ranked(self.scratch.spark.createDataFrame([], "at long, high long, score long, id long, cat long"), k)
        found = self.scratch.save(self.meet(packs, seeds, same, k), f"{name}-found0")
        if len(pairs) > len(seeds):
            kth = self.ranked(found, k).where(F.col("rank") == k).select("at", "high", F.col("score").alias("_kth"))
            raised = windows.join(kth, ["at", "high"], "left").select("at", F.greatest("low", F.coalesce("_kth", "low")).alias("low"), "high")
            packs = self.packs(raised, f"{name}-packs1")
            met = set(seeds)
            rest = [p for a, c, _ in self.pairs(packs) if (p := (a, c)) not in met]
            if rest:
                found = found.unionByName(self.scratch.save(self.meet(packs, rest, same, k), f"{name}-found1"))
        return self.ranked(found, k)

    def packs(self, windows: DataFrame, name: str) -> DataFrame:
        """Anchors with their windows, a few for each anchor row, in packs."""
        listed = windows.groupBy("at").agg(F.collect_list(F.struct("low", "high")).alias("windows"))
        fields = f"{BLOCK_FIELDS}, asker binary, low binary, high binary, ask_low long, ask_high long"
        return self.scratch.save(self.asking.join(listed, "at").groupBy("acell", "block").applyInPandas(packer(self.trees[1], self.dim, "acell"), fields), name)

    def pairs(self, packs: DataFrame) -> list[tuple[int, int, float]]:
        """At most CELLS * CELLS pairs of cells."""
        asks = {r["cell"]: (r["low"], r["high"]) for r in packs.groupBy("cell").agg(F.min("ask_low").alias("low"), F.max("ask_high").alias("high")).collect()}
        if not self.exact:
            return [(a, c, 0.0) for a in asks for c in self.radii]
        return cell_pairs(Balls(self.trees[1], self.cell_radii(packs), asks), Balls(self.trees[0], self.radii))

    def meet(self, packs: DataFrame, pairs: list[tuple[int, int]], same: bool, k: int) -> DataFrame:
        """Rows (at, high, score, id, cat): what is best of the blocks of these cells, up to `k` rows a window and task."""
        dim, exact = self.dim, self.exact
        sent = F.broadcast(self.scratch.spark.createDataFrame(pairs, "cell long, ccell long"))  # bounded by CELLS * CELLS
        fields = ["ats", "labels", "vectors", "centre", "radius", "asker", "low", "high"]
        asking = packs.join(sent, "cell").join(self.units, "ccell").select("ccell", "unit", F.struct("cell", "block", *fields).alias("pack"))
        held = self.blocks.select(F.col("cell").alias("ccell"), "unit", F.struct("ats", "ids", "labels", "vectors", "centre", "radius").alias("held"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            going: dict[tuple[int, int], Found] = {}

            def done() -> pa.RecordBatch:
                rows = [r for f in going.values() for r in f.rows()]
                going.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["at", "high", "score", "id", "cat"])

            for batch in batches:
                for pack, block in zip(batch.column(0), batch.column(1), strict=True):
                    pack, block = pack.as_py(), block.as_py()
                    key = (pack["cell"], pack["block"])
                    if key not in going:
                        if len(going) >= HELD:
                            yield done()
                        going[key] = Found(pack, k)
                    score_pair(pack, block, going[key], dim, same, exact)
            yield done()

        return asking.join(held.hint("merge"), ["ccell", "unit"]).select("pack", "held").mapInArrow(run, "at long, high long, score long, id long, cat long")

    def ranked(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("at", "high").orderBy(F.desc("score"), "id", "cat")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256,
    id_col: str = "vec_id", label: str = "label", vector: str = "embedding", cells: int = CELLS, block: int = BLOCK, pack: int = PACK,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Components become floor(scale * component); scores are inner products,
    higher first, ties by id. An anchor's positives are its first `positives`
    other rows of its label; for each, the first `negatives` rows of other
    labels whose score lies between `least` percent of the positive's and the
    positive's own.

    Rows whose id or label is null, or whose vector is null or has a null or
    non-finite component, take no part. Shorter vectors count as ending in
    zeros. Rows with one id are rows of their own: each is an anchor, a
    positive or a negative by itself. Components and scores are longs: beyond
    them components saturate and scores wrap. Anchors without positives, or
    positives without negatives, give no rows, nor does an empty table.
    """
    bounded_batches(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    real = F.transform(vectors[vector], lambda x: x.cast("double"))
    sound = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(vectors[id_col].isNotNull() & vectors[label].isNotNull() & vectors[vector].isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("at"), vectors[id_col].cast("long").alias("id"), vectors[label].cast("long").alias("label"),
        F.transform(real, lambda x: F.floor(x * scale)).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    search = Search(rows, scratch, cells, block, pack)
    if not search.anchors:
        return search.rows.where("false").select(*[F.lit(0).cast("int" if c == "rank" else "long").alias(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    everything = search.asking.select("at", F.lit(LOW).cast("long").alias("low"), F.lit(HIGH).cast("long").alias("high"))
    found = scratch.save(search.first(everything, True, positives).select("at", F.col("id").alias("positive_id"), "score", F.col("rank").alias("place")), "positives")
    low = F.ceil(F.col("score").cast("decimal(38,0)") * least / 100).cast("long")
    windows = found.select("at", F.col("score").alias("high"), low.alias("low")).distinct().where("low <= high")
    harder = search.first(scratch.save(windows, "windows"), False, negatives)
    of = search.asking.select("at", F.col("id").alias("anchor_id"))
    return (
        found.join(harder.select("at", "rank", F.col("high").alias("score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["at", "score"])
        .join(of, "at").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
    )
