"""Near-dedup for the pipeline: SimHash candidates, confirmed by Jaccard similarity.

The vantage-point trees of `simhash`, at a wider reach than two bits, link the
fingerprints of texts that may be alike. Candidates are confirmed on the sets of
word shingles of the two texts, in three rounds. The first takes enough links to
connect all that are near, about one a fingerprint and tree, however large a
group of copies: that joins most. A link that fails may have stood for others
that hold, so the others look at every pair within reach whose texts are not
joined yet. A bound on the similarity, from sketches of the sets, rules out
most of these for certain. Of what it leaves, the second round takes the likeliest
pairs that connect all, a few for each group in a shard, and the third all
that are still apart. These are no pairs in a table: a shard hands on blocks of
texts among which such pairs are, a block's texts come once, and are
compared where they meet. Components of what is confirmed are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, filled
from .simhash import ALL, BLOCK, MOST, SHARD, components, distance, fingerprints, links, parts, sharded, unite

#: Texts of each side that are compared in one place, about.
SIDE = 512
#: Bits of a sketch, at least and at most.
LEAST_BITS, MOST_BITS = 512, 16_384


def shingles(text: str, width: int) -> list[bytes]:
    """All runs of `width` words, ASCII letters in lower case; a shorter text is one."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < width:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def jaccard(a: str, b: str, width: int) -> float:
    x, y = set(shingles(a, width)), set(shingles(b, width))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts are as similar as `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [jaccard(x.as_py(), y.as_py(), width) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("_text").alias(f"_{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.select("a", "b", "_a", "_b").mapInArrow(run, "a binary, b binary")


def fingerprint_pairs(marked: DataFrame, fps: DataFrame, shards: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b) of nodes: for each fingerprint one node with each other of it, and across those that the trees link."""
    same = marked.select("fp", F.col("node").alias("b")).join(fps.hint("merge"), "fp").where("a <> b").select("a", "b")
    tied = links(shards, reach).distinct()
    other = lambda c, n: fps.select(F.col("fp").alias(c), F.col("a").alias(n)).hint("merge")
    tied = tied.join(other("a", "x"), "a").join(other("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(tied).distinct()


def sketch(held: set[bytes]) -> bytes:
    """How often members of a set fall on each of some bits, odd or even: four to eight bits a member, within limits.

    Two sketches differ in what the sets do not share, so in no more bits than
    the sets have members that are in one alone.
    """
    import xxhash

    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(held) - 1).bit_length()))
    at = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """Texts (node, _text) as (node, size, sketch): members of their set of shingles, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set(shingles(t.as_py(), width)) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "sketch"])

    return texts.select("node", "_text").mapInArrow(run, "node binary, size long, sketch binary")


class Bound:
    """Of sets with sketches, how far apart two are at least, against what a similarity of `least` allows."""

    def __init__(self, size: np.ndarray, sketches: list[bytes], least: float):
        self.size, self.share = size, (1 - least) / (1 + least)
        self.bytes = np.array([len(x) for x in sketches])
        self.place = np.zeros(len(sketches), np.int64)
        self.at = {}  # rows of sketches of one length
        for n in np.unique(self.bytes).tolist():
            own = np.flatnonzero(self.bytes == n)
            self.place[own] = np.arange(len(own))
            self.at[n] = np.frombuffer(b"".join([sketches[k] for k in own]), np.uint64).reshape(len(own), n // 8)

    def rows(self, index: np.ndarray, n: int) -> np.ndarray:
        """Sketches of sets as they are with n bytes; a longer one is folded."""
        out = np.zeros((len(index), n // 8), np.uint64)
        for m in np.unique(self.bytes[index]).tolist():
            own = self.bytes[index] == m
            out[own] = np.bitwise_xor.reduce(self.at[m][self.place[index[own]]].reshape(-1, m // n, n // 8), axis=1)
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs i[k], j[k] a lower bound of their difference over what is allowed; beyond 1 they are surely too far apart."""
        out, common = np.zeros(len(i)), np.minimum(self.bytes[i], self.bytes[j])
        for n in np.unique(common).tolist():
            of = np.flatnonzero(common == n)
            for own in np.split(of, range((8 << 20) // n, len(of), (8 << 20) // n)):
                out[own] = np.bitwise_count(self.rows(i[own], n) ^ self.rows(j[own], n)).sum(axis=1, dtype=np.int64)
        if self.share < 0:
            return np.full(len(i), np.inf)
        # Half a member of slack: differences are whole, so rounding decides nothing.
        return np.maximum(out, np.abs(self.size[i] - self.size[j])) / (self.share * (self.size[i] + self.size[j]) + 0.5)


def apart(fps: np.ndarray, group: np.ndarray, mask: int, free: int, reach: int, bound: Bound) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (indices, indices, bounds) of different groups within reach that agree on `mask`, but those that `bound` rules out; few at once.

    Without a mask all fingerprints are equal; with one, pairs of equal
    fingerprints are left out. A pair that agrees on an earlier part of the bits
    is left to that part's tree. Pairs of the largest group are those of the
    others with it.
    """
    tops = parts(ALL, reach + 1)
    earlier = tops[: tops.index(mask)] if mask in tops else []
    largest = np.bincount(group).argmax()
    values, value = np.unique(fps, return_inverse=True)  # trees cut distinct fingerprints only
    order = np.argsort(value, kind="stable")
    starts = np.searchsorted(value[order], np.arange(len(values) + 1))
    at = lambda index: np.concatenate([order[starts[k] : starts[k + 1]] for k in index])
    other = np.zeros(len(values), bool)
    other[value[group != largest]] = True
    lowest, highest = np.full(len(values), len(fps)), np.zeros(len(values), np.int64)
    np.minimum.at(lowest, value, group)
    np.maximum.at(highest, value, group)

    def met(own: np.ndarray, every: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own, every = at(own), at(every)
        own = own[group[own] != largest]
        for x in np.split(own, range(BLOCK, len(own), BLOCK)):
            for y in np.split(every, range(16 * BLOCK, len(every), 16 * BLOCK)):
                d = distance(fps[x, None], fps[None, y])
                near = (d <= reach) & (group[x, None] != group[None, y]) & ((d > 0) if mask_given else True)
                near &= (group[None, y] == largest) | (x[:, None] < y[None, :])
                for part in earlier:
                    near &= ((fps[x, None] ^ fps[None, y]) & np.uint64(part)) != 0
                i, j = np.nonzero(near)
                i, j = x[i], y[j]
                far = bound(i, j)
                if (kept := far <= 1).any():
                    yield i[kept], j[kept], far[kept]

    mask_given, everything = mask != 0, np.arange(len(values))
    if not mask_given:
        yield from met(everything, everything)
        return
    stack = [(np.flatnonzero(other), everything, mask, free)]
    while stack:
        own, every, mask, free = stack.pop()
        if not len(own) or len(every) < 2 or lowest[every].min() == highest[every].max():
            continue
        if len(own) * len(every) <= BLOCK * BLOCK:
            yield from met(own, every)
            continue
        bits, v = np.uint64(mask), values[own[len(own) // 2]]
        d, own_d = (distance(values[x] & bits, v & bits) for x in (every, own))
        if d.max() == 0:
            free &= ~mask
            further = parts(free, reach + 1)
            if 2 * sum(meetings(values[own] & np.uint64(x), values[every] & np.uint64(x)) for x in further) > len(own) * len(every):
                yield from met(own, every)  # so dense that to cut it further would take longer
            else:
                stack += [(own, every, part, free) for part in further]
            continue
        radius = min(int(np.median(own_d)), int(d.max()) - 1)
        stack += [(own[own_d <= radius], every[d <= radius], mask, free), (own[own_d > radius], every[d > radius], mask, free)]


def meetings(a: np.ndarray, b: np.ndarray) -> int:
    """How many pairs of a value of the first and one of the second are equal."""
    b = np.sort(b)
    return int((np.searchsorted(b, a, "right") - np.searchsorted(b, a)).sum())


def likeliest(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], group: np.ndarray, times: int = 8, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs enough to connect the groups that they connect, those of the smallest bounds first, and so on with the rest, so many times."""

    def thinned(pile: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, far = (np.concatenate(x) for x in zip(*pile, strict=True))
        order = np.argsort(far, kind="stable")
        i, j, far = i[order], j[order], far[order]
        kept = np.zeros(len(i), bool)
        for _ in range(times):
            root, left = np.arange(group.max() + 1), np.flatnonzero(~kept)
            while len(left := left[root[group[i[left]]] != root[group[j[left]]]]):
                one = left[np.unique(np.maximum(root[group[i[left]]], root[group[j[left]]]), return_index=True)[1]]
                kept[one] = True
                unite(root, group[i[one]], group[j[one]])
        return i[kept], j[kept], far[kept]

    pile, n = [(group[:0], group[:0], np.zeros(0))], 0
    for pairs in found:
        pile.append(pairs)
        n += len(pairs[0])
        if n > most:
            pile = [thinned(pile)]
            n = 0
    return thinned(pile)[:2]


def untried(shards: DataFrame, entries: DataFrame, reach: int, least: float, blocks: bool) -> DataFrame:
    """Pairs within reach of texts that are not joined, but for those that sketches rule out; entries are (fp, node, root, size, sketch).

    All of them, as rows (key, n, side, fp, root, node) of blocks among which
    they are, or as pairs (a, b) those that connect all that they connect in a
    shard.
    """

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "mask"], ignore_index=True)
        key, mask, free, fps = (rows[c].to_numpy().view(np.uint64) for c in ("key", "mask", "free", "fp"))
        group = pd.factorize(rows["root"])[0]
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (mask[1:] != mask[:-1])) + 1).tolist(), len(key)]
        out = [np.zeros((0, 4 if blocks else 2), np.int64)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo < 2 or (group[lo:hi] == group[lo]).all():
                continue
            own = np.unique(group[lo:hi], return_inverse=True)[1]
            bound = Bound(rows["size"].to_numpy()[lo:hi], rows["sketch"].tolist()[lo:hi], least)
            found = apart(fps[lo:hi], own, int(mask[lo]), int(free[lo]), reach, bound)
            if not blocks:
                out.append(np.stack(likeliest(found, own), axis=1) + lo)
                continue
            for n, (i, j, _) in enumerate(found):
                for side, at in enumerate((np.unique(i), np.unique(j))):
                    out.append(np.stack([np.full(len(at), lo), np.full(len(at), n), np.full(len(at), side), at + lo], axis=1))
        if not blocks:
            a, b = np.concatenate(out).T
            return pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})
        at, n, side, row = np.concatenate(out).T
        return pd.DataFrame({"key": rows["key"].to_numpy()[at], "n": n, "side": side, "fp": rows["fp"].to_numpy()[row], "root": root[row], "node": node[row]})

    schema = "key long, n long, side long, fp long, root binary, node binary" if blocks else "a binary, b binary"
    groups = max(1, -(-entries.count() * (reach + 1) // (SHARD // 16)))
    own, other = F.pmod(F.xxhash64("node"), "cut").cast("int"), F.col("_other")
    sent = shards.join(entries.hint("merge"), "fp").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    sent = sent.withColumn("key", F.when(F.col("cut") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(own, other), F.greatest(own, other))))
    sent = sent.drop("cut", "_other").withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return sent.groupBy("_group").applyInPandas(meet, schema)


def cells(shards: DataFrame, nodes: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """Shards (key, mask, free, fp, cut) of the fingerprints of `nodes` (node, fp), and one for each fingerprint of several.

    One with more than `most` nodes has a cut: any two of so many parts of it are to meet.
    """
    per_fp = scratch.save(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "per-fp")
    none = F.lit(0).cast("long")
    equal = per_fp.where("n > 1").select(F.xxhash64("fp").alias("key"), none.alias("mask"), none.alias("free"), "fp", "n")
    every = scratch.save(shards.join(per_fp.hint("merge"), "fp").select("key", "mask", "free", "fp", "n").unionByName(equal), "shards-of-nodes")
    large = every.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    large = scratch.save(large.select("key", F.ceil(2 * F.col("n") / most).cast("int").alias("cut")), "cuts")
    return every.drop("n").join(large, "key", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))


def compared(blocks: DataFrame, texts: DataFrame, width: int, least: float, reach: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join what blocks (key, n, side, fp, root, node) hold of similar texts; texts are (node, _text).

    A block with many texts is cut on both sides, and each part of one side
    meets each of the other.
    """
    nodes = scratch.save(blocks, "block-nodes")
    sizes = nodes.groupBy("key", "n").agg(*[F.ceil(F.count_if(F.col("side") == k) / SIDE).cast("int").alias(f"_parts{k}") for k in (0, 1)])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("_parts0")).otherwise(F.col("_parts1"))).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    sent = nodes.join(sizes.hint("merge"), ["key", "n"]).withColumn("_own", own)
    sent = sent.withColumn("_other", F.explode(F.when(F.col("side") == 0, all_of("_parts1")).otherwise(all_of("_parts0"))))
    place = F.when(F.col("side") == 0, F.struct(F.col("_own").alias("i"), F.col("_other").alias("j"))).otherwise(F.struct(F.col("_other").alias("i"), F.col("_own").alias("j")))
    sent = scratch.save(sent.select(F.xxhash64("key", "n", place).alias("key"), "side", "fp", "root", "node"), "block-parts")
    groups = max(1, -(-sent.count() // (8 * SIDE)))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in rows.groupby("key", sort=False):
            found += similar(part, width, least, reach)
        return pd.DataFrame(found, columns=["a", "b"])

    whole = sent.join(texts.hint("merge"), "node").withColumn("_group", F.pmod("key", F.lit(groups)))
    return whole.groupBy("_group").applyInPandas(verify, "a binary, b binary")


def shared(sides: list[list[set[bytes]]], step: int = 8192) -> np.ndarray:
    """How many members each set of the first list has in common with each of the second."""
    both = set().union(*sides[0]) & set().union(*sides[1])
    column = {x: k for k, x in enumerate(both)}
    places = []
    for sets in sides:
        at = [np.fromiter((column[x] for x in own if x in column), np.int64) for own in sets]
        rows, columns = np.repeat(np.arange(len(sets)), [len(x) for x in at]), np.concatenate([np.zeros(0, np.int64), *at])
        order = np.argsort(columns, kind="stable")
        places.append((rows[order], columns[order]))
    counts = np.zeros((len(sides[0]), len(sides[1])), np.float32)  # exact below 2^24
    for lo in range(0, len(column), step):
        blocks = []
        for (rows, columns), sets in zip(places, sides, strict=True):
            i, j = np.searchsorted(columns, [lo, lo + step])
            block = np.zeros((len(sets), min(step, len(column) - lo)), np.float32)
            block[rows[i:j], columns[i:j] - lo] = 1
            blocks.append(block)
        counts += blocks[0] @ blocks[1].T
    return counts.astype(np.int64)


def similar(part: pd.DataFrame, width: int, least: float, reach: int) -> list[tuple[bytes, bytes]]:
    """Of the texts of two sides as many similar pairs as join what they join."""
    sides = [part[part["side"] == k] for k in (0, 1)]
    nodes, roots = [x["node"].tolist() for x in sides], pd.factorize(pd.concat([x["root"] for x in sides]))[0]
    code = [roots[: len(nodes[0])], roots[len(nodes[0]) :]]
    fps = [x["fp"].to_numpy(np.int64).view(np.uint64) for x in sides]
    near = (distance(fps[0][:, None], fps[1][None, :]) <= reach) & (code[0][:, None] != code[1][None, :])
    if not near.any():
        return []
    sets = [[set(shingles(t, width)) for t in x["_text"]] for x in sides]
    sizes = [np.array([len(s) for s in own]) for own in sets]
    both = shared(sets)
    alike = near & (both / (sizes[0][:, None] + sizes[1][None, :] - both) >= least)
    i, j = np.nonzero(alike)
    root = np.arange(roots.max() + 1)
    found = []
    while len(i):  # one pair for each two groups that are still apart
        apart_ = root[code[0][i]] != root[code[1][j]]
        i, j = i[apart_], j[apart_]
        one = np.unique(np.maximum(root[code[0][i]], root[code[1][j]]), return_index=True)[1]
        found += [(nodes[0][x], nodes[1][y]) for x, y in zip(i[one], j[one], strict=True)]
        unite(root, code[0][i[one]], code[1][j[one]])
    return found


def stars_of(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of all nodes of the edges, roots included."""
    stars = components(edges, Scratch(scratch.spark, f"near-components{name}"))
    return scratch.save(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), f"stars{name}")


def drop_near(docs: DataFrame, width: int = 5, least: float = 0.8, reach: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` with its own columns, one text of each component of similar texts: that of the smallest id.

    Texts are linked if their fingerprints are linked by at most `reach` bits and
    the Jaccard similarity of their sets of `width` words in a row is at least
    `least`; all pairs within reach are held against that. Rows count by their text, whatever their ids: equal texts stay or go
    together; among equal ids, or where none has an id, one text stays. Null
    text counts as empty; texts without words are alike. An empty table gives no
    rows.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    node = F.unhex(F.substring(F.sha2(filled(docs[text]), 256), 1, 32))
    rows = docs.select(node.alias("node"), docs[id_col].alias("_id"), filled(docs[text]).alias("_text"))
    marked = scratch.save(fingerprints(rows, "_text", width), "fingerprints")
    fps = scratch.save(marked.groupBy("fp").agg(F.min("node").alias("a")), "fps")
    shards = sharded(fps.select("fp"), reach, scratch)
    pairs = scratch.save(fingerprint_pairs(marked, fps, shards, reach), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # Each fingerprint within reach of another has a link, so the texts of all candidates are among these.
    texts = scratch.save(rows.select("node", "_text").join(asked.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "texts")
    edges = scratch.save(confirmed(pairs, texts, width, least), "edges")
    members = marked.select("node", "fp").distinct().join(asked.hint("merge"), "node", "left_semi")
    members = scratch.save(members.join(sketched(texts, width).hint("merge"), "node"), "members")
    shards = scratch.save(cells(shards, members, scratch), "shards-of-members")

    def entries(name: str) -> DataFrame:
        stars = stars_of(edges, scratch, name)
        return scratch.save(members.join(stars.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), f"entries{name}")

    likely = scratch.save(untried(shards, entries("1"), reach, least, blocks=False).distinct(), "likely")
    edges = scratch.save(edges.unionByName(confirmed(likely, texts, width, least)), "edges2")
    blocks = untried(shards, entries("2"), reach, least, blocks=True)
    edges = scratch.save(edges.unionByName(compared(blocks, texts, width, least, reach, scratch)), "edges3")
    if edges.isEmpty():
        return docs
    stars = stars_of(edges, scratch, "3")
    named = marked.select("node", "_id").join(stars.hint("merge"), "node")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("nameless"), F.col("_id").alias("id"), F.col("node").alias("node"))).alias("best"))
    gone = scratch.save(stars.join(best.hint("merge"), "root").where(F.col("node") != F.col("best.node")).select(F.col("node").alias("_gone")), "gone")
    return docs.join(gone.hint("merge"), node == gone["_gone"], "left_anti").select(*[docs[c] for c in docs.columns])
