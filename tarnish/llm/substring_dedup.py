"""Substring dedup by fixed-block anchors.

Reference blocks of `(width + 1) // 2` words, not overlapping, are indexed; every
rolling window of that many words probes them. Any window of `width` words holds
a whole reference block of its own document, and so do its equals elsewhere:
only windows round a block that some other place hits can repeat. Hashes of
blocks and windows only find and order; two windows count as equal if their
words are, within a chunk by the words themselves, across chunks by a 128-bit
BLAKE2b digest of all of them. Those found twice make up, overlapping, the
maximal exact repeats.

Texts travel packed in chunks of a few megabytes. A chunk sends each distinct
hash once to the bucket of its leading bits, with a mark if it has it twice, and
gets one bit back for it: a passage in a third of all documents weighs no more
in a bucket than one row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, filled, shuffle_partitions

#: Bytes of text in a chunk, windows in a bucket, bytes of a digest.
CHUNK, BUCKET, DIGEST = 4 << 20, 1 << 20, 16


class Numbered(dict):
    """Words in the order they first come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ right >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(31)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` values in a row, put together from runs of powers of two."""
    run, size, out, done = words, 1, None, 0
    while True:
        if width & size:
            out = run if out is None else mixed(out[: len(run) - done], run[done:]) if len(run) > done else run[:0]
            done += size
        if done == width:
            return out[: max(len(words) - width + 1, 0)]
        run, size = mixed(run[:-size], run[size:]) if len(run) > size else run[:0], 2 * size


class Chunk:
    """Words and window hashes of the documents packed in a chunk."""

    def __init__(self, body: bytes, lengths: np.ndarray):
        import xxhash

        ends = np.cumsum(lengths).tolist()
        split = [body[a:b].split() for a, b in zip([0, *ends], ends, strict=False)]
        n = np.array([len(x) for x in split], np.int64)
        # Each document's words are self.first[d] : self.first[d + 1].
        self.first = np.concatenate(([0], np.cumsum(n)))
        self.words = [w for x in split for w in x]
        number = Numbered()
        self.number = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[self.number]
        self.place = np.arange(len(self.words)) - np.repeat(self.first[:-1], n)
        self.left = np.repeat(n, n) - self.place

    def windows(self, width: int) -> np.ndarray:
        return np.flatnonzero(self.left >= width)

    def anchors(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rolling windows, their distinct hashes in order, which each has, and flags: 1 reference block, 2 twice."""
        at = self.windows(block)
        keys, which, n = np.unique(rolling(self.hashes, block)[at], return_inverse=True, return_counts=True)
        flags = (2 * (n > 1)).astype(np.uint8)
        flags[which[self.place[at] % block == 0]] |= 1
        return at, keys, which, flags

    def suspects(self, width: int, block: int, hit: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows round a hit reference block; of the distinct ones among them the hashes, in order, and one place; which each is."""
        struck = np.zeros(len(self.words), bool)
        struck[at] = hit[which]
        windows = self.windows(width)
        windows = windows[struck[windows + -self.place[windows] % block]]
        hashes = rolling(self.hashes, width)[windows]
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        several = np.flatnonzero(one[which] != np.arange(len(windows)))
        same = np.ones(len(several), bool)
        for k in range(width):
            same &= self.number[windows[several] + k] == self.number[windows[one[which[several]]] + k]
        if not same.all():  # other words of one hash: told apart by the words
            rows = np.column_stack([hashes.view(np.int64), *(self.number[windows + k] for k in range(width))])
            _, one, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            order = np.argsort(hashes[one], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys, one, which = hashes[one[order]], one[order], place[which]
        return windows, keys, windows[one], which

    def digests(self, at: np.ndarray, width: int) -> bytes:
        """Of all words of the windows at these places, one after another."""
        joined = b" ".join(self.words)
        end = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        start = np.concatenate(([0], end[:-1] + 1))
        return b"".join([blake2b(joined[a:b], digest_size=DIGEST).digest() for a, b in zip(start[at].tolist(), end[at + width - 1].tolist(), strict=True)])


def buckets_of(keys: np.ndarray, buckets: int) -> tuple[list[int], list[int]]:
    """The buckets that sorted keys fall in, and where in the keys each begins, with the end."""
    of = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    return of[begins].tolist(), [*begins.tolist(), len(keys)]


def packed(docs: DataFrame, text: str, id_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks: chunk, ids, lengths (bytes of each text and a line feed), body (compressed)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, part, seq = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        ids, bodies, size = [], [], 0

        def row():
            lengths = np.array([len(b) for b in bodies], np.int64).tobytes()
            columns = [pa.array([part << 32 | seq], pa.int64()), pa.array([ids], pa.list_(id_kind)), pa.array([lengths], pa.binary()), pa.array([zip_.compress(b"".join(bodies))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "lengths", "body"])

        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = t.as_py().encode("utf-8", "replace") + b"\n"
                ids.append(i)
                bodies.append(raw)
                size += len(raw)
                if size >= chunk_bytes:
                    yield row()
                    ids, bodies, size, seq = [], [], 0, seq + 1
        if bodies:
            yield row()

    return docs.select(docs[id_col], filled(docs[text])).mapInArrow(run, f"chunk long, ids array<{id_type}>, lengths binary, body binary")


def opened(row: dict) -> Chunk:
    import zstandard

    return Chunk(zstandard.ZstdDecompressor().decompress(row["body"]), np.frombuffer(row["lengths"], np.int64))


def bits_of(row: dict, name: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    """One bit per distinct hash of the chunk, from the answers of the buckets."""
    held, bounds = buckets_of(keys, buckets)
    span = {b: (bounds[k], bounds[k + 1]) for k, b in enumerate(held)}
    out = np.zeros(len(keys), bool)
    for answer in row[name] or []:
        lo, hi = span[answer["bucket"]]
        out[lo:hi] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=hi - lo)
    return out


def answers(sent: DataFrame, flagged: bool) -> DataFrame:
    """(chunk, list of bucket and bits): for each hash sent, whether it stands in two places (and, `flagged`, in a reference block)."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        width = 1 if flagged else DIGEST // 4
        keys = np.frombuffer(b"".join(rows["keys"]), np.uint32).reshape(-1, width)
        flags = np.frombuffer(b"".join(rows["flags"]), np.uint8)
        order = np.lexsort(keys.T)
        new = (np.diff(keys[order], axis=0) != 0).any(axis=1)
        group = np.concatenate(([0], np.cumsum(new)))
        twice = np.bincount(group, 1 + (flags[order] >> 1)) >= 2
        if flagged:
            twice &= np.bincount(group, flags[order] & 1) >= 1
        found = np.empty(len(keys), bool)
        found[order] = twice[group]
        ends = np.cumsum([len(x) for x in rows["flags"]])
        bits = [np.packbits(found[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": bits})

    met = sent.groupBy("bucket").applyInPandas(meet, "chunk long, bucket long, bits binary")
    return met.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def remove_repeats(docs: DataFrame, width: int = 35, text: str = "text", id_col: str = "doc_id", chunk_bytes: int = CHUNK, bucket_windows: int = BUCKET) -> DataFrame:
    """One row per row of `docs`: its id, n_words (long), removed and kept.

    removed: array of (start, end), word ranges, end exclusive, that are covered
    by windows of `width` words whose sequence also starts anywhere else; kept:
    the other words, joined by one space. Only id and text are read. Null text
    has no words; repeated rows are copies of one another; null ids are
    ordinary. An empty table gives no rows.
    """
    spark, block = docs.sparkSession, (width + 1) // 2
    bounded_batches(spark)
    scratch = Scratch(spark, "substring")
    chunks = scratch.save(packed(docs, text, id_col, chunk_bytes), "chunks")
    size = chunks.agg(F.sum(F.octet_length("lengths")).alias("rows"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-(size["n"] or 0) * chunk_bytes // (6 * bucket_windows)), shuffle_partitions(spark) if size["n"] and size["n"] > 8 else 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.select([c for c in batch.schema.names if c != "ids"]).slice(k, 1).to_pylist()[0]
                yield row | ({"ids": batch["ids"][k].values} if "ids" in batch.schema.names else {})

    def sent(chunk: int, hashes: np.ndarray, keys: bytes, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each distinct hash, in order, its key and flags, to the bucket of the hash."""
        held, bounds = buckets_of(hashes, buckets)
        cut = lambda x, n: pa.array([x[n * a : n * b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
        columns = [pa.array(held, pa.int64()), pa.array([chunk] * len(held), pa.int64()), cut(keys, len(keys) // max(len(hashes), 1)), cut(flags.tobytes(), 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "keys", "flags"])

    def probe(batches):
        for row in rows(batches):
            _, keys, _, flags = opened(row).anchors(block)
            yield from sent(row["chunk"], keys, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), flags)

    def suspects(row, chunk):
        at, keys, which, _ = chunk.anchors(block)
        return chunk.suspects(width, block, bits_of(row, "hits", keys, buckets), at, which)

    def extend(batches):
        for row in rows(batches):
            chunk = opened(row)
            _, keys, one, which = suspects(row, chunk)
            n = np.bincount(which, minlength=len(keys))
            yield from sent(row["chunk"], keys, chunk.digests(one, width), (2 * (n > 1)).astype(np.uint8))

    def clear(batches):
        for row in rows(batches):
            chunk = opened(row)
            windows, keys, _, which = suspects(row, chunk)
            windows = windows[bits_of(row, "repeats", keys, buckets)[which]]
            change = np.zeros(len(chunk.words) + 1, np.int64)
            change[windows] += 1
            change[windows + width] -= 1
            gone = np.cumsum(change[:-1]) > 0
            spans, texts = [], []
            for a, b in zip(chunk.first.tolist(), chunk.first[1:].tolist(), strict=False):
                own, words = gone[a:b], chunk.words[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).view(np.int8)))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2], strict=True)])
                texts.append(b" ".join(compress(words, ~own) if len(edge) else words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(np.diff(chunk.first), pa.int64()), pa.array(spans, span_kind), pa.array(texts, pa.string())], names=[id_col, "n_words", "removed", "kept"])

    id_type = docs.schema[id_col].dataType
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    keyed = "bucket long, chunk long, keys binary, flags binary"
    hits = scratch.save(answers(chunks.select("chunk", "lengths", "body").mapInArrow(probe, keyed), True).withColumnRenamed("answers", "hits"), "hits")
    seen = chunks.select("chunk", "lengths", "body").join(hits, "chunk", "left")
    repeats = scratch.save(answers(seen.mapInArrow(extend, keyed), False).withColumnRenamed("answers", "repeats"), "repeats")
    seen = chunks.join(hits, "chunk", "left").join(repeats, "chunk", "left")
    return seen.mapInArrow(clear, f"`{id_col}` {id_type.simpleString()}, n_words long, removed array<struct<start:int,end:int>>, kept string")
