"""Best-fit packing of token sequences by linear grouping.

Only the number of pieces of each length decides the plan, and there are at most
`capacity` lengths, so the plan is made on the driver from that histogram and
its size has a bound that no input exceeds. Large lengths are rounded up within
groups of equal cardinality, configurations of the few rounded sizes optimised
by column generation, actual pieces substituted, and what is left, small pieces
first of all, put best-fit into the gaps. Ranges of ranks within a length are
then looked up by each piece where it lies.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, filled, ranked

#: Rounded sizes at most, and the part of a sequence beyond which a piece is large.
#: What rounding leaves open is filled by small pieces, so enough must count as small.
GROUPS, LARGE = 32, 3
#: Words, and pieces of words, whose ids a Python worker remembers: some 150 MB.
WORDS_KEPT, PIECES_KEPT = 250_000, 500_000
#: Fixed value: how the tokenizer cuts text into the pieces that its merges work on.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_known: dict[str, Words] = {}


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Ids of words (UTF-8) as little-endian unsigned 32-bit numbers, found when first asked for.

    The tokenizer never joins characters across ASCII white space, so words are
    looked up one by one. Words of printable Latin-1 characters, which its
    normaliser only lower-cases, are cut into pieces and these given to its
    merge model; for any other word the whole tokenizer is asked.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pieces = self.tokenizer.model, {}
        told = json.loads(self.tokenizer.to_str())
        steps, cut = (told.get("normalizer") or {}).get("normalizers", []), (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        same = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and len(cut) == 2 and cut[0].get("pattern") == {"Regex": PIECE} and cut[1]["type"] == "ByteLevel"
        self.cut = regex.compile(PIECE).findall if same else None
        self.plain = regex.compile(r"[!-~\xa1-\xff]+").fullmatch
        # Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        text = word.decode()
        if self.cut and "<|" not in text and self.plain(text):
            ids = b"".join([self.piece(p) for p in self.cut(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= PIECES_KEPT:
                self.pieces.clear()
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
            ids = self.pieces[piece] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids


def token_bytes(texts: Iterable[str], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    if path not in _known:
        _known[path] = Words(path)
    known = _known[path]
    for text in texts:
        yield b"".join(map(known.__getitem__, text.encode("utf-8", "replace").split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]) of every document.

    A document is its ids and `end_id`; only those longer than `capacity` are
    cut. Null text counts as empty: one piece, `end_id` alone.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, raw in enumerate(token_bytes((t.as_py() for t in batch.column(1)), tokenizer)):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    source.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(docs[id_col], filled(docs[text])).mapInArrow(cut, schema)


@dataclass
class Plan:
    """Where the pieces of each length go: arrays with one entry per range of ranks.

    Pieces of `length` with ranks from `first` on fill sequences from `sequence`
    on, `each` to a sequence, the first of them at `offset`.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank within the length."""
        key = self.length.astype(np.int64) << 44 | self.first
        k = np.searchsorted(key, length.astype(np.int64) << 44 | rank, side="right") - 1
        over = rank - self.first[k]
        return self.sequence[k] + over // self.each[k], self.offset[k] + over % self.each[k] * length


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns of the sizes and how often each is used: the least sum that meets the demand, by column generation."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(m)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = cost @ inverse
        worst = int(np.argmin(prices))
        if prices[worst] < -1e-9:
            column, price = -np.eye(m)[worst], 0.0  # more of this size than asked for
        else:
            column, value = knapsack(sizes, prices, capacity)
            if value <= 1 + 1e-9:
                break
            price = 1.0
        step, held = inverse @ column, inverse @ demand
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, held / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], cost[out] = column, price
    used = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(int), float(used[i])) for i in range(m) if cost[i] and used[i] > 1e-9]


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern of highest price that fits, any number of each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g, (s, p) in enumerate(zip(sizes, prices, strict=True)):
        if p <= 0:
            continue
        for at in range(s, capacity + 1, s):
            end = min(at + s, capacity + 1)
            tried = best[at - s : end - s] + p
            better = tried > best[at:end] + 1e-12
            best[at:end][better], last[at:end][better] = tried[better], g
    column, room = np.zeros(len(sizes)), capacity
    while last[room] >= 0:
        column[last[room]] += 1
        room -= int(sizes[last[room]])
    return column, float(best[capacity])


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """A packing of so many pieces of each length."""
    taken = dict.fromkeys(counts, 0)
    records: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        records.append((length, taken[length], sequence, each, offset))
        taken[length] += n

    def free(room: int, sequence: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((sequence, n))

    large = sorted((x for x in counts if x > capacity // LARGE), reverse=True)
    n_large = sum(counts[x] for x in large)
    if n_large:
        # Equal cardinality: of the sizes in falling order, each run of `each` is rounded up to its first.
        each = -(-n_large // GROUPS)
        runs: list[tuple[int, list[tuple[int, int]]]] = []
        seen = 0
        for x in large:
            left = counts[x]
            while left:
                if seen % each == 0 and (not runs or runs[-1][0] != x):
                    runs.append((x, []))
                n = min(left, each - seen % each)
                members = runs[-1][1]
                if members and members[-1][0] == x:
                    members[-1] = (x, members[-1][1] + n)
                else:
                    members.append((x, n))
                seen, left = seen + n, left - n
        sizes, demand = np.array([s for s, _ in runs]), np.array([float(sum(n for _, n in ms)) for _, ms in runs])
        queues = [list(reversed(ms)) for _, ms in runs]
        for pattern, often in configurations(sizes, demand, capacity):
            bins = int(often + 1e-6)
            # What each place of the pattern gets: actual lengths, in runs over the bins.
            if not bins:
                continue
            columns = []
            for g, copies in enumerate(pattern):
                for _ in range(copies):
                    column, need = [], bins
                    while need and queues[g]:
                        x, n = queues[g].pop()
                        got = min(n, need)
                        column.append((x, got))
                        need -= got
                        if n > got:
                            queues[g].append((x, n - got))
                    columns.append(column)
            borders = sorted({0, bins, *(b for c in columns for b in np.cumsum([n for _, n in c]).tolist())})
            at = [0] * len(columns)
            used = [0] * len(columns)
            for lo, hi in zip(borders, borders[1:], strict=False):
                offset = 0
                for c, column in enumerate(columns):
                    if at[c] < len(column):
                        x, n = column[at[c]]
                        put(x, hi - lo, sequences + lo, 1, offset)
                        offset += x
                        used[c] += hi - lo
                        if used[c] == n:
                            at[c], used[c] = at[c] + 1, 0
                free(capacity - offset, sequences + lo, hi - lo)
            sequences += bins

    for x in sorted(counts, reverse=True):
        left = counts[x] - taken[x]
        while left:
            k = bisect.bisect_left(rooms, x)
            if k == len(rooms):
                n = -(-left // (capacity // x))
                free(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[k]
            sequence, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[k]
            each = room // x
            full = min(n, left // each)
            if full:
                put(x, full * each, sequence, each, capacity - room)
                free(room - each * x, sequence, full)
                left -= full * each
            if full < n and 0 < left < each:
                put(x, left, sequence + full, left, capacity - room)
                free(room - left * x, sequence + full, 1)
                full, left = full + 1, 0
            free(room, sequence + full, n - full)
    records.sort()
    table = np.array(records, np.int64).reshape(-1, 5).T
    return Plan(*table, sequences=sequences)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with its place: sequence_id and offset.

    Columns: the id, piece (int, from 0), start, length, ids_crc32 (of the ids
    as little-endian unsigned 32-bit numbers), with `with_ids` the ids
    themselves, sequence_id (from 0) and offset (gapless from 0 in a sequence).
    Only id and text are read. Null text counts as empty and is packed as
    `end_id` alone; repeated or null ids are ordinary documents; pieces equal in
    all columns share their places in any order. An id column of the name of
    another column of the result comes back with `_id` added. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    if id_col in ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"):
        docs, id_col = docs.select(docs[id_col].alias(f"{id_col}_id"), docs[text].alias("_text")), f"{id_col}_id"
        text = "_text"
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer, capacity, end_id, text, id_col, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = spark.sparkContext.broadcast(plan(counts, capacity))
    placed = ranked(cut, ["length"], [F.col(id_col), F.col("piece")], scratch, "ranks")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sequence, offset = made.value.find(table["length"].to_numpy(), table["_rank"].to_numpy())
            table = table.drop_columns("_rank").append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from table.to_batches()

    order = [*cut.columns, "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return placed.select(*order).mapInArrow(find, schema)
