"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Text is cut into pieces as the tokenizer cuts it; within a piece the merges
decide. How far a byte that is still to come can change tokens already seen has
a bound that the merge list alone gives (`sufficient_lookahead`). So the
transducer holds that many bytes and a step, emits each token once it is
stable, and needs the same memory for a piece of any length. The decoder is a
state machine from bytes to text that holds at most three bytes of an
unfinished character.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import bounded_batches, filled

#: Bytes that a transducer takes in at a time; characters and ids that are handled together.
STEP, SLAB = 1024, 1 << 16
#: Entries remembered by a Python worker, and the longest unit (characters) remembered.
KEPT, SHORT = 500_000, 48
#: Characters of Unicode's White_Space, and how byte-level tokenizers cut a text into pieces (here over ASCII).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: A white-space character goes with the word behind it; all before it in a run stand alone. No piece crosses from one unit to the next.
UNIT = re.compile(rf"[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])")
SEAM = re.compile(rf"[^{WHITE}](?=[{WHITE}][^{WHITE}])")
_known: dict[str, Merges] = {}


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: its own where printable, the others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes behind a token's end after which nothing that follows can change it.

    Take two texts with a common beginning and apply the merges in order to
    both. The agreed tokens can lose their last one, `a`, only by a rule (a, b)
    whose `b` stands where they differ; what a later rule (c, d) then takes
    has a `d` that grew from that very `a`, so `a` lies on the left edge of
    d's merges. The longest such chain of rules, in bytes of what is lost, is
    the bound. Each part must come from earlier rules, which makes the order
    of rules the order of merging.
    """
    grown: dict[str, str] = {}
    chains: dict[str, int] = {}
    longest = 0
    for a, b in merges:
        behind, edge = 0, b
        while edge:
            behind = max(behind, chains.get(edge, 0))
            edge = grown.get(edge, "")
        chains[a] = max(chains.get(a, 0), len(a) + behind)
        longest = max(longest, chains[a])
        grown[a + b] = a
    return longest


class Merges:
    """A byte-level BPE tokenizer file, read for the transducer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or told.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        rules = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        alphabet, vocab = byte_alphabet(), model["vocab"]
        made = set(alphabet)
        for a, b in rules:
            if a not in made or b not in made or a + b in made:
                raise ValueError(f"{path} has a rule whose parts no earlier rule makes")
            made.add(a + b)
        self.lookahead = sufficient_lookahead(rules)
        self.longest = max(map(len, made))
        self.rules = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(rules)}
        self.product = [vocab[a + b] for a, b in rules]
        self.of_byte = [0] * 256
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in told.get("added_tokens") or []}
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens") or []):
            raise ValueError(f"{path} has added tokens that take in what stands round them")
        self.bytes_of |= {i: c.encode() for c, i in added.items()}
        self.added, self.apart = added, re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.classes, self.units, self.pieces = Classes(self.cutter), Units(self), {}

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece, by a transducer of its own."""
        found = self.pieces.get(data)
        if found is None:
            run = Transducer(self)
            found = tuple(chain.from_iterable([*(run.feed(data[at : at + STEP]) for at in range(0, len(data), STEP)), run.end()]))
            if len(data) <= SHORT:
                if len(self.pieces) >= KEPT:
                    self.pieces.clear()
                self.pieces[data] = found
        return found

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a unit: its pieces are found over stand-ins of the same class."""
        cut = text if text.isascii() else text.translate(self.classes)
        return tuple(chain.from_iterable([self.piece(text[m.start() : m.end()].encode("utf-8", "replace")) for m in PIECE.finditer(cut)]))

    def merged(self, data: bytes) -> list[int]:
        """All merges over a few bytes."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 64:
            return self.merged_by_heap(ids)
        rules = self.rules
        ranks = [rules.get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < NONE:
            k = ranks.index(least)
            ids[k] = new = self.product[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rules.get(ids[k - 1] << 32 | new, NONE)
            if k < len(ranks):
                ranks[k] = rules.get(new << 32 | ids[k + 1], NONE)
        return ids

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same, in time n log n; a merged token stands at its first byte, -1 at the others."""
        rules, n = self.rules, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = lambda k: rules.get(ids[k] << 32 | ids[after[k]], NONE) if k >= 0 and ids[k] >= 0 and after[k] >= 0 else NONE
        due = [(rank(k), k) for k in range(n - 1) if rank(k) < NONE]
        heapq.heapify(due)
        while due:
            least, k = heapq.heappop(due)
            if rank(k) != least:
                continue
            right = after[k]
            ids[k], ids[right], after[k] = self.product[least], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for at in (before[k], k):
                if rank(at) < NONE:
                    heapq.heappush(due, (rank(at), at))
        return [i for i in ids if i >= 0]


#: The rank of a pair that no rule merges.
NONE = 1 << 60


class Transducer:
    """Takes the bytes of one piece as they come and emits each token once it is stable.

    Holds fewer than `lookahead` + `step` + the longest token's bytes.
    """

    def __init__(self, merges: Merges, step: int = STEP):
        self.merges, self.held = merges, b""
        self.enough = merges.lookahead + max(step, merges.longest + 1)

    def feed(self, data: bytes) -> list[int]:
        held, out, at = self.held + data, [], 0
        while len(held) - at >= self.enough:
            stable = at + self.enough - self.merges.lookahead
            for i in self.merges.merged(held[at : at + self.enough]):
                if at + len(self.merges.bytes_of[i]) > stable:
                    break
                at += len(self.merges.bytes_of[i])
                out.append(i)
        self.held = held[at:]
        return out

    def end(self) -> list[int]:
        held, self.held = self.held, b""
        return self.merges.merged(held)


class Classes(dict):
    """For `str.translate`: an ASCII character of the class that the tokenizer gives a character. Fewer entries than there are code points."""

    def __init__(self, cutter):
        super().__init__({k: k for k in range(128)})
        self.cutter = cutter

    def __missing__(self, point: int) -> int:
        joins = lambda c: len(self.cutter.pre_tokenize_str(c + chr(point))) == 1
        self[point] = ord("?") if 0xD800 <= point < 0xE000 else ord(next((c for c in "A0!" if joins(c)), "\n"))
        return self[point]


class Units(dict):
    """Ids of short units, found when first asked for."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.merges.unit(unit)
        if len(unit) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[unit] = ids
        return ids


def known(path: str) -> Merges:
    if path not in _known:
        _known[path] = Merges(path)
    return _known[path]


def slabs(text: str, size: int = SLAB) -> Iterator[str]:
    """The text in slabs of about `size` characters that no unit crosses."""
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + size)
        end = seam.end() if seam else len(text)
        yield text[at:end]
        at = end


def segments(text: str, merges: Merges) -> Iterator[str]:
    """Ordinary text and added tokens in turn."""
    at = 0
    for m in merges.apart.finditer(text) if merges.apart else ():
        yield text[at : m.start()]
        yield m.group()
        at = m.end()
    yield text[at:]


def token_ids(text: str, merges: Merges) -> Iterator[list[int]]:
    """Ids of a text, a slab at a time."""
    for k, part in enumerate(segments(text, merges)):
        if k % 2:
            yield [merges.added[part]]
            continue
        for slab in slabs(part):
            yield list(chain.from_iterable(map(merges.units.__getitem__, UNIT.findall(slab))))


def text_of(ids: Iterable[np.ndarray], merges: Merges) -> Iterator[str]:
    """Text of ids that come in parts; ids of no token have none, bytes that are no UTF-8 read as U+FFFD."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    get = merges.bytes_of.get
    for part in ids:
        yield state.decode(b"".join([get(i, b"") for i in part.tolist()]))
    yield state.decode(b"", True)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: the columns of `carry` (all but the text by default) and `ids` (array of int).

    `tokenizer` is the path of a tokenizer file, readable on every machine. Ids
    are those that the tokenizer gives the whole text, added tokens' strings
    included and no special tokens put round it. A null text counts as empty
    and has no ids. A column `ids` of the caller is replaced. Repeated rows are
    ordinary rows; an empty table gives no rows.
    """
    rest = [c for c in (docs.columns if carry is None else carry) if c not in ("ids", *([text] if carry is None else []))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = known(tokenizer)
        for batch in batches:
            parts, ends = [], [0]
            for t in batch.column(0):
                found = [np.array(x, np.int32) for x in token_ids(t.as_py(), merges)]
                parts += found
                ends.append(ends[-1] + sum(map(len, found)))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], names=[*rest, "ids"])

    bounded_batches(docs.sparkSession)
    schema = StructType([*[docs.schema[c] for c in rest], StructField("ids", ArrayType(IntegerType()))])
    return docs.select(filled(docs[text]).alias("_text"), *[docs[c] for c in rest]).mapInArrow(run, schema)


def decode(coded: DataFrame, tokenizer: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `coded`: the columns of `carry` (all by default) and `decoded`, the text of the ids.

    Special tokens are written out. Null counts as no ids, ids that the
    tokenizer lacks are skipped. A column `decoded` of the caller is replaced.
    """
    rest = [c for c in (coded.columns if carry is None else carry) if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = known(tokenizer)
        for batch in batches:
            column = batch.column(0)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            cut = lambda lo, hi: (values[at : min(at + SLAB, hi)] for at in range(lo, hi, SLAB))
            texts = ["".join(text_of(cut(lo, hi), merges)) for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*rest, "decoded"])

    bounded_batches(coded.sparkSession)
    schema = StructType([*[coded.schema[c] for c in rest], StructField("decoded", StringType())])
    listed = F.filter(F.coalesce(coded[ids].cast("array<int>"), F.array().cast("array<int>")), lambda i: i.isNotNull())
    return coded.select(listed.alias("_ids"), *[coded[c] for c in rest]).mapInArrow(run, schema)
