"""Fill-in-middle transformation by overlapping chunks.

A unit is a run of ASCII letters or one other character. Whether a unit starts
at a byte is a predicate over that byte and the one before, so chunks that
overlap by one byte are judged independently: all are counted at once, prefix
sums of the counts tell which chunk owns a cut's rank, and only the owning
chunks are scanned again for the place. No text is ever cut into units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded_batches, filled

#: Bytes in a chunk, and in a block of chunks whose predicates are held at once.
CHUNK, BLOCK = 1 << 12, 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_bytes = np.arange(256)
LETTER = (_bytes >= 65) & (_bytes <= 90) | (_bytes >= 97) & (_bytes <= 122)
#: Bytes at which a character starts: all but those that continue one in UTF-8.
LEADS = _bytes & 0xC0 != 0x80


def starts(data: np.ndarray, before: int = -1) -> np.ndarray:
    """Where units start in a stretch of UTF-8; `before` is the byte in front of it, -1 at a text's start."""
    letter = LETTER[data]
    joined = np.empty(len(data), bool)
    joined[1:] = letter[:-1]
    joined[:1] = before >= 0 and LETTER[before]
    return LEADS[data] & ~(letter & joined)


def chunk_counts(data: np.ndarray, ends: np.ndarray, chunk: int = CHUNK, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one behind the other in `data`, text k up to `ends[k + 1]`: first bytes of the chunks, units and characters that start in each.

    A text's chunks are its own.
    """
    sizes = np.diff(ends)
    n = -(-sizes // chunk)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(ends[:-1] - chunk * first[:-1], n) + chunk * np.arange(first[-1])
    units, chars = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    text_starts = ends[:-1][sizes > 0]
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block)))
        a, b = int(at[lo]), int(at[hi]) if hi < len(at) else int(ends[-1])
        here = starts(data[a:b], int(data[a - 1]) if a else -1)
        own = text_starts[np.searchsorted(text_starts, a) : np.searchsorted(text_starts, b)] - a
        here[own] = True  # the byte in front of a text's first is another text's
        units[lo:hi] = np.add.reduceat(here, at[lo:hi] - a, dtype=np.int64)
        chars[lo:hi] = np.add.reduceat(LEADS[data[a:b]], at[lo:hi] - a, dtype=np.int64)
        lo = hi
    return at, units, chars


class Cuts:
    """Places of cuts in texts, from the counts of their chunks."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, chunk: int = CHUNK, block: int = BLOCK):
        self.data, self.ends = data, ends
        self.at, units, chars = chunk_counts(data, ends, chunk, block)
        self.units, self.chars = (np.concatenate([[0], np.cumsum(x)]) for x in (units, chars))
        self.first = np.searchsorted(self.at, ends)
        self.n = self.units[self.first[1:]] - self.units[self.first[:-1]]

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """Bytes and characters of a text before its unit `rank` (from 0), all of them if it has no more."""
        lo, hi = int(self.first[text]), int(self.first[text + 1])
        begin = int(self.ends[text])
        if rank >= self.n[text]:
            return int(self.ends[text + 1]) - begin, int(self.chars[hi] - self.chars[lo])
        k = int(np.searchsorted(self.units[lo : hi + 1], self.units[lo] + rank, side="right")) - 1 + lo
        a = int(self.at[k])
        b = int(self.at[k + 1]) if k + 1 < hi else int(self.ends[text + 1])
        here = starts(self.data[a:b], int(self.data[a - 1]) if a > begin else -1)
        inside = int(np.flatnonzero(here)[rank - (self.units[k] - self.units[lo])])
        return a + inside - begin, int(self.chars[k] - self.chars[lo] + np.count_nonzero(LEADS[self.data[a : a + inside]]))


def draws(id_col: Column, seed: int) -> list[Column]:
    """h1 to h4: 32 bits each of the SHA-256 of seed and id; a null id reads as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, share: int = 90, spm_share: int = 20, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: the columns of `carry` (all but the text by default) and what the transformation gives.

    Adds n (units, long), form (plain, psm or spm), prefix_chars and
    middle_chars (code points, null if plain) and output; columns of these
    names are replaced. `share` percent of texts are transformed, of these
    `spm_share` percent suffix first. A text that is empty or holds a marker
    stays plain; null counts as empty. Two rows with one id are cut by the same
    draws. An empty table gives no rows.
    """
    rest = [c for c in (docs.columns if carry is None else carry) if c not in (*ADDED, *([text] if carry is None else []))]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
            cuts = Cuts(data[ends[0] :], ends - ends[0])
            h = [batch.column(k).to_pylist() for k in range(1, 5)]
            forms, prefixes, middles, outputs = [], [], [], []
            for k in range(len(texts)):
                raw = data[ends[k] : ends[k + 1]].tobytes()
                n = int(cuts.n[k])
                if not raw or h[2][k] % 100 >= share or any(m in raw for m in marks):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(raw)
                    continue
                low, high = sorted((h[0][k] % (n + 1), h[1][k] % (n + 1)))
                (a, before), (b, upto) = cuts.place(k, low), cuts.place(k, high)
                spm = h[3][k] % 100 < spm_share
                p, s, m = marks
                outputs.append(b"".join([s, raw[b:], p, raw[:a], m, raw[a:b]] if spm else [p, raw[:a], s, raw[b:], m, raw[a:b]]))
                forms.append("spm" if spm else "psm")
                prefixes.append(before)
                middles.append(upto - before)
            columns = [pa.array(cuts.n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], *columns], names=[*rest, *ADDED])

    bounded_batches(docs.sparkSession)
    added = [StructField(c, StringType() if c in ("form", "output") else LongType()) for c in ADDED]
    schema = StructType([*[docs.schema[c] for c in rest], *added])
    drawn = [h.alias(f"_h{k}") for k, h in enumerate(draws(docs[id_col], seed), 1)]
    return docs.select(filled(docs[text]).alias("_text"), *drawn, *[docs[c] for c in rest]).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of.

    A text with a marker is plain, and no marker can arise across a seam, as
    each begins with its only `<`; so splitting at the markers gives the parts.
    """
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
