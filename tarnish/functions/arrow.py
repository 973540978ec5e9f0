"""Scalar functions that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish.functions import rules

_FOLD = str.maketrans(*rules.CONFUSABLES)
_KEYS = set(rules.CONFUSABLES[0])
_INVISIBLE = re.compile(rules.INVISIBLE)
_ASCII = re.compile(r"[\x20-\x7e\t]*")
# Types as objects: workers import this module, and have no session to read a schema string.
WORDS = T.ArrayType(T.StringType())
CANONICAL = T.StructType([T.StructField("text", T.StringType()), T.StructField("steps", WORDS)])


@lru_cache(maxsize=None)
def _kind(ch: str) -> str:
    """w for letters and numbers, s for white space, p for all else."""
    return "w" if unicodedata.category(ch)[0] in "LN" else "s" if ch.isspace() or ch == "﻿" else "p"


def canonical_form(text: str) -> tuple[str, list[str]]:
    """Matching key of an instruction, and the steps that changed it."""
    steps: list[str] = []

    def after(name: str, before: str, now: str) -> str:
        if now != before:
            steps.append(name)
        return now

    t = text
    if not _ASCII.fullmatch(t):
        t = after("nfkc", t, unicodedata.normalize("NFKC", t))
        t = after("invisible_strip", t, _INVISIBLE.sub("", t))
        t = after("confusable_fold", t, t.translate(_FOLD))
    t = after("markdown_strip", t, re.sub(r"[*`~]", "", t))
    t = after("punctuation_fold", t, "".join(" " if _kind(c) == "p" else c for c in t))
    t = after("whitespace_collapse", t, re.sub(r"\s+", " ", t).strip())
    return after("lowercase", t, t.lower()), steps


#: Characters that NFKC leaves as they are beside any others of them: ASCII, Latin and Cyrillic letters, ideographs, what is stripped as invisible.
SETTLED = (
    r"[\x00-\x7F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\x{12F}\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{481}\x{48A}-\x{4FF}"
    r"\x{200B}-\x{200F}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2022}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{20AC}\x{4E00}-\x{9FEF}\x{FEFF}\x{E0000}-\x{E007F}]*"
)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def settled(text: Column) -> Column:
    return text.rlike(rf"^{SETTLED}\z")


def settled_form(text: Column) -> Column:
    """`canonical_form` of a settled text as an expression: struct of text and steps."""
    gap = r"\t-\r\x1C- "
    stages: list[tuple[str, Callable[[Column], Column]]] = [
        ("invisible_strip", lambda t: F.regexp_replace(t, rules.INVISIBLE, "")), ("confusable_fold", lambda t: F.translate(t, *rules.CONFUSABLES)), ("markdown_strip", lambda t: F.regexp_replace(t, "[*`~]", "")),
        ("punctuation_fold", lambda t: F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{gap}]", " ")), ("whitespace_collapse", lambda t: F.trim(F.regexp_replace(t, f"[{gap}]+", " "))), ("lowercase", F.lower),
    ]

    def stage(k: int, before: Column, steps: list[Column]) -> Column:
        if k == len(stages):
            return F.struct(before.alias("text"), F.array_compact(F.array(*steps)).alias("steps"))
        name, change = stages[k]
        return once(change(before), lambda now: stage(k + 1, now, [*steps, F.when(now != before, name)]))

    return stage(0, text, [])


def mixed_words(text: str) -> list[str]:
    """Words with Latin letters and look-alikes of them from another script."""
    if _KEYS.isdisjoint(text):
        return []
    words = re.findall(r"[^\W_]+", "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text)) if text else []
    latin = lambda w: any("LATIN" in unicodedata.name(c, "") for c in w)
    return [w for w in words if latin(w) and not _KEYS.isdisjoint(w)]


def snippet(raw: str) -> str:
    """Evidence made safe to show: nothing invisible, no markup, at most 120 characters."""
    out = []
    for ch in raw:
        c = ord(ch)
        hidden = c < 0x20 or 0x7F <= c <= 0x9F or 0x200B <= c <= 0x200F or 0x202A <= c <= 0x202E or 0x2066 <= c <= 0x2069 or 0xE0000 <= c <= 0xE007F or c == 0xFEFF
        out.append(f"<U+{c:04X}>" if hidden else ch)
    text = re.sub(r"^[#>\-=+]+", "", re.sub(r"[`<>|]", "", re.sub(r"\s+", " ", "".join(out)).strip()))
    return text if len(text) <= 120 else text[:120] + "…"


def aligned_distance(a: str, b: str, most: int = 2) -> int:
    """Edits, transpositions of neighbours included, of two words; over `most`: most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return min(rows[-1][-1], most + 1)


@F.pandas_udf(CANONICAL)
def canonicalise(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([canonical_form(t or "") for t in text], columns=["text", "steps"])


@F.pandas_udf(WORDS)
def mixed_script_words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: mixed_words(t or ""))


@F.pandas_udf(T.StringType())
def redact_snippet(text: pd.Series) -> pd.Series:
    return text.map(lambda t: snippet(t or ""))


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([aligned_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")
