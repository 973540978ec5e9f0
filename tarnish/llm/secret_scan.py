"""Secret scans over a trigram inverted index, DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: alternatives,
each a set of trigrams that all must occur. The index holds, keyed by trigram,
the digests of the texts that have it, case-folded; it has only trigrams that
some query names. The postings of each alternative's trigrams are intersected,
and only texts in some intersection are matched against the regex. Rules without
a mandatory trigram are matched on every text, in the pass that makes the index.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filled


@dataclass(frozen=True)
class Rule:
    """`least`: code points that `group` must have for a match to count."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base rules, then published shapes of provider credentials.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # Begin only where a run of their characters does: so the time stays linear, and no part needs a bound.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{2,}://[^\s:/@]+:[^\s:/@]{6,}@"),
)
#: A class of so few characters is spelled out; with more ways than this through a regex, a stretch ends.
SMALL_CLASS, MOST_WAYS = 6, 16
#: Matches of a text that are placed one behind the other.
STRETCH = 256
#: Trigrams of an alternative that go into the index: the rarest, by how seldom their characters are in text.
GRAMS, OFTEN = 2, "etaoinshrdlucmfwypvbgkqjxz"


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams a match must hold, in lower case; None: no such trigrams."""
    out = []
    for strings in _mandatory(re._parser.parse(regex)):
        grams = {s[i : i + 3].lower() for s in strings for i in range(len(s) - 2)}
        if not grams:
            return None
        out.append(frozenset(sorted(grams, key=lambda g: (-sum(OFTEN.index(c) if c in OFTEN else len(OFTEN) for c in g), g))[:GRAMS]))
    return out


def _mandatory(parsed) -> list[list[str]]:
    """For each way through the regex, literal stretches that a match must hold."""
    ways: list[list[str]] = [[""]]
    for op, arg in parsed:
        more = [["", ""]]  # classes and open repeats end a stretch
        if op is sre.LITERAL:
            more = [[chr(arg)]]
        elif op is sre.IN and len(arg) <= SMALL_CLASS and all(kind is sre.LITERAL for kind, _ in arg):
            more = [[chr(c)] for _, c in arg]
        elif op is sre.SUBPATTERN:
            more = _mandatory(arg[3])
        elif op is sre.BRANCH:
            more = [way for branch in arg[1] for way in _mandatory(branch)]
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            more = [*_mandatory(arg[2]), [""]]
        joined = _joined(ways, more)
        ways = joined if len(joined) <= MOST_WAYS else _joined(ways, [["", ""]])
    return ways


def _joined(ways: list[list[str]], more: list[list[str]]) -> list[list[str]]:
    return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in ways for b in more]


def none() -> Column:
    """No spans."""
    return F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")


def matches(text: Column, rule: Rule) -> Column:
    """Spans (start, end, kind) of a rule in a text: code points, end exclusive.

    What stands between matches comes from a split, the matches themselves from
    an extraction; their lengths in turn give the places.
    """
    between, whole = F.split(text, rule.regex), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    lengths = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("whole"), value.alias("value")), lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m["whole"]).alias("n"), F.length(m["value"]).alias("v")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(KINDS[rule.kind]).alias("kind"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("name"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["v"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    # In stretches, as an array that grows match by match is copied each time. A lambda's argument is worked out once.
    once = lambda value, f: F.transform(F.array(value), f)[0]
    chars = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
    cut = lambda every: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / STRETCH)), lambda k: F.slice(every, (k * STRETCH + 1).cast("int"), F.lit(STRETCH)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = lambda sums: F.aggregate(sums, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
    placed = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none().alias("spans")), step, lambda acc: acc["spans"])
    found = once(lengths, lambda every: once(cut(every), lambda parts: F.flatten(F.zip_with(parts, starts(F.transform(parts, chars)), placed))))
    return F.when(text.rlike(rule.regex), found).otherwise(none())


KINDS = {r.kind: i for i, r in enumerate((*BASE_RULES, *MORE_RULES))}


def held_grams(folded: Column, grams: list[str]) -> Column:
    """Which of `grams` a case-folded text has."""
    return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(g)), F.lit(g)) for g in grams]))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): of postings (gram, key) intersected for each alternative, the rules that some alternative leaves a text to."""
    named = [(gram, kind, k, len(grams)) for kind, ways in queries.items() for k, grams in enumerate(ways) for gram in sorted(grams)]
    asked = postings.sparkSession.createDataFrame(named, "gram string, kind string, way int, asked int")
    # As many rows as the rules have trigrams.
    met = postings.join(F.broadcast(asked), "gram").groupBy("kind", "way", "key").agg(F.count(F.lit(1)).alias("n"), F.first("asked").alias("asked"))
    return met.where("n = asked").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = (*BASE_RULES, *MORE_RULES), carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs` with the columns of `carry` (all by default).

    Adds spans: array of (start, kind, end, name) sorted by start, then rule
    order; code points, end exclusive. A column `spans` of `docs` is replaced.
    Matches of one rule don't overlap; those of several may. Null text counts
    as empty; null or repeated ids are ordinary rows (texts are told apart by
    their SHA-256 digest). An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    carried = [c for c in (docs.columns if carry is None else carry) if c != "spans"]
    asked = {r.kind: trigram_query(r.regex) for r in rules}
    queries = {k: q for k, q in asked.items() if q is not None}
    grams = sorted({g for q in queries.values() for way in q for g in way})
    digest = F.unhex(F.sha2(filled(docs[text]), 256))
    every = [matches(F.col("_text"), r) for r in rules if asked[r.kind] is None]
    # Folded once, in a projection of its own; one pass over the texts gives index and full scans.
    read = docs.select(F.struct(*[docs[c] for c in carried]).alias("_row"), digest.alias("_key"), filled(docs[text]).alias("_text"), F.lower(filled(docs[text])).alias("_folded"))
    rows = scratch.save(read.select("_row", "_key", held_grams(F.col("_folded"), grams).alias("_grams"), (F.flatten(F.array(*every)) if every else none()).alias("_every")), "rows")
    postings = rows.select(F.explode("_grams").alias("gram"), F.col("_key").alias("key")).distinct()
    left = scratch.save(candidates(postings, queries), "candidates")
    # Texts of candidates only, each once however often it is repeated. How they are joined is left to Spark's size check.
    copies = docs.select(digest.alias("key"), filled(docs[text]).alias("_text")).join(left, "key")
    texts = copies.groupBy("key").agg(F.first("_text").alias("_text"), F.first("kinds").alias("kinds"))
    found = [F.when(F.array_contains("kinds", r.kind), matches(F.col("_text"), r)) for r in rules if asked[r.kind] is not None]
    verified = texts.select(F.col("key").alias("_key"), (F.flatten(F.array_compact(F.array(*found))) if found else none()).alias("_verified")).where(F.size("_verified") > 0)
    verified = scratch.save(verified, "verified")
    whole = rows.drop("_grams").join(verified, "_key", "left")
    return whole.select("_row.*", F.sort_array(F.concat("_every", F.coalesce("_verified", none()))).alias("spans"))


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["name"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
