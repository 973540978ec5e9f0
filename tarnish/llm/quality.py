"""Quality rules by weak supervision, DataFrame functions only.

Each rule looks at one figure of a text and votes good (1), bad (-1) or
abstains (0). Expectation-maximisation over the table of vote patterns, which
has at most 3 ** rules rows whatever the input, estimates for each rule how
often it votes each way on good and on bad texts; a text is kept if the
posterior probability that it is good reaches a threshold. No single rule
rejects a text, but for the two base conditions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filled, restored, words

#: Words in a block: distinct words are counted in each, so that their share doesn't fall with a text's length.
DISTINCT_BLOCK = 2000
SYMBOLS = r"[#*$%&|<>]"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to a in is that for it on with as was at by be this are from or an "
    "de la le et les des en un une du est que pour dans par sur pas qui au "
    "der die und das den von zu mit sich ist ein eine nicht auf dem als für auch "
    "el los las se del por con su para una es al lo como más"
).split()

#: Rule: figure, and the bounds outside which it votes bad and inside which it votes good.
#: A bound of None is no bound; between the two ranges, and on a null figure, it abstains.
RULES: dict[str, tuple[tuple[float | None, float | None], tuple[float | None, float | None]]] = {
    "symbol_share": ((None, 0.08), (None, 0.01)),
    "capital_share": ((None, 0.5), (None, 0.2)),
    "exclamation_share": ((None, 0.3), (None, 0.05)),
    "dup_line_share": ((None, 0.3), (None, 0.1)),
    "repeat_share": ((None, 0.3), (None, 0.1)),
    "word_length": ((2.0, 14.0), (3.0, 10.0)),
    "stop_share": ((0.05, None), (0.12, None)),
    "distinct_share": ((0.2, None), (0.4, None)),
}
#: Pseudo-counts of votes by class: a rule is mostly right on good texts, and tells little of bad ones.
EXPECTED = {1: {1: 9.0, -1: 1.0}, 0: {1: 5.0, -1: 5.0}}


def figures(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' figures."""
    t = filled(text)
    df = df.withColumn("_w", words(F.col(text)))
    df = df.withColumn("_n", F.size("_w"))
    window = lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("_s", F.when(F.col("_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - 3), window))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.transform("_s", lambda s, k: F.when((F.get("_s", k - 1)["h"] == s["h"]) | (F.get("_s", k + 1)["h"] == s["h"]), s["i"]))
    df = df.withColumn("_p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    blocks = F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(DISTINCT_BLOCK))
    kinds = F.aggregate(F.transform(blocks, lambda i: F.size(F.array_distinct(F.slice("_w", i + 1, DISTINCT_BLOCK)))), F.lit(0), lambda a, x: a + x)
    chars = F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    df = df.withColumns({
        "n_words": F.col("_n").cast("long"), "word_chars": chars, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_repeat_words": covered.cast("long"), "_lines": F.size("_l"),
        "_stops": F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))), "_kinds": kinds,
        "_capitals": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), "_exclaims": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
    }).drop("_w", "_s", "_p", "_l", "_n")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return df.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "capital_share": share("_capitals", "word_chars"), "exclamation_share": share("_exclaims", "n_words"),
        "dup_line_share": share("n_dup_lines", "_lines"), "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
        "stop_share": share("_stops", "n_words"), "distinct_share": share("_kinds", "n_words"),
    }).drop("_lines", "_stops", "_kinds", "_capitals", "_exclaims")


def vote(name: str) -> Column:
    x, (bad, good) = F.col(name), RULES[name]
    out = lambda r: F.lit(False) if r == (None, None) else F.coalesce((x < r[0]) if r[0] is not None else F.lit(False), F.lit(False)) | F.coalesce((x > r[1]) if r[1] is not None else F.lit(False), F.lit(False))
    return F.when(x.isNull(), 0).when(out(bad), -1).when(~out(good), 1).otherwise(0).cast("byte")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, tolerance: float = 1e-9) -> tuple[float, list[dict[int, dict[int, float]]]]:
    """Prior of good, and rates[rule][class][vote], from vote patterns and counts.

    What is made most likely are the votes given which rules vote: an
    abstention says nothing, in the rates as in the posterior. Starts from texts
    with no bad vote as probably good, each bad vote making that less likely.
    Pseudo-counts (`EXPECTED`) say what a rule is expected to do, so that a
    table of few rows tells good from bad as well. Order of the patterns doesn't
    matter.
    """
    patterns = sorted(patterns)
    n_rules = len(patterns[0][0]) if patterns else 0
    good = [0.95 if -1 not in p else 0.1 ** p.count(-1) for p, _ in patterns]
    prior, rates, before = 0.5, [], None
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        mass = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        prior = (mass + 5) / (total + 10)
        rates = []
        for r in range(n_rules):
            counts = {c: dict(by) for c, by in EXPECTED.items()}
            for g, (p, n) in zip(good, patterns, strict=True):
                if p[r]:
                    counts[1][p[r]] += g * n
                    counts[0][p[r]] += (1 - g) * n
            rates.append({c: {v: x / sum(by.values()) for v, x in by.items()} for c, by in counts.items()})
        good = [1 / (1 + math.exp(min(700, -log_odds(p, prior, rates)))) for p, _ in patterns]
        if before is not None and max((abs(a - b) for a, b in zip(good, before, strict=True)), default=0) < tolerance:
            break
        before = good
    return prior, rates


def log_odds(pattern: tuple[int, ...], prior: float, rates: list[dict[int, dict[int, float]]]) -> float:
    """Of good against bad; an abstaining rule says nothing."""
    return math.log(prior / (1 - prior)) + sum(math.log(r[1][v] / r[0][v]) for v, r in zip(pattern, rates, strict=True) if v)


def drop_rejected(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of `docs` that are kept, with its own columns, whatever their names; see `score`."""
    rows = docs.select(docs[text].alias("_q_text"), F.struct(*[docs[c] for c in docs.columns]).alias("_q_whole"))
    return restored(score(rows, "_q_text", threshold, carry=["_q_whole"]).where("kept"), "_q_whole", docs)


def score(docs: DataFrame, text: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs` with the columns of `carry` (all by default).

    Adds the base figures, base_failed (under 50 words, or over half the words
    in 3-word windows found twice), `votes` (rule to vote), p_good (posterior)
    and kept, replacing columns of these names. Null text counts as empty and
    fails; repeated rows get equal verdicts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*base, "base_failed", "votes", "p_good", "kept"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    measured = figures(docs.select(F.struct(*[docs[c] for c in carried]).alias("_row"), docs[text].alias("_text")), "_text").drop("_text")
    measured = Scratch(spark, "quality").save(measured.select("_row", *base, *[vote(r).alias(f"_v_{r}") for r in RULES]), "votes")
    votes = [f"_v_{r}" for r in RULES]
    found = measured.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, rates = estimate([(tuple(r[v] for v in votes), r["n"]) for r in found])
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, r in zip(votes, rates, strict=bool(found)):  # no rates from an empty table
        odds = odds + F.when(F.col(v) == 1, math.log(r[1][1] / r[0][1])).when(F.col(v) == -1, math.log(r[1][-1] / r[0][-1])).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = measured.withColumns({"base_failed": failed, "p_good": 1 / (1 + F.exp(-odds)), "votes": F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"_v_{r}"))])})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).select("_row.*", *added)
