"""Findings in text that an assistant trusts as instructions.

Files come as (path, surface, content). Each file is read in one pass as an
array of its lines: a rule looks at the lines only where the whole text passes
it, neighbouring lines are neighbours in the array, and phrases over windows of
up to three lines are settled by a fold over the windows that match. Nothing is
shuffled. Python sees only lines that hold characters beyond a fixed set.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish.functions import rules
from tarnish.functions.arrow import canonical_form, mixed_words, once, redact_snippet, settled, settled_form

FINDING = ["path", "surface", "line", "rule", "category", "severity", "tier", "evidence", "steps"]
FOUND = "array<struct<line:int,rule:string,evidence:string,steps:array<string>>>"
ODD = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("mixed", T.BooleanType())]))
#: Each phrase holds one of these words whole, so that a window that matches holds it in one of its lines.
PHRASE_WORDS = "instructions disregard now prompt override user".split()
#: In lower case: what a text must hold for any rule, unless it holds characters that folding strips, changes or that are a finding by themselves.
LITERALS = ["curl", "wget", "iex", "invoke-expression", "base64", "atob", "eval", ".env", "id_rsa", "npmrc", "/.ssh", "/.aws/", "/.config/gh", "credentials.json", "<!--", *PHRASE_WORDS]
UNUSUAL = r"[*`~\xA0\xA8\xAA\xAD\xAF\xB2-\xB5\xB8-\xBA\xBC-\xBE\x{130}\x{132}\x{133}\x{13F}\x{140}\x{149}\x{17F}-\x{10FFFF}]"
FOREIGN = r"[\p{IsCyrillic}\p{IsGreek}]"
#: Rule: category, severity, tier, and whether it counts as a structural hit.
RULES = {
    "zero_width": ("hidden_text", "critical", 1, True), "unicode_tag": ("hidden_text", "critical", 1, True), "bidi_override": ("hidden_text", "critical", 1, True),
    "mixed_script_word": ("hidden_text", "medium", 1, False), "curl_pipe_shell": ("instruction_injection", "critical", 1, True),
    "download_then_exec": ("instruction_injection", "critical", 1, True), "base64_exec": ("instruction_injection", "critical", 1, True),
    "injection_phrase": ("instruction_injection", "high", 2, False), "injection_phrase_canonicalized": ("instruction_injection", "high", 2, False),
    "credential_exfiltration": ("credential_exfiltration", "critical", 2, False), "hidden_html_instruction": ("instruction_injection", "high", 2, False),
}
# A joiner is ordinary between two pictographs: between code points beyond U+2000.
ZERO_WIDTH = r"[\x{200B}\x{200C}]|(?<![\x{2001}-\x{10FFFF}])\x{200D}|\x{200D}(?![\x{2001}-\x{10FFFF}])"


@F.pandas_udf(ODD)
def odd_lines(lines: pd.Series) -> pd.Series:
    """Matching key, steps and mixed-script mark of each line; null for null."""

    def told(line):
        if line is None:
            return None
        key, steps = canonical_form(line)
        return {"text": key, "steps": steps, "mixed": bool(mixed_words(line))}

    return lines.map(lambda xs: None if xs is None else [told(x) for x in xs])


def spelled(word: str) -> str:
    """A regex of a word in all its spellings that have it as their canonical form, NFKC aside."""
    alike = lambda c: "".join(a for a, b in zip(*rules.CONFUSABLES, strict=True) if b.lower() == c)
    return f"(?:{rules.INVISIBLE}|[*`~])*".join(f"[{c}{c.upper()}{alike(c)}]" for c in word)


def line_rules() -> dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]]:
    """For each rule that one line shows by itself: whether a whole text can hold it, and whether a line does."""
    one = lambda *patterns: (lambda t: reduce(lambda a, b: a | b, [t.rlike(p) for p in patterns]),) * 2
    both = lambda t: t.rlike(rules.DOWNLOAD_TO_FILE) & t.rlike(rules.SHELL_EXEC_AFTER)
    return {
        "zero_width": one(ZERO_WIDTH), "unicode_tag": one(r"[\x{E0000}-\x{E007F}]"), "bidi_override": one(r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"),
        "curl_pipe_shell": one(rules.CURL_PIPE_SHELL, rules.POWERSHELL_DOWNLOAD_EXEC), "download_then_exec": (both, both), "base64_exec": one(rules.BASE64_EXEC),
    }


def finding(line: Column, rule: str, evidence: Column, steps: Column | None = None) -> Column:
    return F.struct(line.cast("int").alias("line"), F.lit(rule).alias("rule"), evidence.alias("evidence"), (F.lit(None) if steps is None else steps).cast("array<string>").alias("steps"))


def hits(lines: Column, rule: str, holds: Callable[[Column, Column], Column]) -> Column:
    """A finding for each line (text, place from 0) that holds the rule."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(holds(x, i), finding(i + 1, rule, x))))


def where(guard: Column, found: Column) -> Column:
    """Findings if the guard holds; otherwise they are not worked out."""
    return F.when(guard, found.cast(FOUND)).otherwise(F.array().cast(FOUND))


def phrases(lines: Column, keys: Column) -> Column:
    """Raw phrases by line, then canonical ones in the smallest windows that touch no line spent.

    The smallest window that matches at a line hangs on the lines alone; only
    whether the line is spent by then hangs on earlier windows, which end where
    `until` says.
    """
    pattern = rules.INJECTION_PHRASE

    def settle(keys: Column, raw: Column) -> Column:
        free = lambda i: ~F.get(raw, i)  # noqa: E731  null beyond the end
        key = lambda i: F.get(keys, i)["text"]
        size = lambda k, i: (
            F.when(~free(i), 0).when(k["text"].rlike(pattern), 1).when(free(i + 1) & F.concat_ws(" ", k["text"], key(i + 1)).rlike(pattern), 2)
            .when(free(i + 1) & free(i + 2) & F.concat_ws(" ", k["text"], key(i + 1), key(i + 2)).rlike(pattern), 3).otherwise(0)
        )
        windows = F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("i"), size(k, i).alias("n"))), lambda w: w["n"] > 0)
        begin = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<i:int,n:int>>").alias("kept"))
        step = lambda acc, w: F.when(w["i"] >= acc["until"], F.struct((w["i"] + w["n"]).alias("until"), F.concat(acc["kept"], F.array(w)).alias("kept"))).otherwise(acc)
        kept = F.aggregate(windows, begin, step, lambda acc: acc["kept"])
        part = lambda xs, w: F.slice(xs, w["i"] + 1, w["n"])
        steps = lambda w: F.array_distinct(F.flatten(F.transform(part(keys, w), lambda k: k["steps"])))
        folded = F.transform(kept, lambda w: finding(w["i"] + 1, "injection_phrase_canonicalized", F.array_join(part(lines, w), "\n"), steps(w)))
        return F.concat(hits(lines, "injection_phrase", lambda x, i: F.get(raw, i)), folded)

    return once(keys, lambda ks: once(F.transform(lines, lambda x: x.rlike(pattern)), lambda raw: settle(ks, raw)))


def comments(body: Column) -> Column:
    """HTML comments whose body another rule would flag, at the line they begin."""
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    bad = lambda e: e.rlike(rules.INJECTION_PHRASE) | e.rlike(rules.CURL_PIPE_SHELL) | e.rlike(rules.BASE64_EXEC) | e.rlike(rules.CREDENTIAL_PATH) & e.rlike(rules.EGRESS_VERB)
    gaps, whole = F.split(body, rules.HTML_COMMENT, -1), F.regexp_extract_all(body, F.lit(rules.HTML_COMMENT), F.lit(0))
    inner = F.regexp_extract_all(body, F.lit(rules.HTML_COMMENT), F.lit(1))

    def placed(gap: Column, all_: Column) -> Column:
        line = lambda i: F.aggregate(F.concat(F.slice(gap, F.lit(1), i + 1), F.slice(all_, F.lit(1), i)), F.lit(1), lambda n, x: n + feeds(x))
        return F.array_compact(F.transform(inner, lambda e, i: F.when(bad(e), finding(line(i), "hidden_html_instruction", e))))

    return once(gaps, lambda gap: once(whole, lambda all_: placed(gap, all_)))


def scan_text(files: DataFrame, line_chars: int | None = None) -> DataFrame:
    """All text findings as rows of FINDING, one per rule, line and evidence; evidence made safe to show.

    Lines are read whole, or up to `line_chars` characters where that is given.
    `steps` says how a line was written that only its canonical form gave away.
    In files that merely corroborate, phrases count beside a structural hit of
    the same file. A null content has none.
    """
    body = F.regexp_replace("content", r"^\x{FEFF}", "")
    split = F.split(body, "\n", -1)
    if line_chars is not None:
        split = F.transform(split, lambda x: F.substring(x, 1, line_chars))
    read = files.where("content is not null").select("path", "surface", body.alias("_body"), split.alias("_lines"))
    b, lines, odd = F.col("_body"), F.col("_lines"), F.col("_odd")
    strange = lambda t: ~settled(t) | t.rlike(FOREIGN)
    phrase_words = b.rlike("|".join(map(spelled, PHRASE_WORDS)))
    leaks = b.rlike(rules.CREDENTIAL_PATH) & b.rlike(rules.EGRESS_VERB)
    # A file without any rule's literal, or that passes no rule as a whole, goes no further.
    low = F.lower(b)
    read = read.where(reduce(lambda x, y: x | y, [F.contains(low, F.lit(x)) for x in LITERALS]) | b.rlike(UNUSUAL))
    read = read.where(reduce(lambda x, y: x | y, [*(whole(b) for whole, _ in line_rules().values()), phrase_words, leaks, b.rlike("<!--"), strange(b)]))
    rows = read.withColumn("_odd", odd_lines(F.when(strange(b), F.transform(lines, lambda x: F.when(strange(x), x)))))
    by_line = {name: where(whole(b), hits(lines, name, lambda x, i, line=line: line(x))) for name, (whole, line) in line_rules().items()}
    by_line["mixed_script_word"] = where(b.rlike(FOREIGN), hits(lines, "mixed_script_word", lambda x, i: F.get(odd, i)["mixed"]))
    rows = rows.select("path", "surface", "_body", "_lines", "_odd", *[c.alias(f"_{name}") for name, c in by_line.items()])
    strong = F.concat(*[F.col(f"_{name}") for name in by_line if RULES[name][3]])
    told = lambda x, i: F.coalesce(F.when(F.get(odd, i).isNotNull(), F.struct(F.get(odd, i)["text"].alias("text"), F.get(odd, i)["steps"].alias("steps"))), settled_form(x))
    phrased = where((~settled(b) | phrase_words) & ((F.col("surface") != "corroborate_only") | (F.size(strong) > 0)), phrases(lines, F.transform(lines, told)))
    near = lambda out: hits(lines, "credential_exfiltration", lambda x, i: x.rlike(rules.CREDENTIAL_PATH) & (F.get(out, i) | F.coalesce(F.get(out, i - 1), F.lit(False)) | F.coalesce(F.get(out, i + 1), F.lit(False))))
    leaked = where(leaks, once(F.transform(lines, lambda x: x.rlike(rules.EGRESS_VERB)), near))
    every = F.array_distinct(F.concat(*[F.col(f"_{name}") for name in by_line], phrased, leaked, where(b.rlike("<!--"), comments(b))))
    found = rows.select("path", "surface", F.explode(every).alias("f")).select("path", "surface", "f.*")
    about = F.create_map(*[x for name, (cat, sev, tier, _) in RULES.items() for x in (F.lit(name), F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"), F.lit(tier).alias("tier")))])
    return found.withColumn("_a", about[F.col("rule")]).select("path", "surface", "line", "rule", "_a.category", "_a.severity", "_a.tier", redact_snippet("evidence").alias("evidence"), "steps")


def first_findings(found: DataFrame, most: int = 100) -> DataFrame:
    """The first findings of a repository by path, line and rule: a report's length."""
    return found.orderBy("path", "line", "rule", "evidence").limit(most)


def audit_tool_descriptions(tools: DataFrame) -> DataFrame:
    """Per server (server, name, description): findings in the descriptions and one hash over them, sorted by name."""
    # Each description is a file of its own; its server is read back from before the first NUL, which no name holds.
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.concat_ws("\0", part("server"), part("name"), F.sha2(part("description"), 256))
    text = tools.select(own.alias("path"), F.lit("instructions").alias("surface"), part("description").alias("content"))
    found = scan_text(text).groupBy(F.substring_index("path", "\0", 1).alias("server")).agg(F.count(F.lit(1)).alias("findings"))
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce("name", F.lit("(unnamed)")).alias("n"), F.coalesce("description", F.lit("")).alias("d"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["n"], F.lit("\0"), p["d"])), "\0")
    hashed = tools.groupBy("server").agg(F.count(F.lit(1)).alias("tools"), F.sha2(joined, 256).alias("tools_hash"))
    return hashed.join(found, "server", "left").fillna(0, ["findings"])
