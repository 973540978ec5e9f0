"""Scalar functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnish.functions import rules


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def round_half_up(x: str | Column, digits: int = 0) -> Column:
    """Halves go towards positive infinity, on the binary value."""
    return F.floor(_c(x) * 10**digits + 0.5) / 10**digits


def coerce_version(spec: str | Column) -> Column:
    """First dotted number of at most three parts in a version range; null if there is none."""
    return empty_to_null(F.regexp_extract(_c(spec), r"\d+(?:\.\d+){0,2}(?:[-+][0-9A-Za-z.-]+)?", 0))


def severity_band(score: str | Column) -> Column:
    s = _c(score)
    return F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").when(s > 0, "low").otherwise("unknown")


def severity_word(word: str | Column) -> Column:
    w = F.upper(_c(word))
    return F.when(w.isin("CRITICAL", "HIGH", "LOW"), F.lower(w)).when(w.isin("MODERATE", "MEDIUM"), "medium").otherwise("unknown")


def severity(word: str | Column, score: str | Column) -> Column:
    """The qualitative word where it is known, else the band of the numeric score."""
    named = severity_word(word)
    return F.when(named != "unknown", named).otherwise(severity_band(score))


def rank_in(order: tuple[str, ...], x: str | Column, other: int | None = None) -> Column:
    """Place of a word in a list; words not in it get `other` (its length)."""
    out = None
    for k, word in enumerate(order):
        out = F.when(_c(x) == word, k) if out is None else out.when(_c(x) == word, k)
    return out.otherwise(len(order) if other is None else other)


def age_days(created: str | Column, as_of: Column, rounded: bool = False) -> Column:
    days = F.timestamp_diff("SECOND", _c(created), as_of) / 86400
    return round_half_up(days) if rounded else days


def package_of_specifier(spec: str | Column) -> Column:
    """Package that an import specifier names; null for paths and aliases."""
    s = _c(spec)
    scoped = F.regexp_extract(s, r"^(@[^/]+/[^/]+)", 1)
    bare = F.substring_index(s, "/", 1)
    own = s.rlike(r"^[./#]") | s.startswith("node:") | s.startswith("@/") | s.startswith("~/") | (s == "")
    return F.when(own, None).when(s.startswith("@"), empty_to_null(scoped)).otherwise(empty_to_null(bare))


def pypi_name(name: str | Column) -> Column:
    return F.lower(F.regexp_replace(_c(name), r"[-_.]+", "-"))


def distribution_of_import(name: str | Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in rules.IMPORT_TO_PYPI.items() for x in pair])
    return pypi_name(F.coalesce(known[_c(name)], _c(name)))


def requirement(line: str | Column) -> Column:
    """(name, spec) of a requirements line; null for options, comments, links and blanks."""
    clean = F.trim(F.regexp_replace(_c(line), r"(^|\s)#.*$", ""))
    clean = F.trim(F.substring_index(clean, ";", 1))
    name = F.regexp_extract(clean, r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===).*)?$", 1)
    spec = F.regexp_extract(clean, r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===).*)?$", 2)
    return F.when(name != "", F.struct(pypi_name(name).alias("name"), empty_to_null(F.trim(spec)).alias("spec")))


def licence_term_class(term: str | Column) -> Column:
    t = F.trim(F.regexp_replace(F.trim(_c(term)), r"^\(+|\)+$", ""))
    return F.when(t.rlike(rules.WEAK_LICENCE), "weak-copyleft").when(t.rlike(rules.STRONG_LICENCE), "strong-copyleft").when(t.rlike(rules.PERMISSIVE_LICENCE), "permissive").otherwise("unknown")


def licence_class(expression: str | Column) -> Column:
    """Of alternatives the mildest, of joint terms the strictest; an exception clause is left out."""
    def strictest(alternative):
        terms = F.transform(F.split(alternative, r"(?i)\s+AND\s+"), lambda t: F.split(t, r"(?i)\s+WITH\s+")[0])
        return F.array_max(F.transform(terms, lambda t: rank_in(rules.LICENCE_CLASSES, licence_term_class(t))))

    mildest = F.array_min(F.transform(F.split(_c(expression), r"(?i)\s+OR\s+"), strictest))
    return F.element_at(F.array(*[F.lit(c) for c in rules.LICENCE_CLASSES]), mildest + 1)


def classify_path(path: str | Column) -> Column:
    """Kind of file an assistant trusts; null for all others and for vendored or fixture files."""
    p, out = _c(path), None
    for name, pattern in rules.SURFACES:
        out = F.when(p.rlike(pattern), name) if out is None else out.when(p.rlike(pattern), name)
    return F.when(~p.rlike(rules.EXCLUDED_PATH) & ~p.rlike(rules.EXCLUDED_FIXTURE), out)


def instruction_hash(content: str | Column) -> Column:
    return F.sha2(F.regexp_replace(F.regexp_replace(_c(content), "^﻿", ""), "\r\n", "\n"), 256)


def line_count(content: str | Column) -> Column:
    """Lines, a line feed at the end not counted; none in an empty text."""
    c = F.regexp_replace(_c(content), r"\n\z", "")
    return F.when(_c(content) == "", 0).otherwise(F.size(F.split(c, "\n", -1)))


def strip_version(arg: str | Column) -> Column:
    a = _c(arg)
    suffix = F.regexp_extract(a, r"^.+@([^@]*)\z", 1)
    return F.when(a.rlike(r"^.+@[^@]*\z") & suffix.rlike(rules.VERSION_SUFFIX), F.regexp_extract(a, r"^(.+)@[^@]*\z", 1)).otherwise(a)


def invocation(command: str | Column, args: str | Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(_c(command), F.lit("")), _c(args)))


def invocation_identity(command: str | Column, args: str | Column) -> Column:
    """What runs, whatever its version."""
    return invocation(command, F.transform(_c(args), strip_version))


def normalise_path(path: str | Column) -> Column:
    """A route with its identifiers made placeholders."""
    def step(s):
        return (
            F.when(s.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), ":id").when(s.rlike(r"^\d+\z"), ":n")
            .when((F.length(s) >= 24) & s.rlike(r"^[A-Za-z0-9_-]+\z") & s.rlike(r"\d"), ":token").otherwise(s)
        )

    return F.array_join(F.transform(F.split(F.substring_index(_c(path), "?", 1), "/", -1), step), "/")


def repo_of_url(url: str | Column) -> Column:
    """(owner, name) of an https repository address without credentials; else null."""
    pattern = r"^https://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?\z"
    u = F.trim(_c(url))
    return F.when(u.rlike(pattern), F.struct(F.regexp_extract(u, pattern, 1).alias("owner"), F.regexp_extract(u, pattern, 2).alias("name")))


def scan_error(raw: str | Column) -> Column:
    """Kind of a failed scan's error, as the user is told it."""
    r = _c(raw)
    return (
        F.when(r.rlike(r"(?i)could not read Username|Authentication failed|Repository not found|access denied|returned error: 40[34]"), "unreachable")
        .when(r.rlike(r"(?i)timed? ?out|took too long"), "timeout").when(r.rlike(r"(?i)too (large|many files)|size cap|file cap"), "too_large").otherwise("other")
    )


def rate_limit_seconds(wait: str | Column) -> Column:
    """Seconds of a wait written as 1h2m3.5s."""
    part = lambda unit: F.coalesce(empty_to_null(F.regexp_extract(_c(wait), rf"([\d.]+){unit}", 1)).cast("double"), F.lit(0.0))
    return part("h") * 3600 + part("m(?!s)") * 60 + part("s")


def decimal_text(number: str | Column) -> Column:
    """A double in digits, as 12000000.0 and not as 1.2E7: between 0.001 and 10^15, the rest as Spark casts it."""
    own = _c(number).cast("string")
    digits = F.rtrim(own.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(own.contains("E") & F.abs(_c(number)).between(1e-3, 1e15), plain).otherwise(own)


def markdown_safe(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), r"[\r\n]+", " "), r"([\\`*_{}\[\]()#+!|<>~-])", r"\\$1")


def html_safe(text: str | Column) -> Column:
    out = _c(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def csv_cell(x: str | Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(_c(x).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def entropy(text: str | Column) -> Column:
    """Shannon entropy of the characters, in bits each."""
    t = _c(text)
    chars = F.filter(F.split(t, ""), lambda ch: ch != "")
    n = F.size(chars)
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))


def redact_secret(value: str | Column) -> Column:
    """At most four characters of a secret, and its length."""
    return F.concat(F.substring(_c(value), 1, 4), F.lit("…("), F.length(_c(value)).cast("string"), F.lit(")"))


def secret_fingerprint(provider: str | Column, value: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", _c(provider), _c(value)), 256), 1, 16)


def identity_key(*parts: str | Column) -> Column:
    """Parts joined by colons, colons and backslashes in them escaped."""
    safe = [F.replace(F.replace(F.coalesce(_c(p).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")) for p in parts]
    return F.concat_ws(":", *safe)


def grade(score: str | Column) -> Column:
    out = None
    for least, letter in rules.GRADES:
        out = F.when(_c(score) >= least, letter) if out is None else out.when(_c(score) >= least, letter)
    return out.otherwise("F")


def badge_colour(score: str | Column) -> Column:
    s = _c(score)
    return F.when(s.isNull(), "grey").when(s >= 75, "green").when(s >= 50, "yellow").otherwise("red")


def system_event(message: str | Column, stack: str | Column) -> Column:
    """(message, context) as logged: a message of at most 2000 characters, and of a stack the first 12 lines; no stack, no context."""
    lines = F.array_join(F.slice(F.split(_c(stack), "\n", -1), 1, 12), "\n")
    context = F.when(_c(stack).isNotNull(), F.to_json(F.struct(lines.alias("stack"))))
    return F.struct(F.substring(F.coalesce(_c(message), F.lit("")), 1, 2000).alias("message"), context.alias("context"))


def coverage_caveat(marked: str | Column, examined: str | Column, truncated: str | Column) -> Column:
    """What the share of commits that name an assistant can't tell, in a sentence for the report."""
    n, all_, cut = _c(marked), _c(examined), F.when(_c(truncated), F.format_string(" Only the last %d commits were at hand; older work is not counted.", _c(examined))).otherwise("")
    said = F.when(n == 0, F.format_string("None of %d commits names an assistant, which does not show that none was used.", all_))
    said = said.when(n < rules.MIN_AI_COMMITS, F.format_string("%d of %d commits name an assistant: a direction, no evidence.", n, all_))
    return F.concat(said.otherwise(F.format_string("%d of %d commits name an assistant: a floor, not a total.", n, all_)), cut)


def normalise_email(address: str | Column) -> Column:
    """Addresses that differ by case or white space round them are one mailbox."""
    return F.lower(F.regexp_replace(_c(address), r"^\s+|\s+\z", ""))


def evidence_key(rule: str | Column, line: str | Column, evidence: str | Column) -> Column:
    """What two findings of a file share if they are one."""
    return F.concat_ws(":", _c(rule), _c(line).cast("string"), F.substring(F.sha2(_c(evidence), 256), 1, 12))
