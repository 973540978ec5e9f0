"""Credentials in source lines and in history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.scalar import entropy, redact_secret, secret_fingerprint


def scannable(path: str):
    return ~F.col(path).rlike(rules.SECRET_SKIPPED)


def scan_secrets(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, line, provider, tier, redacted, fingerprint) of lines (path, line, text), with the columns of `carry`.

    Tier 1: shapes of known providers. Tier 2, where a line has none: a literal
    of 16 characters or more given to a name that holds credentials, random
    enough and without white space. Placeholders, references to the environment
    and documented example keys are none. The value itself never leaves.
    """
    t = F.col("text")
    found = lambda name, tier, pattern, group: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(name).alias("provider"), F.lit(tier).alias("tier"), v.alias("value")))
    literal = rf"({rules.CREDENTIAL_NAME})[\"']?\s*[:=]\s*[\"']([^\"'\s]{{{rules.MIN_SECRET_LENGTH},}})[\"']"
    shaped = F.flatten(F.array(*[found(name, 1, pattern, 0) for name, pattern in rules.PROVIDER_KEYS]))
    # One pass over the lines: what has a known shape, and only where nothing has, what has a telling name.
    rows = lines.where(scannable("path")).select("path", "line", *carry, "text", F.filter(shaped, lambda k: ~k["value"].isin(*rules.DOCUMENTED_KEYS)).alias("_first"))
    each = F.explode(F.when(F.size("_first") > 0, F.col("_first")).otherwise(found("generic_secret", 2, literal, 2)))
    rows = rows.select("path", "line", *carry, each.alias("k")).select("path", "line", *carry, "k.*")
    bits = entropy("value")
    random = (bits >= rules.MIN_ENTROPY) & (bits * F.length("value") >= rules.MIN_TOTAL_ENTROPY) & ~F.col("value").rlike(rules.PLACEHOLDER)
    return rows.where((F.col("tier") == 1) | random).select("path", "line", *carry, "provider", "tier", redact_secret("value").alias("redacted"), secret_fingerprint("provider", "value").alias("fingerprint"))


def history_secrets(added: DataFrame, head: DataFrame) -> DataFrame:
    """One row per credential of a history of added lines (seq, sha, path, line, text): first and last commit, gone from head or not."""
    found = scan_secrets(added, ("seq", "sha"))
    per = found.groupBy("provider", "fingerprint").agg(
        F.min_by("path", "seq").alias("path"), F.min_by("redacted", "seq").alias("redacted"), F.min("tier").alias("tier"), F.min_by("sha", "seq").alias("first_commit"), F.max_by("sha", "seq").alias("last_commit"))
    now = scan_secrets(head).select("provider", "fingerprint").distinct().withColumn("_now", F.lit(True))
    return per.join(now, ["provider", "fingerprint"], "left").withColumn("removed_from_head", F.col("_now").isNull()).drop("_now")
