"""Scores, gates and the ranking of findings, one row per scan in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.scalar import grade, rank_in, round_half_up


def saturating(n: Column, most: float, k: float | Column) -> Column:
    """Damage that grows with a count towards `most`; half of it at `k`."""
    return F.lit(most) * n / (n + k)


def axis(*damages: Column) -> Column:
    """100 times the product of what each damage leaves, in the order given."""
    return F.aggregate(F.array(*damages), F.lit(100.0), lambda left, d: left * (1 - d))


def by_severity(prefix: str, weights: dict[str, tuple[float, float]]) -> list[Column]:
    return [saturating(F.col(f"{prefix}_{s}"), most, k) for s, (most, k) in weights.items()]


def scores(counts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds the three axes, score and grade to per-scan counts.

    Counts: files, deps, secrets, phantom, hallucinated, redefined, suspicious
    (not hallucinated), deprecated, licence, unused, zombie_weight (sum of
    confidences), duplicates; vuln_* and agent_* by severity; unverified_* for
    packages of tool servers by severity. The score is the weighted mean of the
    axes, no higher than security, from unrounded axes.
    """
    one = lambda name: saturating(F.col(name), *rules.DAMAGE[name])
    security = axis(one("secrets"), one("phantom"), one("hallucinated"), one("redefined"), *by_severity("vuln", rules.VULN_DAMAGE), *by_severity("agent", rules.AGENT_DAMAGE))
    supply = axis(one("suspicious"), one("deprecated"), one("licence"), *by_severity("unverified", rules.AGENT_DAMAGE))
    maintain = axis(
        saturating(F.col("unused"), 0.55, F.greatest(F.lit(2.0), 0.1 * F.col("deps"))),
        saturating(F.col("zombie_weight"), 0.45, F.greatest(F.lit(3.0), 0.02 * F.col("files"))), one("duplicates"),
    )
    out = counts.withColumns({"_s": security, "_c": supply, "_m": maintain})
    blended = rules.AXIS_WEIGHTS["security"] * F.col("_s") + rules.AXIS_WEIGHTS["supply_chain"] * F.col("_c") + rules.AXIS_WEIGHTS["maintainability"] * F.col("_m")
    score = round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_s"), blended)), 1)
    out = out.withColumns({"security": round_half_up("_s", 1), "supply_chain": round_half_up("_c", 1), "maintainability": round_half_up("_m", 1), "score": score})
    return out.withColumn("grade", grade("score")).drop("_s", "_c", "_m")


def severity_counts(prefix: str, severity: Column, which: Column, severities: tuple[str, ...]) -> list[Column]:
    return [F.count_if(which & (severity == s)).alias(f"{prefix}_{s}") for s in severities]


def gate(score: Column, least: Column) -> Column:
    """Whether a scan passes its repository's merge gate."""
    return score >= F.coalesce(least, F.lit(0.0))


def recommendation(phantom: Column, secrets: Column, score: Column) -> Column:
    return F.when((phantom > 0) | (secrets > 0), "block").when(score < 60, "review").when(score < 80, "caution").otherwise("merge")


def exit_code(phantom: Column, score: Column, least: Column) -> Column:
    return F.when((phantom > 0) | (score < F.coalesce(least, F.lit(0.0))), 1).otherwise(0)


FINDING = ["scan", "band", "kind", "title", "location", "effort", "confidence"]


def dependency_findings(verdicts: DataFrame) -> DataFrame:
    """Ranking rows of dependency verdicts (scan, package_name, ecosystem, status, max_severity, transitive, typosquat_of, deprecated)."""
    s, sev = F.col("status"), F.coalesce("max_severity", F.lit("unknown"))
    worst, squat = sev.isin("critical", "high"), F.col("typosquat_of").isNotNull()
    manifest = F.when(F.col("ecosystem") == "npm", "package.json").otherwise("requirements")
    say = lambda *x: F.concat("package_name", *[F.lit(p) if isinstance(p, str) else p for p in x])
    old = F.col("deprecated").isNotNull() & ~s.isin("phantom", "vulnerable", "suspicious")
    rows = verdicts.withColumns({
        "kind": F.when(s == "phantom", "phantom_dependency").when(s == "vulnerable", "vulnerable_dependency").when(s == "suspicious", "suspicious_dependency").when(old, "deprecated_dependency").when(s == "unused", "unused_dependency"),
        "band": F.when(s == "phantom", "critical").when(s == "vulnerable", F.when(worst, "critical").otherwise("medium")).when(s == "suspicious", F.when(squat, "high").otherwise("medium")).when(old, "medium").otherwise("low"),
        "title": F.when(s == "phantom", say(" does not exist on ", F.col("ecosystem"))).when(s == "vulnerable", say(" has known vulnerabilities (", sev, ")"))
            .when(s == "suspicious", F.when(squat, say(" closely resembles ", F.col("typosquat_of"))).otherwise(say(" looks suspicious (new or very low usage)"))).when(old, say(" is deprecated")).otherwise(say(" is declared but never imported")),
        "location": F.when((s == "vulnerable") & F.coalesce("transitive", F.lit(False)), "transitive dependency").otherwise(manifest),
        "effort": F.when(s == "vulnerable", F.when(F.coalesce("transitive", F.lit(False)), "L").otherwise("S")).when(s.isin("phantom", "suspicious") | old, "M").otherwise("S"),
        "confidence": F.when(s.isin("phantom", "vulnerable") | old, 1.0).when(s == "suspicious", 0.8).otherwise(0.9),
    })
    return rows.where("kind is not null").select(*FINDING)


def secret_findings(secrets: DataFrame) -> DataFrame:
    """Ranking rows of secrets (scan, provider, path, line, removed_from_head)."""
    removed = F.coalesce("removed_from_head", F.lit(False))
    return secrets.select("scan", F.lit("critical").alias("band"), F.lit("hardcoded_secret").alias("kind"), F.concat("provider", F.lit(" hardcoded in "), "path").alias("title"),
        F.concat_ws(":", "path", "line").alias("location"), F.when(removed, "M").otherwise("S").alias("effort"), F.lit(1.0).alias("confidence"))


def agent_findings(found: DataFrame) -> DataFrame:
    """Ranking rows of agent-configuration findings (scan, path, line, rule, category, severity, tier)."""
    risk = F.col("category").isin("dangerous_agent_config", "unverified_mcp_package")
    return found.select("scan", F.col("severity").alias("band"), F.when(risk, "agent_config_risk").otherwise("agent_instruction_injection").alias("kind"),
        F.concat(F.replace("rule", F.lit("_"), F.lit(" ")), F.lit(" in "), "path").alias("title"), F.concat_ws(":", "path", "line").alias("location"),
        F.when(F.col("rule").startswith("mcp_package_"), "M").otherwise("S").alias("effort"), F.when(F.col("tier") == 1, 1.0).otherwise(0.7).alias("confidence"))


def code_findings(symbols: DataFrame) -> DataFrame:
    """Ranking rows of dead code (scan, name, path, line, confidence)."""
    return symbols.select("scan", F.lit("low").alias("band"), F.lit("dead_code").alias("kind"), F.concat("name", F.lit(" appears unused")).alias("title"),
        F.concat_ws(":", "path", "line").alias("location"), F.lit("S").alias("effort"), "confidence")


def licence_findings(conflicts: DataFrame) -> DataFrame:
    """Ranking rows of licence conflicts (scan, package_name, ecosystem, licence, severity)."""
    return conflicts.select("scan", F.when(F.col("severity") == "high", "high").otherwise("medium").alias("band"), F.lit("license_conflict").alias("kind"),
        F.concat("package_name", F.lit(" licence ("), F.coalesce("licence", F.lit("none declared")), F.lit(") may conflict")).alias("title"),
        F.when(F.col("ecosystem") == "npm", "package.json").otherwise("requirements").alias("location"), F.lit("L").alias("effort"), F.lit(0.7).alias("confidence"))


def duplicate_findings(groups: DataFrame) -> DataFrame:
    """Ranking rows of duplicate libraries (scan, ecosystem, packages)."""
    return groups.select("scan", F.lit("low").alias("band"), F.lit("duplicate_library").alias("kind"), F.concat(F.array_join("packages", " + "), F.lit(" overlap in purpose")).alias("title"),
        F.when(F.col("ecosystem") == "npm", "package.json").otherwise("requirements").alias("location"), F.lit("M").alias("effort"), F.lit(0.6).alias("confidence"))


def ranked(*findings: DataFrame, limit: int = 20) -> DataFrame:
    """The first findings of each scan: band, kind, surest, cheapest, then title."""
    rows = reduce(DataFrame.unionByName, findings)
    order = [rank_in(rules.BANDS, "band"), rank_in(rules.KINDS, "kind", 99), F.desc("confidence"), rank_in(rules.EFFORTS, "effort"), F.collate("title", "UNICODE"), F.col("title"), F.col("location")]
    w = Window.partitionBy("scan").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
