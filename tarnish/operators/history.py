"""Commit history: authorship, hotspots, where dependencies came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.scalar import round_half_up


def classified(commits: DataFrame) -> DataFrame:
    """Adds ai and automation to commits (sha, author, email, message); automation is never an assistant."""
    who = F.concat_ws(" ", "author", "email")
    auto = who.rlike(rules.AUTOMATION_AUTHOR)
    return commits.withColumns({"automation": auto, "ai": ~auto & (F.coalesce(F.col("message").rlike(rules.AI_TRAILER), F.lit(False)) | who.rlike(rules.AI_AUTHOR))})


def coverage(ai_commits: Column) -> Column:
    """How far the marks of assistants can be relied on."""
    return F.when(ai_commits == 0, "none").when(ai_commits < rules.MIN_AI_COMMITS, "low").otherwise("usable")


def file_authorship(touched: DataFrame) -> DataFrame:
    """Per (repo, path): commits, ai_commits and whether most are an assistant's; a tie is not."""
    per = touched.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("commits"), F.count_if("ai").alias("ai_commits"))
    return per.withColumn("ai_file", F.col("ai_commits") > F.col("commits") - F.col("ai_commits"))


def finding_density(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repo: share of files that are an assistant's, and findings per 100 files of either kind; zero if there are none."""
    marked = findings.select("repo", "path").join(files.select("repo", "path", "ai_file"), ["repo", "path"], "left")
    found = marked.groupBy("repo").agg(F.count_if(F.coalesce("ai_file", F.lit(False))).alias("_ai_f"), F.count_if(~F.coalesce("ai_file", F.lit(False))).alias("_other_f"))
    per = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_if("ai_file").alias("ai_files")).join(found, "repo", "left").fillna(0)
    rate = lambda n, d: F.when(d > 0, round_half_up(100 * n / d, 1)).otherwise(0.0)
    return per.select("repo", "files", "ai_files", rate(F.col("ai_files"), F.col("files")).alias("ai_share"), rate(F.col("_ai_f"), F.col("ai_files")).alias("ai_density"),
        rate(F.col("_other_f"), F.col("files") - F.col("ai_files")).alias("other_density"))


def hotspots(files: DataFrame, most: int = 8) -> DataFrame:
    """Files (repo, path, commits, lines) that change often and are large: commits times lines, against the repository's most."""
    base = F.element_at(F.split("path", "/"), -1)
    rows = files.where(~base.isin(*rules.LOCKFILES) & ~F.col("path").rlike(rules.DERIVED_FILE) & (F.col("lines") > 0)).withColumn("_raw", F.col("commits") * F.col("lines"))
    top = rows.groupBy("repo").agg(F.max("_raw").alias("_most"))
    scored = rows.join(top, "repo").withColumn("score", round_half_up(F.col("_raw") / F.greatest("_most", F.lit(1)), 3)).drop("_raw", "_most")
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def introductions(manifests: DataFrame, commits: DataFrame) -> DataFrame:
    """Per (repo, name): the commit in which a dependency first appears, and whether an assistant made it.

    manifests: (repo, manifest_pos, seq, name), a name's presence at a commit;
    commits: (repo, seq, sha, author, ai), numbered from the oldest. The first
    manifest listed goes before others. One there from the start predates the
    history; marks of assistants count only where they are usable.
    """
    order = F.struct("manifest_pos", "seq")
    first = manifests.groupBy("repo", "name").agg(F.min_by("seq", order).alias("seq"))
    facts = commits.groupBy("repo").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"), F.count_if("ai").alias("_n"))
    rows = first.join(commits, ["repo", "seq"]).join(facts, "repo")
    predates, level = F.col("seq") == F.col("_lo"), coverage(F.col("_n"))
    verdict = F.when(predates, "unknown").when(F.col("ai"), "likely").when(level == "usable", "unlikely").otherwise("unknown")
    return rows.select("repo", "name", F.when(~predates, F.col("sha")).alias("introduced_commit"), F.when(~predates, F.col("author")).alias("introduced_by"),
        (F.col("_hi") - F.col("seq")).alias("commits_ago"), verdict.alias("ai_assisted"), predates.alias("predates_history"))
