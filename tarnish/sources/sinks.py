"""Writers: findings, upserts, reports and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.functions.scalar import badge_colour, csv_cell, grade, html_safe, markdown_safe


def append_findings(findings: DataFrame, path: str) -> None:
    """Findings by repository; a certain rule has confidence 1, a linguistic one 0.7."""
    tier = F.when(F.col("tier") == 1, 1.0).otherwise(0.7) if "tier" in findings.columns else F.col("confidence")
    findings.withColumn("confidence", tier).write.mode("append").partitionBy("repo").parquet(path)


def write_state(state: DataFrame, path: str) -> DataFrame:
    """Writes a snapshot beside the ones before it and returns it; readers take the newest name.

    The state may have been read from the snapshot it replaces: nothing is overwritten.
    """
    spark = state.sparkSession
    at = f"{path}/{spark.sql('select unix_micros(current_timestamp())').first()[0]:020d}-{uuid.uuid4().hex[:8]}"
    state.write.parquet(at)
    return spark.read.parquet(at)


def read_state(spark, path: str) -> DataFrame | None:
    """The newest snapshot; null if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    done = sorted(s.getPath().toString() for s in fs.listStatus(hadoop) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(done[-1]) if done else None


def latest_scores(scans: DataFrame) -> DataFrame:
    """(repo, latest_score): of the last scan to complete; derived, so never out of date."""
    return scans.where("status = 'complete'").groupBy("repo").agg(F.max_by("score", F.struct("completed_at", "scan")).alias("latest_score"))


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str], most: int = 10_000) -> None:
    """The first `most` rows as one CSV file, every cell quoted, header plain: an export's length."""
    cells = rows.orderBy(*order).limit(most).select(F.concat_ws(",", *[csv_cell(c) for c in columns]).alias("value"), *order)
    header = rows.sparkSession.createDataFrame([(",".join(columns), 0)], "value string, _k int")
    lines = header.unionByName(cells.select("value", F.lit(1).alias("_k"), *order), allowMissingColumns=True)
    lines.orderBy("_k", *order).coalesce(1).select("value").write.mode("overwrite").text(path)


def json_reports(scans: DataFrame) -> DataFrame:
    """(scan, report): each row as JSON."""
    return scans.select("scan", F.to_json(F.struct(*[c for c in scans.columns if c != "scan"])).alias("report"))


def pr_comments(scans: DataFrame, ranked: DataFrame, top: int = 3) -> DataFrame:
    """(scan, comment) in Markdown: score, what to do, and the first findings."""
    first = ranked.where(F.col("rank") <= top).groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("rank", "band", "title"))).alias("f"))
    lines = F.transform("f", lambda x: F.concat(F.lit("- **"), x["band"], F.lit("** "), markdown_safe(x["title"])))
    rows = scans.join(first, "scan", "left")
    body = F.concat_ws("\n", F.concat(F.lit("## Score "), F.col("score").cast("string"), F.lit(" ("), grade("score"), F.lit(")")), F.concat(F.lit("Recommendation: "), "recommendation"), F.array_join(lines, "\n"))
    return rows.select("scan", body.alias("comment"))


def html_reports(findings: DataFrame) -> DataFrame:
    """(scan, html): findings in sections for secrets, agent configuration and code."""
    kind = F.col("finding_type")
    section = F.when(kind.startswith("hardcoded_secret"), "Secrets").when(kind.startswith("agent_"), "Agent configuration").otherwise("Code")
    item = F.concat(F.lit("<li>"), html_safe("title"), F.lit("</li>"))
    per = findings.groupBy("scan", section.alias("section")).agg(F.concat(F.lit("<ul>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</ul>")).alias("list"))
    part = F.concat(F.lit("<h2>"), "section", F.lit("</h2>"), "list")
    return per.groupBy("scan").agg(F.array_join(F.sort_array(F.collect_list(part)), "").alias("html"))


def badges(repos: DataFrame) -> DataFrame:
    """(repo, svg): grade and colour of the latest score."""
    letter = F.coalesce(grade("latest_score"), F.lit("?"))
    letter = F.when(F.col("latest_score").isNull(), "?").otherwise(letter)
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="90" height="20"><rect width="90" height="20" fill="'), badge_colour("latest_score"), F.lit('"/><text x="60" y="14" fill="#fff">'), letter, F.lit("</text></svg>"))
    return repos.select("repo", svg.alias("svg"))
