"""What a commit about to be made would bring in, from blobs (repo, path, content) of the index and of HEAD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.scalar import classify_path
from tarnish.operators import code, config_rules, dependencies, packages, secrets, text_rules
from tarnish.session import shared_dir
from tarnish.sources import manifests

REPORT = ["repo", "path", "section", "rule", "severity", "line", "subject"]
#: Additions of a repository that are looked up where a caller doesn't say; the rest is counted.
CHECKED = 25


def declared_names(blobs: DataFrame) -> DataFrame:
    """(repo, path, ecosystem, name): what each manifest declares by itself, wherever it lies; unreadable ones nothing."""
    file = F.lower(F.element_at(F.split("path", "/"), -1))
    own = blobs.where(F.col("path").rlike(rules.MANIFEST)).select(F.struct("repo", "path").alias("repo"), file.alias("path"), "content")
    found = manifests.npm_declared(own).unionByName(manifests.python_declared(own))
    return found.select("repo.repo", "repo.path", "ecosystem", "name").distinct()


def added_names(staged: DataFrame, head: DataFrame, checked: int | None = CHECKED) -> DataFrame:
    """(repo, path, ecosystem, name, checked): names that a manifest's HEAD lacks; the first `checked` of a repository are to be looked up, all if that is None."""
    new = declared_names(staged).join(declared_names(head), ["repo", "path", "ecosystem", "name"], "left_anti")
    if checked is None:
        return new.withColumn("checked", F.lit(True))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("path", "ecosystem", "name"))
    return new.withColumn("checked", place <= checked)


def from_repositories(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(staged, head) of repositories that all executors can read; `sources.register` makes the format known."""
    read = lambda what: spark.read.format("git_history").options(roots=",".join(roots), what=what).load()
    return read("staged"), read("head")


def stored(blobs: DataFrame, name: str = "staged-blobs") -> DataFrame:
    """Blobs, or what is made of them, written once to the shared folder, in even parts: a scan reads them a dozen times, and small files can take long to scan."""
    spark = blobs.sparkSession
    path = shared_dir(spark, name)
    blobs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    return spark.read.schema(blobs.schema).parquet(path)


def row(section: str, rule: Column, severity: Column, line: Column, subject: Column) -> list[Column | str]:
    return ["repo", "path", F.lit(section).alias("section"), rule.alias("rule"), severity.alias("severity"), line.cast("int").alias("line"), subject.alias("subject")]


def scan(staged: DataFrame, head: DataFrame, registry: DataFrame, advisories: DataFrame, as_of: Column, policy: dict | None = None, lock: DataFrame | None = None, tree: DataFrame | None = None, checked: int | None = CHECKED) -> DataFrame:
    """Everything found in the blobs of the index, as rows of REPORT.

    registry: (ecosystem, name, downloads, created, latest, licence); a name
    that is asked for and absent counts as missing, so leave out additions whose
    lookup failed. Files that assistants read as configuration get the
    configuration rules, their other files the text rules, never both. Servers
    are held against HEAD, and against lock (repo, server, identity) where there
    is one: those of the working tree's files, `tree`, so that a server changed
    before counts too, of the staged files if no tree is given. With `checked` None all additions are looked up; otherwise those
    beyond the first `checked` of a repository are one row `not_checked`, with their number as its line.
    """
    none = F.lit(None).cast("string")
    blob = [F.col(c).cast("string").alias(c) for c in ("repo", "path", "content")]
    staged, head = stored(staged.select(*blob, classify_path("path").alias("surface"))), stored(head.select(*blob))
    # Rules below know files by path alone: one key for repository and path.
    keyed = staged.where("surface is not null").select("*", F.concat("repo", F.lit("\1"), "path").alias("_key"))
    by_key = keyed.select("repo", "path", F.col("_key").alias("_k"))
    back = lambda found: found.withColumnRenamed("path", "_k").join(by_key, "_k")
    files = keyed.select(F.col("_key").alias("path"), "surface", "content")
    config, text = files.where("surface in ('mcp_config', 'permissions')"), files.where("surface not in ('mcp_config', 'permissions')")
    keys = secrets.scan_secrets(code.code_lines(staged), ("repo",))
    parts = [keys.select(*row("secret", F.col("provider"), none, F.col("line"), F.col("redacted")))]
    parts.append(back(config_rules.audit(config)).select(*row("config", F.col("rule"), F.col("severity"), F.lit(None), F.coalesce("server", "evidence"))))
    parts.append(back(text_rules.scan_text(text)).select(*row("config", F.col("rule"), F.col("severity"), F.col("line"), F.col("evidence"))))

    before = head.select(F.concat("repo", F.lit("\1"), "path").alias("path"), F.lit(0).alias("seq"), "content")
    now = config.where("surface = 'mcp_config'").select("path", F.lit(1).alias("seq"), "content")
    drift = config_rules.redefined(before.join(now.select("path"), "path", "left_semi").unionByName(now))
    parts.append(back(drift).select(*row("config", F.lit("mcp_server_redefined"), F.col("severity"), F.lit(None), F.col("server"))))

    added = stored(added_names(staged, head, checked), "staged-additions")
    asked = added.where("checked")
    verdict = packages.verify(asked.select("ecosystem", "name", none.alias("version")), registry, advisories, as_of)
    known = asked.join(verdict, ["ecosystem", "name"])
    parts.append(known.where("status <> 'healthy'").select(*row("dependency", F.col("status"), F.col("max_severity"), F.lit(None), F.col("name"))))
    if checked is not None:
        more = added.where("not checked").groupBy("repo").agg(F.count(F.lit(1)).alias("n")).withColumn("path", none)
        parts.append(more.select(*row("dependency", F.lit("not_checked"), none, F.col("n"), none)))

    found = config_rules.servers(config)
    if policy is not None:
        facts = known.join(registry.select("ecosystem", "name", "downloads", "licence"), ["ecosystem", "name"], "left")
        parts.append(dependencies.policy_violations(facts, policy).select(*row("policy", F.col("rule"), none, F.lit(None), F.col("name"))))
        broken = dependencies.server_policy_violations(config_rules.assess(found), policy)
        parts.append(back(broken).select(*row("policy", F.col("rule"), none, F.lit(None), F.col("server"))))
    if lock is not None:
        owned = lambda df, repo: df.withColumn("server", F.concat(repo, F.lit("\1"), "server"))
        standing = found
        if tree is not None:
            configs = tree.where(classify_path("path") == "mcp_config")
            standing = config_rules.servers(configs.select(F.concat("repo", F.lit("\1"), "path").alias("path"), F.lit("mcp_config").alias("surface"), "content"))
            by_key = by_key.unionByName(configs.select("repo", "path", F.concat("repo", F.lit("\1"), "path").alias("_k"))).distinct()
        there = owned(standing, F.substring_index("path", "\1", 1))
        off = config_rules.verify_lock(there.select("server", "command", "args").distinct(), owned(lock, F.col("repo")))
        where = off.join(there.select("server", "path").distinct(), "server").withColumn("server", F.substring_index("server", "\1", -1))
        parts.append(back(where).select(*row("config", F.col("rule"), F.col("severity"), F.lit(None), F.col("server"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def blocking(report: DataFrame) -> DataFrame:
    """(repo, blocking): rows that keep a commit back: credentials, grave findings, missing or vulnerable additions, broken policy."""
    s, rule = F.col("section"), F.col("rule")
    stops = s.isin("secret", "policy") | (s == "config") & F.col("severity").isin("critical", "high") | (s == "dependency") & rule.isin("phantom", "vulnerable")
    return report.groupBy("repo").agg(F.count_if(F.coalesce(stops, F.lit(False))).alias("blocking"))
