"""Dependency verdicts: missing, unused, suspicious, vulnerable; licences, duplicates, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.arrow import osa_distance
from tarnish.functions.scalar import age_days, coerce_version, licence_class, rank_in


def popular(spark) -> DataFrame:
    """(ecosystem, target, pos): under 300 rows, a fixed list."""
    rows = [(eco, name, k) for eco, names in rules.POPULAR.items() for k, name in enumerate(names)]
    return spark.createDataFrame(rows, "ecosystem string, target string, pos int")


def nearest_popular(names: DataFrame) -> DataFrame:
    """(ecosystem, name, target, distance) for names one or two edits from a popular one.

    The nearest wins, then the one listed first. Popular names and names under
    four letters match none. Names meet only targets that share one of their
    deletion neighbours: a hash join, not a comparison with the whole list.
    """
    spark = names.sparkSession
    listed = popular(spark)
    asked = names.select("ecosystem", "name").distinct().join(F.broadcast(listed.select("ecosystem", F.col("target").alias("name"))), ["ecosystem", "name"], "left_anti").where(F.length("name") >= 4)
    near = lambda c: F.explode(deletions(F.col(c))).alias("_key")
    pairs = asked.select("*", near("name")).join(F.broadcast(listed.where(F.length("target") >= 4).select("*", near("target"))), ["ecosystem", "_key"])
    pairs = pairs.drop("_key").distinct().where(F.abs(F.length("name") - F.length("target")) <= 2)
    measured = pairs.withColumn("distance", osa_distance("name", "target")).where("distance between 1 and 2")
    best = F.min_by(F.struct("target", "distance"), F.struct("distance", "pos")).alias("_b")
    return measured.groupBy("ecosystem", "name").agg(best).select("ecosystem", "name", "_b.*")


def deletions(name: Column) -> Column:
    """The name and all that up to two deletions make of it: two names within two edits share one."""
    def once(x):
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))

    first = once(name)
    return F.array_distinct(F.concat(F.array(name), first, F.flatten(F.transform(F.filter(first, lambda x: x != ""), once))))


def fuzzy_alternative(distance: Column) -> Column:
    return F.when(distance == 1, 0.9).when(distance == 2, 0.6)


def declared_or_imported(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, spec, is_declared, is_imported): union of both; a runtime spec goes before a development one."""
    spec = declared.groupBy("repo", "ecosystem", "name").agg(F.min_by("spec", F.col("is_dev").cast("int")).alias("spec")).withColumn("is_declared", F.lit(True))
    used = imported.select("repo", "ecosystem", "name").distinct().withColumn("is_imported", F.lit(True))
    return spec.join(used, ["repo", "ecosystem", "name"], "full").fillna(False, ["is_declared", "is_imported"])


def exempt(names: DataFrame, required: DataFrame) -> DataFrame:
    """Adds never_unused: by name, by a parent in the same repository, or required by another package."""
    n = F.col("name")
    by_name = n.isin(*rules.NEVER_UNUSED) | n.endswith("-plugin")
    for prefix in rules.NEVER_UNUSED_PREFIXES:
        by_name = by_name | n.startswith(prefix)
    # Parents that exempt a name: fixed pairs.
    pairs = [(d, p) for d in rules.ORM_DRIVERS for p in rules.ORMS] + [(d, p) for d, ps in rules.FRAMEWORK_PEERS.items() for p in ps]
    parents = names.sparkSession.createDataFrame(pairs, "name string, parent string")
    there = names.select("repo", "ecosystem", F.col("name").alias("parent"))
    peers = there.join(F.broadcast(parents), "parent").select("repo", "ecosystem", "name").distinct().withColumn("_peer", F.lit(True))
    needed = required.select("repo", "ecosystem", "name").distinct().withColumn("_required", F.lit(True))
    out = names.join(peers, ["repo", "ecosystem", "name"], "left").join(needed, ["repo", "ecosystem", "name"], "left")
    never = (F.col("ecosystem") == "npm") & (by_name | F.col("_peer").isNotNull()) | F.col("_required").isNotNull()
    return out.withColumn("never_unused", never).drop("_peer", "_required")


def verdicts(names: DataFrame, registry: DataFrame, workspace: DataFrame, as_of: Column) -> DataFrame:
    """Adds status and its reasons to (repo, ecosystem, name, spec, is_declared, is_imported, never_unused).

    registry: (ecosystem, name, lookup_status, downloads, created, ...); a name
    is missing only on a confirmed not_found; a failed lookup gives healthy or
    unused and an error. workspace: (repo, name) of the repository's own
    packages. A look-alike overrides unused, and drops the hallucination mark.
    """
    known = names.sparkSession.createDataFrame([(e, n, True) for e, n in rules.HALLUCINATED], "ecosystem string, _lower string, _listed boolean")
    own = workspace.select("repo", "name").distinct().withColumn("workspace_member", F.lit(True))
    squat = nearest_popular(names).select("ecosystem", "name", F.col("target").alias("_target"), F.col("distance").alias("_distance"))
    rows = names.join(registry, ["ecosystem", "name"], "left").join(own, ["repo", "name"], "left").join(squat, ["ecosystem", "name"], "left")
    rows = rows.withColumn("_lower", F.lower("name")).join(F.broadcast(known), ["ecosystem", "_lower"], "left")
    member, failed, missing = F.col("workspace_member").isNotNull(), F.coalesce(F.col("lookup_status") == "error", F.lit(True)), F.col("lookup_status") == "not_found"
    unused = F.col("is_declared") & ~F.col("is_imported") & ~F.col("never_unused")
    few = F.col("downloads") < F.when(F.col("ecosystem") == "npm", rules.SUSPICIOUS_DOWNLOADS["npm"]).otherwise(rules.SUSPICIOUS_DOWNLOADS["pypi"])
    doubtful = F.coalesce(few, F.lit(False)) | F.coalesce(age_days("created", as_of) < rules.SUSPICIOUS_AGE_DAYS, F.lit(False))
    first = F.when(unused, "unused").when(doubtful, "suspicious").when(F.col("_listed").isNotNull(), "suspicious").otherwise("healthy")
    established = F.coalesce(F.col("downloads") >= rules.ESTABLISHED_DOWNLOADS, F.lit(False))
    looks_alike = F.col("_target").isNotNull() & ((first == "suspicious") | (F.col("_distance") == 1) & ~established)
    looked_up = ~member & ~failed & ~missing
    return rows.select(
        "repo", "ecosystem", "name", "spec",
        F.when(member | failed, F.when(unused, "unused").otherwise("healthy")).when(missing, "phantom").when(looks_alike, "suspicious").otherwise(first).alias("status"),
        F.when(looked_up & looks_alike, F.col("_target")).alias("typosquat_of"), F.when(looked_up & looks_alike, F.col("_distance")).alias("typosquat_distance"),
        (F.col("_listed").isNotNull() & ~member & ~failed & ~(looked_up & looks_alike)).alias("hallucinated"),
        F.when(missing & ~member, F.col("_target")).alias("alternative"), F.when(missing & ~member, fuzzy_alternative(F.col("_distance"))).alias("alternative_confidence"),
        F.when(failed & ~member, "registry_unreachable").alias("error"), member.alias("workspace_member"),
    )


def vulnerability_targets(resolved: DataFrame, declared: DataFrame, most: int = 1000) -> DataFrame:
    """(repo, ecosystem, name, version) to ask advisories for: locked versions before declared ones, at most `most` a repository."""
    from pyspark.sql import Window

    locked = resolved.select("repo", "ecosystem", "name", "version", F.lit(0).alias("_from"))
    asked = declared.where("status <> 'phantom'").select("repo", "ecosystem", "name", coerce_version("spec").alias("version"), F.lit(1).alias("_from")).where("version is not null")
    # Of either kind no name beyond the first `most` can come in: as many locked ones go before it, or names that are locked too stand among these.
    near = Window.partitionBy("repo", "_from").orderBy("ecosystem", "name")
    early = locked.unionByName(asked).withColumn("_k", F.dense_rank().over(near)).where(F.col("_k") <= most)
    once = early.groupBy("repo", "ecosystem", "name").agg(F.min_by(F.struct("version", "_from"), F.struct("_from", "version")).alias("_v")).select("repo", "ecosystem", "name", "_v.*")
    w = Window.partitionBy("repo").orderBy("_from", "ecosystem", "name")
    return once.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k", "_from")


def apply_vulnerabilities(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """Verdicts with advisories (repo, ecosystem, name, id, severity) laid on: full outer join.

    A missing package stays missing; packages that only a lockfile names become
    rows of their own, marked transitive.
    """
    worst = F.max_by("severity", rank_in(rules.SEVERITIES, "severity", 0)).alias("max_severity")
    per = advisories.groupBy("repo", "ecosystem", "name").agg(worst, F.sort_array(F.collect_set("id")).alias("advisories"))
    out = found.join(per, ["repo", "ecosystem", "name"], "full")
    s = F.col("status")
    hit = F.col("advisories").isNotNull() & (s.isNull() | (s != "phantom"))
    return out.withColumns({"transitive": s.isNull(), "status": F.when(hit, "vulnerable").otherwise(s)})


def licence_conflicts(found: DataFrame, project: DataFrame) -> DataFrame:
    """Licence conflicts of (repo, ecosystem, name, status, licence, has_licence_text, ...) with each repository's own licence."""
    copyleft = F.coalesce(licence_class("project_licence").isin("weak-copyleft", "strong-copyleft"), F.lit(False))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = found.where(~F.col("status").isin("unused", "phantom") & no("workspace_member") & F.col("error").isNull() & no("transitive")).join(project, "repo", "left")
    cls = licence_class("licence")
    severity = F.when(F.col("licence").isNull(), F.when(no("has_licence_text"), "medium")).when(copyleft, None).when(cls == "strong-copyleft", "high").when(cls == "weak-copyleft", "medium")
    return rows.withColumn("severity", severity).where("severity is not null").select("repo", "ecosystem", "name", "licence", "severity")


def duplicate_groups(found: DataFrame) -> DataFrame:
    """(repo, ecosystem, category, packages, prefer): libraries of one purpose of which two or more are in use."""
    rows = [(cat, eco, m, k, prefer) for cat, eco, members, prefer in rules.EQUIVALENT_GROUPS for k, m in enumerate(members)]
    members = found.sparkSession.createDataFrame(rows, "category string, ecosystem string, name string, pos int, prefer string")
    used = found.where(~F.col("status").isin("unused", "phantom") & F.col("error").isNull()).select("repo", "ecosystem", "name").distinct()
    grouped = used.join(F.broadcast(members), ["ecosystem", "name"]).groupBy("repo", "ecosystem", "category").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("_m"), F.first("prefer").alias("prefer"))
    return grouped.where(F.size("_m") >= 2).select("repo", "ecosystem", "category", F.col("_m.name").alias("packages"), "prefer")


def policy_violations(packages: DataFrame, policy: dict) -> DataFrame:
    """(…, rule) per violation of a policy by packages (name, exists, age_days, downloads, licence).

    Keys of a policy: deny_packages, min_age_days, min_downloads,
    allow_licences, deny_licences; absent or null is no rule. An allow-list
    makes the deny-list void; rules on facts that are not known don't fire.
    """
    lower = lambda xs: [x.lower() for x in xs or []]
    exists, lic = F.col("exists"), F.lower("licence")
    fired = []
    if policy.get("deny_packages"):
        fired.append(F.when(F.lower("name").isin(lower(policy["deny_packages"])), "policy_deny_package"))
    if policy.get("min_age_days") is not None:
        fired.append(F.when(exists & (F.col("age_days") < policy["min_age_days"]), "policy_min_age"))
    if policy.get("min_downloads") is not None:
        fired.append(F.when(exists & (F.col("downloads") < policy["min_downloads"]), "policy_min_downloads"))
    if policy.get("allow_licences"):
        fired.append(F.when(exists & lic.isNotNull() & ~lic.isin(lower(policy["allow_licences"])), "policy_license_not_allowed"))
    elif policy.get("deny_licences"):
        fired.append(F.when(exists & lic.isin(lower(policy["deny_licences"])), "policy_license_denied"))
    every = F.array_compact(F.array(*fired)) if fired else F.array().cast("array<string>")
    return packages.withColumn("rule", F.explode(every))


def server_policy_violations(servers: DataFrame, policy: dict) -> DataFrame:
    """(…, rule) per violation by tool servers (shell, pinned, package_ref)."""
    fired = [F.lit(None).cast("string")]
    if policy.get("forbid_shell"):
        fired.append(F.when(F.col("shell"), "policy_forbid_shell_mcp"))
    if policy.get("forbid_unpinned"):
        fired.append(F.when(F.col("package_ref").isNotNull() & ~F.col("pinned"), "policy_forbid_unpinned_mcp"))
    return servers.withColumn("rule", F.explode(F.array_compact(F.array(*fired))))
