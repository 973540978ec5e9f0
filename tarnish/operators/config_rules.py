"""Findings in tool-server configuration and permission files, as JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.scalar import invocation, invocation_identity

_SERVER = "struct<command:string,args:array<string>," + ",".join(f"{k}:string" for k in rules.AUTO_APPROVE_KEYS) + ">"
_FLAGS = ",".join(f"{k}:string" for k in rules.AUTO_APPROVE_KEYS)
_ROOT = f"struct<mcpServers:map<string,{_SERVER}>,servers:map<string,{_SERVER}>,permissions:struct<allow:array<string>>,{_FLAGS}>"
FINDING = ["path", "rule", "category", "severity", "tier", "server", "evidence"]


def parsed(configs: DataFrame) -> DataFrame:
    """Configs (path, surface, content) with their content read; unreadable ones have null."""
    return configs.withColumn("doc", F.from_json("content", _ROOT))


def servers(configs: DataFrame, either: bool = False) -> DataFrame:
    """(path, server, command, args, ...): one row per tool server; `either` also reads the key `servers`."""
    where = F.coalesce("doc.mcpServers", "doc.servers") if either else F.col("doc.mcpServers")
    rows = parsed(configs).where("surface = 'mcp_config'").select("path", F.explode(where).alias("server", "s"))
    args = F.filter(F.coalesce("s.args", F.array().cast("array<string>")), lambda a: a.isNotNull())
    return rows.where("s is not null").select("path", "server", F.coalesce("s.command", F.lit("")).alias("command"), args.alias("args"), "s")


def approves(value: Column) -> Column:
    """A flag that is true or a list with something in it."""
    return (value == "true") | value.rlike(r"^\[\s*[^\s\]]")


def package_argument(command: Column, args: Column) -> Column:
    """What npx or uvx is asked to run."""
    free = F.filter(args, lambda a: ~a.startswith("-"))
    return F.when(command.isin("npx", "uvx"), F.get(free, F.lit(0)))


def pinned(spec: Column) -> Column:
    return spec.rlike(r"^.+@[^@]*\z")


def audit(configs: DataFrame) -> DataFrame:
    """Standing approvals, shells, unpinned packages and wildcard permissions."""
    files = parsed(configs).where("doc is not null")
    every = servers(configs)

    def flags(df: DataFrame, holder: str, server: Column) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(approves(F.col(f"{holder}.{k}")), F.concat(F.lit(f"{k}: "), F.col(f"{holder}.{k}"))) for k in rules.AUTO_APPROVE_KEYS]))
        return df.select("path", server.alias("server"), F.explode(found).alias("evidence")).select("path", F.lit("always_allow").alias("rule"), F.lit("dangerous_agent_config").alias("category"),
            F.lit("critical").alias("severity"), F.lit(1).alias("tier"), "server", "evidence")

    command, args = F.col("command"), F.col("args")
    shell = command.rlike(rules.SHELL_COMMAND) | F.exists(args, lambda a: a.rlike(rules.SHELL_METACHAR))
    package = package_argument(command, args)
    loose = command.isin("npx", "uvx") & F.exists(args, lambda a: a.isin("-y", "--yes")) & package.isNotNull() & ~pinned(package)
    row = lambda rule, cat, sev, tier, ev: [F.lit(rule).alias("rule"), F.lit(cat).alias("category"), F.lit(sev).alias("severity"), F.lit(tier).alias("tier"), "server", ev.alias("evidence")]
    shells = every.where(shell).select("path", *row("mcp_shell_command", "dangerous_agent_config", "critical", 1, invocation(command, args)))
    unpinned = every.where(loose).select("path", *row("unpinned_npx", "unverified_mcp_package", "medium", 2, F.concat(command, F.lit(" -y "), package)))
    allow = files.where("surface = 'permissions'").select("path", F.lit(None).cast("string").alias("server"), F.explode("doc.permissions.allow").alias("entry"))
    wild = allow.where(F.col("entry").rlike(rules.WILDCARD_PERMISSION)).select("path", *row("wildcard_permission", "dangerous_agent_config", "high", 1, F.col("entry")))
    root = flags(files.where("surface in ('mcp_config', 'permissions')"), "doc", F.lit(None).cast("string"))
    return root.unionByName(flags(every, "s", F.col("server"))).unionByName(shells).unionByName(unpinned).unionByName(wild).select(*FINDING)


def package_refs(configs: DataFrame) -> DataFrame:
    """(path, server, ecosystem, name, pinned): packages that tool servers run."""
    package = package_argument(F.col("command"), F.col("args"))
    rows = servers(configs).withColumn("spec", package).where("spec is not null")
    name = F.when(pinned(F.col("spec")), F.regexp_extract("spec", r"^(.+)@[^@]*\z", 1)).otherwise(F.col("spec"))
    return rows.select("path", "server", F.when(F.col("command") == "npx", "npm").otherwise("pypi").alias("ecosystem"), name.alias("name"), pinned(F.col("spec")).alias("pinned"))


def package_findings(refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings for packages of tool servers whose verdict (ecosystem, name, status, typosquat_of) isn't clean."""
    rows = refs.join(verdicts, ["ecosystem", "name"])
    s, squat = F.col("status"), F.col("typosquat_of").isNotNull()
    rule = F.when(s == "phantom", "mcp_package_phantom").when(squat, "mcp_package_typosquat").when(s.isin("suspicious", "vulnerable"), F.concat(F.lit("mcp_package_"), s))
    severity = F.when(s == "phantom", "critical").when(squat, "high").otherwise("medium")
    return rows.withColumn("rule", rule).where("rule is not null").select("path", "rule", F.lit("unverified_mcp_package").alias("category"), severity.alias("severity"), F.lit(2).alias("tier"), "server", F.col("name").alias("evidence"))


def assess(found: DataFrame) -> DataFrame:
    """Adds package_ref, pinned, shell, paths, remote, reasons and risk to tool servers (command, args)."""
    command, args = F.trim(F.col("command")), F.col("args")
    binary = F.element_at(F.split(F.lower(command), r"[\\/]"), -1)
    shell = binary.isin(*rules.RISK_SHELLS) | F.exists(args, lambda a: a.rlike(rules.RISK_METACHAR))
    paths = F.filter(args, lambda a: ~a.startswith("-") & a.rlike(r"^(/|~|[A-Za-z]:[\\/]|\./)"))
    spec = package_argument(command, args)
    fixed = F.coalesce(spec.rlike(r"^.+@[\d~^><=v][^@]*\z"), F.lit(True))
    remote = command.rlike(rules.REMOTE_ENDPOINT)
    rows = found.withColumns({"shell": shell, "paths": paths, "remote": remote, "pinned": ~remote & fixed, "package_ref": F.when(fixed, F.regexp_extract(spec, r"^(.+)@[^@]*\z", 1)).otherwise(spec)})
    rows = rows.withColumn("package_ref", F.when(spec.isNotNull(), F.col("package_ref")))
    reasons = F.array_compact(F.array(
        F.when(F.col("shell"), "shell"), F.when(F.size("paths") > 0, "filesystem_paths"), F.when(F.col("remote"), "remote_endpoint"),
        F.when(~F.col("remote") & (command == ""), "no_executable"), F.when(~F.col("pinned") & F.col("package_ref").isNotNull(), "unpinned_package")))
    return rows.withColumn("reasons", reasons).withColumn("risk", F.when(F.col("shell"), "high").when(F.size("reasons") >= 1, "medium").otherwise("low"))


def collisions(proposed: DataFrame, configured: DataFrame) -> DataFrame:
    """Adds collision and verdict to proposed servers: the name is taken by another program, or it is risky, or it is fine."""
    have = configured.groupBy("server").agg(F.collect_set(invocation_identity("command", "args")).alias("_have"))
    rows = assess(proposed).join(have, "server", "left")
    other = F.col("_have").isNotNull() & ~F.array_contains("_have", invocation_identity("command", "args"))
    verdict = F.when(other | (F.col("risk") == "high"), "do_not_add").when(F.col("risk") == "medium", "review").otherwise("ok")
    return rows.withColumns({"collision": other, "verdict": verdict}).drop("_have")


def redefined(revisions: DataFrame) -> DataFrame:
    """(path, seq, server, severity): servers whose program changed from one revision of a file to the next.

    revisions: (path, seq, content). A new version of the same package is no
    change, a server added is none; one that gained a shell is critical.
    """
    w = Window.partitionBy("path").orderBy("seq")
    numbered = revisions.withColumn("_k", F.row_number().over(w))
    each = servers(numbered.withColumns({"surface": F.lit("mcp_config"), "path": F.concat_ws("\0", "path", "seq", "_k")}), either=True)
    part = lambda k: F.split_part("path", F.lit("\0"), F.lit(k))
    each = each.select(part(1).alias("path"), part(2).cast("long").alias("seq"), part(3).cast("int").alias("_k"), "server", "command", "args")
    shell = F.col("command").rlike(rules.SHELL_COMMAND) | F.exists("args", lambda a: a.rlike(rules.SHELL_METACHAR))
    each = each.withColumns({"identity": invocation_identity("command", "args"), "shell": shell})
    before = each.select("path", "server", (F.col("_k") + 1).alias("_k"), F.col("identity").alias("was"), F.col("shell").alias("had_shell"))
    changed = each.join(before, ["path", "server", "_k"]).where("identity <> was")
    return changed.select("path", "seq", "server", "was", "identity", F.when(F.col("shell") & ~F.col("had_shell"), "critical").otherwise("high").alias("severity"))


def verify_lock(found: DataFrame, lock: DataFrame) -> DataFrame:
    """(server, rule, severity): servers (server, command, args) that a lock (server, identity) lacks or has otherwise."""
    now = found.select("server", invocation_identity("command", "args").alias("identity"))
    rows = now.join(lock.select("server", F.col("identity").alias("_locked")), "server", "left")
    rule = F.when(F.col("_locked").isNull(), "mcp_server_unapproved").when(F.col("_locked") != F.col("identity"), "mcp_lock_mismatch")
    return rows.withColumn("rule", rule).where("rule is not null").select("server", "rule", F.when(F.col("rule") == "mcp_lock_mismatch", "critical").otherwise("high").alias("severity"))


def stale_locks(found: DataFrame, lock: DataFrame) -> DataFrame:
    return lock.join(found, "server", "left_anti")


def verify_files(files: DataFrame, lock: DataFrame | None) -> DataFrame:
    """The same for instruction files (path, hash); no lock of files at all says nothing."""
    if lock is None:
        return files.select("path", F.lit("").alias("rule"), F.lit("").alias("severity")).limit(0)
    rows = files.join(lock.select("path", F.col("hash").alias("_locked")), "path", "left")
    rule = F.when(F.col("_locked").isNull(), "instruction_file_unapproved").when(F.col("_locked") != F.col("hash"), "instruction_file_modified")
    return rows.withColumn("rule", rule).where("rule is not null").select("path", "rule", F.when(F.col("rule") == "instruction_file_modified", "critical").otherwise("high").alias("severity"))


def rebuilt_lock(found: DataFrame, previous: DataFrame, key: str, value: str, as_of: Column) -> DataFrame:
    """A new lock (key, value, approved_at): what hasn't changed keeps its time of approval."""
    old = previous.select(key, F.col(value).alias("_was"), F.col("approved_at").alias("_at"))
    same = F.col("_was") == F.col(value)
    return found.select(key, value).join(old, key, "left").select(key, value, F.when(same, F.col("_at")).otherwise(as_of).alias("approved_at"))


def surface_score(found: DataFrame) -> DataFrame:
    """Exposure per path from counts of findings by severity: 100 times what each damage leaves."""
    from tarnish.operators.scoring import axis, by_severity

    counts = found.groupBy("path").agg(*[F.count_if(F.col("severity") == s).alias(f"agent_{s}") for s in rules.AGENT_DAMAGE])
    return counts.withColumn("score", axis(*by_severity("agent", rules.AGENT_DAMAGE)))


def locked_servers(locks: DataFrame) -> DataFrame:
    """(repo, server, identity) of lock files (repo, content): of version 1 only; a malformed file counts as none."""
    doc = F.from_json("content", "version int, servers map<string,struct<identity:string>>", {"mode": "PERMISSIVE"})
    rows = locks.select("repo", doc.alias("d")).where("d.version = 1 AND d.servers IS NOT NULL")
    return rows.select("repo", F.explode("d.servers").alias("server", "_s")).select("repo", "server", F.col("_s.identity").alias("identity"))
