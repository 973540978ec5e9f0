"""Rules over strings made from the rows of tables.

What a rule reads is made by one expression that both dialects know; the rule
itself is written twice, in Spark by the library and in SQL here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions import scalar as S
from tarnish.operators import config_rules, dependencies, history, lifecycle, packages
from tarnish.operators import relational as R
from tarnish.plans.registry import query
from tarnish.plans.standins import AS_OF, table
from tarnish.sources import registry

K, N = "CAST(p_partkey AS STRING)", "replace(p_name, ' ', '-')"


def _case(*values: str) -> str:
    """One of several by the part's number."""
    return "CASE p_partkey % {} {} END".format(len(values), " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)))


#: For each function what it reads of a part.
READ = {
    "specifier": _case(f"'@' || lower(p_type) || '/' || {N} || '/deep'", f"{N} || '/sub'", f"'./' || {N}", f"'@/' || {N}", f"'node:' || {N}", "'@' || p_type", "'~/x'", f"'#' || {N}", "''"),
    "pypi": "replace(p_name, ' ', '_.') || '-' || p_brand", "import": _case("'cv2'", "'PIL'", "'yaml'", "replace(p_name, ' ', '_')"),
    "strip": _case(f"{N} || '@1.' || {K}", f"'@s/' || {N} || '@latest'", f"'@s/' || {N}", f"{N} || '@example.org'", f"{N} || '@^' || {K} || '.0'", f"{N}"),
    "version": _case(f"'^1.' || {K} || '.3'", f"'>=' || {K} || '.0.0 <99'", "'*'", "'workspace:*'", f"'~' || {K}", f"{K} || '.2.3-rc.1'", f"'1.2.' || {K} || '.4'", "'latest'"),
    "error": _case("'fatal: Repository not found ' || p_name", "'clone took too long'", "'Timed out: ' || p_name", "'too many files'", "p_name", "'returned error: 404'", "'SIZE CAP'"),
    "csv": "p_name || ' \"' || p_brand || '\"'", "html": "'<' || p_name || '&' || p_brand || '>'", "markdown": "p_brand || ' | ' || p_type || ' [x](y)'", "key": "p_brand || ':' || p_name",
    "wait": _case(f"{K} || 's'", f"{K} || 'm3.5s'", f"'1h' || {K} || 'm'", "'2h'", "'soon'"),
    "requirement": _case(f"{N} || '[async]>=2.' || {K} || '  # web'", "'-r other.txt'", f"{N}", "'# only'", f"{N} || ' == ' || {K} || ' ; python_version < \"3\"'", f"'https://x/' || {N}"),
    "surface": _case("'.claude/settings.json'", f"{N} || '/.mcp.json'", f"{N} || '/CLAUDE.md'", "'node_modules/a/CLAUDE.md'", "'README.md'", f"'src/' || {N} || '.py'", "'.claude/skills/' || p_brand || '/SKILL.md'", "'test/fixtures/AGENTS.md'"),
    "url": _case(f"'https://github.com/' || p_type || '/' || {N} || '.git'", f"'https://github.com/' || p_type || '/' || {N} || '/'", "'https://u:p@github.com/o/r'", f"'http://github.com/o/' || {N}", f"' https://github.com/o/' || {N} || ' '"),
    "licence": _case("'MIT'", "'(MIT OR GPL-3.0)'", "'MIT AND LGPL-2.1'", "'GPL-2.0 WITH Classpath-exception-2.0'", "'Apache-2.0 or AGPL-3.0 and MIT'", "p_type", "'mpl-2.0'", "'(ISC)'"),
}


def _q(pattern: str) -> str:
    return pattern.replace("'", "''").replace(r"\z", "$")


_TERM = f"""CASE WHEN regexp_matches(z, '{_q(rules.WEAK_LICENCE)}') THEN 2 WHEN regexp_matches(z, '{_q(rules.STRONG_LICENCE)}') THEN 3 WHEN regexp_matches(z, '{_q(rules.PERMISSIVE_LICENCE)}') THEN 0 ELSE 1 END"""
_BARE = r"trim(regexp_replace(trim(regexp_replace(z, '(?i)\s+WITH\s.*', '')), '^\(+|\)+$', '', 'g'))"
_UNIT = lambda unit: f"coalesce(TRY_CAST(nullif(regexp_extract(x, '([\\d.]+){unit}', 1), '') AS DOUBLE), 0)"
_CLEAN = r"trim(split_part(trim(regexp_replace(x, '(^|\s)#.*$', '')), ';', 1))"
_REQ = r"'^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===).*)?$'"
#: For each function the rule in SQL, of x.
RULES = {
    "specifier": r"CASE WHEN regexp_matches(x, '^([./#]|node:|@/|~/|$)') THEN NULL WHEN x LIKE '@%' THEN nullif(regexp_extract(x, '^@[^/]+/[^/]+'), '') ELSE split_part(x, '/', 1) END",
    "pypi": "lower(regexp_replace(x, '[-_.]+', '-', 'g'))",
    "import": "lower(regexp_replace(CASE x {} ELSE x END, '[-_.]+', '-', 'g'))".format(" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.IMPORT_TO_PYPI.items())),
    "strip": f"CASE WHEN regexp_matches(x, '^.+@[^@]*$') AND regexp_matches(regexp_extract(x, '([^@]*)$', 1), '{_q(rules.VERSION_SUFFIX)}') THEN regexp_extract(x, '^(.+)@[^@]*$', 1) ELSE x END",
    "version": r"nullif(regexp_extract(x, '\d+(\.\d+){0,2}([-+][0-9A-Za-z.-]+)?'), '')",
    "error": "CASE WHEN x ILIKE '%repository not found%' OR x LIKE '%error: 40_%' THEN 'unreachable' WHEN x ILIKE '%timed out%' OR x ILIKE '%too long%' THEN 'timeout' WHEN x ILIKE '%too many files%' OR x ILIKE '%size cap%' THEN 'too_large' ELSE 'other' END",
    "csv": "'\"' || replace(x, '\"', '\"\"') || '\"'", "html": "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
    "markdown": r"regexp_replace(x, '([\\`*_{}\[\]()#+!|<>~-])', '\\\1', 'g')", "key": r"replace(replace(x, '\', '\\'), ':', '\:')",
    "wait": f"(({_UNIT('h')}) * 3600 + coalesce(TRY_CAST(nullif(regexp_extract(x, '([\\d.]+)m', 1), '') AS DOUBLE), 0) * 60 + {_UNIT('s')})::VARCHAR",
    "requirement": f"CASE WHEN regexp_matches({_CLEAN}, {_REQ}) THEN lower(regexp_replace(regexp_extract({_CLEAN}, {_REQ}, 1), '[-_.]+', '-', 'g')) || '|' || trim(regexp_extract({_CLEAN}, {_REQ}, 2)) END",
    "surface": "CASE WHEN regexp_matches(x, '{}') OR regexp_matches(x, '{}') THEN NULL {} END".format(_q(rules.EXCLUDED_PATH), _q(rules.EXCLUDED_FIXTURE), " ".join(f"WHEN regexp_matches(x, '{_q(p)}') THEN '{n}'" for n, p in rules.SURFACES)),
    "url": r"CASE WHEN regexp_matches(trim(x), '^https://github\.com/[\w.-]+/[\w.-]+/?$') THEN regexp_replace(regexp_replace(regexp_replace(trim(x), '^https://github.com/', ''), '/$', ''), '\.git$', '') END",
    "licence": f"""(SELECT ['permissive', 'unknown', 'weak-copyleft', 'strong-copyleft'][1 + min(worst)] FROM (SELECT a, max({_TERM.replace("z", "t")}) AS worst FROM (SELECT a, {_BARE} AS t
        FROM (SELECT a, unnest(regexp_split_to_array(a, '(?i)\\s+AND\\s+')) AS z FROM (SELECT unnest(regexp_split_to_array(x, '(?i)\\s+OR\\s+')) AS a))) GROUP BY a))""",
}


def _applied(kind, x):
    req, repo = S.requirement(x), S.repo_of_url(x)
    return {
        "specifier": S.package_of_specifier, "pypi": S.pypi_name, "import": S.distribution_of_import, "strip": S.strip_version, "version": S.coerce_version, "error": S.scan_error, "csv": S.csv_cell, "html": S.html_safe,
        "markdown": S.markdown_safe, "key": S.identity_key, "wait": lambda c: S.decimal_text(S.rate_limit_seconds(c)), "surface": S.classify_path, "licence": S.licence_class,
        "requirement": lambda c: F.when(req.isNotNull(), F.concat(req["name"], F.lit("|"), F.coalesce(req["spec"], F.lit("")))), "url": lambda c: F.when(repo.isNotNull(), F.concat_ws("/", repo["owner"], repo["name"])),
    }[kind](x)


def _each(kinds):
    """Rows (id, kind, y): each kind's function over all parts."""
    sql = " UNION ALL ".join(f"SELECT p_partkey AS id, '{k}' AS kind, {RULES[k]} AS y FROM (SELECT p_partkey, {READ[k].replace('STRING', 'VARCHAR')} AS x FROM part)" for k in kinds)

    def run(spark, d):
        parts = table(spark, d, "part").select("p_partkey", *[F.expr(READ[k]).alias(k) for k in kinds])
        told = F.array(*[F.struct(F.lit(k).alias("kind"), _applied(k, F.col(k)).alias("y")) for k in kinds])
        return parts.select(F.col("p_partkey").alias("id"), F.inline(told))

    return sql, run


for _name, _kinds in {
    "part_names": ["specifier", "pypi", "import", "strip", "version", "requirement"], "part_texts": ["csv", "html", "markdown", "key"], "part_kinds": ["error", "wait", "surface", "url", "licence"],
}.items():
    _sql, _run = _each(_kinds)
    query(_name, _sql)(_run)


@query("document_lines", """SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) END AS lines, sha256(replace(regexp_replace(text, '^\\x{FEFF}', ''), chr(13) || chr(10), chr(10))) AS hash FROM documents""")
def document_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", S.line_count("text").cast("long").alias("lines"), S.instruction_hash("text").alias("hash"))


_COMMIT = """CASE event_id % 6 WHEN 0 THEN 'dependabot[bot]' WHEN 1 THEN 'aider' ELSE 'user ' || CAST(user_id AS STRING) END AS author,
    CASE WHEN event_id % 7 = 0 THEN 'x@cursor-agent.dev' ELSE 'u@x.org' END AS email, event_type || CASE WHEN event_id % 4 = 0 THEN ' co-authored-by: claude <a@b.c>' ELSE '' END AS message"""


@query("commit_rows", f"""SELECT event_id AS sha, author LIKE 'dependabot%' AS automation, author NOT LIKE 'dependabot%' AND (message LIKE '%claude%' OR author = 'aider' OR email LIKE '%cursor-agent%') AS ai
    FROM (SELECT event_id, {_COMMIT.replace("STRING", "VARCHAR")} FROM events)""")
def commit_rows(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS sha", *[f"{e}" for e in _COMMIT.replace("\n", " ").split(", ")])
    return history.classified(rows).select("sha", "automation", "ai")


# Tool servers: one configuration for each customer.
_SERVERS = """SELECT c_custkey AS k, 's' || CAST(c_custkey AS STRING) AS server, 'c' || CAST(c_custkey AS STRING) || '/.mcp.json' AS path,
    CASE c_custkey % 7 WHEN 0 THEN 'npx' WHEN 1 THEN 'bash' WHEN 2 THEN 'node' WHEN 3 THEN 'uvx' WHEN 4 THEN 'https://mcp.example.com/sse' WHEN 5 THEN 'npx' ELSE '' END AS command,
    CASE c_custkey % 5 WHEN 0 THEN '-y' WHEN 1 THEN '-c' WHEN 2 THEN '/home' WHEN 3 THEN '--yes' ELSE 'a | b' END AS a1,
    'pkg-' || CAST(c_custkey % 9 AS STRING) || CASE c_custkey % 4 WHEN 0 THEN '@1.' || CAST(c_custkey AS STRING) WHEN 1 THEN '@latest' ELSE '' END AS a2 FROM customer"""
_S = f"s AS ({_SERVERS.replace('STRING', 'VARCHAR')}), p AS (SELECT *, CASE WHEN command IN ('npx', 'uvx') THEN CASE WHEN a1 NOT LIKE '-%' THEN a1 ELSE a2 END END AS package FROM s)"
_STRIP = lambda c: "(SELECT " + RULES["strip"] + f" FROM (SELECT {c} AS x))"
_ID = f"trim(command || ' ' || {_STRIP('a1')} || ' ' || {_STRIP('a2')})"


def tool_servers(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer_of_tool_servers")
    return spark.sql(_SERVERS.replace("FROM customer", "FROM customer_of_tool_servers"))


def configs_of(rows, *flags):
    """Rows (k, server, path, command, a1, a2) as configuration files."""
    server = F.struct("command", F.array("a1", "a2").alias("args"), *flags)
    return rows.select("path", F.lit("mcp_config").alias("surface"), F.to_json(F.struct(F.map_from_arrays(F.array("server"), F.array(server)).alias("mcpServers"))).alias("content"))


@query("config_rows", f"""WITH {_S}
    SELECT path, 'always_allow' AS rule, server FROM s WHERE k % 6 = 0
    UNION ALL SELECT path, 'mcp_shell_command', server FROM s WHERE regexp_matches(command, '{_q(rules.SHELL_COMMAND)}') OR regexp_matches(a1, '{_q(rules.SHELL_METACHAR)}')
    UNION ALL SELECT path, 'unpinned_npx', server FROM p WHERE package IS NOT NULL AND a1 IN ('-y', '--yes') AND NOT regexp_matches(package, '^.+@[^@]*$')
    UNION ALL SELECT 'p' || c_custkey || '/.claude/settings.json', 'wildcard_permission', NULL FROM customer WHERE c_custkey % 3 = 0""")
def config_rows(spark, d):
    allow = F.when(F.col("k") % 6 == 0, F.array(F.lit("t"))).when(F.col("k") % 6 == 1, F.array().cast("array<string>"))
    files = configs_of(tool_servers(spark, d), allow.alias("alwaysAllow"))
    k = F.col("c_custkey")
    permissions = table(spark, d, "customer").select(F.concat(F.lit("p"), k, F.lit("/.claude/settings.json")).alias("path"), F.lit("permissions").alias("surface"),
        F.to_json(F.struct(F.struct(F.array(F.when(k % 3 == 0, "Bash(*)").otherwise("Bash(ls)"), F.lit("Read(src/**)")).alias("allow")).alias("permissions"))).alias("content"))
    broken = permissions.select("path", "surface", F.expr("left(content, 5)").alias("content"))
    return config_rules.audit(files.unionByName(permissions).unionByName(broken.withColumn("path", F.concat(F.lit("x"), "path")))).select("path", "rule", "server")


@query("server_rows", f"""WITH {_S}, f AS (SELECT *, command IN ({", ".join(f"'{x}'" for x in rules.RISK_SHELLS)}) OR regexp_matches(a1, '{_q(rules.RISK_METACHAR)}') AS shell, a1 LIKE '/%' AS paths, command LIKE 'https://%' AS remote,
        coalesce(regexp_matches(package, '^.+@[\\d~^><=v][^@]*$'), true) AS fixed FROM p),
    r AS (SELECT *, list_filter([CASE WHEN shell THEN 'shell' END, CASE WHEN paths THEN 'filesystem_paths' END, CASE WHEN remote THEN 'remote_endpoint' END, CASE WHEN command = '' THEN 'no_executable' END,
        CASE WHEN NOT remote AND NOT fixed AND package IS NOT NULL THEN 'unpinned_package' END], lambda x: x IS NOT NULL) AS reasons FROM f)
    SELECT server, CASE WHEN shell THEN 'high' WHEN len(reasons) > 0 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN fixed THEN regexp_extract(package, '^(.+)@[^@]*$', 1) ELSE package END AS package_ref, NOT remote AND fixed AS pinned, array_to_string(reasons, ',') AS reasons FROM r""")
def server_rows(spark, d):
    found = config_rules.assess(config_rules.servers(configs_of(tool_servers(spark, d))))
    return found.select("server", "risk", "package_ref", "pinned", F.array_join("reasons", ",").alias("reasons"))


@query("lock_rows", f"""WITH {_S} SELECT server, CASE k % 3 WHEN 1 THEN 'mcp_lock_mismatch' ELSE 'mcp_server_unapproved' END AS rule, CASE k % 3 WHEN 1 THEN 'critical' ELSE 'high' END AS severity FROM s WHERE k % 3 > 0
    UNION ALL SELECT 'gone' || k, 'stale', 'low' FROM s WHERE k % 10 = 0""")
def lock_rows(spark, d):
    rows = tool_servers(spark, d)
    found = config_rules.servers(configs_of(rows))
    args = F.array("a1", F.regexp_replace("a2", "@.*", "@9.9"))  # another version is no other program
    same = rows.where("k % 3 = 0").select("server", S.invocation_identity("command", args).alias("identity"))
    other = rows.where("k % 3 = 1").select("server", F.concat("command", F.lit(" other")).alias("identity"))
    gone = rows.where("k % 10 = 0").select(F.concat(F.lit("gone"), "k").alias("server"), F.lit("x").alias("identity"))
    lock = same.unionByName(other).unionByName(gone)
    return config_rules.verify_lock(found, lock).unionByName(config_rules.stale_locks(found, lock).select("server", F.lit("stale").alias("rule"), F.lit("low").alias("severity")))


@query("redefinition_rows", f"""WITH {_S}, v AS (SELECT *, CASE k % 4 WHEN 1 THEN 'q-' || a2 ELSE a2 END AS b2, CASE WHEN k % 4 = 2 THEN 'bash' ELSE command END AS b, regexp_matches(a1, '{_q(rules.SHELL_METACHAR)}') AS piped FROM s)
    SELECT path, 2 AS seq, server, CASE WHEN b = 'bash' AND command <> 'bash' AND NOT piped THEN 'critical' ELSE 'high' END AS severity FROM v WHERE {_STRIP('b2')} <> {_STRIP('a2')} OR b <> command""")
def redefinition_rows(spark, d):
    rows = tool_servers(spark, d)
    k = F.col("k") % 4
    second = F.when(k == 1, F.concat(F.lit("q-"), "a2")).when((k == 3) & ~F.col("a2").contains("@"), F.concat("a2", F.lit("@2.0"))).otherwise(F.col("a2"))
    later = rows.withColumns({"a2": second, "command": F.when(k == 2, "bash").otherwise(F.col("command"))})
    revision = lambda r, seq: configs_of(r).select("path", F.lit(seq).alias("seq"), "content")
    return config_rules.redefined(revision(rows, 1).unionByName(revision(later, 2))).select("path", F.col("seq").cast("int").alias("seq"), "server", "severity")


# Packages: one for each part, in twenty repositories.
_PACKAGES = """q AS (SELECT p_partkey AS k, 'r' || p_partkey % 20 AS repo, 'package-of-part-' || p_partkey AS name, p_partkey % 2 = 0 OR p_partkey % 5 = 0 AS declared, p_partkey % 3 = 0 AS imported,
        CASE p_partkey % 7 WHEN 0 THEN 'not_found' WHEN 1 THEN 'error' ELSE 'ok' END AS lookup, p_partkey % 10 * 20 AS downloads, p_partkey % 200 AS age, p_partkey % 11 = 0 AS member FROM part),
    v AS (SELECT *, CASE WHEN member OR lookup = 'error' THEN CASE WHEN declared AND NOT imported THEN 'unused' ELSE 'healthy' END WHEN lookup = 'not_found' THEN 'phantom'
        WHEN declared AND NOT imported THEN 'unused' WHEN downloads < 50 OR age < 90 THEN 'suspicious' ELSE 'healthy' END AS status, CASE WHEN lookup = 'error' AND NOT member THEN 'registry_unreachable' END AS error FROM q WHERE declared OR imported)"""


def package_verdicts(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("r"), k % 20).alias("repo"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("package-of-part-"), k).alias("name"))
    declared = rows.where("k % 2 = 0 OR k % 5 = 0").select("repo", "ecosystem", "name", F.lit("^1.2.3").alias("spec"), F.lit(False).alias("is_dev"))
    imported = rows.where("k % 3 = 0").select("repo", "ecosystem", "name")
    lookup = F.when(F.col("k") % 7 == 0, "not_found").when(F.col("k") % 7 == 1, "error").otherwise("ok")
    registry = rows.select("ecosystem", "name", lookup.alias("lookup_status"), (F.col("k") % 10 * 20).cast("double").alias("downloads"), (R.moment(AS_OF) - F.make_dt_interval(days=(F.col("k") % 200).cast("int"))).alias("created"))
    required = spark.createDataFrame([], "repo string, ecosystem string, name string")
    listed = dependencies.exempt(dependencies.declared_or_imported(declared, imported), required)
    return dependencies.verdicts(listed, registry, rows.where("k % 11 = 0").select("repo", "name"), R.moment(AS_OF))


@query("verdict_rows", f"WITH {_PACKAGES} SELECT repo, name, status, error, member AS workspace_member FROM v")
def verdict_rows(spark, d):
    return package_verdicts(spark, d).select("repo", "name", "status", "error", "workspace_member")


@query("vulnerability_rows", f"""WITH {_PACKAGES}, a AS (SELECT repo, name, CASE WHEN k % 17 = 0 THEN 'critical' ELSE 'high' END AS worst FROM q WHERE k % 13 = 0 OR k % 17 = 0 UNION ALL SELECT repo, 'deep-' || k, 'medium' FROM q WHERE k % 29 = 0)
    SELECT coalesce(v.repo, a.repo) AS repo, coalesce(v.name, a.name) AS name, CASE WHEN a.worst IS NOT NULL AND (v.status IS NULL OR v.status <> 'phantom') THEN 'vulnerable' ELSE v.status END AS status, a.worst AS max_severity, v.status IS NULL AS transitive
    FROM v FULL JOIN a ON v.repo = a.repo AND v.name = a.name""")
def vulnerability_rows(spark, d):
    k = F.col("p_partkey")
    told = F.array_compact(F.array(
        *[F.when(k % 13 == 0, F.struct(F.concat(F.lit("package-of-part-"), k).alias("name"), F.lit(i).alias("id"), F.lit(s).alias("severity"))) for i, s in (("G-1", "low"), ("G-2", "high"))],
        F.when(k % 17 == 0, F.struct(F.concat(F.lit("package-of-part-"), k).alias("name"), F.lit("G-3").alias("id"), F.lit("critical").alias("severity"))),
        F.when(k % 29 == 0, F.struct(F.concat(F.lit("deep-"), k).alias("name"), F.lit("G-4").alias("id"), F.lit("medium").alias("severity"))),
    ))
    advisories = table(spark, d, "part").select(F.concat(F.lit("r"), k % 20).alias("repo"), F.lit("npm").alias("ecosystem"), F.inline(told))
    return dependencies.apply_vulnerabilities(package_verdicts(spark, d), advisories).select("repo", "name", "status", "max_severity", "transitive")


# Registry documents: one for each part, of several shapes.
@query("registry_rows", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 9 THEN 'not_found' WHEN p_partkey % 10 = 8 THEN 'error' ELSE 'ok' END AS lookup_status,
    CASE WHEN p_partkey % 10 < 8 THEN CASE WHEN p_partkey % 2 = 1 THEN p_size WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 0 ELSE p_size END END::DOUBLE AS downloads,
    CASE WHEN p_partkey % 10 < 8 THEN '2020-01-0' || (1 + p_partkey % 5) END AS created, CASE WHEN p_partkey % 10 < 8 THEN '1.' || p_partkey END AS latest,
    CASE WHEN p_partkey % 10 < 8 THEN CASE WHEN p_partkey % 2 = 1 THEN 'MIT' WHEN p_partkey % 4 = 0 THEN 'ISC' ELSE 'BSD-' || p_size END END AS licence,
    CASE WHEN p_partkey % 10 < 8 THEN CASE WHEN p_partkey % 2 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'yanked from the index' END WHEN p_partkey % 6 = 0 THEN 'use ' || p_name END END AS deprecated,
    CASE WHEN p_partkey % 10 < 8 AND p_partkey % 2 = 0 THEN p_size * 100 END AS unpacked_size FROM part""")
def registry_rows(spark, d):
    return registry.records(registry_documents(spark, d)).select(
        F.regexp_extract("name", r"\d+", 0).cast("long").alias("id"), "lookup_status", "downloads", F.date_format("created", "yyyy-MM-dd").alias("created"), "latest", "licence", "deprecated", "unpacked_size")


@query("release_rows", """SELECT p_partkey AS id, '1.' || p_partkey AS version, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 = 0 THEN 'use ' || p_name END AS deprecated, p_partkey % 2 = 1 AND p_partkey % 5 = 0 AS yanked FROM part WHERE p_partkey % 10 < 8
    UNION ALL SELECT p_partkey, '0.9', NULL, false FROM part WHERE p_partkey % 10 < 8""")
def release_rows(spark, d):
    return registry.versions(registry_documents(spark, d)).select(F.regexp_extract("name", r"\d+", 0).cast("long").alias("id"), "version", "deprecated", "yanked")


def registry_documents(spark, d):
    k = F.col("p_partkey")
    at, version, last = F.concat(F.lit("2020-01-0"), 1 + k % 5, F.lit("T10:00:00.000Z")), F.concat(F.lit("1."), k), F.lit("2021-05-05T00:00:00Z")
    licence = F.when(k % 4 == 0, '"ISC"').otherwise(F.concat(F.lit('{"type": "BSD-'), "p_size", F.lit('"}')))
    notice = F.when(k % 6 == 0, F.concat(F.lit(', "deprecated": "use '), "p_name", F.lit('"'))).when(k % 6 == 2, ', "deprecated": true').otherwise("")
    npm = F.concat(F.lit('{"dist-tags": {"latest": "'), version, F.lit('"}, "time": {"created": "'), at, F.lit('"}, "versions": {"0.9": {"license": 5}, "'), version, F.lit('": {"license": '), licence, F.lit(', "dist": {"unpackedSize": '), F.col("p_size") * 100, F.lit("}"), notice, F.lit("}}}"))
    pypi = F.concat(F.lit('{"info": {"version": "'), version, F.lit('", "license": "MIT", "classifiers": null, "yanked": '), F.when(k % 3 == 0, "true").otherwise("null"), F.lit('}, "releases": {"0.9": [], "'), version,
        F.lit('": [{"upload_time_iso_8601": "'), last, F.lit('", "yanked": true}, {"upload_time_iso_8601": "'), at, F.lit('", "yanked": '), F.when(k % 5 == 0, "true").otherwise("false"), F.lit("}]}}"))
    counted = F.when(k % 2 == 1, F.concat(F.lit('{"data": {"last_month": '), "p_size", F.lit("}}"))).when(k % 3 == 1, '{"downloads": null}').when(k % 3 == 2, F.concat(F.lit('{"downloads": '), "p_size", F.lit("}")))
    return table(spark, d, "part").select(
        F.when(k % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"), F.concat(F.lit("part-"), k).alias("name"), F.when(k % 10 == 9, 404).otherwise(200).alias("http_status"),
        F.when(k % 10 == 9, None).when(k % 10 == 8, "<html>").when(k % 2 == 0, npm).otherwise(pypi).alias("body"), counted.alias("downloads"))


@query("verified_documents", """SELECT p_partkey AS id, p_partkey % 10 <> 9 AS there,
    CASE WHEN p_partkey % 10 < 8 THEN CASE WHEN p_partkey % 2 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'yanked from the index' END WHEN p_partkey % 6 = 0 THEN 'use ' || p_name END END AS deprecated FROM part WHERE p_partkey % 10 <> 8""")
def verified_documents(spark, d):
    """Packages verified against the documents; one whose lookup failed is not asked for."""
    found = registry.records(registry_documents(spark, d))
    asked = found.where("lookup_status <> 'error'").select("ecosystem", "name", F.lit(None).cast("string").alias("version"))
    none = spark.createDataFrame([], "ecosystem string, name string, version string, id string, severity string")
    told = packages.verify(asked, found.where("lookup_status = 'ok'"), none, R.moment(AS_OF))
    return told.select(F.regexp_extract("name", r"\d+", 0).cast("long").alias("id"), F.col("exists").alias("there"), "deprecated")


@query("identity_rows", f"""WITH {_PACKAGES}, {_S}, e AS (
    SELECT repo, 'dependency' AS kind, 'dependency:npm:' || name || ':' || status AS finding_key, name || ' (' || status || ')' AS title, NULL AS location FROM v WHERE status <> 'healthy'
    UNION ALL SELECT 'r' || p_partkey % 20, 'dead_code', 'dead_code:src/' || replace(replace(p_brand, '\\', '\\\\'), ':', '\\:') || '\\:x.ts:f' || p_partkey % 30, 'f' || p_partkey % 30 || ' in src/' || p_brand || ':x.ts', 'src/' || p_brand || ':x.ts' FROM part
    UNION ALL SELECT 'r' || k % 20, 'secret', 'secret:' || md5((k % 50)::VARCHAR), 'aws in ' || path, path FROM s UNION ALL SELECT 'r' || k % 20, 'agent_config', 'agent_config:' || path || ':always_allow', 'always_allow in ' || path, path FROM s WHERE k % 6 = 0)
    SELECT repo, kind, finding_key, min(title) AS title, arg_min(location, title) AS location FROM e GROUP BY ALL""")
def identity_rows(spark, d):
    k = F.col("k")
    rows = tool_servers(spark, d).withColumn("repo", F.concat(F.lit("r"), k % 20))
    dead = table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey") % 20).alias("repo"), F.concat(F.lit("src/"), "p_brand", F.lit(":x.ts")).alias("path"), F.concat(F.lit("f"), F.col("p_partkey") % 30).alias("name"))
    secrets = rows.select("repo", F.md5((k % 50).cast("string")).alias("fingerprint"), F.lit("aws").alias("provider"), "path")
    agent = rows.where("k % 6 = 0").select("repo", "path", F.lit("always_allow").alias("rule"))
    return lifecycle.identities(package_verdicts(spark, d), dead, secrets, agent)


@query("installation_rows", """WITH i AS (SELECT c_nationkey AS org, c_custkey AS installation, upper(c_name) AS full_name FROM customer UNION ALL SELECT c_nationkey, c_custkey + 1, lower(c_name) FROM customer WHERE c_custkey % 2 = 0)
    SELECT c.c_nationkey AS org, c.c_name AS full_name, min(i.installation) AS installation FROM customer c LEFT JOIN i ON i.org = c.c_nationkey AND lower(i.full_name) = lower(c.c_name) AND c.c_custkey % 3 > 0 GROUP BY ALL""")
def installation_rows(spark, d):
    users = table(spark, d, "customer").select(F.col("c_nationkey").alias("org"), F.col("c_custkey").alias("installation"), F.col("c_name").alias("full_name"))
    there = users.where("installation % 3 > 0")
    again = there.where("installation % 2 = 0").select("org", (F.col("installation") + 1).alias("installation"), F.lower("full_name").alias("full_name"))
    return R.first_installation(users.select("org", "full_name"), there.withColumn("full_name", F.upper("full_name")).unionByName(again))


@query("mailboxes", "SELECT lower(trim(x)) AS mailbox, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN ' User' WHEN 1 THEN 'USER' ELSE 'user' END || o_custkey || '@X.org ' AS x FROM orders) GROUP BY 1")
def mailboxes(spark, d):
    k = F.col("o_orderkey") % 3
    address = F.concat(F.when(k == 0, " User").when(k == 1, "USER").otherwise("user"), F.col("o_custkey"), F.lit("@X.org "))
    return table(spark, d, "orders").select(S.normalise_email(address).alias("mailbox")).groupBy("mailbox").agg(F.count(F.lit(1)).alias("n"))


@query("finding_keys", """SELECT c.conv_id, c.turn, role || ':' || turn || ':' || left(sha256(text), 12) AS key FROM conversations c WHERE text IS NOT NULL AND role IS NOT NULL""")
def finding_keys(spark, d):
    return table(spark, d, "conversations").where("text IS NOT NULL AND role IS NOT NULL").select("conv_id", "turn", S.evidence_key("role", "turn", "text").alias("key"))


@query("locked_server_rows", f"""WITH {_S} SELECT 'r' || k AS repo, server, {_ID} AS identity FROM s WHERE k % 4 = 0""")
def locked_server_rows(spark, d):
    rows = tool_servers(spark, d)
    identity = S.invocation_identity("command", F.array("a1", "a2"))
    doc = F.to_json(F.struct(F.when(F.col("k") % 4 == 1, 2).otherwise(1).alias("version"), F.map_from_arrays(F.array("server"), F.array(F.struct(identity.alias("identity")))).alias("servers")))
    content = F.when(F.col("k") % 4 == 2, F.expr("left(doc, 20)")).when(F.col("k") % 4 == 3, '{"version": 1}').otherwise(F.col("doc"))
    return config_rules.locked_servers(rows.withColumn("doc", doc).select(F.concat(F.lit("r"), "k").alias("repo"), content.alias("content")))
