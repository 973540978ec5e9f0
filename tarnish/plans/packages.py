"""Queries about single packages, over names and records derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.scalar import system_event
from tarnish.operators import packages
from tarnish.operators import relational as R
from tarnish.plans.analysis import SQUATS, values
from tarnish.plans.registry import query
from tarnish.plans.standins import AS_OF, table

NAMES = sorted({n for _, n in SQUATS} | {n for _, n in rules.HALLUCINATED} | {"Python_Dotnev", "numpy", "left-pad"})
CLASSIFIERS = [
    "License :: OSI Approved :: MIT License", "License :: OSI Approved :: GNU General Public License v2 (GPLv2)", "License :: OSI Approved :: GNU Lesser General Public License v3", "License :: OSI Approved",
    "License :: OSI Approved :: GNU Affero General Public License v3", "License :: OSI Approved :: Mozilla Public License 2.0 (MPL 2.0)", "Topic :: Software Development :: GPL tools", "License :: Public Domain",
]
EXPRESSIONS = [None, "", "MIT", "Apache-2.0 WITH LLVM-exception", None, "BSD-3-Clause AND MIT"]
LEGACY = [None, "python-ldap", "Dual Licensed - GNU AFFERO GPL 3.0 or Artifex Commercial License", "Apache License, Version 2.0", "see file", ""]
IMPORTS = ["os", "sys", "json", "cv2", "numpy", "PIL", "yaml", "utils1", "src", "app", "sklearn", "my_mod", "main", "tomllib"]
MEMBERS = [(e, m.upper() if k == 1 else m) for _, e, ms, _ in rules.EQUIVALENT_GROUPS for k, m in enumerate(ms)] + [("npm", "left-pad")]


def listed(words, at):
    """The word at a place of a fixed list, as SQL of both engines counts: from 1."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))


def sql_listed(words, at: str) -> str:
    return f"[{', '.join('NULL' if w is None else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in words)}][({at}) % {len(words)} + 1]"


def asked_for(spark, d):
    k = F.col("p_partkey")
    name = F.concat(listed(NAMES, k), F.when(k % 3 == 0, "").otherwise((k % 40).cast("string")))
    return table(spark, d, "part").select(F.when(k % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"), name.alias("name"), F.when(k % 4 == 0, "1.0.0").alias("version"))


@query("verify_packages", f"""
    WITH a AS (SELECT DISTINCT ecosystem, CASE ecosystem WHEN 'pypi' THEN lower(regexp_replace(name, '[-_.]+', '-', 'g')) ELSE name END AS name, version FROM (
        SELECT CASE p_partkey % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, {sql_listed(NAMES, 'p_partkey')} || CASE p_partkey % 3 WHEN 0 THEN '' ELSE (p_partkey % 40)::VARCHAR END AS name,
        CASE p_partkey % 4 WHEN 0 THEN '1.0.0' END AS version FROM part)),
    n AS (SELECT ecosystem, name, length(name) * 7 + ascii(name) AS h FROM a GROUP BY ALL),
    g AS (SELECT *, CASE WHEN h % 11 > 0 THEN [10, 150, 5000, 200000][h % 4 + 1] END AS downloads, floor(h % 7 * 30 + 0.5 + 0.5) AS age, '1.0.' || h % 3 AS latest FROM n WHERE h % 5 > 0),
    p AS (SELECT * FROM {values([(e, n, k) for e, ns in rules.POPULAR.items() for k, n in enumerate(ns)], 'ecosystem', 'target', 'pos')}),
    pairs AS (SELECT n.ecosystem, name, target, pos, damerau_levenshtein(name, target) AS distance FROM n JOIN p ON n.ecosystem = p.ecosystem AND length(target) >= 4
        WHERE length(name) >= 4 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.ecosystem = n.ecosystem AND q.target = n.name) AND damerau_levenshtein(name, target) BETWEEN 1 AND 2),
    c AS (SELECT ecosystem, name, arg_min(target, distance * 1000 + pos) AS target, min(distance)::INT AS distance FROM pairs GROUP BY ALL),
    l AS (SELECT * FROM {values([(e, n, rules.CONFUSED_WITH.get(n)) for e, n in rules.HALLUCINATED], 'ecosystem', 'name', 'confused_with')}),
    f AS (SELECT a.*, g.name IS NOT NULL AS there, l.name IS NOT NULL AS listed, age, target, distance, confused_with, coalesce(downloads < CASE a.ecosystem WHEN 'npm' THEN 50 ELSE 200 END, false) AS few,
        coalesce(age < 90, false) AS new, coalesce(downloads >= 100000, false) AS established, h % 6 = 1 AND coalesce(version, latest) = '1.0.' || h % 2 AS bad, h % 12 < 6 AS milder
        FROM a LEFT JOIN g USING (ecosystem, name) LEFT JOIN c USING (ecosystem, name) LEFT JOIN l ON l.ecosystem = a.ecosystem AND l.name = lower(a.name)),
    s AS (SELECT *, target IS NOT NULL AND (few OR new OR distance = 1 AND NOT established) AS alike FROM f)
    SELECT ecosystem, name, version, CASE WHEN NOT there THEN 'phantom' WHEN bad THEN 'vulnerable' WHEN few OR new OR alike OR listed THEN 'suspicious' ELSE 'healthy' END AS status,
        concat_ws(',', CASE WHEN there AND few THEN 'low_downloads' END, CASE WHEN there AND new THEN 'newly_published' END, CASE WHEN there AND alike THEN 'typosquat' END, CASE WHEN listed THEN 'hallucinated' END, CASE WHEN there AND bad THEN 'vulnerable' END) AS why,
        age AS age_days, CASE WHEN there AND alike THEN target END AS typosquat_of, CASE WHEN there AND alike THEN distance END AS typosquat_distance,
        CASE WHEN NOT there AND target IS NOT NULL THEN target ELSE confused_with END AS alternative,
        CASE WHEN NOT there AND target IS NOT NULL THEN CASE distance WHEN 1 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END WHEN confused_with IS NOT NULL THEN 1::DOUBLE END AS alternative_confidence,
        CASE WHEN bad THEN 2 END AS vulnerabilities, CASE WHEN bad THEN CASE WHEN milder THEN 'high' ELSE 'critical' END END AS max_severity FROM s""")
def verify_packages(spark, d):
    asked = asked_for(spark, d)
    name = F.when(F.col("ecosystem") == "pypi", F.lower(F.regexp_replace("name", "[-_.]+", "-"))).otherwise(F.col("name"))
    known = asked.select("ecosystem", name.alias("name")).distinct().withColumn("h", F.length("name") * 7 + F.ascii("name"))
    h = F.col("h")
    downloads = F.when(h % 11 > 0, F.element_at(F.array(*[F.lit(x) for x in (10, 150, 5000, 200000)]), h % 4 + 1))
    created = R.moment(AS_OF) - F.make_dt_interval(days=h % 7 * 30, hours=F.lit(12))
    registry = known.where(h % 5 > 0).select("ecosystem", "name", downloads.alias("downloads"), created.alias("created"), F.concat(F.lit("1.0."), h % 3).alias("latest"))
    told = F.array(F.struct(F.lit("A-1").alias("id"), F.lit("low").alias("severity")), F.struct(F.lit("A-2").alias("id"), F.when(h % 12 < 6, "high").otherwise("critical").alias("severity")))
    advisories = known.where((h % 6 == 1) & (h % 5 > 0)).select("ecosystem", "name", F.concat(F.lit("1.0."), h % 2).alias("version"), F.inline(told))
    return packages.verify(asked, registry, advisories, R.moment(AS_OF)).withColumn("why", F.array_join("why", ",")).drop("exists").drop("deprecated")


_FAMILY = lambda t: "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{f}'" for f, p in rules.LICENCE_FAMILIES) + " END"
_RANK = lambda f: f"CASE WHEN {f} IN ('LGPL', 'MPL', 'EPL') THEN 2 WHEN {f} IN ('AGPL', 'GPL') THEN 3 ELSE 0 END"


@query("licence_records", f"""
    WITH r AS (SELECT doc_id, {sql_listed(EXPRESSIONS, 'doc_id')} AS e, CASE WHEN doc_id % 4 = 0 THEN text ELSE {sql_listed(LEGACY, 'doc_id // 4')} END AS l,
        [{sql_listed(CLASSIFIERS, 'doc_id')}, {sql_listed(CLASSIFIERS, 'doc_id // 8')}] AS c FROM documents),
    k AS (SELECT *, coalesce(contains(l, chr(10)) OR length(l) > 200, false) AS whole, list_transform(list_filter(c, lambda x: starts_with(x, 'License ::')), lambda x: trim(split_part(x, '::', -1))) AS leaves FROM r),
    n AS (SELECT *, coalesce(nullif(e, ''), CASE WHEN NOT whole THEN nullif(l, '') END) AS named, list_filter(list_transform(leaves, lambda x: {_FAMILY('x')}), lambda x: x IS NOT NULL) AS families FROM k),
    b AS (SELECT *, list_filter(families, lambda x: {_RANK('x')} = list_max(list_transform(families, lambda y: {_RANK('y')})))[1] AS best FROM n)
    SELECT doc_id, best AS of_classifiers, CASE WHEN named IS NULL OR NOT regexp_matches(trim(named), '(?i)^\\(*(LGPL|MPL|EPL|CDDL|CECILL-C|Artistic|AGPL|GPL|SSPL|OSL|EUPL|MIT|ISC|Apache|BSD|BSL|0BSD|Unlicense|CC0|Zlib|PSF|Python|WTFPL)')
        AND NOT regexp_matches(trim(named), '^[A-Za-z0-9.+()-]+(\\s+(AND|OR|WITH)\\s+[A-Za-z0-9.+()-]+)*$') THEN coalesce(best, {_FAMILY('named')}, named) ELSE named END AS licence, nullif(e, '') IS NULL AND whole AS has_licence_text FROM b""")
def licence_records(spark, d):
    k = F.col("doc_id")
    part = lambda n: F.floor(k / n)
    legacy = F.when(k % 4 == 0, F.col("text")).otherwise(listed(LEGACY, part(4)))
    rows = table(spark, d, "documents").select("doc_id", listed(EXPRESSIONS, k).alias("e"), legacy.alias("l"), F.array(listed(CLASSIFIERS, k), listed(CLASSIFIERS, part(8))).alias("c"))
    return rows.select("doc_id", packages.licence_of_classifiers(F.col("c")).alias("of_classifiers"), F.inline(F.array(packages.resolved_licence(F.col("e"), F.col("l"), F.col("c")))))


@query("first_releases", "SELECT l_orderkey AS id, min(strftime(l_shipdate, '%Y-%m-%d')) FILTER (l_linenumber % 4 <> 1) AS created FROM lineitem GROUP BY 1")
def first_releases(spark, d):
    at = F.when(F.col("l_linenumber") % 4 == 1, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(F.struct(at.alias("uploaded"))).alias("files"))
    return per.groupBy(F.col("l_orderkey").alias("id")).agg(packages.first_release(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "files")))).alias("created"))


_KNOWN = "CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.IMPORT_TO_PYPI.items()) + " ELSE name END"


@query("python_distributions", f"""
    WITH i AS (SELECT DISTINCT user_id AS repo, {sql_listed(IMPORTS, 'event_id')} AS name FROM events),
    m AS (SELECT c_custkey AS repo, unnest(CASE c_custkey % 3 WHEN 0 THEN ['src', 'utils' || c_custkey % 4] WHEN 1 THEN ['app', 'main'] ELSE []::VARCHAR[] END) AS name FROM customer)
    SELECT DISTINCT repo, 'pypi' AS ecosystem, lower(regexp_replace({_KNOWN}, '[-_.]+', '-', 'g')) AS name FROM i
    WHERE name NOT IN (SELECT name FROM {values([(x,) for x in rules.PYTHON_STDLIB], 'name')}) AND NOT EXISTS (SELECT 1 FROM m WHERE m.repo = i.repo AND m.name = i.name)""")
def python_distributions(spark, d):
    imports = table(spark, d, "events").select(F.col("user_id").alias("repo"), listed(IMPORTS, F.col("event_id")).alias("name"))
    k = F.col("c_custkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("src/utils"), k % 4, F.lit(".py"))).when(k % 3 == 1, "app/main.py").otherwise("docs/numpy.md")
    return packages.imported_distributions(imports, table(spark, d, "customer").select(k.alias("repo"), path.alias("path")))


@query("proposed_dependencies", f"""
    WITH g AS (SELECT * FROM {values([(c, e, m, k, p) for c, e, ms, p in rules.EQUIVALENT_GROUPS for k, m in enumerate(ms)], 'category', 'ecosystem', 'name', 'pos', 'prefer')}),
    a AS (SELECT c_custkey AS repo, {sql_listed([e for e, _ in MEMBERS], 'c_custkey')} AS ecosystem, {sql_listed([m for _, m in MEMBERS], 'c_custkey')} AS name FROM customer),
    h AS (SELECT DISTINCT o_custkey AS repo, lower({sql_listed([m for _, m in MEMBERS], 'o_orderkey * 7')}) AS name FROM orders),
    x AS (SELECT a.repo, a.ecosystem, a.name, string_agg(o.name, ',' ORDER BY o.pos) AS existing, any_value(g.category) AS category, any_value(g.prefer) AS prefer
        FROM a JOIN g ON g.ecosystem = a.ecosystem AND g.name = lower(a.name) JOIN g o ON o.ecosystem = g.ecosystem AND o.category = g.category AND o.name <> g.name JOIN h ON h.repo = a.repo AND h.name = o.name GROUP BY ALL)
    SELECT repo, ecosystem, name, EXISTS (SELECT 1 FROM h WHERE h.repo = a.repo AND h.name = lower(a.name)) AS already_declared, category, existing, prefer FROM a LEFT JOIN x USING (repo, ecosystem, name)""")
def proposed_dependencies(spark, d):
    names = [m for _, m in MEMBERS]
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(k.alias("repo"), listed([e for e, _ in MEMBERS], k).alias("ecosystem"), listed(names, k).alias("name"))
    declared = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), listed(names, F.col("o_orderkey") * 7).alias("name"))
    return packages.proposed(asked, declared).withColumn("existing", F.array_join("existing", ","))


@query("system_events", """SELECT doc_id, substring(text, 1, 2000) AS message, CASE WHEN doc_id % 3 > 0 THEN array_to_string(string_split(text, chr(10))[1:12], chr(10)) END AS stack FROM documents""")
def system_events(spark, d):
    docs = table(spark, d, "documents")
    logged = system_event(F.col("text"), F.when(F.col("doc_id") % 3 > 0, F.col("text")))
    return docs.select("doc_id", logged.alias("e")).select("doc_id", "e.message", F.get_json_object("e.context", "$.stack").alias("stack"))
