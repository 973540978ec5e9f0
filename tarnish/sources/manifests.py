"""Manifests and lockfiles as tables, from rows (repo, path, content)."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tarnish.functions.scalar import pypi_name, requirement

_NPM = "struct<name:string,dependencies:map<string,string>,devDependencies:map<string,string>>"


def npm_declared(files: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, spec, is_dev) of each repository's root package.json; unreadable ones have none."""
    docs = files.where("path = 'package.json'").select("repo", F.from_json("content", _NPM).alias("d"))
    each = lambda field, dev: docs.select("repo", F.lit("npm").alias("ecosystem"), F.explode(f"d.{field}").alias("name", "spec"), F.lit(dev).alias("is_dev"))
    return each("dependencies", False).unionByName(each("devDependencies", True))


def workspace_members(files: DataFrame) -> DataFrame:
    """(repo, name): packages in the folders that the root manifest's workspaces name."""
    root = files.where("path = 'package.json'").select("repo", F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>")).alias("w"))
    globs = root.select("repo", F.explode("w").alias("glob"))
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", r"/+\z", ""), r"([.+()\[\]{}^$|])", r"\\$1"), r"\*+", "[^/]+"), F.lit(r"/package\.json\z"))
    members = files.where("path like '%/package.json'").select("repo", "path", F.get_json_object("content", "$.name").alias("name")).where("name is not null")
    return members.join(globs.withColumn("pattern", pattern), "repo").where(F.expr("path rlike pattern")).select("repo", "name").distinct()


def requirement_lines(files: DataFrame) -> DataFrame:
    """(repo, path, rank, line, text) of requirements files, one level of includes followed."""
    p = F.col("path")
    lists = files.where(p.rlike(r"(?i)^requirements[\w.-]*\.txt\z") | p.rlike(r"^requirements/[^/]+\.txt\z"))
    lines = lambda df: df.select("repo", "path", F.posexplode(F.split("content", r"\r?\n", -1)).alias("line", "text"))
    own = lines(lists)
    target = F.regexp_extract(F.trim("text"), r"^(?:-r|--requirement[= ])\s*(.+)$", 1)
    folder = F.regexp_extract("path", r"^(.*/)?[^/]+\z", 1)
    named = own.where(target != "").select("repo", F.col("path").alias("_by"), F.col("line").alias("_at"), F.regexp_replace(F.concat(folder, target), r"(^|/)\./", "$1").alias("path"))
    nested = lines(files.join(named, ["repo", "path"])).join(named, ["repo", "path"])
    place = lambda *c: F.struct(*c)
    return own.select("repo", place(F.col("path").alias("a"), F.col("line").alias("b"), F.lit(-1).alias("c")).alias("place"), "text").unionByName(
        nested.select("repo", place(F.col("_by").alias("a"), F.col("_at").alias("b"), F.col("line").alias("c")).alias("place"), "text"))


@udtf(returnType="source int, position int, name string, line string")
class PyprojectDependencies:
    """(source, position, name, line): requirement strings, and names with a version from tool tables."""

    def eval(self, content: str):
        try:
            doc = tomllib.loads(content or "")
        except tomllib.TOMLDecodeError:
            return
        project = doc.get("project") or {}
        lists = [project.get("dependencies"), *((project.get("optional-dependencies") or {}).values())]
        lines = [x for xs in lists if isinstance(xs, list) for x in xs if isinstance(x, str)]
        yield from ((0, k, None, x) for k, x in enumerate(lines))
        poetry = (doc.get("tool") or {}).get("poetry") or {}
        tables = [poetry.get("dependencies"), poetry.get("dev-dependencies"), *[g.get("dependencies") for g in (poetry.get("group") or {}).values()]]
        entries = [(n, v) for t in tables if t for n, v in t.items() if n.lower() != "python"]
        for k, (name, value) in enumerate(entries):
            yield 1, k, name, value if isinstance(value, str) else str(value.get("version", "")) if isinstance(value, dict) else ""


def python_declared(files: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, spec, is_dev): requirements files, then pyproject.toml; the first declaration of a name wins."""
    asked = requirement_lines(files).select("repo", "place", requirement("text").alias("r")).where("r is not null")
    listed = asked.select("repo", F.struct(F.lit(0).alias("from"), F.col("place.a").alias("a"), F.col("place.b").alias("b"), F.col("place.c").alias("c")).alias("o"), "r.name", "r.spec")
    projects = files.where("path = 'pyproject.toml'")
    found = projects.lateralJoin(PyprojectDependencies(F.col("content").outer()))
    req = requirement("line")
    named = found.select("repo", "source", "position", F.when(F.col("source") == 0, req["name"]).otherwise(pypi_name("name")).alias("name"), F.when(F.col("source") == 0, req["spec"]).otherwise(F.col("line")).alias("spec")).where("name is not null")
    named = named.select("repo", F.struct(F.lit(1).alias("from"), F.lit("").alias("a"), F.col("source").alias("b"), F.col("position").alias("c")).alias("o"), "name", "spec")
    first = listed.unionByName(named).groupBy("repo", "name").agg(F.min_by(F.struct("spec"), "o")["spec"].alias("spec"))
    return first.select("repo", F.lit("pypi").alias("ecosystem"), "name", "spec", F.lit(False).alias("is_dev"))


def _npm_tree(tree: dict, direct: bool, depth: int) -> Iterator[tuple]:
    for name, entry in tree.items():
        if not isinstance(entry, dict):
            continue
        if entry.get("version"):
            yield "package", name, entry["version"], direct, depth
        yield from (("required", n, None, None, depth) for n in entry.get("requires") or {} if isinstance(entry.get("requires"), dict))
        yield from _npm_tree(entry.get("dependencies") or {}, False, depth + 1)


def _npm_lock(content: str) -> Iterator[tuple]:
    doc = json.loads(content)
    if doc.get("packages"):
        root = doc["packages"].get("") or {}
        direct = {*(root.get("dependencies") or {}), *(root.get("devDependencies") or {})}
        for key, entry in doc["packages"].items():
            _, found, name = key.rpartition("node_modules/")
            if found and entry.get("version"):
                yield "package", name, entry["version"], name in direct, key.count("node_modules/")
                yield from (("required", n, None, None, 0) for n in entry.get("dependencies") or {})
    else:
        yield from _npm_tree(doc.get("dependencies") or {}, True, 0)


def _yarn_lock(content: str) -> Iterator[tuple]:
    names: list[str] = []
    inside = False
    for line in content.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if not line[0].isspace():
            specs = [s.strip().strip('"') for s in line.rstrip().rstrip(":").split(",")]
            names, inside = sorted({s[: s.rfind("@")] if s.rfind("@") > 0 else s for s in specs}), False
        elif re.match(r"^ {2}version\b", line):
            version = re.sub(r'^\s*version:?\s+"?|"?\s*$', "", line)
            yield from (("package", n, version, None, 0) for n in names)
        elif re.match(r"^ {2}(optionalD|d)ependencies:", line):
            inside = True
        elif inside and re.match(r"^ {4}\S", line):
            yield "required", re.match(r'^\s+"?(@?[^"\s:]+)"?', line)[1], None, None, 0
        elif re.match(r"^ {2}\S", line):
            inside = False


def _poetry_lock(content: str) -> Iterator[tuple]:
    for package in tomllib.loads(content).get("package") or []:
        yield "package", package["name"], package.get("version"), None, 0
        yield from (("required", n, None, None, 0) for n in package.get("dependencies") or {})


LOCKS = {"package-lock.json": _npm_lock, "yarn.lock": _yarn_lock, "poetry.lock": _poetry_lock}


@udtf(returnType="kind string, name string, version string, direct boolean, depth int, position int")
class LockEntries:
    """Packages and requirements of one lockfile, in its order; none of an unreadable one."""

    def eval(self, path: str, content: str):
        try:
            for position, row in enumerate(LOCKS[path](content or "")):
                yield *row, position
        except (ValueError, KeyError, AttributeError, TypeError):
            return


def lock_entries(files: DataFrame) -> DataFrame:
    """(repo, ecosystem, kind, name, version, direct): of each repository the lockfile that goes first.

    package-lock.json goes before yarn.lock, poetry.lock before pinned
    requirements. Of a name that occurs often the shallowest, then first, counts.
    """
    rank = F.when(F.col("path").isin("package-lock.json", "poetry.lock"), 0).otherwise(1)
    eco = lambda p: F.when(p.isin("package-lock.json", "yarn.lock"), "npm").otherwise("pypi")
    locks = files.where(F.col("path").isin(*LOCKS)).lateralJoin(LockEntries(F.col("path").outer(), F.col("content").outer()))
    rows = locks.select("repo", eco(F.col("path")).alias("ecosystem"), rank.alias("rank"), "kind", "name", "version", "direct", "depth", "position")
    pins = requirement_lines(files).select("repo", requirement("text").alias("r")).where("r.spec rlike '^==[^,*]+$'")
    pins = pins.select("repo", F.lit("pypi").alias("ecosystem"), F.lit(1).alias("rank"), F.lit("package").alias("kind"), "r.name", F.regexp_replace("r.spec", r"^==\s*", "").alias("version"),
        F.lit(True).alias("direct"), F.lit(0).alias("depth"), F.lit(0).alias("position"))
    rows = rows.unionByName(pins)
    rows = rows.withColumn("_best", F.min("rank").over(Window.partitionBy("repo", "ecosystem"))).where("rank = _best")
    first = F.min_by(F.struct("version", "direct"), F.struct("depth", "position")).alias("f")
    return rows.groupBy("repo", "ecosystem", "kind", "name").agg(first).select("repo", "ecosystem", "kind", "name", "f.version", "f.direct")
