"""Imports, symbols and references of source files, and code that nothing references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tarnish.functions import rules, scripts
from tarnish.functions.scalar import package_of_specifier

# Words of Python that name nothing.
PY_KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield self cls print len range str int float dict list set tuple type super isinstance Exception"
).split()


def code_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line, text) of files (repo, path, content); either line ending."""
    return files.select("repo", "path", F.posexplode(F.split("content", r"\r?\n", -1)).alias("_at", "text")).select("repo", "path", (F.col("_at") + 1).alias("line"), "text")


def python_imports(lines: DataFrame) -> DataFrame:
    """(repo, path, name): top-level modules imported, relative imports left out."""
    t = F.col("text")
    plain = F.transform(F.split(F.regexp_extract(t, r"^\s*import\s+(.+)$", 1), ","), lambda p: F.trim(F.split(F.trim(p), r"\s+as\s+")[0]))
    source = F.regexp_extract(t, r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\b", 1)
    names = F.when(t.rlike(r"^\s*import\s+"), plain).when(source != "", F.array(source))
    tops = lines.select("repo", "path", F.explode(names).alias("m")).select("repo", "path", F.substring_index("m", ".", 1).alias("name"))
    return tops.where(F.col("name").rlike(r"^[A-Za-z_]\w*\z")).distinct()


def python_symbols(lines: DataFrame) -> DataFrame:
    """(repo, path, line, name, exported, kind): undecorated definitions at column 0, no dunder names.

    The decorator of a definition is the nearest line above that begins at
    column 0 and is neither blank nor comment nor closing bracket.
    """
    t = F.col("text")
    name = F.coalesce(F.nullif(F.regexp_extract(t, r"^(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^class\s+([A-Za-z_]\w*)\s*[(:]", 1), F.lit("")))
    head = F.when(~t.rlike(r"^\s*(#|\z)") & ~t.rlike(r"^[\s)\]}]"), t.startswith("@"))
    above = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({"name": name, "_decorated": F.coalesce(F.last(head, ignorenulls=True).over(above), F.lit(False))})
    kept = marked.where(F.col("name").isNotNull() & ~F.col("_decorated") & ~F.col("name").rlike(r"^__.*__\z"))
    return kept.select("repo", "path", "line", "name", (~F.col("name").startswith("_")).alias("exported"), F.when(t.startswith("class"), "component").otherwise("function").alias("kind"))


def python_references(lines: DataFrame) -> DataFrame:
    """(repo, path, name): identifiers used, but for a definition's own line and comment lines."""
    t = F.col("text")
    used = lines.where(~t.rlike(r"^\s*#")).withColumn("_own", F.regexp_extract(t, r"^(?:(?:async\s+)?def|class)\s+([A-Za-z_]\w*)\s*[(:]", 1))
    words = used.select("repo", "path", "_own", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name"))
    return words.where((F.col("name") != F.col("_own")) & ~F.col("name").isin(*PY_KEYWORDS)).select("repo", "path", "name").distinct()


def without_noise(content: Column) -> Column:
    """Script source without comments."""
    return F.regexp_replace(F.regexp_replace(content, r"/\*[\s\S]*?\*/", " "), r"(?m)(^|[^:\"'`\\])//.*$", "$1")


@udtf(returnType="kind string, name string, line int, line_end int, exported boolean, text string")
class ScriptFacts:
    """(kind, name, line, line_end, exported, text) of a script file: imports, import and export lines, functions and components with their source, references."""

    def eval(self, content: str, markup: bool):
        yield from scripts.facts(content, markup)


def script_facts(files: DataFrame) -> DataFrame:
    """The columns of files (repo, path, content) but the content, and each fact of `ScriptFacts`; one pass over a file.

    Elements stand in code except in plain typed files, where `<` begins a type.
    """
    rest = [c for c in files.columns if c != "content"]
    facts = ScriptFacts(F.col("content").outer(), (~F.col("path").rlike(r"\.[mc]?ts$")).outer())
    return files.lateralJoin(facts).select(*rest, "kind", "name", "line", "line_end", "exported", "text")


def register_script_facts(spark: SparkSession, name: str = "script_facts") -> None:
    """For SQL: `SELECT ... FROM files, LATERAL script_facts(content, true)`."""
    spark.udtf.register(name, ScriptFacts)


def script_imports(files: DataFrame, aliases: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(repo, path, name): packages that script files import, require or load; aliases (repo, prefix) name none."""
    specs = (script_facts(files) if facts is None else facts).where("kind = 'import'").select("repo", "path", F.col("name").alias("spec")).distinct()
    if aliases is not None:
        own = F.when(F.col("prefix").endswith("/"), F.col("spec").startswith(F.col("prefix"))).otherwise(F.col("spec") == F.col("prefix"))
        specs = specs.alias("s").join(aliases.withColumnRenamed("repo", "_repo"), (F.col("s.repo") == F.col("_repo")) & own, "left_anti")
    return specs.select("repo", "path", package_of_specifier("spec").alias("name")).where("name is not null").distinct()


def import_lines(files: DataFrame, most: int = scripts.LINES, facts: DataFrame | None = None) -> DataFrame:
    """(repo, path, lines): the first `most` lines (40 at most) on which imports and exports of a file begin, as they stand there."""
    own = (script_facts(files) if facts is None else facts).where("kind = 'line' and text <> ''")
    first = Window.partitionBy("repo", "path").orderBy("line", "text")
    kept = own.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_k", "text")))
    return kept.groupBy("repo", "path").agg(F.transform(listed, lambda x: x["text"]).alias("lines"))


def path_aliases(configs: DataFrame) -> DataFrame:
    """(repo, prefix) of compiler configurations (repo, content), comments and trailing commas allowed."""
    bare = F.regexp_replace(without_noise(F.col("content")), r",(\s*[}\]])", "$1")
    paths = F.from_json(bare, "struct<compilerOptions:struct<paths:map<string,string>>>")["compilerOptions"]["paths"]
    keys = configs.select("repo", F.explode(F.map_keys(paths)).alias("key"))
    return keys.select("repo", F.when(F.col("key").endswith("/*"), F.expr("left(key, length(key) - 1)")).otherwise(F.col("key")).alias("prefix")).distinct()


def script_symbols(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(repo, path, line, name, exported, kind): functions and function values at the top of a file or exported; a capital makes a component."""
    return (script_facts(files) if facts is None else facts).where("kind in ('function', 'component')").select("repo", "path", "line", "name", "exported", "kind")


def script_references(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(repo, path, name): identifiers but those being declared or assigned, object keys and member names; elements that name a component."""
    return (script_facts(files) if facts is None else facts).where("kind = 'reference'").select("repo", "path", "name")


def dead_code(symbols: DataFrame, references: DataFrame, most: int = 40) -> DataFrame:
    """Symbols that no file of their repository references, entry points, tests and generated files left out.

    At most `most` a repository, by path and line: a report's length.
    """
    p = F.col("path")
    out = F.col("name").isin(*rules.ENTRY_NAMES) | p.rlike(rules.TEST_FILE) | p.rlike(rules.TEST_DIR) | p.rlike(rules.GENERATED_DIR) | p.rlike(rules.GENERATED_FILE)
    lone = symbols.where(~out).join(references.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    kind = F.when(F.col("exported"), F.when(F.col("kind") == "component", "dead_component").otherwise("dead_export")).otherwise("dead_function")
    w = Window.partitionBy("repo").orderBy("path", "line", "name")
    return lone.withColumns({"finding_type": kind, "_k": F.row_number().over(w)}).where(F.col("_k") <= most).drop("_k")


def review_batches(candidates: DataFrame, size: int = 25) -> DataFrame:
    """Candidates in batches of one repository, file by file."""
    w = Window.partitionBy("repo").orderBy("path", "line", "name")
    return candidates.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def reviewed(responses: DataFrame) -> DataFrame:
    """Findings in reviewers' JSON answers (repo, response): only dead code, confidence from 0 to 1, 0.5 if missing."""
    body = F.regexp_replace(F.trim("response"), r"^```(?:json)?\s*|\s*```$", "")
    items = F.from_json(body, "array<struct<name:string,path:string,line:int,verdict:string,confidence:double,reasoning:string>>")
    rows = responses.select("repo", F.explode(items).alias("v")).select("repo", "v.*").where("verdict = 'dead_code'")
    return rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))))
