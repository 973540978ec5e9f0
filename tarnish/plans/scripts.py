"""Script files: one of every document, whose text stands in a template, a string and a comment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.operators import code
from tarnish.plans.registry import query
from tarnish.plans.standins import table
from tarnish.session import shared_dir


def script_files(spark, d):
    """(repo, path, content, id): what a file imports, declares and calls hangs on the document's columns, its text must not count."""
    text, n = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    swap = lambda c, *pairs: swap(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else c
    template = swap(text, ("\\", "\\\\"), ("`", "\\`"), ("${", "\\${"))
    quoted = swap(text, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"))
    noted = swap(text, ("*/", "* /"))
    lines = [
        F.concat(F.lit('import main, { a as b } from "'), F.coalesce("lang", F.lit("no")), F.lit('-lib";')),
        F.concat(F.lit('// require("gone-'), n, F.lit('")')),
        F.concat(F.lit("const note = `"), template, F.lit(' ${require("in-'), (F.col("doc_id") % 50).cast("string"), F.lit('")} import("not") ${`${b}`}`;')),
        F.concat(F.lit('const quoted = "'), quoted, F.lit('";')),
        F.concat(F.lit("export function load"), n, F.lit('(a) { return /require("never")[/`"]/.test(a) ? a / 2 : import("@scope/'), F.coalesce("source", F.lit("none")), F.lit('/deep"); }')),
        F.concat(F.lit("export const Card"), n, F.lit(" = ({ title }) => <b title=\"require('x')\">{title} it's `fine`</b>;")),
        F.concat(F.lit("/* import x from 'blocked' "), noted, F.lit(" */ load"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("(note);")),
        F.concat(F.lit("const Page = () => <Card"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(" title={quoted} />;")),
    ]
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "lang", "source", "text")
    # Reading a file takes the lexer far longer than reading its row took: few parts of a table would be few tasks.
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.select(F.coalesce("lang", F.lit("no")).alias("repo"), F.concat(F.lit("src/d"), n, F.lit(".tsx")).alias("path"), F.concat_ws("\n", *lines).alias("content"), F.col("doc_id").alias("id"))


_DOCS = """docs AS (SELECT doc_id, coalesce(lang, 'no') AS lang, coalesce(source, 'none') AS source, length(text) - length(replace(text, chr(10), '')) AS feeds
    FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents WHERE doc_id IS NOT NULL))"""


@query("script_facts", f"""WITH {_DOCS}
    SELECT doc_id AS id, 'import' AS kind, lang || '-lib' AS name, 1 AS line, NULL AS exported FROM docs
    UNION ALL SELECT doc_id, 'import', 'in-' || doc_id % 50, (3 + feeds)::INT, NULL FROM docs
    UNION ALL SELECT doc_id, 'import', '@scope/' || source || '/deep', (5 + feeds)::INT, NULL FROM docs
    UNION ALL SELECT doc_id, 'function', 'load' || doc_id, (5 + feeds)::INT, true FROM docs
    UNION ALL SELECT doc_id, 'component', 'Card' || doc_id, (6 + feeds)::INT, true FROM docs
    UNION ALL SELECT doc_id, 'component', 'Page', (8 + 2 * feeds)::INT, false FROM docs""")
def script_facts(spark, d):
    return code.script_facts(script_files(spark, d)).where("kind in ('import', 'function', 'component')").select("id", "kind", "name", "line", "exported")


@query("script_packages", f"""WITH {_DOCS}, p AS (SELECT doc_id, unnest([lang || '-lib', 'in-' || doc_id % 50, '@scope/' || source]) AS name FROM docs)
    SELECT name, count(DISTINCT doc_id) AS files FROM p GROUP BY name""")
def script_packages(spark, d):
    """In SQL, with the table function beside the files."""
    code.register_script_facts(spark)
    from tarnish.functions.scalar import package_of_specifier

    specs = spark.sql("SELECT f.path, t.name AS spec FROM {files} f, LATERAL script_facts(f.content, true) t WHERE t.kind = 'import'", files=script_files(spark, d))
    return specs.select("path", package_of_specifier("spec").alias("name")).where("name is not null").groupBy("name").agg(F.count_distinct("path").alias("files"))


@query("script_dead_code", f"""WITH {_DOCS}, called AS (SELECT lang, 'load' || doc_id // 2 AS name FROM docs UNION SELECT lang, 'Card' || doc_id // 3 FROM docs),
    s AS (SELECT lang, doc_id, 'load' || doc_id AS name, 'dead_export' AS finding_type, 5 + feeds AS line FROM docs UNION ALL SELECT lang, doc_id, 'Card' || doc_id, 'dead_component', 6 + feeds FROM docs
        UNION ALL SELECT lang, doc_id, 'Page', 'dead_function', 8 + 2 * feeds FROM docs)
    SELECT lang AS repo, 'src/d' || doc_id || '.tsx' AS path, name, finding_type FROM s ANTI JOIN called USING (lang, name)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY 'src/d' || doc_id || '.tsx', line, name) <= 40""")
def script_dead_code(spark, d):
    files = script_files(spark, d)
    facts, path = code.script_facts(files).where("kind in ('function', 'component', 'reference')").select("repo", "path", "kind", "name", "line", "exported"), shared_dir(spark, "script-facts")
    facts.write.parquet(path)  # symbols and references are read from one pass of the lexer
    facts = spark.read.schema(facts.schema).parquet(path)
    return code.dead_code(code.script_symbols(files, facts), code.script_references(files, facts)).select("repo", "path", "name", "finding_type")


@query("script_import_lines", f"""WITH {_DOCS} SELECT doc_id AS id, 4 AS lines, 'import main, {{ a as b }} from "' || lang || '-lib";' AS first FROM docs""")
def script_import_lines(spark, d):
    files = script_files(spark, d)
    listed = code.import_lines(files)
    return listed.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("id"), (F.size("lines") + 1).alias("lines"), F.col("lines")[0].alias("first"))
