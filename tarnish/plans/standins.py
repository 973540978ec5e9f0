"""Product tables as views over the test tables, in Spark and in SQL.

`events` stands for the audit log and system events, `orders` for scan jobs,
`customer` for users and repositories, `nation` for organisations, `lineitem`
for dependency findings. Each view here has the same columns as the CTE of its
name in `CTES`; `with_views(sql, ...)` puts those a query names before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for now in every query over events, and over orders.
AS_OF, JOBS_AS_OF = "2024-01-31 00:00:00", "2001-09-01 00:00:00"

CTES = {
    "log": """log AS (SELECT event_id AS id, ts AS created_at, user_id, user_id % 25 AS org_id, event_type AS action,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS level,
        CASE event_id % 3 WHEN 0 THEN 'worker' WHEN 1 THEN 'api' ELSE 'auth' END AS source,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
        value, props FROM events)""",
    "jobs": """jobs AS (SELECT o_orderkey AS id, o_custkey AS repo_id, c_nationkey AS org_id,
        CASE o_orderstatus WHEN 'P' THEN 'complete' WHEN 'F' THEN 'failed' ELSE 'analyzing' END AS status,
        o_orderdate AS created_at,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_seconds(1 + o_orderkey % 900) END AS completed_at,
        CASE WHEN o_orderstatus = 'P' THEN '{"score": ' || (o_orderkey % 1001)::INT || '}' END AS summary,
        CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 50 END AS pr_number
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "deps": """deps AS (SELECT l_orderkey AS scan_job_id, l_linenumber AS line, p_name || '-' || l_partkey AS package_name,
        CASE WHEN l_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'phantom' WHEN 'AO' THEN 'suspicious' WHEN 'RF' THEN 'unused'
            WHEN 'RO' THEN 'vulnerable' ELSE 'healthy' END AS status,
        l_quantity AS downloads, l_discount AS confidence
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}


def with_views(sql: str, *names: str) -> str:
    body = sql.strip()
    more = body[5:] if body[:5].upper() == "WITH " else None
    ctes = ",\n".join(CTES[n] for n in names)
    return f"WITH {ctes}, {more}" if more else f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind, n = table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    return e.select(
        n.alias("id"), F.col("ts").alias("created_at"), "user_id", (F.col("user_id") % 25).alias("org_id"), kind.alias("action"),
        F.when(kind == "error", "error").when(kind == "click", "warn").otherwise("info").alias("level"),
        F.when(n % 3 == 0, "worker").when(n % 3 == 1, "api").otherwise("auth").alias("source"),
        F.when(n % 7 == 0, None).when(kind == "error", 500).otherwise(200).alias("status"), "value", "props",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "P"
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("id"), F.col("o_custkey").alias("repo_id"), F.col("c_nationkey").alias("org_id"),
        F.when(done, "complete").when(F.col("o_orderstatus") == "F", "failed").otherwise("analyzing").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.when(done, F.col("o_orderdate") + F.make_dt_interval(secs=(1 + k % 900).cast("decimal(18,6)"))).alias("completed_at"),
        F.when(done, F.concat(F.lit('{"score": '), (k % 1001).cast("string"), F.lit("}"))).alias("summary"),
        F.when(F.col("o_orderpriority") == "1-URGENT", k % 50).alias("pr_number"),
    )


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    both = F.concat("l_returnflag", "l_linestatus")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("scan_job_id"), F.col("l_linenumber").alias("line"), F.concat("p_name", F.lit("-"), "l_partkey").alias("package_name"),
        F.when(F.col("l_partkey") % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"),
        F.when(both == "AF", "phantom").when(both == "AO", "suspicious").when(both == "RF", "unused").when(both == "RO", "vulnerable").otherwise("healthy").alias("status"),
        F.col("l_quantity").alias("downloads"), F.col("l_discount").alias("confidence"),
    )
