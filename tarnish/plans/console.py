"""Console queries: overview, activity, users, organisations, scans, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.operators import relational as R
from tarnish.plans.registry import query
from tarnish.plans.standins import AS_OF, JOBS_AS_OF, deps, jobs, log, table, with_views


def text_of(column: str, name: str | None = None):
    """A time as text, the same in every engine."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


@query("ov_filter_counts", with_views(f"""
    SELECT count(*) AS total, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warnings,
        count(*) FILTER (created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_week,
        count(*) FILTER (level = 'error' AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS errors_today,
        count(*) FILTER (status IS NULL OR status < 400) AS fine FROM log""", "log"))
def ov_filter_counts(spark, d):
    level = F.col("level")
    return log(spark, d).agg(F.count(F.lit(1)).alias("total"), *R.counts_where(
        errors=level == "error", warnings=level == "warn", last_week=R.within_days("created_at", AS_OF, 7),
        errors_today=(level == "error") & R.within_days("created_at", AS_OF, 1), fine=R.succeeded()))


@query("ov_scan_counts", with_views(f"""
    SELECT count(*) AS scans, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status IN ('pending', 'cloning', 'analyzing')) AS in_flight,
        count(*) FILTER (created_at > TIMESTAMP '{JOBS_AS_OF}' - INTERVAL 30 DAY) AS last_month FROM jobs""", "jobs"))
def ov_scan_counts(spark, d):
    s = F.col("status")
    return jobs(spark, d).agg(F.count(F.lit(1)).alias("scans"), *R.counts_where(
        complete=s == "complete", failed=s == "failed", in_flight=s.isin("pending", "cloning", "analyzing"), last_month=R.within_days("created_at", JOBS_AS_OF, 30)))


@query("ov_scalar_counts", """SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM nation) AS orgs,
    (SELECT count(*) FROM orders) AS scans, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS paying""")
def ov_scalar_counts(spark, d):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    users = table(spark, d, "customer")
    # Rows of one aggregate each: a fixed bound.
    return one(users, "users").crossJoin(one(table(spark, d, "nation"), "orgs")).crossJoin(one(table(spark, d, "orders"), "scans")).crossJoin(one(users.where("c_acctbal > 0"), "paying"))


@query("daily_series_gapfill", with_views(f"""
    WITH days AS (SELECT unnest(generate_series(DATE '2024-01-31' - 13, DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
    per AS (SELECT created_at::DATE AS day, count(*) AS events, count(*) FILTER (level = 'error') AS errors,
        count(DISTINCT user_id) FILTER (action = 'signup') AS signups
        FROM log WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors, coalesce(signups, 0) AS signups
    FROM days LEFT JOIN per USING (day)""", "log"))
def daily_series_gapfill(spark, d):
    recent = log(spark, d).where(R.within_days("created_at", AS_OF, 14)).withColumn("day", F.to_date("created_at"))
    per = recent.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == "error").alias("errors"))
    signups = recent.where("action = 'signup'").groupBy("day").agg(F.countDistinct("user_id").alias("signups"))
    return R.gap_filled(R.daily_series(AS_OF, 14, spark), per, signups).select(F.col("day").cast("string").alias("day"), "events", "errors", "signups").orderBy("day")


@query("recent_problems_topk", with_views("""SELECT id, level, source, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM log WHERE level IN ('warn', 'error') ORDER BY log.created_at DESC, id DESC LIMIT 8""", "log"))
def recent_problems_topk(spark, d):
    return log(spark, d).where(F.col("level").isin("warn", "error")).orderBy(F.desc("created_at"), F.desc("id")).limit(8).select("id", "level", "source", text_of("created_at"))


@query("activity_page", with_views(f"""
    SELECT id, action, user_id, c_name AS email, n_name AS org, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM log LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON org_id = n_nationkey
    WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND action ILIKE 'e%' AND status >= 400
        AND (c_name ILIKE '%0007%' OR n_name ILIKE '%ation_1%')
    ORDER BY log.created_at DESC, id LIMIT 50 OFFSET 25""", "log"))
def activity_page(spark, d):
    limit, offset = R.page_bounds(50, 25)
    rows = log(spark, d).where(R.all_of(R.within_days("created_at", AS_OF, 20), F.col("action").ilike("e%"), R.failed(), None))
    rows = rows.join(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email")), "user_id", "left")
    rows = rows.join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("org_id"), F.col("n_name").alias("org")), "org_id", "left")
    rows = rows.where(R.search("0007", "email") | R.search("ation_1", "org"))
    return R.page(rows, [F.desc("created_at"), F.asc("id")], limit, offset).select("id", "action", "user_id", "email", "org", "status", text_of("created_at"))


@query("activity_total", with_views(f"""SELECT count(*) AS total, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM log
    WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND (status IS NULL OR status < 400)""", "log"))
def activity_total(spark, d):
    rows = log(spark, d).where(R.all_of(R.within_days("created_at", AS_OF, 20), R.succeeded()))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.max("created_at").alias("m")).select("total", text_of("m", "last_at"))


@query("action_hist", with_views("SELECT action, count(*) AS n FROM log GROUP BY action ORDER BY n DESC, action LIMIT 100", "log"))
def action_hist(spark, d):
    return log(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "action").limit(100)


@query("source_level_hist", with_views("SELECT source, level, count(*) AS n FROM log GROUP BY source, level", "log"))
def source_level_hist(spark, d):
    return log(spark, d).groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"))


@query("system_events_page", with_views("""SELECT id, level, source, n_name AS org, get_k AS k FROM
    (SELECT *, (props->>'$.k')::BIGINT AS get_k FROM log WHERE level = 'warn' AND source = 'api') x LEFT JOIN nation ON org_id = n_nationkey
    ORDER BY created_at DESC, id LIMIT 50""", "log"))
def system_events_page(spark, d):
    rows = log(spark, d).where("level = 'warn' and source = 'api'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = R.page(rows, [F.desc("created_at"), F.asc("id")], 50)
    return rows.join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("org_id"), F.col("n_name").alias("org")), "org_id", "left").select("id", "level", "source", "org", "k")


@query("user_counts_correlated", """
    SELECT c_custkey AS id, c_name AS email, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS scan_count,
        (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_custkey = c_custkey) AS last_scan, c_acctbal IS NOT NULL AS billed
    FROM customer ORDER BY scan_count DESC NULLS LAST, id LIMIT 50""")
def user_counts_correlated(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.col("c_acctbal").isNotNull().alias("billed"))
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("scan_count"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_scan"))
    rows = users.join(per, "id", "left").fillna(0, ["scan_count"])
    key = R.sorted_by("scans", {"scans": "scan_count", "email": "email"}, "email")
    return R.page(rows, [key, F.asc("id")], 50).select("id", "email", "scan_count", "last_scan", "billed")


@query("user_detail", with_views(f"""
    SELECT c_custkey AS id, n_name AS org, (SELECT count(*) FROM log WHERE user_id = c_custkey AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS actions,
        (SELECT count(*) FROM log WHERE user_id = c_custkey AND status >= 400 AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS failed
    FROM customer JOIN nation ON c_nationkey = n_nationkey""", "log"))
def user_detail(spark, d):
    users = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = log(spark, d).where(R.within_days("created_at", AS_OF, 30)).groupBy("user_id").agg(F.count(F.lit(1)).alias("actions"), F.count_if(R.failed()).alias("failed"))
    return users.join(per, F.col("c_custkey") == F.col("user_id"), "left").fillna(0, ["actions", "failed"]).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("org"), "actions", "failed")


@query("org_list", with_views("""
    SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members,
        (SELECT count(DISTINCT repo_id) FROM jobs WHERE org_id = n_nationkey) AS repos, (SELECT count(*) FROM jobs WHERE org_id = n_nationkey) AS scans,
        (SELECT strftime(max(created_at), '%Y-%m-%d') FROM jobs WHERE org_id = n_nationkey) AS last_activity,
        (SELECT c_name FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS owner
    FROM nation""", "jobs"))
def org_list(spark, d):
    members = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.count(F.lit(1)).alias("members"), F.max_by("c_name", F.struct("c_acctbal", -F.col("c_custkey"))).alias("owner"))
    scans = jobs(spark, d).groupBy(F.col("org_id").alias("id")).agg(
        F.countDistinct("repo_id").alias("repos"), F.count(F.lit(1)).alias("scans"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_activity"))
    orgs = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return orgs.join(members, "id", "left").join(scans, "id", "left").fillna(0, ["members", "repos", "scans"]).select("id", "name", "members", "repos", "scans", "last_activity", "owner")


@query("org_detail", with_views(f"""SELECT org_id, count(*) FILTER (status = 'failed') AS failed, count(*) AS scans,
    count(DISTINCT repo_id) FILTER (created_at > TIMESTAMP '{JOBS_AS_OF}' - INTERVAL 90 DAY) AS active_repos FROM jobs GROUP BY org_id""", "jobs"))
def org_detail(spark, d):
    recent = F.when(R.within_days("created_at", JOBS_AS_OF, 90), F.col("repo_id"))
    return jobs(spark, d).groupBy("org_id").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("scans"), F.countDistinct(recent).alias("active_repos"))


@query("jobs_in_flight", with_views(f"""SELECT id, c_name AS repo, n_name AS org, date_diff('second', created_at, TIMESTAMP '{JOBS_AS_OF}') AS age_seconds
    FROM jobs JOIN customer ON repo_id = c_custkey JOIN nation ON org_id = n_nationkey
    WHERE status IN ('pending', 'cloning', 'analyzing') ORDER BY created_at, id LIMIT 50""", "jobs"))
def jobs_in_flight(spark, d):
    top = R.page(jobs(spark, d).where(F.col("status").isin("pending", "cloning", "analyzing")), [F.asc("created_at"), F.asc("id")], 50)
    named = top.join(table(spark, d, "customer"), F.col("repo_id") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("org_id") == F.col("n_nationkey"))
    age = F.timestamp_diff("SECOND", "created_at", R.moment(JOBS_AS_OF))
    return named.select("id", F.col("c_name").alias("repo"), F.col("n_name").alias("org"), age.alias("age_seconds"))


@query("jobs_recent", with_views("""SELECT id, status, strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at FROM jobs
    WHERE status IN ('complete', 'failed') ORDER BY jobs.completed_at DESC NULLS LAST, created_at DESC, id LIMIT 25""", "jobs"))
def jobs_recent(spark, d):
    done = jobs(spark, d).where(F.col("status").isin("complete", "failed"))
    return R.page(done, [F.desc_nulls_last("completed_at"), F.desc("created_at"), F.asc("id")], 25).select("id", "status", text_of("completed_at"))


@query("throughput_p95", with_views("""
    SELECT count(*) FILTER (status = 'complete') AS complete, round(avg(date_diff('second', created_at, completed_at)) FILTER (status = 'complete'), 6) AS avg_seconds,
        round(quantile_cont(date_diff('second', created_at, completed_at), 0.95) FILTER (status = 'complete'), 6) AS p95_seconds,
        round(100.0 * count(*) FILTER (status = 'complete') / nullif(count(*) FILTER (status IN ('complete', 'failed')), 0)) AS success_rate FROM jobs""", "jobs"))
def throughput_p95(spark, d):
    took = F.when(F.col("status") == "complete", F.timestamp_diff("SECOND", "created_at", "completed_at"))
    done = F.count_if(F.col("status") == "complete")
    return jobs(spark, d).agg(done.alias("complete"), F.round(F.coalesce(F.avg(took), F.lit(0.0)), 6).alias("avg_seconds"), F.round(F.percentile(took, 0.95), 6).alias("p95_seconds"),
        F.round(100.0 * done / F.nullif(F.count_if(F.col("status").isin("complete", "failed")), F.lit(0))).alias("success_rate"))


@query("repo_last_scan", with_views("""SELECT c_custkey AS repo_id, (SELECT status FROM jobs WHERE repo_id = c_custkey ORDER BY created_at DESC, id DESC LIMIT 1) AS last_status,
    (SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM jobs WHERE repo_id = c_custkey ORDER BY jobs.created_at DESC, id DESC LIMIT 1) AS last_at FROM customer""", "jobs"))
def repo_last_scan(spark, d):
    last = R.latest_per(jobs(spark, d), "repo_id", ["created_at", "id"], ["status", "created_at"])
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"))
    return repos.join(last, "repo_id", "left").select("repo_id", F.col("status").alias("last_status"), text_of("created_at", "last_at"))


@query("repo_trend", with_views("""
    WITH ranked AS (SELECT repo_id, id, created_at, (summary->>'$.score')::DECIMAL(7,2)::DOUBLE AS score,
        row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, id DESC) AS k FROM jobs WHERE status = 'complete')
    SELECT repo_id, id, score, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, id) AS step FROM ranked WHERE k <= 30""", "jobs"))
def repo_trend(spark, d):
    from pyspark.sql import Window

    done = jobs(spark, d).where("status = 'complete'").withColumn("score", F.get_json_object("summary", "$.score").cast("decimal(7,2)").cast("double"))
    by = Window.partitionBy("repo_id")
    newest = done.withColumn("k", F.row_number().over(by.orderBy(F.desc("created_at"), F.desc("id")))).where("k <= 30")
    return newest.select("repo_id", "id", "score", F.row_number().over(by.orderBy("created_at", "id")).cast("long").alias("step"))


@query("tenant_scans", with_views("""SELECT id, repo_id, status FROM jobs WHERE org_id IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (7, 8))
    ORDER BY created_at DESC, id DESC LIMIT 50""", "jobs"))
def tenant_scans(spark, d):
    mine = table(spark, d, "customer").where(F.col("c_custkey").isin(7, 8)).select(F.col("c_nationkey").alias("org_id")).distinct()
    return R.page(jobs(spark, d).join(mine, "org_id", "left_semi"), [F.desc("created_at"), F.desc("id")], 50).select("id", "repo_id", "status")


@query("dependency_page", with_views("""SELECT scan_job_id, package_name, status FROM deps
    ORDER BY CASE status WHEN 'phantom' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'unused' THEN 2 ELSE 3 END, package_name, scan_job_id, line LIMIT 100 OFFSET 100""", "deps"))
def dependency_page(spark, d):
    s = F.col("status")
    case = F.when(s == "phantom", 0).when(s == "suspicious", 1).when(s == "unused", 2).otherwise(3)
    return R.page(deps(spark, d), [case, F.col("package_name"), F.col("scan_job_id"), F.col("line")], 100, 100).select("scan_job_id", "package_name", "status")


@query("code_findings_page", with_views("""SELECT scan_job_id, package_name, confidence FROM deps WHERE status <> 'healthy'
    ORDER BY confidence DESC NULLS LAST, package_name, scan_job_id, line LIMIT 100""", "deps"))
def code_findings_page(spark, d):
    rows = deps(spark, d).where("status <> 'healthy'").withColumn("detail", F.struct(F.sha2("package_name", 256).alias("fingerprint"), "package_name"))
    rows = rows.withColumn("detail", F.col("detail").dropFields("fingerprint"))  # never leaves the store
    return R.page(rows, [F.desc_nulls_last("confidence"), F.asc("package_name"), F.asc("scan_job_id"), F.asc("line")], 100).select("scan_job_id", "detail.package_name", "confidence")


@query("previous_score", with_views("""SELECT id, repo_id, lag((summary->>'$.score')::DOUBLE) OVER (PARTITION BY repo_id ORDER BY created_at, id) AS previous
    FROM jobs WHERE status = 'complete' AND pr_number IS NULL""", "jobs"))
def previous_score(spark, d):
    from pyspark.sql import Window

    rows = jobs(spark, d).where("status = 'complete' and pr_number is null")
    w = Window.partitionBy("repo_id").orderBy("created_at", "id")
    return rows.select("id", "repo_id", F.lag(F.get_json_object("summary", "$.score").cast("double")).over(w).alias("previous"))


@query("autofix_unused", with_views("""SELECT scan_job_id, package_name FROM (SELECT *, row_number() OVER (PARTITION BY scan_job_id ORDER BY package_name, line) AS k
    FROM deps WHERE status = 'unused' AND ecosystem = 'npm') x WHERE k <= 10""", "deps"))
def autofix_unused(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("scan_job_id").orderBy("package_name", "line")
    return deps(spark, d).where("status = 'unused' and ecosystem = 'npm'").withColumn("k", F.row_number().over(w)).where("k <= 10").select("scan_job_id", "package_name")


@query("plan_quota", with_views("""
    WITH plans AS (SELECT n_nationkey AS org_id, CASE n_nationkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'team' END AS plan FROM nation),
    used AS (SELECT org_id, count(*) AS scans FROM jobs WHERE created_at > TIMESTAMP '2001-07-01' - INTERVAL 1 DAY AND created_at <= TIMESTAMP '2001-07-01' GROUP BY org_id)
    SELECT org_id, plan, coalesce(scans, 0) AS scans, CASE plan WHEN 'free' THEN 5 WHEN 'pro' THEN 50 END AS daily_limit,
        coalesce(coalesce(scans, 0) < CASE plan WHEN 'free' THEN 5 WHEN 'pro' THEN 50 END, true) AS allowed
    FROM plans LEFT JOIN used USING (org_id)""", "jobs"))
def plan_quota(spark, d):
    k = F.col("n_nationkey") % 3
    plans = table(spark, d, "nation").select(F.col("n_nationkey").alias("org_id"), F.when(k == 0, "free").when(k == 1, "pro").otherwise("team").alias("plan"))
    limits = spark.createDataFrame([("free", 5), ("pro", 50), ("team", None)], "plan string, daily_limit int")
    used = jobs(spark, d).where(R.within_days("created_at", "2001-07-01 00:00:00", 1) & (F.col("created_at") <= R.moment("2001-07-01 00:00:00"))).groupBy("org_id").agg(F.count(F.lit(1)).alias("scans"))
    rows = plans.join(F.broadcast(limits), "plan").join(used, "org_id", "left").fillna(0, ["scans"])
    return rows.select("org_id", "plan", "scans", "daily_limit", F.coalesce(F.col("scans") < F.col("daily_limit"), F.lit(True)).alias("allowed"))


@query("curation_queue", with_views("""SELECT action AS package_name, source AS ecosystem, count(*) AS report_count, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_reported_at,
    strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_reported_at FROM log GROUP BY 1, 2 ORDER BY report_count DESC, 1, 2 LIMIT 10""", "log"))
def curation_queue(spark, d):
    counted = R.upsert_counter(log(spark, d).select(F.col("action").alias("package_name"), F.col("source").alias("ecosystem"), "created_at"), ["package_name", "ecosystem"], "created_at")
    top = counted.orderBy(F.desc("report_count"), "package_name", "ecosystem").limit(10)
    return top.select("package_name", "ecosystem", "report_count", text_of("first_reported_at"), text_of("last_reported_at"))


@query("member_listing", """SELECT n_name AS org, c_name AS member, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000""")
def member_listing(spark, d):
    users = table(spark, d, "customer").where("c_acctbal > 9000")
    orgs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return users.join(orgs, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("org"), F.col("c_name").alias("member"), F.col("r_name").alias("region"))


@query("anti_join_unconnected", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def anti_join_unconnected(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("full_outer_flags", """SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS is_declared, b.k IS NOT NULL AS is_imported
    FROM (SELECT DISTINCT s_suppkey % 50 AS k FROM supplier WHERE s_acctbal > 0) a FULL JOIN (SELECT DISTINCT c_custkey % 61 AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k""")
def full_outer_flags(spark, d):
    a = table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") % 50).alias("k"))
    b = table(spark, d, "customer").where("c_acctbal > 0").select((F.col("c_custkey") % 61).alias("k"))
    return R.presence(a, b, "k", "is_declared", "is_imported")


@query("set_ops", """SELECT 'both' AS side, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier INTERSECT SELECT DISTINCT c_nationkey FROM customer)
    UNION ALL SELECT 'any', count(*) FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)
    UNION ALL SELECT 'only_customer', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""")
def set_ops(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_acctbal"), table(spark, d, "customer").select(F.col("c_nationkey").alias("n"))
    count = lambda side, df: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    keys = s.select("n")
    return count("both", keys.intersect(c)).unionByName(count("any", keys.union(c).distinct())).unionByName(count("only_customer", c.subtract(s.where("s_acctbal < 0").select("n"))))


@query("upsert_counter", with_views("""SELECT action AS name, source AS ecosystem, count(*) AS report_count, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at,
    strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM log GROUP BY 1, 2""", "log"))
def upsert_counter(spark, d):
    rows = log(spark, d).select(F.col("action").alias("name"), F.col("source").alias("ecosystem"), "created_at", "id")
    keys = ["name", "ecosystem"]
    state, batch = (R.upsert_counter(rows.where(c), keys, "created_at") for c in ("id % 2 = 0", "id % 2 = 1"))
    out = R.merge_counter(state, batch, keys)
    return out.select("name", "ecosystem", "report_count", text_of("first_reported_at", "first_at"), text_of("last_reported_at", "last_at"))


@query("upsert_keep_old", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'new ' || c_name ELSE c_name END AS login
    FROM customer UNION ALL SELECT c_custkey + 1000000, 'added' FROM customer WHERE c_custkey % 100 = 0""")
def upsert_keep_old(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("login"))
    new = old.where("id % 2 = 0").withColumn("login", F.when(F.col("id") % 3 != 0, F.concat(F.lit("new "), "login")))
    added = old.where("id % 100 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("added").alias("login"))
    return R.upsert_keep_old(old, new.unionByName(added), ["id"])


@query("upsert_overwrite", """SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'late' WHEN c_mktsegment = 'BUILDING' THEN 'again' ELSE c_name END AS name FROM customer""")
def upsert_overwrite(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal", "c_mktsegment")
    old = users.where("c_acctbal >= 0 or c_acctbal is null")
    again = R.upsert_overwrite(old.select("id", "name"), old.where("c_mktsegment = 'BUILDING'").select("id", F.lit("again").alias("name")), ["id"])
    return R.insert_missing(again, users.select("id", F.lit("late").alias("name")), ["id"])


@query("first_wins_dedup", with_views("SELECT user_id, action, min(id) AS id FROM log GROUP BY 1, 2", "log"))
def first_wins_dedup(spark, d):
    return R.first_per(log(spark, d).select("user_id", "action", "id"), ["user_id", "action"], ["id"])


@query("last_wins_dedup", with_views("SELECT user_id, action, max(id) AS id, arg_max(value, id) AS value FROM log GROUP BY 1, 2", "log"))
def last_wins_dedup(spark, d):
    return R.last_per(log(spark, d).select("user_id", "action", "id", "value"), ["user_id", "action"], ["id"])


@query("retention_keep", with_views(f"SELECT count(*) AS kept, (SELECT count(*) FROM log) - count(*) AS removed FROM log WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY", "log"))
def retention_keep(spark, d):
    rows = log(spark, d)
    stays = F.count_if(F.col("created_at") >= R.moment(AS_OF) - F.make_dt_interval(days=F.lit(10)))
    return rows.agg(stays.alias("kept"), (F.count(F.lit(1)) - stays).alias("removed"))


@query("cascade_delete", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS user_id FROM orders WHERE o_custkey % 3 <> 0""")
def cascade_delete(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    scans = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    stays = R.cascade(scans, users.where("id % 3 <> 0"), "user_id", "id")
    return R.set_null(stays, users.where("id % 4 <> 0"), "user_id", "id").select("id", "user_id")


@query("first_appearance", with_views("""WITH b AS (SELECT min(id) AS lo, max(id) AS hi FROM log)
    SELECT user_id, action, min(id) AS first_seq, hi - min(id) AS from_head, min(id) = lo AS predates FROM log, b GROUP BY user_id, action, hi, lo""", "log"))
def first_appearance(spark, d):
    return R.first_appearance(log(spark, d), ["user_id", "action"], "id")


@query("revision_pairs", with_views("""SELECT repo_id, id, status, previous FROM (SELECT *, lag(status) OVER (PARTITION BY repo_id ORDER BY created_at, id) AS previous FROM jobs) x
    WHERE previous <> status""", "jobs"))
def revision_pairs(spark, d):
    return R.revision_pairs(jobs(spark, d), "repo_id", ["created_at", "id"], "status").select("repo_id", "id", "status", "previous")


@query("queue_depths", with_views("""SELECT org_id, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'analyzing') AS analyzing FROM jobs GROUP BY org_id""", "jobs"))
def queue_depths(spark, d):
    return jobs(spark, d).groupBy("org_id").pivot("status", ["complete", "failed", "analyzing"]).count().fillna(0)


@query("heartbeat_liveness", with_views(f"""SELECT source, date_sub('second', max(created_at), TIMESTAMP '{AS_OF}') AS age_seconds,
    date_sub('second', max(created_at), TIMESTAMP '{AS_OF}') < 60 AS alive FROM log GROUP BY source""", "log"))
def heartbeat_liveness(spark, d):
    age = F.timestamp_diff("SECOND", "last", R.moment(AS_OF))
    return log(spark, d).groupBy("source").agg(F.max("created_at").alias("last")).select("source", age.alias("age_seconds"), (age < 60).alias("alive"))


@query("activity_csv", with_views("""SELECT '"' || id || '","' || replace(action, '"', '""') || '","' || coalesce(replace(props, '"', '""'), '') || '"' AS line
    FROM log ORDER BY id LIMIT 10000""", "log"))
def activity_csv(spark, d):
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return log(spark, d).orderBy("id").limit(10000).select(F.concat_ws(",", *[cell(c) for c in ("id", "action", "props")]).alias("line"))
