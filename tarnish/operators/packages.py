"""Single packages: verification before an install, licences and dates of registry records, what a project has already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions import rules
from tarnish.functions.scalar import age_days, distribution_of_import, empty_to_null, licence_term_class, pypi_name, rank_in
from tarnish.operators.dependencies import fuzzy_alternative, nearest_popular


def licence_family(text: Column) -> Column:
    """Family that a licence's wording names, without a version of its own making; null if it names none."""
    out = None
    for family, pattern in rules.LICENCE_FAMILIES:
        out = F.when(text.rlike(pattern), family) if out is None else out.when(text.rlike(pattern), family)
    return out


def licence_of_classifiers(classifiers: Column) -> Column:
    """Strictest family among the licence classifiers, the first of equals; null if none names one."""
    leaf = lambda c: F.trim(F.substring_index(c, "::", -1))
    leaves = F.transform(F.filter(classifiers, lambda c: c.startswith("License ::")), leaf)
    rated = F.transform(leaves, lambda c, k: F.struct(rank_in(rules.LICENCE_CLASSES, licence_term_class(licence_family(c))).alias("rank"), (-k).alias("before"), licence_family(c).alias("family")))
    return F.array_max(F.filter(rated, lambda r: r["family"].isNotNull()))["family"]


def resolved_licence(expression: Column, legacy: Column, classifiers: Column) -> Column:
    """(licence, has_licence_text) of a record: its expression, else its older field, else what classifiers or wording say.

    A whole licence document in either field is no identifier, but shows that
    there is a licence. Free text gives way to a family that can be read off.
    """
    whole = lambda c: F.coalesce(c.contains("\n") | (F.length(c) > rules.LICENCE_TEXT), F.lit(False))
    first = F.when(~whole(expression), empty_to_null(expression))
    named = F.coalesce(first, F.when(~whole(legacy), empty_to_null(legacy)))
    prose = (licence_term_class(named) == "unknown") & ~F.trim(named).rlike(rules.LICENCE_EXPRESSION)
    read = F.coalesce(licence_of_classifiers(classifiers), licence_family(named))
    licence = F.when(named.isNull() | prose, F.coalesce(read, named)).otherwise(named)
    return F.struct(licence.alias("licence"), (whole(expression) | first.isNull() & whole(legacy)).alias("has_licence_text"))


def first_release(releases: Column) -> Column:
    """Earliest upload of all files of all versions (map of version to files with `uploaded`, ISO text); null without one."""
    return F.array_min(F.flatten(F.transform(F.map_values(releases), lambda files: F.transform(files, lambda f: empty_to_null(f["uploaded"])))))


def local_modules(files: DataFrame) -> DataFrame:
    """(repo, name): modules that a repository's own Python files can be imported as, each folder on the way included."""
    parts = F.split(F.regexp_replace("path", r"\.py\z", ""), "/")
    return files.where(F.col("path").endswith(".py")).select("repo", F.explode(parts).alias("name")).distinct()


def imported_distributions(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, ecosystem, name) that Python imports (repo, name) ask for: neither standard modules nor the repository's own."""
    foreign = imports.where(~F.col("name").isin(*rules.PYTHON_STDLIB)).join(local_modules(files), ["repo", "name"], "left_anti")
    return foreign.select("repo", F.lit("pypi").alias("ecosystem"), distribution_of_import("name").alias("name")).distinct()


def proposed(asked: DataFrame, declared: DataFrame) -> DataFrame:
    """Adds already_declared, category, existing and prefer to (repo, ecosystem, name) about to be added.

    existing lists, in the group's order, what the repository declares (repo,
    name) for the same purpose; null where nothing. Names compare without case.
    """
    spark = asked.sparkSession
    rows = [(cat, eco, m, k, prefer) for cat, eco, members, prefer in rules.EQUIVALENT_GROUPS for k, m in enumerate(members)]
    members = F.broadcast(spark.createDataFrame(rows, "category string, ecosystem string, _member string, _pos int, prefer string"))
    have = declared.select("repo", F.lower("name").alias("_member")).distinct()
    each = asked.select("repo", "ecosystem", "name").distinct().withColumn("_lower", F.lower("name"))
    flagged = each.join(have.select("repo", F.col("_member").alias("_lower"), F.lit(True).alias("_have")), ["repo", "_lower"], "left")
    own = members.select("ecosystem", F.col("_member").alias("_lower"), "category", "prefer")
    group = flagged.join(own, ["ecosystem", "_lower"], "left")
    others = group.join(members.drop("prefer"), ["ecosystem", "category"]).where("_member <> _lower").join(have, ["repo", "_member"], "left_semi")
    known = others.groupBy("repo", "ecosystem", "name").agg(F.sort_array(F.collect_list(F.struct("_pos", "_member")))["_member"].alias("existing"))
    out = group.join(known, ["repo", "ecosystem", "name"], "left")
    redundant = F.col("existing").isNotNull()
    return out.select("repo", "ecosystem", "name", F.coalesce("_have", F.lit(False)).alias("already_declared"), F.when(redundant, F.col("category")).alias("category"), "existing", F.when(redundant, F.col("prefer")).alias("prefer"))


def verify(asked: DataFrame, registry: DataFrame, advisories: DataFrame, as_of: Column) -> DataFrame:
    """Whether packages (ecosystem, name, version or null) are real and can be trusted, one row for each distinct one asked for.

    registry: (ecosystem, name, downloads, created, latest) of what exists, and
    deprecated where it is known: a notice that stays beside the status.
    advisories: (ecosystem, name, version, id, severity). Missing comes first;
    few downloads or a recent date make a package suspicious, then a name close
    to a popular one, then a name that assistants are known to invent; known
    vulnerabilities at the version asked for, or the latest, override these.
    why lists what spoke against it, in that order.
    """
    spark = asked.sparkSession
    eco = F.col("ecosystem")
    names = asked.select("ecosystem", F.when(eco == "pypi", pypi_name("name")).otherwise(F.col("name")).alias("name"), "version").distinct()
    invented = spark.createDataFrame([(e, n, rules.CONFUSED_WITH.get(n)) for e, n in rules.HALLUCINATED], "ecosystem string, _lower string, confused_with string").withColumn("_listed", F.lit(True))
    close = nearest_popular(names).select("ecosystem", "name", F.col("target").alias("_target"), F.col("distance").alias("_distance"))
    notice = F.col("deprecated") if "deprecated" in registry.columns else F.lit(None).cast("string")
    rows = names.join(registry.select("ecosystem", "name", "downloads", "created", "latest", notice.alias("_notice"), F.lit(True).alias("_there")), ["ecosystem", "name"], "left").join(close, ["ecosystem", "name"], "left")
    rows = rows.withColumn("_lower", F.lower("name")).join(F.broadcast(invented), ["ecosystem", "_lower"], "left")
    worst = F.max_by("severity", rank_in(rules.SEVERITIES, "severity", 0)).alias("max_severity")
    known = advisories.groupBy("ecosystem", "name", F.col("version").alias("_at")).agg(F.count_distinct("id").alias("vulnerabilities"), worst)
    rows = rows.withColumn("_at", F.coalesce("version", "latest")).join(known, ["ecosystem", "name", "_at"], "left")

    sure = lambda c: F.coalesce(c, F.lit(False))
    there, listed, age = F.col("_there").isNotNull(), F.col("_listed").isNotNull(), age_days("created", as_of, rounded=True)
    few = sure(F.col("downloads") < F.when(eco == "npm", rules.SUSPICIOUS_DOWNLOADS["npm"]).otherwise(rules.SUSPICIOUS_DOWNLOADS["pypi"]))
    new = sure(age < rules.SUSPICIOUS_AGE_DAYS)
    alike = F.col("_target").isNotNull() & (few | new | (F.col("_distance") == 1) & ~sure(F.col("downloads") >= rules.ESTABLISHED_DOWNLOADS))
    vulnerable = F.col("vulnerabilities").isNotNull()
    why = {"low_downloads": there & few, "newly_published": there & new, "typosquat": there & alike, "hallucinated": listed, "vulnerable": there & vulnerable}
    near = F.when(there, None).otherwise(F.col("_target"))
    return rows.select(
        "ecosystem", "name", "version", there.alias("exists"),
        F.when(~there, "phantom").when(vulnerable, "vulnerable").when(few | new | alike | listed, "suspicious").otherwise("healthy").alias("status"),
        F.array_compact(F.array(*[F.when(c, k) for k, c in why.items()])).alias("why"), F.when(there, age).alias("age_days"),
        F.when(there & alike, F.col("_target")).alias("typosquat_of"), F.when(there & alike, F.col("_distance")).alias("typosquat_distance"),
        F.coalesce(near, F.col("confused_with")).alias("alternative"), F.when(near.isNotNull(), fuzzy_alternative(F.col("_distance"))).when(F.col("confused_with").isNotNull(), 1.0).alias("alternative_confidence"),
        F.when(there, F.col("vulnerabilities")).alias("vulnerabilities"), F.when(there, F.col("max_severity")).alias("max_severity"),
        F.when(there, F.col("_notice")).alias("deprecated"),
    )
