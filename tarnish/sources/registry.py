"""Documents of package registries as they were fetched, of any shape, read as VARIANT.

Only what is asked of a document is taken out of it, by path; a field of
another type than expected reads as missing, a body that is no JSON as a lookup
that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.operators.packages import resolved_licence

YANKED = "yanked from the index"


def text(v: Column, path: str = "$") -> Column:
    """A string at a path; null for anything that is no string."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def members(v: Column, path: str) -> Column:
    """The members of an object at a path, by name."""
    return F.try_variant_get(v, path, "map<string,variant>")


def versions(fetched: DataFrame) -> DataFrame:
    """(ecosystem, name, version, released, deprecated, yanked): every version that a document (ecosystem, name, body) lists."""
    rows = fetched.select("ecosystem", "name", F.try_parse_json("body").alias("_v"))
    npm = rows.where("ecosystem = 'npm'").select("ecosystem", "name", F.col("_v"), F.explode(members(F.col("_v"), "$.versions")).alias("version", "_at"))
    npm = npm.select("ecosystem", "name", "version", text(F.try_element_at(members(F.col("_v"), "$.time"), F.col("version"))).alias("released"), text(F.col("_at"), "$.deprecated").alias("deprecated"), F.lit(False).alias("yanked"))
    files = F.try_variant_get(F.col("_at"), "$", "array<variant>")
    pypi = rows.where("ecosystem = 'pypi'").select("ecosystem", "name", F.explode(members(F.col("_v"), "$.releases")).alias("version", "_at"))
    gone = F.size(files).cast("int") > 0
    yanked = gone & F.forall(files, lambda f: F.coalesce(F.try_variant_get(f, "$.yanked", "boolean"), F.lit(False)))
    pypi = pypi.select("ecosystem", "name", "version", uploaded(files).alias("released"), F.lit(None).cast("string").alias("deprecated"), F.coalesce(yanked, F.lit(False)).alias("yanked"))
    return npm.unionByName(pypi)


def uploaded(files: Column) -> Column:
    """Earliest upload of a version's files, as written."""
    return F.array_min(F.filter(F.transform(files, lambda f: text(f, "$.upload_time_iso_8601")), lambda t: t != ""))


def records(fetched: DataFrame) -> DataFrame:
    """One row per document (ecosystem, name, http_status, body, downloads), downloads being the body of the counter's answer or null.

    Gives ecosystem, name, lookup_status (ok, not_found, error), downloads
    (npm: a week's, pypi: a month's), created, latest, licence,
    has_licence_text, deprecated and unpacked_size. A name is missing only on a
    404; a counter of the npm kind without a number counts as zero.
    """
    v, at, d = F.col("_v"), F.col("_latest"), F.col("_d")
    npm = F.col("ecosystem") == "npm"
    rows = fetched.select("ecosystem", "name", "http_status", "downloads", F.try_parse_json("body").alias("_v"), F.try_parse_json("downloads").alias("_d"))
    status = F.when(F.col("http_status") == 404, "not_found").when(v.isNull() | ~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), "error").otherwise("ok")
    rows = rows.withColumns({"lookup_status": status, "latest": F.when(npm, text(v, "$['dist-tags'].latest")).otherwise(text(v, "$.info.version"))})
    rows = rows.withColumn("_latest", F.when(npm, F.try_element_at(members(v, "$.versions"), F.col("latest"))))
    count = F.when(npm, F.when(F.col("downloads").isNotNull(), F.coalesce(F.try_variant_get(d, "$.downloads", "double"), F.lit(0.0)))).otherwise(F.try_variant_get(d, "$.data.last_month", "double"))
    files = F.flatten(F.filter(F.transform(F.map_values(members(v, "$.releases")), lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: x.isNotNull()))
    created = F.when(npm, text(v, "$.time.created")).otherwise(uploaded(files))
    classifiers = F.filter(F.coalesce(F.try_variant_get(v, "$.info.classifiers", "array<string>"), F.array().cast("array<string>")), lambda c: c.isNotNull())
    python = resolved_licence(text(v, "$.info.license_expression"), text(v, "$.info.license"), classifiers)
    yanked = F.when(F.coalesce(F.try_variant_get(v, "$.info.yanked", "boolean"), F.lit(False)), YANKED)
    ok = F.col("lookup_status") == "ok"
    given = {
        "downloads": count, "created": F.try_to_timestamp(created), "latest": F.col("latest"), "licence": F.when(npm, F.coalesce(text(at, "$.license"), text(at, "$.license.type"))).otherwise(python["licence"]),
        "has_licence_text": F.when(npm, F.lit(False)).otherwise(F.coalesce(python["has_licence_text"], F.lit(False))), "deprecated": F.when(npm, text(at, "$.deprecated")).otherwise(yanked),
        "unpacked_size": F.try_variant_get(at, "$.dist.unpackedSize", "long"),
    }
    return rows.select("ecosystem", "name", "lookup_status", *[F.when(ok, c).alias(n) for n, c in given.items()])
