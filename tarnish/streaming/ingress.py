"""Uploads as they come: JSON lines of a folder, told apart into accepted rows and a quarantine with the reasons.

The file source keeps the offsets. Nothing is dropped: each line received is a
row of one of the two tables, and a batch that is run again overwrites its own
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A check: what a rejected row is told, and the condition that a good row meets; null counts as not met.
Check = tuple[str, Callable[[Column], Column]]

PHANTOM_REPORT = "name string, ecosystem string"
PHANTOM_CHECKS: list[Check] = [
    ("name: 1 to 214 characters", lambda r: F.length(r["name"]).between(1, 214)),
    ("ecosystem: npm or pypi", lambda r: r["ecosystem"].isin("npm", "pypi")),
]


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 1000, glob: str | None = None) -> DataFrame:
    """(value, file, modified): lines of the files of a folder, as a stream."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def checked(lines: DataFrame, schema: str, checks: list[Check]) -> DataFrame:
    """Adds `row` (struct of the schema) and `reasons`, empty if all is well. A line that is no object of the schema has one reason."""
    parsed = lines.withColumn("_parsed", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    fields = lines.sparkSession.createDataFrame([], schema).columns
    row = F.struct(*[F.col("_parsed")[c].alias(c) for c in fields])
    sound = F.col("_parsed").isNotNull() & F.col("_parsed")["_corrupt"].isNull() & F.trim("value").startswith("{")
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(holds(F.col("row")), F.lit(False)), reason) for reason, holds in checks]))
    rows = parsed.withColumn("row", row).withColumn("_sound", F.coalesce(sound, F.lit(False)))
    return rows.withColumn("reasons", F.when(F.col("_sound"), failed).otherwise(F.array(F.lit("not an object of the schema")))).drop("_parsed", "_sound")


def split_into(accepted: str, quarantine: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over `checked` lines: the two tables, each batch a folder of its own."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            good, bad = batch.where(F.size("reasons") == 0), batch.where(F.size("reasons") > 0)
            good.select("row.*", "file", "modified").write.mode("overwrite").parquet(f"{accepted}/batch={epoch}")
            bad.select(F.col("value").alias("raw"), "reasons", "file", "modified").write.mode("overwrite").parquet(f"{quarantine}/batch={epoch}")
        finally:
            batch.unpersist()

    return run


def ingest(lines: DataFrame, schema: str, checks: list[Check], path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Runs over all that is there now; returns (accepted, quarantined) with the number of their `batch`."""
    write = checked(lines, schema, checks).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    write.foreachBatch(split_into(f"{path}/accepted", f"{path}/quarantine")).start().awaitTermination()
    read = lambda name, columns: lines.sparkSession.read.schema(f"{columns}, file string, modified timestamp, batch long").parquet(f"{path}/{name}")
    return read("accepted", schema), read("quarantine", "raw string, reasons array<string>")
