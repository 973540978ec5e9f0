"""Shared pieces: word expressions, shared scratch tables, distributed ranks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnish.session import shared_dir

#: White space between words, and a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(filled(text), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def restored(df: DataFrame, struct: str, like: DataFrame) -> DataFrame:
    """The fields of a struct column as the columns they were in `like`."""
    return df.select(*[F.col(struct)[c].alias(c) for c in like.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on the session hands Python at most so many bytes of rows at once, and one row at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


class Scratch:
    """Tables written once to the folder that driver and executors share.

    Writing cuts lineage: a lost executor costs a re-read, never a re-run with
    another row order. `drop` removes a table nothing reads any more; an
    operator's result still reads some, so its caller drops those, with
    `cleared`, when the result is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.dir = shared_dir(spark, name)
        _written.append(self.dir)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        removed(self.spark, f"{self.dir}/{name}")


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that operators called within have written, once it is left."""
    before = len(_written)
    try:
        yield
    finally:
        for folder in _written[before:]:
            removed(spark, folder)
        del _written[before:]


def ranked(df: DataFrame, by: list[str], order: list[str | Column], scratch: Scratch, name: str, partitions: int | None = None) -> DataFrame:
    """Adds `_rank`, a row's place (long, from 0) among the rows of its `by` key.

    No key is gathered in one task: rows are range-partitioned on key and order,
    numbered inside their partition, and a table of one row per key and
    partition carries the offsets. `by` columns must not hold null. Rows equal
    in `by` and `order` are numbered in any order, and can be parted by their
    place in the input.
    """
    spark = df.sparkSession
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    n = partitions or shuffle_partitions(spark)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tie")]
    placed = scratch.save(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*by, "_part")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    starts = scratch.save(starts, f"{name}-starts")
    return placed.join(starts, [*by, "_part"]).withColumn("_rank", F.col("_base") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_base")
