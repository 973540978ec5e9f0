"""A keyed table that batches are merged into, in hash buckets: a batch rewrites the buckets of its keys and no others.

A bucket's version is a folder `_bucket=B/_epoch=E` of Parquet files; a batch is
committed by one marker file, written last, so readers see all of it or
nothing. A batch that is run again after its commit changes nothing; one that
failed half way leaves folders that no reader looks at and the next try
removes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketStore:
    """`path` must lie where driver and executors can write; `schema` is that of the rows, `keys` their key; the number of buckets stays as it began."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._at(*parts)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def epochs(self) -> list[int]:
        """Batches that are committed."""
        return sorted(int(n) for n in self._names("_committed") if n.isdigit())

    def versions(self) -> dict[int, int]:
        """The newest committed epoch of each bucket that has rows: at most as many as there are buckets."""
        done, out = set(self.epochs()), {}
        for name in self._names():
            if name.startswith("_bucket="):
                there = [e for n in self._names(name) if (e := int(n.split("=")[1])) in done]
                if there:
                    out[int(name.split("=")[1])] = max(there)
        return out

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        at = [f"{self.path}/_bucket={b}/_epoch={e}" for b, e in self.versions().items() if buckets is None or b in buckets]
        rows = self.spark.read.schema(self.schema)
        return rows.parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, epoch: int, merge: Merge) -> list[int]:
        """Merges a batch into the buckets of its keys, by merge(old rows of those buckets, batch), and returns these buckets."""
        if epoch in self.epochs():
            return []
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # no more than there are buckets
            fs = self._fs()
            for b in touched:
                fs.delete(self._at(f"_bucket={b}", f"_epoch={epoch}"), True)
            merged = merge(self.read(touched), batch).select(*self.columns)
            # A bucket is one task's: a salt would make small files, and buckets are sized so that one fits.
            laid = merged.withColumn("_bucket", self.bucket()).withColumn("_epoch", F.lit(epoch)).repartition(len(touched) or 1, "_bucket")
            laid.write.mode("append").partitionBy("_bucket", "_epoch").parquet(self.path)
            for b in touched:
                fs.mkdirs(self._at(f"_bucket={b}", f"_epoch={epoch}"))  # stays empty where all rows of a bucket went
            fs.create(self._at("_committed", str(epoch)), True).close()
            return sorted(touched)
        finally:
            batch.unpersist()

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions of buckets older than the newest `keep`; a reader that began before `keep` batches loses its files."""
        done, fs = set(self.epochs()), self._fs()
        for name in self._names():
            if name.startswith("_bucket="):
                there = sorted(e for n in self._names(name) if (e := int(n.split("=")[1])) in done)
                for e in there[:-keep]:
                    fs.delete(self._at(name, f"_epoch={e}"), True)


def into(store: BucketStore, merge: Merge) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""

    def run(batch: DataFrame, epoch: int) -> None:
        store.merge(batch, epoch, merge)

    return run
