"""Files of checked-out repositories, hidden ones included.

Spark's own file readers leave out names that begin with a dot or an
underscore, which are those an assistant's configuration has. Options: `roots`
(folders, comma-separated, seen by all executors; each is a repository, named
by its last part), `max_bytes`, `skip` (folder names left out).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = "node_modules,.git,dist,build,out,coverage,vendor,__pycache__,.venv,venv"
SCRIPT, PYTHON = r"\.(js|jsx|ts|tsx|mjs|cjs)\z", r"\.py\z"
SKIPPED_DIR = r"(^|/)(node_modules|\.git|coverage|vendor|__tests__|__mocks__|__fixtures__|(dist|build|out)(-[^/]*)?)/|(^|/)tests?/(.*/)?fixtures?(-[^/]*)?/"
SKIPPED_PYTHON = r"(^|/)(__pycache__|\.venv|venv|env|\.tox|\.mypy_cache|\.pytest_cache|node_modules|site-packages|[^/]+\.egg-info)/"
SOURCE_BYTES, SURFACE_BYTES, INVENTORY_BYTES = 1 << 20, 256 << 10, 512 << 10


class Folder(InputPartition):
    def __init__(self, root: str, start: str, deep: bool):
        self.root, self.start, self.deep = root, start, deep


class RepoFiles(DataSource):
    """(repo, path, size, content): one partition for each folder at the top of a repository."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "repo string, path string, size long, content string"

    def reader(self, schema) -> DataSourceReader:
        return RepoFilesReader(self.options)


class RepoFilesReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r.rstrip("/") for r in options["roots"].split(",")]
        self.most = int(options.get("max_bytes", SOURCE_BYTES))
        self.skip = set(options.get("skip", SKIPPED).split(","))

    def partitions(self) -> list[Folder]:
        out = []
        for root in self.roots:
            out.append(Folder(root, root, False))
            out += [Folder(root, e.path, True) for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in self.skip]
        return out

    def read(self, part: Folder) -> Iterator[tuple]:
        for folder, names, files in os.walk(part.start):
            names[:] = sorted(n for n in names if n not in self.skip) if part.deep else []
            for name in sorted(files):
                full = os.path.join(folder, name)
                try:
                    size = os.path.getsize(full)
                    content = None
                    if size <= self.most and not os.path.islink(full):
                        with open(full, encoding="utf-8", newline="") as f:
                            content = f.read()
                except OSError:
                    continue
                except UnicodeDecodeError:
                    content = None
                yield os.path.basename(part.root), os.path.relpath(full, part.root).replace(os.sep, "/"), size, content


def read_repos(spark, *roots: str, **options) -> DataFrame:
    from tarnish.sources import register

    register(spark)
    return spark.read.format("repo_files").options(roots=",".join(roots), **options).load()


def source_files(files: DataFrame) -> DataFrame:
    """Script sources worth analysing."""
    return files.where(F.col("path").rlike(SCRIPT) & ~F.col("path").rlike(SKIPPED_DIR) & (F.col("size") <= SOURCE_BYTES))


def python_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(PYTHON) & ~F.col("path").rlike(SKIPPED_PYTHON) & (F.col("size") <= SOURCE_BYTES))


def surface_files(files: DataFrame, most: int = SURFACE_BYTES) -> DataFrame:
    """Files an assistant trusts, with their kind; content is null beyond `most` bytes, the path counts all the same."""
    from tarnish.functions.scalar import classify_path

    kept = files.withColumn("surface", classify_path("path")).where("surface is not null")
    return kept.withColumn("content", F.when(F.col("size") <= most, F.col("content")))


def ecosystems(files: DataFrame) -> DataFrame:
    """(repo, npm, pypi): which package systems a repository uses."""
    p = F.col("path")
    return files.groupBy("repo").agg(F.bool_or(p == "package.json").alias("npm"), F.bool_or(p.rlike(r"^(pyproject\.toml|requirements[\w.-]*\.txt)\z") | p.rlike(PYTHON)).alias("pypi"))


def within_limits(files: DataFrame, most_files: int = 20_000, most_bytes: int = 200 << 20) -> DataFrame:
    """(repo, files, bytes, accepted) of a clone."""
    sums = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return sums.withColumn("accepted", (F.col("files") <= most_files) & (F.col("bytes") <= most_bytes))


def licence_of(files: DataFrame) -> DataFrame:
    """(repo, licence): of the manifest, else the first line of a licence file."""
    p, c = F.col("path"), F.col("content")
    named = F.coalesce(F.get_json_object(c, "$.license.type"), F.get_json_object(c, "$.license"))
    order = F.when(p == "package.json", 0).when(p == "LICENSE", 1).when(p == "LICENSE.md", 2).when(p == "LICENSE.txt", 3).when(p == "COPYING", 4)
    value: Column = F.when(p == "package.json", named).otherwise(F.trim(F.substring_index(F.trim(c), "\n", 1)))
    found = files.select("repo", order.alias("o"), value.alias("licence")).where("o is not null and licence is not null and licence <> ''")
    return found.groupBy("repo").agg(F.min_by("licence", "o").alias("licence"))
