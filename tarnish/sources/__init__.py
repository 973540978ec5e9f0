"""Readers and writers."""

from tarnish.sources.git_history import GitHistory
from tarnish.sources.repo_files import RepoFiles


def register(spark) -> None:
    """Makes the formats `repo_files` and `git_history` known to a session."""
    spark.dataSource.register(RepoFiles)
    spark.dataSource.register(GitHistory)


__all__ = ["GitHistory", "RepoFiles", "register"]
