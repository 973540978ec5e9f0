"""Commits, index and blobs of repositories that all executors can read, through git.

Options: `roots` (folders, comma-separated), `what`, `path` for revisions,
`limit` (commits: 500; of a manifest: 200), `chunk` (commits a partition: 100).

| what | rows |
|-|-|
| commits | repo, seq, sha, author, email, date, message |
| files | repo, seq, sha, path: what each commit touched |
| revisions | repo, path, seq, sha, content: of one path |
| manifests | the same of every manifest of the index |
| index | repo, path, mode, blob: tracked files |
| staged | repo, path, content: what the next commit adds or changes, as it stands in the index |
| head | repo, path, content: the same paths as HEAD has them |

seq is 0 for the oldest commit read. History is read in ranges of commits, so a
long one is several partitions. Fields are parted by NUL, which neither
messages nor paths can hold. Blobs over `MAX_BLOB` and those that are no UTF-8
have null content.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnish.functions import rules

REVISIONS = "repo string, path string, seq int, sha string, content string"
BLOBS = "repo string, path string, content string"
SCHEMAS = {
    "commits": "repo string, seq int, sha string, author string, email string, date string, message string",
    "files": "repo string, seq int, sha string, path string",
    "revisions": REVISIONS, "manifests": REVISIONS, "index": "repo string, path string, mode string, blob string", "staged": BLOBS, "head": BLOBS,
}
LIMITS = {"revisions": 500, "commits": 500, "files": 500, "manifests": 200}
MAX_BLOB = 1 << 20


class Repository:
    def __init__(self, root: str):
        self.root, self.name = root, os.path.basename(root.rstrip("/"))

    def git(self, *args: str, said: bytes | None = None) -> bytes:
        """Output of a command; empty where git refuses, as in a repository without commits."""
        return subprocess.run(["git", "-C", self.root, *args], capture_output=True, input=said, check=False).stdout

    def names(self, *args: str, said: bytes | None = None) -> list[str]:
        return [x.decode("utf-8", "replace") for x in self.git(*args, said=said).split(b"\0") if x]

    def count(self, limit: int, *paths: str) -> int:
        found = self.git("rev-list", "--count", f"--max-count={limit}", "HEAD", *(["--", *paths] if paths else []))
        return int(found or 0)

    def shas(self, low: int, high: int, *paths: str) -> list[str]:
        """Commits from `low` to `high`, 0 the newest."""
        return self.git("rev-list", f"--skip={low}", f"--max-count={high - low}", "HEAD", *(["--", *paths] if paths else [])).decode().split()

    def blobs(self, names: list[str]) -> Iterator[str | None]:
        """Contents of objects such as sha:path, by one process; null if there is none, or it is large or no text."""
        plain = [n for n in names if "\n" not in n]
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
            for name in names:
                if name not in plain:
                    yield text_of(self.git("show", name))
                    continue
                run.stdin.write(name.encode() + b"\n")
                run.stdin.flush()
                head = run.stdout.readline().split()
                if len(head) != 3 or head[1] != b"blob":
                    if len(head) == 3 and head[2].isdigit():  # a tree or a commit
                        run.stdout.read(int(head[2]) + 1)
                    yield None
                    continue
                yield text_of(run.stdout.read(int(head[2]) + 1)[:-1])
            run.stdin.close()


def text_of(raw: bytes) -> str | None:
    if len(raw) > MAX_BLOB:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


class Part(InputPartition):
    """Commits `low` to `high` of a repository (0 the newest of `total`), of a path where one is named."""

    def __init__(self, root: str, low: int = 0, high: int = 0, total: int = 0, path: str = ""):
        self.root, self.low, self.high, self.total, self.path = root, low, high, total, path


class GitReader(DataSourceReader):
    def __init__(self, options):
        self.roots, self.what = options["roots"].split(","), options.get("what", "commits")
        self.path, self.limit = options.get("path", ""), int(options.get("limit", LIMITS.get(self.what, 0)))
        self.chunk = int(options.get("chunk", 100))

    def partitions(self) -> list[InputPartition]:
        if self.what not in LIMITS:
            return [Part(r) for r in self.roots]
        return [p for r in self.roots for path in self.paths(Repository(r)) for p in self.ranges(r, path)]

    def paths(self, repo: Repository) -> list[str]:
        if self.what == "manifests":
            return [n for n in repo.names("ls-files", "-z") if re.search(rules.MANIFEST.replace(r"\z", r"\Z"), n)]
        return [self.path] if self.what == "revisions" else [""]

    def ranges(self, root: str, path: str) -> Iterator[Part]:
        total = Repository(root).count(self.limit, *([path] if path else []))
        for low in range(0, total, self.chunk):
            yield Part(root, low, min(low + self.chunk, total), total, path)

    def read(self, part: Part | None) -> Iterator[tuple]:
        if part is None:  # no history, so no partitions
            return
        repo = Repository(part.root)
        if self.what == "index":
            for entry in repo.names("ls-files", "-s", "-z"):
                facts, path = entry.split("\t", 1)
                mode, blob, _ = facts.split(" ")
                yield repo.name, path, mode, blob
        elif self.what in ("staged", "head"):
            paths = repo.names("diff", "--cached", "--name-only", "--diff-filter=ACM", "-z")
            for path, content in zip(paths, repo.blobs([f"{'HEAD' if self.what == 'head' else ''}:{p}" for p in paths]), strict=True):
                if content is not None:
                    yield repo.name, path, content
        else:
            yield from getattr(self, self.what)(repo, part)

    def commits(self, repo: Repository, part: Part) -> Iterator[tuple]:
        fields = repo.git("log", "-z", f"--skip={part.low}", f"--max-count={part.high - part.low}", "--format=%H%x00%an%x00%ae%x00%aI%x00%B").decode("utf-8", "replace").split("\0")
        for k in range(len(fields) // 5):
            sha, author, email, date, message = fields[5 * k : 5 * k + 5]
            yield repo.name, part.total - 1 - part.low - k, sha, author, email, date, message.strip()

    def files(self, repo: Repository, part: Part) -> Iterator[tuple]:
        shas = repo.shas(part.low, part.high)
        seqs = {sha: part.total - 1 - part.low - k for k, sha in enumerate(shas)}
        at = None
        for name in repo.names("diff-tree", "--stdin", "-r", "--root", "--name-only", "-z", said="".join(f"{s}\n" for s in shas).encode()):
            name = name.lstrip("\n") if at is None else name
            if name in seqs:
                at = name
            else:
                yield repo.name, seqs[at], at, name

    def revisions(self, repo: Repository, part: Part) -> Iterator[tuple]:
        shas = repo.shas(part.low, part.high, part.path)
        for k, (sha, content) in enumerate(zip(shas, repo.blobs([f"{s}:{part.path}" for s in shas]), strict=True)):
            yield repo.name, part.path, part.total - 1 - part.low - k, sha, content

    manifests = revisions
