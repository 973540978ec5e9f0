import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tarnish.sources import manifests, register, repo_files, sinks

LOCK = {
    "packages": {
        "": {"dependencies": {"left-pad": "^1"}}, "node_modules/left-pad": {"version": "1.3.0", "dependencies": {"deep-transitive": "*"}},
        "node_modules/deep-transitive": {"version": "2.1.0"}, "node_modules/left-pad/node_modules/deep-transitive": {"version": "9.9.9"},
    }
}
YARN = '# yarn lockfile v1\n\n"@s/a@^1", "@s/a@^2":\n  version "1.5.0"\n  dependencies:\n    b "^2"\n    "@s/c" "^1"\n\nb@^2:\n  version "2.0.1"\n'
FILES = {
    "package.json": json.dumps({"license": {"type": "MIT"}, "dependencies": {"left-pad": "^1"}, "devDependencies": {"left-pad": "^0", "husky": "*"}, "workspaces": ["packages/*"]}),
    "packages/ui/package.json": json.dumps({"name": "@own/ui"}),
    "package-lock.json": json.dumps(LOCK),
    "yarn.lock": YARN,
    "requirements.txt": "rich>=13.0  # unused\r\nFlask[async]==2.0\r\n-r more/extra.txt\r\n",
    "more/extra.txt": "rich==1.0\nhttpx\n",
    "pyproject.toml": '[project]\ndependencies = ["rich==9", "numpy>=2"]\n[tool.poetry.dependencies]\npython = "^3"\nPand_as = {version = "^1"}\n',
    ".mcp.json": '{"mcpServers": {}}', ".claude/skills/x/SKILL.md": "skill", "tests/CLAUDE.md": "no", "README.md": "hi", "src/__init__.py": "import os", "node_modules/x/index.js": "x",
    "src/app.ts": "x", "dist-old/x.ts": "x", "LICENSE": "Apache License\nmore",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos") / "demo"
    for path, content in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content, newline="")
    (root / "blob.bin").write_bytes(b"\xff\xfe\x00")
    return root


@pytest.fixture(scope="module")
def files(spark, repo):
    return repo_files.read_repos(spark, str(repo)).cache()


def test_hidden_files_are_read(files):
    found = {r["path"]: r for r in files.collect()}
    assert found.keys() == {p for p in FILES if not p.startswith("node_modules")} | {"blob.bin"}
    assert found[".mcp.json"]["content"] == FILES[".mcp.json"] and found["blob.bin"]["content"] is None
    assert {r["repo"] for r in found.values()} == {"demo"}


def test_file_classes(files):
    paths = lambda df: {r["path"] for r in df.collect()}
    assert paths(repo_files.source_files(files)) == {"src/app.ts"} and paths(repo_files.python_files(files)) == {"src/__init__.py"}
    assert {(r["path"], r["surface"]) for r in repo_files.surface_files(files).collect()} == {(".mcp.json", "mcp_config"), (".claude/skills/x/SKILL.md", "skill"), ("README.md", "corroborate_only")}
    assert repo_files.ecosystems(files).first().asDict() == {"repo": "demo", "npm": True, "pypi": True}
    assert repo_files.licence_of(files).first()["licence"] == "MIT"
    assert repo_files.within_limits(files, most_files=3).first()["accepted"] is False


def test_npm_manifest(files):
    rows = {(r["name"], r["spec"], r["is_dev"]) for r in manifests.npm_declared(files).collect()}
    assert rows == {("left-pad", "^1", False), ("left-pad", "^0", True), ("husky", "*", True)}
    assert [r["name"] for r in manifests.workspace_members(files).collect()] == ["@own/ui"]


def test_python_manifest_first_wins(files):
    rows = {r["name"]: r["spec"] for r in manifests.python_declared(files).collect()}
    assert rows == {"rich": ">=13.0", "flask": "==2.0", "httpx": None, "numpy": ">=2", "pand-as": "^1"}


def test_lockfiles(files, spark):
    rows = {(r["ecosystem"], r["kind"], r["name"], r["version"], r["direct"]) for r in manifests.lock_entries(files).collect()}
    assert rows == {("npm", "package", "left-pad", "1.3.0", True), ("npm", "package", "deep-transitive", "2.1.0", False), ("npm", "required", "deep-transitive", None, None), ("pypi", "package", "flask", "2.0", True), ("pypi", "package", "rich", "1.0", True)}
    yarn = spark.createDataFrame([("y", "yarn.lock", YARN), ("bad", "package-lock.json", "{"), ("v1", "package-lock.json", json.dumps({"dependencies": {"a": {"version": "1", "requires": {"b": "1"}, "dependencies": {"b": {"version": "2"}}}}}))], "repo string, path string, content string")
    got = {(r["repo"], r["kind"], r["name"], r["version"]) for r in manifests.lock_entries(yarn).collect()}
    assert got == {("y", "package", "@s/a", "1.5.0"), ("y", "package", "b", "2.0.1"), ("y", "required", "b", None), ("y", "required", "@s/c", None), ("v1", "package", "a", "1"), ("v1", "package", "b", "2"), ("v1", "required", "b", None)}


def test_git_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(3):
        (tmp_path / "m.json").write_text(str(k))
        git("add", ".")
        git("commit", "-qm", f"commit {k}\n\nbody | with : marks")
    register(spark)
    read = lambda what, **o: spark.read.format("git_history").options(roots=str(tmp_path), what=what, **o).load().collect()
    assert [(r["seq"], r["message"].split("\n")[0]) for r in sorted(read("commits"), key=lambda r: r["seq"])] == [(k, f"commit {k}") for k in range(3)]
    assert {(r["seq"], r["path"]) for r in read("files")} == {(k, "m.json") for k in range(3)}
    assert {(r["seq"], r["content"]) for r in read("revisions", path="m.json")} == {(k, str(k)) for k in range(3)}


def test_csv_and_state_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'a "q"'), (1, None)], "id int, text string")
    sinks.write_csv(rows, f"{tmp_path}/csv", ["id", "text"], ["id"])
    lines = [x for p in (tmp_path / "csv").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == ["id,text", '"1",""', '"2","a ""q"""']
    assert sinks.read_state(spark, f"{tmp_path}/state") is None
    sinks.write_state(rows, f"{tmp_path}/state")
    again = sinks.write_state(sinks.read_state(spark, f"{tmp_path}/state").where("id = 1"), f"{tmp_path}/state")
    assert again.count() == 1 and sinks.read_state(spark, f"{tmp_path}/state").count() == 1


def test_reports(spark):
    scans = spark.createDataFrame([("s", 58.5, "review")], "scan string, score double, recommendation string")
    ranked = spark.createDataFrame([("s", 1, "high", "a|b"), ("s", 2, "low", "c")], "scan string, rank int, band string, title string")
    assert sinks.pr_comments(scans, ranked).first()["comment"] == "## Score 58.5 (D)\nRecommendation: review\n- **high** a\\|b\n- **low** c"
    found = spark.createDataFrame([("s", "hardcoded_secret", "<k>"), ("s", "dead_export", "f")], "scan string, finding_type string, title string")
    assert sinks.html_reports(found).first()["html"] == "<h2>Code</h2><ul><li>f</li></ul><h2>Secrets</h2><ul><li>&lt;k&gt;</li></ul>"
    assert "green" in sinks.badges(spark.createDataFrame([("r", 80.0)], "repo string, latest_score double")).first()["svg"]
    assert json.loads(sinks.json_reports(scans).first()["report"])["score"] == 58.5
    done = spark.createDataFrame([("r", 1, 50.0, "complete", 1), ("r", 2, 70.0, "complete", 2), ("r", 3, 10.0, "failed", 3)], "repo string, scan int, score double, status string, completed_at int")
    assert sinks.latest_scores(done).first()["latest_score"] == 70.0


@pytest.fixture(scope="module")
def worked(tmp_path_factory):
    """A repository with odd messages and paths, a manifest that changes, and things staged."""
    root = tmp_path_factory.mktemp("git") / "worked"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A\x1fnn", "-c", "user.email=a@x.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (root / "sub").mkdir()
    for k in range(7):
        (root / "sub" / "package.json").write_text(json.dumps({"dependencies": {f"p{j}": "1" for j in range(k)}}))
        (root / f"tab\t{k} é.txt").write_text(str(k))
        git("add", ".")
        git("commit", "-qm", f"commit {k} \x1f with \x1e marks\n\nbody")
    git("rm", "-q", "tab\t0 é.txt")
    (root / "sub" / "package.json").write_text('{"dependencies": {"p1": "1", "fresh-name": "2"}}')
    (root / ".mcp.json").write_text('{"mcpServers": {"s": {"command": "bash", "args": ["x.sh"]}}}')
    (root / "data.bin").write_bytes(b"\xff\xfe\x00")
    git("add", ".")
    (root / "sub" / "package.json").write_text("{}")  # not staged
    return root


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_history_in_ranges(spark, worked, chunk):
    register(spark)
    load = lambda what, **o: spark.read.format("git_history").options(roots=str(worked), what=what, chunk=chunk, **o).load()
    read = lambda what, **o: load(what, **o).collect()
    commits = sorted(read("commits"), key=lambda r: r["seq"])
    assert [(r["seq"], r["author"], r["message"]) for r in commits] == [(k, "A\x1fnn", f"commit {k} \x1f with \x1e marks\n\nbody") for k in range(7)]
    assert load("commits").rdd.getNumPartitions() == -(-7 // chunk)
    assert {(r["seq"], r["path"]) for r in read("files")} == {(k, p) for k in range(7) for p in ("sub/package.json", f"tab\t{k} é.txt")}
    assert {(r["seq"], r["sha"]) for r in read("files")} == {(r["seq"], r["sha"]) for r in commits}
    found = sorted(read("manifests"), key=lambda r: r["seq"])
    assert [(r["path"], r["seq"], len(json.loads(r["content"])["dependencies"])) for r in found] == [("sub/package.json", k, k) for k in range(7)]
    assert sorted(r["seq"] for r in read("manifests", limit=3)) == [0, 1, 2] and {r["sha"] for r in read("manifests", limit=3)} == {r["sha"] for r in commits[-3:]}
    assert [r["content"] for r in read("revisions", path="tab\t3 é.txt")] == ["3"]


def test_index_and_staged_blobs(spark, worked, tmp_path):
    register(spark)
    read = lambda what, root=worked: spark.read.format("git_history").options(roots=str(root), what=what).load().collect()
    assert {r["path"] for r in read("index")} == {"sub/package.json", ".mcp.json", "data.bin", *(f"tab\t{k} é.txt" for k in range(1, 7))} and {r["mode"] for r in read("index")} == {"100644"}
    now = {r["path"]: r["content"] for r in read("staged")}
    assert now.keys() == {"sub/package.json", ".mcp.json"} and "fresh-name" in now["sub/package.json"]
    assert [r["path"] for r in read("head")] == ["sub/package.json"]
    bare = tmp_path / "none"
    bare.mkdir()
    subprocess.run(["git", "-C", str(bare), "init", "-q"], check=True)
    assert [read(what, bare) for what in ("commits", "files", "manifests", "index", "staged", "head")] == [[]] * 6


def test_staged_scan_of_a_repository(spark, worked):
    from tarnish.operators import staged

    register(spark)
    blobs, head = staged.from_repositories(spark, [str(worked)])
    registry = spark.createDataFrame([], "ecosystem string, name string, downloads long, created timestamp, latest string, licence string")
    none = spark.createDataFrame([], "ecosystem string, name string, version string, id string, severity string")
    lock = spark.createDataFrame([("worked", "s", "0"), ("worked", "t", "0")], "repo string, server string, identity string")
    tree = spark.createDataFrame([("worked", ".cursor/mcp.json", '{"mcpServers": {"t": {"command": "node", "args": ["changed.js"]}}}')], "repo string, path string, content string")
    found = lambda **o: {(r["path"], r["rule"], r["subject"]) for r in staged.scan(blobs, head, registry, none, F.current_timestamp(), **o).collect()}
    plain = found()
    assert ("sub/package.json", "phantom", "fresh-name") in plain and (".mcp.json", "mcp_shell_command", "s") in plain and not any(p == "sub/package.json" and s == "p1" for p, _, s in plain)
    assert found(lock=lock) - plain == {(".mcp.json", "mcp_lock_mismatch", "s")}
    assert found(lock=lock, tree=tree) - plain == {(".cursor/mcp.json", "mcp_lock_mismatch", "t")}


def test_registry_documents_of_odd_shapes(spark):
    from tarnish.sources import registry

    odd = ["null", "5", "[]", "{}", "not json", None, '{"versions": [], "dist-tags": 7}', '{"dist-tags": {"latest": "1\'.0"}, "versions": {"1\'.0": {"license": {"type": 3}, "deprecated": true, "dist": {"unpackedSize": "x"}}}}', '{"info": 5, "releases": {"1": {}, "2": [7, null]}}']
    rows = [(eco, f"{eco}{k}", 200, body, "[]") for k, body in enumerate(odd) for eco in ("npm", "pypi")] + [("npm", "gone", 404, None, None), ("npm", "down", 503, "{}", None), ("npm", "none", None, "{}", None)]
    fetched = spark.createDataFrame(rows, "ecosystem string, name string, http_status int, body string, downloads string")
    got = {r["name"]: r for r in registry.records(fetched).collect()}
    assert {n for n, r in got.items() if r["lookup_status"] != "ok"} == {"npm4", "pypi4", "npm5", "pypi5", "gone", "down", "none"} and got["gone"]["lookup_status"] == "not_found"
    assert got["npm7"]["latest"] == "1'.0" and all(got["npm7"][c] is None for c in ("licence", "deprecated", "unpacked_size", "created")) and got["npm3"]["downloads"] == 0 and got["pypi3"]["downloads"] is None
    assert {(r["name"], r["version"]) for r in registry.versions(fetched).collect()} == {("npm7", "1'.0"), ("pypi8", "1"), ("pypi8", "2")}
