import subprocess
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import detect, git
from weftgraph.sources.tree import ScanConfig, source_files
from weftgraph.store import Conflict, GraphStore, NotFound
from weftgraph.streaming import incremental


@pytest.fixture
def store(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/store")
    s.initialize()
    s.create_project("p", description="d")
    return s


NODES = [{"id": "a.A", "type": "class", "name": "A", "qualified_name": "a.A", "description": "", "start_line": 0}, {"id": "b.I", "type": "Interface", "name": "I"}, {"id": "a.A.m", "type": "method", "name": "m", "modifiers": ["public"]}]


def test_projects(store):
    assert store.healthy() and store.get_project("p")["name"] == "p" and store.get_project("no") is None
    with pytest.raises(Conflict):
        store.create_project("p")
    store.create_project("q", "Q")
    assert {r.project_id for r in store.list_projects().collect()} == {"p", "q"}
    store.add_nodes("q", NODES)
    assert store.delete_project("q") and not store.delete_project("q") and store.table("nodes", "q").count() == 0
    assert store.query("select count(*) k from projects where project_id = :x", x="p").first().k == 1


def test_nodes_and_edges(store):
    store.add_nodes("p", NODES)
    n = store.get_node("p", "a.A")
    assert n["description"] is None and n["start_line"] is None and n["modifiers"] == [] and n["attributes"] == {} and store.get_node("p", "b.I")["type"] == "interface"
    for bad in ([NODES[0]], [{"id": "x", "type": "nonsense"}], [{"id": "y", "type": "class"}] * 2):
        with pytest.raises(Conflict):
            store.add_nodes("p", bad)
    store.add_nodes("p", [NODES[0] | {"name": "other"}], strict=False)
    assert store.get_node("p", "a.A")["name"] == "A" and store.table("nodes").count() == 3
    store.update_node("p", "a.A", name="AA", modifiers=["final"], id="ignored")
    assert store.get_node("p", "a.A")["name"] == "AA" and store.get_node("p", "a.A")["modifiers"] == ["final"] and store.get_node("p", "b.I")["name"] == "I"
    for error, kw in ((ValueError, {}), (ValueError, {"nope": 1}), (ValueError, {"id": "z"})):
        with pytest.raises(error):
            store.update_node("p", "a.A", **kw)
    with pytest.raises(NotFound):
        store.update_node("p", "gone", name="x")
    store.add_edges("p", [{"id": "e1", "type": "CONTAINS", "source": "a.A", "target": "a.A.m"}, {"id": "e2", "type": "implements", "source": "a.A", "target": "z.y.I"}])
    assert store.get_edge("p", "e2")["target"] == "b.I" and store.get_edge("p", "e1")["type"] == "contains"
    with pytest.raises(Conflict):
        store.add_edges("p", [{"id": "e3", "type": "calls", "source": "a.A", "target": "gone"}])
    missing = store.add_edges("p", [{"id": "e3", "type": "calls", "source": "a.A", "target": "gone"}, {"id": "e1", "type": "calls", "source": "a.A", "target": "a.A"}], strict=False)
    assert [r.id for r in missing.collect()] == ["e3"] and store.table("edges").count() == 2
    store.update_edge("p", "e1", type="calls", source="ignored")
    assert store.get_edge("p", "e1")["type"] == "calls" and store.get_edge("p", "e1")["source"] == "a.A"
    assert store.delete_edge("p", "e1") and not store.delete_edge("p", "e1")
    assert store.delete_node("p", "b.I") and not store.delete_node("p", "b.I") and store.table("edges").count() == 0
    store.check_unique("nodes")
    store.clear("p")
    assert store.table("nodes").count() == 0 and store.get_project("p")


def test_embeddings(store, spark):
    store.add_nodes("p", NODES)
    new = spark.createDataFrame([("a.A", [1.0], "m"), ("gone", [1.0], "m"), ("b.I", None, "m")], "node_id string, semantic_embedding array<float>, model string")
    assert [r.node_id for r in store.add_embeddings("p", new).collect()] == ["gone"]
    store.add_embeddings("p", new.withColumn("model", F.lit("m2")))
    assert [(r.node_id, r.model) for r in store.table("embeddings").collect()] == [("a.A", "m2")]


def tree(tmp_path):
    root = tmp_path / "src"
    for path, text in {"pkg/a.py": "class A:\n    def f(self): pass\n", "pkg/deep/er/b.py": "class B: pass\n", "node_modules/x.js": "x()", "sub/node_modules/y.js": "y()", "t/test_a.py": "def test_a(): pass\n", "bad.py": "def f(", "App.java": "class App { }", "package.json": '{"name": "n", "version": "1", "dependencies": {"express": "1", "react": "2"}}', "yarn.lock": "", "sub/pom.xml": "<project><artifactId>art</artifactId><version>2</version></project>", "notes.txt": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_source_tree(spark, tmp_path):
    root = tree(tmp_path)
    names = lambda **kw: {r.source_file for r in source_files(spark, ScanConfig(str(root), "p", **kw)).collect()}
    assert names() == {"pkg/a.py", "pkg/deep/er/b.py", "t/test_a.py", "bad.py", "App.java"}
    assert names(include_tests=False, languages=("python",), max_depth=1) == {"pkg/a.py", "bad.py"}
    assert names(exclude_paths=("pkg/**",), languages=("python",)) == {"t/test_a.py", "bad.py"}


def test_scan_and_add_files(store, spark, tmp_path):
    root = tree(tmp_path)
    for _ in range(2):  # a second scan changes nothing
        out = store.scan(ScanConfig(str(root), "s"))
        assert (out["files"], out["errors"].count()) == (5, 1) and store.table("nodes", "s").where("id = 'pkg.a.A.f'").count() == 1
    edges = store.table("edges", "s").count()
    new = spark.createDataFrame([("s", "pkg/a.py", "class C: pass\n")], "project_id string, source_file string, text string")
    store.add_files("s", new)
    ids = {r.id for r in store.table("nodes", "s").collect()}
    assert "pkg.a.C" in ids and "pkg.a.A" not in ids and "pkg.deep.er.b.B" in ids and store.table("edges", "s").count() < edges
    assert store.graph("s").nodes.where("attributes is null").count() == 0


def test_files_in_any_order_give_the_graph_of_a_scan(store, spark):
    texts = {"a.py": "class A:\n    def f(self):\n        return 1\n", "b.py": "from a import A\nclass B(A):\n    def g(self):\n        return self.f()\n", "c.py": "from b import B\nclass C(B): pass\n", "x.py": "class X: pass\n"}
    df = lambda *names: spark.createDataFrame([("s", n, texts[n]) for n in names], "project_id string, source_file string, text string")

    def got(project):
        strip = lambda r: tuple(v for k, v in sorted(r.asDict(True).items()) if k != "project_id")
        return [sorted(map(str, map(strip, store.table(t, project).collect()))) for t in ("nodes", "edges")]

    names = list(texts)
    as_ = lambda p, rows: rows.withColumn("project_id", F.lit(p))
    store.add_files("all", as_("all", df(*names)))
    assert any("b.B_extends_a.A" in e for e in got("all")[1])
    store.add_files("late", as_("late", df("c.py", "b.py")))
    store.add_files("late", as_("late", df("x.py")))
    store.add_files("late", as_("late", df("a.py")))
    assert got("late") == got("all")
    store.add_files("late", as_("late", df("a.py")))  # unchanged
    assert got("late") == got("all")
    store.add_nodes("late", [{"id": "own", "type": "class", "name": "own"}])
    store.add_edges("late", [{"id": "own_link", "type": "references", "source": "own", "target": "c.C"}])
    store.update_node("late", "b.B", description="kept")
    texts["a.py"] = "class Z: pass\n"
    store.add_files("late", as_("late", df("a.py")))
    nodes, edges = got("late")
    assert not any("a.A" in e for e in edges) and any("own_link" in e for e in edges) and any("'own'" in n for n in nodes)
    assert store.get_node("late", "b.B")["description"] == "kept" and store.get_node("late", "a.Z") and store.get_node("late", "a.A") is None


def test_stream(store, spark, tmp_path):
    box = f"{tmp_path}/in"
    put = lambda text, day: spark.createDataFrame([("s", "m.py", text)], "project_id string, source_file string, text string").withColumn("scanned_at", F.lit(f"2024-01-0{day}").cast("timestamp")).write.mode("append").parquet(box)
    for text, day in (("class Old: pass\n", 1), ("class New: pass\n", 2)):
        put(text, day)
    for _ in range(2):
        incremental.keep_indexed(store, incremental.changes(spark, box), f"{tmp_path}/ckpt").awaitTermination()
    assert {r.id for r in store.table("nodes", "s").collect()} == {"m", "m.New"}
    put("class Newer: pass\n", 3)
    incremental.keep_indexed(store, incremental.changes(spark, box), f"{tmp_path}/ckpt").awaitTermination()
    assert {r.id for r in store.table("nodes", "s").collect()} == {"m", "m.Newer"}


def test_detection(spark, tmp_path):
    root = tree(tmp_path)
    files = spark.createDataFrame([(str(p.relative_to(root)), p.read_text()) for p in root.rglob("*") if p.is_file()], "source_file string, text string")
    d = detect.detect(spark, files)
    assert d["sub_projects"] == ["sub"] and d["mono_repo"] and d["primary"] == "python" and d["file_counts"]["python"] == 4
    meta = {m["path"]: m for m in d["metadata"]}
    assert meta["package.json"]["framework"] == "React" and meta["package.json"]["build_system"] == "yarn" and meta["sub/pom.xml"]["name"] == "art"
    assert detect.validate_languages(["python", "csharp"]) == {"supported": ["python"], "unsupported": ["csharp"]}
    assert detect.can_detect("x/My.csproj") and not detect.can_detect("x/pom.xml.bak") and "target" in detect.recommended(["java"])["exclude_paths"]
    assert detect.validate_structure(spark, files)["valid"] and not detect.validate_structure(spark, files.limit(0))["valid"]
    assert detect.metadata("package.json", "{broken")["name"] is None and detect.package_manager({"pnpm-lock.yaml", "yarn.lock"}) == "pnpm"
    sln = 'VisualStudioVersion = 17.1\nProject("{F}") = "Core", "Core\\\\Core.csproj", "{A}"\nEndProject\n'
    assert detect.metadata("All.sln", sln) == {"name": "All", "version": "17.1", "dependencies": ["Core"], "framework": None}
    assert detect.metadata("setup.py", "setup(name='x', install_requires=['flask>=1', \"numpy\"])")["dependencies"] == ["flask", "numpy"]
    assert detect.metadata("pyproject.toml", "[tool.poetry.dependencies]\npython = '^3'\ndjango = '^4'\n[tool.x]\ny = 1\n")["dependencies"] == ["django"]
    assert detect.metadata("setup.cfg", "[options]\ninstall_requires =\n    flask\n    numpy>=1\n")["dependencies"] == ["flask", "numpy"]
    found = detect.detect_tree(spark, ScanConfig(str(root), "t"))
    assert found["valid"] and {m["path"] for m in found["metadata"]} >= {"package.json", "sub/pom.xml"} and found["file_counts"]["python"] >= 1
    assert detect.metadata("requirements.txt", "flask==1\n# x\nnumpy\n")["framework"] == "Flask"


def test_git(tmp_path):
    a = git.parse("https://github.com/o/r.git")
    assert (a.provider, a.project_id, a.url("ssh")) == ("github", "o-r", "git@github.com:o/r.git") and len(a.cache_key()) == 16 and a.cache_key("x") != a.cache_key()
    assert git.is_git_url("git@gitlab.com:o/r.git") and not git.is_git_url("file:///x")
    with pytest.raises(git.GitError):
        git.parse("https://secret@x")
    assert git.credentials("github", env={"GH_TOKEN": "b", "GITHUB_TOKEN": "a"}) == {"token": "a"} and git.credentials("github", {"token": "z"}, {"GH_TOKEN": "b"}) == {"token": "z"} and git.credentials("gitlab", env={}) == {}
    assert git.credentials("bitbucket", env={"BITBUCKET_USERNAME": "u", "BITBUCKET_APP_PASSWORD": "p"}) == {"username": "u", "password": "p"}
    assert git.plausible_token("github", "ghp_" + "a" * 36) and not git.plausible_token("github", "short") and "x-access-token:t%2F@github.com" in git.authenticated_url(a, {"token": "t/"})
    repo = tmp_path / "repo"
    repo.mkdir()
    for args in (["init", "-q"], ["-c", "user.name=n", "-c", "user.email=e@x", "commit", "-q", "--allow-empty", "-m", "m"]):
        subprocess.run(["git", "-C", str(repo), *args], check=True)
    cache, seen = git.Cache(str(tmp_path / "cache")), []
    path = git.clone("https://github.com/o/r.git", cache=cache, progress=lambda p, w: seen.append(p), source=f"file://{repo}")
    assert seen == [10, 30, 95, 100] and git.clone("https://github.com/o/r.git", cache=cache, source="file:///nowhere") == path
    assert cache.stats()["entries"] == 1 and cache.get(a, now=time.time() + 25 * 3600) is None and cache.expire(time.time() + 25 * 3600) == 1 and cache.clear() == 0
    with pytest.raises(git.GitError):
        git.clone("https://github.com/o/r.git", source="file:///nowhere")
