import subprocess

import pytest

from weftgraph.__main__ import main
from weftgraph.api import GraphApi
from weftgraph.operators.semantic import EmbeddingConfig, hash_provider
from weftgraph.sources import git
from weftgraph.sources.tree import ScanConfig
from weftgraph.store import GraphStore

SOURCE = {"a/base.py": "class Base:\n    def run(self):\n        return 1\n", "a/boat.py": 'from a.base import Base\nclass Boat(Base):\n    """Carries parcels over the water."""\n    def go(self):\n        return self.run()\n    def run(self):\n        return 2\n', "a/broken.py": "def f("}


@pytest.fixture
def root(tmp_path):
    for p, t in SOURCE.items():
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text(t)
    return tmp_path / "tree"


def test_tools(spark, tmp_path, root):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    store.initialize()
    api = GraphApi(store, hash_provider(32), EmbeddingConfig(dimensions=32, threshold=0.5), git.Cache(str(tmp_path / "cache")))
    out = api.scan_dir(ScanConfig(str(root), "p"))
    assert "Boat: 2 methods" in out["report"] and "broken.py" in out["report"]
    assert api.get_inheritance_hierarchy("p", "Boat") == ["Boat", "Base"] and api.get_inheritance_hierarchy("p", "Base") == []
    assert [r.class_name for r in api.find_classes_calling_method("p", "run").collect()] == ["Boat"]
    page, meta = api.find_nodes_by_type("p", "METHOD", limit=2)
    assert page.count() == 2 and meta["total"] == 3 and meta["has_more"]
    assert [r.id for r in api.search_nodes("p", "parcels")[0].collect()] == ["a.boat.Boat"]
    boat = api.calculate_ck_metrics("p", "a.boat.Boat").first()
    assert (boat.wmc, boat.dit, boat.findings) == (2, 1, "healthy")
    assert api.get_project_summary("p").first().classes == 2 and api.find_architectural_issues("p").count() == 0
    api.add_node("p", id="x", type="class", name="X")
    api.add_edge("p", id="e", type="implements", source="x", target="a.boat.Boat")
    assert api.find_edges_by_source("p", "x").count() == 1 and api.get_edge("p", "e")["type"] == "implements"
    api.update_node("p", "x", name="Y")
    assert api.get_node("p", "x")["name"] == "Y" and api.delete_edge("p", "e") and api.delete_node("p", "x")
    assert api.update_embeddings("p")["updated"] == 5 and api.initialize_semantic_search()["enabled"]
    assert api.semantic_search("Boat Carries parcels over the water", "p").first().node_id == "a.boat.Boat"
    hit = api.semantic_search("Boat Carries parcels over the water", "p", include_relationships=True).where("node_id = 'a.boat.Boat'").first()
    assert " | Related: " in hit.content and "run (method)" in hit.content
    assert api.get_similar_code("p", "a.boat.Boat.run").count() >= 1
    assert api.list_projects(True).first().entity_count >= 5 and api.find_nodes_by_annotation("p", "nope").count() == 0
    assert api.analyze_testing_annotations("p", coverage=True)["summary"].first().total_test_entities == 0
    assert api.find_deprecated_code("p").count() == api.find_usage_of_deprecated_code("p").count() == api.get_framework_usage("p").count() == api.get_annotation_usage("p").count() == 0
    assert api.calculate_package_metrics("p").count() == 0 and api.find_untestable_code("p").count() == 0
    assert api.add_file("p", "a/boat.py", "class Ship: pass\n").count() == 0 and api.get_node("p", "a.boat.Boat") is None
    with pytest.raises(ValueError):
        api.scan_dir(ScanConfig(str(tmp_path / "cache"), "none"))


def test_remote_scan(spark, tmp_path, root):
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=n", "-c", "user.email=e@x", "commit", "-q", "-m", "m"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    store = GraphStore(spark, f"file://{tmp_path}/store")
    store.initialize()
    api = GraphApi(store, cache=git.Cache(str(tmp_path / "cache")))
    out = api.scan_remote_repo("https://github.com/o/r", source=f"file://{root}")
    assert out["project_id"] == "o-r" and out["score"] == 100 and api.git_cache_stats()["entries"] == 1 and api.clear_git_cache() == 1
    with pytest.raises(RuntimeError):
        api.semantic_search("x")


def test_command_line(spark, tmp_path, root, capsys):
    where = f"file://{tmp_path}/store"
    assert main(["validate", str(root)]) == 0
    assert main(["scan", where, str(root), "--project", "p", "--analyze", "--output", str(tmp_path / "report.txt")]) == 0
    assert "Scan report" in (tmp_path / "report.txt").read_text() and GraphStore(spark, where).table("nodes", "p").count() > 5
    assert main(["clear", where, "--project", "p"]) == 0 and GraphStore(spark, where).table("nodes", "p").count() == 0
