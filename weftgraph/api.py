"""One object with every tool of the domain, over a store: edits, lookups, metrics, annotations, search and scans.

Tools return DataFrames, rows as dictionaries, or plain values; lists are pages within a token budget where the domain
pages them. Errors are exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import annotations, lookup, metrics, paging, projects, semantic, traverse
from weftgraph.sources import git
from weftgraph.sources.detect import detect_tree
from weftgraph.sources.tree import ScanConfig
from weftgraph.store import GraphStore


class GraphApi:
    """Tools over ``store``; ``provider`` embeds texts (None disables semantic search), ``cache`` keeps clones."""

    def __init__(self, store: GraphStore, provider: semantic.Provider | None = None, config: semantic.EmbeddingConfig = semantic.EmbeddingConfig(), cache: git.Cache | None = None) -> None:
        self.store, self.provider, self.config, self.cache = store, provider, config, cache

    def _graph(self, project: str | None) -> Graph:
        return self.store.graph(project)

    @staticmethod
    def _page(df: DataFrame, order: list[str], offset: int, limit: int | None) -> tuple[DataFrame, dict[str, object]]:
        return paging.paginate(df, order, offset, limit, paging.token_budget())

    # --- nodes and edges

    def add_node(self, project: str, **node: object) -> None:
        self.store.add_nodes(project, [node])

    def update_node(self, project: str, node_id: str, **updates: object) -> None:
        self.store.update_node(project, node_id, **updates)

    def get_node(self, project: str, node_id: str) -> dict | None:
        return self.store.get_node(project, node_id)

    def delete_node(self, project: str, node_id: str) -> bool:
        return self.store.delete_node(project, node_id)

    def find_nodes_by_type(self, project: str | None, node_type: str, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, dict[str, object]]:
        return self._page(lookup.nodes_by_type(self._graph(project), node_type, project), ["name", "project_id", "id"], offset, limit)

    def search_nodes(self, project: str | None, term: str, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, dict[str, object]]:
        return self._page(lookup.search_nodes(self._graph(project), term, project), ["name", "project_id", "id"], offset, limit)

    def add_edge(self, project: str, **edge: object) -> None:
        self.store.add_edges(project, [edge])

    def get_edge(self, project: str, edge_id: str) -> dict | None:
        return self.store.get_edge(project, edge_id)

    def delete_edge(self, project: str, edge_id: str) -> bool:
        return self.store.delete_edge(project, edge_id)

    def find_edges_by_source(self, project: str, source: str) -> DataFrame:
        return lookup.edges_by_source(self._graph(project), source, project)

    # --- relations

    def find_classes_calling_method(self, project: str | None, method: str) -> DataFrame:
        return lookup.classes_calling_method(self._graph(project), method, project).orderBy("class_name", "project_id")

    def find_classes_implementing_interface(self, project: str | None, interface: str) -> DataFrame:
        return lookup.implementers(self._graph(project), interface, project).orderBy("class_name", "project_id")

    def get_inheritance_hierarchy(self, project: str, class_name: str) -> list[str]:
        """Names from the class to its furthest ancestor; empty without ancestors (ties of names: the smallest id)."""
        g = self._graph(project)
        own = g.typed("class").where(F.col("name") == class_name).select("project_id", "id")
        r = traverse.inheritance_lines(g).join(own, ["project_id", "id"]).orderBy("id").limit(1).collect()
        return r[0]["path"].split(">") if r else []

    # --- metrics

    def calculate_ck_metrics(self, project: str | None, class_id: str | None = None, lift: bool = False) -> DataFrame:
        m = metrics.ck_metrics(self._graph(project), lift)
        m = m if class_id is None else m.where(F.col("id") == class_id)
        return m.join(metrics.assess_ck(m), metrics.KEY)

    def calculate_package_metrics(self, project: str | None, package: str | None = None) -> DataFrame:
        m = metrics.package_metrics(self._graph(project))
        m = m if package is None else m.where(F.col("package") == package)
        return m.join(metrics.assess_packages(m), ["project_id", "package"])

    def find_architectural_issues(self, project: str | None = None, lift: bool = False) -> DataFrame:
        return metrics.issues(self._graph(project), lift)

    def get_project_summary(self, project: str | None = None, lift: bool = False) -> DataFrame:
        return metrics.summary(self._graph(project), lift)

    # --- annotations

    def find_nodes_by_annotation(self, project: str | None, name: str, framework: str | None = None, category: str | None = None, node_type: str | None = None) -> DataFrame:
        return lookup.nodes_by_annotation(self._graph(project), name, framework, category, node_type)

    def get_framework_usage(self, project: str | None = None, min_usage: int = 1) -> DataFrame:
        return annotations.framework_usage(self._graph(project), min_usage).orderBy(F.desc("total_usage"), "framework", F.desc("usage_count"), "name")

    def get_annotation_usage(self, project: str | None = None, by: str = "annotation", category: str | None = None, framework: str | None = None, include_deprecated: bool = True) -> DataFrame:
        return annotations.annotation_usage(self._graph(project), by, category, framework, include_deprecated).orderBy(F.desc("usage_count"), "name")

    def find_deprecated_code(self, project: str | None = None, node_type: str | None = None) -> DataFrame:
        return annotations.deprecated_code(self._graph(project), node_type).orderBy(F.desc("dependency_count"), "qualified_name")

    def find_usage_of_deprecated_code(self, project: str | None = None) -> DataFrame:
        return annotations.deprecated_usage(self._graph(project)).orderBy(F.desc("usage_count"), "deprecated_node")

    def analyze_testing_annotations(self, project: str | None = None, framework: str | None = None, coverage: bool = False) -> dict[str, DataFrame | None]:
        g = self._graph(project)
        return {"entities": annotations.testing_entities(g, framework).orderBy(F.desc("annotation_count"), "qualified_name"), "frameworks": annotations.testing_frameworks(g), "coverage": annotations.coverage(g) if coverage else None, "summary": annotations.testing_summary(g)}

    def find_untestable_code(self, project: str | None = None) -> DataFrame:
        return annotations.untestable(self._graph(project)).orderBy(F.desc("n_methods"), "concern")

    # --- projects

    def list_projects(self, include_stats: bool = False, sort_by: str = "name", limit: int = 100) -> DataFrame:
        return projects.list_projects(self.store.table("projects"), self._graph(None) if include_stats else None, sort_by, limit)

    # --- semantic search

    def initialize_semantic_search(self) -> dict[str, object]:
        """Whether vectors can be made, and of which model. Search scans are exact, so there's no index to make."""
        return {"enabled": self.provider is not None, "model": self.config.model, "dimensions": self.config.dimensions}

    def _vector(self, text: str) -> list[float]:
        if self.provider is None:
            raise RuntimeError("semantic search is disabled")
        v = self.provider([text])[0]
        if v is None:
            raise ValueError("the query has no embedding")
        return v

    def update_embeddings(self, project: str, node_types: tuple[str, ...] = semantic.EMBEDDED_TYPES) -> dict[str, int]:
        """Embed a project's nodes again: how many worked and failed."""
        if self.provider is None:
            raise RuntimeError("semantic search is disabled")
        g = self._graph(project)
        done = semantic.embed(g.nodes.where(F.col("type").isin(*node_types)), self.provider, self.config)
        from weftgraph.session import written

        done = written(done, "embedded")
        self.store.add_embeddings(project, done)
        r = semantic.update_counts(done).first()
        return {"updated": r["updated"], "failed": r["failed"]}

    def semantic_search(self, query: str, project: str | None = None, node_types: list[str] | None = None, limit: int = 10, threshold: float | None = None, include_relationships: bool = False, max_hops: int = 2) -> DataFrame:
        g, v, q = self._graph(project), self.store.table("embeddings", project), self._vector(query)
        least = threshold or self.config.threshold
        if include_relationships:
            return semantic.hybrid_search(g, v, q, limit, least, max_hops, project)
        return semantic.search(v, q, limit, least, project, node_types, g.nodes)

    def get_similar_code(self, project: str, node_id: str, limit: int = 5) -> DataFrame:
        return semantic.similar_nodes(self.store.table("embeddings", project), node_id, project, limit, self.config.threshold)

    # --- scans

    def add_file(self, project: str, path: str, text: str, clear_existing: bool = True) -> DataFrame:
        """Parse one file into the graph; the errors."""
        f = self.store.spark.createDataFrame([(project, path, text)], "project_id string, source_file string, text string")
        return self.store.add_files(project, f, clear_existing)

    def scan_dir(self, config: ScanConfig, clear: bool = False) -> dict[str, object]:
        """Scan a tree; counts, errors and the report's text."""
        found = detect_tree(self.store.spark, config)
        if not found["valid"]:
            raise ValueError("; ".join(found["suggestions"]))  # type: ignore[arg-type]
        out = self.store.scan(config, clear)
        out["build"] = {k: found[k] for k in ("primary", "metadata", "sub_projects", "mono_repo")}
        return out | {"report": projects.report(self._graph(config.project_id), out["errors"])}  # type: ignore[operator]

    def validate_remote_repo(self, url: str) -> dict[str, object]:
        return git.validate(url)

    def scan_remote_repo(self, url: str, branch: str | None = None, project: str | None = None, progress: Callable[[int, str], None] = lambda p, w: None, source: str | None = None) -> dict[str, object]:
        """Clone and scan; the score takes 5 points off for each architectural issue."""
        name = project or git.parse(url).project_id
        folder = git.clone(url, branch, self.cache, progress=progress, source=source)
        out = self.scan_dir(ScanConfig(folder, name, project_name=name))
        n = self.find_architectural_issues(name).count()
        return out | {"project_id": name, "score": max(0, min(100, 100 - 5 * n))}

    def git_cache_stats(self) -> dict[str, object]:
        return self.cache.stats() if self.cache else {"entries": 0, "size": 0, "oldest": None, "newest": None}

    def clear_git_cache(self) -> int:
        return self.cache.clear() if self.cache else 0
