"""Lookups: filters, text search and ordered, bounded lists of nodes and edges.

Orders put nulls last when ascending, as the query language of the domain does, and end in the id, so that limits are
deterministic. ``project`` None means all projects.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, ends, resolved

LIST_LIMIT, SEARCH_LIMIT = 1000, 100


def _sorted(df: DataFrame, *cols: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def _in(df: DataFrame, project: str | Column | None) -> DataFrame:
    return df if project is None else df.where(F.col("project_id") == project)


def nodes_by_type(g: Graph, node_type: str, project: str | None = None) -> DataFrame:
    """Nodes of a type, by name; across projects by project and name."""
    df = _in(g.nodes, project).where(F.col("type") == node_type.lower())
    return _sorted(df, *(["project_id"] if project is None else []), "name", "id")


def nodes_by_name(g: Graph, part: str, project: str | None = None) -> DataFrame:
    """Nodes whose name contains ``part``, case-sensitively."""
    return _sorted(_in(g.nodes, project).where(F.contains("name", F.lit(part))), "name", "project_id", "id")


def nodes_by_qualified_name(g: Graph, name: str | Column, project: str | None = None) -> DataFrame:
    return _in(g.nodes, project).where(F.col("qualified_name") == name)


def node(g: Graph, node_id: str, project: str) -> DataFrame:
    """The node of a key: one row or none."""
    return g.project(project).nodes.where(F.col("id") == node_id)


def search_nodes(g: Graph, term: str, project: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Nodes whose name, qualified name or description contains ``term``; a null description doesn't match."""
    t = F.lit(term)
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(c, t), F.lit(False)) for c in ("name", "qualified_name", "description")])
    return _sorted(_in(g.nodes, project).where(hit), *(["project_id"] if project is None else []), "name", "id").limit(limit)


def all_nodes(g: Graph, project: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    return _sorted(_in(g.nodes, project), *(["project_id"] if project is None else []), "type", "name", "id").limit(limit)


def edges_by_type(g: Graph, edge_type: str, project: str | None = None) -> DataFrame:
    """Edges of a type whose ends are both nodes, by project."""
    return _sorted(resolved(_in(g.links(edge_type.lower()), project), _in(g.nodes, project)), "project_id", "id")


def edges_by_source(g: Graph, source: str | Column, project: str | Column | None = None) -> DataFrame:
    return resolved(_in(g.edges, project).where(F.col("source") == source), _in(g.nodes, project))


def edges_by_target(g: Graph, target: str | Column, project: str | Column | None = None) -> DataFrame:
    return resolved(_in(g.edges, project).where(F.col("target") == target), _in(g.nodes, project))


def edges_between(g: Graph, source: str | Column, target: str | Column, project: str | Column | None = None) -> DataFrame:
    return resolved(_in(g.edges, project).where((F.col("source") == source) & (F.col("target") == target)), _in(g.nodes, project))


def all_edges(g: Graph, project: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    return _sorted(resolved(_in(g.edges, project), _in(g.nodes, project)), "project_id", "type", "id").limit(limit)


def annotation_predicate(name: str | None = None, framework: str | None = None, category: str | None = None):
    """A predicate on one annotation that holds where all given parts do."""

    def holds(a: Column) -> Column:
        given = [(a["name"], name), (a["framework"], framework), (a["category"], category)]
        return reduce(and_, [c == v for c, v in given if v is not None], F.lit(True))

    return holds


def nodes_by_annotation(g: Graph, name: str, framework: str | None = None, category: str | None = None, node_type: str | None = None) -> DataFrame:
    """Nodes with one annotation that meets all conditions; ``matched`` is the first that does."""
    df = g.nodes if node_type is None else g.typed(node_type)
    df = df.where(F.exists("annotations", annotation_predicate(name, framework, category)))
    return _sorted(df.withColumn("matched", F.get(F.filter("annotations", annotation_predicate(name, framework, category)), F.lit(0))), "qualified_name", "project_id", "id")


def class_names(g: Graph, wanted: DataFrame) -> DataFrame:
    """``project_id, id`` with ``name``, 'Unknown' where there's no such node."""
    return wanted.join(g.nodes.select("project_id", "id", "name"), ["project_id", "id"], "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))


def classes_calling_method(g: Graph, method: str | Column, project: str | None = None) -> DataFrame:
    """Distinct classes that contain a method that calls a method of the name."""
    g = g.project(project)
    called = ends(g.typed("method").where(F.col("name") == method), "target")
    calls = g.links("calls").join(called, ["project_id", "target"]).select("project_id", F.col("source").alias("target")).distinct()
    holders = g.links("contains").join(calls, ["project_id", "target"]).join(ends(g.typed("class"), "source", "name"), ["project_id", "source"])
    return holders.select("project_id", F.col("source_name").alias("class_name")).distinct()


def implementers(g: Graph, interface: str | Column, project: str | None = None, interface_types: tuple[str, ...] = ("interface",)) -> DataFrame:
    """Nodes that implement an interface of the name, once for each link."""
    g = g.project(project)
    target = ends(g.nodes.where(F.col("type").isin(*interface_types) & (F.col("name") == interface)), "target", "name")
    return g.links("implements").join(target, ["project_id", "target"]).join(ends(g.nodes, "source", "name"), ["project_id", "source"]).select("project_id", F.col("source_name").alias("class_name"), F.col("target_name").alias("interface_name"))


def cross_project_links(g: Graph) -> DataFrame:
    """Edges whose source is a node of the edge's project and whose target is a node of other projects only by its id.

    ``project_id, target_project, source, target, type``. Both ends are looked up by id; a target that also exists in the
    edge's own project is no cross-project link.
    """
    own = g.nodes.select("project_id", F.col("id").alias("target"))
    out = g.edges.where("target is not null").join(ends(g.nodes, "source"), ["project_id", "source"]).join(own, ["project_id", "target"], "left_anti")
    other = g.nodes.select(F.col("project_id").alias("target_project"), F.col("id").alias("target"))
    return out.join(other, "target").where("target_project <> project_id").select("project_id", "target_project", "source", "target", "type")
