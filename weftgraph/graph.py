"""The graph as two DataFrames, and how it's loaded.

Nodes are one row per (project_id, id) and edges one row per id, project, type and ends (an id has one of each, so this is
one per id; stated this way, filters on them reach the scan): of repeated rows the first scanned counts. Types are lower case. Links repeated under several ids stay, since the edge set is a multigraph: plain counts count links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.session import written
from weftgraph.sources.tables import table

NODE_TYPES = ("class", "interface", "enum", "exception", "function", "method", "field", "package", "module")
EDGE_KEY = ["project_id", "type", "source", "target", "id"]
EDGE_TYPES = ("calls", "implements", "extends", "contains", "references", "throws", "belongs_to")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the first in ``order`` (nulls first; further ties by Spark's row order).

    A group limit runs before the shuffle, so each task sends at most one row of a key.
    """
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


@dataclass(frozen=True)
class Graph:
    """``nodes`` and ``edges``; every operator takes both, or one of them, of one or of all projects."""

    nodes: DataFrame
    edges: DataFrame
    clean: bool = False

    def once(self) -> Graph:
        """The same graph with what measures need of it written to the shared folder: rows are made unique once, not per measure."""
        if self.clean:
            return self
        nodes = self.nodes.select("project_id", "id", "type", "name", "qualified_name", "modifiers")
        return Graph(written(nodes, "nodes"), written(self.edges.select(*EDGE_KEY), "edges"), True)

    def project(self, project_id: str | None) -> Graph:
        """The graph of one project (pushed down to the scans), or all of it."""
        if project_id is None:
            return self
        return Graph(self.nodes.where(F.col("project_id") == project_id), self.edges.where(F.col("project_id") == project_id), self.clean)

    def typed(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types))

    def links(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))


def load(spark: SparkSession, folder: str) -> Graph:
    """The graph of a folder with ``code_nodes`` and ``code_edges``."""
    n = table(spark, folder, "code_nodes").withColumn("type", F.lower("type"))
    e = table(spark, folder, "code_edges").withColumn("type", F.lower("type"))
    return Graph(first_wins(n, ["project_id", "id"], ["scanned_at"]), first_wins(e, EDGE_KEY, ["scanned_at"]))


def symmetric(edges: DataFrame) -> DataFrame:
    """``project_id, a, b``: each edge in both directions, a loop once."""
    e = edges.select("project_id", F.col("source").alias("a"), F.col("target").alias("b"))
    return e.unionByName(e.where("a <> b").select("project_id", F.col("b").alias("a"), F.col("a").alias("b")))


def ends(nodes: DataFrame, prefix: str, *cols: str) -> DataFrame:
    """Nodes to join to an edge's end: ``project_id, <prefix>`` (the id) and ``<prefix>_<col>``."""
    return nodes.select("project_id", F.col("id").alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def resolved(edges: DataFrame, nodes: DataFrame, *cols: str) -> DataFrame:
    """Edges whose ends are both nodes of their project, with ``source_<col>`` and ``target_<col>``."""
    return edges.join(ends(nodes, "source", *cols), ["project_id", "source"]).join(ends(nodes, "target", *cols), ["project_id", "target"])


def inner_edges(g: Graph) -> DataFrame:
    """Edges whose ends are both nodes of their project: what a graph store would hold of them."""
    return resolved(g.edges, g.nodes)
