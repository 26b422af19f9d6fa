"""Queries of the general problems 2 and 4 over the graph tables, with SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import hierarchy, skew
from weftgraph.sources.tables import table


def hierarchy_links(edges: DataFrame) -> DataFrame:
    """``project_id, hierarchy, child, parent`` of contains, belongs_to and extends; the type is read without case."""
    t = F.lower(F.trim("type"))
    down = t == "contains"
    return edges.where(t.isin("contains", "belongs_to", "extends")).select(
        "project_id",
        F.when(t == "extends", "extends").otherwise("containment").alias("hierarchy"),
        F.when(down, F.col("target")).otherwise(F.col("source")).alias("child"),
        F.when(down, F.col("source")).otherwise(F.col("target")).alias("parent"),
    )


def _ungroup(df: DataFrame) -> DataFrame:
    part = F.split("grp", "\x1e")
    return df.withColumns({"project_id": part[0], "hierarchy": part[1]}).drop("grp")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on a directed cycle of one hierarchy of one project."""
    links = hierarchy_links(table(spark, d, "code_edges"))
    return _ungroup(hierarchy.cycle_nodes(links, ["project_id", "hierarchy"])).select("project_id", "hierarchy", F.col("node").alias("node_id"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, state and number of descendants of every node of both hierarchies."""
    links = hierarchy_links(table(spark, d, "code_edges"))
    solved = hierarchy.written(hierarchy.resolve(links, ["project_id", "hierarchy"]), "resolved")
    n = hierarchy.descendant_counts(solved, hierarchy.more_links(links, ["project_id", "hierarchy"]))
    return _ungroup(solved.join(n, ["grp", "node"])).select("project_id", "hierarchy", F.col("node").alias("node_id"), "root", "depth", F.translate("path", hierarchy.SEP, ">").alias("path"), "state", "n_descendants")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor-descendant pair with its distance."""
    links = hierarchy_links(table(spark, d, "code_edges"))
    solved = hierarchy.written(hierarchy.resolve(links, ["project_id", "hierarchy"]), "resolved")
    return _ungroup(hierarchy.descendants(solved, hierarchy.more_links(links, ["project_id", "hierarchy"]))).select("project_id", "hierarchy", "ancestor", "descendant", "distance")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    e = skew.key_shares(table(spark, d, "code_edges").select("target"), "target")
    n = skew.key_shares(table(spark, d, "code_nodes").select("project_id"), "project_id")
    return e.select(F.lit("edge_target").alias("field"), "key", "n_rows", "share", "hot").unionByName(n.select(F.lit("node_project").alias("field"), "key", "n_rows", "share", "hot"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets with at least 3 % of the edges that have one, and projects with at least 3 % of the nodes."""
    return _keys(spark, d).where("hot").select("field", "key")


def p4_target_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per target: edges, distinct sources and first and last scan, without an imbalance from hot targets."""
    e = table(spark, d, "code_edges").select("target", "source", "scanned_at", F.col("attributes.line_number").alias("line"))
    stats = skew.key_shares(e, "target", {"first_scan": F.min("scanned_at"), "last_scan": F.max("scanned_at"), "sum_line": F.sum("line"), "n_lines": F.count("line")})
    return stats.join(skew.distinct_per_key(e, "target", "source"), "key").select(F.col("key").alias("target"), "n_rows", F.col("n_distinct").alias("n_sources"), "first_scan", "last_scan", "sum_line", "n_lines", F.round("share", 9).alias("share"), "hot")


def p4_project_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per project: nodes, distinct ids and summed length, without an imbalance from hot projects."""
    n = table(spark, d, "code_nodes").select("project_id", "id", (F.col("end_line") - F.col("start_line") + 1).alias("size"))
    stats = skew.key_shares(n, "project_id", {"sum_lines": F.sum("size")})
    return stats.join(skew.distinct_per_key(n, "project_id", "id"), "key").select(F.col("key").alias("project_id"), "n_rows", F.col("n_distinct").alias("n_ids"), "sum_lines", F.round("share", 9).alias("share"), "hot")


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p4_found, p4_target_stats, p4_project_stats)}

_LINKS = """l AS (SELECT DISTINCT project_id, CASE WHEN lower(type) = 'extends' THEN 'extends' ELSE 'containment' END AS hierarchy,
  CASE WHEN lower(type) = 'contains' THEN target ELSE source END AS child, CASE WHEN lower(type) = 'contains' THEN source ELSE target END AS parent
  FROM code_edges WHERE lower(type) IN ('contains', 'belongs_to', 'extends') AND source IS NOT NULL AND target IS NOT NULL)"""
_UP = f"""WITH RECURSIVE {_LINKS}, up AS (SELECT project_id, hierarchy, child AS node_id, parent AS anc FROM l
  UNION SELECT u.project_id, u.hierarchy, u.node_id, l.parent FROM up u JOIN l ON l.project_id = u.project_id AND l.hierarchy = u.hierarchy AND l.child = u.anc)"""
_TREE = f"""WITH RECURSIVE {_LINKS}, roots AS (SELECT DISTINCT project_id, hierarchy, parent AS node FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.project_id = l.project_id AND k.hierarchy = l.hierarchy AND k.child = l.parent)),
 t AS (SELECT project_id, hierarchy, node, node AS root, CAST(0 AS BIGINT) AS depth, node AS path, [node] AS nodes FROM roots
  UNION ALL SELECT t.project_id, t.hierarchy, l.child, t.root, t.depth + 1, t.path || '>' || l.child, list_append(t.nodes, l.child) FROM t JOIN l ON l.project_id = t.project_id AND l.hierarchy = t.hierarchy AND l.parent = t.node)"""

ORACLE = {
    "p2_found": f"{_UP} SELECT project_id, hierarchy, node_id FROM up WHERE node_id = anc",
    "p2_hierarchy": f"""{_TREE}, a AS (SELECT project_id, hierarchy, unnest(nodes) AS node, node AS me FROM t), c AS (SELECT project_id, hierarchy, node, count(*) - 1 AS n FROM a GROUP BY ALL),
 up AS (SELECT project_id, hierarchy, child AS node, parent AS anc FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.project_id = l.project_id AND t.hierarchy = l.hierarchy AND t.node = l.child)
  UNION SELECT u.project_id, u.hierarchy, u.node, l.parent FROM up u JOIN l ON l.project_id = u.project_id AND l.hierarchy = u.hierarchy AND l.child = u.anc),
 y AS (SELECT DISTINCT project_id, hierarchy, node, max(node = anc) OVER (PARTITION BY project_id, hierarchy, node) AS cyc FROM up)
 SELECT project_id, hierarchy, node AS node_id, root, depth, path, 'tree' AS state, n AS n_descendants FROM t JOIN c USING (project_id, hierarchy, node)
 UNION ALL SELECT project_id, hierarchy, node, NULL, NULL, NULL, CASE WHEN cyc THEN 'cycle' ELSE 'below_cycle' END, 0 FROM y""",
    "p2_descendants": f"{_TREE} SELECT project_id, hierarchy, unnest(nodes[:-2]) AS ancestor, node AS descendant, depth - unnest(range(depth)) AS distance FROM t WHERE depth > 0",
    "p4_found": """SELECT 'edge_target' AS field, target AS key FROM code_edges WHERE target IS NOT NULL GROUP BY target HAVING count(*) >= 0.03 * (SELECT count(target) FROM code_edges)
 UNION ALL SELECT 'node_project', project_id FROM code_nodes WHERE project_id IS NOT NULL GROUP BY project_id HAVING count(*) >= 0.03 * (SELECT count(project_id) FROM code_nodes)""",
    "p4_target_stats": """SELECT target, count(*) AS n_rows, count(DISTINCT source) AS n_sources, min(scanned_at) AS first_scan, max(scanned_at) AS last_scan, CAST(sum(attributes.line_number) AS BIGINT) AS sum_line, count(attributes.line_number) AS n_lines,
 round(count(*)::DOUBLE / (SELECT count(target) FROM code_edges), 9) AS share, count(*) >= 0.03 * (SELECT count(target) FROM code_edges) AS hot FROM code_edges WHERE target IS NOT NULL GROUP BY target""",
    "p4_project_stats": """SELECT project_id, count(*) AS n_rows, count(DISTINCT id) AS n_ids, CAST(sum(end_line - start_line + 1) AS BIGINT) AS sum_lines, round(count(*)::DOUBLE / (SELECT count(project_id) FROM code_nodes), 9) AS share,
 count(*) >= 0.03 * (SELECT count(project_id) FROM code_nodes) AS hot FROM code_nodes WHERE project_id IS NOT NULL GROUP BY project_id""",
}
