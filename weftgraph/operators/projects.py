"""Statistics and lists of projects, and breakdowns of what a scan found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph

LANGUAGE_ORDER = ("typescript", "javascript", "java", "python", "csharp")


def stats(g: Graph) -> DataFrame:
    """``project_id, entity_count, relationship_count, entity_types, relationship_types`` (types sorted, joined by comma)."""
    n = g.nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("entity_count"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("entity_types"))
    e = g.edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("relationship_count"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("relationship_types"))
    return n.join(e, "project_id", "left").withColumns({"relationship_count": F.coalesce("relationship_count", F.lit(0)), "relationship_types": F.coalesce("relationship_types", F.lit(""))})


def list_projects(projects: DataFrame, g: Graph | None = None, sort_by: str = "name", limit: int = 100) -> DataFrame:
    """Projects with statistics (with a graph), sorted by name, created_at, updated_at or entity_count, and limited.

    One grouped join instead of a query per project. Names sort by the rules of their language (a null name is the id);
    times newest first (null is the epoch); an unknown key, or entity_count without a graph, sorts by name.
    """
    p = projects.select("project_id", "name", "created_at", "updated_at")
    if g is not None:
        zero = F.lit(0).cast("bigint")
        p = p.join(stats(g), "project_id", "left").withColumns({"entity_count": F.coalesce("entity_count", zero), "relationship_count": F.coalesce("relationship_count", zero), "entity_types": F.coalesce("entity_types", F.lit("")), "relationship_types": F.coalesce("relationship_types", F.lit(""))})
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    by_name = F.collate(F.coalesce("name", "project_id"), "UNICODE").asc()
    first = {"created_at": F.coalesce("created_at", epoch).desc(), "updated_at": F.coalesce("updated_at", epoch).desc()}
    if g is not None:
        first["entity_count"] = F.col("entity_count").desc()
    return p.orderBy(first.get(sort_by, by_name), "project_id").limit(limit)


def totals(listed: DataFrame) -> DataFrame:
    """Projects, entities and relationships of a list (take it before its limit)."""
    return listed.agg(F.count(F.lit(1)).alias("projects"), F.sum("entity_count").alias("entities"), F.sum("relationship_count").alias("relationships"))


def breakdown(g: Graph) -> DataFrame:
    """``kind, type, n``: nodes and edges by type."""
    n = g.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def largest_classes(g: Graph, limit: int = 5) -> DataFrame:
    """The classes with the most contained methods."""
    from weftgraph.operators.metrics import wmc

    c = g.typed("class").select("project_id", "id", "name").join(wmc(g), ["project_id", "id"])
    return c.orderBy(F.desc("wmc"), "project_id", "id").limit(limit)


def report(g: Graph, errors: DataFrame, top: int = 5, most_errors: int = 10) -> str:
    """The text of a scan report: counts by type, the largest classes, the first errors."""
    rows = breakdown(g).orderBy(F.desc("n"), "type").collect()  # one row a type
    lines = ["Scan report", "", "Entities:"] + [f"  {r['type']}: {r['n']}" for r in rows if r["kind"] == "node"] + ["", "Relationships:"] + [f"  {r['type']}: {r['n']}" for r in rows if r["kind"] == "edge"]
    lines += ["", "Largest classes:"] + [f"  {r['name']}: {r['wmc']} methods" for r in largest_classes(g, top).collect()]
    bad = errors.orderBy("file_path", "line").limit(most_errors).collect()
    return "\n".join(lines + (["", "Errors:"] + [f"  {r['file_path']}: {r['message']}" for r in bad] if bad else [])) + "\n"


def primary_language(files: DataFrame) -> DataFrame:
    """``project_id, language`` with the most files (``project_id, language, files``); ties go by the order of :data:`LANGUAGE_ORDER`."""
    rank = F.create_map(*[x for i, n in enumerate(LANGUAGE_ORDER) for x in (F.lit(n), F.lit(i))])
    return files.groupBy("project_id").agg(F.min_by("language", F.struct(-F.col("files"), F.coalesce(F.try_element_at(rank, F.col("language")), F.lit(len(LANGUAGE_ORDER))))).alias("language"))
