"""A store of graphs: Parquet tables partitioned by project, with inserts, updates and deletes as copy-on-write.

A table is a folder of versions with a pointer file; a write makes the next version of the projects it touches and
moves the pointer, so readers never see half a write and a lost executor costs a retried task only. Other projects'
partitions are taken over by name.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.extract.entities import EXTRACTED, errors_of, graph_of
from weftgraph.extract.entities import rows as extract_rows
from weftgraph.graph import EDGE_TYPES, NODE_TYPES, Graph, ends
from weftgraph.operators.traverse import resolve_implements
from weftgraph.session import written
from weftgraph.sources.tree import ScanConfig, source_files

_ANN = "array<struct<name: string, type: string, source_line: bigint, framework: string, category: string, parameters: array<struct<name: string, value: string, type: string>>>>"
SCHEMAS = {
    "nodes": f"id string, type string, name string, qualified_name string, source_file string, description string, start_line bigint, end_line bigint, modifiers array<string>, annotations {_ANN}, attributes_json string, project_id string",
    "edges": "id string, type string, source string, target string, source_file string, attributes_json string, project_id string",
    "projects": "name string, description string, created_at timestamp, updated_at timestamp, project_id string",
    "extracted": EXTRACTED,
    "embeddings": "node_id string, semantic_embedding array<float>, model string, version string, created_at timestamp, project_id string",
}
KEYS = {"nodes": ["project_id", "id"], "edges": ["project_id", "id"], "extracted": ["project_id", "source_file", "kind", "seq"], "projects": ["project_id"], "embeddings": ["project_id", "node_id"]}


class NotFound(LookupError):
    """There's no such row."""


class Conflict(ValueError):
    """The key is taken, or an end of a link is missing."""


class GraphStore:
    """Tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    # --- session and files

    def _fs(self, path: str):
        return self._fs_path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str | None:
        p = self._fs_path(path)
        fs = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        part = f"{path}.{uuid.uuid4().hex}"
        fs = self._fs(path)
        out = fs.create(self._fs_path(part), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not fs.rename(self._fs_path(part), self._fs_path(path)):
            fs.delete(self._fs_path(path), False)
            fs.rename(self._fs_path(part), self._fs_path(path))

    def healthy(self) -> bool:
        """Whether the session answers."""
        try:
            return self.spark.range(1).count() == 1
        except Exception:
            return False

    def query(self, sql: str, **params: object) -> DataFrame:
        """SQL with named parameters over the views nodes, edges, projects, embeddings."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=params)

    def initialize(self) -> None:
        """Make what tables are missing."""
        for name in SCHEMAS:
            if self._read_text(f"{self.folder}/{name}/pointer.json") is None:
                self._write_text(f"{self.folder}/{name}/pointer.json", "{}")

    def check_unique(self, name: str) -> None:
        """Raise if a key occurs twice."""
        twice = self.table(name).groupBy(*KEYS[name]).agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).collect()
        if twice:
            raise Conflict(f"{name}: key {tuple(twice[0])[:-1]} occurs more than once")

    # --- tables: project -> folder of its current version

    def _pointer(self, name: str) -> dict[str, str]:
        return json.loads(self._read_text(f"{self.folder}/{name}/pointer.json") or "{}")

    def table(self, name: str, project: str | None = None) -> DataFrame:
        """A table, or one project's part of it: only that part's files are listed and read."""
        pointer = self._pointer(name)
        parts = sorted({v for k, v in pointer.items() if project in (None, k)})
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(T._parse_datatype_string(SCHEMAS[name])).parquet(*parts)
        return df if project is None else df.where(F.col("project_id") == project)

    def replace(self, name: str, project: str, rows: DataFrame | None) -> None:
        """Make ``rows`` the project's whole part of a table (None or no rows: none)."""
        pointer = self._pointer(name)
        if rows is not None:
            path = f"{self.folder}/{name}/{re.sub(r'[^A-Za-z0-9_-]', '_', project)}-{uuid.uuid4().hex}"
            cols = [f.name for f in T._parse_datatype_string(SCHEMAS[name]).fields]
            df = rows.select(*cols)
            if name in ("nodes", "edges"):
                df = df.sortWithinPartitions("type", "id")
            df.write.parquet(path)
            pointer[project] = path
        else:
            pointer.pop(project, None)
        self._write_text(f"{self.folder}/{name}/pointer.json", json.dumps(pointer))

    def _rewrite(self, name: str, project: str, change: Callable[[DataFrame], DataFrame]) -> None:
        self.replace(name, project, change(self.table(name, project)))

    def _one(self, name: str, project: str, key: str) -> DataFrame:
        return self.table(name, project).where(F.col(KEYS[name][-1]) == key)

    def _frame(self, name: str, rows: list[dict]) -> DataFrame:
        fields = T._parse_datatype_string(SCHEMAS[name]).fields
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], SCHEMAS[name])

    @staticmethod
    def _tidy(df: DataFrame) -> DataFrame:
        """Empty texts and lines 0 are null, modifiers and attributes never are."""
        out = {c: F.nullif(c, F.lit("")) for c in ("description", "source_file") if c in df.columns}
        out |= {c: F.nullif(c, F.lit(0).cast("bigint")) for c in ("start_line", "end_line") if c in df.columns}
        if "modifiers" in df.columns:
            out["modifiers"] = F.coalesce("modifiers", F.array().cast("array<string>"))
        out["attributes_json"] = F.coalesce("attributes_json", F.lit("{}"))
        return df.withColumns(out)

    # --- projects

    def create_project(self, project: str, name: str | None = None, description: str | None = None) -> None:
        if project in self._pointer("projects"):
            raise Conflict(f"project {project} exists")
        row = self._frame("projects", [{"project_id": project, "name": name or project, "description": description}])
        self.replace("projects", project, row.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}))

    def get_project(self, project: str) -> dict | None:
        r = self.table("projects", project).limit(1).collect()
        return r[0].asDict() if r else None

    def list_projects(self) -> DataFrame:
        """Newest first."""
        return self.table("projects").orderBy(F.desc_nulls_last("created_at"), "project_id")

    def delete_project(self, project: str) -> bool:
        """A project with its nodes, edges and embeddings; whether there was one."""
        there = project in self._pointer("projects")
        for name in SCHEMAS:
            self.replace(name, project, None)
        return there

    def clear(self, project: str | None = None) -> None:
        """Empty the graph of one project, or of all."""
        for name in ("edges", "nodes", "embeddings", "extracted"):
            for p in [project] if project is not None else list(self._pointer(name)):
                self.replace(name, p, None)

    # --- nodes

    def add_nodes(self, project: str, nodes: list[dict] | DataFrame, strict: bool = True) -> None:
        """Insert nodes; with ``strict`` a taken key is an error, else the stored node stays."""
        new = self._frame("nodes", [{**n, "project_id": project} for n in nodes]) if isinstance(nodes, list) else nodes
        new = self._tidy(new.withColumn("type", F.lower("type")))
        bad = new.where(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False)) | F.col("id").isNull()).limit(1).collect()
        if bad:
            raise Conflict(f"node {bad[0]['id']} of type {bad[0]['type']}")
        old = self.table("nodes", project)
        if strict and (not new.join(old, ["project_id", "id"], "left_semi").isEmpty() or new.groupBy("id").count().where("count > 1").limit(1).count()):
            raise Conflict("a node of that id exists")
        self.replace("nodes", project, old.unionByName(new.join(old.select("project_id", "id"), ["project_id", "id"], "left_anti")))

    def update_node(self, project: str, node_id: str, **updates: object) -> None:
        self._update("nodes", project, node_id, updates, ("id", "project_id"))

    def get_node(self, project: str, node_id: str) -> dict | None:
        r = self._one("nodes", project, node_id).limit(1).collect()
        return decoded(r[0].asDict(True)) if r else None

    def delete_node(self, project: str, node_id: str) -> bool:
        """A node and the links at it; whether there was one."""
        if self._one("nodes", project, node_id).isEmpty():
            return False
        self._rewrite("nodes", project, lambda df: df.where(F.col("id") != node_id))
        self._rewrite("extracted", project, lambda df: df.where((F.col("kind") != "node") | (F.col("id") != node_id)))
        self._rewrite("edges", project, lambda df: df.where((F.col("source") != node_id) & (F.col("target") != node_id)))
        return True

    # --- edges

    def add_edges(self, project: str, edges: list[dict] | DataFrame, strict: bool = True, dedupe: bool = True) -> DataFrame:
        """Insert links whose ends are nodes; returns those that can't be (``id, source, target``).

        An implements link without a target node goes to the interface named like the target's last part. With
        ``strict`` a link that can't be inserted is an error. With ``dedupe`` ids that are stored, or repeated, are left out.
        """
        new = self._frame("edges", [{**e, "project_id": project} for e in edges]) if isinstance(edges, list) else edges
        new = self._tidy(new.withColumn("type", F.lower("type")))
        bad = new.where(~F.coalesce(F.col("type").isin(*EDGE_TYPES, "depends_on"), F.lit(False))).limit(1).collect()
        if bad:
            raise Conflict(f"link of type {bad[0]['type']}")
        good, missing = self._linked(self.table("nodes", project), new)
        if strict and not missing.isEmpty():
            raise Conflict(f"no node for an end of link {missing.first()['id']}")
        old = self.table("edges", project)
        if dedupe:
            good = good.dropDuplicates(["project_id", "id"]).join(old.select("project_id", "id"), ["project_id", "id"], "left_anti")
        self.replace("edges", project, old.unionByName(good))
        return missing

    @staticmethod
    def _linked(nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links whose ends are nodes (implements links perhaps by the name of an interface), and ``id, source, target`` of the others."""
        ok = new.join(ends(nodes, "source"), ["project_id", "source"], "left_semi").join(ends(nodes, "target"), ["project_id", "target"], "left_semi")
        fixed = resolve_implements(Graph(nodes, new)).where("resolved is not null").select("project_id", "id", "resolved")
        more = new.join(fixed, ["project_id", "id"]).withColumn("target", F.col("resolved")).drop("resolved")
        good = ok.unionByName(more.select(*ok.columns))
        return good, new.join(good.select("project_id", "id"), ["project_id", "id"], "left_anti").select("id", "source", "target")

    def update_edge(self, project: str, edge_id: str, **updates: object) -> None:
        self._update("edges", project, edge_id, updates, ("id", "project_id", "source", "target"))

    def get_edge(self, project: str, edge_id: str) -> dict | None:
        r = self._one("edges", project, edge_id).limit(1).collect()
        return decoded(r[0].asDict(True)) if r else None

    def delete_edge(self, project: str, edge_id: str) -> bool:
        if self._one("edges", project, edge_id).isEmpty():
            return False
        self._rewrite("edges", project, lambda df: df.where(F.col("id") != edge_id))
        self._rewrite("extracted", project, lambda df: df.where((F.col("kind") != "edge") | (F.col("id") != edge_id)))
        return True

    def _update(self, name: str, project: str, key: str, updates: dict[str, object], fixed: tuple[str, ...]) -> None:
        schema = {f.name: f.dataType for f in T._parse_datatype_string(SCHEMAS[name]).fields}
        given = {k: v for k, v in updates.items() if k not in fixed}
        unknown = [k for k in given if k not in schema]
        if unknown:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        if not given:
            raise ValueError("nothing to update")
        if self._one(name, project, key).isEmpty():
            raise NotFound(f"{key} in {project}")
        hit = F.col(KEYS[name][-1]) == key
        value = lambda k, v: F.lit(v).cast(schema[k]) if not isinstance(v, list) or v else F.array().cast(schema[k])
        self._rewrite(name, project, lambda df: df.withColumns({k: F.when(hit, value(k, v)).otherwise(F.col(k)) for k, v in given.items()}))

    # --- graphs, embeddings, scans

    def graph(self, project: str | None = None) -> Graph:
        """The stored graph, with attributes decoded."""
        n = self.table("nodes", project).withColumn("attributes", F.from_json("attributes_json", ATTRIBUTES))
        e = self.table("edges", project).withColumn("attributes", F.from_json("attributes_json", "line_number bigint, call_type string, arguments array<string>"))
        return Graph(n, e)

    def add_embeddings(self, project: str, rows: DataFrame, version: str = "1.0") -> DataFrame:
        """Set vectors (``node_id, semantic_embedding, model``) of existing nodes; returns the ids without a node."""
        new = rows.select(F.lit(project).alias("project_id"), "node_id", "semantic_embedding", "model", F.lit(version).alias("version"), F.current_timestamp().alias("created_at")).where("semantic_embedding is not null")
        have = self.table("nodes", project).select(F.col("id").alias("node_id"))
        missing = new.join(have, "node_id", "left_anti").select("node_id")
        good = new.join(have, "node_id", "left_semi")
        old = self.table("embeddings", project).join(good.select("node_id"), "node_id", "left_anti")
        self.replace("embeddings", project, old.unionByName(good))
        return missing

    def put_graph(self, project: str, g: Graph) -> DataFrame:
        """Add a graph to a project, the first of each key staying; returns links that miss an end."""
        n = g.nodes.withColumn("attributes_json", F.to_json("attributes", {"ignoreNullFields": "false"})).drop("attributes")
        self.add_nodes(project, n.select(*[f.name for f in T._parse_datatype_string(SCHEMAS["nodes"]).fields]), strict=False)
        e = g.edges.withColumn("attributes_json", F.to_json("attributes", {"ignoreNullFields": "false"})).drop("attributes")
        return self.add_edges(project, e.select(*[f.name for f in T._parse_datatype_string(SCHEMAS["edges"]).fields]), strict=False)

    def scan(self, config: ScanConfig, clear: bool = False) -> dict[str, object]:
        """Scan a tree into the store; counts of files, nodes, links, links that miss an end, and errors."""
        if config.project_id not in self._pointer("projects"):
            self.create_project(config.project_id, config.project_name)
        if clear:
            self.clear(config.project_id)
        files = source_files(self.spark, config)
        new = written(extract_rows(files, config.extended), "extracted")
        missing = self._index(config.project_id, files.select("source_file").distinct(), new)
        g = graph_of(new)
        return {"files": files.count(), "nodes": g.nodes.count(), "edges": g.edges.count(), "missing_ends": missing.count(), "errors": errors_of(new)}

    def add_files(self, project: str, files: DataFrame, clear_existing: bool = True) -> DataFrame:
        """Parse single files (``project_id, source_file, text``) again; what they gave before is replaced. Returns the errors.

        Whatever the order in which files come, the graph is that of a scan of all of them: what each file gave is kept in
        the table ``extracted``, links that miss an end included, and nodes and links are made from all of it anew.
        """
        if project not in self._pointer("projects"):
            self.create_project(project)
        new = written(extract_rows(files), "extracted")
        self._index(project, files.select("source_file").distinct() if clear_existing else files.select("source_file").limit(0), new)
        return errors_of(new)

    def _index(self, project: str, paths: DataFrame, new: DataFrame) -> DataFrame:
        """Put extracted rows in place of those of ``paths``; returns the links that miss an end.

        Nodes and links that no file gave stay, as do changes to those of other files.
        """
        old = self.table("extracted", project)
        gone = {k: old.where(F.col("kind") == k).select("id").distinct() for k in ("node", "edge")}
        self.replace("extracted", project, old.join(paths, "source_file", "left_anti").unionByName(new).dropDuplicates(KEYS["extracted"]))
        g = graph_of(self.table("extracted", project))
        flat = lambda df, name: self._tidy(df.withColumn("attributes_json", F.to_json("attributes", {"ignoreNullFields": "false"})).withColumn("type", F.lower("type"))).select(*[f.name for f in T._parse_datatype_string(SCHEMAS[name]).fields])

        def merged(name: str, made: DataFrame, had: DataFrame, same: list[str]) -> DataFrame:
            kept = self.table(name, project).join(paths, "source_file", "left_anti").join(made.select(*same), same, "left_semi")
            own = self.table(name, project).join(had, "id", "left_anti").join(made.select("id"), "id", "left_anti")
            return made.join(kept.select("id"), "id", "left_anti").unionByName(kept).unionByName(own)

        nodes = merged("nodes", flat(g.nodes, "nodes"), gone["node"], ["id", "source_file"])
        self.replace("nodes", project, nodes)
        nodes = self.table("nodes", project)
        good, missing = self._linked(nodes, flat(g.edges, "edges"))
        edges = merged("edges", good, gone["edge"], ["id", "source_file", "source", "target"])
        edges = edges.join(ends(nodes, "source"), ["project_id", "source"], "left_semi").join(ends(nodes, "target"), ["project_id", "target"], "left_semi")
        missing = written(missing, "missing")
        self.replace("edges", project, edges)
        return missing


ATTRIBUTES = "parameters array<struct<name string, type string, description string>>, return_type string, implements array<string>, extends string"


def decoded(row: dict) -> dict:
    """A row with its attributes decoded; modifiers default to none."""
    row["attributes"] = json.loads(row.pop("attributes_json") or "{}")
    if "modifiers" in row:
        row["modifiers"] = row["modifiers"] or []
    return row


def plain_json(value: Column) -> Column:
    """Maps and structs as JSON text."""
    return F.to_json(value)


__all__ = ["GraphStore", "NotFound", "Conflict", "decoded", "extract_rows", "plain_json"]
