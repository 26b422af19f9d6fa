"""Semantic search over node embeddings: exact similarity, top-k, hybrid with the graph; pluggable providers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalar import cosine, embedding_text, truncated
from weftgraph.graph import Graph, first_wins
from weftgraph.operators.traverse import neighbours
from weftgraph.session import written

#: Node types that are embedded, and defaults of the configuration (fixed values).
EMBEDDED_TYPES = ("class", "interface", "method", "function", "enum")
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "nomic-embed-text": 768, "mxbai-embed-large": 1024}


@dataclass(frozen=True)
class EmbeddingConfig:
    """How texts are embedded; ``dimensions`` follow the model where it's known."""

    provider: str = "hash"
    model: str = "hash-64"
    dimensions: int = 64
    max_tokens: int = 8000
    batch_size: int = 100
    threshold: float = 0.7

    @staticmethod
    def of(provider: str, model: str, **more: object) -> EmbeddingConfig:
        return EmbeddingConfig(provider, model, **{"dimensions": DIMENSIONS.get(model, 64), **more})  # type: ignore[arg-type]


Provider = Callable[[list[str]], list[list[float] | None]]


def hash_provider(dimensions: int = 64) -> Provider:
    """A deterministic provider without any model: words hashed to signed places. For tests and dry runs."""

    def one(text: str) -> list[float] | None:
        v = np.zeros(dimensions)
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        n = float(np.sqrt(v @ v))
        return (v / n).tolist() if n else None

    return lambda texts: [one(t) for t in texts]


def contents(nodes: DataFrame) -> DataFrame:
    """``project_id, id, content`` of every node."""
    a = F.col("attributes")
    return nodes.select("project_id", "id", embedding_text(F.col("name"), F.col("qualified_name"), F.col("description"), a["parameters"], a["return_type"], F.col("annotations"), F.col("modifiers")).alias("content"))


def embed(nodes: DataFrame, provider: Provider, config: EmbeddingConfig = EmbeddingConfig()) -> DataFrame:
    """``project_id, node_id, semantic_embedding, model, ok`` of nodes of embedded types with some text.

    Batches go to the provider in Arrow-fed tasks; a failed batch or text has ``ok`` false and a null vector.
    """
    rows = contents(nodes.where(F.col("type").isin(*EMBEDDED_TYPES))).where("content <> ''")
    rows = rows.select("project_id", F.col("id").alias("node_id"), truncated(F.col("content"), config.max_tokens).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[list[float] | None] = []
            texts = b["content"].tolist()
            for i in range(0, len(texts), config.batch_size):
                part = texts[i : i + config.batch_size]
                try:
                    got += provider(part)
                except Exception:
                    got += [None] * len(part)
            yield pd.DataFrame({"project_id": b["project_id"], "node_id": b["node_id"], "semantic_embedding": got, "model": config.model, "ok": [g is not None for g in got]})

    return rows.mapInPandas(run, "project_id string, node_id string, semantic_embedding array<float>, model string, ok boolean")


def update_counts(embedded: DataFrame) -> DataFrame:
    """How many nodes were embedded and how many failed."""
    return embedded.agg(F.count_if("ok").alias("updated"), F.count_if(~F.col("ok")).alias("failed"))


def search(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.7, project: str | None = None, node_types: list[str] | None = None, nodes: DataFrame | None = None, scale: str = "normalized") -> DataFrame:
    """``project_id, node_id, similarity``: vectors at least ``threshold`` similar to the query, best first.

    ``limit`` or ``threshold`` 0 mean the defaults. Null and zero vectors and other lengths never match. One scan with a
    bounded heap per task; the query is a literal.
    """
    limit, threshold = limit or 10, threshold or 0.7
    q = F.lit([float(x) for x in query])
    v = vectors.where("semantic_embedding is not null")
    if project is not None:
        v = v.where(F.col("project_id") == project)
    if node_types:
        if nodes is None:
            raise ValueError("node types need the nodes")
        v = v.join(nodes.where(F.col("type").isin(*node_types)).select("project_id", F.col("id").alias("node_id")), ["project_id", "node_id"], "left_semi")
    hit = v.select("project_id", "node_id", cosine(F.col("semantic_embedding"), q, scale).alias("similarity")).where(F.col("similarity") >= threshold)
    return hit.orderBy(F.desc("similarity"), "project_id", "node_id").limit(limit)


def similar_nodes(vectors: DataFrame, node_id: str, project: str, limit: int = 5, threshold: float = 0.7) -> DataFrame:
    """The most similar nodes of the same project, without the node itself; an error if it has no vector."""
    row = vectors.where((F.col("project_id") == project) & (F.col("node_id") == node_id) & F.col("semantic_embedding").isNotNull()).select("semantic_embedding").first()
    if row is None:
        raise LookupError(f"no embedding of {node_id} in {project}")
    return search(vectors.where(F.col("node_id") != node_id), list(row[0]), limit, threshold, project)


def hybrid_search(g: Graph, vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.7, max_hops: int = 2, project: str | None = None) -> DataFrame:
    """:func:`search` with each hit's text and up to five related nodes within ``max_hops``, in one batched expansion."""
    hits = written(search(vectors, query, limit, threshold, project), "hits")
    seeds = hits.select("project_id", F.col("node_id").alias("id"))
    near = neighbours(g.edges, seeds, int(max_hops), 5, g.nodes).join(g.nodes.select("project_id", "id", "name", "type"), ["project_id", "id"])
    related = near.groupBy("project_id", F.col("seed").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hop", "id", "name", "type"))), lambda x: F.concat(x["name"], F.lit(" ("), x["type"], F.lit(")"))), ", ").alias("related"))
    found = hits.select("project_id", F.col("node_id").alias("id"))
    text = contents(g.nodes.join(found, ["project_id", "id"], "left_semi")).withColumnRenamed("id", "node_id")
    out = hits.join(text, ["project_id", "node_id"], "left").join(related, ["project_id", "node_id"], "left")
    return out.select("project_id", "node_id", "similarity", F.concat_ws(" | Related: ", F.coalesce("content", F.lit("")), "related").alias("content"))


def usable(vectors: DataFrame) -> DataFrame:
    """One row per vector id: the first created."""
    return first_wins(vectors, ["vec_id"], ["created_at"])
