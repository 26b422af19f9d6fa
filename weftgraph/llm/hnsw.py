"""The most similar vectors of every vector (problem 7): HNSW graphs per shard, shard results merged.

0. Equal vectors of one group are indexed and asked once, by the smallest id; the others get its answer, with the ids of
   all equal ones, after the merge. Copies would otherwise fill each other's links and the beam.
1. Vectors of one group (project and length) form cells of about ``SHARD_ROWS`` vectors around centroids, which are
   fitted on a bounded sample by rounds that no task or driver sees whole. A cell that is larger still is split at random into shards of bounded size.
2. Each vector is indexed in its own cell, and asks the ``PROBES`` cells with the nearest centroids. A shard asked by
   very many vectors gets its questions in chunks of bounded size, each with a copy of the shard.
3. In each shard a hierarchical navigable small-world graph is built as flat neighbour arrays (one array of
   ``M`` links per vector and layer, ``2 M`` on the lowest) and searched by a beam, for all questions at once.
4. The shards' best are merged per question with exact cosine similarities.

Every distinct vector is indexed and asked; the work per vector is bounded, so it grows in proportion to the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.session import written

#: Vectors of a cell, on average, and at most in a shard.
SHARD_ROWS = 1_500
SHARD_MOST = 4_000
#: Questions that one task answers from a shard.
CHUNK_ROWS = 8_000
#: Cells that a vector asks.
PROBES = 4
#: Links of a vector on the upper layers (twice as many on the lowest), and width of the beam.
M = 12
BEAM = 40
#: Vectors inserted at once.
BATCH = 512
#: Vectors a group's centroids are fitted on, for each of them, rounds of the fit, and bytes of all groups' centroids together.
SAMPLE_PER_CELL = 24
ROUNDS = 6
CENTROID_BYTES = 1 << 24


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, as flat neighbour arrays.

    A vector's highest layer is drawn from its number, with a factor of ``1 / M`` from layer to layer. Vectors are inserted
    in batches: each batch searches the graph so far, layer by layer, for its candidates (and has the others of its batch),
    links them by the usual heuristic (a candidate is kept if it's nearer to the vector than to any link kept before; free
    places take the nearest left over), and is linked back, by the same heuristic where a list is full.
    """

    def __init__(self, x: np.ndarray, m: int = M, seed: int = 7, beam: int = BEAM, batch: int = BATCH) -> None:
        self.x, n = x, len(x)
        self.level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / math.log(max(m, 2))).astype(int)
        self.most = [2 * m if lv == 0 else m for lv in range(int(self.level.max(initial=0)) + 1)]
        #: Per layer, the neighbours of each vector as positions in ``x`` (-1: none).
        self.links = [np.full((n, w), -1, np.int32) for w in self.most]
        self.top, done = 0, 0
        while done < n:
            new = np.arange(done, min(n, done + batch))
            self._insert(new, done, m, beam)
            self.top = int(self.level[: new[-1] + 1].argmax())
            done = int(new[-1]) + 1

    def _insert(self, new: np.ndarray, done: int, m: int, beam: int) -> None:
        at = np.full(len(new), self.top)
        for lv in range(len(self.links) - 1, -1, -1):
            here = self.level[new] >= lv
            there = done and self.level[self.top] >= lv
            if there and not here.all():
                at[~here] = self._descend(self.x[new[~here]], at[~here], lv)
            if not here.any():
                continue
            mine = new[here]
            sim = self.x[mine] @ self.x[mine].T
            np.fill_diagonal(sim, -np.inf)
            near = np.where(sim > -np.inf, mine[None, :], -1)
            if there:
                ids, sims = self._beam(self.x[mine], at[here], lv, beam)
                at[here] = ids[np.arange(len(mine)), sims.argmax(1)]
                near, sim = np.concatenate([near, ids], 1), np.concatenate([sim, sims], 1)
            self._link(mine, near, sim, lv, m)

    def _link(self, mine: np.ndarray, near: np.ndarray, sim: np.ndarray, lv: int, m: int) -> None:
        links, most = self.links[lv], self.most[lv]
        chosen = self._choose(near, sim, m, 2 * most)
        links[mine, : chosen.shape[1]] = chosen
        src, dst = np.repeat(mine, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        known = (links[dst] == src[:, None]).any(1)  # it already chose this one
        src, dst = src[~known], dst[~known]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        who, first, count = np.unique(dst, return_index=True, return_counts=True)
        more = np.full((len(who), int(count.max())), -1)
        more[np.repeat(np.arange(len(who)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        have = links[who]
        room = most - (have >= 0).sum(1)
        fits = count <= room
        if fits.any():
            row = np.repeat(np.flatnonzero(fits), count[fits])
            place = (have >= 0).sum(1)[row] + np.concatenate([np.arange(c) for c in count[fits]])
            links[who[row], place] = more[row, np.concatenate([np.arange(c) for c in count[fits]])]
        full = np.flatnonzero(~fits)
        for a in range(0, len(full), 256):
            at = full[a : a + 256]
            cand = np.concatenate([have[at], more[at]], 1)
            near_sim = np.where(cand >= 0, np.einsum("qd,qcd->qc", self.x[who[at]], self.x[np.maximum(cand, 0)], optimize=True), -np.inf)
            kept = self._choose(cand, near_sim, most, 2 * most)
            links[who[at]] = -1
            links[who[at], : kept.shape[1]] = kept

    def _choose(self, near: np.ndarray, sim: np.ndarray, most: int, width: int) -> np.ndarray:
        """Of each row's candidates (-1: none), at most ``most``, the nearest ``width`` looked at."""
        width = min(width, near.shape[1])
        if width < near.shape[1]:
            cut = np.argpartition(-sim, width - 1, axis=1)[:, :width]
            near, sim = np.take_along_axis(near, cut, 1), np.take_along_axis(sim, cut, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        real = sim > -np.inf
        v = self.x[np.maximum(near, 0)]
        between = v @ v.transpose(0, 2, 1)
        keep = np.zeros(near.shape, bool)
        for j in range(width):
            blocked = ((between[:, j, :j] > sim[:, j, None]) & keep[:, :j]).any(1) if j else np.zeros(len(near), bool)
            keep[:, j] = ~blocked & real[:, j] & (keep.sum(1) < most)
        rank = np.argsort(np.where(keep, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(near, rank, 1), -1)

    def _descend(self, q: np.ndarray, at: np.ndarray, lv: int) -> np.ndarray:
        """Greedy steps of one layer, all questions together."""
        at = at.copy()
        best = np.einsum("qd,qd->q", q, self.x[at])
        live = np.arange(len(q))
        while len(live):
            near = self.links[lv][at[live]]
            sim = np.where(near >= 0, np.einsum("qd,qmd->qm", q[live], self.x[np.maximum(near, 0)], optimize=True), -np.inf)
            j = sim.argmax(1)
            s = sim[np.arange(len(live)), j]
            up = s > best[live]
            live, j, s = live[up], near[up, j[up]], s[up]
            at[live], best[live] = j, s
        return at

    def _beam(self, q: np.ndarray, at: np.ndarray, lv: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each question on one layer, from ``at``: positions (-1: none) and similarities."""
        n, b, links = len(self.x), len(q), self.links[lv]
        ids, sims = np.full((b, beam), -1), np.full((b, beam), -np.inf)
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = at, np.einsum("qd,qd->q", q, self.x[at]), True
        seen = np.zeros((b, n), bool)
        seen[np.arange(b), at] = True
        live = np.arange(b)
        step = 3  # beam members expanded at once
        while len(live):
            front = np.where(open_[live], sims[live], -np.inf)
            pick = np.argpartition(-front, min(step, beam) - 1, axis=1)[:, :step] if beam > step else np.tile(np.arange(beam), (len(live), 1))
            ok = np.take_along_axis(front, pick, 1) > -np.inf
            going = ok.any(1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            rows = np.arange(len(live))[:, None]
            open_[live[:, None], pick] = False
            near = np.where(ok[:, :, None], links[np.maximum(ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[live[:, None], np.maximum(near, 0)]] = -1
            near = -np.sort(-near, axis=1)
            near = near[:, : max(1, int((near >= 0).sum(1).max()))]
            seen[live[:, None], np.where(near >= 0, near, ids[live, :1])] = True
            sim = np.where(near >= 0, np.einsum("qd,qmd->qm", q[live], self.x[np.maximum(near, 0)], optimize=True), -np.inf)
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], sim], 1)
            all_open = np.concatenate([open_[live], sim > -np.inf], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = all_ids[rows, top], all_sims[rows, top], all_open[rows, top]
        return np.where(sims > -np.inf, ids, -1), sims

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of about the ``k`` nearest of each row of ``q`` (-1 where there are fewer)."""
        at = np.full(len(q), self.top)
        for lv in range(len(self.links) - 1, 0, -1):
            at = self._descend(q, at, lv)
        ids, sims = self._beam(q, at, 0, min(max(beam, k), len(self.x)))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _matrix(raw: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _usable(vectors: DataFrame, id_col: str, group_cols: list[str], vec_col: str) -> DataFrame:
    """``grp, id, raw``: one row per id, vectors as bytes of 32-bit floats; without unusable ones."""
    grp = F.concat_ws("\x1e", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group_cols], F.size(vec_col).cast("string"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            n = np.asarray(lists.value_lengths())
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # -0.0 equals 0.0
            ends = np.cumsum(n)
            wide = x.astype(np.float64)
            squares = np.add.reduceat(np.r_[wide * wide, 0.0], np.minimum(ends - n, len(wide))) if len(n) else np.zeros(0)
            ok = (n > 0) & np.isfinite(squares) & (squares > 0)
            raw = [x[e - k : e].tobytes() for e, k in zip(ends[ok], n[ok])]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(raw, pa.binary())], ["grp", "id", "raw"])

    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull())).select(grp.alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    packed = rows.mapInArrow(pack, "grp string, id bigint, raw binary")
    return packed.groupBy("grp", "id").agg(F.min("raw").alias("raw"))


def _homes(raw: pd.Series, grp: pd.Series, centroids: dict[str, np.ndarray], probes: int) -> list[list[int]]:
    """The numbers of the ``probes`` nearest centroids of each vector, nearest first; [0] in groups without centroids."""
    cells: list[list[int]] = [[0]] * len(raw)
    for g, at in grp.groupby(grp).indices.items():
        c = centroids.get(g)
        if c is not None:
            p = min(probes, len(c))
            for part in np.array_split(at, max(1, len(at) * len(c) // 20_000_000)):
                sim = _matrix(raw.iloc[part]).astype(np.float32) @ c.T
                near = np.argpartition(-sim, p - 1, axis=1)[:, :p]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
                for i, row in zip(part, near.tolist()):
                    cells[i] = row
    return cells


def _centroids(sample: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Centroids of the groups of a written sample (``grp, id, raw, cells``): spherical k-means.

    Each round assigns the sample in its tasks and sums it by cell; the driver sees the sums of the cells only.
    """
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("id", F.lit(11)), "id"))
    first = sample.withColumn("r", rank).where(F.col("r") <= F.col("cells")).select("grp", "r", "raw").toPandas()  # one row a cell
    out = {g: _matrix(part.sort_values("r")["raw"]).astype(np.float32) for g, part in first.groupby("grp")}
    sc = sample.sparkSession.sparkContext
    for _ in range(rounds if out else 0):
        shared = sc.broadcast(out)

        def add(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            for b in batches:
                home = np.array([h[0] for h in _homes(b["raw"], b["grp"], shared.value, 1)])
                for g, at in b.groupby("grp").indices.items():
                    np.add.at(total.setdefault(g, np.zeros(shared.value[g].shape)), home[at], _matrix(b["raw"].iloc[at]))
            for g, t in total.items():
                live = np.flatnonzero(np.abs(t).sum(1) > 0)
                yield pd.DataFrame({"grp": g, "cell": live, "total": [r.tolist() for r in t[live]]})

        parts = sample.select("grp", "raw").mapInPandas(add, "grp string, cell int, total array<double>")
        sums = parts.select("grp", "cell", F.posexplode("total").alias("at", "x")).groupBy("grp", "cell", "at").agg(F.sum("x").alias("x"))
        got = sums.groupBy("grp", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("total")).toPandas()
        for g, cell, t in zip(got["grp"], got["cell"], got["total"]):
            t = np.asarray(t)
            norm = math.sqrt(float(t @ t))
            if norm > 0:
                out[g][cell] = t / norm
        shared.unpersist()
    return out


def _expanded(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From the neighbours of representatives (``grp, id, neighbour, similarity, rank``) those of all vectors.

    ``members`` (``grp, rep, id``) are the vectors that have equals. ``k + 1`` of the smallest ids of each set are enough for
    every list: a vector's own ones, and its neighbours'.
    """
    few = F.row_number().over(W.partitionBy("grp", "rep").orderBy("id"))
    first = written(members.withColumn("r", few).where(F.col("r") <= k + 1).select("grp", "rep", "id"), "first")
    reps = first.select("grp", F.col("rep").alias("id")).distinct()
    others = first.select("grp", F.col("rep").alias("neighbour"), F.col("id").alias("copy"))
    spread = found.join(others, ["grp", "neighbour"], "left").select("grp", "id", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity")
    rank = F.row_number().over(W.partitionBy("grp", "id").orderBy(F.desc("similarity"), "neighbour"))
    single = spread.join(reps, ["grp", "id"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", "similarity", "rank")
    own = first.select("grp", F.col("rep").alias("id"), F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    ranked = spread.join(reps, ["grp", "id"], "left_semi").unionByName(own).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    lists = ranked.groupBy("grp", F.col("id").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("l"))
    best = members.join(lists, ["grp", "rep"]).select("id", F.slice(F.filter("l", lambda e: e["neighbour"] != F.col("id")), 1, k).alias("l"))
    copies = best.select("id", F.posexplode("l").alias("at", "e")).select("id", "e.neighbour", "e.similarity", (F.col("at") + 1).alias("rank"))
    return single.unionByName(copies)


def nearest(vectors: DataFrame, k: int, id_col: str = "vec_id", group_cols: tuple[str, ...] = ("project_id",), vec_col: str = "semantic_embedding", shard_rows: int = SHARD_ROWS, shard_most: int = SHARD_MOST, probes: int = PROBES, beam: int = BEAM, m: int = M, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``id, neighbour, similarity, rank``: about the ``k`` most similar vectors of every usable vector in its group.

    Vectors of different length never meet. Null, empty and all-zero vectors, vectors with a null, infinite or NaN
    element, and null ids are left out. Rows that repeat an id (in its group and length) count once. Ties are ordered
    by id. Extra columns are ignored; an empty table gives no rows.
    """
    usable = written(_usable(vectors, id_col, list(group_cols), vec_col), "vectors")
    sets = written(usable.groupBy("grp", "raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "sets")
    base = sets.select("grp", "id", "raw")
    several = sets.where("n > 1").select("grp", "raw", F.col("id").alias("rep"))
    sizes = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    all_bytes = base.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    per_cell = max(shard_rows, math.ceil(all_bytes / CENTROID_BYTES))
    split = sizes.where(F.col("n") > 2 * per_cell).select("grp", "n", F.ceil(F.col("n") / per_cell).cast("int").alias("cells"))
    picked = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.col("cells") * float(SAMPLE_PER_CELL) / F.col("n")) * float(1 << 30)
    centroids = _centroids(written(base.join(split, "grp").where(picked).select("grp", "id", "raw", "cells"), "sample"))  # at most CENTROID_BYTES in all
    shared = base.sparkSession.sparkContext.broadcast(centroids)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = _homes(b.column(2).to_pandas(), b.column(0).to_pandas(), shared.value, probes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cells, pa.list_(pa.int32()))], ["grp", "id", "raw", "cells"])

    asked = written(base.mapInArrow(ask, "grp string, id bigint, raw binary, cells array<int>"), "asked")
    # Shards of a cell and chunks of its questions, both of bounded size.
    homes = asked.groupBy("grp", F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    askers = asked.select("grp", F.explode("cells").alias("cell")).groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("q"))
    plan = homes.join(askers, ["grp", "cell"]).select("grp", "cell", F.ceil(F.col("n") / shard_most).cast("int").alias("shards"), F.ceil(F.col("q") / chunk_rows).cast("int").alias("chunks"))
    plan = written(plan, "shards")  # a row a cell and small group; no hint, so Spark decides by its size
    own = asked.select("grp", "id", "raw", F.col("cells")[0].alias("cell")).join(plan, ["grp", "cell"])
    index = own.select("grp", "cell", F.pmod(F.xxhash64("id", F.lit(5)), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "raw", F.lit(True).alias("indexed"))
    ask_rows = asked.select("grp", "id", "raw", F.explode("cells").alias("cell")).join(plan, ["grp", "cell"])
    questions = ask_rows.select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id", F.lit(9)), F.col("chunks")).cast("int").alias("chunk"), "id", "raw", F.lit(False).alias("indexed"))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        there = pdf["indexed"].to_numpy(bool)
        own, ask = pdf[there], pdf[~there]
        if not len(own) or not len(ask):
            return pd.DataFrame({"grp": [], "id": [], "neighbour": [], "similarity": []})
        own = own.sort_values("id")
        ids, x = own["id"].to_numpy(), _matrix(own["raw"])
        graph = Graph(x.astype(np.float32), m, beam=beam)
        q, qid = _matrix(ask["raw"]), ask["id"].to_numpy()
        out = []
        for a in range(0, len(q), 1024):
            near, _ = graph.search(q[a : a + 1024].astype(np.float32), k + 3, beam)
            exact = np.einsum("qd,qmd->qm", q[a : a + 1024], x[np.maximum(near, 0)])
            who = np.repeat(qid[a : a + 1024], near.shape[1])
            there = (near.ravel() >= 0) & (ids[np.maximum(near.ravel(), 0)] != who)
            out.append(pd.DataFrame({"id": who[there], "neighbour": ids[near.ravel()[there]], "similarity": exact.ravel()[there]}))
        got = pd.concat(out).sort_values(["id", "similarity", "neighbour"], ascending=[True, False, True])
        return got.groupby("id").head(k).assign(grp=pdf["grp"].iloc[0])

    found = index.unionByName(questions).groupBy("grp", "cell", "shard", "chunk").applyInPandas(answer, "grp string, id bigint, neighbour bigint, similarity double")
    rank = F.row_number().over(W.partitionBy("grp", "id").orderBy(F.desc("similarity"), "neighbour"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    if several.isEmpty():
        return found.drop("grp")
    members = written(usable.join(several, ["grp", "raw"]).select("grp", "rep", "id"), "copies")
    return _expanded(written(found, "found"), members, k)


def close_pairs(found: DataFrame, least: float) -> DataFrame:
    """``a, b`` (smaller first), ``similarity``: pairs of at least ``least``, one among the most similar of the other."""
    near = found.where(F.round("similarity", 12) >= least)
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), F.round("similarity", 9).alias("similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def group_of(*cols: str) -> Column:
    """The text that names a group of :func:`nearest`."""
    return F.concat_ws("\x1e", *cols)
