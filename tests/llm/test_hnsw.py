import numpy as np
import pytest

from weftgraph.llm import hnsw as H


def data(n=1500, dim=16, seed=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(40, dim))
    x = centres[rnd.integers(0, 40, n)] + 0.4 * rnd.normal(size=(n, dim))
    return (x * rnd.uniform(0.1, 9, (n, 1))).astype(np.float32)


def brute(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_graph_recall():
    x = data()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near, _ = brute(x, 10)
    got, _ = H.Graph(u).search(u, 11)
    hits = sum(len({*g.tolist()} & {*n.tolist()}) for g, n in zip(got, near))
    assert hits / near.size > 0.95


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_tiny_graphs_find_everything(n):
    x = data(n)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got, _ = H.Graph(u).search(u, n)
    assert all({*g.tolist()} == {*range(n)} for g in got)


@pytest.mark.parametrize("shard", [{}, {"shard_rows": 150, "shard_most": 200, "chunk_rows": 300}])
def test_recall_within_projects_and_dirt(spark, shard):
    x = data(1200)
    project = ["a" if i % 3 else "b" for i in range(1200)]
    rows = [(i, project[i], x[i].tolist(), 0.5) for i in range(1200)]
    rows += rows[:30]
    rows += [(5000, "a", None, 0.0), (5001, "a", [0.0] * 16, 0.0), (5002, "a", [1.0] * 8, 0.0), (5003, "a", [2.0] * 8, 0.0), (5004, "a", [float("nan")] * 16, 0.0), (5005, "a", [None] + [1.0] * 15, 0.0), (None, "a", [1.0] * 16, 0.0), (5006, None, [1.0] * 16, 0.0), (5007, "a", [], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, project_id string, semantic_embedding array<float>, similarity double")
    got = {}
    for r in H.nearest(df, 5, **shard).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.similarity))
    assert not {5000, 5001, 5004, 5005, 5006, 5007, None} & set(got) and got[5002][0][1] == 5003
    hits = total = 0
    for p in "ab":
        ids = [i for i in range(1200) if project[i] == p]
        near, s = brute(x[ids], 5)
        for row, i in enumerate(ids):
            mine = sorted(got[i])
            assert len({m[1] for m in mine}) == 5 and all(project[m[1]] == p and m[1] != i for m in mine)
            hits += len({m[1] for m in mine} & {ids[j] for j in near[row]})
            total += 5
    assert hits / total >= 0.9
    assert H.nearest(df.limit(0), 5).count() == 0


def test_many_equal_vectors_and_pairs(spark):
    df = spark.createDataFrame([(i, "p", [1.0, 2.0]) for i in range(300)] + [(999, "p", [-2.0, 1.0])], "vec_id long, project_id string, semantic_embedding array<float>")
    found = H.nearest(df, 5, shard_rows=50, shard_most=60)
    pairs = H.close_pairs(found, 0.95).collect()
    assert all(r.a < r.b and r.similarity == 1.0 for r in pairs) and {i for r in pairs for i in (r.a, r.b)} == set(range(300))


def test_recall_around_many_copies(spark):
    rnd, dim = np.random.default_rng(8), 16
    x = np.concatenate([np.repeat(rnd.normal(size=(1, dim)), 1000, 0), np.zeros((200, dim)), rnd.normal(size=(1800, dim))])
    x[1000:1200] = x[0] + 0.25 * rnd.normal(size=(200, dim))
    kind = np.repeat([0, 1, 2], [1000, 200, 1800])  # copies, vectors near them, others
    order = rnd.permutation(len(x))
    x, kind = x[order].astype(np.float32), kind[order]
    _, s = brute(x, 5)
    near = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :5]
    df = spark.createDataFrame([(i, "p", v.tolist()) for i, v in enumerate(x)], "vec_id long, project_id string, semantic_embedding array<float>")
    got = {}
    for r in H.nearest(df, 5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert all(got[i] == near[i].tolist() for i in np.flatnonzero(kind == 0))
    for part in (1, 2):
        rows = np.flatnonzero(kind == part)
        assert sum(len({*got[i]} & {*near[i].tolist()}) for i in rows) / (5 * len(rows)) >= 0.95
