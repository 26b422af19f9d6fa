import random

import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.llm import termfreq as T


def counts(df, **kw):
    out = T.term_counts(df, ["project_id", "id"], ["at"], {"modifier": F.col("mods")}, **kw)
    return {r.term: (r.occurrences, r.records, round(r.share, 9)) for r in out.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), f"n{rnd.randrange(300)}", i, [rnd.choice([None, "", " ", "@Pub ", "pub", "PUB", " @x", "y", f"t{rnd.randrange(40)}"]) for _ in range(rnd.randrange(5))], "clash") for i in range(900)]
    rows += [(None, None, 5, ["pub"], "c"), (None, None, 6, ["pub", "late"], "c"), ("a", "n", 0, None, "c")]
    first = {}
    for p, i, at, mods, _ in rows:
        clean = [m.strip().lstrip("@").lower() for m in mods or [] if m is not None]
        clean = [m for m in clean if m]
        if (p, i) not in first or at < first[p, i][0]:  # whether it has terms or not, as in the SQL
            first[p, i] = (at, clean)
    want, n = {}, sum(bool(clean) for _, clean in first.values())
    for _, clean in first.values():
        for t in clean:
            o, r = want.get(t, (0, 0))
            want[t] = (o + 1, r)
        for t in {*clean}:
            want[t] = (want[t][0], want[t][1] + 1)
    df = spark.createDataFrame(rows, "project_id string, id string, at int, mods array<string>, term string").repartition(7)
    assert counts(df) == {t: (o, r, round(r / n, 9)) for t, (o, r) in want.items()}


def test_flushing_keeps_records_whole(monkeypatch):
    monkeypatch.setattr(T, "FLUSH_TERMS", 3)
    rows = [(f"k{i // 2}", [f"f\x00t{j}" for j in range(i % 7)]) for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + 5]]), pa.array([t for _, t in rows[a : a + 5]], pa.list_(pa.string()))], ["k", "t"]) for a in range(0, 60, 5)]
    got = {}
    for b in T._count(iter(batches)):
        for r in b.to_pylist():
            o, n = got.get(r["term"], (0, 0))
            got[r["term"]] = (o + r["occurrences"], n + r["records"])
    want = {}
    for i in range(0, 60, 2):  # the first row of each key counts
        for j in range(i % 7):
            o, n = want.get(f"t{j}", (0, 0))
            want[f"t{j}"] = (o + 1, n + 1)
    assert got == want


def test_the_first_row_counts_even_without_terms(spark):
    df = spark.createDataFrame([("p", "1", 0, [None, " "]), ("p", "1", 1, ["a"]), ("p", "2", 0, ["a"]), ("p", "3", 0, None), ("p", "3", 1, ["b"])], "project_id string, id string, at int, mods array<string>")
    assert [(r.term, r.records, r.share) for r in T.term_counts(df, ["project_id", "id"], ["at"], {"m": F.col("mods")}).collect()] == [("a", 1, 1.0)]


def test_marks_and_empty(spark):
    rows = [("p", str(i), 0, ["always", f"v{i % 5}"] + (["once"] if i == 3 else [])) for i in range(20)]
    df = spark.createDataFrame(rows, "project_id string, id string, at int, mods array<string>")
    got = {r.term: r.mark for r in T.mark(T.term_counts(df, ["project_id", "id"], ["at"], {"m": F.col("mods")})).collect()}
    assert got == {"always": "common", "once": "rare", **{f"v{i}": None for i in range(5)}}
    assert T.term_counts(df.limit(0), ["project_id", "id"], ["at"], {"m": F.col("mods")}).count() == 0
