import random

import pytest

from weftgraph.operators import hierarchy as H

SCHEMA = "g string, child string, parent string, grp int, path string"


def brute(links):
    up = {}
    for g, c, p in links:
        up.setdefault((g, c), set()).add(p)
    nodes = {(g, x) for g, c, p in links for x in (c, p)}
    out = {}
    for g, n in nodes:
        seen, todo = set(), list(up.get((g, n), ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get((g, x), ())
        if n in seen:
            out[g, n] = ("cycle", None, None)
            continue
        path, at = [n], n
        while (g, at) in up and len(path) <= len(nodes):
            at = min(up[g, at])
            path.append(at)
        out[g, n] = ("below_cycle", None, None) if (g, at) in up else ("tree", at, H.SEP.join(reversed(path)))
    return out


def run(spark, links, fragment_rows):
    df = spark.createDataFrame([(g, c, p, 7, "x") for g, c, p in links], SCHEMA)
    rows = H.resolve(df, ["g"], fragment_rows=fragment_rows).collect()
    assert len(rows) == len({(r.grp, r.node) for r in rows})
    for r in rows:
        assert r.state != "tree" or r.depth == r.path.count(H.SEP)
    return {(r.grp, r.node): (r.state, r.root, r.path) for r in rows}


@pytest.mark.parametrize("fragment_rows", [100_000, 40, 9])
def test_forest_with_cycles_at_any_fragment_size(spark, fragment_rows):
    rnd = random.Random(5)
    links = []
    for g in "ab":
        names = [f"n{i:03d}" for i in rnd.sample(range(1000), 90)]
        links += [(g, names[i], names[rnd.randrange(i)]) for i in range(1, 60)]
        ring = names[60:80]
        links += [(g, ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))]
        links += [(g, names[80], names[65]), (g, names[81], names[80]), (g, names[82], names[82])]
    links += links[:10]
    assert run(spark, links, fragment_rows) == brute(links)


def test_chain_without_locality_is_contracted_by_coins(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = [("g", f"{a:04d}", f"{b:04d}") for a, b in zip(order, order[1:])]
    assert run(spark, links, 10) == brute(links)


def test_several_parents(spark):
    links = [("g", "b", "a"), ("g", "c", "b"), ("g", "a", "c"), ("g", "c", "0"), ("g", "d", "c"), ("g", "e", "e"), ("g", "e", "d"), ("g", "f", "d"), ("g", "f", "0")]
    got = {k for k, v in run(spark, links, 100).items() if v[0] == "cycle"}
    assert got == {("g", x) for x in "abce"}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "b", "a", 1, ""), ("g", None, "a", 1, ""), ("g", "x", None, 1, "")], SCHEMA)
    assert {(r.grp, r.node, r.depth) for r in H.resolve(df, ["g"]).collect()} == {("", "a", 0), ("", "b", 1)}
    assert H.resolve(df.limit(0), ["g"]).count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([("g", "b", "a", 1, ""), ("g", "c", "b", 1, ""), ("g", "d", "a", 1, "")], SCHEMA)
    solved = H.resolve(df, ["g"])
    assert {(r.ancestor, r.descendant, r.distance) for r in H.descendants(solved).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert {r.node: r.n_descendants for r in H.descendant_counts(solved).collect()} == {"a": 3, "b": 1, "c": 0, "d": 0}


@pytest.mark.parametrize("fragment_rows", [100, 4])
def test_all_links_of_several_parents_count(spark, fragment_rows):
    # x: a diamond with a longer side, and a second link further up. c1, c2: a cycle that only further links close, with nodes below.
    links = [("b", "a"), ("d", "b"), ("d", "c"), ("c", "a"), ("e", "d"), ("e", "z"), ("z", "y"), ("a", "0"), ("a", "k"), ("c1", "0"), ("c1", "c2"), ("c2", "c1"), ("low", "c1"), ("lower", "low"), ("lower", "m")]
    df = spark.createDataFrame([("g", c, p, 1, "") for c, p in links], SCHEMA)
    solved = H.resolve(df, ["g"], fragment_rows=fragment_rows)
    states = {r.node: (r.state, r.path) for r in solved.collect()}
    assert {n for n, (s, _) in states.items() if s == "cycle"} == {"c1", "c2"} and {n for n, (s, _) in states.items() if s == "below_cycle"} == {"low", "lower"}
    assert states["e"] == ("tree", H.SEP.join("0abde")) and len(states) == len({n for link in links for n in link})
    up = {}
    for c, p in links:
        if states[c][0] == states[p][0] == "tree":
            up.setdefault(c, set()).add(p)
    want = set()
    for n in up:
        at, seen, far = {n}, {n}, 0
        while at := {p for x in at for p in up.get(x, ())} - seen:
            far, seen = far + 1, seen | at
            want |= {(x, n, far) for x in at}
    more = H.more_links(df, ["g"])
    assert {(r.ancestor, r.descendant, r.distance) for r in H.descendants(solved, more).collect()} == want
    counts = {r.node: r.n_descendants for r in H.descendant_counts(solved, more).collect()}
    assert counts["k"] == 5 and counts["c"] == 2 and counts["y"] == 2 and counts["low"] == 0


def test_counts_of_descendants_over_many_ranges(spark):
    rnd = random.Random(3)
    names = [f"n{i:04d}" for i in rnd.sample(range(5000), 600)] + ["a", "a!", "a b", "a0"]
    links = [("g", names[i], names[rnd.randrange(max(0, i - 6), i)]) for i in range(1, len(names))] + [("h", "x", "y"), ("h", "z", "z")]
    solved = H.written(H.resolve(spark.createDataFrame([(*x, 1, "p") for x in links], SCHEMA), ["g"]), "solved")
    want = {}
    for r in solved.where("state = 'tree'").collect():
        for anc in r.path.split(H.SEP)[:-1]:
            want[r.grp, anc] = want.get((r.grp, anc), 0) + 1
    got = {(r.grp, r.node): r.n_descendants for r in H.descendant_counts(solved).collect()}
    assert len(got) == 607 and {k: n for k, n in got.items() if n} == want
