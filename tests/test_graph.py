"""Lookups, traversals, metrics and statistics on graphs small enough to count by hand."""

import random
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph, load, symmetric
from weftgraph.operators import annotations, lookup, metrics, projects, traverse

NODE = "project_id string, id string, type string, name string, qualified_name string, source_file string, description string, start_line long, end_line long, modifiers array<string>, annotations array<struct<name string, type string, source_line long, framework string, category string>>, attributes struct<parameters array<struct<name string, type string, description string>>, return_type string, implements array<string>, extends string>, scanned_at timestamp"
EDGE = "id string, project_id string, type string, source string, target string, source_file string, attributes struct<line_number long, call_type string, arguments array<string>>, scanned_at timestamp"


def graph(spark, nodes, edges):
    ns = [(n.get("p", "p"), n["id"], n.get("type", "class"), n.get("name", n["id"].rsplit(".", 1)[-1]), n.get("qn", n["id"]), n.get("file"), n.get("doc"), 1, 2, n.get("mods"), n.get("ann"), (n.get("params"), None, None, None), None) for n in nodes]
    es = [(e[3] if len(e) > 3 else f"{i}", e[4] if len(e) > 4 else "p", e[0], e[1], e[2], None, None, None) for i, e in enumerate(edges)]
    return Graph(spark.createDataFrame(ns, NODE), spark.createDataFrame(es, EDGE))


def ann(name, framework=None, category=None):
    return (name, "annotation", 1, framework, category)


def test_chain(spark):
    g = graph(spark, [{"id": x} for x in ("Child", "Parent", "Grand")], [("extends", "Child", "Parent"), ("extends", "Parent", "Grand")])
    lines = {r.id: (r.depth, r.path) for r in traverse.inheritance_lines(g).collect()}
    assert lines == {"Child": (2, "Child>Parent>Grand"), "Parent": (1, "Parent>Grand")}
    assert {r.id: (r.dit, r.noc) for r in metrics.ck_metrics(g).collect()} == {"Child": (2, 0), "Parent": (1, 1), "Grand": (0, 1)}


def test_cycles_and_several_parents_end(spark):
    g = graph(spark, [{"id": x} for x in "abcde"], [("extends", "a", "b"), ("extends", "b", "c"), ("extends", "c", "a"), ("extends", "d", "a"), ("extends", "e", "e")])
    assert {r.id: r.dit for r in metrics.dit(g).collect()} == {"a": 3, "b": 3, "c": 3, "d": 4, "e": 1}
    g = graph(spark, [{"id": x} for x in "abcd"], [("extends", "a", "b"), ("extends", "a", "c"), ("extends", "c", "d"), ("extends", "a", "b")])
    assert {r.id: r.dit for r in metrics.dit(g).collect()} == {"a": 2, "c": 1}


def test_class_measures(spark):
    nodes = [{"id": "C", "mods": ["abstract"]}] + [{"id": f"C.m{i}", "type": "method"} for i in range(10)] + [{"id": f"C.f{i}", "type": "field"} for i in range(8)] + [{"id": f"x{i}", "type": "method"} for i in range(5)] + [{"id": f"K{i}"} for i in range(5)] + [{"id": f"S{i}"} for i in range(3)]
    edges = [("contains", "C", f"C.m{i}") for i in range(10)] + [("contains", "C", f"C.f{i}") for i in range(8)] + [("calls", f"C.m{i}", f"x{i % 5}") for i in range(10)] + [("calls", "C", f"K{i}") for i in range(3)] + [("references", f"K{i}", "C") for i in range(2, 5)] + [("extends", f"S{i}", "C") for i in range(3)] + [("calls", "C", "C")]
    r = metrics.ck_metrics(graph(spark, nodes, edges)).where("id = 'C'").first()
    assert (r.wmc, r.dit, r.noc, r.cbo, r.rfc, r.lcom) == (10, 0, 3, 5, 15, 2)
    again = metrics.ck_metrics(graph(spark, nodes, edges + [("contains", "C", "C.m0"), ("extends", "S0", "C")])).where("id = 'C'").first()
    assert (again.wmc, again.noc, again.rfc, again.lcom) == (11, 4, 15, 2)  # plain counts count links, distinct ones don't
    found = {x.id: x.findings for x in metrics.assess_ck(metrics.ck_metrics(graph(spark, nodes, edges))).collect()}
    assert found["C"] == "lcom" and found["K0"] == "healthy"


def test_symmetric_counts_loops_once(spark):
    g = graph(spark, [{"id": "a"}], [("calls", "a", "a"), ("calls", "a", "b")])
    assert sorted((r.a, r.b) for r in symmetric(g.edges).collect()) == [("a", "a"), ("a", "b"), ("b", "a")]


def test_packages(spark):
    nodes = [{"id": "q.p", "type": "package"}, {"id": "q.lone", "type": "package"}] + [{"id": f"q.p.C{i}", "mods": ["abstract"] if i < 2 else None} for i in range(5)] + [{"id": f"z.E{i}"} for i in range(5)]
    edges = [("calls", f"z.E{i}", f"q.p.C{i}") for i in range(3)] + [("references", "q.p.C0", "z.E3"), ("calls", "q.p.C1", "z.E4"), ("calls", "q.p.C1", "z.E4"), ("calls", "q.p.C0", "q.p.C1")]
    got = {r.package: r for r in metrics.package_metrics(graph(spark, nodes, edges)).collect()}
    p, lone = got["q.p"], got["q.lone"]
    assert (p.ca, p.ce, p.instability, p.abstractness) == (3, 2, 0.4, 0.4) and abs(p.distance - 0.2) < 1e-9
    assert (lone.ca, lone.ce, lone.instability, lone.distance) == (0, 0, 0.0, 1.0)
    assert {r.package: r.findings for r in metrics.assess_packages(metrics.package_metrics(graph(spark, nodes, edges))).collect()}["q.lone"] == "off_main_sequence,isolated"


def test_issues(spark):
    nodes = [{"id": "God"}, {"id": "Hub"}] + [{"id": f"God.m{i}", "type": "method"} for i in range(25)] + [{"id": f"K{i}"} for i in range(30)]
    nodes += [{"id": f"r.{c}", "type": "package"} for c in "abc"] + [{"id": f"r.{c}.X"} for c in "abc"] + [{"id": "r.d", "type": "package"}, {"id": "r.d.X"}]
    edges = [("contains", "God", f"God.m{i}") for i in range(25)] + [("calls", "God", f"K{i}") for i in range(15)] + [("calls", "Hub", f"K{i}") for i in range(30)]
    edges += [("calls", "r.a.X", "r.b.X"), ("extends", "r.b.X", "r.c.X"), ("references", "r.c.X", "r.a.X"), ("calls", "r.d.X", "r.a.X")]
    got = {(r.issue, r.entity): r.severity for r in metrics.issues(graph(spark, nodes, edges)).collect()}
    assert got == {("god_class", "God"): "high", ("high_coupling", "Hub"): "critical", **{("circular_dependency", f"r.{c}"): "high" for c in "abc"}}
    s = metrics.summary(graph(spark, nodes, edges)).first()
    assert (s.classes, s.methods, s.packages, s.issues, s.score, s.band) == (36, 25, 4, 5, 75, "good")


def test_averages_leave_out_missing_depth(spark):
    g = graph(spark, [{"id": x} for x in "abc"], [("extends", "a", "b"), ("calls", "a", "b")])
    r = metrics.averages(g).first()
    assert (round(r.avg_cbo, 4), r.avg_rfc, r.avg_dit) == (0.6667, 0.0, 1.0)


def test_lookups(spark):
    nodes = [{"id": "a.X", "name": "Xray", "doc": "finds_bones"}, {"id": "a.Y", "type": "interface", "name": "Y"}, {"id": "a.X.m", "type": "method", "name": "m"}, {"id": "b", "p": "q", "name": "Xray"}]
    g = graph(spark, nodes, [("contains", "a.X", "a.X.m"), ("implements", "a.X", "a.Y"), ("implements", "a.X", "z.Y", "d"), ("calls", "a.X.m", "a.X.m"), ("calls", "gone", "a.X.m", "g"), ("calls", "a.X", "b", "x"), ("throws", None, None, "n")])
    assert [r.id for r in lookup.nodes_by_name(g, "ra").collect()] == ["a.X", "b"] and not lookup.nodes_by_name(g, "RA").collect()
    assert [r.id for r in lookup.search_nodes(g, "_bones", "p").collect()] == ["a.X"] and not lookup.search_nodes(g, "%").collect()
    assert [r.type for r in lookup.all_nodes(g, "p").collect()] == ["class", "interface", "method"]
    assert [r.class_name for r in lookup.classes_calling_method(g, "m").collect()] == ["Xray"]
    assert [r.class_name for r in lookup.implementers(g, "Y").collect()] == ["Xray"]
    assert {(r.id, r.missing) for r in traverse.missing_ends(g).collect()} == {("d", "target"), ("g", "source"), ("x", "target"), ("n", "both")}
    assert [(r.id, r.resolved) for r in traverse.resolve_implements(g).collect()] == [("d", "a.Y")]
    assert [(r.source, r.target_project) for r in lookup.cross_project_links(g).collect()] == [("a.X", "q")]
    assert {r.id: r.name for r in lookup.class_names(g, spark.createDataFrame([("p", "a.X"), ("p", "no")], "project_id string, id string")).collect()} == {"a.X": "Xray", "no": "Unknown"}
    assert len(lookup.edges_by_type(g, "CALLS").collect()) == 1 and len(lookup.edges_between(g, "a.X", "a.X.m", "p").collect()) == 1


def test_neighbours(spark):
    g = graph(spark, [{"id": x} for x in "abcdefg"], [("calls", "a", "b"), ("calls", "c", "b"), ("calls", "c", "d"), ("calls", "a", "a"), *[("calls", "a", x) for x in "efg"]])
    seeds = spark.createDataFrame([("p", "a")], "project_id string, id string")
    assert [(r.id, r.hop) for r in traverse.neighbours(g.edges, seeds, 2, 5).orderBy("hop", "id").collect()] == [("b", 1), ("e", 1), ("f", 1), ("g", 1), ("c", 2)]


def test_annotations(spark):
    test = ann("@Test", "JUnit", "testing")
    nodes = [
        {"id": "d1", "type": "method", "ann": [ann("@Deprecated", "Java", "core")]}, {"id": "d2", "type": "method", "ann": [ann("deprecated")]}, {"id": "u", "type": "method", "ann": []},
        {"id": "T.test_run_d1", "type": "method", "name": "test_run_d1", "ann": [test, ann("@X")]}, {"id": "T.other", "type": "method", "name": "other", "ann": None, "mods": ["Private "]}, {"id": "n", "type": "method", "ann": [ann("@N")], "mods": ["static"]}, {"id": "f", "type": "function", "mods": ["static"]},
    ]
    g = graph(spark, nodes, [("calls", "u", "d1"), ("calls", "u", "d1", "again"), ("references", "u", "d1"), ("throws", "u", "d1")])
    assert {r.id: r.dependency_count for r in annotations.deprecated_code(g).collect()} == {"d1": 2, "d2": 0}
    assert {r.id: r.usage_count for r in annotations.deprecated_usage(g).collect()} == {"d1": 3}
    assert {(r.framework, r.total_usage) for r in annotations.framework_usage(g).collect()} == {("Java", 1), ("JUnit", 1)}
    assert {(r.category, r.total_usage) for r in annotations.annotation_usage(g, "category").collect()} == {("core", 1), (None, 3), ("testing", 1)}
    assert "@Deprecated" not in {r.name for r in annotations.annotation_usage(g, include_deprecated=False).collect()}
    assert [(r.id, r.annotation_count) for r in annotations.testing_entities(g).collect()] == [("T.test_run_d1", 1)]
    c = annotations.coverage(g).first()  # n and d2 have an annotation without category: unknown, hence left out
    assert (c.total_methods, c.methods_with_tests, c.methods_without_tests, c.coverage_percentage) == (3, 2, 1, 67.0)
    assert {(r.concern, r.n_methods) for r in annotations.untestable(g).collect()} == {("private", 1), ("static", 1)}


@pytest.mark.parametrize("name", ["", "m" * 40])
def test_coverage_of_odd_names(spark, name):
    test = [ann("@T", None, "testing")]
    g = graph(spark, [{"id": "a", "type": "method", "name": name, "qn": "q"}, {"id": "b", "type": "method", "name": "x" + "m" * 40 + "y", "ann": test}, {"id": "c", "type": "method", "name": None, "qn": "r"}], [])
    c = annotations.coverage(g).first()
    assert (c.total_methods, c.methods_with_tests) == (2, 1)


def test_projects(spark):
    g = graph(spark, [{"id": "a"}, {"id": "b", "type": "method"}, {"id": "a", "p": "q"}], [("calls", "b", "a")])
    assert {r.project_id: (r.entity_count, r.relationship_count, r.entity_types) for r in projects.stats(g).collect()} == {"p": (2, 1, "class,method"), "q": (1, 0, "class")}
    p = spark.sql("select * from values ('p', 'beta', timestamp'2024-01-01', null), ('q', 'Alpha', null, timestamp'2024-02-01'), ('r', null, timestamp'2024-03-01', null) as t(project_id, name, created_at, updated_at)")
    assert [r.project_id for r in projects.list_projects(p, g).collect()] == ["q", "p", "r"]
    assert [r.project_id for r in projects.list_projects(p, g, "entity_count").collect()] == ["p", "q", "r"]
    assert [r.project_id for r in projects.list_projects(p, None, "created_at").collect()] == ["r", "p", "q"]
    text = projects.report(g, spark.createDataFrame([("x.py", 1, "bad")], "file_path string, line int, message string"))
    assert "class: 2" in text and "x.py: bad" in text


def test_first_scanned_wins(spark, tmp_path):
    n = graph(spark, [{"id": "a", "name": "late"}, {"id": "a", "name": "early"}], []).nodes.withColumn("scanned_at", F.when(F.col("name") == "late", F.lit("2024-02-01")).otherwise("2024-01-01").cast("timestamp")).withColumn("type", F.lit("CLASS"))
    n.write.parquet(f"{tmp_path}/code_nodes.parquet")
    graph(spark, [], [("CALLS", "a", "a", "e1"), ("calls", "a", "a", "e1"), ("calls", "a", "a", "e2")]).edges.write.parquet(f"{tmp_path}/code_edges.parquet")
    g = load(spark, str(tmp_path))
    assert [(r.name, r.type) for r in g.nodes.collect()] == [("early", "class")] and g.edges.count() == 2


def test_empty_graph(spark):
    g = graph(spark, [], [])
    for df in (metrics.ck_metrics(g), metrics.package_metrics(g), metrics.issues(g), metrics.summary(g), annotations.coverage(g), annotations.framework_usage(g), annotations.untestable(g), projects.stats(g), traverse.inheritance_lines(g), traverse.missing_ends(g), lookup.all_nodes(g)):
        assert df.count() == 0


def _brute_lines(links, classes):
    """The longest trail of every class, ties by the smallest line of ids."""
    up = {}
    for p, a, b in {*links}:
        up.setdefault((p, a), set()).add(b)
    out = {}
    for p, i in classes:
        best, todo = None, [([i], frozenset())]
        while todo:
            path, used = todo.pop()
            more = [(path + [t], used | {(path[-1], t)}) for t in up.get((p, path[-1]), ()) if (path[-1], t) not in used]
            todo += more
            if len(path) > 1:
                best = min(best or (1,), (1 - len(path), "\x1f".join(path), path))
        if best:
            out[p, i] = best[2]
    return out


def _lines_graph(spark, links):
    ids = sorted({(p, x) for p, a, b in links for x in (a, b)})
    nodes = spark.createDataFrame([(p, i, "class" if int(i.strip("abcdefghijklmnopqrstuvwxyz") or 0) % 10 != 9 else "interface", i) for p, i in ids], "project_id string, id string, type string, name string")
    edges = spark.createDataFrame([(str(k), p, "extends", a, b) for k, (p, a, b) in enumerate(links)], "id string, project_id string, type string, source string, target string")
    return Graph(nodes, edges), [(r.project_id, r.id) for r in nodes.where("type = 'class'").collect()]


@pytest.mark.parametrize("seeds, rows", [((0, 3), 100_000), ((1, 2, 4, 5), 100_000), ((1, 5), 3)])  # without and with forks, cycles across fragments
def test_longest_lines_equal_brute_force(spark, seeds, rows):
    links = []
    for seed in seeds:
        rnd = random.Random(seed)
        for p in (f"p{seed}", f"q{seed}"):
            names = [f"{rnd.choice('ab')}{i:02d}" for i in rnd.sample(range(100), 26)]
            links += [(p, names[i], names[rnd.randrange(i)]) for i in range(1, 18)]
            links += [(p, names[i], names[rnd.randrange(i)]) for i in rnd.sample(range(2, 18), 4 if seed % 3 else 0)]  # several parents
            ring = names[18:22]
            links += [(p, ring[i], ring[(i + 1) % 4]) for i in range(4)] + [(p, names[22], ring[1]), (p, names[23], names[22]), (p, names[24], names[24])]
            if seed % 2 and seed != 3:
                links += [(p, names[23], names[5]), (p, names[25], names[23])]  # a fork above a cycle
            if seed == 5:
                links += [(p, ring[2], names[3]), (p, ring[0], ring[2])]  # forks on a cycle
    links += links[:3]
    g, classes = _lines_graph(spark, links)
    got = {(r.project_id, r.id): r.path for r in traverse.longest_lines(g, rows).collect()}
    assert got == _brute_lines(links, classes)


def test_diamonds_and_long_cycles(spark):
    diamonds = [x for i in range(8) for x in (("d", f"t{i}", f"l{i}"), ("d", f"t{i}", f"r{i}"), ("d", f"l{i}", f"t{i + 1}"), ("d", f"r{i}", f"t{i + 1}"))]
    line = [("p", f"n{i}", f"n{i + 1}") for i in range(1000)]
    ring = [("c", f"z{i:03d}", f"z{(i + 1) % 300:03d}") for i in range(300)] + [("c", "y", "z010"), ("c", "x", "y"), ("c", "o", "o")]
    g, _ = _lines_graph(spark, line + ring + diamonds)
    got = {(r.project_id, r.id): (r.hops, r.path) for r in traverse.longest_lines(g).collect()}
    assert got["p", "n0"] == (1000, [f"n{i}" for i in range(1001)])
    assert got["c", "z005"] == (300, [f"z{(5 + i) % 300:03d}" for i in range(301)]) and got["c", "o"] == (1, ["o", "o"])
    assert got["c", "x"] == (302, ["x", "y", *(f"z{(10 + i) % 300:03d}" for i in range(301))])
    assert got["d", "t0"] == (16, [x for i in range(8) for x in (f"t{i}", f"l{i}")] + ["t8"])


def test_long_lines_are_followed_to_their_end(spark):
    n = 203
    line = [("extends", f"c{i:03d}", f"c{i + 1:03d}") for i in range(n)]
    # p: its end has two parents. q: its end lies on a cycle. r: nothing odd.
    odd = [*line, ("extends", f"c{n}", "y"), ("extends", f"c{n}", "x")]
    ring = [*line, ("extends", f"c{n}", "z"), ("extends", "z", f"c{n}")]
    edges = [(*e, f"{p}{i}", p) for p, es in (("p", odd), ("q", ring), ("r", line)) for i, e in enumerate(es)]
    g = graph(spark, [{"id": x, "p": p} for p in "pqr" for x in ("c000", "c150", f"c{n}", "z")], edges)
    got = {(r.project_id, r.id): (r.hops, r.path[-1], len(r.path)) for r in traverse.longest_lines(g).collect()}
    assert got == {
        ("p", "c000"): (n + 1, "x", n + 2), ("p", "c150"): (n - 149, "x", n - 148), ("p", f"c{n}"): (1, "x", 2),
        ("q", "c000"): (n + 2, f"c{n}", n + 3), ("q", "c150"): (n - 148, f"c{n}", n - 147), ("q", f"c{n}"): (2, f"c{n}", 3), ("q", "z"): (2, "z", 3),
        ("r", "c000"): (n, f"c{n}", n + 1), ("r", "c150"): (n - 150, f"c{n}", n - 149),
    }
