"""Paths: trails, bounded neighbourhoods, inheritance lines, package cycles, dangling ends.

Loops over hops write each frontier to the shared folder; a round's action is the write itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.graph import Graph, ends, symmetric
from weftgraph.operators import hierarchy
from weftgraph.session import written


def trails(links: DataFrame, starts: DataFrame) -> DataFrame:
    """All trails (no link twice) from ``starts`` (``project_id, id``) along ``links`` (``project_id, source, target``).

    ``project_id, start, id, hops, path``: ``path`` holds the ids from the start on. Trails end by themselves, on cycles
    too, and are followed until the last has ended: a round per link of the longest. Repeated links count once.
    """
    step = written(links.select("project_id", F.col("source").alias("id"), F.col("target").alias("next")).distinct(), "steps")
    at = starts.select("project_id", F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.array("id").alias("path"), F.array().cast("array<string>").alias("used"))
    found: list[str] = []
    while True:
        link = F.concat_ws("\x1f", "id", "next")
        at = at.join(step, ["project_id", "id"]).where(~F.array_contains("used", link)).select("project_id", "start", F.col("next").alias("id"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("next")).alias("path"), F.concat("used", F.array(link)).alias("used"))
        at = written(at, "trails")
        if at.isEmpty():
            break
        found.append(at._weftgraph_path)
    # One scan of all rounds: a union of hundreds would be too deep a plan.
    return (links.sparkSession.read.schema(at.schema).parquet(*found) if found else at).drop("used")


def longest_lines(g: Graph, fragment_rows: int = hierarchy.FRAGMENT_ROWS) -> DataFrame:
    """``project_id, id, hops, path`` of the longest trail of extends links of every class that extends something.

    Lines of nodes that extend one other come from :mod:`weftgraph.operators.hierarchy`, without a round per level. At a node
    that extends several (a fork) only the best line is kept, so the rounds grow with the forks on a line and nothing grows
    with the number of ways. A line that meets a cycle goes once around it. Only where a cycle holds a fork is the longest
    trail no sum of parts: nodes that lead there are followed by :func:`trails`. Ties go to the smallest line of ids.
    """
    e = g.links("extends").where("source is not null and target is not null").select("project_id", "source", "target").distinct()
    e = written(e, "extends")
    classes = g.typed("class").select("project_id", "id")
    forks = written(e.groupBy("project_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("project_id", "id"), "forks")
    forked = not forks.isEmpty()
    if forked:
        cyc = written(_named(hierarchy.cycle_nodes(e, ["project_id"], "source", "target"), "id"), "on_cycles")
        cut = forks.union(cyc).distinct().withColumnRenamed("id", "source")
        lines = written(_lines(e.join(cut, ["project_id", "source"], "left_anti")), "lines")
    else:
        solved = written(_solved(e), "solved")
        cyc = solved.where("state = 'cycle'").select("project_id", "id")
        lines = solved.where("state = 'tree' and depth > 0").drop("state")
    looped = not cyc.isEmpty()
    if looped and not forked:
        below = solved.where("state = 'below_cycle'").select("project_id", F.col("id").alias("source"))
        lines = written(lines.unionByName(_lines(e.join(below, ["project_id", "source"], "left_semi"))), "lines")
    if not forked and not looped:
        return lines.select("project_id", "id", F.col("depth").alias("hops"), "path").join(classes, ["project_id", "id"], "left_semi")
    # The best line of every node that others lead to: roots, nodes on cycles, forks.
    tops, tangled = _around(e, cyc, forks, fragment_rows) if looped else (_no_tops(e), cyc.limit(0))
    if forked:
        tops, tangled = _best_of_forks(e, forks.join(cyc, ["project_id", "id"], "left_anti"), lines, tops, tangled)
    at_root = lines.join(tops.select("project_id", F.col("id").alias("root"), F.col("hops").alias("on"), F.col("path").alias("rest")), ["project_id", "root"], "left")
    whole = at_root.select("project_id", "id", (F.col("depth") + F.coalesce("on", F.lit(0))).alias("hops"), F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat(F.slice(F.col("path"), F.lit(1), F.col("depth").cast("int")), "rest")).alias("path"), "root")
    out = whole.join(tangled.withColumnRenamed("id", "root"), ["project_id", "root"], "left_anti").drop("root").unionByName(tops.where("hops > 0"))
    out = out.join(classes, ["project_id", "id"], "left_semi")
    if not tangled.isEmpty():
        starts = tangled.unionByName(whole.join(tangled.withColumnRenamed("id", "root"), ["project_id", "root"], "left_semi").select("project_id", "id"))
        out = out.unionByName(_longest(trails(e, starts.join(classes, ["project_id", "id"], "left_semi").distinct())))
    return out


def _named(solved: DataFrame, node: str = "id") -> DataFrame:
    return solved.select(F.split("grp", "\x1e")[0].alias("project_id"), F.col("node").alias(node), *[c for c in solved.columns if c not in ("grp", "node")])


def _solved(links: DataFrame) -> DataFrame:
    """``project_id, id, root, depth, path, state`` of links ``project_id, source, target``; the path runs from the node to its root."""
    return _named(hierarchy.resolve(links, ["project_id"], "source", "target")).withColumn("path", F.reverse(F.split("path", hierarchy.SEP)))


def _lines(links: DataFrame) -> DataFrame:
    """:func:`_solved` of links without cycles, without the roots."""
    return _solved(links).where("depth > 0").drop("state")


def _no_tops(e: DataFrame) -> DataFrame:
    return e.limit(0).select("project_id", F.col("source").alias("id"), F.lit(0).cast("bigint").alias("hops"), F.array("source").alias("path"))


def _rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Once around for the nodes of all cycles that lie within one fragment."""
    got = [b for b in batches if len(b)]
    up = {(p, i): t for b in got for p, i, t in b.itertuples(index=False)}
    seen: set[tuple[str, str]] = set()
    for key in up:
        p, way = key[0], []
        while key in up and key not in seen:
            seen.add(key)
            way.append(key[1])
            key = (p, up[key])
        if key[1] in way:  # met again: a cycle from there on
            ring = way[way.index(key[1]) :]
            for a in range(0, len(ring), 1000):
                part = range(a, min(len(ring), a + 1000))
                yield pd.DataFrame({"project_id": p, "id": [ring[i] for i in part], "hops": len(ring), "path": [ring[i:] + ring[: i + 1] for i in part]})


def _around(e: DataFrame, cyc: DataFrame, forks: DataFrame, fragment_rows: int) -> tuple[DataFrame, DataFrame]:
    """Once around for every node on a cycle without forks, and the nodes on cycles that hold or lead to one.

    Cycles within one fragment (a range of names of bounded size) are walked there. Each other one is cut behind its
    smallest node (found by pointer doubling), which leaves a line of any length to :mod:`weftgraph.operators.hierarchy`;
    a node's way around is its way to the cut and the start of the whole line.
    """
    links = written(e.join(cyc.withColumnRenamed("id", "source"), ["project_id", "source"], "left_semi").join(forks.withColumnRenamed("id", "source"), ["project_id", "source"], "left_anti").select("project_id", F.col("source").alias("id"), "target"), "cyclic")
    parts = max(1, math.ceil(links.count() / fragment_rows))
    near = links.coalesce(1) if parts == 1 else links.repartitionByRange(parts, "project_id", "id")
    tops = written(near.mapInPandas(_rings, "project_id string, id string, hops bigint, path array<string>"), "rings")
    links = written(links.join(tops.select("project_id", "id"), ["project_id", "id"], "left_anti").withColumnRenamed("id", "source"), "further")
    tangled = cyc.join(tops.select("project_id", "id"), ["project_id", "id"], "left_anti")
    if links.isEmpty():
        return tops, written(tangled, "tangled")
    far, tangled = _around_far(links, tangled)
    return tops.unionByName(far), tangled


def _around_far(links: DataFrame, cyc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`_around` for cycles that no fragment holds whole."""
    solved = written(_solved(links), "cyclic_lines")
    on = solved.where("state = 'cycle'").select("project_id", "id")
    tangled = cyc.join(on, ["project_id", "id"], "left_anti")
    ring = written(links.join(on.withColumnRenamed("id", "source"), ["project_id", "source"], "left_semi"), "ring")
    jump = ring.select("project_id", F.col("source").alias("id"), F.col("target").alias("to"), F.least("source", "target").alias("least"))
    while True:
        there = jump.select("project_id", F.col("id").alias("to"), F.col("to").alias("far"), F.col("least").alias("seen"))
        jump = written(jump.join(there, ["project_id", "to"]).select("project_id", "id", F.col("far").alias("to"), F.least("least", "seen").alias("least"), (F.col("seen") < F.col("least")).alias("moved")), "jump")
        if jump.where("moved").isEmpty():
            break
        jump = jump.drop("moved")
    least = jump.select("project_id", "id", "least")
    open_ = ring.join(least.withColumnRenamed("id", "source"), ["project_id", "source"])
    line = written(_lines(open_.where("source <> least").drop("least")), "opened")  # node, its way to the smallest of its cycle
    first = open_.where("source = least").select("project_id", F.col("least").alias("root"), F.col("target").alias("id"))
    # The whole cycle from its smallest node on; a loop has no line.
    whole = first.join(line.select("project_id", "id", "path"), ["project_id", "id"], "left").select("project_id", "root", F.coalesce("path", F.array("root")).alias("cycle"))
    ways = line.select("project_id", "id", "root", "depth", "path").unionByName(whole.select("project_id", F.col("root").alias("id"), "root", F.lit(0).cast("bigint").alias("depth"), F.array("root").alias("path")))
    full = ways.join(whole, ["project_id", "root"])
    n = F.size("cycle").cast("bigint")
    tops = full.select("project_id", "id", n.alias("hops"), F.concat("path", F.slice("cycle", F.lit(1), (n - F.col("depth")).cast("int"))).alias("path"))
    return written(tops, "around"), written(tangled, "tangled")


def _best_of_forks(e: DataFrame, forks: DataFrame, lines: DataFrame, tops: DataFrame, tangled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the best line of every fork that's on no cycle, and the forks that lead to tangled nodes.

    A fork is solved once all forks and cycles that it leads to are: a round for each fork on the longest line of forks.
    """
    via = e.join(forks.withColumnRenamed("id", "source"), ["project_id", "source"]).select("project_id", F.col("source").alias("id"), F.col("target").alias("next"))
    up = lines.select("project_id", F.col("id").alias("next"), "root", "depth", "path")
    leads = via.join(up, ["project_id", "next"], "left").select("project_id", "id", F.coalesce("root", "next").alias("to"), (F.coalesce("depth", F.lit(0)) + 1).alias("far"), F.concat(F.array("id"), F.coalesce(F.slice("path", F.lit(1), F.col("depth").cast("int")), F.array().cast("array<string>"))).alias("way"))
    known = tops.select("project_id", F.col("id").alias("to"), "hops", "path", F.lit(False).alias("odd")).unionByName(tangled.select("project_id", F.col("id").alias("to"), F.lit(0).cast("bigint").alias("hops"), F.array("id").alias("path"), F.lit(True).alias("odd")))
    wait = forks.select("project_id", F.col("id").alias("to"), F.lit(True).alias("wait"))
    hops, path = F.col("far") + F.coalesce("hops", F.lit(0)), F.concat("way", F.coalesce("path", F.array("to")))
    state = ["project_id", "id", "to", "far", "way", hops.alias("hops"), path.alias("path"), F.coalesce("odd", F.lit(False)).alias("odd")]
    todo = leads.join(known, ["project_id", "to"], "left").join(wait, ["project_id", "to"], "left").select(*state, F.col("wait").isNull().alias("ready"))
    found: list[str] = []
    while True:
        todo = written(todo, "fork_leads")
        best = F.min(F.struct((-F.col("hops")).alias("k"), F.concat_ws("\x1f", "path").alias("p"), "path")).alias("b")
        ready = todo.groupBy("project_id", "id").agg(best, F.max("odd").alias("odd"), F.min("ready").alias("ready")).where("ready")
        new = written(ready.select("project_id", "id", (-F.col("b.k")).alias("hops"), F.col("b.path").alias("path"), "odd"), "fork_best")
        if new.isEmpty():
            break
        found.append(new._weftgraph_path)
        rest = todo.withColumnsRenamed({"hops": "hops0", "path": "path0", "odd": "odd0"}).join(new.select("project_id", "id"), ["project_id", "id"], "left_anti")
        fresh = new.select("project_id", F.col("id").alias("to"), "hops", "path", "odd")
        hit = F.col("hops").isNotNull()
        rest = rest.join(fresh, ["project_id", "to"], "left")
        todo = rest.select("project_id", "id", "to", "far", "way", F.when(hit, F.col("far") + F.col("hops")).otherwise(F.col("hops0")).alias("hops"), F.when(hit, F.concat("way", "path")).otherwise(F.col("path0")).alias("path"), F.coalesce("odd", "odd0").alias("odd"), (F.col("ready") | hit).alias("ready"))
    if not found:
        return tops, tangled
    every = e.sparkSession.read.schema(new.schema).parquet(*found)
    return tops.unionByName(every.where("not odd").drop("odd")), tangled.unionByName(every.where("odd").select("project_id", "id"))


def _longest(t: DataFrame) -> DataFrame:
    best = t.groupBy("project_id", F.col("start").alias("id")).agg(F.min(F.struct((-F.col("hops")).alias("k"), F.concat_ws("\x1f", "path").alias("p"), "path", "hops")).alias("b"))
    return best.select("project_id", "id", F.col("b.hops").cast("bigint").alias("hops"), F.col("b.path").alias("path"))


def inheritance_lines(g: Graph) -> DataFrame:
    """The longest line of ancestors of every class that extends something: ``project_id, id, depth, path`` (names).

    Ties go to the smallest line of ids. An ancestor without a node goes by its id. Classes without ancestors have no row.
    """
    steps = longest_lines(g).select("project_id", "id", "hops", F.posexplode("path").alias("at", "anc"))
    names = g.nodes.select("project_id", F.col("id").alias("anc"), "name")
    named = steps.join(names, ["project_id", "anc"], "left").withColumn("name", F.coalesce("name", "anc"))
    line = named.groupBy("project_id", "id").agg(F.max("hops").alias("depth"), F.sort_array(F.collect_list(F.struct("at", "name"))).alias("l"))
    return line.select("project_id", "id", "depth", F.array_join(F.transform("l", lambda x: x["name"]), ">").alias("path"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int | None = 5, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes within ``hops`` undirected steps of each seed (``project_id, id``): ``project_id, seed, id, hop``.

    ``hop`` is the smallest. With ``limit``, the nearest that many per seed, ties by id; a seed that has them isn't followed
    further. With ``nodes``, ends that aren't nodes of their project are left out. Each step reads only the links at its
    frontier: the frontier is joined to the links before anything is made distinct.
    """
    at = written(seeds.select("project_id", F.col("id").alias("seed"), "id").distinct(), "seeds")
    seen = at.withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        front = at.select("project_id", "id").distinct()

        def beside(here: str, there: str, at=at, front=front) -> DataFrame:
            near = edges.join(front.withColumnRenamed("id", here), ["project_id", here], "left_semi")
            return near.join(at.withColumnRenamed("id", here), ["project_id", here]).select("project_id", "seed", F.col(there).alias("id"))

        nxt = beside("source", "target").unionByName(beside("target", "source")).where("id is not null").distinct()
        if nodes is not None:
            nxt = nxt.join(nodes.select("project_id", "id"), ["project_id", "id"], "left_semi")
        at = written(nxt.join(seen.select("project_id", "seed", "id"), ["project_id", "seed", "id"], "left_anti").select("project_id", "seed", "id"), "hop")
        seen = seen.unionByName(at.withColumn("hop", F.lit(h)))
        if limit is not None and h < hops:
            full = seen.where("hop > 0").groupBy("project_id", "seed").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= limit)
            at = at.join(full, ["project_id", "seed"], "left_anti").select("project_id", "seed", "id")
    out = seen.where("hop > 0")
    if limit is None:
        return out
    rank = F.row_number().over(W.partitionBy("project_id", "seed").orderBy("hop", "id"))
    return out.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def package_of(g: Graph, of: DataFrame) -> DataFrame:
    """``project_id, id, package``: the innermost package whose qualified name is a dotted prefix of a node's.

    Prefixes are exploded and joined by equality, so no pair of node and package is compared.
    """
    packs = g.typed("package").select("project_id", F.col("qualified_name").alias("package")).where("package is not null").distinct()
    part = F.split("qualified_name", "[.]")
    prefixes = of.select("project_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda n: F.array_join(F.slice(part, F.lit(1), n), "."))).alias("package"))
    hit = prefixes.join(packs, ["project_id", "package"])
    return hit.groupBy("project_id", "id").agg(F.max_by("package", F.length("package")).alias("package"))


def package_links(g: Graph) -> DataFrame:
    """Distinct links ``project_id, a, b`` between different packages, from calls, references, extends, implements."""
    home = written(package_of(g, g.nodes), "packages")
    e = g.links("calls", "references", "extends", "implements", "depends_on").select("project_id", "source", "target").distinct()
    a = home.select("project_id", F.col("id").alias("source"), F.col("package").alias("a"))
    b = home.select("project_id", F.col("id").alias("target"), F.col("package").alias("b"))
    return e.join(a, ["project_id", "source"]).join(b, ["project_id", "target"]).where("a <> b").select("project_id", "a", "b").distinct()


def package_cycles(links: DataFrame) -> DataFrame:
    """``project_id, package, length``: packages on a closed trail of 2 to 5 links, with the shortest length.

    Trails are met in the middle: a closed trail of five links is one of three and one of two with the same ends, so walks
    are made of at most three links, and only from packages without a shorter closed trail.
    """
    links = written(links, "package_links")
    one = links.select("project_id", F.col("a").alias("start"), F.col("b").alias("at"))
    ahead = links.select("project_id", F.col("a").alias("at"), "b")
    walk = lambda df: df.join(ahead, ["project_id", "at"]).select("project_id", "start", F.col("b").alias("at")).distinct()
    back = lambda df: df.select("project_id", F.col("at").alias("start"), F.col("start").alias("at"))
    two = written(walk(one), "two")
    found: DataFrame | None = None
    rest = two.where("start <> at")
    for length, (steps, home) in enumerate(((None, None), (rest, one), (rest, two), (walk, two)), 2):
        if steps is None:
            hit = two.where("start = at")
        else:
            some = rest.join(found.select("project_id", F.col("package").alias("start")), ["project_id", "start"], "left_anti")  # type: ignore[union-attr]
            hit = (steps(some) if steps is walk else some).join(back(home), ["project_id", "start", "at"], "left_semi")
        new = hit.select("project_id", F.col("start").alias("package")).distinct().withColumn("length", F.lit(length).cast("bigint"))
        found = written(new if found is None else found.unionByName(new), "cycles")
    return found  # type: ignore[return-value]


def missing_ends(g: Graph) -> DataFrame:
    """``project_id, id, missing``: edges whose source or target is not a node of their project ('source', 'target', 'both')."""
    e = g.edges.select("project_id", "id", "source", "target")
    s, t = ends(g.nodes, "source").withColumn("has_s", F.lit(1)), ends(g.nodes, "target").withColumn("has_t", F.lit(1))
    j = e.join(s, ["project_id", "source"], "left").join(t, ["project_id", "target"], "left")
    no_s, no_t = F.col("has_s").isNull(), F.col("has_t").isNull()
    return j.where(no_s | no_t).select("project_id", "id", F.when(no_s & no_t, "both").when(no_s, "source").otherwise("target").alias("missing"))


def resolve_implements(g: Graph) -> DataFrame:
    """Targets for ``implements`` edges without one: an interface of the project named like the target's last part.

    ``project_id, id, source, resolved``; ``resolved`` is null where there's none (then the edge is an error), and the
    smallest id where there are several.
    """
    have = ends(g.nodes, "target")
    dangling = g.links("implements").where("target is not null").join(have, ["project_id", "target"], "left_anti").join(ends(g.nodes, "source"), ["project_id", "source"])
    faces = g.typed("interface").groupBy("project_id", F.col("name").alias("last")).agg(F.min("id").alias("resolved"))
    last = F.element_at(F.split("target", "[.]"), -1)
    return dangling.withColumn("last", last).join(faces, ["project_id", "last"], "left").select("project_id", "id", "source", "resolved")
