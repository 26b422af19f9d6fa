"""Parent-child links to full hierarchies (problem 2).

Links ``(grp, child, parent)`` form, per group, a forest of unknown depth, possibly with cycles. Walking it
level by level costs one shuffle per level; instead:

1. *Contract.* Links are range-partitioned by group and child. Names of children tend to start like their
   parents' names, so most chains lie within one fragment (a partition of bounded size). Inside a fragment every
   chain is followed to its *exit*, the first ancestor that has no link in this fragment (pointer doubling over
   arrays). Cycles that lie inside one fragment are found here.
2. *Solve the quotient.* Only exits that are children elsewhere matter further up. They form a much smaller
   forest, child -> exit, which is solved the same way, recursively, until it fits one fragment.
3. *Expand.* A node's root, depth and path are its fragment's part joined with the solution of its exit. Nodes
   on cycles that cross fragments are those on the fragment-local way between a cyclic quotient node and its exit.

If a quotient shrinks too little (names without locality), half of its links are contracted by coin tosses: a
node with tail whose parent has head is bypassed by one join, which removes a quarter on average each time.

Nothing is collected: the driver sees only row counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written

#: Links that one task holds at once (some 150 bytes each).
FRAGMENT_ROWS = 150_000
#: A quotient larger than this share of its level is contracted by coin tosses first.
STALL = 0.5
SEP = "\x1f"

LINK = "grp string, child string, parent string, hops bigint, seg string"
SOLVED = LINK.replace("parent", "top") + ", state int"
LOCAL = SOLVED + ", parent string, frag int"
#: state: 0 leads to a root or to an exit, 1 lies on a cycle, 2 leads to a cycle.
ON_CYCLE, TO_CYCLE = 1, 2


def _index(pdf: pd.DataFrame) -> np.ndarray:
    """For each link, the position of the link whose child is its parent, or -1."""
    key = pdf["grp"].str.cat(pdf["child"], sep="\x00")
    up = pdf["grp"].str.cat(pdf["parent"], sep="\x00")
    return pd.Index(key).get_indexer(pd.Index(up))


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    got = [b for b in batches if len(b)]
    return pd.concat(got, ignore_index=True) if got else None


def _contract(batches: Iterator[pd.DataFrame], paths: bool) -> Iterator[pd.DataFrame]:
    """Follow every chain of one fragment to its exit."""
    pdf = _whole(batches)
    if pdf is None:
        return
    n, par = len(pdf), _index(pdf)
    me = np.arange(n)
    jump, hops = np.where(par >= 0, par, me), np.where(par >= 0, pdf["hops"].to_numpy()[np.maximum(par, 0)], 0).astype(np.int64)
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        hops = hops + hops[jump]
        jump = jump[jump]
    cyclic = par[jump] >= 0
    on = np.zeros(n, bool)
    on[jump[cyclic]] = True
    top = pdf["parent"].to_numpy()[jump].astype(object)
    top[cyclic] = None
    total = np.where(cyclic, 0, hops + pdf["hops"].to_numpy())
    seg = pdf["seg"].to_numpy().astype(object)
    if paths:
        for i in np.argsort(total, kind="stable"):
            if cyclic[i]:
                seg[i] = None
            elif par[i] >= 0:
                seg[i] = seg[par[i]] + SEP + seg[i]
    state = np.where(on, ON_CYCLE, np.where(cyclic, TO_CYCLE, 0)).astype(np.int32)
    frag = np.int32(TaskContext.get().partitionId())
    yield pd.DataFrame({"grp": pdf["grp"], "child": pdf["child"], "top": top, "hops": total, "seg": seg, "state": state, "parent": pdf["parent"], "frag": frag})


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the flagged links of one fragment, flag all links above them in it."""
    flag = pdf["flag"].to_numpy(dtype=bool, na_value=False)
    par = _index(pdf)
    jump = np.where(par >= 0, par, np.arange(len(pdf)))
    for _ in range(max(1, math.ceil(math.log2(len(pdf) + 1)))):
        flag = flag.copy()
        flag[jump[flag]] = True
        jump = jump[jump]
    return pdf.loc[flag, ["grp", "child"]]


def _fragments(links: DataFrame, parts: int) -> DataFrame:
    return links.repartitionByRange(parts, "grp", "child") if parts > 1 else links.coalesce(1)


def _solve(links: DataFrame, paths: bool, fragment_rows: int, level: int = 0) -> DataFrame:
    """``links`` (written, one per child) to SOLVED; ``top`` is a root, or null at and below cycles."""
    n = links.count()
    parts = max(1, math.ceil(n / fragment_rows))
    local = _fragments(links, parts).mapInPandas(lambda it: _contract(it, paths), LOCAL)
    if parts == 1:
        return local.drop("parent", "frag")
    local = written(local, f"fragments{level}")
    exits = local.where("top is not null").groupBy("grp", F.col("top").alias("child")).agg(F.lit(1).alias("__one"))
    inner = local.join(exits, ["grp", "child"])
    quotient = written(inner.select("grp", "child", "top", "hops", "seg", "state"), f"quotient{level}")
    q = quotient.count()
    if not q:
        return local.drop("parent", "frag")
    todo = quotient.where("state = 0").select("grp", "child", F.col("top").alias("parent"), "hops", "seg")
    done = quotient.where("state <> 0")
    upper = _toss(todo, paths, fragment_rows, level + 1) if q > STALL * n else _solve(written(todo, f"todo{level}"), paths, fragment_rows, level + 1)
    upper = written(_adopt(upper, done), f"solved{level}")
    u = upper.select("grp", F.col("child").alias("top"), F.col("top").alias("u_top"), F.col("hops").alias("u_hops"), F.col("seg").alias("u_seg"), F.col("state").alias("u_state"))
    joined = local.join(u, ["grp", "top"], "left")
    below = F.coalesce(F.col("u_state"), F.lit(0)) > 0
    merged = joined.select(
        "grp", "child", F.when(below, None).otherwise(F.coalesce("u_top", "top")).alias("top"), F.when(below, 0).otherwise(F.col("hops") + F.coalesce("u_hops", F.lit(0))).cast("bigint").alias("hops"),
        F.when(below, None).when(F.col("u_seg").isNotNull(), F.concat_ws(SEP, "u_seg", "seg")).otherwise(F.col("seg")).alias("seg"), F.when(below, TO_CYCLE).otherwise(F.col("state")).cast("int").alias("state"),
    )
    flags = upper.where(F.col("state") == ON_CYCLE).select("grp", "child", F.lit(True).alias("flag"))
    if flags.isEmpty():
        return merged
    marked = local.select("grp", "child", "parent", "frag").join(flags, ["grp", "child"], "left")
    hit = marked.where("flag").select("frag").distinct()
    cyc = written(marked.join(hit, "frag", "left_semi").groupBy("frag").applyInPandas(_spread, "grp string, child string"), f"cyclic{level}")
    return _mark(merged, cyc)


def _mark(solved: DataFrame, cyc: DataFrame) -> DataFrame:
    on = cyc.groupBy("grp", "child").agg(F.lit(ON_CYCLE).alias("__on"))
    return solved.join(on, ["grp", "child"], "left").select("grp", "child", "top", "hops", "seg", F.coalesce("__on", "state").cast("int").alias("state"))


def _adopt(upper: DataFrame, done: DataFrame) -> DataFrame:
    """Add nodes whose cycle was already found; whatever ends in one of them leads to a cycle."""
    d = done.select("grp", F.col("child").alias("top"), F.lit(TO_CYCLE).alias("__c"))
    u = upper.join(d, ["grp", "top"], "left")
    hit = F.col("__c").isNotNull()
    u = u.select("grp", "child", F.when(~hit, F.col("top")).alias("top"), F.when(~hit, F.col("hops")).otherwise(0).cast("bigint").alias("hops"), F.when(~hit, F.col("seg")).alias("seg"), F.coalesce("__c", "state").cast("int").alias("state"))
    return u.unionByName(done.select("grp", "child", "top", "hops", "seg", "state"))


def _toss(links: DataFrame, paths: bool, fragment_rows: int, level: int) -> DataFrame:
    """Bypass links with tail whose parent has head, solve the rest, and put the bypassed ones back."""
    links = written(links.withColumn("coin", F.pmod(F.xxhash64("grp", "child", F.lit(level)), F.lit(2))), f"coins{level}")
    heads = links.select("grp", F.col("child").alias("parent"), F.col("coin").alias("p_coin"))
    both = written(links.join(heads, ["grp", "parent"], "left"), f"tossed{level}")
    out = both.where("coin = 1 and p_coin = 0").select("grp", F.col("child").alias("parent"), F.col("parent").alias("r_parent"), F.col("hops").alias("r_hops"), F.col("seg").alias("r_seg"))
    keep = both.where("coin = 0 or p_coin is null or p_coin = 1").select("grp", "child", "parent", "hops", "seg").join(out, ["grp", "parent"], "left")
    seg = F.when(F.col("r_seg").isNotNull(), F.concat_ws(SEP, "r_seg", "seg")).otherwise(F.col("seg"))
    short = keep.select("grp", "child", F.coalesce("r_parent", "parent").alias("parent"), (F.col("hops") + F.coalesce("r_hops", F.lit(0))).alias("hops"), seg.alias("seg"), F.when(F.col("r_parent").isNotNull(), F.col("parent")).alias("via"))
    short = written(short, f"short{level}")
    upper = written(_solve(short.drop("via"), paths, fragment_rows, level + 1), f"upper{level}")
    u = upper.select("grp", F.col("child").alias("r_parent"), F.col("top").alias("u_top"), F.col("hops").alias("u_hops"), F.col("seg").alias("u_seg"), F.col("state").alias("u_state"))
    below = F.coalesce(F.col("u_state"), F.lit(0)) > 0
    back = out.join(u, ["grp", "r_parent"], "left").select(
        "grp", F.col("parent").alias("child"), F.when(below, None).otherwise(F.coalesce("u_top", "r_parent")).alias("top"), F.when(below, 0).otherwise(F.col("r_hops") + F.coalesce("u_hops", F.lit(0))).cast("bigint").alias("hops"),
        F.when(below, None).when(F.col("u_seg").isNotNull(), F.concat_ws(SEP, "u_seg", "r_seg")).otherwise(F.col("r_seg")).alias("seg"), F.when(below, TO_CYCLE).otherwise(0).cast("int").alias("state"),
    )
    via = short.where("via is not null").join(upper.where(F.col("state") == ON_CYCLE).select("grp", "child"), ["grp", "child"]).select("grp", F.col("via").alias("child"))
    return upper.unionByName(_mark(back, via))


def distinct_links(links: DataFrame, group_cols: list[str], child: str, parent: str) -> DataFrame:
    """``grp, child, parent`` without nulls and repeats; ``grp`` joins the group columns (null as empty)."""
    grp = F.concat_ws("\x1e", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group_cols])
    cols = links.select(grp.alias("grp"), F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent"))
    return cols.where("child is not null and parent is not null").groupBy("grp", "child", "parent").agg(F.lit(1).alias("__one")).drop("__one")


def _cores(links: DataFrame) -> DataFrame:
    """``grp, child, core``: nodes of ``grp, child, parent`` links on a directed cycle, and what they're strongly connected by.

    Nodes without a way in or without a way out are trimmed until none is left to trim; the rest is split by
    forward and backward minimum labels (a node is on a cycle with the label's owner if both agree), round by
    round, as in distributed strongly connected components. Every round is written to the shared folder.
    """
    loops = links.where("child = parent").select("grp", "child", F.col("child").alias("core"))
    rest, found = written(links.where("child <> parent"), "rest"), []
    while True:
        while True:
            n = rest.count()
            ups = rest.select("grp", F.col("parent").alias("child")).distinct()
            downs = rest.select("grp", F.col("child").alias("parent")).distinct()
            rest = written(rest.join(ups, ["grp", "child"], "left_semi").join(downs, ["grp", "parent"], "left_semi"), "trim")
            if rest.count() == n:
                break
        if not n:
            break
        nodes = rest.select("grp", F.col("child").alias("v")).union(rest.select("grp", F.col("parent").alias("v"))).distinct()
        lab = nodes.select("grp", "v", F.col("v").alias("f"), F.col("v").alias("b"))
        lab = written(lab, "labels")
        while True:
            fwd = rest.join(lab.select("grp", F.col("v").alias("child"), "f"), ["grp", "child"]).select("grp", F.col("parent").alias("v"), "f", F.lit(None).cast("string").alias("b"))
            bwd = rest.join(lab.select("grp", F.col("v").alias("parent"), "b"), ["grp", "parent"]).select("grp", F.col("child").alias("v"), F.lit(None).cast("string").alias("f"), "b")
            new = written(lab.unionByName(fwd).unionByName(bwd).groupBy("grp", "v").agg(F.min("f").alias("f"), F.min("b").alias("b")), "labels")
            changed = new.join(lab.select("grp", "v", F.col("f").alias("f0"), F.col("b").alias("b0")), ["grp", "v"]).where("f <> f0 or b <> b0")
            stop = changed.isEmpty()
            lab = new
            if stop:
                break
        core = written(lab.where("f = b"), "core")
        big = core.groupBy("grp", "f").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        found.append(core.join(big, ["grp", "f"], "left_semi").select("grp", F.col("v").alias("child"), F.col("f").alias("core")))
        side = lambda end: lab.select("grp", F.col("v").alias(end), F.struct("f", "b").alias(f"l_{end}"))
        split = rest.join(side("child"), ["grp", "child"]).join(side("parent"), ["grp", "parent"]).where("l_child = l_parent and l_child.f <> l_child.b")
        rest = written(split.select("grp", "child", "parent"), "rest")
    for x in found:
        loops = loops.join(x.select("grp", "child"), ["grp", "child"], "left_anti").union(x)
    return loops


def _cycles_any(links: DataFrame, fragment_rows: int) -> DataFrame:
    """``grp, child`` on a directed cycle where nodes may have several parents (forks).

    Lines of nodes with one parent are contracted first, so the rounds of :func:`_cores` grow with the forks on a line,
    not with its length. Nodes between two forks of one core are on a cycle with them.
    """
    forks = written(links.groupBy("grp", "child").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp", "child"), "forks")
    single = links.join(forks, ["grp", "child"], "left_anti").select("grp", "child", "parent", F.lit(1).cast("bigint").alias("hops"), F.col("child").alias("seg"))
    lines = written(_solve(written(single, "single"), True, fragment_rows), "lines")
    on = lines.where(F.col("state") == ON_CYCLE).select("grp", "child")
    up = lines.select("grp", F.col("child").alias("parent"), "top", "seg", "state")
    leads = links.join(forks, ["grp", "child"]).join(up, ["grp", "parent"], "left").where("state is null or state = 0")
    leads = leads.select("grp", "child", F.coalesce("top", "parent").alias("to"), "seg").join(forks.withColumnRenamed("child", "to"), ["grp", "to"])
    leads = written(leads, "leads")
    if leads.isEmpty():
        return on
    cores = written(_cores(leads.select("grp", "child", F.col("to").alias("parent")).distinct()), "cores")
    inner = leads.join(cores, ["grp", "child"]).join(cores.withColumnsRenamed({"child": "to", "core": "core_to"}), ["grp", "to"]).where("core = core_to")
    between = inner.where("seg is not null").select("grp", F.explode(F.split("seg", SEP)).alias("child"))
    return on.union(cores.select("grp", "child")).union(between).distinct()


def resolve(links: DataFrame, group_cols: list[str], child: str = "child", parent: str = "parent", paths: bool = True, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Path, depth, root and cycle state of every node that occurs in ``links``.

    Returns ``grp, node, root, depth, path, state``: ``grp`` joins the group columns by ``\\x1e``; ``path`` runs
    from the root to the node, joined by ``\\x1f`` (null without ``paths``); ``depth`` of a root is 0; ``state``
    is 'tree', 'cycle' (on a directed cycle, loops included) or 'below_cycle'. For the latter two, root, depth
    and path are null.

    Links with a null end are left out, repeated links count once, other columns are ignored, an empty table
    gives no rows. A node with several different parents takes the smallest for its path and is on a cycle if any
    directed cycle of the group holds it; nodes whose path would lead to such a cycle are below it.
    :func:`more_links` has the links that no path follows.
    """
    all_links = written(distinct_links(links, group_cols, child, parent), "links")
    one = all_links.groupBy("grp", "child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("k"))
    several = not one.where("k > 1").isEmpty()
    seg = F.col("child") if paths else F.lit(None).cast("string")
    if several:
        cyc = written(_cycles_any(all_links, fragment_rows), "on_cycles")
        one = one.join(cyc, ["grp", "child"], "left_anti")  # so that paths end in nodes on cycles
    single = one if several else all_links
    start = single.select("grp", "child", "parent", F.lit(1).cast("bigint").alias("hops"), seg.alias("seg"))
    solved = _solve(written(start, "single") if several else start, paths, fragment_rows)
    if several:
        on = cyc.select("grp", "child", F.lit(None).cast("string").alias("top"), F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast("string").alias("seg"), F.lit(ON_CYCLE).cast("int").alias("state"))
        solved = _adopt(solved, on)
    state = F.when(F.col("state") == ON_CYCLE, "cycle").when(F.col("state") == TO_CYCLE, "below_cycle").otherwise("tree")
    path = F.when(F.col("state") == 0, F.concat_ws(SEP, "top", "seg")) if paths else F.lit(None).cast("string")
    tree = F.col("state") == 0
    nodes = solved.select("grp", F.col("child").alias("node"), F.when(tree, F.col("top")).alias("root"), F.when(tree, F.col("hops")).alias("depth"), path.alias("path"), state.alias("state"))
    kids = all_links.select("grp", F.col("child").alias("node")).distinct()
    roots = all_links.select("grp", F.col("parent").alias("node")).distinct().join(kids, ["grp", "node"], "left_anti")
    return nodes.unionByName(roots.select("grp", "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.col("node").alias("path") if paths else F.lit(None).cast("string").alias("path"), F.lit("tree").alias("state")))


def cycle_nodes(links: DataFrame, group_cols: list[str], child: str = "child", parent: str = "parent", fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """``grp, node`` of the nodes on cycles: :func:`resolve` without paths."""
    return resolve(links, group_cols, child, parent, False, fragment_rows).where("state = 'cycle'").select("grp", "node")


def more_links(links: DataFrame, group_cols: list[str], child: str = "child", parent: str = "parent") -> DataFrame:
    """``grp, child, parent`` of the links that no path of :func:`resolve` follows: of several parents, all but the smallest."""
    up = distinct_links(links, group_cols, child, parent)
    several = up.groupBy("grp", "child").agg(F.min("parent").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return up.join(several, ["grp", "child"]).where("parent <> least").select("grp", "child", "parent")


def descendants(resolved: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``grp, ancestor, descendant, distance`` of every ancestor-descendant pair, from the paths.

    As many rows as the sum of all depths. Nodes on or below cycles have no pairs. With ``more`` (:func:`more_links`),
    pairs over all links between the other nodes, each once with its shortest distance: paths are continued over further
    links, a round for each such link on a way.
    """
    steps = resolved.where("depth > 0").select("grp", F.col("node").alias("descendant"), "depth", F.posexplode(F.split("path", SEP)).alias("at", "ancestor"))
    pairs = steps.where("at < depth").select("grp", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    if more is None:
        return pairs
    trees = resolved.where("state = 'tree'").select("grp", "node")
    more = more.join(trees.withColumnRenamed("node", "child"), ["grp", "child"]).join(trees.withColumnRenamed("node", "parent"), ["grp", "parent"])
    more = written(more.select("grp", "child", "parent"), "more")
    if more.isEmpty():
        return pairs
    me = trees.select("grp", F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).cast("bigint").alias("distance"))
    lines = written(me.unionByName(pairs), "lines")
    # Where each further link leads: its parent and the parent's path.
    leads = more.join(lines.withColumnRenamed("descendant", "parent"), ["grp", "parent"]).groupBy("grp", F.col("child").alias("via"), "ancestor").agg((F.min("distance") + 1).alias("far"))
    leads = written(leads, "leads")
    best = new = lines
    while True:
        step = new.select("grp", "descendant", F.col("ancestor").alias("via"), "distance").join(leads, ["grp", "via"])
        step = step.groupBy("grp", "ancestor", "descendant").agg(F.min(F.col("distance") + F.col("far")).alias("distance"))
        old = best.select("grp", "ancestor", "descendant", F.col("distance").alias("had"))
        new = written(step.join(old, ["grp", "ancestor", "descendant"], "left").where("had is null or distance < had").select("grp", "ancestor", "descendant", "distance"), "further")
        if new.isEmpty():
            break
        best = written(best.unionByName(new).groupBy("grp", "ancestor", "descendant").agg(F.min("distance").alias("distance")), "pairs")
    return best.where("distance > 0")


def descendant_counts(resolved: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``grp, node, n_descendants`` (0 for leaves, and for nodes on or below cycles).

    Where every node has one parent, no pair is made: nodes in order of their paths follow their ancestors at once, so each
    range of them adds up subtrees with a stack of one path, and only the ancestors of its first row go on to other
    ranges. With ``more`` links between trees, pairs are counted.
    """
    if more is not None:
        trees = resolved.where("state = 'tree'").select("grp", "node")
        more = written(more.join(trees.withColumnRenamed("node", "child"), ["grp", "child"], "left_semi").join(trees.withColumnRenamed("node", "parent"), ["grp", "parent"], "left_semi"), "more")
    if more is None or more.isEmpty():
        lined = resolved.where("state = 'tree'").select("grp", F.split("path", SEP).alias("way"))
        lined = lined.repartitionByRange("grp", "way").sortWithinPartitions("grp", "way")
        n = lined.mapInArrow(_sizes, "grp string, node string, n bigint").groupBy("grp", "node").agg(F.sum("n").alias("n"))
    else:
        n = descendants(resolved, more).groupBy("grp", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return resolved.select("grp", "node").join(n, ["grp", "node"], "left").select("grp", "node", F.coalesce("n", F.lit(0)).alias("n_descendants"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of paths in order, the descendants of each node that follow it here; also of the first row's ancestors."""
    stack: list[list] = []  # node, its descendants so far, whether its own row is here
    out: list[tuple] = []
    grp = None

    def close(depth: int) -> None:
        while len(stack) > depth:
            node, n, real = stack.pop()
            if n:
                out.append((grp, node, n))
            if stack:
                stack[-1][1] += n + real

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["grp", "node", "n"])

    for b in batches:
        for g, way in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if g != grp:
                close(0)
                grp = g
            close(len(way) - 1)
            for node in way[len(stack) : -1]:
                stack.append([node, 0, 0])
            stack.append([way[-1], 0, 1])
        yield batch()
    close(0)
    yield batch()
