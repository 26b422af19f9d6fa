"""Queries of the graph operators over whole tables, each with its SQL.

Parameters that name one project, node or method are taken from the data (the smallest of their kind), so that the
same query is meaningful on any folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.extract import frameworks
from weftgraph.functions import scalar
from weftgraph.graph import Graph, inner_edges, load
from weftgraph.operators import annotations, lookup, metrics, paging, projects, semantic, traverse
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_N = "n AS (SELECT * REPLACE (lower(type) AS type) FROM code_nodes QUALIFY row_number() OVER (PARTITION BY project_id, id ORDER BY scanned_at NULLS FIRST) = 1)"
_E = "e AS (SELECT id, project_id, lower(type) AS type, source, target, source_file, attributes FROM code_edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at NULLS FIRST) = 1)"
_IN = "r AS (SELECT e.* FROM e JOIN n s ON s.project_id = e.project_id AND s.id = e.source JOIN n t ON t.project_id = e.project_id AND t.id = e.target)"
_P = "(SELECT min(project_id) FROM code_nodes)"


def query(sql: str | None = None, ctes: str = f"{_N}, {_E}", recursive: bool = False):
    """Register a query under its function's name, with SQL over the given common tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {sql}"
        return f

    return register


def _project(spark: SparkSession, d: str) -> str:
    return table(spark, d, "code_nodes").agg(F.min("project_id")).first()[0]


_NODE = ("project_id", "id", "type", "name", "qualified_name")


# --- lookups ----------------------------------------------------------------------------------------------------


@query("SELECT project_id, id, type, name, qualified_name FROM n WHERE type = 'class'")
def nodes_by_type_across(spark, d):
    """Classes of all projects, by project and name."""
    return lookup.nodes_by_type(load(spark, d), "class").select(*_NODE)


@query(f"SELECT project_id, id, type, name, qualified_name FROM n WHERE type = 'method' AND project_id = {_P}")
def nodes_by_type(spark, d):
    """Methods of one project, by name."""
    return lookup.nodes_by_type(load(spark, d), "method", _project(spark, d)).select(*_NODE)


@query("SELECT project_id, id, type, name, qualified_name FROM n WHERE contains(name, 'Ledger')")
def nodes_by_name(spark, d):
    """Nodes with a part in the name, case-sensitively."""
    return lookup.nodes_by_name(load(spark, d), "Ledger").select(*_NODE)


@query("SELECT project_id, id, type, name, qualified_name FROM n WHERE qualified_name = (SELECT min(qualified_name) FROM code_nodes)")
def nodes_by_qualified_name(spark, d):
    """Nodes of a qualified name."""
    name = table(spark, d, "code_nodes").agg(F.min("qualified_name")).first()[0]
    return lookup.nodes_by_qualified_name(load(spark, d), name).select(*_NODE)


@query(f"SELECT project_id, id, type, name, qualified_name FROM n WHERE project_id = {_P} AND id = (SELECT min(id) FROM code_nodes WHERE project_id = {_P})")
def get_node(spark, d):
    """One node by its key."""
    p = _project(spark, d)
    i = table(spark, d, "code_nodes").where(F.col("project_id") == p).agg(F.min("id")).first()[0]
    return lookup.node(load(spark, d), i, p).select(*_NODE)


_SEARCH = "contains(name, 'wagon') OR contains(qualified_name, 'wagon') OR contains(description, 'wagon')"


@query(f"SELECT project_id, id, type, name, qualified_name FROM n WHERE project_id = {_P} AND ({_SEARCH}) ORDER BY name NULLS LAST, id LIMIT 100")
def search_nodes(spark, d):
    """Text search in one project: the first 100 by name."""
    return lookup.search_nodes(load(spark, d), "wagon", _project(spark, d)).select(*_NODE)


@query(f"SELECT project_id, id, type, name, qualified_name FROM n WHERE {_SEARCH} ORDER BY project_id NULLS LAST, name NULLS LAST, id LIMIT 100")
def search_nodes_across(spark, d):
    """Text search in all projects."""
    return lookup.search_nodes(load(spark, d), "wagon").select(*_NODE)


@query(f"SELECT project_id, id, type, name, qualified_name FROM n WHERE project_id = {_P} ORDER BY type NULLS LAST, name NULLS LAST, id LIMIT 1000")
def all_nodes(spark, d):
    """The first 1000 nodes of a project by type and name."""
    return lookup.all_nodes(load(spark, d), _project(spark, d)).select(*_NODE)


@query("SELECT project_id, id, type, name, qualified_name FROM n ORDER BY project_id NULLS LAST, type NULLS LAST, name NULLS LAST, id LIMIT 1000")
def all_nodes_across(spark, d):
    """The first 1000 nodes of all projects."""
    return lookup.all_nodes(load(spark, d)).select(*_NODE)


_EDGE = ("id", "project_id", "type", "source", "target")
_EC = f"{_N}, {_E}, {_IN}"
_ES = "SELECT id, project_id, type, source, target FROM r"


@query(f"{_ES} WHERE type = 'implements' AND project_id = {_P}", _EC)
def edges_by_type(spark, d):
    """Implements links of a project."""
    return lookup.edges_by_type(load(spark, d), "implements", _project(spark, d)).select(*_EDGE)


@query(f"{_ES} WHERE type = 'throws'", _EC)
def edges_by_type_across(spark, d):
    """Throws links of all projects."""
    return lookup.edges_by_type(load(spark, d), "throws").select(*_EDGE)


def _end(spark, d, end: str) -> tuple[str, str]:
    g = load(spark, d)
    r = inner_edges(g).groupBy("project_id", end).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "project_id", end).first()
    return r[1], r[0]


_TOP = "(SELECT {0} FROM r GROUP BY project_id, {0} ORDER BY count(*) DESC, project_id, {0} LIMIT 1)"
_TOPP = "(SELECT project_id FROM r GROUP BY project_id, {0} ORDER BY count(*) DESC, project_id, {0} LIMIT 1)"


@query(f"{_ES} WHERE source = {_TOP.format('source')} AND project_id = {_TOPP.format('source')}", _EC)
def edges_by_source(spark, d):
    """Links from the node with the most of them."""
    return lookup.edges_by_source(load(spark, d), *_end(spark, d, "source")).select(*_EDGE)


@query(f"{_ES} WHERE target = {_TOP.format('target')} AND project_id = {_TOPP.format('target')}", _EC)
def edges_by_target(spark, d):
    """Links to the node with the most of them."""
    return lookup.edges_by_target(load(spark, d), *_end(spark, d, "target")).select(*_EDGE)


@query(f"{_ES} WHERE target = {_TOP.format('target')} AND project_id = {_TOPP.format('target')} AND source = (SELECT min(source) FROM r WHERE target = {_TOP.format('target')} AND project_id = {_TOPP.format('target')})", _EC)
def edges_between(spark, d):
    """Links between two nodes."""
    g, (t, p) = load(spark, d), _end(spark, d, "target")
    s = lookup.edges_by_target(g, t, p).agg(F.min("source")).first()[0]
    return lookup.edges_between(g, s, t, p).select(*_EDGE)


@query(f"{_ES} WHERE project_id = {_P} ORDER BY project_id, type, id LIMIT 1000", _EC)
def all_edges(spark, d):
    """The first 1000 links of a project by type and id."""
    return lookup.all_edges(load(spark, d), _project(spark, d)).select(*_EDGE)


@query(f"{_ES} ORDER BY project_id, type, id LIMIT 1000", _EC)
def all_edges_across(spark, d):
    """The first 1000 links of all projects."""
    return lookup.all_edges(load(spark, d)).select(*_EDGE)


@query("SELECT project_id, id, qualified_name, list_filter(annotations, lambda a: a.name = '@Test')[1].framework AS framework FROM n WHERE len(list_filter(annotations, lambda a: a.name = '@Test' AND a.category = 'testing')) > 0")
def nodes_by_annotation(spark, d):
    """Nodes with an annotation that meets all conditions."""
    return lookup.nodes_by_annotation(load(spark, d), "@Test", category="testing").select("project_id", "id", "qualified_name", F.col("matched.framework").alias("framework"))


@query("SELECT k.project_id, k.id, coalesce(n.name, 'Unknown') AS name FROM (SELECT DISTINCT project_id, target AS id FROM e WHERE type = 'extends' AND target IS NOT NULL) k LEFT JOIN n ON n.project_id = k.project_id AND n.id = k.id")
def class_names(spark, d):
    """Names of everything that is extended, 'Unknown' for ids without a node."""
    g = load(spark, d)
    return lookup.class_names(g, g.links("extends").where("target is not null").select("project_id", F.col("target").alias("id")).distinct())


_METHOD = "(SELECT min(t.name) FROM e JOIN n t ON t.project_id = e.project_id AND t.id = e.target AND t.type = 'method' WHERE e.type = 'calls')"


@query(f"SELECT DISTINCT c.project_id, k.name AS class_name FROM e c JOIN n k ON k.project_id = c.project_id AND k.id = c.source AND k.type = 'class' JOIN e x ON x.type = 'calls' AND x.project_id = c.project_id AND x.source = c.target JOIN n m ON m.project_id = x.project_id AND m.id = x.target AND m.type = 'method' AND m.name = {_METHOD} WHERE c.type = 'contains'")
def classes_calling_method(spark, d):
    """Classes that contain a caller of a method."""
    g = load(spark, d)
    name = g.links("calls").join(g.typed("method").select("project_id", F.col("id").alias("target"), "name"), ["project_id", "target"]).agg(F.min("name")).first()[0]
    return lookup.classes_calling_method(g, name)


@query("SELECT e.project_id, s.name AS class_name, t.name AS interface_name FROM e JOIN n s ON s.project_id = e.project_id AND s.id = e.source JOIN n t ON t.project_id = e.project_id AND t.id = e.target AND t.type IN ('interface', 'class') WHERE e.type = 'implements'")
def classes_implementing(spark, d):
    """Implementers of every interface (or class used as one), once for each link."""
    g = load(spark, d)
    t = g.typed("interface", "class").select("project_id", F.col("id").alias("target"), F.col("name").alias("interface_name"))
    s = g.nodes.select("project_id", F.col("id").alias("source"), F.col("name").alias("class_name"))
    return g.links("implements").join(t, ["project_id", "target"]).join(s, ["project_id", "source"]).select("project_id", "class_name", "interface_name")


@query("SELECT e.project_id, t.project_id AS target_project, e.source, e.target, e.type FROM e JOIN n s ON s.project_id = e.project_id AND s.id = e.source JOIN n t ON t.id = e.target AND t.project_id <> e.project_id WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.project_id = e.project_id AND o.id = e.target)")
def cross_project_dependencies(spark, d):
    """Links whose target is a node of another project only."""
    return lookup.cross_project_links(load(spark, d))


# --- traversals -------------------------------------------------------------------------------------------------

_X = "x AS (SELECT DISTINCT project_id, source, target FROM e WHERE type = 'extends' AND source IS NOT NULL AND target IS NOT NULL)"
_TR = f"""{_N}, {_E}, {_X}, t AS (SELECT n.project_id, n.id AS start, x.target AS id, CAST(1 AS BIGINT) AS hops, [n.id, x.target] AS path, [x.source || '#' || x.target] AS used FROM n JOIN x ON x.project_id = n.project_id AND x.source = n.id WHERE n.type = 'class'
 UNION ALL SELECT t.project_id, t.start, x.target, t.hops + 1, list_append(t.path, x.target), list_append(t.used, x.source || '#' || x.target) FROM t JOIN x ON x.project_id = t.project_id AND x.source = t.id WHERE NOT list_contains(t.used, x.source || '#' || x.target))"""


@query(
    """, b AS (SELECT project_id, start AS id, hops AS depth, path FROM t QUALIFY row_number() OVER (PARTITION BY project_id, start ORDER BY hops DESC, array_to_string(path, chr(31))) = 1),
 u AS (SELECT project_id, id, depth, unnest(path) AS anc, generate_subscripts(path, 1) AS at FROM b)
 SELECT u.project_id, u.id, any_value(u.depth) AS depth, string_agg(coalesce(n.name, u.anc), '>' ORDER BY u.at) AS path FROM u LEFT JOIN n ON n.project_id = u.project_id AND n.id = u.anc GROUP BY u.project_id, u.id""",
    _TR,
    True,
)
def inheritance_hierarchy(spark, d):
    """The longest line of ancestors of every class, from the class on."""
    return traverse.inheritance_lines(load(spark, d))


_SYM = "sym AS (SELECT DISTINCT project_id, source AS a, target AS b FROM r UNION SELECT DISTINCT project_id, target, source FROM r)"


@query(
    """, h1 AS (SELECT DISTINCT s.project_id, s.id AS seed, sym.b AS id FROM n s JOIN sym ON sym.project_id = s.project_id AND sym.a = s.id WHERE s.type = 'enum' AND sym.b <> s.id),
 h2 AS (SELECT DISTINCT h1.project_id, h1.seed, sym.b AS id FROM h1 JOIN sym ON sym.project_id = h1.project_id AND sym.a = h1.id WHERE sym.b <> h1.seed),
 al AS (SELECT project_id, seed, id, min(hop) AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL)
 SELECT project_id, seed, id, hop FROM al QUALIFY row_number() OVER (PARTITION BY project_id, seed ORDER BY hop, id) <= 5""",
    f"{_N}, {_E}, {_IN}, {_SYM}",
)
def k_hop_neighbours(spark, d):
    """The five nearest nodes within two undirected steps of every enum."""
    g = load(spark, d)
    return traverse.neighbours(inner_edges(g), g.typed("enum").select("project_id", "id"), 2, 5)


_PK = """packs AS (SELECT DISTINCT project_id, qualified_name AS package FROM n WHERE type = 'package' AND qualified_name IS NOT NULL),
 parts AS (SELECT project_id, id, string_split(qualified_name, '.') AS w FROM n), pre AS (SELECT project_id, id, len(w) AS k, array_to_string(w[1:i], '.') AS package FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM parts)),
 home AS (SELECT pre.project_id, pre.id, arg_max(pre.package, length(pre.package)) AS package FROM pre JOIN packs USING (project_id, package) GROUP BY pre.project_id, pre.id),
 pl AS (SELECT DISTINCT e.project_id, a.package AS a, b.package AS b FROM e JOIN home a ON a.project_id = e.project_id AND a.id = e.source JOIN home b ON b.project_id = e.project_id AND b.id = e.target WHERE e.type IN ('calls', 'references', 'extends', 'implements', 'depends_on') AND a.package <> b.package)"""
_CY = f"""{_N}, {_E}, {_PK}, w2 AS (SELECT DISTINCT x.project_id, x.a AS s, y.b AS t FROM pl x JOIN pl y ON y.project_id = x.project_id AND y.a = x.b),
 w3 AS (SELECT DISTINCT w.project_id, w.s, y.b AS t FROM w2 w JOIN pl y ON y.project_id = w.project_id AND y.a = w.t WHERE w.s <> w.t), w4 AS (SELECT DISTINCT w.project_id, w.s, y.b AS t FROM w3 w JOIN pl y ON y.project_id = w.project_id AND y.a = w.t WHERE w.s <> w.t),
 w5 AS (SELECT DISTINCT w.project_id, w.s, y.b AS t FROM w4 w JOIN pl y ON y.project_id = w.project_id AND y.a = w.t WHERE w.s <> w.t),
 cyc AS (SELECT project_id, s AS package, min(length) AS length FROM (SELECT *, 2 AS length FROM w2 UNION ALL SELECT *, 3 FROM w3 UNION ALL SELECT *, 4 FROM w4 UNION ALL SELECT *, 5 FROM w5) WHERE s = t GROUP BY ALL)"""


@query("SELECT project_id, a, b FROM pl", f"{_N}, {_E}, {_PK}")
def package_links(spark, d):
    """Links between packages, from those of their members."""
    return traverse.package_links(load(spark, d))


@query("SELECT project_id, package, CAST(length AS BIGINT) AS length FROM cyc", _CY)
def circular_dependencies(spark, d):
    """Packages on a closed trail of two to five links."""
    return traverse.package_cycles(traverse.package_links(load(spark, d)))


@query("SELECT e.project_id, e.id, CASE WHEN s.id IS NULL AND t.id IS NULL THEN 'both' WHEN s.id IS NULL THEN 'source' ELSE 'target' END AS missing FROM e LEFT JOIN n s ON s.project_id = e.project_id AND s.id = e.source LEFT JOIN n t ON t.project_id = e.project_id AND t.id = e.target WHERE s.id IS NULL OR t.id IS NULL")
def missing_endpoints(spark, d):
    """Links with an end that is no node."""
    return traverse.missing_ends(load(spark, d))


@query("SELECT e.project_id, e.id, e.source, f.resolved FROM e JOIN n s ON s.project_id = e.project_id AND s.id = e.source LEFT JOIN (SELECT project_id, name, min(id) AS resolved FROM n WHERE type = 'interface' GROUP BY ALL) f ON f.project_id = e.project_id AND f.name = string_split(e.target, '.')[-1] WHERE e.type = 'implements' AND e.target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n t WHERE t.project_id = e.project_id AND t.id = e.target)")
def resolve_implements(spark, d):
    """Interfaces for implements links without a target node, by the last part of the name."""
    return traverse.resolve_implements(load(spark, d))


# --- metrics ----------------------------------------------------------------------------------------------------

_MEM = "mem AS (SELECT e.project_id, e.source AS id, e.target AS member, t.type AS mt FROM e JOIN n c ON c.project_id = e.project_id AND c.id = e.source AND c.type = 'class' JOIN n t ON t.project_id = e.project_id AND t.id = e.target WHERE e.type = 'contains')"


def _coup(lift: bool) -> str:
    own = "own AS (SELECT project_id, id AS member, id AS cls FROM n WHERE type = 'class'" + (" UNION SELECT e.project_id, e.target, e.source FROM e JOIN n c ON c.project_id = e.project_id AND c.id = e.source AND c.type = 'class' WHERE e.type = 'contains')" if lift else ")")
    return f"""{own}, d AS (SELECT DISTINCT e.project_id, a.cls AS a, b.cls AS b FROM e JOIN own a ON a.project_id = e.project_id AND a.member = e.source JOIN own b ON b.project_id = e.project_id AND b.member = e.target WHERE e.type IN ('calls', 'references')),
 coup AS (SELECT project_id, a, b FROM d UNION SELECT project_id, b, a FROM d)"""


_WMC = "wmc AS (SELECT project_id, id, count(*) AS wmc FROM mem WHERE mt = 'method' GROUP BY ALL)"
_DIT = "dit AS (SELECT project_id, start AS id, max(hops) AS dit FROM t GROUP BY ALL)"
_NOC = "noc AS (SELECT e.project_id, e.target AS id, count(*) AS noc FROM e JOIN n s ON s.project_id = e.project_id AND s.id = e.source WHERE e.type = 'extends' GROUP BY ALL)"
_CBO = "cbo AS (SELECT project_id, a AS id, count(*) AS cbo FROM coup WHERE a <> b GROUP BY ALL)"
_RFC = """om AS (SELECT DISTINCT project_id, id, member FROM mem WHERE mt = 'method'), rfc AS (SELECT om.project_id, om.id, count(DISTINCT om.member) + count(DISTINCT m.id) AS rfc FROM om LEFT JOIN e x ON x.project_id = om.project_id AND x.source = om.member AND x.type = 'calls'
 LEFT JOIN n m ON m.project_id = x.project_id AND m.id = x.target AND m.type = 'method' GROUP BY om.project_id, om.id)"""
_LCOM = "lcom AS (SELECT project_id, id, CASE WHEN count(DISTINCT member) FILTER (mt = 'method') > 0 AND count(DISTINCT member) FILTER (mt = 'field') > 0 THEN greatest(0, count(DISTINCT member) FILTER (mt = 'method') - count(DISTINCT member) FILTER (mt = 'field')) ELSE 0 END AS lcom FROM mem GROUP BY ALL)"


def _all_ck(lift: bool) -> str:
    return f"{_TR}, {_MEM}, {_coup(lift)}, {_WMC}, {_DIT}, {_NOC}, {_CBO}, {_RFC}, {_LCOM}, ck AS (SELECT c.project_id, c.id, c.name, " + ", ".join(f"coalesce({m}.{m}, 0) AS {m}" for m in ("wmc", "dit", "noc", "cbo", "rfc", "lcom")) + " FROM n c " + " ".join(f"LEFT JOIN {m} ON {m}.project_id = c.project_id AND {m}.id = c.id" for m in ("wmc", "dit", "noc", "cbo", "rfc", "lcom")) + " WHERE c.type = 'class')"


_CK = "project_id, id, wmc, dit, noc, cbo, rfc, lcom"


@query(f"SELECT {_CK} FROM ck", _all_ck(False), True)
def ck_metrics(spark, d):
    """The six class measures over the links as they are."""
    return metrics.ck_metrics(load(spark, d)).select(*_CK.split(", "))


@query(f"SELECT {_CK} FROM ck", _all_ck(True), True)
def ck_metrics_lifted(spark, d):
    """The six class measures with coupling lifted from members to classes."""
    return metrics.ck_metrics(load(spark, d), True).select(*_CK.split(", "))


for _name, _cte in (("wmc", f"{_N}, {_E}, {_MEM}, {_WMC}"), ("noc", f"{_N}, {_E}, {_NOC}"), ("rfc", f"{_N}, {_E}, {_MEM}, {_RFC}"), ("lcom", f"{_N}, {_E}, {_MEM}, {_LCOM}"), ("cbo", f"{_N}, {_E}, {_coup(True)}, {_CBO}"), ("dit", f"{_TR}, {_DIT}")):

    def _measure(spark, d, name=_name):
        g = load(spark, d)
        return metrics.cbo(g, True) if name == "cbo" else getattr(metrics, name)(g).where(F.col(name) > 0)

    _measure.__name__ = _name
    _measure.__doc__ = f"{_name} of every class that has any."
    query(f"SELECT project_id, id, CAST({_name} AS BIGINT) AS {_name} FROM {_name} WHERE {_name} > 0", _cte, _name == "dit")(_measure)

_IS = """inside AS (SELECT pre.project_id, pre.id, pre.package FROM (SELECT project_id, id, k, package FROM pre) pre JOIN packs USING (project_id, package) WHERE len(string_split(pre.package, '.')) < pre.k),
 lk AS (SELECT DISTINCT project_id, source, target FROM r WHERE type IN ('calls', 'references')),
 ca AS (SELECT t.project_id, t.package, count(DISTINCT lk.source) AS ca FROM lk JOIN inside t ON t.project_id = lk.project_id AND t.id = lk.target WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.project_id = lk.project_id AND s.id = lk.source AND s.package = t.package) GROUP BY ALL),
 ce AS (SELECT s.project_id, s.package, count(DISTINCT lk.target) AS ce FROM lk JOIN inside s ON s.project_id = lk.project_id AND s.id = lk.source WHERE NOT EXISTS (SELECT 1 FROM inside t WHERE t.project_id = lk.project_id AND t.id = lk.target AND t.package = s.package) GROUP BY ALL),
 ab AS (SELECT i.project_id, i.package, count(*) FILTER (list_contains(list_transform(c.modifiers, lambda m: lower(trim(m))), 'abstract')) AS na, count(*) AS nc FROM inside i JOIN n c ON c.project_id = i.project_id AND c.id = i.id AND c.type = 'class' GROUP BY ALL),
 pm0 AS (SELECT p.project_id, p.package, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, coalesce(ce / nullif(coalesce(ca, 0) + coalesce(ce, 0), 0), 0.0) AS i, coalesce(na / nullif(nc, 0), 0.0) AS a FROM packs p LEFT JOIN ca USING (project_id, package) LEFT JOIN ce USING (project_id, package) LEFT JOIN ab USING (project_id, package)),
 pm AS (SELECT project_id, package, ca, ce, round(i, 6) AS instability, round(a, 6) AS abstractness, round(abs(a + i - 1), 6) AS distance FROM pm0)"""
_PM = f"{_N}, {_E}, {_IN}, {_PK}, {_IS}"


@query("SELECT project_id, package, ca, ce, instability, abstractness, distance FROM pm", _PM)
def package_metrics(spark, d):
    """Couplings, instability, abstractness and distance of every package."""
    return metrics.package_metrics(load(spark, d)).withColumns({c: F.round(c, 6) for c in ("instability", "abstractness", "distance")})


@query("SELECT project_id, package, coalesce(nullif(concat_ws(',', CASE WHEN i > 0.7 AND a < 0.3 THEN 'zone_of_pain' END, CASE WHEN i < 0.3 AND a > 0.7 THEN 'zone_of_uselessness' END, CASE WHEN abs(a + i - 1) > 0.7 THEN 'off_main_sequence' END, CASE WHEN ca = 0 AND ce = 0 THEN 'isolated' END), ''), 'balanced') AS findings FROM pm0", _PM)
def assess_packages(spark, d):
    """Findings on every package."""
    return metrics.assess_packages(metrics.package_metrics(load(spark, d)))


@query("SELECT project_id, id, coalesce(nullif(concat_ws(',', CASE WHEN wmc > 15 THEN 'wmc' END, CASE WHEN dit > 4 THEN 'dit' END, CASE WHEN noc > 7 THEN 'noc' END, CASE WHEN cbo > 10 THEN 'cbo' END, CASE WHEN rfc > 30 THEN 'rfc' END, CASE WHEN lcom > 0.7 THEN 'lcom' END), ''), 'healthy') AS findings FROM ck", _all_ck(True), True)
def assess_classes(spark, d):
    """Findings on every class."""
    return metrics.assess_ck(metrics.ck_metrics(load(spark, d), True))


_GOD = "god AS (SELECT c.project_id, c.id, c.name, w.wmc AS method_count, k.coupling FROM n c JOIN wmc w ON w.project_id = c.project_id AND w.id = c.id JOIN (SELECT project_id, a AS id, count(*) AS coupling FROM coup GROUP BY ALL) k ON k.project_id = c.project_id AND k.id = c.id WHERE w.wmc > 6 AND k.coupling > 2)"
_HIGH = "high AS (SELECT c.project_id, c.id, c.name, k.coupling, CASE WHEN k.coupling > 8 THEN 'critical' ELSE 'high' END AS severity FROM n c JOIN (SELECT project_id, a AS id, count(*) AS coupling FROM coup GROUP BY ALL) k ON k.project_id = c.project_id AND k.id = c.id WHERE k.coupling > 4)"
_LIMITS = {"methods": 6, "coupling": 2, "more_than": 4, "critical": 8}


@query("SELECT project_id, id, name, method_count, coupling FROM god", f"{_N}, {_E}, {_MEM}, {_coup(True)}, {_WMC}, {_GOD}")
def god_classes(spark, d):
    """Classes with many methods and couplings (limits lowered to suit small classes)."""
    return metrics.god_classes(load(spark, d), _LIMITS["methods"], _LIMITS["coupling"], True)


@query("SELECT project_id, id, name, coupling, severity FROM high", f"{_N}, {_E}, {_coup(True)}, {_HIGH}")
def high_coupling(spark, d):
    """Classes with many couplings."""
    return metrics.high_coupling(load(spark, d), _LIMITS["more_than"], _LIMITS["critical"], True)


_ISSUES = f"""{_CY}, {_MEM}, {_coup(True)}, {_WMC}, {_GOD}, {_HIGH}, iss AS (SELECT project_id, 'circular_dependency' AS issue, 'high' AS severity, package AS entity, 'Circular dependency detected in package: ' || package AS description FROM cyc
 UNION ALL SELECT project_id, 'god_class', 'high', id, 'God class detected: ' || name || ' (' || method_count || ' methods, ' || coupling || ' couplings)' FROM god UNION ALL SELECT project_id, 'high_coupling', severity, id, 'Highly coupled class: ' || name || ' (' || coupling || ' couplings)' FROM high)"""


@query("SELECT project_id, issue, severity, entity, description FROM iss", _ISSUES)
def architectural_issues(spark, d):
    """Package cycles, god classes and high coupling."""
    return metrics.issues(load(spark, d), True, **_LIMITS)


@query("SELECT project_id, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'method') AS methods, count(*) FILTER (type = 'package') AS packages FROM n GROUP BY project_id")
def project_totals(spark, d):
    """Classes, methods and packages per project."""
    return metrics.totals(load(spark, d))


_AVG = "av AS (SELECT c.project_id, avg(coalesce(k.cbo, 0)) AS avg_cbo, avg(coalesce(rfc.rfc, 0)) AS avg_rfc, coalesce(avg(dit.dit), 0.0) AS avg_dit FROM n c LEFT JOIN (SELECT project_id, a AS id, count(*) AS cbo FROM coup GROUP BY ALL) k ON k.project_id = c.project_id AND k.id = c.id LEFT JOIN rfc ON rfc.project_id = c.project_id AND rfc.id = c.id LEFT JOIN dit ON dit.project_id = c.project_id AND dit.id = c.id WHERE c.type = 'class' GROUP BY c.project_id)"


@query("SELECT project_id, round(avg_cbo, 6) AS avg_cbo, round(avg_rfc, 6) AS avg_rfc, round(avg_dit, 6) AS avg_dit FROM av", f"{_TR}, {_MEM}, {_coup(True)}, {_RFC}, {_DIT}, {_AVG}", True)
def average_metrics(spark, d):
    """Average coupling, response and depth per project."""
    return metrics.averages(load(spark, d), True).withColumns({c: F.round(c, 6) for c in ("avg_cbo", "avg_rfc", "avg_dit")})


@query(
    """, tot AS (SELECT project_id, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'method') AS methods, count(*) FILTER (type = 'package') AS packages FROM n GROUP BY project_id),
 s AS (SELECT tot.*, coalesce(avg_cbo, 0) AS avg_cbo, coalesce(avg_rfc, 0) AS avg_rfc, coalesce(avg_dit, 0) AS avg_dit, coalesce(i.k, 0) AS issues FROM tot LEFT JOIN av USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS k FROM iss GROUP BY ALL) i USING (project_id)),
 q AS (SELECT *, CAST(greatest(0, 100 - (CASE WHEN avg_cbo > 10 THEN 20 ELSE 0 END) - (CASE WHEN avg_rfc > 30 THEN 15 ELSE 0 END) - (CASE WHEN avg_dit > 4 THEN 10 ELSE 0 END) - 5 * issues) AS BIGINT) AS score FROM s)
 SELECT project_id, classes, methods, packages, issues, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'critical' END AS band FROM q""",
    f"{_ISSUES}, {_TR.split(f'{_N}, {_E}, ')[1]}, {_RFC}, {_DIT}, {_AVG}",
    True,
)
def project_summary(spark, d):
    """Totals, issues, score and band of every project."""
    return metrics.summary(load(spark, d), True, **_LIMITS).select("project_id", "classes", "methods", "packages", "issues", "score", "band")


# --- annotations ------------------------------------------------------------------------------------------------

_AN = f"{_N}, {_E}, a0 AS (SELECT project_id, id, qualified_name, unnest(annotations) AS x FROM n), an AS (SELECT project_id, id, qualified_name, x.name AS name, x.type AS kind, x.framework AS framework, x.category AS category FROM a0)"


def _usage(keys: str, n: int, where: str = "true") -> str:
    return f"us AS (SELECT {keys}, count(*) AS usage_count, coalesce(array_to_string(list_sort(list_distinct(list(qualified_name)))[1:{n}], ','), '') AS sample_nodes FROM an WHERE {where} GROUP BY ALL)"


@query("SELECT framework, name, category, usage_count, sample_nodes, CAST(sum(usage_count) OVER (PARTITION BY framework) AS BIGINT) AS total_usage FROM us WHERE usage_count >= 2", f"{_AN}, {_usage('framework, name, category', 5, 'framework IS NOT NULL')}")
def framework_usage(spark, d):
    """Annotations of each framework with at least two uses."""
    return annotations.framework_usage(load(spark, d), 2)


@query("SELECT name, framework, category, kind, usage_count, sample_nodes FROM us", f"{_AN}, {_usage('name, framework, category, kind', 5)}")
def annotation_usage(spark, d):
    """Uses of every annotation."""
    return annotations.annotation_usage(load(spark, d))


@query("SELECT category, name, framework, usage_count, sample_nodes, CAST(sum(usage_count) OVER (PARTITION BY category) AS BIGINT) AS total_usage, count(*) OVER (PARTITION BY category) AS distinct_annotations FROM us", f"{_AN}, {_usage('category, name, framework', 3)}")
def annotation_usage_by_category(spark, d):
    """Uses by category; annotations without one are a group."""
    return annotations.annotation_usage(load(spark, d), "category")


@query("SELECT framework, name, category, usage_count, sample_nodes, CAST(sum(usage_count) OVER (PARTITION BY framework) AS BIGINT) AS total_usage, count(*) OVER (PARTITION BY framework) AS distinct_annotations FROM us", f"{_AN}, {_usage('framework, name, category', 3, chr(39).join(['framework IS NOT NULL AND name NOT IN (', '@Deprecated', ', ', 'deprecated', ')']))}")
def annotation_usage_by_framework(spark, d):
    """Uses by framework, without deprecation marks."""
    return annotations.annotation_usage(load(spark, d), "framework", include_deprecated=False)


_DEP = "dep AS (SELECT project_id, id, qualified_name, type, list_filter(annotations, lambda a: a.name IN ('@Deprecated', 'deprecated', '@deprecated', 'Deprecated'))[1].name AS mark FROM n WHERE len(list_filter(annotations, lambda a: a.name IN ('@Deprecated', 'deprecated', '@deprecated', 'Deprecated'))) > 0)"
_REL = "('calls', 'references', 'extends', 'implements')"


@query(f"SELECT d.project_id, d.id, d.qualified_name, d.type, d.mark, coalesce(u.k, 0) AS dependency_count FROM dep d LEFT JOIN (SELECT project_id, id, count(*) AS k FROM (SELECT DISTINCT e.project_id, e.target AS id, s.qualified_name, e.type, s.type AS st FROM e JOIN n s ON s.project_id = e.project_id AND s.id = e.source WHERE e.type IN {_REL}) GROUP BY ALL) u ON u.project_id = d.project_id AND u.id = d.id", f"{_N}, {_E}, {_DEP}")
def deprecated_code(spark, d):
    """Deprecated nodes and how much depends on them."""
    return annotations.deprecated_code(load(spark, d))


@query(f"SELECT d.project_id, d.id, d.qualified_name AS deprecated_node, d.type AS deprecated_type, count(*) AS usage_count, min(s.qualified_name) AS first_user FROM dep d JOIN e ON e.project_id = d.project_id AND e.target = d.id AND e.type IN {_REL} JOIN n s ON s.project_id = e.project_id AND s.id = e.source GROUP BY ALL", f"{_N}, {_E}, {_DEP}")
def deprecated_usage(spark, d):
    """Links to deprecated nodes."""
    return annotations.deprecated_usage(load(spark, d))


@query("SELECT project_id, id, qualified_name, type, CAST(len(t) AS BIGINT) AS annotation_count, array_to_string(list_transform(t, lambda a: coalesce(a.name, '')), ',') AS test_annotations FROM (SELECT *, list_filter(annotations, lambda a: a.category = 'testing') AS t FROM n) WHERE len(t) > 0")
def testing_entities(spark, d):
    """Nodes with testing annotations."""
    return annotations.testing_entities(load(spark, d))


_TF = "tf AS (SELECT framework, name, count(*) AS usage_count FROM an WHERE category = 'testing' GROUP BY ALL)"


@query("SELECT framework, name, usage_count, CAST(sum(usage_count) OVER (PARTITION BY framework) AS BIGINT) AS total_usage FROM tf", f"{_AN}, {_TF}")
def testing_frameworks(spark, d):
    """Uses of testing annotations by framework."""
    return annotations.testing_frameworks(load(spark, d))


@query("SELECT (SELECT count(*) FROM n WHERE len(list_filter(annotations, lambda a: a.category = 'testing')) > 0) AS total_test_entities, count(DISTINCT coalesce(framework, '')) AS frameworks_used, CAST(coalesce(sum(usage_count), 0) AS BIGINT) AS total_testing_annotations FROM tf", f"{_AN}, {_TF}")
def testing_summary(spark, d):
    """Testing entities, frameworks and annotations in all."""
    return annotations.testing_summary(load(spark, d))


_TEST = "CASE WHEN len(list_filter(coalesce(annotations, []), lambda a: a.category = 'testing')) > 0 THEN true WHEN len(list_filter(coalesce(annotations, []), lambda a: a.category IS NULL)) > 0 THEN NULL ELSE false END"


@query(
    """SELECT p.project_id, count(*) AS total_methods, count(*) FILTER (EXISTS (SELECT 1 FROM m t WHERE t.is_test AND t.project_id = p.project_id AND (contains(t.qualified_name, p.name) OR contains(t.name, p.name)))) AS methods_with_tests,
 count(*) - count(*) FILTER (EXISTS (SELECT 1 FROM m t WHERE t.is_test AND t.project_id = p.project_id AND (contains(t.qualified_name, p.name) OR contains(t.name, p.name)))) AS methods_without_tests,
 round(100.0::DOUBLE * count(*) FILTER (EXISTS (SELECT 1 FROM m t WHERE t.is_test AND t.project_id = p.project_id AND (contains(t.qualified_name, p.name) OR contains(t.name, p.name)))) / count(*)) AS coverage_percentage
 FROM m p WHERE NOT p.is_test AND NOT contains(p.qualified_name, 'test') AND NOT contains(p.qualified_name, 'Test') GROUP BY p.project_id""",
    f"{_N}, m AS (SELECT project_id, id, name, qualified_name, {_TEST} AS is_test FROM n WHERE type = 'method')",
)
def test_coverage(spark, d):
    """Methods whose name occurs in a test method's name, per project."""
    return annotations.coverage(load(spark, d))


@query(
    "SELECT project_id, concern, count(*) AS n_methods, coalesce(array_to_string(list_sort(list_distinct(list(qualified_name)))[1:5], ','), '') AS sample_nodes FROM c WHERE concern IS NOT NULL GROUP BY ALL",
    f"{_N}, c AS (SELECT project_id, qualified_name, CASE WHEN list_contains(list_transform(modifiers, lambda m: lower(trim(m))), 'private') THEN 'private' WHEN list_contains(list_transform(modifiers, lambda m: lower(trim(m))), 'static') THEN 'static' WHEN contains(qualified_name, '__') THEN 'private_python' WHEN len(attributes.parameters) > 10 THEN 'too_many_parameters' END AS concern FROM n WHERE type IN ('method', 'function') AND NOT ({_TEST}))",
)
def untestable_code(spark, d):
    """Methods and functions that are hard to test, by what hinders it."""
    return annotations.untestable(load(spark, d))


# --- projects, reports, pages -----------------------------------------------------------------------------------

_ST = "st AS (SELECT a.project_id, a.entity_count, coalesce(b.relationship_count, 0) AS relationship_count, a.entity_types, coalesce(b.relationship_types, '') AS relationship_types FROM (SELECT project_id, count(*) AS entity_count, string_agg(DISTINCT type, ',' ORDER BY type) AS entity_types FROM n GROUP BY project_id) a LEFT JOIN (SELECT project_id, count(*) AS relationship_count, string_agg(DISTINCT type, ',' ORDER BY type) AS relationship_types FROM e GROUP BY project_id) b USING (project_id))"


@query("SELECT project_id, entity_count, relationship_count, entity_types, relationship_types FROM st", f"{_N}, {_E}, {_ST}")
def project_stats(spark, d):
    """Nodes, links and their types of every project."""
    return projects.stats(load(spark, d))


@query("SELECT p.project_id, p.name, p.created_at, p.updated_at, coalesce(entity_count, 0) AS entity_count, coalesce(relationship_count, 0) AS relationship_count, coalesce(entity_types, '') AS entity_types, coalesce(relationship_types, '') AS relationship_types FROM projects p LEFT JOIN st USING (project_id) ORDER BY coalesce(entity_count, 0) DESC, project_id LIMIT 100", f"{_N}, {_E}, {_ST}")
def list_projects(spark, d):
    """The hundred largest projects with their statistics."""
    return projects.list_projects(table(spark, d, "projects"), load(spark, d), "entity_count")


@query("SELECT 'node' AS kind, type, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type")
def type_breakdown(spark, d):
    """Nodes and links by type."""
    return projects.breakdown(load(spark, d))


@query("SELECT c.project_id, c.id, c.name, w.wmc FROM n c JOIN wmc w ON w.project_id = c.project_id AND w.id = c.id ORDER BY w.wmc DESC, c.project_id, c.id LIMIT 5", f"{_N}, {_E}, {_MEM}, {_WMC}")
def largest_classes(spark, d):
    """The five classes with the most methods."""
    return projects.largest_classes(load(spark, d))


@query("SELECT project_id, id, type, name, source_file FROM n")
def dedupe_first_wins(spark, d):
    """Nodes without repeats: the first scanned of each key."""
    return load(spark, d).nodes.select("project_id", "id", "type", "name", "source_file")


@query("SELECT doc_id, tokens, cum_tokens FROM (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(sum(ceil(length(text) / 4.0)) OVER (ORDER BY doc_id) AS BIGINT) AS cum_tokens FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> '' ORDER BY doc_id LIMIT 1000)) WHERE cum_tokens <= 9900", "x AS (SELECT 1)")
def token_budget_page(spark, d):
    """The longest prefix of a page of documents within the token budget."""
    page = table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", "text").orderBy("doc_id").limit(1000)
    return paging.within_budget(page, ["doc_id"], cost=F.ceil(F.length("text") / 4).cast("bigint")).select("doc_id", "tokens", "cum_tokens")


@query("SELECT project_id, id FROM n ORDER BY project_id, id LIMIT 50 OFFSET 100")
def paginate_nodes(spark, d):
    """One page of fifty nodes."""
    return paging.paginate(load(spark, d).nodes.select("project_id", "id"), ["project_id", "id"], 100, 50)[0].drop("tokens")


# --- semantic ---------------------------------------------------------------------------------------------------

_V = "v AS (SELECT * FROM node_embeddings WHERE semantic_embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY created_at NULLS FIRST) = 1), q AS (SELECT semantic_embedding AS q, project_id AS qp, node_id AS qn FROM v WHERE len(semantic_embedding) = 64 AND list_sum(list_transform(semantic_embedding, lambda z: abs(z))) > 0 ORDER BY vec_id LIMIT 1)"
_SIM = "s AS (SELECT v.project_id, v.node_id, round((list_dot_product(semantic_embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(semantic_embedding::DOUBLE[], semantic_embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) + 1) / 2, 6) AS similarity, qp, qn FROM v, q WHERE len(semantic_embedding) = len(q) AND list_sum(list_transform(semantic_embedding, lambda z: abs(z))) > 0)"


def _query_vector(spark, d):
    v = semantic.usable(table(spark, d, "node_embeddings").where("semantic_embedding is not null"))
    r = v.where((F.size("semantic_embedding") == 64) & (F.aggregate("semantic_embedding", F.lit(0.0), lambda s, x: s + F.abs(x)) > 0)).orderBy("vec_id").limit(1).select("semantic_embedding", "project_id", "node_id").first()
    return v, list(r[0]), r[1], r[2]


@query("SELECT project_id, node_id, similarity FROM s WHERE similarity >= 0.5 ORDER BY similarity DESC, project_id, node_id LIMIT 10", f"{_V}, {_SIM}")
def semantic_search(spark, d):
    """The ten vectors most similar to a query vector."""
    v, q, _, _ = _query_vector(spark, d)
    return semantic.search(v, q, 10, 0.5).withColumn("similarity", F.round("similarity", 6))


@query("SELECT project_id, node_id, similarity FROM s WHERE project_id = qp AND node_id <> qn AND similarity >= 0.5 ORDER BY similarity DESC, node_id LIMIT 5", f"{_V}, {_SIM}")
def similar_nodes(spark, d):
    """The five nodes of a project most similar to one of them."""
    v, _, p, n = _query_vector(spark, d)
    return semantic.similar_nodes(v, n, p, 5, 0.5).withColumn("similarity", F.round("similarity", 6))


@query()
def hybrid_search(spark, d):
    """Semantic search whose hits carry their text and related nodes."""
    v, q, _, _ = _query_vector(spark, d)
    return semantic.hybrid_search(load(spark, d), v, q, 10, 0.5)


@query("""SELECT project_id, id, concat_ws(' | ', nullif(name, ''), CASE WHEN qualified_name IS DISTINCT FROM name THEN nullif(qualified_name, '') END, nullif(description, ''),
 CASE WHEN len(attributes.parameters) > 0 THEN 'Parameters: ' || array_to_string(list_transform(attributes.parameters, lambda p: coalesce(p.name, '') || ': ' || coalesce(p.type, 'any') || CASE WHEN length(p.description) > 0 THEN ' - ' || p.description ELSE '' END), ', ') END,
 CASE WHEN length(attributes.return_type) > 0 THEN 'Returns: ' || attributes.return_type END, CASE WHEN len(annotations) > 0 THEN 'Annotations: ' || coalesce(array_to_string(list_filter(list_transform(annotations, lambda a: a.name), lambda z: z IS NOT NULL), ', '), '') END,
 CASE WHEN len(modifiers) > 0 THEN 'Modifiers: ' || coalesce(array_to_string(list_filter(modifiers, lambda z: z IS NOT NULL), ', '), '') END) AS content FROM n""")
def semantic_content(spark, d):
    """The text of every node that would be embedded."""
    return semantic.contents(load(spark, d).nodes)


@query("SELECT doc_id, CASE WHEN length(text) / 4.0 > 50 THEN substr(text, 1, 200) || '...' ELSE text END AS text FROM documents", "x AS (SELECT 1)")
def truncate_text(spark, d):
    """Documents cut to fifty estimated tokens."""
    return table(spark, d, "documents").select("doc_id", scalar.truncated(F.col("text"), 50).alias("text"))


# --- scalar functions -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT project_id || ':' || id AS scoped, split_part(project_id || ':' || id, ':', 1) AS project, regexp_extract(project_id || ':' || id, '^[^:]*:(.*)$', 1) AS entity, 'Project_' || regexp_replace(project_id, '[^a-zA-Z0-9_]', '_', 'g') || '_' || upper(substr(type, 1, 1)) || substr(type, 2) AS label FROM n")
def scoped_ids(spark, d):
    """Scoped ids, their parts and labels."""
    g = load(spark, d).nodes
    s = scalar.scoped_id(F.col("project_id"), F.col("id"))
    return g.select(s.alias("scoped"), scalar.scoped_project(s).alias("project"), scalar.scoped_entity(s).alias("entity"), scalar.project_label(F.col("project_id"), F.col("type")).alias("label")).distinct()


_LANG = "CASE lower(regexp_extract(regexp_extract(source_file, '([^/]*)$', 1), '(\\.[^.]+)$', 1)) WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' END"
_LG = f"f AS (SELECT DISTINCT file_id, project_id, source_file FROM source_files), l AS (SELECT project_id, {_LANG} AS language, count(*) AS files FROM f GROUP BY ALL)"


@query("SELECT project_id, language, files FROM l WHERE language IS NOT NULL", _LG)
def language_detection(spark, d):
    """Files by project and language of the extension."""
    f = table(spark, d, "source_files").select("file_id", "project_id", "source_file").distinct()
    return f.groupBy("project_id", scalar.language(F.col("source_file")).alias("language")).agg(F.count(F.lit(1)).alias("files")).where("language is not null")


@query("SELECT project_id, language FROM l WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY files DESC, CASE language WHEN 'typescript' THEN 0 WHEN 'javascript' THEN 1 WHEN 'java' THEN 2 ELSE 3 END) = 1", _LG)
def primary_language(spark, d):
    """The language with the most files of every project; ties in the order of declaration."""
    return projects.primary_language(language_detection(spark, d))


_URL = "'https://github.com/' || project_id || '/' || regexp_extract(source_file, '([^/]*)$', 1) || '.git'"


@query(f"SELECT DISTINCT {_URL} AS url, 'github.com' AS host, project_id AS owner, regexp_extract(source_file, '([^/]*)$', 1) AS repo, 'github' AS provider, substr(sha256('github.com/' || project_id || '/' || regexp_extract(source_file, '([^/]*)$', 1) || '/default'), 1, 16) AS cache_key FROM source_files WHERE source_file IS NOT NULL AND project_id IS NOT NULL", "x AS (SELECT 1)")
def git_urls(spark, d):
    """Git addresses made of projects and files, parsed again, with their cache keys."""
    url = F.concat(F.lit("https://github.com/"), F.col("project_id"), F.lit("/"), scalar.basename(F.col("source_file")), F.lit(".git"))
    f = table(spark, d, "source_files").where("source_file is not null and project_id is not null").select(url.alias("url")).distinct()
    h, o, r = (scalar.git_part(F.col("url"), i) for i in (1, 2, 3))
    return f.select("url", h.alias("host"), o.alias("owner"), r.alias("repo"), scalar.git_provider(F.col("url")).alias("provider"), scalar.git_cache_key(h, o, r, F.lit(None)).alias("cache_key"))


@query(r"SELECT method_id, call, count(*) AS n FROM (SELECT DISTINCT method_id, body FROM parsed_methods), unnest(regexp_extract_all(body, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS t(call) WHERE call NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'throw', 'new', 'super', 'this', 'function') GROUP BY ALL", "x AS (SELECT 1)")
def method_calls(spark, d):
    """Names called in every method body, and how often."""
    m = table(spark, d, "parsed_methods").select("method_id", "body").distinct()
    c = m.select("method_id", F.explode(F.regexp_extract_all("body", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))).alias("call"))
    return c.where(~F.col("call").isin("if", "for", "while", "switch", "catch", "return", "throw", "new", "super", "this", "function")).groupBy("method_id", "call").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events", "x AS (SELECT 1)")
def json_attributes(spark, d):
    """Attributes decoded from JSON text."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), scalar.is_json(F.col("props")).alias("valid"))


# --- extraction and frameworks ----------------------------------------------------------------------------------


def _scan(spark: SparkSession, d: str):
    from weftgraph.extract.entities import scan

    return scan(table(spark, d, "source_files").select("project_id", "source_file", "text"))


@query()
def extract_nodes(spark, d):
    """Nodes of all source files."""
    return _scan(spark, d)[0].nodes.select("project_id", "id", "type", "name", "source_file", "start_line", "end_line")


@query()
def extract_edges(spark, d):
    """Links of all source files."""
    return _scan(spark, d)[0].edges.select("project_id", "id", "type", "source", "target")


@query()
def extract_errors(spark, d):
    """Files that could not be parsed."""
    return _scan(spark, d)[1]


def _values(rows) -> str:
    """Rows as SQL values."""
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_LATEST = {(lang, a): (lang, a, fw, order) for lang, fw, order, a, _ in frameworks.annotation_rows()}
_EXT = _LANG.replace("source_file", "file")
_FW = f"""{_N}, k(language, annotation, framework, ord) AS (VALUES {_values(_LATEST.values())}),
 a AS (SELECT source_file AS file, regexp_replace(trim(x.name), '^@', '') AS name FROM (SELECT source_file, unnest(annotations) AS x FROM n WHERE source_file IS NOT NULL)),
 f AS (SELECT file, framework, min(ord) AS ord, count(*) AS c FROM (SELECT file, name, CASE {_EXT} WHEN 'javascript' THEN 'typescript' ELSE {_EXT} END AS language FROM a) t JOIN k ON k.annotation = t.name AND k.language = t.language GROUP BY file, framework),
 b AS (SELECT file, framework, least(90, 20 * c) AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY file ORDER BY c DESC, ord) = 1)"""


@query("SELECT file, framework, CAST(confidence AS INTEGER) AS confidence FROM b", _FW)
def framework_from_annotations(spark, d):
    """The framework of every file by its annotations."""
    a = load(spark, d).nodes.where("source_file is not null").select(F.col("source_file").alias("file"), F.explode("annotations").alias("x"))
    lang = scalar.language(F.col("file"))
    rows = a.select("file", F.col("x.name").alias("name"), F.when(lang == "javascript", "typescript").otherwise(lang).alias("language"))
    return frameworks.by_annotations(rows, frameworks.framework_annotations(spark)).drop("module_order")


_PAT = [(fw, frameworks._regex(p), c, i) for i, ((lang, fw), ps) in enumerate(frameworks.IMPORTS.items()) if lang == "java" for p, c in ps.items()]
_IMP = rf"""i AS (SELECT DISTINCT file_id AS file, unnest(regexp_extract_all(text, '(?m)^import (?:static )?([a-z][A-Za-z0-9_.]*)', 1)) AS module FROM source_files WHERE source_file LIKE '%.java'),
 p(framework, regex, confidence, ord) AS (VALUES {_values(_PAT)}), b AS (SELECT file, framework, confidence FROM i JOIN p ON regexp_matches(i.module, p.regex) QUALIFY row_number() OVER (PARTITION BY file ORDER BY confidence DESC, ord) = 1)"""


@query("SELECT file, framework, confidence FROM b", _IMP)
def framework_from_imports(spark, d):
    """The framework of every Java file by its imports."""
    f = table(spark, d, "source_files").where("source_file like '%.java'").select(F.col("file_id").alias("file"), "text").distinct()
    i = f.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^import (?:static )?([a-z][A-Za-z0-9_.]*)"), F.lit(1))).alias("module"), F.lit("java").alias("language")).distinct()
    return frameworks.by_imports(i, frameworks.framework_imports(spark)).drop("module_order")
