"""Software metrics of all classes and packages at once, architectural issues, and quality rules.

One row per class: every measure is an aggregate on ``(project_id, class id)``, joined to the classes from the left.
``lift`` moves the ends of calls and references from members to the class that contains them, since extraction
links methods and fields rather than classes; without it the links are taken as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, ends, symmetric
from weftgraph.operators import traverse
from weftgraph.session import written

KEY = ["project_id", "id"]
#: Texts of the issues (fixed values: part of the interface).
CYCLE_TEXT = "Circular dependency detected in package: "
GOD_TEXT = "God class detected: %s (%d methods, %d couplings)"
HIGH_TEXT = "Highly coupled class: %s (%d couplings)"
#: Thresholds of the rules (fixed values of the domain).
GOD_METHODS, GOD_COUPLING, HIGH_COUPLING, CRITICAL_COUPLING = 20, 10, 15, 25
CK_LIMITS = (("wmc", 15.0), ("dit", 4.0), ("noc", 7.0), ("cbo", 10.0), ("rfc", 30.0), ("lcom", 0.7))


def _classes(g: Graph) -> DataFrame:
    return g.typed("class").select("project_id", "id", "name", "qualified_name")


def _members(g: Graph, member: str) -> DataFrame:
    """``project_id, id, member``: contains links from classes to members of a type (as often as linked)."""
    e = g.links("contains").join(ends(g.typed(member), "target"), ["project_id", "target"]).join(ends(g.typed("class"), "source"), ["project_id", "source"])
    return e.select("project_id", F.col("source").alias("id"), F.col("target").alias("member"))


def couplings(g: Graph, lift: bool = False) -> DataFrame:
    """Distinct ``project_id, a, b``: classes that call or refer to each other, in both directions."""
    e = g.links("calls", "references").select("project_id", "source", "target").where("source is not null and target is not null").distinct()
    own = g.typed("class").select("project_id", F.col("id").alias("member"), F.col("id").alias("cls"))
    if lift:
        m = g.links("contains").join(ends(g.typed("class"), "source"), ["project_id", "source"]).select("project_id", F.col("target").alias("member"), F.col("source").alias("cls"))
        own = own.unionByName(m).distinct()
    s, t = own.select("project_id", F.col("member").alias("source"), F.col("cls").alias("a")), own.select("project_id", F.col("member").alias("target"), F.col("cls").alias("b"))
    pairs = e.join(s, ["project_id", "source"]).join(t, ["project_id", "target"]).select("project_id", F.col("a").alias("source"), F.col("b").alias("target"))
    return symmetric(pairs).distinct()


def wmc(g: Graph) -> DataFrame:
    """Links from a class to its methods."""
    return _members(g, "method").groupBy(*KEY).agg(F.count(F.lit(1)).alias("wmc"))


def dit(g: Graph) -> DataFrame:
    """Length of the longest trail of extends links."""
    return traverse.longest_lines(g).select(*KEY, F.col("hops").alias("dit"))


def noc(g: Graph) -> DataFrame:
    """Extends links from nodes to a class."""
    e = g.links("extends").join(ends(g.nodes, "source"), ["project_id", "source"])
    return e.groupBy("project_id", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("noc"))


def cbo(g: Graph, lift: bool = False) -> DataFrame:
    """Distinct other classes that call or refer to a class or the other way round."""
    return couplings(g, lift).where("a <> b").groupBy("project_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("cbo"))


def rfc(g: Graph) -> DataFrame:
    """Distinct methods of a class plus distinct methods that those call."""
    own = _members(g, "method").distinct()
    n = own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("own"))
    calls = g.links("calls").select("project_id", F.col("source").alias("member"), "target").distinct().join(ends(g.typed("method"), "target"), ["project_id", "target"])
    called = own.join(calls, ["project_id", "member"]).select(*KEY, "target").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("called"))
    return n.join(called, KEY, "left").select(*KEY, (F.col("own") + F.coalesce("called", F.lit(0))).alias("rfc"))


def lcom(g: Graph) -> DataFrame:
    """Methods beyond the number of fields, 0 if there are none of either."""
    m = _members(g, "method").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"))
    f = _members(g, "field").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("f"))
    return m.join(f, KEY).select(*KEY, F.greatest(F.lit(0).cast("bigint"), F.col("m") - F.col("f")).alias("lcom"))


def ck_metrics(g: Graph, lift: bool = False) -> DataFrame:
    """All six measures of every class; missing ones are 0."""
    g = g.once()
    out = _classes(g)
    for name, part in (("wmc", wmc(g)), ("dit", dit(g)), ("noc", noc(g)), ("cbo", cbo(g, lift)), ("rfc", rfc(g)), ("lcom", lcom(g))):
        out = out.join(part, KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def _inside(g: Graph) -> DataFrame:
    """``project_id, id, package``: every package whose dotted prefix a node's qualified name has (nested ones too)."""
    packs = g.typed("package").select("project_id", F.col("qualified_name").alias("package")).where("package is not null").distinct()
    part = F.split("qualified_name", "[.]")
    some = g.nodes.where(F.size(part) > 1)
    prefixes = some.select("project_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda n: F.array_join(F.slice(part, F.lit(1), n), "."))).alias("package"))
    return prefixes.join(packs, ["project_id", "package"])


def package_coupling(g: Graph) -> DataFrame:
    """``project_id, package, ca, ce``: distinct nodes outside that call or refer to a node inside, and the reverse."""
    inside = written(_inside(g), "inside")
    e = g.links("calls", "references").select("project_id", "source", "target").distinct()
    e = e.join(ends(g.nodes, "source"), ["project_id", "source"]).join(ends(g.nodes, "target"), ["project_id", "target"])
    s = inside.select("project_id", F.col("id").alias("source"), "package")
    t = inside.select("project_id", F.col("id").alias("target"), "package")
    into = e.join(t, ["project_id", "target"]).join(s, ["project_id", "source", "package"], "left_anti")
    outof = e.join(s, ["project_id", "source"]).join(t, ["project_id", "target", "package"], "left_anti")
    ca = into.select("project_id", "package", "source").distinct().groupBy("project_id", "package").agg(F.count(F.lit(1)).alias("ca"))
    ce = outof.select("project_id", "package", "target").distinct().groupBy("project_id", "package").agg(F.count(F.lit(1)).alias("ce"))
    packs = g.typed("package").select("project_id", F.col("qualified_name").alias("package")).where("package is not null").distinct()
    zero = F.lit(0).cast("bigint")
    return packs.join(ca, ["project_id", "package"], "left").join(ce, ["project_id", "package"], "left").withColumns({"ca": F.coalesce("ca", zero), "ce": F.coalesce("ce", zero)})


def package_metrics(g: Graph) -> DataFrame:
    """``ca, ce, instability, abstractness, distance`` of every package."""
    g = g.once()
    c = g.typed("class").select(*KEY, F.coalesce(F.exists("modifiers", lambda m: F.lower(F.trim(m)) == "abstract"), F.lit(False)).alias("abstract"))
    cls = _inside(g).join(c, KEY).groupBy("project_id", "package").agg(F.count_if("abstract").alias("n_abstract"), F.count(F.lit(1)).alias("n_classes"))
    p = package_coupling(g).join(cls, ["project_id", "package"], "left")
    i = F.coalesce(F.try_divide(F.col("ce").cast("double"), F.col("ca") + F.col("ce")), F.lit(0.0))
    a = F.coalesce(F.try_divide(F.col("n_abstract").cast("double"), F.col("n_classes")), F.lit(0.0))
    return p.select("project_id", "package", "ca", "ce", i.alias("instability"), a.alias("abstractness"), F.abs(a + i - 1).alias("distance"))


def god_classes(g: Graph, methods: int = GOD_METHODS, coupling: int = GOD_COUPLING, lift: bool = False) -> DataFrame:
    """Classes with more methods and more couplings (itself allowed) than the limits."""
    m = wmc(g).where(F.col("wmc") > methods)
    c = couplings(g, lift).groupBy("project_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("coupling")).where(F.col("coupling") > coupling)
    return _classes(g).join(m, KEY).join(c, KEY).select(*KEY, "name", F.col("wmc").alias("method_count"), "coupling")


def high_coupling(g: Graph, more_than: int = HIGH_COUPLING, critical: int = CRITICAL_COUPLING, lift: bool = False) -> DataFrame:
    c = couplings(g, lift).groupBy("project_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("coupling")).where(F.col("coupling") > more_than)
    return _classes(g).join(c, KEY).select(*KEY, "name", "coupling", F.when(F.col("coupling") > critical, "critical").otherwise("high").alias("severity"))


def issues(g: Graph, lift: bool = False, **limits: int) -> DataFrame:
    """``project_id, issue, severity, entity, description``: package cycles, god classes, high coupling."""
    g = g.once()
    k = lambda *names: {n: limits[n] for n in names if n in limits}
    cyc = traverse.package_cycles(traverse.package_links(g)).select("project_id", F.lit("circular_dependency").alias("issue"), F.lit("high").alias("severity"), F.col("package").alias("entity"), F.concat(F.lit(CYCLE_TEXT), F.col("package")).alias("description"))
    god = god_classes(g, lift=lift, **k("methods", "coupling")).select("project_id", F.lit("god_class").alias("issue"), F.lit("high").alias("severity"), F.col("id").alias("entity"), F.format_string(GOD_TEXT, "name", "method_count", "coupling").alias("description"))
    high = high_coupling(g, lift=lift, **k("more_than", "critical")).select("project_id", F.lit("high_coupling").alias("issue"), "severity", F.col("id").alias("entity"), F.format_string(HIGH_TEXT, "name", "coupling").alias("description"))
    return cyc.unionByName(god).unionByName(high)


def totals(g: Graph) -> DataFrame:
    """Classes, methods and packages per project, in one pass."""
    return g.nodes.groupBy("project_id").agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in (("class", "classes"), ("method", "methods"), ("package", "packages"))])


def averages(g: Graph, lift: bool = False) -> DataFrame:
    """Average cbo, rfc and dit per project; classes without ancestors have no dit and don't count for its average.

    The coupling here may include the class itself, as in the totals of the domain.
    """
    g = g.once()
    c = couplings(g, lift).groupBy("project_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("cbo"))
    all_ = _classes(g).join(c, KEY, "left").join(rfc(g), KEY, "left").join(dit(g), KEY, "left")
    zero = F.lit(0)
    return all_.groupBy("project_id").agg(F.avg(F.coalesce("cbo", zero)).alias("avg_cbo"), F.avg(F.coalesce("rfc", zero)).alias("avg_rfc"), F.coalesce(F.avg("dit"), F.lit(0.0)).alias("avg_dit"))


def summary(g: Graph, lift: bool = False, **limits: int) -> DataFrame:
    """Totals, averages, number of issues, score and band of every project."""
    g = g.once()
    n = issues(g, lift, **limits).groupBy("project_id").agg(F.count(F.lit(1)).alias("issues"))
    s = totals(g).join(averages(g, lift), "project_id", "left").join(n, "project_id", "left")
    s = s.fillna(0.0, ["avg_cbo", "avg_rfc", "avg_dit"]).withColumn("issues", F.coalesce("issues", F.lit(0).cast("bigint")))
    score = quality_score(F.col("avg_cbo"), F.col("avg_rfc"), F.col("avg_dit"), F.col("issues"))
    return s.withColumn("score", score).withColumn("band", quality_band(F.col("score")))


def quality_score(avg_cbo: Column, avg_rfc: Column, avg_dit: Column, n_issues: Column) -> Column:
    """100, less 20, 15 and 10 for high averages and 5 for each issue, at least 0."""
    off = lambda c, most, by: F.when(c > most, by).otherwise(0)
    return F.greatest(F.lit(0).cast("bigint"), (F.lit(100) - off(avg_cbo, 10, 20) - off(avg_rfc, 30, 15) - off(avg_dit, 4, 10) - 5 * n_issues).cast("bigint"))


def quality_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("critical")


def scan_score(n_issues: Column) -> Column:
    """The score of a scanned repository: 100 less 5 for each issue, from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 5 * n_issues))


def assess_ck(ck: DataFrame) -> DataFrame:
    """``project_id, id, findings``: measures above their limits, joined by comma, or 'healthy'."""
    hits = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) > limit, n) for n, limit in CK_LIMITS])), ",")
    return ck.select(*KEY, F.when(hits == "", "healthy").otherwise(hits).alias("findings"))


def assess_packages(p: DataFrame) -> DataFrame:
    """``project_id, package, findings`` by instability, abstractness, distance and isolation."""
    i, a, d = F.col("instability"), F.col("abstractness"), F.col("distance")
    rules = [F.when((i > 0.7) & (a < 0.3), "zone_of_pain"), F.when((i < 0.3) & (a > 0.7), "zone_of_uselessness"), F.when(d > 0.7, "off_main_sequence"), F.when((F.col("ca") == 0) & (F.col("ce") == 0), "isolated")]
    hits = F.array_join(F.array_compact(F.array(*rules)), ",")
    return p.select("project_id", "package", F.when(hits == "", "balanced").otherwise(hits).alias("findings"))


def rendered(ck: DataFrame, decimals: int = 2) -> DataFrame:
    """One line of text per class."""
    fmt = f"%s: WMC %d, DIT %d, NOC %d, CBO %d, RFC %d, LCOM %.{decimals}f"
    return ck.select(*KEY, F.format_string(fmt, "name", "wmc", "dit", "noc", "cbo", "rfc", F.col("lcom").cast("double")).alias("line"))
