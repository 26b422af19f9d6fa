"""Statistics of annotations: frameworks, categories, deprecation, tests and testability.

Predicates follow three-valued logic: ``NOT any(...)`` over annotations with a null category is unknown, so such nodes
drop out of coverage and testability, as in the query language of the domain. Samples take the smallest names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, ends
from weftgraph.session import written

#: Spellings of the deprecation mark (fixed values); 'Deprecated' is that of loaders that drop the sign.
DEPRECATED = ("@Deprecated", "deprecated", "@deprecated", "Deprecated")
#: The spellings that an exclusion of deprecated annotations takes.
EXCLUDED_DEPRECATED = ("@Deprecated", "deprecated")
DEPENDENCY_TYPES = ("calls", "references", "extends", "implements")


def exploded(g: Graph) -> DataFrame:
    """One row per node and annotation: ``project_id, id, qualified_name, name, kind, framework, category``."""
    a = g.nodes.select("project_id", "id", "qualified_name", F.explode("annotations").alias("a"))
    return a.select("project_id", "id", "qualified_name", F.col("a.name").alias("name"), F.col("a.type").alias("kind"), F.col("a.framework").alias("framework"), F.col("a.category").alias("category"))


def _sample(col: str, n: int) -> Column:
    return F.array_join(F.slice(F.sort_array(F.collect_set(col)), 1, n), ",")


def _top_names(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` smallest distinct qualified names per key, cut before the shuffle so that a hot key stays small."""
    from pyspark.sql.window import Window as W

    some = rows.where("qualified_name is not null").select(*keys, "qualified_name").distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("qualified_name"))
    few = some.withColumn("r", rank).where(F.col("r") <= n)
    return few.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("qualified_name")), ",").alias("sample_nodes"))


def _counted(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("usage_count"))
    names = _top_names(rows, keys, n)
    on = None
    for k in keys:
        c = counts[k].eqNullSafe(names[k])
        on = c if on is None else on & c
    return counts.join(names, on, "left").select(*[counts[k] for k in keys], "usage_count", F.coalesce("sample_nodes", F.lit("")).alias("sample_nodes"))


def framework_usage(g: Graph, min_usage: int = 1) -> DataFrame:
    """``framework, name, category, usage_count, sample_nodes, total_usage``: annotations of frameworks used often enough.

    ``total_usage`` sums the framework's rows that are left. Annotations without framework don't count.
    """
    c = _counted(exploded(g).where("framework is not null"), ["framework", "name", "category"], 5).where(F.col("usage_count") >= min_usage)
    c = written(c, "usage")
    return c.join(c.groupBy("framework").agg(F.sum("usage_count").alias("total_usage")), "framework")


def annotation_usage(g: Graph, by: str = "annotation", category: str | None = None, framework: str | None = None, include_deprecated: bool = True) -> DataFrame:
    """Usage by 'annotation', 'category' (a null one is a group) or 'framework' (a null one isn't)."""
    rows = exploded(g)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if framework is not None:
        rows = rows.where(F.col("framework") == framework)
    if not include_deprecated:
        rows = rows.where(~F.col("name").isin(*EXCLUDED_DEPRECATED))
    if by == "annotation":
        return _counted(rows, ["name", "framework", "category", "kind"], 5)
    if by == "framework":
        rows = rows.where("framework is not null")
    keys = {"category": ["category", "name", "framework"], "framework": ["framework", "name", "category"]}[by]
    inner = written(_counted(rows, keys, 3), "usage")
    total = inner.groupBy(F.col(by).alias("k")).agg(F.sum("usage_count").alias("total_usage"), F.count(F.lit(1)).alias("distinct_annotations"))
    return inner.join(total, inner[by].eqNullSafe(total["k"])).drop("k")


def _deprecated(g: Graph, node_type: str | None = None) -> DataFrame:
    n = g.nodes if node_type is None else g.typed(node_type)
    return n.where(F.exists("annotations", lambda a: a["name"].isin(*DEPRECATED)))


def deprecated_code(g: Graph, node_type: str | None = None) -> DataFrame:
    """Deprecated nodes with the number of distinct dependents (node, kind of link); 0 without any."""
    d = _deprecated(g, node_type).select("project_id", "id", "qualified_name", "type", F.get(F.filter("annotations", lambda a: a["name"].isin(*DEPRECATED)), F.lit(0))["name"].alias("mark"))
    e = g.links(*DEPENDENCY_TYPES).select("project_id", "source", F.col("target").alias("id"), F.col("type").alias("rel")).distinct()
    using = e.join(d.select("project_id", "id"), ["project_id", "id"], "left_semi").join(ends(g.nodes, "source", "qualified_name", "type"), ["project_id", "source"])
    n = using.select("project_id", "id", "source_qualified_name", "rel", "source_type").distinct().groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("dependency_count"))
    return d.join(n, ["project_id", "id"], "left").withColumn("dependency_count", F.coalesce("dependency_count", F.lit(0)))


def deprecated_usage(g: Graph) -> DataFrame:
    """Deprecated nodes that something depends on: links to them (as often as linked) and sample users."""
    d = _deprecated(g).select("project_id", "id", F.col("qualified_name").alias("deprecated_node"), F.col("type").alias("deprecated_type"))
    e = g.links(*DEPENDENCY_TYPES).select("project_id", "source", F.col("target").alias("id"))
    u = e.join(d, ["project_id", "id"]).join(ends(g.nodes, "source", "qualified_name"), ["project_id", "source"])
    return u.groupBy("project_id", "id", "deprecated_node", "deprecated_type").agg(F.count(F.lit(1)).alias("usage_count"), F.min("source_qualified_name").alias("first_user"))


def testing_entities(g: Graph, framework: str | None = None) -> DataFrame:
    """Nodes with a testing annotation (of the framework, if given): names and number of their testing annotations."""
    holds = lambda a: (a["category"] == "testing") if framework is None else (a["category"] == "testing") & (a["framework"] == framework)
    n = g.nodes.where(F.exists("annotations", holds))
    tests = F.filter("annotations", lambda a: a["category"] == "testing")
    return n.select("project_id", "id", "qualified_name", "type", F.size(tests).cast("bigint").alias("annotation_count"), F.array_join(F.transform(tests, lambda a: F.coalesce(a["name"], F.lit(""))), ",").alias("test_annotations"))


def testing_frameworks(g: Graph) -> DataFrame:
    """Uses of testing annotations by framework and name, with the framework's total (a null framework is a group)."""
    t = exploded(g).where("category = 'testing'").groupBy("framework", "name").agg(F.count(F.lit(1)).alias("usage_count"))
    t = written(t, "testing")
    total = t.groupBy(F.col("framework").alias("k")).agg(F.sum("usage_count").alias("total_usage"))
    return t.join(total, t["framework"].eqNullSafe(total["k"])).drop("k")


#: Substrings are joined by equality up to this length; longer names by their start, then compared whole.
GRAM = 16


def coverage(g: Graph) -> DataFrame:
    """Per project: methods, those whose name occurs in a test method's (qualified) name, and the rounded percentage.

    Methods with testing annotations, or with 'test' or 'Test' in the qualified name, aren't counted. Substrings of test
    names of the lengths that method names have are joined by equality, instead of comparing every pair.
    """
    testing = F.exists(F.coalesce("annotations", F.array()), lambda a: a["category"] == "testing")
    methods = g.typed("method").select("project_id", "id", "name", "qualified_name", testing.alias("is_test"))
    tests = methods.where("is_test").select("project_id", "qualified_name", "name")
    plain = methods.where(~F.col("is_test") & ~F.contains("qualified_name", F.lit("test")) & ~F.contains("qualified_name", F.lit("Test"))).select("project_id", "id", "name")
    names = plain.where("name is not null").select("project_id", "name").distinct().withColumn("gram", F.substring("name", 1, GRAM))
    lengths = sorted(r[0] for r in names.select(F.length("gram").alias("n")).distinct().collect() if r[0])  # at most GRAM values
    texts = tests.select("project_id", F.explode(F.array("qualified_name", "name")).alias("text")).where("text is not null").distinct()
    empty = names.where("name = ''").join(texts.select("project_id"), "project_id", "left_semi").select("project_id", "name")
    if lengths:
        grams = F.flatten(F.array(*[_grams("text", n) for n in lengths]))
        pieces = texts.select("project_id", "text", F.explode(F.array_distinct(grams)).alias("gram"))
        short = pieces.select("project_id", "gram").distinct()
        hit = names.where(F.length("name") <= GRAM).join(short, ["project_id", "gram"], "left_semi").select("project_id", "name")
        long = names.where(F.length("name") > GRAM).join(pieces, ["project_id", "gram"]).where(F.contains("text", F.col("name"))).select("project_id", "name").distinct()
        hit = hit.unionByName(long).unionByName(empty)
    else:
        hit = empty
    flag = plain.join(hit.distinct().withColumn("tested", F.lit(1)), ["project_id", "name"], "left")
    out = flag.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_methods"), F.count("tested").alias("methods_with_tests"))
    pct = F.round(F.try_divide(F.lit(100.0).cast("double") * F.col("methods_with_tests"), F.col("total_methods")))
    return out.withColumn("methods_without_tests", F.col("total_methods") - F.col("methods_with_tests")).withColumn("coverage_percentage", pct)


def _grams(col: str, n: int) -> Column:
    at = F.when(F.length(col) >= n, F.sequence(F.lit(1), F.length(col) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(F.col(col), i, F.lit(n)))


def untestable(g: Graph) -> DataFrame:
    """Methods and functions without testing annotations by what hinders tests: ``project_id, concern, n_methods, sample_nodes``."""
    n = g.typed("method", "function").where(~F.exists(F.coalesce("annotations", F.array()), lambda a: a["category"] == "testing"))
    has = lambda m: F.exists(F.coalesce("modifiers", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) == m)
    concern = F.when(has("private"), "private").when(has("static"), "static").when(F.contains("qualified_name", F.lit("__")), "private_python").when(F.size(F.coalesce("attributes.parameters", F.array())) > 10, "too_many_parameters")
    rows = n.select("project_id", concern.alias("concern"), "qualified_name").where("concern is not null")
    return _counted(rows, ["project_id", "concern"], 5).withColumnRenamed("usage_count", "n_methods")


def testing_summary(g: Graph) -> DataFrame:
    """Testing entities, frameworks and annotations in all."""
    e = testing_entities(g).agg(F.count(F.lit(1))).scalar()
    f = testing_frameworks(g).agg(F.count_distinct(F.coalesce("framework", F.lit(""))).alias("frameworks_used"), F.coalesce(F.sum("usage_count"), F.lit(0)).alias("total_testing_annotations"))
    return f.select(e.alias("total_test_entities"), "*")
