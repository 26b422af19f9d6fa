import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar as S
from weftgraph.operators import paging, semantic


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col.alias("x")).first().x


def test_scoped_ids(spark):
    assert one(spark, S.scoped_id(F.col("a"), F.col("b")), a="p", b="x:y") == "p:x:y"
    assert one(spark, S.scoped_project(F.col("a")), a="p:x:y") == "p" and one(spark, S.scoped_entity(F.col("a")), a="p:x:y") == "x:y"
    assert one(spark, S.scoped_entity(F.col("a")), a="none") is None
    assert one(spark, S.project_label(F.col("a"), F.lit("class")), a="my-app") == "Project_my_app_Class"


@pytest.mark.parametrize("url, parts", [("https://github.com/o/r.git", ("https", "github", "github.com", "o", "r")), ("git@gitlab.com:o/r.git", ("ssh", "gitlab", "gitlab.com", "o", "r")), ("ssh://git@h.org/o/r", ("ssh", "generic", "h.org", "o", "r")), ("git://bitbucket.org/o/r.git", ("git", "bitbucket", "bitbucket.org", "o", "r")), ("https://u:t@github.com/o/r/", ("https", "github", "github.com", "o", "r")), ("nonsense", (None,) * 5), ("https://github.com/o", (None,) * 5)])
def test_git_urls(spark, url, parts):
    u = F.col("u")
    r = spark.createDataFrame([(url,)], "u string").select(S.git_protocol(u), S.git_provider(u), S.git_part(u, 1), S.git_part(u, 2), S.git_part(u, 3)).first()
    assert tuple(r) == parts
    assert one(spark, S.is_git_url(F.col("u")), u=url) == (parts[0] is not None)


def test_paths(spark):
    assert one(spark, S.extension(F.col("p")), p="a.b/C.JAVA") == ".java" and one(spark, S.extension(F.col("p")), p="a.b/Makefile") == ""
    assert one(spark, S.language(F.col("p")), p="x/y.tsx") == "typescript" and one(spark, S.language(F.col("p")), p="x") is None
    assert one(spark, S.basename(F.col("p")), p="a/b.c") == "b.c" and one(spark, S.dirname(F.col("p")), p="a/b/c") == "a/b"


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, S.cosine(v(1, 0), v(0, 1))) == 0.5 and one(spark, S.cosine(v(1, 0), v(-2, 0), "raw")) == -1.0
    assert one(spark, S.cosine(v(0, 0), v(1, 0))) is None and one(spark, S.cosine(v(1), v(1, 0))) is None


def test_truncation(spark):
    assert one(spark, S.truncated(F.col("t"), 2), t="x" * 8) == "x" * 8 and one(spark, S.truncated(F.col("t"), 2), t="x" * 9) == "x" * 8 + "..."


def test_embedding_text(spark):
    df = spark.sql("select 'f' name, 'a.f' qn, '' d, array(named_struct('name', 'x', 'type', 'int', 'description', 'the x'), named_struct('name', 'y', 'type', cast(null as string), 'description', '')) p, 'void' r, array(named_struct('name', '@A')) a, array('public') m")
    cols = [F.col(c) for c in ("name", "qn", "d", "p", "r", "a", "m")]
    assert df.select(S.embedding_text(*cols)).first()[0] == "f | a.f | Parameters: x: int - the x, y: any | Returns: void | Annotations: @A | Modifiers: public"
    df = spark.sql("select 'f' name, 'f' qn, cast(null as string) d, cast(null as array<struct<name string, type string, description string>>) p, cast(null as string) r, cast(null as array<struct<name string>>) a, cast(null as array<string>) m")
    assert df.select(S.embedding_text(*cols)).first()[0] == "f"


def test_token_budget(spark):
    df = spark.createDataFrame([(i, "x" * 40 if i != 3 else None) for i in range(5)], "id int, t string")
    cost = df.select("id", paging.estimated_tokens("id", "t").alias("c")).orderBy("id").collect()
    assert [r.c for r in cost] == [14, 14, 14, 5, 14]
    assert paging.within_budget(df, ["id"], 128).count() == 2 and paging.within_budget(df, ["id"], 127).count() == 1 and paging.within_budget(df, ["id"], 28, metadata=False).count() == 2
    page, meta = paging.paginate(df, ["id"], 1, 2)
    assert [r.id for r in page.collect()] == [1, 2] and meta == {"total": 5, "returned": 2, "has_more": True, "next_offset": 3, "truncated": False}
    assert paging.paginate(df, ["id"], 1, 4, 128)[1] == {"total": 5, "returned": 2, "has_more": True, "next_offset": 3, "truncated": True}
    assert paging.paginate(df, ["id"], 9)[1]["next_offset"] is None


def test_semantic(spark):
    rows = [("p", "a", [1.0, 0.0]), ("p", "b", [1.0, 0.1]), ("p", "c", [0.0, 1.0]), ("p", "z", [0.0, 0.0]), ("p", "n", None), ("q", "a", [1.0, 0.0]), ("p", "long", [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "project_id string, node_id string, semantic_embedding array<float>")
    assert [(r.project_id, r.node_id) for r in semantic.search(v, [2.0, 0.0]).collect()] == [("p", "a"), ("q", "a"), ("p", "b")]
    assert [r.node_id for r in semantic.search(v, [2.0, 0.0], 1, project="q").collect()] == ["a"]
    assert [r.node_id for r in semantic.similar_nodes(v, "a", "p", 5, 0.5).collect()] == ["b", "c"]
    with pytest.raises(LookupError):
        semantic.similar_nodes(v, "n", "p")


def test_embedding_nodes(spark):
    n = spark.sql("select 'p' project_id, 'a' id, 'class' type, 'Ant' name, 'Ant' qualified_name, cast(null as string) description, cast(null as array<string>) modifiers, cast(null as array<struct<name string>>) annotations, cast(null as struct<parameters array<struct<name string, type string, description string>>, return_type string>) attributes")
    more = n.withColumn("type", F.lit("package")).unionByName(n).unionByName(n.withColumn("name", F.lit("boom")))

    def provider(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError
        return semantic.hash_provider(8)(texts)

    e = semantic.embed(more, provider, semantic.EmbeddingConfig(batch_size=1))
    assert e.count() == 2 and tuple(semantic.update_counts(e).first()) == (1, 1)
    assert semantic.EmbeddingConfig.of("openai", "text-embedding-3-large").dimensions == 3072
