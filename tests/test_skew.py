from pyspark.sql import functions as F

from weftgraph.operators import skew


def test_hot_key_and_nulls(spark):
    rows = [("h", i) for i in range(90)] + [(f"k{i}", None) for i in range(60)] + [(None, 1)] * 500
    df = spark.createDataFrame(rows, "n_rows string, key int")
    got = {r.key: r for r in skew.key_shares(df, "n_rows", {"s": F.sum("key")}).collect()}
    assert got["h"].n_rows == 90 and got["h"].hot and got["h"].s == sum(range(90)) and got["h"].share == 0.6
    assert not got["k1"].hot and got["k1"].s is None and None not in got
    assert {r.key: r.n_distinct for r in skew.distinct_per_key(df, "n_rows", "key").collect()}["h"] == 90


def test_share_at_the_limit_is_hot(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 97, "k string")
    assert {r.key for r in skew.key_shares(df, "k").where("hot").collect()} == {"a", "b"}


def test_empty(spark):
    assert skew.key_shares(spark.createDataFrame([], "k string"), "k").count() == 0
