"""Per-key results when a handful of keys hold most rows (problem 4).

Only algebraic aggregates are used (count, sum, min, max, avg), so every task keeps one small state per key it
has seen in a hash table; Spark's partial aggregation spills those states when they outgrow memory, and only
states are shuffled, never rows. A key with a third of all rows therefore reaches its reducer as one state per
map task, and no task runs longer than the others. Distinct counts are made in two such steps (key and value,
then key), which keeps them skew-free as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows that have a key.
HOT_SHARE = 0.03


def per_key(df: DataFrame, key: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct non-null value of ``key``: ``key``, ``n_rows`` and the given algebraic measures.

    Rows with a null key are left out. Repeated rows count as often as they are stored. An empty table gives no
    rows. Columns of ``df`` named like an output column do no harm: they're read before anything is renamed.
    """
    measures = measures or {}
    aggs = [F.count(F.lit(1)).alias("n_rows"), *(m.alias(n) for n, m in measures.items())]
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(*aggs)


def key_shares(df: DataFrame, key: str, measures: dict[str, Column] | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """:func:`per_key` with ``share`` of the rows that have a key, and ``hot`` where it reaches ``hot_share``.

    The total is a scalar subquery over the per-key counts, so the table is shuffled once (the exchange is reused).
    """
    counts = per_key(df, key, measures)
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()
    share = F.try_divide(F.col("n_rows").cast("double"), total)
    return counts.withColumn("share", share).withColumn("hot", F.col("n_rows") >= F.lit(hot_share) * total)


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``n_distinct`` non-null values of ``value``, in two algebraic steps.

    The first groups by key *and* value, which spreads a hot key over all reducers; the second counts.
    """
    pairs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).alias("__v"))
    return pairs.groupBy("key", "__v").agg(F.lit(1).alias("__one")).groupBy("key").agg(F.count("__v").alias("n_distinct"))
