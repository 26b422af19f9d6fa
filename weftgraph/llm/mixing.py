"""Mixing sources to target weights (problem 9): weighted fair queueing.

Documents of a source are shuffled (by a hash) and queue one after another; a document's virtual finish time is
the number of its source's tokens up to its end, divided by the source's target weight. A source that is short is
queued again, at most ``max_repeats`` times in all. Served by virtual finish time, every prefix of the mixture holds
the sources by weight; the mixture ends when the budget is used up. When a source runs out, the rest goes on, sharing
by their weights.

Neither the cumulative tokens per source nor the global order runs through one task: both are made of bucket sums
(buckets of bounded size, whose sums are a small table) plus sums within a bucket, so a source with a third of
all documents is spread like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.llm.packing import sized
from weftgraph.llm.tokens import TOKENIZER, TOKENIZER_DIR
from weftgraph.session import written

#: Documents of one bucket, on average.
BUCKET_DOCS = 20_000
#: At most so many buckets; their sums are what a single task adds up.
MAX_BUCKETS = 65_536


def normal_source(source: Column) -> Column:
    """Source names without variants of case, separator and surrounding blanks."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_"), F.lit(""))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 42, budget: int | None = None, folder: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER, bucket_docs: int = BUCKET_DOCS) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``docs`` has ``doc_id, source, text``; ``targets`` has ``source, target_share, max_repeats`` (one row per source,
    null or non-positive shares and repeats are left out). ``budget`` in tokens is that of all documents by default.

    Mixture: ``doc_id, source, repeat`` (from 0), ``tokens, finish`` (virtual finish time) and ``cum_tokens`` in order
    of service; the last document is the first to reach the budget. Ties are broken by source, repeat and document.
    Report, for every target: ``target_share, max_repeats, source_tokens, available_tokens`` (all repeats),
    ``target_tokens, actual_tokens, actual_share, repeats_used, short`` (all its repeats were served and lie below its share).

    Documents of sources without a target count for the default budget only; null or empty texts have no tokens and
    aren't mixed. Empty tables give an empty mixture and a report of zeros.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs, folder=folder, tokenizer=tokenizer, label=normal_source(F.col("source"))).withColumnRenamed("label", "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "sizes")
    plan = targets.select(normal_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("reps")).where("share > 0 and reps > 0 and source is not null")
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = int(total if budget is None else budget)
    buckets = min(MAX_BUCKETS, max(1, math.ceil(n / bucket_docs)))

    # Cumulative tokens per source: bucket sums by range of the hash, then sums within a bucket.
    known = sizes.where("tokens > 0").join(F.broadcast(plan), "source") if _few(plan) else sizes.where("tokens > 0").join(plan, "source")
    known = known.withColumn("b", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets).cast("bigint"))
    sums = written(known.groupBy("source", "b").agg(F.sum("tokens").alias("t")), "bucket_sums")
    before = sums.select("source", "b", (F.sum("t").over(W.partitionBy("source").orderBy("b")) - F.col("t")).alias("before"), F.sum("t").over(W.partitionBy("source")).alias("src_tokens"))
    inner = F.sum("tokens").over(W.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    lined = written(known.withColumn("inner", inner).join(before, ["source", "b"]).select("doc_id", "source", "tokens", "share", "reps", "src_tokens", (F.col("before") + F.col("inner")).alias("cum")), "queues")

    # The virtual time at which the budget is used up, from the (few) sources' totals alone.
    ends = lined.groupBy("source").agg(F.first("src_tokens").alias("s"), F.first("share").alias("w"), F.first("reps").alias("r"), F.max("tokens").alias("m"))
    ends = ends.withColumn("v", F.col("s") * F.col("r") / F.col("w"))  # when the source runs out
    upto = W.orderBy("v").rangeBetween(W.unboundedPreceding, 0)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    gone = F.sum("w").over(upto)
    line = ends.select("v", (F.sum(F.col("s") * F.col("r")).over(upto) + F.col("v") * (F.sum("w").over(every) - gone)).alias("t"), (F.sum("w").over(every) - gone + F.sum("w").over(W.partitionBy("v"))).alias("rate"), F.max(F.col("m") / F.col("w")).over(every).alias("slack"))
    first = line.where(F.col("t") >= budget).orderBy("v").limit(1).select((F.col("v") - (F.col("t") - budget) / F.greatest("rate", F.lit(1e-12))).alias("v"), "slack").first()
    slack = first["slack"] if first else 0.0
    stop = first["v"] + slack * 2 if first else float("inf")

    # Repeats up to that time (plus one document of each source), in global order by buckets of the finish time.
    rep = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("reps") - 1)).alias("repeat")
    turns = lined.select("*", rep).withColumn("finish", (F.col("repeat") * F.col("src_tokens") + F.col("cum")) / F.col("share")).where(F.col("finish") <= stop)
    width = F.lit((stop if first else 0.0) / buckets if first and stop > 0 else 0.0)
    if not first:  # the budget exceeds everything there is: all repeats are served
        top = turns.agg(F.coalesce(F.max("finish"), F.lit(1.0))).first()[0]
        width = F.lit(top / buckets)
    turns = written(turns.withColumn("fb", F.floor(F.col("finish") / width).cast("bigint")).select("doc_id", "source", "repeat", "tokens", "finish", "fb"), "turns")
    fsum = turns.groupBy("fb").agg(F.sum("tokens").alias("t"))
    fbefore = fsum.select("fb", (F.sum("t").over(W.orderBy("fb")) - F.col("t")).alias("before"))  # at most MAX_BUCKETS rows
    order = W.partitionBy("fb").orderBy("finish", "source", "repeat", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    mixture = turns.withColumn("inner", F.sum("tokens").over(order)).join(fbefore, "fb").withColumn("cum_tokens", F.col("before") + F.col("inner"))
    mixture = written(mixture.where(F.col("cum_tokens") - F.col("tokens") < budget).select("doc_id", "source", "repeat", "tokens", "finish", "cum_tokens"), "mixture")

    have = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    used = mixture.groupBy("source").agg(F.sum("tokens").alias("actual_tokens"), (F.max("repeat") + 1).alias("repeats_used"))
    all_used = used.agg(F.sum("actual_tokens")).scalar()
    zero = F.lit(0).cast("bigint")
    report = (
        plan.join(have, "source", "left").join(used, "source", "left")
        .select("source", F.col("share").alias("target_share"), F.col("reps").alias("max_repeats"), F.coalesce("source_tokens", zero).alias("source_tokens"), F.coalesce("actual_tokens", zero).alias("actual_tokens"), F.coalesce("repeats_used", zero).alias("repeats_used"))
        .withColumn("available_tokens", F.col("source_tokens") * F.col("max_repeats"))
        .withColumn("target_tokens", F.col("target_share") * F.lit(float(budget)))
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), all_used), F.lit(0.0)))
        .withColumn("short", (F.col("actual_tokens") >= F.col("available_tokens")) & (F.col("actual_tokens") < F.col("target_tokens")))
    )
    return mixture, report


def _few(plan: DataFrame, most: int = 100_000) -> bool:
    """Whether the targets are few enough to be broadcast."""
    return plan.limit(most + 1).count() <= most
