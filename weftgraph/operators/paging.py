"""Pages of bounded size: estimated tokens, token budgets, offsets."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Default budget of a response, and what of it is kept for the page's own data (fixed values).
BUDGET, RESERVED = 10_000, 100


def token_budget() -> int:
    """The budget from WEFTGRAPH_TOKEN_BUDGET if it's a positive number, else the default."""
    v = os.environ.get("WEFTGRAPH_TOKEN_BUDGET", "")
    return int(v) if v.isdigit() and int(v) > 0 else BUDGET


def estimated_tokens(*cols: str) -> Column:
    """A quarter of the characters of the row as JSON, nulls included, rounded up."""
    return F.ceil(F.length(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})) / F.lit(4)).cast("bigint")


def within_budget(page: DataFrame, order: list[str], budget: int = BUDGET, cost: Column | None = None, metadata: bool = True) -> DataFrame:
    """The longest prefix of a page, in ``order``, whose tokens fit the budget; adds ``tokens`` and ``cum_tokens``.

    Take it of a page that is already limited: the running sum is one task's. Each row costs at least one token, so the
    running sum grows and the prefix is the greedy one.
    """
    cols = page.columns
    tokens = estimated_tokens(*cols) if cost is None else cost
    w = W.orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return page.withColumn("tokens", tokens).withColumn("cum_tokens", F.sum("tokens").over(w)).where(F.col("cum_tokens") <= budget - (RESERVED if metadata else 0))


def paginate(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None, budget: int = BUDGET) -> tuple[DataFrame, dict[str, object]]:
    """A page within the budget, and its data: total, returned, has_more, next_offset, truncated."""
    total = df.count()
    cut = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).offset(offset)
    cut = cut.limit(limit if limit is not None else max(1, budget))  # each row costs a token at least
    page = within_budget(cut, order, budget)
    n, wanted = page.count(), cut.count()
    end = offset + n
    return page.drop("cum_tokens"), {"total": total, "returned": n, "has_more": end < total, "next_offset": end if end < total else None, "truncated": n < wanted}
