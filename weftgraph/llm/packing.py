"""Filling containers of fixed capacity (problem 8): minimum bin slack.

Documents are spread at random over groups of a bounded size, and each group is packed by itself: containers are
filled one after another, each with the largest remaining item and the fullest feasible combination of the others,
found by subset-sum dynamic programming over bitsets (one bit per length) of the available lengths. Only the last
container of a group is part-filled, so the unused space per group is about one container, however large the data.

A text longer than the capacity is cut into full pieces and a rest; the rest is packed like any item. Nothing
else is split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.tokens import TOKENIZER, TOKENIZER_DIR, count_tokens
from weftgraph.session import written

#: Documents of one group, on average.
GROUP_DOCS = 5_000
PACKED = "doc_id bigint, piece bigint, n_pieces bigint, first_token bigint, tokens bigint, container string, used bigint"


def fill(room: int, counts: dict[int, int]) -> list[int]:
    """The lengths (of those in ``counts``, as often as counted) whose sum is the largest up to ``room``.

    Bit s of a bitset is set if some combination of the lengths so far sums to s. The bitset after each length is
    kept for walking back; the search ends as soon as the room can be filled completely.
    """
    full, reach, trail = 1 << room, 1, []
    mask = (full << 1) - 1
    for size in sorted((s for s, k in counts.items() if k and s <= room), reverse=True):
        left = min(counts[size], room // size)
        step = 1
        while left:  # 1, 2, 4, ... copies: every number of copies is a sum of these
            k = min(step, left)
            grown = (reach | reach << size * k) & mask
            if grown != reach:
                trail.append((size, k, reach))
                reach = grown
            left -= k
            step *= 2
        if reach & full:
            break
    best, out = reach.bit_length() - 1, []
    for size, k, before in reversed(trail):
        if not before >> best & 1:
            out += [size] * k
            best -= size * k
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` (each from 1 to ``capacity``) in each container."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    counts = {s: len(v) for s, v in by_size.items()}
    bins = []
    while counts:
        top = max(counts)
        chosen = [top]
        counts[top] -= 1
        if capacity > top:
            chosen += fill(capacity - top, counts)
        for s in chosen[1:]:
            counts[s] -= 1
        bins.append([by_size[s].pop() for s in chosen])
        for s in {*chosen}:
            if not counts[s]:
                del counts[s]
    return bins


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER, label: Column | None = None) -> DataFrame:
    """``doc_id, label, tokens`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_tokens(b.column(2).to_pylist(), folder, tokenizer))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "label", "tokens"])

    label = F.lit(None) if label is None else label
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), label.cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, label string, tokens bigint")


def pack_sizes(sizes: DataFrame, capacity: int, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack rows ``doc_id, tokens``; see :func:`pack_documents`. With a number in ``row``, rows that repeat an id are spread as well."""
    groups = max(1, math.ceil(sizes.count() / group_docs))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        docs, tokens = pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy(np.int64)
        pieces = -(-tokens // capacity)
        row = np.repeat(np.arange(len(docs)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = piece * capacity
        size = np.minimum(tokens[row] - first, capacity)
        bin_of, used = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        for b, members in enumerate(pack(size.tolist(), capacity)):
            bin_of[members] = b
            used[members] = size[members].sum()
        return pd.DataFrame({"doc_id": docs[row], "piece": piece, "n_pieces": pieces[row], "first_token": first, "tokens": size, "container": [f"{key[0]}-{b}" for b in bin_of], "used": used})

    lot = F.xxhash64("doc_id", *(["row"] if "row" in sizes.columns else []), F.lit(17))
    return sizes.where("tokens > 0").groupBy(F.pmod(lot, F.lit(groups)).cast("bigint").alias("g")).applyInPandas(run, PACKED)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: ``containers, tokens, capacity, fill`` (used part of all containers) and ``least`` (containers that any packing needs)."""
    tokens = F.coalesce(F.sum("tokens"), F.lit(0))
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("containers"), tokens.alias("tokens"))
    cap = F.lit(capacity).cast("bigint")
    return bins.select("containers", "tokens", cap.alias("capacity"), F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("containers") * cap), F.lit(1.0)).alias("fill"), F.ceil(F.col("tokens") / cap).alias("least"))


def pack_documents(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Containers of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece`` (from 0), ``n_pieces, first_token, tokens, container`` and ``used`` tokens of
    the container. Documents without a token (null or empty text) are in none. Repeated rows are packed as often as they
    are stored. A null id is an id like any other. An empty table gives no rows. The ids and sizes are written to the
    shared folder, so that texts are tokenized once.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    return pack_sizes(written(sized(docs, id_col, text_col, folder, tokenizer).withColumn("row", F.monotonically_increasing_id()), "sizes"), capacity, group_docs)
