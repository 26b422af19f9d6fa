"""Frequency of every distinct term, and in how many records it occurs (problem 1).

Records are hash-partitioned and ordered by their key; each task then runs *last-seen counters* over its stream:
a term holds its occurrences, its records and the ordinal of the last record that had it. A term seen again in
the same record raises only the occurrences, so no set of terms per record (or of records per term) is kept.
Partitioning by record rather than by term makes a term that a third of all records carry no heavier than any
other, and repeated rows of one record meet in one task. Only compact partial counters are shuffled to the final
sum. A task's table is flushed at a record boundary when it holds ``FLUSH_TERMS`` terms, which keeps it bounded
and the partial counters mergeable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written

#: Terms that one task holds before it hands on its partial counters.
FLUSH_TERMS = 500_000
RARE_BELOW = 3
COMMON_ABOVE = 0.30
_OUT = "field string, term string, occurrences bigint, records bigint"
_SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def normal(value: Column) -> Column:
    """Trimmed (any white space), without leading @, in lower case; blank becomes null."""
    bare = F.regexp_replace(F.lower(value), r"^[\s ​﻿@]+|[\s ​﻿]+$", "")
    return F.nullif(bare, F.lit(""))


class LastSeen:
    """Counters of one task: occurrences, records and last record of each term, grown as terms appear."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.occ = np.zeros(1024, np.int64)
        self.rec = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def add(self, terms: pa.Array, records: np.ndarray) -> None:
        """``records`` (ordinals, ascending) of each of ``terms``."""
        d = terms.dictionary_encode()
        local = np.fromiter((self.codes.setdefault(t, len(self.codes)) for t in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
        n = len(self.codes)
        while n > len(self.occ):
            k = len(self.occ)
            self.occ, self.rec, self.last = (np.concatenate([a, np.full(k, fill, np.int64)]) for a, fill in ((self.occ, 0), (self.rec, 0), (self.last, -1)))
        code = local[d.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(code, kind="stable")
        code, records = code[order], records[order]
        first = np.r_[True, code[1:] != code[:-1]]
        before = np.r_[-1, records[:-1]]
        before[first] = self.last[code[first]]
        self.occ += np.bincount(code, minlength=len(self.occ))
        self.rec += np.bincount(code, weights=(records != before), minlength=len(self.rec)).astype(np.int64)
        end = np.r_[first[1:], True]
        self.last[code[end]] = records[end]

    def flush(self) -> pa.RecordBatch:
        n = len(self.codes)
        names = [t.split("\x00", 1) for t in self.codes]
        out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string()), pa.array(self.occ[:n]), pa.array(self.rec[:n])], schema=_SCHEMA)
        self.__init__()
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, fields, terms`` ordered by key: partial counters, with a term '' for records of each field."""
    seen, ordinal, prev = LastSeen(), -1, object()
    for b in batches:
        key = b.column(0)
        k = key.to_pylist()
        fresh = np.fromiter((x != y for x, y in zip(k, [prev, *k[:-1]])), bool, len(k))
        if not len(k):
            continue
        prev = k[-1]
        record = ordinal + np.cumsum(fresh)
        ordinal = int(record[-1])
        if len(seen.codes) > FLUSH_TERMS and fresh.any():
            # Hand on at the first record boundary of this batch, so that no record is split between two tables.
            cut = int(np.argmax(fresh))
            _feed(seen, b.column(1).slice(0, cut), record[:cut], fresh[:cut])
            yield seen.flush()
            _feed(seen, b.column(1).slice(cut), record[cut:], fresh[cut:])
        else:
            _feed(seen, b.column(1), record, fresh)
    if seen.codes:
        yield seen.flush()


def _feed(seen: LastSeen, lists: pa.Array, record: np.ndarray, fresh: np.ndarray) -> None:
    if not len(lists):
        return
    lists = lists.filter(pa.array(fresh))  # repeated rows of a record count once
    size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    if size.sum():
        seen.add(lists.flatten(), np.repeat(record[fresh], size))


def _headed(head: Column, terms: Column) -> Column:
    return F.concat(F.array(head), F.transform(terms, lambda x: F.concat(head, x)))


def term_counts(records: DataFrame, key_cols: list[str], order_cols: list[str], fields: dict[str, Column]) -> DataFrame:
    """``field, term, occurrences, records, share`` of every term of every field.

    ``fields`` maps a field's name to an expression of type array of string. Terms are normalised by
    :func:`normal`; null and blank ones don't count. Rows with equal keys are repeats of one record: the first in
    ``order_cols`` counts, the rest are ignored (a null key is a key like any other). ``share`` is the part of the
    records that have at least one term of the field. Records whose first row has no term, and empty tables, give no rows.
    """
    parts = []
    for name, arr in fields.items():
        clean = F.filter(F.transform(arr, normal), lambda x: x.isNotNull())
        marked = F.when(F.size(clean) > 0, _headed(F.lit(name + "\x00"), clean))
        parts.append(F.coalesce(marked, F.array().cast("array<string>")))
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in key_cols]))
    rows = records.select(key.alias("__k"), F.concat(*parts).alias("__t"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_cols)])
    tidy = rows.repartition("__k").sortWithinPartitions("__k", *[f"__o{i}" for i in range(len(order_cols))]).select("__k", "__t")
    counters = tidy.mapInArrow(_count, _OUT)
    # "field" may hold NUL-free names only; the term after it is kept whole.
    counts = written(counters.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")), "terms")
    totals = counts.where("term = ''").select("field", F.col("records").alias("__n"))  # one row a field
    return counts.where("term <> ''").join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", (F.col("records") / F.col("__n")).alias("share"))


def mark(counts: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """Adds ``mark``: 'rare' in fewer than ``rare_below`` records, 'common' in more than ``common_above`` of them, else null.

    A term that is both (of a field with very few records) is rare.
    """
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("share") > common_above, "common"))
