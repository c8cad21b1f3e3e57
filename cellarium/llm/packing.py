"""Packing into optimal length buckets.

The histogram of lengths over all documents decides K bucket boundaries by dynamic programming, so
that padding each document to its bucket's boundary costs least. Inside a bucket, documents in
doc_id order form batches of floor(budget / boundary) rows, at least one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, tune

BUCKETS = 16
BUDGET = 32_768
#: Documents are numbered in slices of about so many (at most MOST_SLICES slices) by doc_id.
SLICE = 1_000
MOST_SLICES = 4_000


def tokens(text: Column) -> Column:
    """Words parted by white space, and one for the end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long") + 1


def boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most k upper bounds from ``lengths`` (ascending, distinct) that minimise padding.

    cost(i, j) = lengths[j] * (documents i..j) - (their tokens); best[b][j] = min over i of
    best[b - 1][i - 1] + cost(i, j). The cost satisfies the quadrangle inequality, so the best i
    does not fall as j grows, and each layer is found by divide and conquer, a level of it at a time.
    """
    n = len(lengths)
    if not n:
        return []
    number = np.r_[0, np.cumsum(counts, dtype=np.float64)]
    total = np.r_[0, np.cumsum(lengths.astype(np.float64) * counts)]
    cost = lambda i, j: lengths[j] * (number[j + 1] - number[i]) - (total[j + 1] - total[i])
    best = cost(np.zeros(n, np.int64), np.arange(n))
    cuts: list[np.ndarray] = [np.zeros(n, np.int64)]
    for _ in range(1, min(k, n)):
        before, new, cut_at = np.r_[0, best[:-1]], np.empty(n), np.empty(n, np.int64)
        lo, hi, a, b = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(b, j) - a + 1
            first = np.r_[0, np.cumsum(size)[:-1]]
            i = np.arange(size.sum()) + np.repeat(a - first, size)
            costs = before[i] + cost(i, np.repeat(j, size))
            new[j] = np.minimum.reduceat(costs, first)
            hits = np.flatnonzero(costs == np.repeat(new[j], size))
            at = i[hits[np.searchsorted(hits, first)]]
            cut_at[j] = at
            lo, hi, a, b = np.r_[lo, j + 1], np.r_[j - 1, hi], np.r_[a, at], np.r_[at, b]
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        cuts.append(cut_at)
        best = new
    out, j = [], n - 1
    for layer in reversed(cuts):
        out.append(int(lengths[j]))
        j = int(layer[j]) - 1
        if j < 0:
            break
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, place) for every row of ``docs``.

    ``batch`` counts the batches of a bucket from 0 and ``place`` the rows of a batch. A document
    longer than the budget is a batch of its own. Null and empty texts have the end token alone.
    Rows of one doc_id follow each other by length, and are alike if that is the same too; null
    doc_ids come first. No rows: no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    n = F.col("n_tokens")
    sized = cut(docs.select("doc_id", tokens(F.col("text")).alias("n_tokens")), "lengths")
    # distinct lengths are few: their sum is at most the words of all documents
    found = sized.groupBy("n_tokens").agg(F.count("*").alias("c")).orderBy("n_tokens").collect()
    bounds = boundaries(np.array([r["n_tokens"] for r in found], np.int64), np.array([r["c"] for r in found]), buckets)
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (n > b).cast("int")
    size = F.element_at(F.array(*map(F.lit, bounds or [0])), F.col("bucket") + 1).cast("long")
    placed = sized.withColumn("bucket", bucket).withColumn("bucket_len", size)
    # Numbers over all rows of a bucket, without one task for it: rows are cut into slices by doc_id,
    # slices are counted, and the counts before a slice are added to the numbers inside it.
    n_rows = sum(r["c"] for r in found)
    edges = np.array([])
    if n_rows > SLICE:
        shares = np.linspace(0, 1, min(MOST_SLICES, n_rows // SLICE + 1) + 1)[1:-1].tolist()
        edges = np.unique(sized.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", shares, 0.1 / len(shares)))

    @F.pandas_udf("int")
    def slice_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.fillna(-np.inf)).astype(np.int32))

    placed = placed.withColumn("slice", slice_of(F.col("doc_id").cast("double")))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("bucket", "slice").agg(F.count("*").alias("c")).select(
        "bucket", "slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("bucket", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens")
    rank = placed.withColumn("r", F.row_number().over(inside) - 1).join(F.broadcast(counts), ["bucket", "slice"])
    at, rows = F.col("r") + F.col("before"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return rank.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor(at / rows).cast("long").alias("batch"), (at % rows).cast("long").alias("place"),
    )

