"""Nearest neighbours by inner product as a block matrix join on int8 vectors.

Every vector is rounded to int8 with a scale of its own. A tile multiplies int8 blocks; with the
norms of the rounding errors, each product is known to lie in an interval (Cauchy-Schwarz), and
pairs whose upper end is below the query's k-th best lower end cannot be among its k nearest of the
tile. The surviving pairs are computed again on the original vectors in double precision, and heaps
merge them: in the tile over candidates, then over tiles. Since only pairs that provably lose are
dropped, the answer is exact (recall 1) although the search is over 8-bit vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import finite, slices
from .tiles import TILE_CANDIDATES, matrix, merge_lists, tiles

# A float32 product of int8 rows is exact up to this dimension.
FLOAT32_DIM = (1 << 24) // (127 * 127)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of the rounded rows and of the rounding errors."""
    top = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top / 127.0, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of all inner products of the rows of ``a`` and ``b``."""
    qa, sa, na, ea = quantise(a)
    qb, sb, nb, eb = quantise(b)
    kind = np.float32 if a.shape[1] <= FLOAT32_DIM else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * (sa[:, None] * sb[None, :])
    off = ea[:, None] * (nb + eb)[None, :] + na[:, None] * eb[None, :]
    # Room for the double precision of the bound itself.
    off = off * (1 + 1e-9) + 1e-12 * (na[:, None] * nb[None, :])
    return near - off, near + off


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, components added from first to last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def nearest_in_tile(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int
) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    low, high = bounds(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    if low.shape[1] > k:
        cut = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        cut = np.full(len(q), -np.inf)
    i, j = np.nonzero((high >= cut[:, None]) & ~own)
    exact = products(q[i], c[j])
    ends = np.searchsorted(i, np.arange(len(q) + 1))
    for r, qid in enumerate(q_ids):
        at = slice(ends[r], ends[r + 1])
        pairs = zip((-exact[at]).tolist(), c_ids[j[at]].tolist())
        yield int(qid), heapq.nsmallest(k, pairs)


def nearest_neighbours(
    vectors: DataFrame, vec_id: str, embedding: str, is_query: Column, k: int = 20
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates with the largest inner product, in
    double precision on the original vectors, ties to the smaller id.

    Vectors that are null, zero (or of no component) or hold null or non-finite components take no
    part, nor do rows with a null id; vectors of different length do not meet. A row's own id is
    never its candidate; a repeated candidate row may be listed twice, a repeated query id is
    searched once. Fewer than ``k`` candidates: all of them; an empty table gives no rows.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.where(finite(F.col(embedding))).select(
        F.col(vec_id).cast("bigint").alias("_id"), v.alias("_v"), is_query.alias("_q")
    ).where(F.col("_id").isNotNull() & F.exists("_v", lambda x: x != 0))
    queries = rows.where("_q").groupBy("_id").agg(F.min("_v").alias("_v"))
    n, n_queries = rows.count(), queries.count()
    met = tiles(queries, n_queries, rows, n, "<f8")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.c_ids, "<i8")
                q, c = matrix(r.q_rows, "<f8", len(q_ids)), matrix(r.c_rows, "<f8", len(c_ids))
                found = list(nearest_in_tile(q_ids, q, c_ids, c, k))
                yield pd.DataFrame(
                    {
                        "query_id": [f[0] for f in found],
                        "col": [r.col] * len(found),
                        "top": [[{"neg": s, "id": i} for s, i in f[1]] for f in found],
                    }
                )

    lists = met.mapInPandas(top, "query_id bigint, col bigint, top array<struct<neg:double,id:bigint>>")
    merged = merge_lists(lists, k, slices(n, TILE_CANDIDATES), F.col("top"))
    return merged.select("query_id", F.posexplode("top").alias("_r", "_t")).select(
        "query_id",
        (F.col("_r") + 1).alias("rank"),
        F.col("_t.id").alias("vec_id"),
        (-F.col("_t.neg")).alias("score"),
    )
