"""Exact top-k search by inner product of integer vectors: tiled matrix products, a partial
selection in each tile, and a merging tree of the per-query lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices
from .tiles import TILE_CANDIDATES, matrix, merge_lists, tiles

# Integers up to here are exact in double precision, whatever the order of a sum.
EXACT = 1 << 53


def _scores(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, 0 for a row with itself: in double precision where every sum
    is exact, else in unbounded integers; a product beyond 64 bits raises an error."""
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if largest <= EXACT:
        scores = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        scores = q.astype(object) @ c.astype(object).T
        scores[own] = 0
        if scores.size and max(abs(scores.min()), abs(scores.max())) >= 1 << 63:
            raise OverflowError("an inner product does not fit into 64 bits")
        scores = scores.astype(np.int64)
    return scores


def select_tile(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int
) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(query, its best ``k`` of this tile as (-score, id)); ties at the cut go to smaller ids."""
    scores = _scores(q, c, q_ids[:, None] == c_ids[None, :])
    for i, qid in enumerate(q_ids):
        own = scores[i]
        there = np.flatnonzero(c_ids != qid)
        if len(there) > k:
            # The k-th score, then all that reach it, so that ties are settled by id.
            cut = np.partition(own[there], len(there) - k)[len(there) - k]
            there = there[own[there] >= cut]
        order = there[np.lexsort((c_ids[there], -own[there]))][:k]
        yield int(qid), [(-int(own[j]), int(c_ids[j])) for j in order]


def exact_topk(
    vectors: DataFrame, vec_id: str, integers: Column, is_query: Column, k: int = 10
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query row its ``k`` largest integer inner
    products with the other rows, ties to the smaller id.

    ``integers`` is the vector as ``array<bigint>``, null where a row takes no part; ``is_query``
    marks the query rows. Rows with a null id take no part either. Vectors of different length do
    not meet. A row's own id is never its candidate; a repeated candidate row may be listed twice,
    a repeated query id is searched once (with the smaller vector if they differ). Fewer than ``k``
    candidates: all of them; an empty table or one row: no rows.
    """
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("_id"), integers.alias("_v"), is_query.alias("_q")
    ).where("_id IS NOT NULL AND _v IS NOT NULL")
    queries = rows.where("_q").groupBy("_id").agg(F.min("_v").alias("_v"))
    n, n_queries = rows.count(), queries.count()
    met = tiles(queries, n_queries, rows, n, "<i8")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.c_ids, "<i8")
                q, c = matrix(r.q_rows, "<i8", len(q_ids)), matrix(r.c_rows, "<i8", len(c_ids))
                found = list(select_tile(q_ids, q, c_ids, c, k))
                yield pd.DataFrame(
                    {
                        "query_id": [f[0] for f in found],
                        "col": [r.col] * len(found),
                        "top": [[{"neg": s, "id": i} for s, i in f[1]] for f in found],
                    }
                )

    lists = met.mapInPandas(top, "query_id bigint, col bigint, top array<struct<neg:bigint,id:bigint>>")
    merged = merge_lists(lists, k, slices(n, TILE_CANDIDATES), F.col("top"))
    return merged.select("query_id", F.posexplode("top").alias("_r", "_t")).select(
        "query_id",
        (F.col("_r") + 1).alias("rank"),
        F.col("_t.id").alias("vec_id"),
        (-F.col("_t.neg")).alias("score"),
    )
