"""Blocks of vectors and tiles of (query block, candidate block), for searches by matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import bounded_batches, slices

# Vectors in a block; candidate blocks in a tile column; query blocks in a tile row.
BLOCK_ROWS = 2_048
TILE_CANDIDATES = 32_768
TILE_QUERIES = 4_096
# Lists that one merging step joins.
FAN_IN = 16

BLOCKS = "_dim int, _part bigint, _ids binary, _rows binary"


def pack_blocks(vectors: DataFrame, n_parts: int, prefix: str, kind: str) -> DataFrame:
    """Pack ``_id bigint, _v array`` rows into blocks of equally long vectors: the ids and the
    row-major matrix of type ``kind`` as bytes. Batches are packed where they are read, without a
    shuffle; ``_part`` deals the blocks to ``n_parts`` tile rows or columns."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            dims = batch["_v"].map(len)
            for dim, same in batch.groupby(dims):
                for at in range(0, len(same), BLOCK_ROWS):
                    part = same.iloc[at : at + BLOCK_ROWS]
                    ids = part["_id"].to_numpy(np.int64)
                    rows = np.stack(part["_v"].to_numpy()).astype(kind) if dim else np.zeros((len(part), 0), kind)
                    yield pd.DataFrame(
                        {
                            "_dim": [int(dim)],
                            "_part": [int((ids[0] * 2654435761 >> 7) % n_parts)],
                            "_ids": [ids.tobytes()],
                            "_rows": [np.ascontiguousarray(rows).tobytes()],
                        }
                    )

    bounded_batches(vectors.sparkSession, rows=BLOCK_ROWS)
    packed = vectors.select("_id", "_v").mapInPandas(pack, BLOCKS)
    return packed.toDF(*[f"{prefix}{c}" for c in ("_dim", "_part", "_ids", "_rows")])


def tiles(queries: DataFrame, n_queries: int, candidates: DataFrame, n_candidates: int, kind: str) -> DataFrame:
    """Every query block beside every candidate block of the same dimension.

    The grid has a row for each ``TILE_QUERIES`` queries and a column for each ``TILE_CANDIDATES``
    candidates; blocks are copied along their row or column and meet by an equi-join on the cell,
    so each cell is a shuffle key of its own and only packed blocks move. The packed blocks
    of both sides are written first: which rows a block holds, and so its cell, depends on the order
    in which a shuffle delivers them, and must not change when a lost task is run again.
    """
    n_rows, n_cols = slices(n_queries, TILE_QUERIES), slices(n_candidates, TILE_CANDIDATES)
    spread_queries = queries.repartition(slices(n_queries, BLOCK_ROWS))
    q = materialise(pack_blocks(spread_queries, n_rows, "q", kind), "query_blocks")
    c = materialise(pack_blocks(candidates, n_cols, "c", kind), "candidate_blocks")
    q = q.withColumn("_col", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))))
    c = c.withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    cell = (
        (F.col("q_part") == F.col("_row"))
        & (F.col("_col") == F.col("c_part"))
        & (F.col("q_dim") == F.col("c_dim"))
    )
    return q.join(c, cell).select(
        F.col("q_dim").alias("dim"), F.col("c_part").alias("col"), "q_ids", "q_rows", "c_ids", "c_rows"
    )


def merge_lists(lists: DataFrame, k: int, n_cols: int, best_first: Column) -> DataFrame:
    """Merge ``query_id, col, top array<struct>`` to one list of ``k`` per query, as a tree.

    Each level joins the lists of at most ``FAN_IN`` neighbouring columns, so no group grows with
    the number of candidates. ``best_first`` must make an array that sorts best first.
    """
    level = lists.withColumn("_g", F.col("col").cast("bigint"))
    width = max(1, n_cols)
    while True:
        joined = F.slice(F.array_sort(F.flatten(F.collect_list(best_first))), 1, k)
        level = level.groupBy("query_id", "_g").agg(joined.alias("top"))
        if width == 1:
            return level.select("query_id", "top")
        level = level.withColumn("_g", F.floor(F.col("_g") / FAN_IN))
        width = -(-width // FAN_IN)
        best_first = F.col("top")


def matrix(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(n, -1)
