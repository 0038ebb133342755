"""Packing of token sequences into fixed-size training sequences by exact-complement hashing.

Pieces are counted by length; the histogram has at most ``capacity`` entries however many
documents there are. The plan is made on it: single lengths, pairs and triples of lengths are
indexed by their sum, and combinations that fill a gap exactly are consumed as often as the counts
allow; what is left is packed best fit, longest first. The plan says, for every length, which rank
interval goes to which run of sequences at which offset, so pieces find their places by their rank
within their length, each on its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import bounded_batches, deal, give_back, slices, text_of
from .token_counts import byte_bpe, vocabulary

# Pieces of one length that a ranking task sorts.
RANK_ROWS = 200_000


@dataclass
class Plan:
    """Runs of equal sequences: ``first`` sequence number, ``times``, and the lengths in one."""

    runs: list[tuple[int, int, tuple[int, ...]]]

    @property
    def sequences(self) -> int:
        return sum(times for _, times, _ in self.runs)

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, end rank, first sequence, offset), sorted by length and rank."""
        given: dict[int, int] = defaultdict(int)
        rows = []
        for first, times, lengths in self.runs:
            at = 0
            for n in lengths:
                rows.append((n, given[n], given[n] + times, first, at))
                given[n] += times
                at += n
        rows.sort()
        return np.array(rows, dtype=np.int64).reshape(-1, 5)


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts[length]`` pieces of each length into sequences of ``capacity`` tokens."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} is not in 1..{capacity}")
        left[n] = c
    bins: list[tuple[int, tuple[int, ...]]] = []

    def consume(lengths: tuple[int, ...]) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        if times:
            np.subtract(left, need * times, out=left)
            bins.append((times, lengths))

    for a in range(capacity, 0, -1):
        if not left[a]:
            continue
        gap = capacity - a
        if gap == 0:
            consume((a,))
            continue
        consume((a, gap))
        # Pairs with the wanted sum, longest member first.
        for b in range(gap - 1, (gap - 1) // 2, -1):
            if not left[a]:
                break
            if left[b] and left[gap - b]:
                consume((a, b, gap - b))
        if left[a]:
            _triples(a, gap, left, consume)
    _best_fit(left, capacity, bins)
    runs, first = [], 0
    for times, lengths in bins:
        runs.append((first, times, lengths))
        first += times
    return Plan(runs)


def _triples(a: int, gap: int, left: np.ndarray, consume) -> None:
    """Fill the gap beside ``a`` with three lengths: sums of pairs are looked up by complement."""
    for b in range(gap - 2, (gap - 1) // 3, -1):
        if not left[a]:
            return
        while left[a] and left[b]:
            rest = gap - b
            there = left[: rest + 1] > 0
            pair = np.flatnonzero(there & there[::-1])
            pair = pair[(pair > 0) & (pair <= b) & (rest - pair > 0) & (rest - pair <= pair)]
            before = left[a]
            for c in pair[::-1]:
                consume((a, b, int(c), int(rest - c)))
                if not left[a] or not left[b]:
                    break
            if left[a] == before:
                break


def _best_fit(left: np.ndarray, capacity: int, bins: list[tuple[int, tuple[int, ...]]]) -> None:
    """Longest first into the open sequence with the smallest sufficient gap; equal ones together."""
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        left[n] = 0
        while todo:
            gap = next((g for g in range(n, capacity) if open_bins.get(g)), None)
            if gap is None:
                fit = capacity // n
                full, rest = divmod(todo, fit)
                if full:
                    open_bins[capacity - fit * n].append((full, (n,) * fit))
                if rest:
                    open_bins[capacity - rest * n].append((1, (n,) * rest))
                break
            times, lengths = open_bins[gap].pop()
            used = min(times, todo)
            if times > used:
                open_bins[gap].append((times - used, lengths))
            open_bins[gap - n].append((used, (*lengths, n)))
            todo -= used
    for same in open_bins.values():
        bins.extend(same)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only the first may be shorter."""
    short = n % capacity
    starts = [0] if short else []
    starts += range(short, n, capacity)
    return [(s, (short if short and s == 0 else capacity)) for s in starts]


def tokenised_pieces(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    capacity: int = 1024,
    id_type: str | None = None,
) -> DataFrame:
    """``_key, piece, start, length, ids_crc32``, or, with an ``id_type``, ``_key, piece, length, ids`` with
    the ids as bytes of that type.

    A document is the ids of its whole text (null: empty) and then ``end_id``.
    """
    bounded_batches(df.sparkSession)
    texts = text_of(df, key, text)
    width = np.dtype(id_type or "<u4").itemsize

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary(tokenizer))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            of, cut, parts = [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                ids = bpe.encode_bytes(t) + end
                cuts = cut_lengths(len(ids) // 4, capacity)
                if width != 4:
                    ids = np.frombuffer(ids, "<u4").astype(id_type).tobytes()
                for k, (start, n) in enumerate(cuts):
                    of.append(i)
                    cut.append((k, start, n))
                    parts.append(ids[width * start : width * (start + n)])
            numbers = np.array(cut, dtype=np.int64).reshape(-1, 3)
            columns = {
                "_key": batch.column("_key").take(pa.array(of, pa.int64())), "piece": pa.array(numbers[:, 0].astype(np.int32)),
                "start": pa.array(numbers[:, 1]), "length": pa.array(numbers[:, 2]),
            }
            if id_type:
                del columns["start"]
                columns["ids"] = pa.array(parts, pa.binary())
            else:
                columns["ids_crc32"] = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)
        give_back()

    kind = texts.schema["_key"].dataType.simpleString()
    rest = "length bigint, ids binary" if id_type else "start bigint, length bigint, ids_crc32 bigint"
    return texts.mapInArrow(pieces, f"_key {kind}, piece int, {rest}")


def place(pieces: DataFrame, length: str, order: list[str], capacity: int, uid: str) -> DataFrame:
    """Add ``sequence_id, offset`` to a table of pieces; ``pieces`` is read more than once.

    A piece's rank within its length has two levels: rows are dealt by a hash of ``order`` to
    slices of about ``RANK_ROWS`` rows, ranked inside (length, slice), and the sizes of the
    slices before are added. So a length that most pieces have is never in one task. Rows that are
    equal in all of ``order`` may take each other's places; many of them are dealt by ``uid``, a frozen
    number of each row.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # <= capacity rows
    plan = plan_packing(histogram, capacity)
    slots = spark.sparkContext.broadcast(plan.slots())  # bounded by capacity, not by the pieces
    n_slices = slices(sum(histogram.values()), RANK_ROWS)
    dealt = deal(pieces, order, uid, n_slices, RANK_ROWS, "_slice")
    before = Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        dealt.groupBy(F.col(length).alias("_l"), F.col("_slice").alias("_s"))
        .count()
        .select("_l", "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    )
    local = Window.partitionBy(length, "_slice").orderBy(*order, uid)
    ranked = dealt.withColumn("_rank", F.row_number().over(local) - 1)
    ranked = ranked.join(ahead, (F.col(length) == F.col("_l")) & (F.col("_slice") == F.col("_s")))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def find(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        table = slots.value
        wide = np.int64(1) << 40  # more than the pieces of one length
        at = np.searchsorted(
            table[:, 0] * wide + table[:, 1], lengths.to_numpy() * wide + ranks.to_numpy(), "right"
        ) - 1
        row = table[at]
        return pd.DataFrame(
            {"sequence_id": row[:, 3] + ranks.to_numpy() - row[:, 1], "offset": row[:, 4]}
        )

    return ranked.select(
        *pieces.columns, find(F.col(length), F.col("_rank") + F.col("_ahead")).alias("_at")
    ).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    capacity: int = 1024,
) -> DataFrame:
    """Pack whole documents: ``<key>, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents of more than ``capacity`` tokens are cut. A null or empty text is the end id
    alone; repeated rows and null keys are packed like any others; an empty table gives no rows;
    other columns are not read. Texts are tokenised once; the small table of pieces is written to
    the shared folder, so a lost executor costs a re-read.
    """
    pieces = tokenised_pieces(df, key, text, tokenizer, end_id, capacity)
    pieces = materialise(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    placed = place(pieces, "length", ["_key", "piece", "start", "ids_crc32"], capacity, "_uid")
    return placed.select(
        F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
