"""Training-order materialisation of token sequences as fixed-stride shards.

Sequences are numbered densely, and a keyed Feistel permutation (with cycle-walking, so that it maps
0..N-1 onto itself) gives each number its slot in the global training order. Rows are range
partitioned by shard and written as one binary value per shard in which every slot takes the same
number of bytes, so slot s lies in shard s // per_shard at byte (s % per_shard) * stride: readers go
through shards in order and can resume at any slot without an index.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_folder
from .common import bounded_batches, deal, give_back, slices
from .packing import tokenised_pieces
from .token_counts import id_type, vocabulary

# Bytes in front of the ids of a slot: the document's key, the piece and the number of ids.
HEADER = np.dtype([("key", "<i8"), ("piece", "<i4"), ("length", "<i4")])
ROUNDS = 6
PER_SHARD = 1_024
RANK_ROWS = 200_000
BROADCAST_ROWS = 500_000
NO_KEY = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number below ``n``: a bijection of 0..n-1 chosen by ``key``."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix((np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << shift) | right

    slot = once(index.astype(np.uint64))
    while (out := slot >= n).any():  # walk along the cycle until it is back in range
        slot[out] = once(slot[out])
    return slot.astype(np.int64)


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_shards(
    sequences: DataFrame, path: str, capacity: int, key: int, dtype: str = "<u2", per_shard: int = PER_SHARD
) -> DataFrame:
    """Write ``_key, piece, length, ids`` (ids as bytes of ``dtype``) in training order to ``path``.

    Returns the shards as read back: ``shard, first_slot, n_slots, payload``. The order depends on
    the rows and ``key`` only, not on partitions; Spark's writer commits tasks, so a lost executor's
    shards are written again and none twice. A null key is stored as the smallest 64-bit integer.
    """
    spark = sequences.sparkSession
    frozen = _write(
        sequences.withColumn("_uid", F.monotonically_increasing_id()), f"{path}-sequences"
    )
    n = frozen.count()
    n_slices = slices(n, RANK_ROWS)
    keys = frozen.select("_uid", "_key", "piece", F.xxhash64("ids").alias("_h"))
    keys = deal(keys, ["_key", "piece", "_h"], "_uid", n_slices, RANK_ROWS, "_s")
    before = Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keys.groupBy("_s").count().select(
        "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead")
    )
    local = Window.partitionBy("_s").orderBy("_key", "piece", "_h", "_uid")

    @F.pandas_udf("bigint")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(np.int64), n, key))

    numbered = keys.withColumn("_rank", F.row_number().over(local) - 1).join(ahead, "_s")
    slots = _write(numbered.select("_uid", slot(F.col("_rank") + F.col("_ahead")).alias("slot")), f"{path}-slots")
    if n <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    stride = HEADER.itemsize + capacity * np.dtype(dtype).itemsize
    n_shards = slices(n, per_shard)
    placed = (
        frozen.join(slots, "_uid")
        .withColumn("shard", F.floor(F.col("slot") / per_shard))
        .select("shard", "slot", F.coalesce("_key", F.lit(NO_KEY)).alias("_key"), "piece", "length", "ids")
        .repartitionByRange(min(n_shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard")
        .sortWithinPartitions("slot")
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, body, count = None, bytearray(), 0

        def row() -> pa.RecordBatch:
            numbers = [pa.array([v], pa.int64()) for v in (shard, shard * per_shard, count)]
            return pa.RecordBatch.from_arrays([*numbers, pa.array([bytes(body[: count * stride])], pa.binary())], names)

        names = ["shard", "first_slot", "n_slots", "payload"]
        for batch in batches:
            head = np.zeros(batch.num_rows, HEADER)
            for field, column in (("key", "_key"), ("piece", "piece"), ("length", "length")):
                head[field] = batch.column(column).to_numpy()
            heads, width = memoryview(head.tobytes()), HEADER.itemsize
            shards, slots = (batch.column(c).to_numpy().tolist() for c in ("shard", "slot"))
            for i, ids in enumerate(batch.column("ids")):
                if shards[i] != shard:
                    if shard is not None:
                        yield row()
                    shard, body, count = shards[i], bytearray(per_shard * stride), 0
                at = (slots[i] - shard * per_shard) * stride
                ids = ids.as_buffer()
                body[at : at + width] = heads[i * width : (i + 1) * width]
                body[at + width : at + width + ids.size] = ids
                count += 1
        if shard is not None:
            yield row()
        give_back()

    shards = placed.mapInArrow(fill, "shard bigint, first_slot bigint, n_slots bigint, payload binary")
    return _write(shards, f"{path}-shards")


def read_slots(
    shards: DataFrame, capacity: int, dtype: str = "<u2", first: int = 0, per_shard: int = PER_SHARD, digest: bool = False
) -> DataFrame:
    """``slot, shard, byte_offset, _key, piece, length, ids`` (uint32 bytes) from slot ``first`` on,
    whole shards before it being skipped by the scan. With ``digest`` the CRC of these bytes,
    ``ids_crc32``, stands in place of them."""
    stride = HEADER.itemsize + capacity * np.dtype(dtype).itemsize
    bounded_batches(shards.sparkSession)  # by bytes: a payload has some megabytes

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["shard", "first_slot", "n_slots", "payload"]).to_pylist():
                rows = np.frombuffer(r["payload"], np.uint8).reshape(r["n_slots"], stride)
                keep = np.arange(max(0, first - r["first_slot"]), r["n_slots"])
                head = np.ascontiguousarray(rows[keep, : HEADER.itemsize]).view(HEADER)[:, 0]
                wide = np.ascontiguousarray(rows[keep, HEADER.itemsize :]).view(dtype).astype("<u4", copy=False)
                ids = [row[:n].tobytes() for row, n in zip(wide, head["length"].tolist())]
                key = np.ascontiguousarray(head["key"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keep + r["first_slot"]), pa.array(np.full(len(keep), r["shard"])), pa.array(keep * stride),
                        pa.array(key, mask=key == NO_KEY), pa.array(np.ascontiguousarray(head["piece"])),
                        pa.array(head["length"].astype(np.int64)),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()) if digest else pa.array(ids, pa.binary()),
                    ],
                    ["slot", "shard", "byte_offset", "_key", "piece", "length", last[0]],
                )
        give_back()

    last = ("ids_crc32", "bigint") if digest else ("ids", "binary")
    wanted = shards.where(F.col("shard") >= first // per_shard)
    return wanted.mapInArrow(
        slots, f"slot bigint, shard bigint, byte_offset bigint, _key bigint, piece int, length bigint, {last[0]} {last[1]}"
    )


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), "compscope", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")


def training_order(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
    tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, seed: int = 20_250_101,
) -> DataFrame:
    """Tokenise whole documents, write them in training order, and return what the shards hold:
    ``slot, shard, byte_offset, <key>, piece, length, ids_crc32``, a row per sequence.

    A document is its ids and ``end_id``, cut into sequences of at most ``capacity`` ids of which
    only the first may be shorter. A null or empty text is the end id alone; repeated rows and null
    keys are kept; an empty table writes no shard; other columns are not read. Keys are integers. Ids
    take two bytes, or four if the vocabulary has more than 65,536.
    """
    path = path or fresh_path(df.sparkSession, "tokens")
    dtype = id_type(vocabulary(tokenizer))
    if not 0 <= end_id < 1 << 8 * np.dtype(dtype).itemsize:
        raise ValueError(f"the end id {end_id} does not fit the ids of {tokenizer}")
    pieces = tokenised_pieces(df, key, text, tokenizer, end_id, capacity, id_type=dtype)
    sequences = pieces.withColumn("_key", F.col("_key").cast("bigint"))
    shards = write_shards(sequences, path, capacity, seed, dtype)
    return read_slots(shards, capacity, dtype, digest=True).withColumnRenamed("_key", key).select(
        "slot", "shard", "byte_offset", key, "piece", "length", "ids_crc32"
    )
