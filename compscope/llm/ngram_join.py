"""N-gram Jaccard join of documents by a grouped prefix join, and the groups that its links form.

Shingles are put into one order for all documents: those that look frequent last. Two sets with
Jaccard similarity of at least t share one of the first ``n - ceil(t n) + 1`` shingles of this
order. Documents with the same prefix and set size are collapsed into one group; groups meet in an
inverted index of prefix shingles, and group pairs are dropped by set size and by the bits in which
all members of one differ from all members of the other. What remains is expanded to the distinct
texts and verified exactly. Pairs are never listed for large groups: long posting lists and whole
candidate groups are compared block by block, and a block only reports links that join what is not
joined yet, so its output grows with the documents and no connection is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import bounded_batches, components, give_back, text_of
from .shingles import shingle_sets

# The frequency sketch: 2^SKETCH_BITS counters, a fixed size whatever the data.
SKETCH_BITS = 20
SKETCH_CHUNK = 4_096
# Words of the parity bitmap of a set, 64 bits each. Where the allowed difference is more than this
# part of the bits, unlike sets would pass; large sets have a second bitmap of WIDER times the words,
# or as often WIDER times that as it takes.
BITMAP_WORDS = 16
WIDER = 8
FILL = 0.35
# Posting lists up to this length are joined row by row, longer ones in blocks.
SHORT_LIST = 64
LIST_BLOCK = 2_048
# Shingles of the texts that one verification block holds.
BLOCK_SHINGLES = 1_000_000
# Most rows of a document list that is broadcast (16 bytes and an id each).
BROADCAST_ROWS = 500_000


def most_difference(a, b, num: int, den: int):
    """Largest symmetric difference of sets of sizes a, b with Jaccard >= num / den."""
    return (a + b) * (den - num) // (den + num)


def frequency_sketch(texts: DataFrame, k: int) -> np.ndarray:
    """How far each counter of hashed shingles stands out over all documents: 0 for the usual.

    Each task counts all its shingles in an array of fixed size; the arrays are added in two
    grouped steps. Only the order of the shingles depends on it, never the result.
    """
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column("_text"), k):
                # A set may have a counter twice.
                np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        give_back()
        if total.any():
            parts = total.reshape(-1, SKETCH_CHUNK).astype("<i8")
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array(range(len(parts)), pa.int32()),
                    "counts": pa.array([p.tobytes() for p in parts], pa.binary()),
                }
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, "<i8") for c in rows["counts"]], axis=0)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "counts": [total.tobytes()]})

    schema = "chunk int, counts binary"
    parts = texts.select("_text").mapInArrow(count, schema)
    parts = parts.withColumn("part", F.spark_partition_id() % 64)
    parts = parts.groupBy("chunk", "part").applyInPandas(add, schema)
    parts = parts.groupBy("chunk").applyInPandas(add, schema)
    load = np.zeros(size, np.int64)
    for row in parts.collect():  # a fixed number of rows
        load[row.chunk * SKETCH_CHUNK : (row.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(row.counts, "<i8")
    usual = float(np.median(load))
    return np.maximum(0, load - usual - 5 * np.sqrt(usual + 1)).astype(np.uint32)


def signatures(texts: DataFrame, k: int, num: int, den: int, unusual: np.ndarray) -> DataFrame:
    """Per row ``_key, n, digest, prefix, group_key, bits, wide``: the set's size, a 128-bit digest,
    its prefix, a digest of prefix and size, its parity bitmap, and a wider one for a large set.
    Null where the set is empty. A column ``_text_id`` of ``texts`` is kept."""
    named = "_text_id" in texts.columns
    order = texts.sparkSession.sparkContext.broadcast(unusual)
    schema = pa.schema(
        [
            ("_key", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()),
            ("group_key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())),
            ("wide", pa.list_(pa.int64())),
        ]
        + [("_text_id", pa.binary())] * named
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = order.value
        for batch in batches:
            sets = shingle_sets(batch.column("_text"), k)
            digests, keys, prefixes, bits, wide = [], [], [], [], []
            for s in sets:
                n = len(s)
                if not n:
                    for out in (digests, keys, prefixes, bits, wide):
                        out.append(None)
                    continue
                first = np.argsort(rare[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefix = s[first[: n - -(-n * num // den) + 1]]
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(xxhash.xxh3_128_digest(prefix.tobytes() + n.to_bytes(8, "little")))
                prefixes.append(prefix.view(np.int64))
                bits.append(bitmap(s, BITMAP_WORDS).view(np.int64))
                words = wide_words(n, num, den)
                wide.append(bitmap(s, words).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(digests, pa.binary()), pa.array(keys, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                    pa.array(wide, pa.list_(pa.int64())),
                ]
                + ([batch.column("_text_id")] if named else []),
                schema=schema,
            )
        give_back()

    return texts.mapInArrow(
        sign,
        "_key bigint, n int, digest binary, group_key binary, prefix array<bigint>, bits array<bigint>, "
        "wide array<bigint>" + ", _text_id binary" * named,
    )


def bitmap(s: np.ndarray, words: int) -> np.ndarray:
    """Parities of the hashes' counts in 64 x ``words`` classes: two sets differ in at least as
    many elements as their bitmaps differ in bits."""
    size = 64 * words
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def wide_words(n: int, num: int, den: int) -> int:
    """Words of the second bitmap of a set of ``n`` shingles; 0 where the first one is enough."""
    words, limit = BITMAP_WORDS, most_difference(n, n, num, den)
    while limit > FILL * 64 * words:
        words *= WIDER
    return words if words > BITMAP_WORDS else 0


def _groups(signed: DataFrame) -> DataFrame:
    """Documents with the same prefix and size as one row: ``gid, group_key, n, prefix``, the bits
    that all members have (``every``) or any has (``some``), the wide bitmap if they share one, and
    whether members differ."""
    words = range(BITMAP_WORDS)
    grouped = signed.groupBy("group_key").agg(
        F.first("n").alias("n"),
        F.first("prefix").alias("prefix"),
        F.array(*[F.bit_and(F.col("bits")[i]) for i in words]).alias("every"),
        F.array(*[F.bit_or(F.col("bits")[i]) for i in words]).alias("some"),
        F.when(F.min("wide").eqNullSafe(F.max("wide")), F.min("wide")).alias("wide"),
        (F.min("digest") != F.max("digest")).alias("multi"),
    )
    return materialise(grouped.withColumn("gid", F.monotonically_increasing_id()), "groups")


def _differing_bits() -> Column:
    def total(a: str, b: str) -> Column:
        ones = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.aggregate(ones, F.lit(0), lambda s, x: s + x)

    return total("every_a", "some_b") + total("every_b", "some_a")


def _differing_wide() -> Column:
    ones = F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    total = F.aggregate(ones, F.lit(0), lambda s, x: s + x)
    return F.when(F.size("wide_a") == F.size("wide_b"), total)


def _candidates(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``a, b`` between groups that may hold a similar pair; their connected groups hold
    all pairs that pass the filters, though not each such pair is listed."""
    postings = groups.select("gid", "n", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    lists = materialise(postings.join(shared, "token"), "postings")
    short = lists.where(F.col("length") <= SHORT_LIST)
    left, right = (short.select("token", F.col("gid").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    # n_a and n_b are of one size class if the smaller one reaches num / den of the larger one.
    near = (F.least("n_a", "n_b") * den) >= (F.greatest("n_a", "n_b") * num)
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    for side in "ab":
        own = groups.select(
            F.col("gid").alias(side), F.col("n").alias(f"n_{side}"),
            F.col("every").alias(f"every_{side}"), F.col("some").alias(f"some_{side}"),
            F.col("wide").alias(f"wide_{side}"),
        )
        pairs = pairs.join(own, side)
    limit = F.expr(f"(cast(n_a AS bigint) + n_b) * {den - num} div {den + num}")
    alike = (_differing_bits() <= limit) & F.coalesce(_differing_wide() <= limit, F.lit(True))
    links = pairs.where(alike).select("a", "b")

    blocks = F.ceil(F.col("length") / LIST_BLOCK).cast("int")
    dealt = (
        lists.where(F.col("length") > SHORT_LIST)
        .join(groups.select("gid", "every", "some", "wide"), "gid")
        .withColumn("block", F.pmod(F.xxhash64("gid"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        every = np.stack(rows["every"].to_numpy()).view(np.uint64)
        some = np.stack(rows["some"].to_numpy()).view(np.uint64)
        n, block, wide = rows["n"].to_numpy(np.int64), rows["block"].to_numpy(), rows["wide"].tolist()
        across = rows["low"].iloc[0] != rows["high"].iloc[0]
        forest = Forest(len(rows))
        links = []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            ok = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
            if across:
                ok &= block[j] != block[i]
            j = j[ok]
            bits = np.bitwise_count(every[i] & ~some[j]).sum(axis=1, dtype=np.int64)
            bits += np.bitwise_count(every[j] & ~some[i]).sum(axis=1, dtype=np.int64)
            limit = most_difference(n[i], n[j], num, den)
            for x, most in zip(j[bits <= limit].tolist(), limit[bits <= limit].tolist()):
                if forest.find(i) != forest.find(x) and _wide_alike(wide[i], wide[x], most):
                    forest.join(i, x)
                    links.append((i, x))
        gid = rows["gid"].to_numpy()
        at = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": gid[at[:, 0]], "b": gid[at[:, 1]]})

    long = dealt.groupBy("token", "low", "high").applyInPandas(joined, "a bigint, b bigint")
    return links.unionByName(long)


def _wide_alike(a: np.ndarray | None, b: np.ndarray | None, limit: int) -> bool:
    if a is None or b is None or len(a) != len(b):
        return True
    return int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(dtype=np.int64)) <= limit


class Forest:
    """Union-find over positions of one block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def similar_links(
    sets: list[np.ndarray], side: np.ndarray, across: bool, num: int, den: int
) -> list[tuple[int, int]]:
    """Exact links of one block that join what is not joined yet; with ``across`` only pairs of
    different sides count. All pairs are covered: by size, by bitmap, by being joined already, or
    by comparing the sets."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    bits = np.stack([bitmap(s, BITMAP_WORDS) for s in sets])
    forest, links = Forest(len(sets)), []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        ok = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
        if across:
            ok &= side[j] != side[i]
        j = j[ok]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = apart <= most_difference(n[i], n[j], num, den)
        for x in j[near][np.argsort(apart[near], kind="stable")].tolist():
            if forest.find(i) == forest.find(x):
                continue
            common = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
            if common * den >= (n[i] + n[x] - common) * num:
                forest.join(i, x)
                links.append((i, x))
    return links


def _verified(
    texts: DataFrame, signed: DataFrame, active: DataFrame, k: int, num: int, den: int
) -> DataFrame:
    """Links ``a, b`` between digests of distinct texts: those that connect every two texts of a
    candidate group that exact links connect."""
    classes = materialise(
        signed.join(active, "group_key")
        .groupBy("digest")
        .agg(F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("root").alias("root")),
        "classes",
    )
    weights = classes.groupBy("root").agg(F.sum("n").alias("weight"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = max(1, int(total[0]) // BLOCK_SHINGLES)
    placed = (
        classes.join(weights, "root")
        .withColumn("blocks", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        # Small groups share a tile; a large one has a tile for every two of its blocks.
        .withColumn("tile", F.when(F.col("blocks") > 1, F.col("root")).otherwise(
            -1 - F.pmod(F.xxhash64("root"), F.lit(shared))))
        .select("_key", "digest", "root", "tile", "block", "blocks")
    )
    small = total[1] <= BROADCAST_ROWS
    fetched = texts.join(F.broadcast(placed) if small else placed, "_key")
    dealt = (
        fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select("tile", "low", "high", "block", "root", "digest", "_text")
    )

    def verify(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        roots, block = table.column("root").to_numpy(), table.column("block").to_numpy()
        across = table.column("low")[0] != table.column("high")[0]
        sets = shingle_sets(table.column("_text"), k)
        seen: dict[int, dict[bytes, int]] = {}
        for i, s in enumerate(sets):
            # A repeated id may bring other texts along; equal rows need to be compared once.
            if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == digests[i]:
                seen.setdefault(int(roots[i]), {})[digests[i]] = i
        a, b = [], []
        for members in seen.values():
            at = np.array(list(members.values()))
            if len(at) > 1:
                for i, j in similar_links([sets[x] for x in at], block[at], across, num, den):
                    a.append(digests[at[i]])
                    b.append(digests[at[j]])
        del sets, table
        give_back()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("tile", "low", "high").applyInArrow(verify, "a binary, b binary")


def text_id(text: Column) -> Column:
    """128 bits that tell the texts of one key apart; a null text is empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def ngram_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100,
    by_text: bool = False,
) -> DataFrame:
    """Per row ``<key>, n_shingles, component_id``: the size of its set of ``k``-word shingles and
    the smallest key that it reaches by links of Jaccard similarity >= num / den, itself included.

    A null or empty text, or one without words, has an empty set and links with nothing, not even
    its like. Fewer than ``k`` words are one shingle. Repeated rows are one text; a repeated key
    with different texts keeps them apart. A row with a null key is returned with its size and a
    null component and links with nothing. An empty table gives no rows; other columns are not read.
    With ``by_text`` there are also ``text_id`` of the row and ``first_text_id``: the smallest one
    among the texts of the component that stand under ``component_id``, null where nothing links.
    """
    bounded_batches(df.sparkSession)
    texts = text_of(df, key, text).withColumn("_key", F.col("_key").cast("bigint"))
    if by_text:
        texts = texts.withColumn("_text_id", text_id(F.col("_text")))
    unusual = frequency_sketch(texts, k)
    signed = materialise(signatures(texts, k, num, den, unusual), "signatures")
    linked = signed.where("n > 0 AND _key IS NOT NULL")
    groups = _groups(linked)
    roots = components(_candidates(groups, num, den), "a", "b")
    if roots is None:
        active = groups.where("multi").select("group_key", F.col("gid").alias("root"))
    else:
        roots = roots.withColumnRenamed("node", "gid")
        active = (
            groups.select("gid", "group_key", "multi").join(roots, "gid", "left")
            .where("multi OR root IS NOT NULL")
            .select("group_key", F.coalesce("root", "gid").alias("root"))
        )
    found = components(_verified(texts, linked, active, k, num, den), "a", "b")
    low = F.struct("_key", "_text_id") if by_text else F.col("_key")
    member = linked.groupBy("digest").agg(F.min(low).alias("low"))
    if found is None:
        member = member.withColumn("root", F.col("digest"))
    else:
        member = member.join(found.withColumnRenamed("node", "digest"), "digest", "left")
        member = member.withColumn("root", F.coalesce("root", "digest"))
    lowest = member.groupBy("root").agg(F.min("low").alias("low"))
    labels = member.drop("low").join(lowest, "root").select("digest", "low")
    out = [F.col("_key").alias(key), F.col("n").cast("bigint").alias("n_shingles")]
    ends, none = [F.col("low").alias("component_id")], [F.col("_key").alias("component_id")]
    if by_text:
        own = F.col("_text_id").alias("text_id")
        ends = [F.col("low._key").alias("component_id"), own, F.col("low._text_id").alias("first_text_id")]
        none += [own, F.lit(None).cast("binary").alias("first_text_id")]
    alone = signed.where("n = 0 OR _key IS NULL").select(*out, *none)
    return linked.join(labels, "digest").select(*out, *ends).unionByName(alone)
