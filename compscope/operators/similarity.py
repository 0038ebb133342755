"""Exact Tanimoto joins of bit sets and nearest-centroid assignment.

Similarity is |A & B| / |A | B| of two sorted ``array<int>`` bit columns, compared as integers;
two empty sets have similarity 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .ordered import rank_in_group

# A token list longer than this is spread over several join keys.
BUCKET_ROWS = 50_000
# The frequency list that is broadcast never has more tokens than this (3 MB).
MAX_FREQUENT = 200_000
# Bit sets with fewer members than this in total (32 MB) may be sent to every executor.
BROADCAST_BITS = 8_000_000


def as_fraction(similarity: float) -> Fraction:
    """The threshold as an exact ratio: 0.65 means 65/100."""
    ratio = Fraction(str(similarity)).limit_denominator(1_000_000)
    if not 0 <= ratio <= 1:
        raise ValueError("similarity is between 0 and 1")
    return ratio


def shared_bits(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def reaches(shared: Column, n_a: Column, n_b: Column, ratio: Fraction) -> Column:
    """Integer test of ``shared / (n_a + n_b - shared) >= ratio`` for sets that share a bit.

    Solved for ``shared``, so an overlap expression pushed into a join is evaluated once.
    """
    num, den = F.lit(ratio.numerator).cast("bigint"), F.lit(ratio.denominator).cast("bigint")
    return (den + num) * shared >= F.greatest(num * (n_a + n_b), F.lit(1).cast("bigint"))


def token_order(frames: Sequence[DataFrame], bits: str):
    """The most frequent tokens, sorted, with their counts, sent to every executor: the order of tokens
    that joins and clusterings of the same sets may share, so that tokens are counted once.

    At most ``MAX_FREQUENT`` of them, so the driver and broadcast size is bounded. Tokens left out
    count as rare; any fixed order is right, a good one is just faster.
    """
    sets = frames[0].select(bits)
    for other in frames[1:]:
        sets = sets.unionAll(other.select(bits))
    found = (
        sets.select(F.explode(bits).alias("t"))
        .groupBy("t")
        .count()
        .where(F.col("count") > 8)
        .orderBy(F.col("count").desc(), "t")
        .limit(MAX_FREQUENT)
        .toPandas()
        .sort_values("t")
    )
    spark = frames[0].sparkSession
    return spark.sparkContext.broadcast((found["t"].to_numpy(np.int64), found["count"].to_numpy(np.int64)))


def _prefix(bits: Column, frequent, ratio: Fraction) -> Column:
    """The rarest tokens of a set, enough that two similar sets share at least one.

    Sets with similarity >= t share at least t*n tokens of the larger-or-equal bound, so the first
    ``n - ceil(t*n) + 1`` tokens of both, in one global order (rarest first), must meet
    (prefix filter, Bayardo et al. 2007).
    """
    num, den = ratio.numerator, ratio.denominator

    @F.pandas_udf("array<int>")
    def rarest(sets: pd.Series) -> pd.Series:
        tokens, counts = frequent.value
        out = []
        for s in sets:
            s = np.asarray(s, dtype=np.int64)
            keep = len(s) - max(1, -(-len(s) * num // den)) + 1
            if len(tokens) and len(s):
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                freq = np.where(tokens[at] == s, counts[at], 0)
                s = s[np.lexsort((s, freq))]
            out.append(s[: max(keep, 0)].astype(np.int32))
        return pd.Series(out)

    return rarest(bits)


def candidate_postings(
    df: DataFrame, keys: Sequence[str], row_id: str, bits: str, frequent, ratio: Fraction
) -> DataFrame:
    """Inverted index of the prefixes: ``at, id, sizes``; ``at`` stands for the keys and the token, ``sizes``
    packs the size of the set and what is left of it from the token on. Two keys may meet in an ``at``:
    ``verify`` compares the keys."""
    return df.select(
        *keys,
        F.col(row_id).alias("id"),
        F.size(bits).cast("bigint").alias("n"),
        F.posexplode(_prefix(F.col(bits), frequent, ratio)).alias("_pos", "token"),
    ).select(
        F.xxhash64(*keys, "token").alias("at"), "id", (F.shiftleft("n", 32) + F.col("n") - F.col("_pos")).alias("sizes")
    )


def _unpacked(postings: DataFrame, side: str) -> DataFrame:
    """``at, id_<side>, n_<side>, left_<side>`` and the salt, if there is one."""
    salt = [c for c in ("salt",) if c in postings.columns]
    return postings.select(
        "at", *salt, F.col("id").alias(f"id_{side}"), F.shiftright("sizes", 32).alias(f"n_{side}"),
        F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"left_{side}"),
    )


def shared_postings(
    df: DataFrame, keys: Sequence[str], row_id: str, bits: str, order, min_similarity: float
) -> DataFrame:
    """The postings of a table that are not alone in their list, written, with the length of the list
    (``_c``). Most tokens of a prefix are in one set only; they cost one shuffle and nothing further."""
    dealt = candidate_postings(df, keys, row_id, bits, order, as_fraction(min_similarity)).repartition("at")
    lists = dealt.groupBy("at").agg(F.count("*").alias("_c")).where("_c > 1")
    return materialise(dealt.join(lists, "at"), "postings")


def similarity_join(
    left: DataFrame,
    right: DataFrame | None,
    keys: Sequence[str],
    row_id: str,
    bits: str,
    min_similarity: float,
    n_bits: int | None = None,
    order=None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Exact join of rows with ``right`` rows of similarity >= ``min_similarity`` inside ``keys``.

    Returns ``keys, id_a, id_b, n_shared, n_a, n_b``. With ``right=None`` the table is joined with
    itself (``id_a < id_b``): its result is quadratic where many rows are alike, so the operators
    here only do that for blocks of checked size, and otherwise join rows with leaders, which are
    unlike each other.

    With ``n_bits`` (sets of a fixed width) rows and ``right`` rows are multiplied in blocks. Otherwise a
    prefix-filtered inverted index; long token lists are salted on the left side and repeated on
    the right one, so no token decides the size of a task. ``order`` is a ``token_order`` of these or
    other sets (any order is right, a good one is faster), ``postings`` the ``shared_postings`` of a self-join.
    """
    if n_bits is not None and right is not None:
        from .bit_blocks import block_join

        return block_join(left, right, keys, row_id, bits, n_bits, min_similarity)
    ratio = as_fraction(min_similarity)
    sides = [left] if right is None else [left, right]
    frequent = order or (None if postings is not None else token_order(sides, bits))
    salts = F.ceil(F.col("_c") / BUCKET_ROWS).cast("int")
    on = ["at"]
    if right is None:
        # Both sides of a self-join read one written index instead of computing it twice.
        a = postings if postings is not None else shared_postings(left, keys, row_id, bits, frequent, min_similarity)
        a = b = a.withColumn("salts", salts).drop("_c")
        salted = not a.where("salts > 1").isEmpty()
    else:
        a = candidate_postings(left, keys, row_id, bits, frequent, ratio)
        b = candidate_postings(right, keys, row_id, bits, frequent, ratio)
        salted = bool((frequent.value[1] > BUCKET_ROWS).any())
        if salted:
            long_lists = a.groupBy("at").agg(F.count("*").alias("_c")).where(F.col("_c") > BUCKET_ROWS)
            long_lists = long_lists.select("at", salts.alias("salts"))
            a, b = (side.join(long_lists, "at", "left") for side in (a, b))
    if salted:
        many = F.coalesce("salts", F.lit(1))
        a = a.withColumn("salt", F.pmod(F.xxhash64("id"), many).cast("int"))
        b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))
        on.append("salt")
    a, b = _unpacked(a, "a"), _unpacked(b, "b")
    # At the first common token, all shared tokens are among those left on either side.
    n_a, n_b = F.col("n_a"), F.col("n_b")
    near = reaches(F.least("left_a", "left_b"), n_a, n_b, ratio)
    met = a.join(b, on).where(reaches(F.least(n_a, n_b), n_a, n_b, ratio))
    if right is None:
        met = met.where(F.col("id_a") < F.col("id_b"))
    # All tokens that two prefixes share were met; behind the prefix that ends first, less than the
    # threshold's part of its set is left. The margin is for rounding only.
    t = float(ratio)
    enough = F.col("_met") + t * F.greatest(n_a, n_b) + 0.01 >= t / (1 + t) * (n_a + n_b)
    counted = met.groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("_met"), F.max(near).alias("_near"))
    candidates = counted.where(F.col("_near") & enough).select("id_a", "id_b").distinct()
    return verify(candidates, left, sides[-1], keys, row_id, bits).where(
        reaches(F.col("n_shared"), F.col("n_a"), F.col("n_b"), ratio)
    )


def _sized(df: DataFrame, bits: str) -> DataFrame:
    """Marked for broadcast when its bits, counted first, stay below ``BROADCAST_BITS``; larger
    tables are shuffled."""
    total = df.agg(F.sum(F.size(bits) + F.lit(8))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BITS else df


def verify(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    row_id: str,
    bits: str,
) -> DataFrame:
    """Exact overlap counts of candidate pairs ``id_a, id_b`` where both rows have the same ``keys``."""
    a = _sized(left.select(*keys, F.col(row_id).alias("id_a"), F.col(bits).alias("_a")), "_a")
    b = _sized(right.select(*keys, F.col(row_id).alias("id_b"), F.col(bits).alias("_b")), "_b")
    return (
        pairs.join(a, "id_a")
        .join(b, [*keys, "id_b"])
        .select(
            *keys,
            "id_a",
            "id_b",
            shared_bits(F.col("_a"), F.col("_b")).cast("bigint").alias("n_shared"),
            F.size("_a").cast("bigint").alias("n_a"),
            F.size("_b").cast("bigint").alias("n_b"),
        )
    )


def verify_in_cells(pairs: DataFrame, df: DataFrame, row_id: str, bits: str) -> DataFrame:
    """Exact overlap counts of candidate pairs ``id_a, id_b, cell`` of one table, as ``verify`` gives them.

    A bit set is sent once for each cell that names it, not for each of its pairs: a cell is a bounded
    number of rows that stand near each other, and their pairs are counted there.
    """
    named = F.explode(F.array_distinct(F.array("id_a", "id_b"))).alias("_id")
    members = pairs.select(F.col("cell").alias("_cell"), named).distinct()
    sets = members.join(df.select(F.col(row_id).alias("_id"), F.col(bits).alias("_bits")), "_id")
    kind = df.schema[row_id].dataType.simpleString()
    return (
        pairs.groupBy("cell").cogroup(sets.select("_cell", "_id", "_bits").groupBy("_cell"))
        .applyInArrow(_cell_overlaps, f"id_a {kind}, id_b {kind}, n_shared bigint, n_a bigint, n_b bigint")
    )


def _cell_overlaps(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """Shared bits of the pairs of a cell: the bits of one row are marked, then those of all its
    partners are looked up at once."""
    sets = pa.concat_arrays(rows["_bits"].chunks) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    at = np.asarray(sets.offsets, dtype=np.int64)
    names, codes = np.unique(np.asarray(sets.values), return_inverse=True)
    places = pd.DataFrame({"id": rows["_id"].to_pandas(), "at": np.arange(rows.num_rows)})
    found = pairs.select(["id_a", "id_b"]).to_pandas()
    found = found.merge(places.rename(columns={"id": "id_a", "at": "a"}), on="id_a")
    found = found.merge(places.rename(columns={"id": "id_b", "at": "b"}), on="id_b").sort_values("a", kind="stable")
    a, b = found["a"].to_numpy(), found["b"].to_numpy()
    shared, marked = np.zeros(len(found), np.int64), np.zeros(len(names), bool)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
    for lo, hi in zip(starts, [*starts[1:], len(a)]):
        mine = codes[at[a[lo]] : at[a[lo] + 1]]
        marked[mine] = True
        others = [codes[at[x] : at[x + 1]] for x in b[lo:hi]]
        seen = np.concatenate([[0], np.cumsum(marked[np.concatenate(others)])])
        ends = np.cumsum([len(x) for x in others])
        shared[lo:hi] = seen[ends] - seen[np.concatenate([[0], ends[:-1]])]
        marked[mine] = False
    size = np.diff(at)
    return pa.table({
        "id_a": pa.array(found["id_a"], pairs.schema.field("id_a").type), "id_b": pa.array(found["id_b"], pairs.schema.field("id_b").type),
        "n_shared": shared, "n_a": size[a], "n_b": size[b],
    })


def tanimoto(shared: str = "n_shared", n_a: str = "n_a", n_b: str = "n_b") -> Column:
    s, a, b = F.col(shared), F.col(n_a), F.col(n_b)
    return s / (a + b - s)


def number_centroids(
    centroids: DataFrame, dataset: str, row_id: str, name: str = "cluster_ID"
) -> DataFrame:
    """0-based index of each centroid in its data set, in row order."""
    ranked = rank_in_group(centroids.select(dataset, row_id), [dataset], [F.col(row_id)], "_r")
    numbers = ranked.select(dataset, row_id, (F.col("_r") - 1).alias(name))
    return centroids.join(numbers, [dataset, row_id])


def _key_hash(dataset: str, key: str) -> Column:
    """Stands in for (data set, key) in joins: keys may be long texts. JSON quotes both parts, so
    two different pairs never look alike."""
    pair = F.struct(F.col(dataset).cast("string").alias("d"), F.col(key).cast("string").alias("k"))
    return F.sha2(F.to_json(pair), 256)


def assign_exact(rows: DataFrame, centroids: DataFrame, dataset: str, key: str) -> DataFrame:
    """Rows whose key is a centroid's own key, with its ``cluster_ID``.

    The right side has one row per key, so a key that most rows share costs no more than its rows
    (Spark splits a skewed left partition).
    """
    known = F.col(dataset).isNotNull() & F.col(key).isNotNull()
    kid = _key_hash(dataset, key).alias("_kid")
    lookup = centroids.where(known).groupBy(kid).agg(F.min("cluster_ID").alias("cluster_ID"))
    # Keys may be long texts: their digests are joined.
    return rows.where(known).select("*", kid).join(lookup, "_kid").select(*rows.columns, "cluster_ID")


def assign_clusters(
    rows: DataFrame,
    centroids: DataFrame,
    dataset: str,
    key: str,
    bits: str,
    tiers: Sequence[float] = (0.65, 0.3, 0.0),
    n_bits: int | None = None,
    prints: DataFrame | None = None,
    order=None,
) -> DataFrame:
    """``cluster_ID`` of every row: the centroid with the same key, else the most similar one.

    ``centroids`` carries ``cluster_ID`` (see ``number_centroids``); ties go to the lowest index,
    and a row that shares no bit with any centroid gets 0; a data set without centroids gets null.
    Works on the distinct keys and joins
    the answer back. The similar ones are found in tiers of falling thresholds: whatever has a
    partner at or above a tier has its best partner there too, so each tier is exact and only the
    rest goes on to the next, costlier one. Rows of the clustered library end in the first tier.
    With ``n_bits`` (fingerprints of a fixed width) blocks of rows and centroids are multiplied
    instead, and only the best centroid of each row is kept: no tiers, no candidate pairs. The bits of
    the distinct keys may come as ``prints`` (``dataset, key, bits``) instead of with the rows.
    """
    hashed = rows.withColumn("_kid", _key_hash(dataset, key))
    source = hashed if prints is None else prints.withColumn("_kid", _key_hash(dataset, key))
    unique = (
        source.where(F.col(key).isNotNull())
        .groupBy("_kid")
        .agg(F.any_value(dataset).alias(dataset), F.any_value(bits).alias("_bits"))
    )
    own = centroids.groupBy(_key_hash(dataset, key).alias("_kid")).agg(
        F.min("cluster_ID").alias("cluster_ID")
    )
    exact = unique.join(own, "_kid", "left").withColumn("_bits", F.when(F.col("cluster_ID").isNull(), F.col("_bits")))
    exact = materialise(exact, "keys")
    answered = exact.where("cluster_ID IS NOT NULL").select("_kid", "cluster_ID")
    rest = exact.where("cluster_ID IS NULL").drop("cluster_ID")
    nodes = centroids.select(dataset, "cluster_ID", F.col(bits).alias("_bits"))
    if n_bits is not None:
        from .bit_blocks import block_best

        best = block_best(
            rest.withColumn("_id", F.col("_kid")).select(dataset, "_id", "_bits"),
            nodes.withColumn("_id", F.col("cluster_ID")).select(dataset, "_id", "_bits"),
            [dataset], "_id", "_bits", n_bits,
        ).select(F.col("id_a").alias("_kid"), F.col("id_b").alias("cluster_ID"))
        best = materialise(best, "best")
        answered = answered.unionByName(best)
        rest = rest.join(best.select("_kid"), "_kid", "left_anti")
        tiers = ()
    # A set without bits shares none: no tier has to look for it.
    bare = rest.where(F.coalesce(F.size("_bits"), F.lit(0)) <= 0)
    rest = rest.where(F.size("_bits") > 0)
    for tier in tiers:
        if rest.isEmpty():
            break
        found = similarity_join(
            rest.withColumn("_id", F.col("_kid")),
            nodes.withColumn("_id", F.col("cluster_ID").cast("string")),
            [dataset],
            "_id",
            "_bits",
            tier,
            order=order,
        )
        cid = F.col("id_b").cast("bigint")
        best = found.groupBy(dataset, F.col("id_a").alias("_kid")).agg(
            F.max_by(cid, F.struct(tanimoto(), -cid)).alias("cluster_ID")
        )
        joined = materialise(rest.join(best, [dataset, "_kid"], "left"), "tier")
        answered = answered.unionByName(
            joined.where("cluster_ID IS NOT NULL").select("_kid", "cluster_ID")
        )
        rest = joined.where("cluster_ID IS NULL").drop("cluster_ID")
    answered = answered.unionByName(
        rest.unionByName(bare).join(centroids.select(dataset).distinct(), dataset, "left_semi")
        .select("_kid", F.lit(0).cast("bigint").alias("cluster_ID"))
    )
    return hashed.join(answered, "_kid", "left").select(*rows.columns, "cluster_ID")
