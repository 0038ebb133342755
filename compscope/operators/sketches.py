"""Unique counts and overlaps of libraries from stored theta sketches of their keys.

A sketch keeps the smallest hashes of a library's keys, some 8 bytes for each of 2^lg_k entries. Sketches
merge without reading keys again, and merging a batch twice changes nothing. Only sketches are shuffled:
one per library and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LG_K = 12
# Regions are listed for at most this many libraries: 2^n - 1 rows.
MAX_SETS = 10
# Standard errors to each side of an estimate.
Z = 5.0


def sketch_keys(df: DataFrame, dataset: str, key: str, lg_k: int = LG_K) -> DataFrame:
    """``Dataset, lg_k, sketch``: a row per library. Keys are compared as text, null as ``nan``, as in
    ``overlap_regions``; rows without a library are left out; an empty table has no sketches."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("nan"))
    return (
        df.where(F.col(dataset).isNotNull())
        .groupBy(F.col(dataset).cast("string").alias("Dataset"))
        .agg(F.theta_sketch_agg(text, lg_k).alias("sketch"))
        .select("Dataset", F.lit(lg_k).alias("lg_k"), "sketch")
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per library from those of its batches. Batches of unlike size end the job."""
    alike = F.when(F.min("lg_k") == F.max("lg_k"), F.min("lg_k")).otherwise(
        F.raise_error(F.lit("sketches of one library differ in lg_k")).cast("int")
    )
    return sketches.groupBy("Dataset").agg(
        alike.alias("lg_k"), F.theta_union_agg("sketch", _lg_k(sketches)).alias("sketch")
    )


def _lg_k(sketches: DataFrame) -> int:
    low, high = sketches.agg(F.min("lg_k"), F.max("lg_k")).first()
    if low != high:
        raise ValueError(f"sketches differ in lg_k: {low} to {high}")
    return LG_K if low is None else low


def _with_bounds(df: DataFrame, whole: Column, lg_k: int) -> DataFrame:
    """``low`` and ``high`` around ``estimate``, the part of ``whole`` keys that was asked for.

    A sketch of n keys samples them at a rate of at least k / n, so a part of r keys has a variance of
    at most r n / k. Nothing is uncertain up to k keys, when the sketch holds them all.
    """
    rate = whole / float(1 << lg_k)
    margin = F.when(rate <= 1, F.lit(0.0)).otherwise(Z * F.sqrt(F.col("estimate") * rate) + Z * Z * rate)
    return df.withColumns({
        "low": F.greatest(F.lit(0.0), F.col("estimate") - margin), "high": F.col("estimate") + margin,
    })


def unique_from_sketches(sketches: DataFrame) -> DataFrame:
    """``Dataset, estimate, low, high``: distinct keys of each library."""
    counted = merge_sketches(sketches).select(
        "Dataset", F.theta_sketch_estimate("sketch").cast("double").alias("estimate")
    )
    return _with_bounds(counted, F.col("estimate"), _lg_k(sketches))


def union_from_sketches(sketches: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """``estimate, low, high`` of the distinct keys of all ``datasets`` together."""
    lg_k = _lg_k(sketches)
    chosen = sketches.where(F.col("Dataset").isin(list(datasets)))
    merged = chosen.agg(F.theta_union_agg("sketch", lg_k).alias("sketch"))
    counted = merged.select(
        F.coalesce(F.theta_sketch_estimate("sketch"), F.lit(0)).cast("double").alias("estimate")
    )
    return _with_bounds(counted, F.col("estimate"), lg_k)


def overlap_from_sketches(sketches: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """``region_mask, region, estimate, low, high``: every exclusive Venn region of ``datasets``, empty
    ones included, with masks as in ``overlap_regions``. A library without a sketch is empty."""
    if not 1 <= len(datasets) <= MAX_SETS or len(set(datasets)) != len(datasets):
        raise ValueError(f"regions are listed for 1 to {MAX_SETS} different data sets")
    lg_k = _lg_k(sketches)
    # All sketches in one row; a library without one takes that of no keys.
    wide = sketches.agg(
        F.theta_sketch_agg(F.lit(None).cast("string"), lg_k).alias("none"),
        *[F.theta_union_agg(F.when(F.col("Dataset") == name, F.col("sketch")), lg_k).alias(f"s{i}")
          for i, name in enumerate(datasets)],
    )
    sets = [F.coalesce(F.col(f"s{i}"), F.col("none")) for i in range(len(datasets))]
    every = sets[0]
    for s in sets[1:]:
        every = F.theta_union(every, s, lg_k)
    masks = F.explode(F.sequence(F.lit(1), F.lit((1 << len(datasets)) - 1)).cast("array<bigint>"))
    rows = wide.withColumn("_all", every).withColumn("region_mask", masks).withColumn("part", F.col("_all"))
    for i, s in enumerate(sets):
        inside = F.col("region_mask").bitwiseAND(1 << i) != 0
        rows = rows.withColumn(
            "part",
            F.when(inside, F.theta_intersection("part", s)).otherwise(F.theta_difference(F.col("part"), s)),
        )
    members = F.concat_ws("&", *[
        F.when(F.col("region_mask").bitwiseAND(1 << i) != 0, F.lit(str(n))) for i, n in enumerate(datasets)
    ])
    counted = rows.select(
        "region_mask", members.alias("region"),
        F.theta_sketch_estimate("part").cast("double").alias("estimate"),
        F.theta_sketch_estimate("_all").cast("double").alias("_whole"),
    )
    return _with_bounds(counted, F.col("_whole"), lg_k).drop("_whole")
