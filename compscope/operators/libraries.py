"""Library tables: tagging, validation, distinct keys, overlap and novelty."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import seeded_hash


def tag_libraries(libraries: Sequence[DataFrame], prefix: str = "LIB-") -> DataFrame:
    """One long table of all libraries, row source in ``Dataset`` = ``LIB-1``, ``LIB-2``, ..."""
    tagged = [df.withColumn("Dataset", F.lit(f"{prefix}{i}")) for i, df in enumerate(libraries, 1)]
    return union_by_name(tagged)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def attach_reference(df: DataFrame, reference: DataFrame, name: str = "reference") -> DataFrame:
    """Add a reference set under its own ``Dataset`` name."""
    return union_by_name([df, reference.withColumn("Dataset", F.lit(name))])


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` uniformly drawn rows (all of them if fewer), repeatable for a seed."""
    return (
        df.withColumn("_h", seeded_hash(seed, F.col(row_id)))
        .orderBy("_h", row_id)
        .limit(n)
        .drop("_h")
    )


def head_tail(df: DataFrame, row_id: str, n: int = 2) -> DataFrame:
    """First and last ``n`` rows in ``row_id`` order."""
    return df.orderBy(F.col(row_id).asc()).limit(n).unionByName(
        df.orderBy(F.col(row_id).desc()).limit(n)
    )


def validate_key(
    df: DataFrame,
    column: str,
    normalise: Callable[[Column], Column],
    valid: Callable[[Column], Column],
) -> tuple[DataFrame, DataFrame]:
    """Normalise a key column; rows that are null or not valid afterwards go to the rejects.

    ``normalise`` and ``valid`` build expressions, or apply a pandas UDF (toolkit plug-in).
    Other columns, such as a target, stay in their row.
    """
    canon = df.withColumn("_canon", normalise(F.col(column)))
    canon = canon.withColumn(
        "_ok", F.col("_canon").isNotNull() & F.coalesce(valid(F.col("_canon")), F.lit(False))
    )
    clean = canon.where("_ok").withColumn(column, F.col("_canon")).drop("_canon", "_ok")
    return clean, canon.where("NOT _ok").drop("_canon", "_ok")


def collapse_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def cast_numeric_target(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Cast the target to double; also a one-row report of rows that are not numbers."""
    cast = df.withColumn("_num", F.col(column).cast("string").try_cast("double"))
    report = cast.agg(
        F.count("*").alias("n_rows"),
        F.count("_num").alias("n_numeric"),
        (F.count("*") - F.count("_num")).alias("n_rejected"),
    )
    return cast.withColumn(column, F.col("_num")).drop("_num"), report


def dedup_keep_first(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """First row by ``row_id`` of every key; partial aggregation before the one shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def derive_group_key(
    df: DataFrame,
    column: str,
    key: Callable[[Column], Column],
    name: str = "BM",
    per_distinct: bool = False,
) -> DataFrame:
    """Group key (scaffold) of each structure.

    Evaluated row by row without a shuffle. For a costly ``key`` (toolkit UDF) use
    ``per_distinct``: it runs once per distinct structure and is joined back.
    """
    if not per_distinct:
        return df.withColumn(name, key(F.col(column)))
    lookup = df.select(column).distinct().withColumn(name, key(F.col(column)))
    return df.join(lookup.withColumnRenamed(column, "_s"), F.col(column).eqNullSafe(F.col("_s"))).drop(
        "_s"
    )


def label_encode(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Alphabetical 0-based code of each category, added to every row."""
    return df.join(category_codes(df, column, name), column, "left")


def category_codes(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """The legend: one row per category with its code."""
    from .ordered import rank_in_group

    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = rank_in_group(values.withColumn("_g", F.lit(0)), ["_g"], [F.col(column)], "_r")
    return ranked.select(column, (F.col("_r") - 1).cast("int").alias(name))


def overlap_regions(
    df: DataFrame, key: str, dataset: str, datasets: Sequence[str] | None = None,
    include_empty: bool = False,
) -> DataFrame:
    """Size of every exclusive Venn region: ``region_mask, region, n_keys``.

    Bit i of the mask stands for the i-th data set. Keys are compared as text, null as ``nan``.
    Memberships are or-ed per key (map side first), so there is one shuffle on the key for any
    number of sets. ``include_empty`` lists the empty regions too: 2^n - 1 rows for n sets.
    """
    if datasets is None:
        # At most 63 names may reach the driver: a mask has no room for more.
        found = df.select(dataset).distinct().orderBy(dataset).limit(64).collect()
        datasets = [r[0] for r in found]
    if not 1 <= len(datasets) <= 63:
        raise ValueError("overlap needs between 1 and 63 data sets")
    spark = df.sparkSession
    bit = F.lit(None).cast("bigint")
    for i, name in enumerate(datasets):
        bit = F.when(F.col(dataset) == name, F.lit(1 << i).cast("bigint")).otherwise(bit)
    masks = (
        df.where(F.col(dataset).isin(list(datasets)))
        .select(F.coalesce(F.col(key).cast("string"), F.lit("nan")).alias("_k"), bit.alias("_b"))
        .groupBy("_k")
        .agg(F.bit_or("_b").alias("region_mask"))
        .groupBy("region_mask")
        .agg(F.count("*").alias("n_keys"))
    )
    if include_empty:
        every = spark.range(1, 1 << len(datasets)).select(F.col("id").alias("region_mask"))
        masks = every.join(masks, "region_mask", "left").fillna(0, ["n_keys"])
    members = F.concat_ws(
        "&", *[F.when(F.col("region_mask").bitwiseAND(1 << i) != 0, F.lit(str(n)))
               for i, n in enumerate(datasets)]
    )
    return masks.select("region_mask", members.alias("region"), "n_keys")


def novel_keys(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that the reference lacks."""
    return df.select(key).distinct().join(reference.select(key).distinct(), key, "left_anti")


def shared_keys(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that the reference has as well."""
    return df.select(key).distinct().join(reference.select(key).distinct(), key, "left_semi")
