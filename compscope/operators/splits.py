"""Train/test splits and repeated cross-validation cycles, decided by hashes.

A split depends only on the seed and the row or group key, so it is the same on any cluster and
after any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import hash_to_int, seeded_hash
from ..session import materialise
from .ordered import rank_in_group, scalar_quantiles
from .profile import bin_of, quantile_edges


def strata(df: DataFrame, target: str, n_bins: int = 10) -> Column:
    """Stratum of a row: the class when the target has at most two values, else a quantile bin."""
    lower, upper, between = _extremes(df, target)
    if not between:
        lower = 0 if lower is None else lower
        return F.when(F.col(target).isNotNull(), (F.col(target) > F.lit(lower)).cast("int"))
    return bin_of(F.col(target), quantile_edges(df, target, n_bins))


def _extremes(df: DataFrame, target: str) -> tuple:
    """Smallest and largest value, and whether there are others."""
    lower, upper = df.agg(F.min(target), F.max(target)).first()
    if lower is None or lower == upper:
        return lower, upper, False
    return lower, upper, not df.where((F.col(target) > lower) & (F.col(target) < upper)).isEmpty()


def _cycles(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return df.withColumn(
        "_cs",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(int(s)).alias("s"))
                            for i, s in enumerate(seeds, 1)])),
    ).withColumns({"cycle": F.col("_cs.c"), "_seed": F.col("_cs.s")}).drop("_cs")


def cycle_seeds(seed: int, n: int) -> list[int]:
    return [seed + i for i in range(n)]


def repeated_stratified(
    df: DataFrame,
    row_id: str,
    target: str,
    seeds: Sequence[int],
    test_size: float = 0.2,
    n_bins: int = 10,
) -> DataFrame:
    """One independent stratified draw per seed: the input columns with ``cycle, split``.

    Each stratum gives exactly ``round(test_size * size)`` test rows: those with the lowest seeded
    hashes. Only ids and strata are looked at to find the cut; then every row is placed on its own.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size is a fraction between 0 and 1")
    placed = df.withColumn("stratum", strata(df, target, n_bins))
    cuts = _cuts(placed.select(row_id, "stratum"), row_id, seeds, test_size)
    h = seeded_hash(F.col("_seed"), F.col(row_id))
    # A row per cycle and stratum, whatever the number of rows: the features stay where they are.
    picked = _cycles(placed, seeds).withColumn("_h", h).join(
        F.broadcast(cuts),
        (F.col("cycle") == F.col("_c")) & F.col("stratum").eqNullSafe(F.col("_s")), "left",
    )
    at = F.struct(F.col("_h").alias("h"), F.col(row_id).alias("id"))
    return picked.withColumn(
        "split", F.when(F.coalesce(at <= F.col("_cut"), F.lit(False)), "test").otherwise("train")
    ).select("cycle", *df.columns, "stratum", "split")


# Width of the hash interval that is searched for a cut, in standard deviations of its position.
SPREAD = 8.0
# Leading hexadecimal digits of a hash that are compared with the ends of the interval.
HASH_DIGITS = 13


def _hash_digits(number: int) -> str:
    """A number below 16 ** HASH_DIGITS as text in the order of hashes; others become the nearest."""
    return f"{min(max(number, 0), 16**HASH_DIGITS - 1):0{HASH_DIGITS}x}"


def _cuts(rows: DataFrame, row_id: str, seeds: Sequence[int], test_size: float) -> DataFrame:
    """The last test row of every cycle and stratum in hash order: ``_c, _s, _cut (h, id)``.

    Hashes are uniform, so the k-th smallest of n lies near k / n: rows below that neighbourhood
    are only counted, and only the few inside are ranked, all in one pass over the hashes. A cut
    outside it is an error. Strata whose share rounds to no row have no cut.
    """
    sizes = {r["stratum"]: r["count"] for r in rows.groupBy("stratum").count().collect()}
    bounds = []
    for stratum, n in sizes.items():
        k = int(test_size * n + 0.5)
        if k:
            off = (SPREAD * (k * (1 - k / n)) ** 0.5 + SPREAD) / n
            bounds.append((stratum, k, _hash_digits(ceil((k / n - off) * 2**52)), _hash_digits(floor((k / n + off) * 2**52))))
    kind = rows.schema["stratum"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(bounds, f"_s {kind}, _k bigint, _lo string, _hi string")
    hashed = _cycles(rows, seeds).withColumn("_h", seeded_hash(F.col("_seed"), F.col(row_id)))
    near = hashed.join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("_s"))).where(
        F.substring("_h", 1, HASH_DIGITS) <= F.col("_hi")
    )
    # Equal keys are added up before they travel: a null hash stands for all rows below.
    inside = F.col("_h") >= F.col("_lo")
    counted = near.groupBy(
        "cycle", "_s", "_k", F.when(inside, F.col("_h")).alias("_h"), F.when(inside, F.col(row_id)).alias("_id")
    ).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("cycle", "_s").orderBy("_h", "_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    wanted = counted.withColumn("_r", F.sum("_n").over(order)).where(
        F.col("_h").isNotNull() & (F.col("_r") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_r"))
    )
    cuts = materialise(wanted.select(
        F.col("cycle").alias("_c"), "_s", F.struct(F.col("_h").alias("h"), F.col("_id").alias("id")).alias("_cut")
    ), "cuts")
    if cuts.count() != len(bounds) * len(seeds):
        raise ValueError("a cut lies outside its hash interval; are the row ids unique?")
    return cuts


def stratified_split(
    df: DataFrame, row_id: str, target: str, test_size: float = 0.2, seed: int = 42,
    n_bins: int = 10,
) -> DataFrame:
    """A single stratified split; the ``split`` column is the index of both parts."""
    return repeated_stratified(df, row_id, target, [seed], test_size, n_bins).drop("cycle")


def positive_class(df: DataFrame, target: str) -> Column:
    """The class used to balance group folds: the higher of two values, else ``>= median``."""
    lower, upper, between = _extremes(df, target)
    if not between and lower != upper:
        return F.col(target) == F.lit(upper)
    return F.col(target) >= F.lit(scalar_quantiles(df, target, [0.5])[0])


def group_fold(group: Column, seed: int | Column, n_folds: int) -> Column:
    return (hash_to_int(seeded_hash(seed, group)) % n_folds).cast("int")


def fold_balance(
    df: DataFrame, group: str, target: str, seeds: Sequence[int], n_folds: int = 5
) -> DataFrame:
    """Positive ratio inside and outside every fold: ``cycle, fold, n, test_ratio, train_ratio,
    ratio_diff``. A fold is a hash of the group, so only (cycle, fold) counts are shuffled."""
    pos = positive_class(df, target).cast("bigint")
    counted = (
        _cycles(df.select(group, pos.alias("_pos")), seeds)
        .withColumn("fold", group_fold(F.col(group), F.col("_seed"), n_folds))
        .groupBy("cycle", "fold")
        .agg(F.count("*").alias("n"), F.sum("_pos").alias("n_pos"))
    )
    whole = counted.groupBy("cycle").agg(
        F.sum("n").alias("_n_all"), F.sum("n_pos").alias("_pos_all")
    )
    test = F.col("n_pos") / F.col("n")
    train = F.try_divide(F.col("_pos_all") - F.col("n_pos"), F.col("_n_all") - F.col("n"))
    return counted.join(whole, "cycle").select(
        "cycle", "fold", "n", test.alias("test_ratio"), train.alias("train_ratio"),
        F.abs(train - test).alias("ratio_diff"),
    )


def balanced_folds(
    df: DataFrame, group: str, target: str, seed: int = 42, n_folds: int = 5
) -> DataFrame:
    """``group, n, n_pos, fold``: groups dealt by class and size, each fold in turn and back again.

    Groups are put in order of their positives, then size (ties by a seeded hash), and dealt 0, 1,
    ..., n-1, n-1, ..., 0: folds get as many groups, and nearly as many rows of either class. The
    order is ranked in two levels, so the number of groups is not limited by one task.
    """
    pos = positive_class(df, target).cast("bigint")
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(pos), F.lit(0)).alias("n_pos")
    )
    ordered = rank_in_group(
        sizes.withColumns({"_all": F.lit(0), "_h": seeded_hash(seed, F.col(group))}), ["_all"],
        [F.col("n_pos").desc(), F.col("n").desc(), F.col("_h").asc(), F.col(group).asc()], "_r",
    )
    place = F.pmod(F.col("_r") - 1, F.lit(2 * n_folds))
    fold = F.when(place < n_folds, place).otherwise(2 * n_folds - 1 - place)
    return ordered.select(group, "n", "n_pos", fold.cast("int").alias("fold"))


def repeated_grouped(
    df: DataFrame, group: str, target: str, seeds: Sequence[int], n_folds: int = 5
) -> DataFrame:
    """One group split per seed: the input columns with ``cycle, split``.

    Groups never straddle; of ``n_folds`` folds the one whose positive ratio is closest to the
    rest becomes the test part (lowest fold on ties).
    """
    best = fold_balance(df, group, target, seeds, n_folds).groupBy("cycle").agg(
        F.min_by("fold", F.struct(F.round("ratio_diff", 12), F.col("fold"))).alias("_best")
    )
    # One number per cycle: read as literals, so the rows need neither a join nor a shuffle.
    chosen = {r["cycle"]: r["_best"] for r in best.collect()}
    fold = group_fold(F.col(group), F.col("_seed"), n_folds)
    wanted = F.element_at(
        F.array(*[F.lit(chosen.get(i, -1)) for i in range(1, len(seeds) + 1)]), F.col("cycle")
    )
    return (
        _cycles(df, seeds)
        .withColumn("split", F.when(fold == wanted, "test").otherwise("train"))
        .select("cycle", *df.columns, "split")
    )


def grouped_split(
    df: DataFrame, group: str, target: str, seed: int = 42, n_folds: int = 5
) -> DataFrame:
    """A single group split."""
    return repeated_grouped(df, group, target, [seed], n_folds).drop("cycle")


def straddling_groups(split: DataFrame, group: str) -> DataFrame:
    """Number of groups with rows on both sides (must be 0)."""
    return (
        split.groupBy(group)
        .agg(F.min("split").alias("a"), F.max("split").alias("b"))
        .agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_straddling"),
             F.count("*").alias("n_groups"))
    )
