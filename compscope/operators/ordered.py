"""Ranks, prefix sums and exact quantiles that never put one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise


# Groups up to this size are ranked by one task each, with one shuffle and no write.
WINDOW_ROWS = 1_000_000


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``measures`` inside each group of ``keys``, in ``order``.

    Group sizes are counted first. If no group has more than ``WINDOW_ROWS`` rows, one window over the
    group does it. Otherwise there are two levels: rows are range-partitioned by (keys, order), so a
    large group spans many slices and equal order values may be split too; each slice gets local
    running sums, and the sums of the slices before it (one row per slice and group) are added.
    ``order`` must be total. With ``totals`` the group sums come along as ``<name>_total``.
    """
    names = list(measures)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            *df.columns,
            *[F.sum(measures[n]).over(upto).alias(n) for n in names],
            *([F.sum(measures[n]).over(group).alias(f"{n}_total") for n in names] if totals else []),
        )
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    frozen = materialise(
        ranged.select(
            "*",
            *[measures[n].alias(f"_m_{n}") for n in names],
            F.spark_partition_id().alias("_slice"),
        ),
        "ranged",
    )
    local = (
        Window.partitionBy("_slice", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    per_slice = frozen.groupBy("_slice", *keys).agg(
        *[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names]
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        F.col("_slice").alias("_o_slice"),
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names],
        *([F.sum(f"_s_{n}").over(group).alias(f"_t_{n}") for n in names] if totals else []),
    )
    same = F.col("_slice") == F.col("_o_slice")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    summed = frozen.select("*", *[F.sum(f"_m_{n}").over(local).alias(f"_l_{n}") for n in names])
    return summed.join(offsets, same).select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in names],
        *([F.col(f"_t_{n}").alias(f"{n}_total") for n in names] if totals else []),
    )


def rank_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """1-based row number inside each group, with the group size as ``<name>_total``."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, totals=True)


# Groups up to this size leave at most about a million rows after compression.
WINDOW_GROUP = 200_000_000
# Rank error of the approximate quantiles is at most 1 / ACCURACY of the group.
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    window_group: int = WINDOW_GROUP,
) -> DataFrame:
    """Linear-interpolated quantiles per group as ``quantiles array<double>``; nulls are skipped.

    Large groups are not gathered: approximate quantiles (a mergeable sketch) give a narrow
    bracket around every wanted rank, the rows outside the brackets are merged into a few counts,
    and only the values inside are ranked, exactly. There is one formula at every size; groups of
    more than ``window_group`` rows have their compressed values ranked in two levels.
    """
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_v")
    )
    largest = data.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if not largest:
        return data.select(*keys, F.array(F.col("_v")).alias("quantiles")).limit(0)
    counts, group = _compressed(data, keys, sorted(set(probs)))
    if largest <= window_group:
        whole = Window.partitionBy(*group)
        upto = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.withColumns(
            {"_c": F.sum("_n").over(upto), "_c_total": F.sum("_n").over(whole)}
        )
    else:
        ranked = running_totals(
            counts, group, [F.col("_v").asc()], {"_c": F.col("_n")}, totals=True
        )
    picks, values = [], []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_c_total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = F.col("_exact") & (F.col("_c") - F.col("_n") <= pos) & (pos < F.col("_c"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        # A rank that fell outside its bracket would break the sketch's promise: fail loudly.
        values.append(
            F.when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("quantile outside bracket")))
            .otherwise(lo + (hi - lo) * F.col(f"_f{i}"))
            .cast("double")
        )
    found = ranked.groupBy(*group).agg(*picks)
    return found.select(*keys, F.array(*values).alias("quantiles"))


def _compressed(
    data: DataFrame, keys: Sequence[str], probs: Sequence[float]
) -> tuple[DataFrame, list[str]]:
    """Value counts with everything outside the quantile brackets merged: ``_v, _n, _exact``.

    A merged run keeps its largest value, so the order among runs and exact values is right.
    """
    margin = 2.0 / ACCURACY
    at = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    summary = data.groupBy(*keys).agg(
        F.count("*").alias("_size"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", [float(p) for p in at], ACCURACY).alias("_at"),
    )
    m = len(probs)
    if keys:
        # One row per group, written: Spark knows its size and sends it to the rows. Had both sides to be
        # shuffled, a group would be sorted by one task.
        data = data.join(materialise(summary, "brackets"), list(keys))
        at_col, lo, hi = F.col("_at"), F.col("_min"), F.col("_max")
        whole = F.col("_size") <= 2 * ACCURACY
    else:
        row = summary.first()
        data = data.withColumn("_all", F.lit(0))
        at_col = F.array(*[F.lit(v) for v in row["_at"]])
        lo, hi, whole = F.lit(row["_min"]), F.lit(row["_max"]), F.lit(False)
    inside, run = whole, F.lit(0)
    for i, p in enumerate(probs):
        low = lo if p - margin <= 0 else at_col[i]
        high = hi if p + margin >= 1 else at_col[m + i]
        inside |= (F.col("_v") >= low) & (F.col("_v") <= high)
        run = run + (F.col("_v") > high).cast("int")
    group = list(keys) or ["_all"]
    merged = data.select(
        *group, "_v", inside.alias("_exact"), F.when(inside, F.col("_v")).alias("_kept"),
        F.when(~inside, run).alias("_run"),
    )
    return (
        merged.groupBy(*group, "_exact", "_kept", "_run")
        .agg(F.max("_v").alias("_v"), F.count("*").alias("_n"))
        .select(*group, "_exact", "_v", "_n")
    ), group


def scalar_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Quantiles of a whole column, as a few driver-side numbers for use as literals."""
    row = exact_quantiles(df, [], value, probs).first()
    if row is None or row[0] is None:
        raise ValueError(f"column {value!r} has no values")
    return list(row[0])
