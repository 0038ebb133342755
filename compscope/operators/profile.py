"""Descriptive tables: counts, bins, histograms, box statistics, score summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import round_half_even
from ..session import materialise
from .ordered import exact_quantiles, rank_in_group, scalar_quantiles


def unique_keys_per_dataset(
    df: DataFrame, dataset: str, key: str, approximate: bool = False
) -> DataFrame:
    """Number of distinct keys per data set; one row per pair is shuffled, not one per row."""
    if approximate:
        return df.groupBy(dataset).agg(F.approx_count_distinct(key).alias("n_unique"))
    return (
        df.select(dataset, key).distinct().groupBy(dataset).agg(F.count(key).alias("n_unique"))
    )


def positive_fraction(df: DataFrame, positive: Column) -> DataFrame:
    """Share of the positive class in percent."""
    return df.agg(
        F.count("*").alias("n_rows"), (F.avg(positive.cast("int")) * 100).alias("positive_pct")
    )


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """0-based right-closed bin of a value between sorted edges; the lowest edge is included."""
    above = F.lit(0)
    for e in edges:
        above = above + (value > F.lit(float(e))).cast("int")
    return F.when(value.isNotNull(), F.greatest(above - 1, F.lit(0)))


def quantile_edges(df: DataFrame, value: str, n_bins: int = 10) -> list[float]:
    """Distinct quantile edges, ``n_bins + 1`` numbers at most."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    return sorted(set(scalar_quantiles(df, value, probs)))


def quantile_bins(df: DataFrame, value: str, n_bins: int = 10, name: str = "bin") -> DataFrame:
    """Quantile bin of each row; coinciding edges are merged."""
    return df.withColumn(name, bin_of(F.col(value), quantile_edges(df, value, n_bins)))


def histogram(
    df: DataFrame, value: str, colour: Sequence[str] = (), n_bins: int = 20
) -> DataFrame:
    """Equal-width histogram, one count per bin and colour; the maximum is in the last bin. Nulls
    and NaN are in no bin."""
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        raise ValueError(f"column {value!r} has no values")
    lo, width = float(lo), (float(hi) - float(lo)) / n_bins
    pos = F.floor((F.col(value) - F.lit(lo)) / F.lit(width)) if width else F.lit(0)
    return (
        df.withColumn("bin", F.least(pos, F.lit(n_bins - 1)).cast("int"))
        .groupBy("bin", *colour)
        .agg(F.count("*").alias("n"))
        .withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width))
    )


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, extremes, whiskers (furthest rows within 1.5 IQR) and the annotation height."""
    quart = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75]).select(
        *keys,
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    # One row per group, written: Spark knows its size, and rows are neither shuffled nor sorted by group.
    quart = materialise(quart, "quartiles")
    v = F.col(value)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return (
        df.select(*keys, value)
        .join(quart, list(keys))
        .groupBy(*keys)
        .agg(
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(v).alias("lo"),
            F.max(v).alias("hi"),
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_lo"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_hi"),
            (F.max(v) * 1.1).alias("annotation_height"),
        )
    )


def cv_summary(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean (two decimals) and sample deviation of every metric over the cycles."""
    aggs = []
    for m in metrics:
        aggs += [
            round_half_even(F.avg(m), 2).alias(f"Val_{m}"),
            F.stddev_samp(m).alias(f"Val_{m}_std"),
        ]
    return scores.groupBy(*keys).agg(*aggs)


def bar_bounds(summary: DataFrame, validation: str, test: str, deviation: str) -> DataFrame:
    """Axis range of the score bars: 0.6 x the lowest and 1.03 x the highest bar with deviation."""
    sd = F.max(deviation)
    return summary.agg(
        (0.6 * F.least(F.min(validation) - sd, F.min(test) - sd)).alias("y_min"),
        (1.03 * F.greatest(F.max(validation) + sd, F.max(test) + sd)).alias("y_max"),
    )


def parity_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ends of the parity line: a tenth below the minimum, 15 % above the maximum."""
    aggs = []
    for c in columns:
        lo, hi = F.min(c), F.max(c)
        aggs += [
            (lo - F.abs(0.1 * lo)).alias(f"{c}_lo"),
            (hi + F.abs(0.15 * hi)).alias(f"{c}_hi"),
        ]
    return df.agg(*aggs)


def row_number_in_group(df: DataFrame, keys: Sequence[str], row_id: str, name: str) -> DataFrame:
    """1-based row number inside each group in ``row_id`` order."""
    return rank_in_group(df, keys, [F.col(row_id).asc()], name).drop(f"{name}_total")


def metrics_pivot(
    scores: DataFrame, keys: Sequence[str], metric: str, value: str, metrics: Sequence[str]
) -> DataFrame:
    """Long scores to one row per model with the metric columns in the given order."""
    wide = scores.groupBy(*keys).pivot(metric, list(metrics)).agg(F.first(value))
    return wide.select(*keys, *metrics)


def arrange_columns(df: DataFrame, priority: Sequence[str], prefix: dict[str, str]) -> DataFrame:
    """Rename column prefixes, then put the priority columns first."""
    names = {}
    for c in df.columns:
        for old, new in prefix.items():
            if c.startswith(old):
                names[c] = new + c[len(old):]
    out = df.withColumnsRenamed(names)
    first = [c for c in priority if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])
