"""Addressability curves, best rows and score orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import exact_quantiles, running_totals


def _clean(score: str):
    """NaN sorts last, like null."""
    return F.when(~F.isnan(F.col(score).cast("double")), F.col(score))


def _best_first(score: Column, row_id: Column) -> Column:
    """A struct whose smallest value is the best row: the highest score (no score last), then the
    smallest id, whatever its type."""
    return F.struct(score.isNull().alias("none"), (-score).alias("score"), row_id.alias("id"))


def addressability_curve(
    df: DataFrame,
    dataset: str,
    cluster: str,
    score: str,
    row_id: str,
    threshold: float = 0.5,
) -> DataFrame:
    """Per data set, in falling score order (ties by ``row_id``): ``rank``, ``scaff_addr`` =
    clusters met so far, ``cmpd_addr`` = share of all rows that scored above the threshold so far.

    ``row_id`` is unique within a data set and of any type that has an order. The first row of
    each cluster comes from an aggregate, not from a window over the cluster, so a cluster or data
    set may hold most of the rows.
    """
    rows = df.select(
        F.col(dataset).alias("Dataset"),
        F.col(cluster).alias("_cluster"),
        _clean(score).alias("_score"),
        F.col(row_id).alias("row_id"),
    )
    firsts = rows.groupBy("Dataset", "_cluster").agg(
        F.min(_best_first(F.col("_score"), F.col("row_id"))).alias("_b")
    )
    first = firsts.select(
        F.col("Dataset").alias("_d"), F.col("_b.id").alias("_i"), F.lit(1).cast("bigint").alias("_first")
    )
    flagged = rows.drop("_cluster").join(
        first, F.col("Dataset").eqNullSafe(F.col("_d")) & (F.col("row_id") == F.col("_i")), "left"
    ).drop("_d", "_i")
    summed = running_totals(
        flagged,
        ["Dataset"],
        [F.col("_score").desc_nulls_last(), F.col("row_id").asc()],
        {
            "rank": F.lit(1).cast("bigint"),
            "scaff_addr": F.coalesce(F.col("_first"), F.lit(0).cast("bigint")),
            "_pos": F.coalesce((F.col("_score") > threshold).cast("bigint"), F.lit(0)),
        },
        totals=True,
    )
    return summed.select(
        "Dataset",
        "rank",
        "row_id",
        "scaff_addr",
        (F.col("_pos") / F.col("rank_total")).alias("cmpd_addr"),
    )


def best_per_cluster(
    df: DataFrame, dataset: str, cluster: str, score: str, row_id: str
) -> DataFrame:
    """The whole best row of each (cluster, data set); rows with a null key are left out."""
    keys = [cluster, dataset]
    rest = [c for c in df.columns if c not in keys]
    order = _best_first(_clean(score), F.col(row_id))
    return (
        df.where(F.col(cluster).isNotNull() & F.col(dataset).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_best"))
        .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def order_by_score(df: DataFrame, score: str, row_id: str, k: int | None = None) -> DataFrame:
    """Rows by falling score (range-partitioned sort), or only the top ``k`` of them."""
    ordered = df.orderBy(F.col(score).desc_nulls_last(), F.col(row_id).asc())
    return ordered if k is None else ordered.limit(k)


def score_threshold_stats(df: DataFrame, dataset: str, score: str) -> DataFrame:
    """Bounds and default threshold (median) of a score per data set."""
    bounds = df.groupBy(dataset).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    median = exact_quantiles(df, [dataset], score, [0.5])
    return bounds.join(median, dataset, "left").select(
        dataset, "lo", "hi", F.col("quantiles")[0].alias("median")
    )
