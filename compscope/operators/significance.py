"""Paired significance tests over cross-validation scores.

The long score table has one row per (x, group, block): x is the category a test is run for, the
groups are compared, the blocks are the cycles. Ranks and statistics are windows and aggregates;
only the p-value of the one-row-per-test result is a Python function. The number of blocks is a
number of training runs, so the windows here are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.distributions import chi2_p_column, t_p_column, wilcoxon_p_column

DIGITS = 12


def _average_rank(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``_rank``: average rank of the value among its ties; ``_ties``: how many share it."""
    valued = df.withColumn("_v", F.round(value, DIGITS))
    order = Window.partitionBy(*keys).orderBy("_v")
    same = Window.partitionBy(*keys, "_v")
    return valued.withColumn("_ties", F.count("*").over(same)).withColumn(
        "_rank", F.rank().over(order) + (F.col("_ties") - 1) / 2
    )


def choose_test(scores: DataFrame, x: str, group: str) -> DataFrame:
    """Wilcoxon for two groups, Friedman for three or more, none otherwise."""
    return scores.groupBy(x).agg(F.countDistinct(group).alias("n_groups")).withColumn(
        "test",
        F.when(F.col("n_groups") == 2, "wilcoxon")
        .when(F.col("n_groups") >= 3, "friedman")
        .otherwise("none"),
    )


def wilcoxon(
    scores: DataFrame, x: str, group: str, block: str, score: str, exact_pairs: int = 50
) -> DataFrame:
    """Signed-rank test of the two groups of every x; zero differences are left out.

    The p-value is exact up to ``exact_pairs`` pairs without ties or zeros, else a normal
    approximation.
    """
    pairs = scores.groupBy(x, block).agg(
        (F.max_by(score, group) - F.min_by(score, group)).alias("_d"),
        F.countDistinct(group).alias("_g"),
    ).where("_g = 2")
    zeros = pairs.groupBy(x).agg(
        F.count(F.when(F.round("_d", DIGITS) == 0, 1)).alias("n_zero")
    )
    ranked = _average_rank(
        pairs.where(F.round("_d", DIGITS) != 0), [x], F.abs(F.col("_d"))
    )
    stats = ranked.groupBy(x).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0)).alias("w_minus"),
        # Each tie group of size t adds t^3 - t, spread over its t members.
        F.sum(F.col("_ties") * F.col("_ties") - 1).cast("double").alias("tie_term"),
    )
    out = zeros.join(stats, x, "left").fillna(0, ["n", "w_plus", "w_minus", "tie_term"])
    out = out.withColumn("statistic", F.least("w_plus", "w_minus"))
    exact = (F.col("n") <= exact_pairs) & (F.col("n_zero") == 0) & (F.col("tie_term") == 0)
    return out.withColumn(
        "p_value", wilcoxon_p_column(F.col("statistic"), F.col("n"), F.col("tie_term"), exact)
    )


def complete_blocks(
    scores: DataFrame, x: str, group: str, block: str, score: str
) -> tuple[DataFrame, DataFrame]:
    """The scores of blocks in which every group of their x has one non-null score, and per x
    ``n_dropped_blocks``. An x without a complete block is an error."""
    valued = scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    groups = scores.groupBy(x).agg(F.countDistinct(group).alias("_groups"))
    held = valued.groupBy(x, block).agg(
        F.countDistinct(group).alias("_here"), F.count("*").alias("_rows")
    )
    whole = (F.col("_here") == F.col("_groups")) & (F.col("_rows") == F.col("_groups"))
    judged = scores.select(x, block).distinct().join(held, [x, block], "left").join(groups, x)
    judged = judged.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    dropped = judged.groupBy(x).agg(
        F.count(F.when(~F.col("_whole"), 1)).alias("n_dropped_blocks"),
        F.count(F.when(F.col("_whole"), 1)).alias("_kept"),
    )
    none = F.raise_error(F.concat(F.lit("no complete block for "), F.col(x).cast("string")))
    dropped = dropped.select(
        x, F.when(F.col("_kept") > 0, F.col("n_dropped_blocks")).otherwise(none).alias("n_dropped_blocks")
    )
    return valued.join(judged.where("_whole").select(x, block), [x, block], "left_semi"), dropped


def _friedman_parts(scores: DataFrame, x: str, group: str, block: str, score: str):
    """Ranks inside each complete block, rank sums per group, and per-x totals."""
    scores, dropped = complete_blocks(scores, x, group, block, score)
    ranked = _average_rank(scores, [x, block], F.col(score))
    sums = ranked.groupBy(x, group).agg(F.sum("_rank").alias("rank_sum"))
    blocks = ranked.groupBy(x).agg(
        F.countDistinct(block).alias("n_blocks"),
        F.countDistinct(group).alias("n_groups"),
        F.sum(F.col("_rank") * F.col("_rank")).alias("rank_squares"),
        F.sum(F.col("_ties") * F.col("_ties") - 1).cast("double").alias("tie_term"),
    )
    squares = sums.groupBy(x).agg(F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("sum_squares"))
    return sums, dropped.join(blocks, x).join(squares, x)


def friedman(scores: DataFrame, x: str, group: str, block: str, score: str) -> DataFrame:
    """Tie-corrected Friedman chi-square over the complete blocks of every x."""
    _, parts = _friedman_parts(scores, x, group, block, score)
    n, k = F.col("n_blocks").cast("double"), F.col("n_groups").cast("double")
    correction = 1 - F.col("tie_term") / (n * k * (k * k - 1))
    plain = 12 / (n * k * (k + 1)) * F.col("sum_squares") - 3 * n * (k + 1)
    return parts.select(
        x, "n_blocks", "n_dropped_blocks", "n_groups", F.try_divide(plain, correction).alias("statistic")
    ).withColumn(
        "p_value", chi2_p_column(F.col("statistic"), F.col("n_groups") - 1)
    )


def conover_pairs(scores: DataFrame, x: str, group: str, block: str, score: str) -> DataFrame:
    """Conover's post-hoc t statistic for every pair of groups, with Holm-adjusted p-values."""
    sums, parts = _friedman_parts(scores, x, group, block, score)
    a = sums.select(x, F.col(group).alias("group_a"), F.col("rank_sum").alias("sum_a"))
    b = sums.select(x, F.col(group).alias("group_b"), F.col("rank_sum").alias("sum_b"))
    n, k = F.col("n_blocks").cast("double"), F.col("n_groups").cast("double")
    spread = F.sqrt(
        2 * (n * F.col("rank_squares") - F.col("sum_squares")) / ((n - 1) * (k - 1))
    )
    # One pair per two models of a benchmark, not per two data rows.
    pairs = a.join(b, x).where(F.col("group_a") < F.col("group_b")).join(parts, x)
    tested = pairs.select(
        x, "group_a", "group_b",
        F.try_divide(F.abs(F.col("sum_a") - F.col("sum_b")), spread).alias("t_statistic"),
        ((n - 1) * (k - 1)).cast("int").alias("df"),
    ).withColumn("p_value", t_p_column(F.col("t_statistic"), F.col("df")))
    return holm_adjust(tested, [x], "p_value", ["group_a", "group_b"])


def test_by_category(scores: DataFrame, x: str, group: str, block: str, score: str) -> DataFrame:
    """The test that fits each x, run: ``x, n_groups, test, n_blocks, statistic, p_value``.

    Wilcoxon for two groups, Friedman for three or more; a single group has no statistic. For
    Wilcoxon, ``n_blocks`` counts the pairs that differ.
    """
    chosen = choose_test(scores, x, group)

    def part(test: str) -> DataFrame:
        return scores.join(chosen.where(F.col("test") == test).select(x), x, "left_semi")

    two = wilcoxon(part("wilcoxon"), x, group, block, score)
    more = friedman(part("friedman"), x, group, block, score)
    results = two.select(x, F.col("n").cast("bigint").alias("n_blocks"), "statistic", "p_value").unionByName(
        more.select(x, F.col("n_blocks").cast("bigint").alias("n_blocks"), "statistic", "p_value")
    )
    return chosen.join(results, x, "left")


def holm_adjust(df: DataFrame, keys: list[str], p: str, ties: list[str]) -> DataFrame:
    """Holm step-down adjustment of the p-values of each family, as ``p_adjusted``."""
    family = Window.partitionBy(*keys)
    order = family.orderBy(p, *ties)
    stepped = df.withColumn("_m", F.count("*").over(family)).withColumn(
        "_step", F.least(F.col(p) * (F.col("_m") - F.row_number().over(order) + 1), F.lit(1.0))
    )
    return stepped.withColumn(
        "p_adjusted",
        F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    ).drop("_m", "_step")
