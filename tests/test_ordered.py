import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from compscope.operators import ordered, profile, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one score value a third of them."""
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "g": np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n)),
        "v": np.where(rng.random(n) < 0.33, 7.0, rng.normal(size=n).round(3)),
        "c": np.where(rng.random(n) < 0.33, 0, rng.integers(1, 200, n)),
    })
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_running_totals_equal_window(skewed):
    _, df = skewed
    got = ordered.running_totals(
        df, ["g"], [F.col("v").desc(), F.col("id")], {"n": F.lit(1), "s": F.col("c")}, totals=True
    )
    w = Window.partitionBy("g").orderBy(F.desc("v"), "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy("g")
    want = df.withColumns({
        "n": F.sum(F.lit(1)).over(w), "s": F.sum("c").over(w),
        "n_total": F.sum(F.lit(1)).over(whole), "s_total": F.sum("c").over(whole),
    }).select(got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("window", [10**9, 0])
def test_exact_quantiles(skewed, window):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = ordered.exact_quantiles(df, ["g"], "v", probs, window)
    for g, q in got.collect():
        assert np.allclose(q, np.quantile(pdf[pdf.g == g].v, probs))
    whole = ordered.exact_quantiles(df, [], "v", probs, window).first()[0]
    assert np.allclose(whole, np.quantile(pdf.v, probs))


def test_quantiles_of_a_large_group_inside_brackets(spark):
    pdf = pd.DataFrame({"v": np.random.default_rng(3).normal(size=200_000)})
    got = ordered.scalar_quantiles(spark.createDataFrame(pdf), "v", [0.1, 0.5, 0.77])
    assert np.allclose(got, np.quantile(pdf.v, [0.1, 0.5, 0.77]), atol=0)


def test_curve_is_monotone_and_complete(skewed):
    pdf, df = skewed
    curve = ranking.addressability_curve(df, "g", "c", "v", "id", 0.5).toPandas()
    for g, part in curve.sort_values("rank").groupby("Dataset"):
        rows = pdf[pdf.g == g]
        assert part["rank"].tolist() == list(range(1, len(rows) + 1))
        assert part.scaff_addr.is_monotonic_increasing and part.cmpd_addr.is_monotonic_increasing
        assert part.scaff_addr.iloc[-1] == rows.c.nunique()
        assert np.isclose(part.cmpd_addr.iloc[-1], (rows.v > 0.5).mean())


def test_nan_scores_sort_last(spark):
    df = spark.createDataFrame(
        [(1, "d", "x", float("nan")), (2, "d", "y", 0.9), (3, "d", "y", 0.1)],
        "id long, ds string, cl string, s double",
    )
    curve = {r["row_id"]: r for r in
             ranking.addressability_curve(df, "ds", "cl", "s", "id").collect()}
    assert [curve[i]["rank"] for i in (2, 3, 1)] == [1, 2, 3]
    assert curve[1]["scaff_addr"] == 2 and np.isclose(curve[1]["cmpd_addr"], 1 / 3)


def test_best_row_stays_whole(spark):
    df = spark.createDataFrame(
        [(1, "d", 1, 0.5, "a"), (2, "d", 1, 0.9, None), (3, "d", None, 1.0, "n"),
         (4, "d", 1, 0.9, "late")],
        "id long, ds string, cl int, s double, note string",
    )
    best = ranking.best_per_cluster(df, "ds", "cl", "s", "id").collect()
    assert [(r["id"], r["note"]) for r in best] == [(2, None)]


def test_two_levels_equal_one(skewed, monkeypatch):
    """Groups over the window size are split; the rows are the same, with one shuffle otherwise."""
    _, df = skewed
    order, measures = [F.col("v").desc(), F.col("id")], {"n": F.lit(1), "s": F.col("c")}
    for keys in (["g"], []):
        one = ordered.running_totals(df, keys, order, measures, totals=True)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 1
        monkeypatch.setattr(ordered, "WINDOW_ROWS", 100)
        two = ordered.running_totals(df, keys, order, measures, totals=True)
        monkeypatch.undo()
        assert two.exceptAll(one).count() == 0 and two.count() == one.count()
    assert ordered.running_totals(df.limit(0), ["g"], order, measures).count() == 0


def test_box_statistics_do_not_gather_a_group(spark):
    """Rows meet the quartiles and brackets of their group where they are: no join sorts or shuffles them."""
    rows = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 5.0), (None, 1.0)], "k string, v double")
    out = profile.box_stats(rows, ["k"], "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r["k"]: (r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"]) for r in out.collect()}
    assert got == {"a": (25.0, 50.0, 75.0, 0.0, 100.0), "b": (5.0, 5.0, 5.0, 5.0, 5.0)}
