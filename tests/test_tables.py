"""Validation, rounding, splits, statistics."""

import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from compscope.functions import distributions, fingerprints, scalars
from compscope.operators import libraries, metrics, profile, significance, splits


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,ok", [
    ("CCO", True), ("c1ccccc1", True), ("C[C@H](N)C(=O)O", True), ("C%12CC%12", True),
    ("[Na+].[Cl-]", True), ("C(", False), ("c1ccccc", False), ("C)C(", False), ("", False),
    ("hello", False), ("C[N", False), (None, False),
])
def test_smiles_preset(spark, text, ok):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(fingerprints.smiles_well_formed(F.col("s"))).first()[0] is ok


def test_targets_stay_in_their_row(spark):
    df = spark.createDataFrame([(0, " CCO ", 1.0), (1, "C(", 2.0), (2, "CN", 3.0)],
                               "id int, s string, y double")
    clean, rejects = libraries.validate_key(
        df, "s", fingerprints.smiles_normalised, fingerprints.smiles_well_formed
    )
    assert {tuple(r) for r in clean.collect()} == {(0, "CCO", 1.0), (2, "CN", 3.0)}
    assert [r["id"] for r in rejects.collect()] == [1]


def test_fingerprint_of_short_and_long_strings(spark):
    def bits(text, **kw):
        return one(spark, fingerprints.qgram_fingerprint(F.lit(text), **kw))

    assert bits("") == [] and bits("ab", q=4) != []
    assert bits("abcd", q=4, hashes_per_feature=2) > bits("zzzz", q=4)[:0]
    assert len(bits("abcdefgh", q=4, n_bits=2**31 - 1)) == 5
    assert bits("a  b\nc", q=3, unit="word") == bits("a b c", q=3, unit="word")


@pytest.mark.parametrize("x,digits,want", [
    (0.00015, 4, 0.0001), (2.5, 0, 2.0), (3.5, 0, 4.0), (0.12345, 4, 0.1234), (-2.5, 0, -2.0),
])
def test_half_even(spark, x, digits, want):
    assert one(spark, scalars.round_half_even(F.lit(x), digits)) == want
    assert np.round(x, digits) == want


def test_clip_nan(spark):
    vec = F.array(F.lit(float("nan")), F.lit(1e9), F.lit(-1e9), F.lit(None).cast("double"), F.lit(2.0))
    assert one(spark, scalars.clip_vector(vec)) == [0.0, 1e5, -1e5, 0.0, 2.0]


def test_names_and_labels(spark):
    assert scalars.free_name(["a", "y"], "y") == "y_pred"
    assert scalars.free_name(["a"], "y") == "y"
    assert one(spark, scalars.prediction_label(F.lit(0.5), F.lit(2.25))) == "exp: 2.25 | pred: 0.50"


def test_group_key_per_distinct(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None), (4, "a b")], "id int, s string")
    key = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    a = libraries.derive_group_key(df, "s", key, per_distinct=True).orderBy("id").collect()
    b = libraries.derive_group_key(df, "s", key).orderBy("id").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_overlap_sums_to_distinct_keys(spark):
    df = spark.createDataFrame(
        [("x", "A"), ("x", "B"), ("y", "A"), ("y", "A"), (None, "B"), ("z", "C")],
        "k string, d string",
    )
    regions = {r["region"]: r["n_keys"] for r in libraries.overlap_regions(df, "k", "d", include_empty=True).collect()}
    assert regions == {"A": 1, "B": 1, "C": 1, "A&B": 1, "A&C": 0, "B&C": 0, "A&B&C": 0}


@pytest.mark.parametrize("zeros", [600, 630])
def test_strata_do_not_collapse(spark, zeros):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < zeros, 0.0).otherwise(1.0))
    out = splits.stratified_split(df, "id", "y", 0.2)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts[(0.0, "test")] == round(zeros * 0.2)
    assert counts[(1.0, "test")] == round((1000 - zeros) * 0.2)


def test_strata_of_skewed_numbers(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 630, 0.0).otherwise(F.col("id") * 1.0))
    out = splits.stratified_split(df, "id", "y", 0.25, seed=1)
    assert out.where("split = 'test'").count() == pytest.approx(250, abs=5)
    with pytest.raises(ValueError):
        splits.stratified_split(df, "id", "y", 20)


def test_group_split_with_a_hot_group(spark):
    df = spark.range(900).select(
        "id", F.when(F.col("id") < 300, "hot").otherwise((F.col("id") % 97).cast("string")).alias("g"),
        (F.col("id") % 2).cast("double").alias("y"),
    )
    out = splits.grouped_split(df, "g", "y", 3)
    assert splits.straddling_groups(out, "g").first()["n_straddling"] == 0
    assert out.count() == 900 and out.select("split").distinct().count() == 2


def test_tails_match_tables():
    for x, df in ((3.841, 1), (5.991, 2), (7.815, 3), (11.070, 5), (18.307, 10)):
        assert distributions.chi2_tail(x, df) == pytest.approx(0.05, abs=2e-4)
    for t, df in ((12.706, 1), (4.303, 2), (2.571, 5), (2.228, 10), (2.042, 30)):
        assert distributions.t_tail_two_sided(t, df) == pytest.approx(0.05, abs=2e-4)
    assert distributions.signed_rank_tail(0, 5) == 0.0625
    assert distributions.signed_rank_tail(8, 10) == pytest.approx(0.0488, abs=1e-4)
    assert distributions.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def scores(spark, table):
    """``{group: [score per cycle]}`` as a long table for one x."""
    rows = [("x", g, i, float(v)) for g, vs in table.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "x string, g string, b int, s double")


def test_wilcoxon(spark):
    df = scores(spark, {"a": [1.0, 2, 3, 4, 5, 6], "b": [1.1, 2.3, 2.9, 4.6, 5.8, 6.7]})
    r = significance.wilcoxon(df, "x", "g", "b", "s").first()
    # |d| = .1 .3 .1 .6 .8 .7: the two ties share rank 1.5, one of them is negative.
    assert (r["w_plus"], r["w_minus"], r["n"]) == (19.5, 1.5, 6)
    var = (6 * 7 * 13 - 6 / 2) / 24
    assert r["p_value"] == pytest.approx(math.erfc(abs((1.5 - 10.5) / math.sqrt(var)) / math.sqrt(2)))
    exact = scores(spark, {"a": [1.0, 2, 3, 4, 5], "b": [1.1, 2.2, 3.3, 4.4, 5.5]})
    assert significance.wilcoxon(exact, "x", "g", "b", "s").first()["p_value"] == 0.0625


def test_wilcoxon_of_equal_scores(spark):
    df = scores(spark, {"a": [1.0, 2], "b": [1.0, 2]})
    r = significance.wilcoxon(df, "x", "g", "b", "s").first()
    assert r["n"] == 0 and r["p_value"] is None


def test_friedman_and_conover(spark):
    # Ranks per block: a=1 b=2 c=3, except block 3 with b and c tied.
    df = scores(spark, {"a": [1.0, 1, 1, 1], "b": [2.0, 2, 2, 3], "c": [3.0, 3, 3, 3]})
    f = significance.friedman(df, "x", "g", "b", "s").first()
    ra, rb, rc = 4, 8.5, 11.5
    plain = 12 / (4 * 3 * 4) * (ra**2 + rb**2 + rc**2) - 3 * 4 * 4
    stat = plain / (1 - 6 / (4 * 3 * 8))
    assert f["statistic"] == pytest.approx(stat)
    assert f["p_value"] == pytest.approx(math.exp(-stat / 2))
    pairs = {(r["group_a"], r["group_b"]): r for r in
             significance.conover_pairs(df, "x", "g", "b", "s").collect()}
    a1 = 3 * 14 + 1 + 2 * 2.5**2
    spread = math.sqrt(2 * (4 * a1 - (ra**2 + rb**2 + rc**2)) / (3 * 2))
    assert pairs[("a", "c")]["t_statistic"] == pytest.approx(7.5 / spread)
    ordered = sorted(pairs.values(), key=lambda r: r["p_value"])
    assert ordered[0]["p_adjusted"] == pytest.approx(min(1, 3 * ordered[0]["p_value"]))
    assert ordered[1]["p_adjusted"] <= ordered[2]["p_adjusted"]


def test_average_precision_and_auc_by_hand(spark):
    df = spark.createDataFrame(
        [(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "s double, t boolean"
    )
    r = metrics.ranking_metrics(df, [], F.col("t"), "s").first()
    assert r["roc_auc"] == pytest.approx((2 + 1.5) / 4)
    assert r["avg_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_undefined_mcc_is_zero(spark):
    df = spark.createDataFrame([(True, True), (True, True)], "t boolean, g boolean")
    r = metrics.with_class_metrics(metrics.confusion(df, [], F.col("t"), F.col("g"))).first()
    assert r["mcc"] == 0.0 and r["accuracy"] == 1.0 and r["balanced_accuracy"] is None


def test_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 8 + [1, 2]], "y double")
    assert profile.quantile_edges(df, "y", 4) == [0.0, 2.0]
    out = profile.quantile_bins(df, "y", 4)
    assert {r["bin"] for r in out.collect()} == {0}


def test_cuts_read_the_rows_once(spark, monkeypatch):
    """Ids that come twice, are null or share a stratum give the lowest hashes, from one pass."""
    ids = [f"r{i // 2}" for i in range(399)] + [None] + [f"s{i}" for i in range(100)] + ["u"]
    strata = ["x"] * 400 + [None] * 100 + ["y"]
    rows = spark.createDataFrame(list(zip(ids, strata)), "id string, stratum string")
    plans = []
    write = splits.materialise
    monkeypatch.setattr(
        splits, "materialise",
        lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name),
    )
    cuts = {(r["_c"], r["_s"]): tuple(r["_cut"]) for r in splits._cuts(rows, "id", [5, 6], 0.2).collect()}
    want = {}
    for c, seed in ((1, 5), (2, 6)):
        for stratum in ("x", None):
            texts = [(md5(f"{seed}|{i}".encode() if i else str(seed).encode()).hexdigest(), i) for i, s in zip(ids, strata) if s == stratum]
            ranked = sorted(texts, key=lambda t: (t[0], t[1] or ""))
            want[c, stratum] = ranked[int(0.2 * len(texts) + 0.5) - 1]
    assert cuts == want
    assert plans[0].count("LogicalRDD") == 2  # the rows and the bounds
