"""Stored sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from compscope.operators import libraries, sketches
from compscope.sources.sketch_store import add_sketches, load_sketches

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def keys(spark):
    """Some 60,000 keys, far more than a sketch of 2^9 entries holds; c lies within b."""
    ids = spark.range(60_000)
    a = ids.where("id < 40000").select(F.lit("a").alias("lib"), F.col("id").cast("string").alias("k"), "id")
    b = ids.where("id >= 30000").select(F.lit("b").alias("lib"), F.col("id").cast("string").alias("k"), "id")
    c = ids.where("id >= 58000").select(F.lit("c").alias("lib"), F.col("id").cast("string").alias("k"), "id")
    return a.unionByName(a).unionByName(b).unionByName(c).cache()


def regions(df):
    return {r["region"]: r for r in df.collect()}


def test_estimates_bracket_the_exact_counts(keys):
    made = sketches.sketch_keys(keys, "lib", "k", lg_k=9)
    exact = {r["region"]: r["n_keys"] for r in libraries.overlap_regions(keys, "k", "lib", NAMES, True).collect()}
    found = regions(sketches.overlap_from_sketches(made, NAMES))
    assert set(found) == set(exact)
    for name, r in found.items():
        assert r["low"] <= exact[name] <= r["high"], name
    # The stated margin for 30,000 of 60,000 keys is some 3,700 with 2^12 entries.
    sharp = regions(sketches.overlap_from_sketches(sketches.sketch_keys(keys, "lib", "k"), NAMES))["a"]
    assert 25_000 < sharp["low"] <= 30_000 <= sharp["high"] < 35_000
    unique = {r["Dataset"]: r for r in sketches.unique_from_sketches(made).collect()}
    for name, n in (("a", 40_000), ("b", 30_000), ("c", 2_000)):
        assert unique[name]["low"] <= n <= unique[name]["high"]
    both = sketches.union_from_sketches(made, ["a", "b"]).first()
    assert both["low"] <= 60_000 <= both["high"] and both["estimate"] != 40_000


def test_small_libraries_are_exact(keys):
    few = keys.where("id % 50 = 0")
    exact = {r["region"]: r["n_keys"] for r in libraries.overlap_regions(few, "k", "lib", NAMES, True).collect()}
    found = regions(sketches.overlap_from_sketches(sketches.sketch_keys(few, "lib", "k"), NAMES))
    assert {n: r["estimate"] for n, r in found.items()} == exact
    assert all(r["low"] == r["high"] == r["estimate"] for r in found.values())


def test_batches_in_a_store_equal_one_pass_and_repeats_change_nothing(spark, keys, tmp_path):
    path = str(tmp_path / "sketches")
    whole = sketches.sketch_keys(keys, "lib", "k")
    for part in (0, 1, 1, 2):
        add_sketches(sketches.sketch_keys(keys.where(F.col("id") % 3 == part), "lib", "k"), path)
    stored = load_sketches(spark, path)
    assert stored.count() == 3
    one = {r["Dataset"]: r for r in sketches.unique_from_sketches(whole).collect()}
    two = {r["Dataset"]: r for r in sketches.unique_from_sketches(stored).collect()}
    for name, n in (("a", 40_000), ("b", 30_000), ("c", 2_000)):
        assert one[name]["low"] <= n <= one[name]["high"] and two[name]["low"] <= n <= two[name]["high"]
    assert two["c"]["estimate"] == 2_000


def test_nulls_empty_tables_and_unlike_sketches(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), (None, "y")], "lib string, k string")
    made = sketches.sketch_keys(rows, "lib", "k")
    assert [tuple(r) for r in sketches.unique_from_sketches(made).collect()] == [("a", 2.0, 2.0, 2.0)]
    found = regions(sketches.overlap_from_sketches(made, ["a", "missing"]))
    assert {n: r["estimate"] for n, r in found.items()} == {"a": 2.0, "missing": 0.0, "a&missing": 0.0}
    none = sketches.sketch_keys(rows.limit(0), "lib", "k")
    assert none.count() == 0 and sketches.unique_from_sketches(none).count() == 0
    assert sketches.union_from_sketches(none, ["a"]).first()["estimate"] == 0
    with pytest.raises(ValueError, match="lg_k"):
        sketches.unique_from_sketches(made.unionByName(sketches.sketch_keys(rows, "lib", "k", 9)))
