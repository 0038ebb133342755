"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF
from oracle_check import compare

from compscope.operators import features, models
from compscope.queries import ORACLES, QUERIES, learning


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_models_learn_where_there_is_something_to_learn(spark):
    """The net price follows price and discount. (The labels of the embeddings are noise: even a
    linear fit stays at an AUC of 0.49 on 2,000 rows, so a floor there would test luck.)"""
    split = learning._priced(spark, SF)
    assert learning._test_metrics(split, models.REGRESSOR, "StochasticBoosting").first()[
        "pearsonR"
    ] > 0.6
    classed = learning._priced(spark, SF, classes=True)
    for algorithm in ("RandomForest", "ExtraTrees", "Boosting"):
        assert learning._test_metrics(classed, models.CLASSIFIER, algorithm).first()["AUC"] > 0.8


def test_classifier_report_is_complete(spark):
    split = learning._priced(spark, SF, classes=True)
    r = learning._test_metrics(split, models.CLASSIFIER, "RandomForest").first()
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == split.where("split = 'test'").count()
    assert all(0 <= r[m] <= 1 for m in ("ACC", "AUC", "MAP")) and -1 <= r["MCC"] <= 1


def test_preprocessing_is_fitted_once_and_members_are_shared(spark, monkeypatch):
    calls = []
    fit = features.CorrelationFilter._fit
    monkeypatch.setattr(features.CorrelationFilter, "_fit", lambda self, df: calls.append(1) or fit(self, df))
    train = learning._priced(spark, SF).where("split = 'train'")
    fitted = models.fit_all(train, models.REGRESSOR, models.ALGORITHMS, "features", 2, 2)
    assert len(calls) == 1 and list(fitted) == list(models.ALGORITHMS)
    assert fitted["Consensus"].members == [fitted[a].members[0] for a in models.MEMBERS]


def test_boosted_regressor_is_trained_whole(spark, monkeypatch):
    """Its query asks for the library's 500 trees of depth 5 (here two are grown), with a place for checkpoints."""
    asked, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda df, task, algorithm, features, trees, depth: asked.append(
        (task, algorithm, trees, depth)) or fit(df, task, algorithm, features, 2, 2))
    assert QUERIES["train_regressor_gbt"](spark, SF).count() == 1
    assert asked == [(models.REGRESSOR, "StochasticBoosting", 500, 5)]
    assert spark.sparkContext.getCheckpointDir()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
