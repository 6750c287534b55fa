"""Fits of a comparison run at the same time and share what they need of the training table."""

from threading import Barrier

from pyspark.sql import functions as F

from gridloom.operators import models

NAMES = list("abc")


def _rows(spark, n=400):
    df = spark.range(n).withColumns({c: F.round(F.rand(i), 3) for i, c in enumerate(NAMES)})
    return df.withColumn("y", (F.col("a") + 0.2 * F.col("b") > 0.6).cast("int"))


def test_fits_and_ensemble_members_run_together(spark, monkeypatch):
    """Two presets and the two boosted members of the vote wait for each other; the bins are found once."""
    together, found = Barrier(4), []
    real_fit, real_cuts = models.fit_boosted, models.bin_cuts

    def fit(*args):
        together.wait(timeout=120)
        return real_fit(*args)

    def cuts(*args):
        found.append(args[2])
        return real_cuts(*args)

    monkeypatch.setattr(models, "fit_boosted", fit)
    monkeypatch.setattr(models, "bin_cuts", cuts)
    out = models.compare_classifiers(_rows(spark), NAMES, "y", "id", 3, 3, names=["xgboost", "catboost"])
    assert sorted(r["model"] for r in out.results.collect()) == ["catboost", "ensemble_voting", "xgboost"]
    assert found == [64]


def test_shared_bins_give_the_same_models(spark):
    df, bins = _rows(spark).localCheckpoint(), models.Bins()
    presets = {n: p for n, p in models.classifier_presets(4, 400).items() if n != "logistic_regression"}
    shared = {n: models.train(df, NAMES, "y", p, n, bins).model for n, p in presets.items()}
    for name, preset in presets.items():
        own = models.train(df, NAMES, "y", preset, name).model
        assert own.cuts == shared[name].cuts
        assert [str(t) for t in own.trees] == [str(t) for t in shared[name].trees]
