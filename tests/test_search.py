"""Fits with validation rows (K05, M07) and the racing search."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators.evaluation import learning_curve
from tessera.operators.models import ModelConfig, TrainedModel, fit_model, same_predictions
from tessera.operators.search import first_trees, fit_validated, race, rungs_of
from tessera.session import checkpoint_dir


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    made = [(i, "validation" if i % 4 == 0 else "train", Vectors.dense(x[i]), float(y[i]), float(x[i, 1] * 3 + rng.normal())) for i in range(400)]
    return spark.createDataFrame(made, ["k", "split", "features", "label", "value"])


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_the_best_prefix_is_kept(rows, task):
    data = rows if task == "classification" else rows.withColumn("label", F.col("value"))
    train, val = data.where("split = 'train'"), data.where("split = 'validation'")
    config = ModelConfig("sklearn", "gradient_boosting", {"n_estimators": 15, "learning_rate": 0.8})
    model, told = fit_validated(config, train, val, task, 2)
    assert told["rounds"] == 15 and told["losses"][told["chosen"] - 1] == min(told["losses"]) and told["chosen"] < 15
    assert model.model.getNumTrees == told["chosen"]
    again = [r["loss"] for r in learning_curve(model.model, {"v": val}).orderBy("round").collect()]
    assert again == pytest.approx(told["losses"][:told["chosen"]])
    plain = fit_model(ModelConfig("sklearn", "gradient_boosting", {"n_estimators": told["chosen"], "learning_rate": 0.8}), train, task, 2)
    assert same_predictions(model, plain, val, "k")
    path = checkpoint_dir(rows.sparkSession).rstrip("/") + f"/validated_{task}"
    model.save(path)
    assert same_predictions(model, TrainedModel.load(path), val, "k")
    with pytest.raises(ValueError):
        first_trees(model.model, 0)


def test_models_without_rounds_and_no_validation(rows):
    train = rows.where("split = 'train'")
    for config, val in ((ModelConfig("sklearn", "logistic_regression"), rows), (ModelConfig("sklearn", "gradient_boosting", {"n_estimators": 2}), rows.limit(0))):
        model, told = fit_validated(config, train, val, "classification", 2)
        assert told == {"rounds": None, "chosen": None, "losses": []} and model.predict(rows).count() == 400


def test_rungs_stay_within_the_budget():
    for n in (1, 2, 9, 10, 40):
        for size in (1, 50, 10_000):
            for budget in (10, 999, 123_456):
                plan = rungs_of(n, size, budget)
                assert sum(c * r for c, r in plan) <= budget and plan[0][0] == n and plan[-1][0] == 1
                assert all(r <= size for _, r in plan) and [r for _, r in plan] == sorted(r for _, r in plan)


def test_race_drops_the_worse_and_keeps_the_budget(rows):
    train, val = rows.where("split = 'train'"), rows.where("split = 'validation'")
    configs = [ModelConfig("sklearn", "dummy")] * 3 + [ModelConfig("sklearn", "decision_tree", {"max_depth": d}) for d in (1, 2)]
    accuracy = lambda df: df.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    out = race(configs, train, val, "k", accuracy, "max", 700, "classification", 2)
    assert out.rows <= 700 and out.winner >= 3 and [s["rung"] for s in out.steps] == [0] * 5 + [1]
    assert sum(s["rows"] for s in out.steps) == out.rows and accuracy(out.model.predict(val)) == out.steps[-1]["score"]
    again = race(configs, train.repartition(7), val, "k", accuracy, "max", 700, "classification", 2)
    assert [s["candidate"] for s in again.steps] == [s["candidate"] for s in out.steps]
    with pytest.raises(ValueError):
        race(configs, train, val, "k", accuracy, "max", 50, "classification", 2)
