"""Fits with validation rows (K05, M07) and a racing search under a budget.

``fit_validated`` boosts all rounds, reads the validation loss after each in one pass (V11) and keeps the best
prefix of trees.  ``race`` fits many candidates on few rows and few candidates on many: between rungs the worse ones are
dropped, rungs are nested exact samples, and the rows fitted never exceed the budget.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import priority, scalar_key
from tessera.functions.ranking import cumulative
from tessera.operators.evaluation import learning_curve
from tessera.operators.models import ModelConfig, TrainedModel, fit_model
from tessera.session import cut_lineage


def first_trees(model, n: int):
    """A boosted MLlib model of the first ``n`` trees of ``model``, with its columns and parameters."""
    if not 1 <= n <= model.getNumTrees:
        raise ValueError(f"{n} trees of {model.getNumTrees}")
    java = model._java_obj
    gateway = SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(list(zip(java.trees(), java.treeWeights(), strict=True))[:n]):
        trees[i], weights[i] = tree, weight
    package = gateway.jvm.org.apache.spark.ml
    if isinstance(model, GBTClassificationModel):
        short = package.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    else:
        short = package.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    return type(model)(java.copyValues(short, java.extractParamMap()))


def fit_validated(config: ModelConfig, train: DataFrame, validation: DataFrame, task_type: str, n_classes: int = 0,
                  features: str = "features", label: str = "label") -> tuple[TrainedModel, dict]:
    """A model and how validation shaped it: ``rounds`` fitted and ``chosen`` (the first round of least validation loss), ``losses``.

    Boosted trees of two classes or of values keep the trees up to the chosen round; other models have no rounds and are
    fitted on the training rows alone (``chosen`` is None).  Without validation rows nothing is cut."""
    model = fit_model(config, train, task_type, n_classes, features, label)
    if not isinstance(model.model, (GBTClassificationModel, GBTRegressionModel)) or validation.isEmpty():
        return model, {"rounds": None, "chosen": None, "losses": []}
    curve = learning_curve(model.model, {"validation": validation}, features, label)
    losses = [r["loss"] for r in curve.orderBy("round").collect()]  # one per round
    chosen = min(range(len(losses)), key=lambda i: (losses[i], i)) + 1
    kept = replace(model, model=first_trees(model.model, chosen))
    return kept, {"rounds": len(losses), "chosen": chosen, "losses": losses}


@dataclass
class Race:
    """Outcome of a race: ``steps`` (candidate, rung, rows, score, kept), the winner's place among the configurations, its model
    and the rows fitted in all."""

    steps: list[dict]
    winner: int
    model: TrainedModel
    rows: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(s.values()) for s in self.steps],
                                     "candidate int, rung int, rows long, score double, kept boolean")


def rungs_of(candidates: int, rows: int, budget: int, eta: int = 3) -> list[tuple[int, int]]:
    """(candidates, rows of each fit) by rung: every rung has an equal part of the budget, and no fit more rows than there are."""
    sizes = [candidates]
    while sizes[-1] > 1:
        sizes.append(max(1, sizes[-1] // eta))
    part = budget // len(sizes)
    return [(n, min(rows, part // n)) for n in sizes]


def race(configs: Sequence[ModelConfig], train: DataFrame, validation: DataFrame, key: str | Sequence[str], score: Callable[[DataFrame], float],
         direction: str, budget: int, task_type: str, n_classes: int = 0, eta: int = 3, seed: int = 42, least: int = 20) -> Race:
    """Race ``configs``: rung by rung, fit each candidate on a sample of the training rows, score its predictions of the
    validation rows and keep the best ``1 / eta`` (missing scores last, ties by the order given).

    ``budget`` is in training rows, added over all fits; it is never exceeded, and one too small for ``least`` rows a fit is an error.
    Samples are the first rows by seeded priority of ``key`` (unique), so each rung's rows contain those of the rung before."""
    if not configs or eta < 2 or direction not in ("max", "min"):
        raise ValueError("a race needs candidates, an eta of 2 or more and a direction")
    keys = [key] if isinstance(key, str) else list(key)
    name = F.concat_ws("\x1f", *[scalar_key(k, train.schema[k].dataType) for k in keys])
    marked = train.withColumns({"_one": F.lit(1).cast("long"), "_pr": priority(seed, name), "_name": name})
    ranked = cut_lineage(cumulative(marked, [], ["_pr", "_name"], weight="_one", before="_place", total="_rows"))
    rows = ranked.count()
    plan = rungs_of(len(configs), rows, budget, eta)
    if min(n for _, n in plan) < min(least, rows) or not rows:
        raise ValueError(f"a budget of {budget} rows leaves {min(n for _, n in plan)} rows for a fit of {len(configs)} candidates")
    alive, steps, spent, best = list(range(len(configs))), [], 0, None
    for rung, (n, size) in enumerate(plan):
        sample = ranked.where(F.col("_place") < size).drop("_one", "_pr", "_name", "_place", "_rows")
        scored = []
        for at in alive:
            model = fit_model(configs[at], sample, task_type, n_classes)
            value = score(model.predict(validation))
            spent += size
            missing = value is None or value != value
            scored.append((missing, 0.0 if missing else -value if direction == "max" else value, at, model, None if missing else float(value)))
        scored.sort(key=lambda s: s[:3])
        stay = plan[rung + 1][0] if rung + 1 < len(plan) else 1
        alive = sorted(s[2] for s in scored[:stay])
        steps += [{"candidate": s[2], "rung": rung, "rows": size, "score": s[4], "kept": i < stay} for i, s in enumerate(scored)]
        best = scored[0]
    assert spent <= budget
    return Race(steps, best[2], best[3], spent)
