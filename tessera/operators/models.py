"""Supervised models (K03, K05, M01-M17) on ``pyspark.ml``.

The catalog maps (backend, algorithm) names onto MLlib estimators; linear models, SVM and penalised
regression minimise the stated objectives exactly as scaled there.  Documented differences: a
MLlib GBT is binary (one-vs-rest, without probabilities, for more classes), the SVM is linear, decides
without probabilities and only classifies, trees without a depth limit stop at MLlib's 30, and the MLP
uses sigmoid hidden units with L-BFGS and only classifies.  All fits run on executors; only
coefficients and trees come back to the driver.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    """Backend, algorithm, JSON params, seed."""
    backend: str
    algorithm: str
    params: dict = field(default_factory=dict)
    seed: int = 42
    categorical_columns: tuple = ()
    scale_numeric: bool = False


MAX_DEPTH = 30  # MLlib's deepest tree; a max_depth of None (no limit) means this

# Parameters and defaults that a user of the catalog may give, by algorithm.
_LINEAR = {"max_iter": 1000}
DEFAULTS = {
    "dummy": {}, "linear": {}, "linear_regression": {},
    "logistic_regression": {"C": 1.0, **_LINEAR}, "multinomial_logistic": {"C": 1.0, "solver": "lbfgs", **_LINEAR},
    "ridge": {"alpha": 1.0}, "lasso": {"alpha": 1.0, "tol": 1e-10, **_LINEAR},
    "elastic_net": {"alpha": 1.0, "l1_ratio": 0.5, "tol": 1e-10, **_LINEAR},
    "decision_tree": {"max_depth": 6, "min_samples_leaf": 2},
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1},
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "adaboost": {"n_estimators": 50, "learning_rate": 1.0},
    "svm": {"C": 1.0, "kernel": "linear", **_LINEAR},
    "knn": {"n_neighbors": 5, "weights": "uniform"},
    "gaussian_nb": {"alpha": 1.0}, "multinomial_nb": {"alpha": 1.0}, "bernoulli_nb": {"alpha": 1.0, "binarize": 0.0},
    "voting": {"n_estimators": 100}, "stacking": {"cv": 3},
    "mlp": {"hidden_sizes": [64, 32], "epochs": 30},
}
BOOSTED = {
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1},
    "lightgbm": {"n_estimators": 100, "num_leaves": 31, "learning_rate": 0.1},
    "catboost": {"iterations": 100, "depth": 6, "learning_rate": 0.1},
}


def parameters(config: ModelConfig) -> dict:
    """The defaults of the model overridden by the given parameters; a name it does not know is an error."""
    known = BOOSTED[config.backend] if config.algorithm == "boosted_trees" else DEFAULTS.get(config.algorithm)
    if known is None:
        return dict(config.params)  # registered by a caller
    strange = sorted(set(config.params) - set(known))
    if strange:
        raise ValueError(f"{config.backend}:{config.algorithm} has no parameter {', '.join(strange)}; "
                         f"it takes {', '.join(known) or 'none'}")
    return {**known, **config.params}


def _depth(p: dict) -> int:
    """Tree depth from max_depth or depth (None: no limit), or the depth that holds num_leaves leaves."""
    if "num_leaves" in p:
        return max(1, math.ceil(math.log2(p["num_leaves"])))
    depth = p.get("max_depth", p.get("depth"))
    return MAX_DEPTH if depth is None else int(depth)


def _estimator(algorithm: str, p: dict, seed: int, task_type: str, n_classes: int, train: DataFrame,
               features: str, label: str):
    """The MLlib estimator of one catalog entry."""
    classify = task_type == "classification"
    cols = {"featuresCol": features, "labelCol": label}

    def per_class(binary):
        return binary if n_classes <= 2 else C.OneVsRest(classifier=binary, **cols)

    if algorithm in ("logistic_regression", "multinomial_logistic", "svm"):
        # C * sum(loss) + |w|^2 / 2 has its minimum where mean(loss) + |w|^2 / (2 C n) has: MLlib's form
        penalty = 1.0 / (float(p["C"]) * max(train.count(), 1))
        shared = {"regParam": penalty, "standardization": False, "maxIter": int(p["max_iter"]), "tol": 1e-8, **cols}
        if algorithm == "svm":
            if p["kernel"] != "linear":
                raise ValueError(f"An SVM with a {p['kernel']} kernel needs all pairs of rows; only 'linear' is offered")
            return per_class(C.LinearSVC(**shared))
        return C.LogisticRegression(family="multinomial" if algorithm == "multinomial_logistic" else "auto", **shared)
    if algorithm == "linear_regression":
        return R.LinearRegression(solver="normal", regParam=0.0, **cols)
    if algorithm in ("ridge", "lasso", "elastic_net"):
        # The scikit-learn objectives, mapped exactly.  Lasso / ElasticNet minimise
        # 1/(2n)|y - Xw|^2 + a1 |w|_1 + a2/2 |w|^2 (a1 = alpha * l1_ratio, a2 = alpha - a1);
        # Ridge minimises |y - Xw|^2 + alpha |w|^2, i.e. a1 = 0, a2 = alpha / n.  MLlib without
        # standardisation applies regParam * elasticNetParam to |w|_1 and divides the L2 part
        # by the label's population std, so regParam = a1 + a2 * std_y.
        y = train.agg(F.count(F.col(label)).alias("n"), F.stddev_pop(label).alias("sd")).first()
        alpha = float(p["alpha"])
        l1 = {"ridge": 0.0, "lasso": 1.0}.get(algorithm, float(p.get("l1_ratio", 0.0)))
        a1 = alpha * l1
        a2 = alpha / max(y["n"], 1) if algorithm == "ridge" else alpha - a1
        reg = a1 + a2 * (y["sd"] or 0.0)
        return R.LinearRegression(regParam=reg, elasticNetParam=a1 / reg if reg > 0 else 0.0, standardization=False,
                                  solver="normal" if a1 == 0 else "auto", maxIter=int(p.get("max_iter", 1000)),
                                  tol=float(p.get("tol", 1e-10)), **cols)
    if algorithm == "decision_tree":
        tree = C.DecisionTreeClassifier if classify else R.DecisionTreeRegressor
        return tree(maxDepth=_depth(p), minInstancesPerNode=int(p["min_samples_leaf"]), seed=seed, **cols)
    if algorithm == "random_forest":
        forest = C.RandomForestClassifier if classify else R.RandomForestRegressor
        return forest(numTrees=int(p["n_estimators"]), maxDepth=_depth(p),
                      minInstancesPerNode=int(p["min_samples_leaf"]), seed=seed, **cols)
    if algorithm in ("gradient_boosting", "boosted_trees"):
        shared = {"maxIter": int(p.get("n_estimators", p.get("iterations"))), "maxDepth": _depth(p),
                  "stepSize": float(p["learning_rate"]), "seed": seed, **cols}
        return per_class(C.GBTClassifier(**shared)) if classify else R.GBTRegressor(**shared)
    if algorithm in ("gaussian_nb", "multinomial_nb"):
        return C.NaiveBayes(modelType=algorithm.split("_")[0], smoothing=float(p["alpha"]), **cols)
    if algorithm == "bernoulli_nb":  # presence of each feature: above the threshold or not
        present = Binarizer(threshold=float(p["binarize"]), inputCol=features, outputCol="_present")
        return Pipeline(stages=[present, C.NaiveBayes(modelType="bernoulli", smoothing=float(p["alpha"]),
                                                      featuresCol="_present", labelCol=label)])
    if algorithm == "mlp":
        width = train.select(F.size(vector_to_array(features)).alias("w")).first()["w"]
        return C.MultilayerPerceptronClassifier(layers=[width, *p["hidden_sizes"], n_classes], seed=seed,
                                                maxIter=int(p["epochs"]), **cols)
    raise ValueError(f"No estimator is known for {algorithm!r}")


REGISTRY: dict = {}


def register_model(backend: str, algorithm: str, spec: dict) -> None:
    """Add a (backend, algorithm) entry; ``spec`` holds task types and defaults."""
    REGISTRY[(backend, algorithm)] = spec


# Catalog names offered for selection (backend, algorithm) -> task types.
for _name in ("logistic_regression", "multinomial_logistic", "gaussian_nb", "multinomial_nb", "bernoulli_nb", "svm"):
    register_model("sklearn", _name, {"tasks": ("classification",)})
for _name in ("linear_regression", "ridge", "lasso", "elastic_net"):
    register_model("sklearn", _name, {"tasks": ("regression",)})
for _name in ("dummy", "linear", "decision_tree", "random_forest", "gradient_boosting", "adaboost", "knn", "voting",
              "stacking"):
    register_model("sklearn", _name, {"tasks": ("classification", "regression")})
for _backend in ("xgboost", "lightgbm", "catboost"):
    register_model(_backend, "boosted_trees", {"tasks": ("classification", "regression")})
for _backend in ("pytorch", "tensorflow"):
    register_model(_backend, "mlp", {"tasks": ("classification",)})


@dataclass
class TrainedModel:
    config: ModelConfig
    task_type: str
    n_classes: int
    model: object = None
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``prediction`` (double) and, for classifiers that estimate one, ``probability``
        (array<double>).  Linear SVMs and one-vs-rest models only decide: they add none."""
        algo = self.config.algorithm
        if algo == "dummy":
            if self.task_type == "regression":
                return df.withColumn("prediction", F.lit(float(self.extra["mean"])))
            pri = [float(x) for x in self.extra["priors"]]
            return df.withColumn("prediction", F.lit(float(self.extra["majority"]))) \
                .withColumn("probability", F.array(*[F.lit(v) for v in pri]))
        if algo == "voting":
            out, column = df, "probability" if self.task_type == "classification" else "prediction"
            for i, member in enumerate(self.extra["members"]):
                out = member.predict(out, features).withColumnRenamed(column, f"_v{i}").drop("prediction", "probability")
            if self.task_type == "regression":
                return out.withColumn("prediction", (F.col("_v0") + F.col("_v1")) / 2).drop("_v0", "_v1")
            out = out.withColumn("probability", F.zip_with("_v0", "_v1", lambda x, y: (x + y) / 2)).drop("_v0", "_v1")
            return out.withColumn("prediction", F.array_position(
                "probability", F.array_max("probability")).cast("double") - 1)
        if algo == "adaboost":
            return self._adaboost_predict(df) if self.task_type == "classification" else self._adaboost_median(df)
        if algo == "stacking":
            meta_in = _stack_features(self.extra["members"], df, features, self.task_type)
            return self.extra["meta"].predict(meta_in, "_meta").drop("_meta")
        out = self.model.transform(df).drop("rawPrediction", "_present")
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out

    def _adaboost_median(self, df):
        """The prediction of the tree at which the confidence, in order of predictions, first reaches half."""
        out, votes, half = df, [], sum(self.extra["alphas"]) / 2
        for i, (tree, alpha) in enumerate(zip(self.extra["trees"], self.extra["alphas"])):
            out = tree.transform(out).withColumnRenamed("prediction", f"_t{i}")
            votes.append(F.struct(F.col(f"_t{i}").alias("p"), F.lit(alpha).alias("a")))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))
        median = F.aggregate(F.array_sort(F.array(*votes)), start, lambda acc, v: F.struct(
            (acc["sum"] + v["a"]).alias("sum"), F.when(acc["sum"] < half, v["p"]).otherwise(acc["p"]).alias("p")))
        return out.withColumn("prediction", median["p"]).drop(*[f"_t{i}" for i in range(len(votes))])

    def _adaboost_predict(self, df):
        k = self.n_classes
        score = F.array(*[F.lit(0.0) for _ in range(k)])
        out = df
        for i, (tree, alpha) in enumerate(zip(self.extra["trees"], self.extra["alphas"])):
            out = tree.transform(out).withColumnRenamed("prediction", f"_t{i}").drop("rawPrediction", "probability")
        for i, alpha in enumerate(self.extra["alphas"]):
            score = F.zip_with(score, F.array(*[(F.col(f"_t{i}") == j).cast("double") * alpha for j in range(k)]),
                               lambda a, b: a + b)
        out = out.withColumn("_score", score)
        total = F.aggregate("_score", F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("probability", F.transform("_score", lambda v: v / F.when(total > 0, total).otherwise(1.0)))
        out = out.withColumn("prediction", (F.array_position("_score", F.array_max("_score")) - 1).cast("double"))
        return out.drop("_score", *[f"_t{i}" for i in range(len(self.extra["alphas"]))])

    def save(self, path: str) -> None:
        """Write the model below ``path`` (which must be new): one JSON line, the MLlib models with
        their own writers, members of an ensemble in folders of their own."""
        spark = SparkSession.active()
        parts = {k: v for k, v in self.extra.items() if k in ("members", "meta", "trees")}
        about = {"config": asdict(self.config), "task_type": self.task_type, "n_classes": self.n_classes,
                 "model": self.model is not None, "extra": {k: v for k, v in self.extra.items() if k not in parts},
                 "parts": {k: len(v) if isinstance(v, list) else None for k, v in parts.items()}}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        if self.model is not None:
            self.model.write().save(f"{path}/model")
        for name, part in parts.items():
            for i, one in enumerate(part if isinstance(part, list) else [part]):
                if isinstance(one, TrainedModel):
                    one.save(f"{path}/{name}/{i}")
                else:
                    one.write().save(f"{path}/{name}/{i}")

    @staticmethod
    def load(path: str) -> TrainedModel:
        """The model that ``save`` wrote below ``path``."""
        spark = SparkSession.active()
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        config = about["config"]
        config["categorical_columns"] = tuple(config["categorical_columns"])
        extra = dict(about["extra"])
        for name, n in about["parts"].items():
            read = TrainedModel.load if name != "trees" else lambda at: DefaultParamsReader.loadParamsInstance(at, spark)
            found = [read(f"{path}/{name}/{i}") for i in range(1 if n is None else n)]
            extra[name] = found[0] if n is None else found
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark) if about["model"] else None
        return TrainedModel(ModelConfig(**config), about["task_type"], about["n_classes"], model, extra)


def same_predictions(a: TrainedModel, b: TrainedModel, rows: DataFrame, key: str) -> bool:
    """Whether both models predict the same for every row (unique ``key``), to 1e-9: the round-trip check."""
    left = a.predict(rows).select(key, F.col("prediction").alias("_a"))
    right = b.predict(rows).select(key, F.col("prediction").alias("_b"))
    off = left.join(right, key, "full").where(F.coalesce(F.abs(F.col("_a") - F.col("_b")) > 1e-9, F.lit(True)))
    return off.isEmpty()


def fit_model(config: ModelConfig, train: DataFrame, task_type: str, n_classes: int = 0,
              features: str = "features", label: str = "label") -> TrainedModel:
    """Fit one candidate on encoded training rows (``features`` vector, ``label`` double)."""
    if (config.backend, config.algorithm) not in REGISTRY:
        raise ValueError(f"Unknown model {config.backend}:{config.algorithm}")
    if task_type not in REGISTRY[(config.backend, config.algorithm)]["tasks"]:
        raise ValueError(f"{config.algorithm} does not support {task_type}")
    p, algo = parameters(config), config.algorithm
    if algo == "linear":  # the fast starting point: logistic classes, ridge values
        plain = ModelConfig("sklearn", "logistic_regression" if task_type == "classification" else "ridge", {}, config.seed)
        return fit_model(plain, train, task_type, n_classes, features, label)
    if algo == "dummy":
        if task_type == "regression":
            return TrainedModel(config, task_type, 0, extra={"mean": train.agg(F.avg(label)).first()[0]})
        counts = {int(r[0]): int(r[1]) for r in train.groupBy(label).count().collect()}  # one row per class
        n = sum(counts.values())
        priors = [counts.get(i, 0) / n for i in range(n_classes)]
        majority = max(range(n_classes), key=lambda i: (priors[i], -i))
        return TrainedModel(config, task_type, n_classes, extra={"priors": priors, "majority": majority})
    if algo == "voting":
        linear = ModelConfig("sklearn", "linear")
        forest = ModelConfig("sklearn", "random_forest", {"n_estimators": p["n_estimators"]}, config.seed)
        members = [fit_model(linear, train, task_type, n_classes, features, label),
                   fit_model(forest, train, task_type, n_classes, features, label)]
        return TrainedModel(config, task_type, n_classes, extra={"members": members})
    if algo == "adaboost":
        boost = _fit_adaboost if task_type == "classification" else _fit_adaboost_r2
        return boost(config, train, n_classes, features, label)
    if algo == "stacking":
        return _fit_stacking(config, train, task_type, n_classes, features, label)
    if algo == "knn":
        raise ValueError("k nearest neighbours are served by operators.neighbors.knn_predict")
    est = _estimator(algo, p, config.seed, task_type, n_classes, train, features, label)
    model = est.fit(train)
    return TrainedModel(config, task_type, n_classes, model=model)


def _base_configs(task_type: str, seed: int) -> list[ModelConfig]:
    lin = "logistic_regression" if task_type == "classification" else "linear_regression"
    return [ModelConfig("sklearn", lin, {}, seed), ModelConfig("sklearn", "random_forest", {"n_estimators": 20}, seed)]


def _stack_features(members: list, df: DataFrame, features: str, task_type: str) -> DataFrame:
    """Base-model outputs (class probabilities, or predictions) assembled as ``_meta``."""
    from pyspark.ml.functions import array_to_vector
    out = df
    parts = []
    for i, m in enumerate(members):
        p = m.predict(out, features)
        if task_type == "classification":
            out = p.withColumnRenamed("probability", f"_p{i}").drop("prediction")
        else:
            out = p.withColumnRenamed("prediction", f"_p{i}")
            out = out.withColumn(f"_p{i}", F.array(F.col(f"_p{i}")))
        parts.append(f"_p{i}")
    return out.withColumn("_meta", array_to_vector(F.concat(*[F.col(c) for c in parts]))).drop(*parts)


def _fit_stacking(config, train, task_type, n_classes, features, label):
    """Out-of-fold base predictions (``cv`` folds from a content hash, so folds do not depend
    on partitioning) train a logistic / linear meta model; base models are then refitted on all
    training rows."""
    cv = int(parameters(config)["cv"])
    from pyspark.ml.functions import vector_to_array as v2a

    from tessera.session import cut_lineage
    fold = F.pmod(F.xxhash64(v2a(features), F.col(label)), F.lit(cv))
    # every fit passes over its rows several times: what they are derived from is computed once
    data = cut_lineage(train.select(features, label, fold.alias("_fold")))
    oof = None
    for k in range(cv):
        members = [fit_model(c, data.where(F.col("_fold") != k), task_type, n_classes, features, label)
                   for c in _base_configs(task_type, config.seed)]
        part = _stack_features(members, data.where(F.col("_fold") == k), features, task_type)
        oof = part if oof is None else oof.unionByName(part)
    meta_cfg = ModelConfig("sklearn", "logistic_regression" if task_type == "classification" else "linear_regression")
    meta = fit_model(meta_cfg, cut_lineage(oof.select("_meta", label)), task_type, n_classes, "_meta", label)
    members = [fit_model(c, data, task_type, n_classes, features, label) for c in _base_configs(task_type, config.seed)]
    return TrainedModel(config, task_type, n_classes, extra={"members": members, "meta": meta})


def _fit_adaboost(config, train, n_classes, features, label):
    """SAMME with depth-1 trees on ``weightCol``; one small fit per round, weights updated
    by a column expression (no collection of rows)."""
    p = parameters(config)
    rounds, lr = int(p["n_estimators"]), float(p["learning_rate"])
    df = train.withColumn("_w", F.lit(1.0))
    trees, alphas = [], []
    for i in range(rounds):
        tree = C.DecisionTreeClassifier(maxDepth=1, weightCol="_w", featuresCol=features, labelCol=label,
                                        seed=config.seed + i).fit(df)
        pred = tree.transform(df).select(*df.columns, F.col("prediction").alias("_p"))
        err_row = pred.agg((F.sum(F.when(F.col("_p") != F.col(label), F.col("_w")).otherwise(0.0)) /
                            F.sum("_w")).alias("e")).first()
        e = float(err_row["e"] or 0.0)
        if e >= 1 - 1.0 / n_classes:
            break
        alpha = lr * (math.log((1 - e) / max(e, 1e-12)) + math.log(n_classes - 1))
        trees.append(tree)
        alphas.append(alpha)
        if e <= 0:
            break
        df = pred.withColumn("_w", F.col("_w") * F.when(F.col("_p") != F.col(label), math.exp(alpha))
                             .otherwise(1.0)).drop("_p")
        if (i + 1) % 5 == 0:  # cut the growing lineage reliably (shared checkpoint folder)
            from tessera.session import cut_lineage
            df = cut_lineage(df)
    return TrainedModel(config, "classification", n_classes, extra={"trees": trees, "alphas": alphas})


def _fit_adaboost_r2(config, train, n_classes, features, label):
    """M08 for values: AdaBoost.R2 (Drucker 1997, linear loss) with trees of depth 3 on ``weightCol``.  A
    row's loss is its error over the largest error of the round."""
    from tessera.session import cut_lineage
    p = parameters(config)
    rate = float(p["learning_rate"])
    df, trees, alphas = train.withColumn("_w", F.lit(1.0)), [], []
    for i in range(int(p["n_estimators"])):
        tree = R.DecisionTreeRegressor(maxDepth=3, weightCol="_w", featuresCol=features, labelCol=label,
                                       seed=config.seed + i).fit(df)
        pred = tree.transform(df).withColumn("_e", F.abs(F.col("prediction") - F.col(label)))
        seen = pred.agg(F.max("_e").alias("worst"), (F.sum(F.col("_w") * F.col("_e")) / F.sum("_w")).alias("mean")).first()
        worst = float(seen["worst"] or 0.0)
        loss = float(seen["mean"] or 0.0) / worst if worst > 0 else 0.0
        if loss >= 0.5 and trees:
            break
        beta = min(max(loss, 1e-12), 0.5 - 1e-12) / (1 - min(max(loss, 1e-12), 0.5 - 1e-12))
        trees.append(tree)
        alphas.append(rate * math.log(1 / beta))
        if worst == 0 or loss >= 0.5:
            break
        df = pred.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), rate * (1 - F.col("_e") / worst))) \
            .select(*df.columns)
        if (i + 1) % 5 == 0:
            df = cut_lineage(df)
    return TrainedModel(config, "regression", 0, extra={"trees": trees, "alphas": alphas})


def search_configs(base: ModelConfig, space: dict, method: str = "random", trials: int = 10, seed: int = 0,
                   max_trials: int = 100) -> list[ModelConfig]:
    """Configurations of a finite space.  ``grid`` lists all of them; ``random`` draws ``trials``
    different ones (all, if there are fewer), each parameter on its own.  More than ``max_trials`` is an
    error in both."""
    names = sorted(space)
    points = math.prod(len(space[k]) for k in names)
    asked = points if method == "grid" else trials
    if asked > max_trials:
        raise ValueError(f"{asked} trials asked for, at most {max_trials} allowed")
    every = itertools.product(*[range(len(space[k])) for k in names])
    if method == "grid":
        chosen = list(every)
    else:
        rng, wanted = random.Random(seed), min(trials, points)
        if points <= 2 * wanted:  # draws would mostly repeat: shuffle the few there are
            chosen = list(every)
            rng.shuffle(chosen)
            chosen = chosen[:wanted]
        else:
            drawn: dict = {}
            while len(drawn) < wanted:
                drawn[tuple(rng.randrange(len(space[k])) for k in names)] = None
            chosen = list(drawn)
    return [replace(base, params={**base.params, **{k: space[k][i] for k, i in zip(names, at)}}) for at in chosen]


def choose_winner(results: list[dict], metric: str, direction: str) -> dict:
    """Best by metric direction; missing scores last; ties by candidate name."""
    def key(r):
        v = r.get(metric)
        missing = v is None
        return (missing, -(v or 0.0) if direction == "max" else (v or 0.0), r["candidate"])
    return sorted(results, key=key)[0]
