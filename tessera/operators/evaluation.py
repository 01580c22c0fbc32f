"""Evaluation (V01-V08, V12 counts): metrics as aggregates over (label, prediction[, probability]).

Class labels are integer codes 0..n_classes-1 (E07).  Everything is one or two aggregates over
the confusion table (n_classes^2 cells at most) -- no collection of predictions.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import average_rank

DIRECTIONS = {"accuracy": "max", "balanced_accuracy": "max", "f1_macro": "max", "log_loss": "min",
              "roc_auc": "max", "mae": "min", "rmse": "min", "r2": "max", "f1_weighted": "max",
              "precision_macro": "max", "recall_macro": "max", "f1_binary": "max"}
REGRESSION = {"mae", "rmse", "r2"}
EPS = sys.float_info.epsilon


def validate_metric(metric: str, task_type: str) -> str:
    """Metric direction, after checking it fits the task."""
    allowed = REGRESSION if task_type == "regression" else set(DIRECTIONS) - REGRESSION
    if metric not in allowed:
        raise ValueError(f"A {task_type} task is not measured by {metric!r}")
    return DIRECTIONS[metric]


def regression_metrics(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """MAE, RMSE, R^2 (NULL for one row; 1 when the truth is constant and fit exact, else 0)."""
    err = F.col(y) - F.col(p)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
                 F.var_pop(y).alias("vy"))
    ss_res = F.col("mse") * F.col("n")
    ss_tot = F.col("vy") * F.col("n")
    r2 = F.when(F.col("n") < 2, None).when(ss_tot > 0, 1 - ss_res / ss_tot) \
        .when(ss_res == 0, 1.0).otherwise(0.0)
    return agg.select(F.col("n").cast("bigint").alias("rows"), "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def confusion(df: DataFrame, n_classes: int, y: str = "label", p: str = "prediction") -> DataFrame:
    """Dense n x n confusion counts (actual, predicted, count)."""
    cells = df.groupBy(F.col(y).cast("int").alias("actual"), F.col(p).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    classes = spark.range(n_classes).select(F.col("id").cast("int").alias("actual"))
    spine = classes.crossJoin(classes.select(F.col("actual").alias("predicted")))  # n_classes^2, bounded
    return spine.join(cells, ["actual", "predicted"], "left") \
        .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def per_class(df: DataFrame, n_classes: int, y: str = "label", p: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1 and support over all trained classes (0 on zero
    division)."""
    cm = confusion(df, n_classes, y, p)
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("predicted_n"))
    j = tp.join(sup, "cls").join(pred, "cls")
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select("cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("bigint").alias("support"))


def classification_metrics(df: DataFrame, n_classes: int, y: str = "label", p: str = "prediction",
                           prob: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy (classes present in truth), macro precision /
    recall / F1 over all trained classes, support-weighted F1, binary F1 (class 1), log loss
    and ROC AUC (binary, both classes present) from ``prob`` (array of class probabilities)."""
    pc = per_class(df, n_classes, y, p)
    m = pc.agg(
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.max(F.when(F.col("cls") == 1, F.col("f1"))).alias("_f1_1"))
    acc = df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("rows"))
    out = acc.crossJoin(m).withColumn("f1_binary", F.col("_f1_1") if n_classes == 2 else F.lit(None).cast("double")) \
        .drop("_f1_1")
    if prob is not None:
        pk = F.element_at(F.col(prob), F.col(y).cast("int") + 1)
        ll = df.agg(F.avg(-F.log(F.least(F.greatest(pk, F.lit(EPS)), F.lit(1 - EPS)))).alias("log_loss"))
        out = out.crossJoin(ll)
        if n_classes == 2:
            out = out.crossJoin(roc_auc(df.select(F.col(y).alias("_y"), F.element_at(prob, 2).alias("_s")),
                                        "_y", "_s"))
        else:
            out = out.withColumn("roc_auc", F.lit(None).cast("double"))
    return out


def roc_auc(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC by the rank-sum (Mann-Whitney) formula with average ranks for ties;
    NULL unless both classes occur.  Ranks come from the distributed rank core over distinct
    scores, joined back per score value."""
    base = df.where(F.col(score).isNotNull()).select(F.col(y).cast("int").alias("_y"),
                                                     F.col(score).cast("double").alias("_s"))
    ranks = average_rank(base, "_s").select("_s", "rank")
    per_score = base.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    j = per_score.join(ranks, "_s")
    agg = j.agg(F.sum(F.col("pos") * F.col("rank")).alias("rs"), F.sum("pos").alias("np"),
                F.sum(F.col("n") - F.col("pos")).alias("nn"))
    auc = F.when((F.col("np") > 0) & (F.col("nn") > 0),
                 (F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn")))
    return agg.select(auc.alias("roc_auc"))


def check_probabilities(df: DataFrame, prob: str, n_classes: int) -> None:
    """V05 validity: right width, finite, >= 0, rows sum to 1 within 1e-5."""
    bad = df.agg(F.count_if((F.size(prob) != n_classes) |
                            F.exists(prob, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (F.abs(v) == float("inf"))) |
                            (F.abs(F.aggregate(prob, F.lit(0.0), lambda a, v: a + v) - 1) > 1e-5)).alias("n")).first()
    if bad["n"]:
        raise ValueError("Class probabilities must lie in [0, 1] and add up to 1")


def learning_curve(model, frames: dict[str, DataFrame], features: str = "features", label: str = "label") -> DataFrame:
    """Loss per boosting round (``evaluateEachIteration``: one distributed pass per frame,
    all rounds at once) or per optimiser iteration (``summary.objectiveHistory`` of linear
    models, training only).  Rows: series (``<frame>_loss``), round (1-based), loss; the
    table is bounded by the number of rounds."""
    spark = next(iter(frames.values())).sparkSession
    rows = []
    if hasattr(model, "evaluateEachIteration"):
        for name, df in frames.items():
            data = df.select(features, label)
            losses = model.evaluateEachIteration(data) if "Classification" in type(model).__name__ \
                else model.evaluateEachIteration(data, "squared")
            rows += [(f"{name}_loss", i + 1, float(v)) for i, v in enumerate(losses)]
    elif getattr(model, "hasSummary", False):
        rows += [("train_loss", i + 1, float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    else:
        raise ValueError("the model records no per-round loss")
    return spark.createDataFrame(rows, "series string, round int, loss double")


def class_view(scored: DataFrame, axes: list[str], classes: list, n: int = 2000, seed: int = 42,
               key: list[str] | None = None, max_categories: int = 30, label: str = "label",
               prediction: str = "prediction") -> DataFrame:
    """True vs predicted classes of a priority sample of at most ``n`` rows, placed on one
    or two axes.  A numeric axis keeps its (finite) values; a categorical axis is coded 0.. by
    the sorted distinct sampled labels (at most ``max_categories``).  Rows without a prediction
    or a usable axis value are left out; ``unknown`` marks true labels outside ``classes``."""
    from pyspark.sql import Window
    from pyspark.sql import types as T

    from tessera.operators.sampling import priority_sample
    if not 1 <= len(axes) <= 2 or len(set(axes)) != len(axes):
        raise ValueError(f"The class view has one or two different axes, not {axes}")
    sample = priority_sample(scored, n, seed, key)  # at most n rows from here on
    valid = F.col(prediction).isNotNull()
    coords = []
    for a in axes:
        if isinstance(scored.schema[a].dataType, T.NumericType):
            v = F.col(a).cast("double")
            valid = valid & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
            coords.append(v)
        else:
            text = F.col(a).cast("string")
            n_labels = sample.where(text.isNotNull()).select(text).distinct().count()  # <= n
            if n_labels > max_categories:
                raise ValueError(f"{n_labels} sampled values do not fit on an axis for {max_categories}")
            code_w = Window.partitionBy(text.isNull()).orderBy(text)  # the sample is bounded by n
            coords.append((F.dense_rank().over(code_w) - 1).cast("double"))
            valid = valid & text.isNotNull()
    names = ["x", "y"][:len(axes)]
    placed = sample.select(*(key or []), *[c.alias(nm) for c, nm in zip(coords, names)],
                           F.col(label).alias("true_class"), F.col(prediction).alias("predicted_class"),
                           valid.alias("_valid"))
    known = F.col("true_class").isin(*classes) & F.col("true_class").isNotNull()
    return placed.where("_valid").drop("_valid").withColumn("unknown", ~known)
