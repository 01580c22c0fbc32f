"""Prediction / scoring of tables.

Every input row is returned: rows the fitted recipe removes get ``status =
excluded_by_preprocessing`` and NULL predictions.  The recipe's row filters and the model run
in one lazy plan over the kept rows; the left join back to the input is on the caller's row
key (equi-join; AQE picks broadcast or sort-merge from runtime sizes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_table(df: DataFrame, key: Sequence[str] | str, fitted_recipe, encoder, model,
                classes: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """(key, status, prediction[, predicted_class, probability_i...]) for every row."""
    keys = [key] if isinstance(key, str) else list(key)
    extra = [c for c in keys if c not in fitted_recipe.input_columns]
    base = df.select(*keys, *[c for c in fitted_recipe.input_columns if c not in keys])
    prepared = fitted_recipe.apply(base.drop(*extra), strict=strict) if not extra else _apply_with_keys(
        fitted_recipe, base, keys)
    scored = model.predict(encoder.transform(prepared))
    cols = [*keys, "prediction"]
    if "probability" in scored.columns and classes is not None:
        cols += [F.col("probability")[i].alias(f"probability_{i}") for i in range(len(classes))]
    out = scored.select(*cols).withColumn("status", F.lit("predicted"))
    if classes is not None:
        lookup = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(float(i)), F.lit(c))])
        out = out.withColumn("predicted_class", F.element_at(lookup, F.col("prediction")))
    joined = df.select(*keys).join(out, keys, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("excluded_by_preprocessing")))


def _apply_with_keys(fitted_recipe, df: DataFrame, keys: list[str]) -> DataFrame:
    from tessera.plans.prepare import _apply_carrying
    return _apply_carrying(fitted_recipe, df, keys)


def append_predictions(df: DataFrame, scored: DataFrame, key: Sequence[str] | str, target: str | None = None) -> DataFrame:
    """Original columns + prediction; an existing target column is kept as
    ``<target>_actual`` (``_2`` etc. if taken)."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df
    if target and target in df.columns:
        name, n = f"{target}_actual", 2
        while name in df.columns:
            name, n = f"{target}_actual_{n}", n + 1
        out = out.withColumnRenamed(target, name)
    return out.join(scored, keys, "left")


def with_residuals(scored: DataFrame, truth: str, task_type: str) -> DataFrame:
    """Residual (regression) or correct flag (classification) where the truth is known."""
    if task_type == "regression":
        return scored.withColumn("residual", F.col(truth) - F.col("prediction"))
    return scored.withColumn("correct", F.col(truth) == F.col("prediction"))


def sorted_probabilities(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(class, probability) pairs sorted by probability desc then class."""
    pairs = F.array(*[F.struct((-F.col(f"probability_{i}")).alias("neg"), F.lit(c).alias("class"),
                               F.col(f"probability_{i}").alias("probability")) for i, c in enumerate(classes)])
    return scored.withColumn("ranked", F.transform(F.array_sort(pairs), lambda s: F.struct(s["class"], s["probability"])))
