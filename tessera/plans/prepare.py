"""R09 prepare_task: split the raw rows, fit the recipe on training features only, apply it to
every split, keep target and row key with each row.  One lazy plan per output; the fit is one
aggregate per learned step over train rows only (no leakage from validation/test)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_missing
from tessera.operators.splitting import SplitConfig, check_splits, split_assign
from tessera.plans.recipe import FittedRecipe, Recipe, fit_recipe


@dataclass(frozen=True)
class TaskConfig:
    """Task: target, type, excluded columns, missing-target policy."""
    target: str
    task_type: str = "classification"
    excluded: tuple[str, ...] = ()
    missing_target: str = "exclude"

    def __post_init__(self):
        if self.task_type not in ("classification", "regression"):
            raise ValueError(f"There is no {self.task_type!r} task, only classification and regression")
        if self.missing_target not in ("exclude", "error"):
            raise ValueError(f"missing_target={self.missing_target!r}: 'exclude' and 'error' exist")


def feature_columns(columns, task: TaskConfig, controls=()) -> list[str]:
    """Every column minus target, excluded and split-control columns."""
    if task.target not in columns:
        raise ValueError(f"The table has no target column {task.target!r}")
    unknown = set(task.excluded) - set(columns)
    if unknown:
        raise ValueError(f"Columns to leave out are not in the table: {sorted(unknown)}")
    drop = {task.target, *task.excluded, *[c for c in controls if c]}
    feats = [c for c in columns if c not in drop]
    if not feats:
        raise ValueError("Target, excluded and split columns leave no feature")
    return feats


def eligible_rows(df: DataFrame, task: TaskConfig) -> DataFrame:
    """Rows with an observed target; a regression target must be numeric and finite."""
    t = task.target
    dt = df.schema[t].dataType
    ok = ~is_missing(t, dt)
    if task.task_type == "regression":
        bad = df.agg(F.count_if(ok & ~(F.abs(F.col(t).cast("double")) < F.lit(float("inf")))).alias("n")).first()
        if bad["n"]:
            raise ValueError("Regression target must be finite")
    return df.where(ok)


@dataclass
class Prepared:
    frame: DataFrame
    fitted: FittedRecipe
    counts: dict = field(default_factory=dict)


def prepare_task(df: DataFrame, task: TaskConfig, split: SplitConfig, recipe: Recipe,
                 key: str | list[str], check: bool = True) -> Prepared:
    """Split -> fit on train features -> apply to all rows -> attach target, key, split.

    The split frame is checkpointed (reliably, into the shared checkpoint folder): the fit and
    the final apply both read it, and its assignment must not be recomputed differently."""
    from tessera.session import cut_lineage
    keys = [key] if isinstance(key, str) else list(key)
    controls = [split.group_column, split.time_column]
    feats = feature_columns(df.columns, task, controls=[c for c in controls if c and c != task.target])
    assigned = split_assign(df, split, keys, target=task.target, missing_target=task.missing_target,
                            task_type=task.task_type)
    assigned = cut_lineage(assigned)
    counts = check_splits(assigned, split, task.target, task.task_type) if check else {}
    feature_frame = [c for c in feats if c not in keys]
    train = assigned.where(F.col("split") == "train").select(*feature_frame)
    fitted = fit_recipe(recipe, train)
    carried = [*keys, "split", task.target]
    # apply row-wise on the full frame, carrying key, split and target through the same plan
    out = _apply_carrying(fitted, assigned, carried)
    if check and task.task_type == "classification":
        got = out.where(F.col("split") == "train").select(task.target).distinct()
        before = assigned.where(F.col("split") == "train").select(task.target).distinct()
        lost = before.join(got, task.target, "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"Preprocessing removed every training row of class {lost[0][0]!r}")
    return Prepared(out, fitted, counts)


def _apply_carrying(fitted: FittedRecipe, df: DataFrame, carried: list[str]) -> DataFrame:
    """Apply the fitted steps to the feature columns while the carried columns ride along
    (row filters drop them together, so no join back by row id is needed)."""
    out = df.select(*fitted.input_columns, *carried)
    for step, state in zip(fitted.steps(), fitted.states):
        feats_now = [c for c in out.columns if c not in carried]
        if getattr(step, "name", "") in ("select_columns", "drop_columns", "rename_columns"):
            projected = step.apply(out.select(*feats_now), state)
            if step.name == "rename_columns":
                out = out.withColumnsRenamed(dict(zip(step.columns, step.names)))
            else:
                out = out.select(*projected.columns, *carried)
        else:
            out = step.apply(out, state)
    return out
