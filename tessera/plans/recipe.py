"""Recipe lifecycle (R01-R08): reviewed steps, fit on an explicit source, lazy apply.

A fitted recipe is a small driver-side object (step specs + learned literals); applying it is a
lazy, narrow plan, so it is valid on batch and streaming frames alike.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import is_missing, strip_ws
from tessera.operators.transforms import STEPS, Step, build_step

STATUSES = ("proposed", "approved", "rejected")


def fingerprint(value) -> str:
    """SHA-256 of the canonical JSON text."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class RecipeStep:
    """One reviewed step; approval is tied to the step's fingerprint."""
    name: str
    params: dict
    status: str = "proposed"
    approved_fingerprint: str | None = None
    reason: str = ""

    def fingerprint(self) -> str:
        return fingerprint({"name": self.name, "params": self.params})

    def approve(self):
        self.status, self.approved_fingerprint = "approved", self.fingerprint()

    def reject(self):
        self.status, self.approved_fingerprint = "rejected", None

    def edit(self, params: dict):
        self.params, self.status, self.approved_fingerprint = dict(params), "proposed", None

    @property
    def active(self) -> bool:
        return self.status == "approved" and self.approved_fingerprint == self.fingerprint()

    def build(self) -> Step:
        return build_step(self.name, self.params)


@dataclass
class Recipe:
    steps: list[RecipeStep] = field(default_factory=list)

    def add(self, name: str, **params) -> RecipeStep:
        step = RecipeStep(name, params)
        self.steps.append(step)
        return step

    def approve_all(self) -> Recipe:
        for s in self.steps:
            s.approve()
        return self

    def active_steps(self) -> list[RecipeStep]:
        return [s for s in self.steps if s.active]

    def fingerprint(self) -> str:
        return fingerprint([{"name": s.name, "params": s.params} for s in self.active_steps()])


def validate_recipe(recipe: Recipe, columns: list[str]) -> dict:
    """Output columns and whether fitting is needed, without reading data."""
    cols, needs_fit = list(columns), False
    for s in recipe.active_steps():
        step = s.build()
        cols = step.output_columns(cols)
        needs_fit |= step.requires_fit
    return {"output_columns": cols, "requires_fit": needs_fit}


@dataclass
class FittedRecipe:
    """Recipe + learned state + input column order."""
    specs: list[dict]
    states: list[dict]
    input_columns: list[str]

    def steps(self) -> list[Step]:
        return [build_step(s["name"], s["params"]) for s in self.specs]

    def apply(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """P22 + R02: reorder to the fitted input columns (a differing set is an error; extra
        columns are allowed when not ``strict``), then apply every step lazily."""
        if strict and set(df.columns) != set(self.input_columns):
            raise ValueError("Input columns differ from the fitted recipe's columns")
        missing = [c for c in self.input_columns if c not in df.columns]
        if missing:
            raise ValueError(f"Input lacks fitted columns {missing}")
        out = df.select(*self.input_columns)
        for step, state in zip(self.steps(), self.states):
            out = step.apply(out, state)
        return out

    def to_dict(self) -> dict:
        return {"version": 1, "steps": self.specs, "states": self.states, "input_columns": self.input_columns}

    @classmethod
    def from_dict(cls, data: dict) -> FittedRecipe:
        if data.get("version") != 1:
            raise ValueError("Unsupported fitted recipe version")
        for s in data["steps"]:
            if s["name"] not in STEPS:
                raise ValueError(f"Unknown transform {s['name']!r}")
        return cls(list(data["steps"]), list(data["states"]), list(data["input_columns"]))

    def save(self, spark, path: str) -> None:
        """The JSON form as one new file (local or shared cluster storage)."""
        from tessera.sources.readers import write_text_file
        write_text_file(spark, path, json.dumps(self.to_dict(), sort_keys=True, default=str))

    @classmethod
    def load(cls, spark, path: str) -> FittedRecipe:
        text = spark.read.text(path, wholetext=True).first()  # one small file
        return cls.from_dict(json.loads(text[0]))


def fit_recipe(recipe: Recipe, df: DataFrame) -> FittedRecipe:
    """Fit steps in order; each learned step sees the data transformed by the earlier
    (already fitted) steps.  A learned step costs one aggregate; the rest stays lazy."""
    specs, states = [], []
    current = df
    for s in recipe.active_steps():
        step = s.build()
        state = step.fit(current) if step.requires_fit else {}
        current = step.apply(current, state)
        specs.append(step.spec())
        states.append(_jsonable(state))
    return FittedRecipe(specs, states, list(df.columns))


def _jsonable(value):
    return json.loads(json.dumps(value, default=str))


def change_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before/after/removed, columns added/removed, missing cells and types per column
    before and after.  Two aggregates; schema diff on the driver."""
    def missing_counts(df):
        return df.agg(F.count(F.lit(1)).alias("rows"),
                      *[F.count_if(is_missing(f.name, f.dataType)).alias(f.name) for f in df.schema.fields])
    b, a = missing_counts(before).first(), missing_counts(after).first()
    spark = before.sparkSession
    rows = []
    names = list(dict.fromkeys(list(before.columns) + list(after.columns)))
    for c in names:
        rows.append((c, before.schema[c].dataType.simpleString() if c in before.columns else None,
                     after.schema[c].dataType.simpleString() if c in after.columns else None,
                     int(b[c]) if c in before.columns else None, int(a[c]) if c in after.columns else None,
                     "added" if c not in before.columns else "removed" if c not in after.columns else "kept"))
    cols = spark.createDataFrame(rows, "column string, type_before string, type_after string, "
                                       "missing_before long, missing_after long, change string")
    return cols.withColumn("rows_before", F.lit(int(b["rows"]))).withColumn("rows_after", F.lit(int(a["rows"]))) \
        .withColumn("rows_removed", F.lit(int(b["rows"]) - int(a["rows"])))


def suggest_recipe(df: DataFrame, protected: tuple[str, ...] = (), overview: DataFrame | None = None,
                   numeric_missing: str = "mean", drop_constant: bool = True, trim: bool = True) -> Recipe:
    """Suggestions from the full-data profile: drop a constant non-missing column; strip
    text when some value has edge whitespace (full scan ``count_if(c != strip(c))``); impute
    numeric columns by ``numeric_missing`` (mean or median) and categories by mode, nothing for text
    and dates; never touch protected or all-missing columns; keep at least one column."""
    if numeric_missing not in ("mean", "median"):
        raise ValueError(f"Numbers are imputed by mean or median, not {numeric_missing!r}")
    if set(protected) - set(df.columns):
        raise ValueError(f"Protected columns {sorted(set(protected) - set(df.columns))} are not in the table")
    from tessera.operators.profile import column_overview
    ov = {r["column"]: r for r in (overview or column_overview(df)).collect()}  # one row per column
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    edge = df.agg(*[F.count_if(F.col(c) != strip_ws(c)).alias(c) for c in text_cols]).first() if text_cols else {}
    recipe = Recipe()
    dropped = []
    for c in df.columns:
        if c in protected:
            continue
        r = ov[c]
        if r["all_missing"]:
            continue
        if drop_constant and r["is_constant"] and r["num_missing"] == 0 and len(df.columns) - len(dropped) > 1:
            dropped.append(c)
            recipe.add("drop_columns", columns=[c]).reason = "constant"
            continue
        if trim and c in text_cols and edge[c]:
            recipe.add("normalize_categories", columns=[c], strip=True).reason = "edge whitespace"
        if r["num_missing"]:
            if r["role"] == "numeric":
                recipe.add("fill_missing", columns=[c], strategy=numeric_missing).reason = "numeric missing"
            elif r["role"] == "category":
                recipe.add("fill_missing", columns=[c], strategy="mode").reason = "category missing"
    return recipe


def next_version_path(spark, base: str) -> str:
    """``base/vN`` with N = max existing + 1; never overwrites.  Listed through the Hadoop
    FileSystem of the session, so ``base`` may be on shared cluster storage."""
    from tessera.sources.readers import list_names
    existing = [int(n[1:]) for n in list_names(spark, base) if n.startswith("v") and n[1:].isdigit()]
    return base.rstrip("/") + f"/v{max(existing, default=0) + 1}"


def execute_recipe(recipe: Recipe, df: DataFrame, output_base: str, fit_source: DataFrame | None = None,
                   partition_by: str | None = None) -> dict:
    """R08 + S09/S10: approved steps only; learned steps need an explicit fit source; writes a new
    version folder in ``errorifexists`` mode with a JSON sidecar (recipe, state, lineage) and
    counts the rows that landed from the Parquet footers."""
    checked = validate_recipe(recipe, df.columns)
    if checked["requires_fit"] and fit_source is None:
        raise ValueError("Learned steps need an explicit fit source")
    fitted = fit_recipe(recipe, fit_source if fit_source is not None else df)
    out = fitted.apply(df)
    spark = df.sparkSession
    path = next_version_path(spark, output_base)
    from tessera.sources.readers import write_parquet, write_text_file
    rows = write_parquet(out, path, [partition_by] if partition_by else ())
    meta = {"recipe_fingerprint": recipe.fingerprint(), "fitted": fitted.to_dict(), "rows": rows, "path": path}
    write_text_file(spark, path + ".json", json.dumps(meta, sort_keys=True, default=str))
    return meta
