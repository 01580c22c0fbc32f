"""Time series operators.

A series is ``(series key?, ts, value)``.  Positions come from the distributed rank core, and lags
from its range slices with a halo of the rows before each (``ranking.lagged``), so a
single very long series is still spread over all tasks (no ``Window.partitionBy(series)``) and no row is sent twice.
The AR fit (Z04) reduces to the normal equations: (p+1)^2 sums per series in one aggregate,
solved per series on a one-row-per-series table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_finite
from tessera.functions.ranking import cumulative, lagged


def regularity(df: DataFrame, ts: str, series: str | None = None) -> DataFrame:
    """Successive differences; a series is regular when every step is equal and positive.
    Returns steps, distinct step count and the smallest step in seconds."""
    keys = [series] if series else []
    pairs = lagged(df.select(*keys, ts), keys, [ts], {"_last": (ts, 1)}).where(F.col("_last").isNotNull())
    step = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp")))
    out = pairs.groupBy(*keys).agg(F.count(step).alias("steps"), F.countDistinct(step).alias("distinct_steps"),
                                   (F.min(step) / 1_000_000).cast("bigint").alias("min_step_seconds"))
    return out


def positions(df: DataFrame, ts: str, series: str | None = None, name: str = "pos") -> DataFrame:
    """0-based position of each row in time order within its series (timestamps unique)."""
    keys = [series] if series else []
    ranked = cumulative(df.withColumn("_one", F.lit(1)), keys, [ts], weight="_one", before=name, total="_n")
    return ranked.drop("_one", "_n")


def validate_series(df: DataFrame, ts: str, value: str, series: str | None = None) -> None:
    """Unique timestamps, finite values and regular steps, else an error."""
    keys = [series] if series else []
    bad = df.agg(F.count_if(~is_finite(value)).alias("nonfinite"), F.count_if(F.col(ts).isNull()).alias("nots")).first()
    if bad["nonfinite"] or bad["nots"]:
        raise ValueError("Series values must be finite and timestamps present")
    dup = df.groupBy(*keys, ts).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError("Series timestamps must be unique")
    reg = regularity(df, ts, series).where((F.col("distinct_steps") > 1) | (F.col("min_step_seconds") <= 0))
    if reg.limit(1).count():
        raise ValueError("Series must be regular (equal positive steps)")


def lag_features(df: DataFrame, ts: str, value: str, window: int, series: str | None = None) -> DataFrame:
    """``value_lag_1 .. value_lag_w`` (NULL where history is shorter)."""
    keys = [series] if series else []
    return lagged(df, keys, [ts], {f"{value}_lag_{i}": (value, i) for i in range(1, window + 1)}, before="pos")


def chronological_cut(df: DataFrame, ts: str, fractions: Sequence[float], series: str | None = None) -> DataFrame:
    """First floor(n * f_train) positions train, next floor(n * f_val) validation,
    rest test, per series."""
    keys = [series] if series else []
    ranked = cumulative(df.withColumn("_one", F.lit(1)), keys, [ts], weight="_one", before="pos", total="_n")
    a = F.floor(F.col("_n") * float(fractions[0]))
    b = a + F.floor(F.col("_n") * float(fractions[1]))
    split = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_one", "_n")


def standardise(train: DataFrame, value: str, series: str | None = None) -> DataFrame:
    """Training mean and population std per series (std 0 -> 1)."""
    keys = [series] if series else []
    return train.groupBy(*keys).agg(F.avg(value).alias("mean"),
                                    F.when(F.stddev_pop(value) > 0, F.stddev_pop(value)).otherwise(1.0).alias("std"))


def last_value_baseline(split_df: DataFrame, ts: str, value: str, series: str | None = None) -> DataFrame:
    """Predict the last training value over the whole validation horizon; MAE and RMSE."""
    keys = [series] if series else []
    last = split_df.where(F.col("split") == "train").groupBy(*keys).agg(
        F.max_by(value, ts).alias("_last"))
    val = split_df.where(F.col("split") == "validation")
    # one row per series: the series count is not bounded, so AQE picks the join from runtime size
    j = val.join(last, keys) if keys else val.crossJoin(last)
    err = F.col(value) - F.col("_last")
    return j.groupBy(*keys).agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                                F.count(F.lit(1)).alias("rows"))


def naive_baseline(df: DataFrame, ts: str, value: str, series: str | None = None,
                   split_col: str = "split", on: str = "validation") -> DataFrame:
    """Rolling one-step naive forecast (previous observed value) scored on ``on`` rows."""
    keys = [series] if series else []
    lagged = lag_features(df, ts, value, 1, series)
    err = F.col(value) - F.col(f"{value}_lag_1")
    scored = lagged.where((F.col(split_col) == on) & F.col(f"{value}_lag_1").isNotNull())
    return scored.groupBy(*keys).agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                                     F.count(F.lit(1)).alias("rows"))


def fit_ar(df: DataFrame, ts: str, value: str, p: int, d: int = 0, series: str | None = None) -> DataFrame:
    """AR(p) on the d-th difference by least squares with intercept.

    Differences and lags are column math over exact positions; the fit aggregates X'X and X'y
    ((p+1)^2 + (p+1) sums per series), then solves each series' small system in pandas on a
    one-row-per-series frame.  Returns (series?, coef array [intercept, phi_1..phi_p], n)."""
    keys = [series] if series else []
    cur = df.select(*keys, ts, F.col(value).cast("double").alias("_y"))
    for _ in range(d):
        lagged = lag_features(cur, ts, "_y", 1, series)
        cur = lagged.where(F.col("_y_lag_1").isNotNull()).select(*keys, ts, (F.col("_y") - F.col("_y_lag_1")).alias("_y"))
    feats = lag_features(cur, ts, "_y", p, series)
    for i in range(1, p + 1):
        feats = feats.where(F.col(f"_y_lag_{i}").isNotNull())
    xs = [F.lit(1.0)] + [F.col(f"_y_lag_{i}") for i in range(1, p + 1)]
    sums = []
    for a in range(p + 1):
        for b in range(p + 1):
            sums.append(F.sum(xs[a] * xs[b]).alias(f"xx_{a}_{b}"))
        sums.append(F.sum(xs[a] * F.col("_y")).alias(f"xy_{a}"))
    agg = feats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    k = p + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        coefs = []
        for _, row in pdf.iterrows():  # one row per series
            xx = np.array([[row[f"xx_{a}_{b}"] for b in range(k)] for a in range(k)], dtype=float)
            xy = np.array([row[f"xy_{a}"] for a in range(k)], dtype=float)
            coefs.append(np.linalg.lstsq(xx, xy, rcond=None)[0].tolist())
        out = pdf[keys + ["n"]].copy()
        out["coef"] = coefs
        return out
    schema = ", ".join([f"`{c}` {agg.schema[c].dataType.simpleString()}" for c in keys] +
                       ["n long", "coef array<double>"])
    return agg.mapInPandas(lambda it: (solve(pdf) for pdf in it), schema)


def forecast_ar(df: DataFrame, model: DataFrame, ts: str, value: str, p: int, d: int, horizon: int,
                step_seconds: int, series: str | None = None) -> DataFrame:
    """Z04 predict: recursive forecast of ``horizon`` steps from the last p + d observations of
    each series (a bounded tail per series), undoing the differencing."""
    keys = [series] if series else []
    pos = positions(df.select(*keys, ts, F.col(value).cast("double").alias("_y")), ts, series)
    tail_n = p + d
    maxpos = pos.groupBy(*keys).agg(F.max("pos").alias("_m"), F.max(ts).alias("_last_ts"))
    tail = pos.join(maxpos, keys) if keys else pos.crossJoin(maxpos)
    tail = tail.where(F.col("pos") > F.col("_m") - tail_n)
    grouped = tail.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "_y"))).alias("_hist"),
                                      F.first("_last_ts").alias("_last_ts"))  # <= p + d values per series
    j = grouped.join(model, keys) if keys else grouped.crossJoin(model)

    def run(it):
        for pdf in it:
            rows = []
            for _, r in pdf.iterrows():
                hist = [float(h["_y"]) for h in r["_hist"]]
                coef = list(r["coef"])
                levels = [hist]
                for _ in range(d):
                    levels.append(list(np.diff(levels[-1])))
                work = list(levels[-1])
                preds = []
                for _ in range(horizon):
                    lags_ = work[-p:][::-1] if p else []
                    yhat = coef[0] + sum(c * v for c, v in zip(coef[1:], lags_))
                    work.append(yhat)
                    preds.append(yhat)
                for level in range(d - 1, -1, -1):
                    base = levels[level][-1]
                    undone = []
                    for v in preds:
                        base = base + v
                        undone.append(base)
                    preds = undone
                for h, v in enumerate(preds, start=1):
                    rows.append({**{k: r[k] for k in keys}, "step": h,
                                 "ts": r["_last_ts"] + pd.Timedelta(seconds=step_seconds * h), "forecast": v})
            yield pd.DataFrame(rows, columns=keys + ["step", "ts", "forecast"])
    schema = ", ".join([f"`{c}` {j.schema[c].dataType.simpleString()}" for c in keys] +
                       ["step long", f"ts {df.schema[ts].dataType.simpleString()}", "forecast double"])
    return j.mapInPandas(run, schema)


def ar_residuals(df: DataFrame, model: DataFrame, ts: str, value: str, p: int,
                 series: str | None = None) -> DataFrame:
    """One-step prediction of every position from its observed history only (AR(p) on the
    levels, d = 0) and the residual actual - prediction; positions without p lags get NULL."""
    keys = [series] if series else []
    lagged = lag_features(df.select(*keys, ts, value), ts, value, p, series)
    j = lagged.join(model.select(*keys, "coef"), keys) if keys else lagged.crossJoin(model.select("coef"))
    pred = F.col("coef")[0]
    for i in range(1, p + 1):
        pred = pred + F.col("coef")[i] * F.col(f"{value}_lag_{i}")
    return j.select(*keys, ts, value, pred.alias("prediction"), (F.col(value) - pred).alias("residual"))
