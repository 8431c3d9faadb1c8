"""Kernel scoring against a support table of bounded size, and the parameter tables of the models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.baseline import fit_baseline
from busvitals.operators.quantiles import exact_percentiles
from busvitals.operators.sampling import subsample_normal
from busvitals.sources.scratch import stored

ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class KernelModel:
    """Scaler and weighted support vectors; at most ``MAX_TRAIN_ROWS`` vectors, so it fits every task."""

    mean: np.ndarray
    std: np.ndarray
    support: np.ndarray
    alpha: np.ndarray
    gamma: float
    rho: float

    def __post_init__(self) -> None:
        if len(self.alpha) > fv.MAX_TRAIN_ROWS:
            raise ValueError(f"{len(self.alpha)} support vectors exceed the bound of {fv.MAX_TRAIN_ROWS}")


def rbf_score(windows: DataFrame, model: KernelModel, out: str = "anomaly_score") -> DataFrame:
    """sum(alpha * exp(-gamma * |x - sv|^2)) - rho per window; narrow, vectorised, null for incomplete windows."""
    shared = windows.sparkSession.sparkContext.broadcast(
        (model.mean, model.std, model.support, model.alpha, model.gamma, model.rho)
    )

    @F.pandas_udf("double")
    def decision(*features: pd.Series) -> pd.Series:
        mean, std, support, alpha, gamma, rho = shared.value
        x = (np.column_stack([f.to_numpy(dtype="float64") for f in features]) - mean) / std
        result = np.empty(len(x))
        norms = (support**2).sum(axis=1)
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = x[start : start + ROWS_AT_ONCE]
            distance = np.maximum((part**2).sum(axis=1)[:, None] + norms - 2.0 * part @ support.T, 0.0)
            result[start : start + ROWS_AT_ONCE] = np.exp(-gamma * distance) @ alpha - rho
        return pd.Series(result).where(~np.isnan(result), None).astype("float64")

    scored = windows.withColumn(out, decision(*[F.col(c) for c in fv.FEATURES]))
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def fit_parzen(windows: DataFrame) -> KernelModel:
    """Equal weights over the training draw, offset at the 5th percentile of the normal kernel values.

    The limit nu = 1 of the one-class machine. Fitting is an action: the model has a fixed maximal size.
    """
    mean, std = scaler(windows)
    rows = subsample_normal(windows).select(*fv.FEATURES).toPandas().to_numpy(dtype="float64")
    if not len(rows):
        raise ValueError("no complete normal windows to fit on")
    alpha = np.full(len(rows), 1.0 / len(rows))
    raw = KernelModel(mean, std, (rows - mean) / std, alpha, 1.0 / len(fv.FEATURES), 0.0)
    return KernelModel(mean, std, raw.support, alpha, raw.gamma, _offset(windows, raw))


def _offset(windows: DataFrame, raw: KernelModel) -> float:
    # stored, because finding the percentile scans the values twice and computing them is the expensive part
    normal = stored(rbf_score(windows.where("attack_label = 0"), raw).select("anomaly_score"), "kernel-values")
    return exact_percentiles(normal, [], "anomaly_score", {"rho": fv.THRESHOLD_PERCENTILE}).first()["rho"]


def scaler(windows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the normal windows; a constant feature keeps scale 1."""
    row = fit_baseline(windows, fv.FEATURES, ddof=0, floor=None).first()
    std = np.array([row[f"s_{c}"] for c in fv.FEATURES])
    return np.array([row[f"m_{c}"] for c in fv.FEATURES]), np.where(std == 0, 1.0, std)


def save_model(spark: SparkSession, model: KernelModel, path: str) -> None:
    """Scaler, support vectors and parameters as three Parquet tables."""
    rows = [(i, c, float(m), float(s)) for i, (c, m, s) in enumerate(zip(fv.FEATURES, model.mean, model.std))]
    spark.createDataFrame(rows, "ord int, feature string, mean double, std double").coalesce(1).write.parquet(f"{path}/scaler")
    vectors = [(i, float(a), [float(v) for v in sv]) for i, (a, sv) in enumerate(zip(model.alpha, model.support))]
    spark.createDataFrame(vectors, "sv_id int, alpha double, features array<double>").coalesce(1).write.parquet(f"{path}/support")
    spark.createDataFrame([(float(model.gamma), float(model.rho))], "gamma double, rho double").coalesce(1).write.parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> KernelModel:
    scaling = spark.read.parquet(f"{path}/scaler").orderBy("ord").collect()
    vectors = spark.read.parquet(f"{path}/support").orderBy("sv_id").limit(fv.MAX_TRAIN_ROWS + 1).collect()
    params = spark.read.parquet(f"{path}/params").first()
    return KernelModel(
        np.array([r["mean"] for r in scaling]),
        np.array([r["std"] for r in scaling]),
        np.array([r["features"] for r in vectors]),
        np.array([r["alpha"] for r in vectors]),
        params["gamma"],
        params["rho"],
    )
