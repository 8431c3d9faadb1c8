"""The tables every later question starts from, built once per session and input folder.

Frames are windowed, the windows stored, a model fitted on the stored windows, and the scored windows stored. Later
questions read those tables, so their plans stay small and lost executors cost a re-read, not a re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from busvitals.operators.baseline import fit_baseline
from busvitals.operators.frames import engineer_frames
from busvitals.operators.health import health_score
from busvitals.operators.kernel import KernelModel, fit_parzen, load_model, rbf_score, save_model
from busvitals.operators.quantiles import value_sketches
from busvitals.operators.series import trend_at_window
from busvitals.operators.windows import window_features, window_index
from busvitals.sources.scratch import fresh_path, stored
from busvitals.sources.event_frames import event_frames
from busvitals.sources.tables import load_windows, stored_schema, write_windows

SCORED_SCHEMA = stored_schema(
    T.StructField("window_index", T.LongType()), T.StructField("anomaly_score", T.DoubleType())
)
_OPEN: dict[tuple[str, str], "Workspace"] = {}


class Workspace:
    """Stored windows, model and scored windows for one input folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.root = fresh_path(spark, "tables")
        self._engineered = self._windows = self._model = self._scored = self._health = self._trended = None
        self._baselines: dict[int, DataFrame] = {}
        self._sketches: dict[str, DataFrame] = {}

    def frames(self) -> DataFrame:
        return event_frames(self.spark, self.folder)

    def engineered(self) -> DataFrame:
        """Frames with all per-frame columns, stored."""
        if self._engineered is None:
            self._engineered = stored(engineer_frames(self.frames()), "engineered")
        return self._engineered

    def windows(self) -> DataFrame:
        if self._windows is None:
            write_windows(window_features(self.frames()), f"{self.root}/windows")
            self._windows = load_windows(self.spark, f"{self.root}/windows")
        return self._windows

    def model(self) -> KernelModel:
        if self._model is None:
            save_model(self.spark, fit_parzen(self.windows()), f"{self.root}/model")
            self._model = load_model(self.spark, f"{self.root}/model")
        return self._model

    def scored(self) -> DataFrame:
        """Windows with ``anomaly_score`` and ``window_index``."""
        if self._scored is None:
            write_windows(rbf_score(window_index(self.windows()), self.model()), f"{self.root}/scored")
            self._scored = self.spark.read.schema(SCORED_SCHEMA).parquet(f"{self.root}/scored")
        return self._scored

    def baseline(self, ddof: int = 0) -> DataFrame:
        """One row: 0 = the health engine's population deviations, 1 = the service's sample deviations."""
        if ddof not in self._baselines:
            path = f"{self.root}/baseline{ddof}"
            fit_baseline(self.scored(), ddof=ddof).coalesce(1).write.parquet(path)
            self._baselines[ddof] = self.spark.read.parquet(path)
        return self._baselines[ddof]

    def engine_health(self) -> DataFrame:
        """Health as the health engine reports it: rounded to two digits after categorising."""
        return health_score(self.scored(), self.baseline(0), digits=2)

    def service_health(self) -> DataFrame:
        """Health as the service and the explanations use it: unrounded, sample deviations. Stored, read by most questions."""
        if self._health is None:
            self._health = stored(health_score(self.scored(), self.baseline(1)), "health")
        return self._health

    def sketches(self, value: str) -> DataFrame:
        """Stored sketches of ``anomaly_score``, or of ``cyber_health`` as the engine reports it, one per vehicle and capture;
        small, whatever the number of windows."""
        if value not in self._sketches:
            source = self.scored() if value == "anomaly_score" else self.engine_health()
            keys = ["vehicle_id", "capture", "attack_type", "attack_label"]
            self._sketches[value] = stored(value_sketches(source, keys, value), f"sketches-{value}")
        return self._sketches[value]

    def trended(self) -> DataFrame:
        """Health with the local trend at each window. Stored, read by all stories."""
        if self._trended is None:
            self._trended = stored(trend_at_window(self.service_health(), ["vehicle_id"], "window_index", "cyber_health"), "trended")
        return self._trended


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]
