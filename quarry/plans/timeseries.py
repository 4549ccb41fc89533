"""Pipelines for series: lags that are known at prediction time, rolling origins, forecasts and their intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions import metrics
from quarry.operators import series
from quarry.operators.split import time_series_split
from quarry.plans import estimators as est
from quarry.plans.graph import ComponentGraph, Pipeline, linear_graph, preprocessing


@dataclass(frozen=True)
class Horizon:
    """What a series problem needs: the time and series columns, steps between known and predicted rows, lags and step."""

    time_index: str
    gap: int = 0
    max_delay: int = 2
    forecast_horizon: int = 1
    series_id: str | None = None
    step_seconds: int = 86400

    @property
    def delays(self) -> list[int]:
        first = self.gap + self.forecast_horizon
        return list(range(first, first + self.max_delay + 1))

    @property
    def history(self) -> int:
        """Rows before the first predicted one that its lags reach."""
        return max(self.delays)


class TimeSeriesPipeline(Pipeline):
    """A pipeline whose features hold the target's lags from gap + horizon on, or whose estimator forecasts whole series.

    ``predict`` takes the rows to predict and the training rows before them; only those that lags reach are read again.
    """

    def __init__(self, graph: ComponentGraph, problem: str, horizon: Horizon, parameters: dict | None = None, name: str | None = None):
        super().__init__(graph, problem, parameters, name)
        self.horizon = horizon

    @property
    def forecasts(self) -> bool:
        return self.graph.steps[self.graph.order[-1]][0] in est.KERNELS

    def _lagged(self, df: DataFrame, y: str) -> DataFrame:
        h = self.horizon
        return series.lags(df, [y], h.delays, h.time_index, h.series_id, {y: "target"})

    def fit(self, df: DataFrame, y: str) -> TimeSeriesPipeline:
        self.y = y
        table = df if self.forecasts else self._lagged(df, y).where(F.col(f"target_delay_{self.horizon.history}").isNotNull())
        self.graph.fit(table, y, self.parameters)
        return self

    def _predicted(self, df: DataFrame, train: DataFrame | None = None) -> DataFrame:
        if self.forecasts:
            return super()._predicted(df)
        h = self.horizon
        test = df if self.y in df.columns else df.withColumn(self.y, F.lit(None).cast("double"))
        if train is None:
            return self._kept(self._lagged(test, self.y))
        if h.series_id:
            w = series.series_window(F.desc(h.time_index), h.series_id)
            tail = train.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= h.history + h.gap).drop("_k")
        else:
            tail = train.orderBy(F.desc(h.time_index)).limit(h.history + h.gap)
        both = test.withColumn("_asked", F.lit(True)).unionByName(tail.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
        return self._kept(self._lagged(both, self.y).where("_asked").drop("_asked"))

    def _kept(self, table: DataFrame) -> DataFrame:
        """The graph's predictions, with the time and series columns even if its components have replaced them."""
        h = self.horizon
        keys = {k: f"_kept_{i}" for i, k in enumerate((h.time_index, h.series_id)) if k}
        held = table.withColumns({n: F.struct(F.col(f"`{k}`").alias("v")) for k, n in keys.items()})
        out = super()._predicted(held)
        return out.withColumns({k: F.col(f"{n}.v") for k, n in keys.items()}).drop(*keys.values())

    def predict(self, df: DataFrame, train: DataFrame | None = None) -> DataFrame:
        return self.graph.inverse_target(self._predicted(df, train))

    def predict_in_sample(self, df: DataFrame) -> DataFrame:
        """Predictions of the training rows by their own lags; the first rows lack them and are predicted from nulls imputed."""
        return self.graph.inverse_target(super()._predicted(df) if self.forecasts else self._kept(self._lagged(df, self.y)))

    def score(self, df: DataFrame, names: list[str], train: DataFrame | None = None) -> metrics.Scores:
        out = self._predicted(df, train)
        y = F.col(f"`{self.y}`").cast("double").alias("y")
        table = out.select(y, F.col("prediction").cast("double").alias("p"), *([F.get("probability", F.lit(1)).alias("p1")] if "probability" in out.columns else [])).persist()
        extra = {"proba": "p1"} if "probability" in out.columns else {}
        if train is not None and "regression" in self.problem:
            extra["train"] = (train, self.y, self.horizon.time_index)
        got = metrics.score_all(table, self.problem, names, "y", "p", **extra)
        table.unpersist()
        return got

    def new(self, parameters: dict) -> TimeSeriesPipeline:
        return TimeSeriesPipeline(ComponentGraph(self.graph.steps, self.graph.key), self.problem, self.horizon, parameters, self.name)

    def get_forecast_period(self, train: DataFrame) -> DataFrame:
        h = self.horizon
        return series.forecast_period(train, h.time_index, h.forecast_horizon, h.gap, h.step_seconds, h.series_id)

    def get_forecast_predictions(self, train: DataFrame) -> DataFrame:
        """Predictions for the horizon after the last training row; other columns are null there."""
        ahead = self.get_forecast_period(train)
        more = [f for f in train.schema.fields if f.name not in ahead.columns]
        return self.predict(ahead.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]), train)

    def get_prediction_intervals(self, df: DataFrame, train: DataFrame | None = None, coverage: float = 0.95) -> DataFrame:
        return est.prediction_intervals(self.predict(df, train), self.horizon.time_index, coverage, self.horizon.series_id)


def make_timeseries_pipeline(df: DataFrame, y: str, estimator: str, problem: str, horizon: Horizon, parameters: dict | None = None) -> TimeSeriesPipeline:
    """Preprocessing that the schema and the estimator call for; estimators that forecast series see time and target only."""
    p = dict(parameters or {})
    keys = {"time_index": horizon.time_index, "series_id": horizon.series_id}
    if estimator in est.KERNELS:
        p[estimator] = keys | {"gap": horizon.gap, "forecast_horizon": horizon.forecast_horizon} | p.get(estimator, {})
        return TimeSeriesPipeline(linear_graph([estimator]), problem, horizon, p, estimator)
    names = [*preprocessing(df, y, problem, estimator), estimator]
    unknown = [c for c in schema.of_type(df, "unknown") if c != y]
    if "DropColumns" in names:
        p.setdefault("DropColumns", {"columns": unknown})
    if "OneHotEncoder" in names:
        p.setdefault("OneHotEncoder", {"handle_missing": "as_category"})
    return TimeSeriesPipeline(linear_graph(names), problem, horizon, p, f"{estimator} w/ {' + '.join(names[:-1])}")


def baseline_pipeline(problem: str, horizon: Horizon) -> TimeSeriesPipeline:
    name = "MultiseriesTimeSeriesBaselineRegressor" if horizon.series_id else "TimeSeriesBaselineEstimator"
    keys = {"time_index": horizon.time_index, "series_id": horizon.series_id, "gap": horizon.gap, "forecast_horizon": horizon.forecast_horizon}
    return TimeSeriesPipeline(linear_graph([name]), problem, horizon, {name: keys}, name)


def rolling_origins(df: DataFrame, horizon: Horizon, n_splits: int = 3, n_series: int = 1) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) of each split: no training row is later than a test row."""
    cut = time_series_split(df, horizon.time_index, n_splits, horizon.forecast_horizon, horizon.gap, horizon.max_delay, n_series).persist()
    part = lambda k, test: cut.where((F.col("split") == k) & (F.col("is_test") == test)).drop("split", "is_test")
    return [(part(k, False), part(k, True)) for k in range(n_splits)]
