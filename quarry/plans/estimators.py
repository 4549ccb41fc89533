"""Estimators over Spark ML by family and problem, with the search spaces of their parameters.

Where Spark has no such learner the nearest one stands in, and says so in ``approximates``: extremely randomised trees by
a forest of small feature subsets, the three gradient-boosting libraries by Spark's, kernel machines by linear ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.ordered import numbered
from quarry.operators.encode import vectors
from quarry.operators.series import naive_forecast, series_window

B, M, REG = "binary", "multiclass", "regression"
TB, TM, TR, MR = "time_series_binary", "time_series_multiclass", "time_series_regression", "multiseries_time_series_regression"
CLS, ALL_R = (B, M, TB, TM), (REG, TR, MR)


@dataclass(frozen=True)
class Spec:
    """What the search knows of an estimator: family, problems, parameters with defaults, and their ranges."""

    family: str
    problems: tuple[str, ...]
    defaults: dict = field(default_factory=dict)
    space: dict = field(default_factory=dict)
    approximates: str = ""


_TREES = {"n_estimators": (10, 1000), "max_depth": (1, 10)}
_BOOST = {"eta": (1e-6, 1.0), "max_depth": (1, 10), "n_estimators": (1, 1000)}
ESTIMATORS: dict[str, Spec] = {
    "BaselineClassifier": Spec("baseline", (B, M), {"strategy": "mode"}),
    "LogisticRegressionClassifier": Spec("linear_model", CLS, {"C": 1.0}, {"C": (0.01, 10.0)}),
    "ElasticNetClassifier": Spec("linear_model", CLS, {"C": 1.0, "l1_ratio": 0.15}, {"C": (0.01, 10.0), "l1_ratio": (0.0, 1.0)}),
    "DecisionTreeClassifier": Spec("decision_tree", CLS, {"criterion": "gini", "max_depth": 6}, {"criterion": ["gini", "entropy"], "max_depth": (4, 10)}),
    "RandomForestClassifier": Spec("random_forest", CLS, {"n_estimators": 100, "max_depth": 6}, _TREES),
    "ExtraTreesClassifier": Spec("extra_trees", CLS, {"n_estimators": 100, "max_depth": 6}, {"n_estimators": (10, 1000), "max_depth": (4, 10)}, "extremely randomised trees"),
    "XGBoostClassifier": Spec("xgboost", CLS, {"eta": 0.1, "max_depth": 6, "n_estimators": 100}, _BOOST, "XGBoost"),
    "LightGBMClassifier": Spec("lightgbm", CLS, {"eta": 0.1, "max_depth": 5, "n_estimators": 100}, {"eta": (1e-6, 1.0), "n_estimators": (10, 100), "max_depth": (1, 10)}, "LightGBM"),
    "CatBoostClassifier": Spec("catboost", CLS, {"eta": 0.03, "max_depth": 6, "n_estimators": 10}, {"eta": (1e-6, 1.0), "n_estimators": (4, 100), "max_depth": (4, 10)}, "CatBoost"),
    "KNeighborsClassifier": Spec("k_neighbors", CLS, {"n_neighbors": 5, "max_reference": 5000}, {"n_neighbors": (2, 12)}),
    "SVMClassifier": Spec("svm", CLS, {"C": 1.0}, {"C": (0.01, 10.0)}, "a support-vector machine with a kernel"),
    "BaselineRegressor": Spec("baseline", (REG, TR), {"strategy": "mean"}),
    "LinearRegressor": Spec("linear_model", ALL_R, {"fit_intercept": True}, {"fit_intercept": [True, False]}),
    "ElasticNetRegressor": Spec("linear_model", ALL_R, {"alpha": 0.0001, "l1_ratio": 0.15}, {"alpha": (0.0, 1.0), "l1_ratio": (0.0, 1.0)}),
    "DecisionTreeRegressor": Spec("decision_tree", ALL_R, {"max_depth": 6}, {"max_depth": (4, 10)}),
    "RandomForestRegressor": Spec("random_forest", ALL_R, {"n_estimators": 100, "max_depth": 6}, {"n_estimators": (10, 1000), "max_depth": (1, 30)}),
    "ExtraTreesRegressor": Spec("extra_trees", ALL_R, {"n_estimators": 100, "max_depth": 6}, {"n_estimators": (10, 1000), "max_depth": (4, 10)}, "extremely randomised trees"),
    "XGBoostRegressor": Spec("xgboost", ALL_R, {"eta": 0.1, "max_depth": 6, "n_estimators": 100}, _BOOST, "XGBoost"),
    "LightGBMRegressor": Spec("lightgbm", (REG, TR), {"eta": 0.1, "max_depth": 5, "n_estimators": 20}, {"eta": (1e-6, 1.0), "n_estimators": (10, 100), "max_depth": (1, 10)}, "LightGBM"),
    "CatBoostRegressor": Spec("catboost", ALL_R, {"eta": 0.03, "max_depth": 6, "n_estimators": 10}, {"eta": (1e-6, 1.0), "n_estimators": (4, 100), "max_depth": (4, 10)}, "CatBoost"),
    "SVMRegressor": Spec("svm", (REG, TR), {"C": 1.0}, {"C": (0.01, 10.0)}, "support-vector regression with a kernel"),
    "TimeSeriesBaselineEstimator": Spec("baseline", (TR, TB, TM), {"gap": 1, "forecast_horizon": 1}),
    "MultiseriesTimeSeriesBaselineRegressor": Spec("baseline", (MR,), {"gap": 1, "forecast_horizon": 1}),
    "ExponentialSmoothingRegressor": Spec("exponential_smoothing", (TR,), {"sp": 2}, {"sp": (2, 8)}),
    "ARIMARegressor": Spec("arima", (TR,), {"max_p": 5, "d": 0}, {"max_p": (3, 10), "d": (0, 2)}, "auto-ARIMA, by an autoregression of chosen order"),
    "VARMAXRegressor": Spec("varmax", (MR,), {"p": 1}, {"p": (1, 10)}, "VARMAX, by a vector autoregression"),
    "ProphetRegressor": Spec("prophet", (TR,), {"changepoints": 5}, {"changepoints": (1, 20)}, "Prophet, by a piecewise line with Fourier terms"),
}


def estimators_for(problem: str, families: list[str] | None = None, excluded: list[str] | None = None) -> list[str]:
    """Names of the estimators for a problem; baselines are left out."""
    return [n for n, s in ESTIMATORS.items() if problem in s.problems and s.family != "baseline" and (not families or s.family in families) and s.family not in (excluded or [])]


def families_for(problem: str) -> list[str]:
    return list(dict.fromkeys(ESTIMATORS[n].family for n in estimators_for(problem)))


def _ml(name: str, p: dict, classes: int, n: int):
    """The Spark learner of an estimator."""
    kind = name.replace("Classifier", "").replace("Regressor", "")
    reg = 1.0 / max(p.get("C", 1.0) * n, 1.0)
    if name.endswith("Classifier"):
        boost = lambda: C.GBTClassifier(maxDepth=p["max_depth"], maxIter=p["n_estimators"], stepSize=max(p["eta"], 1e-6), seed=0)
        one = {
            "LogisticRegression": lambda: C.LogisticRegression(regParam=reg, elasticNetParam=0.0),
            "ElasticNet": lambda: C.LogisticRegression(regParam=reg, elasticNetParam=p["l1_ratio"]),
            "DecisionTree": lambda: C.DecisionTreeClassifier(maxDepth=p["max_depth"], impurity=p["criterion"], seed=0),
            "RandomForest": lambda: C.RandomForestClassifier(numTrees=p["n_estimators"], maxDepth=p["max_depth"], seed=0),
            "ExtraTrees": lambda: C.RandomForestClassifier(numTrees=p["n_estimators"], maxDepth=p["max_depth"], featureSubsetStrategy="sqrt", subsamplingRate=1.0, bootstrap=False, seed=0),
            "SVM": lambda: C.LinearSVC(regParam=reg),
        }.get(kind, boost)()
        only_two = kind in ("XGBoost", "LightGBM", "CatBoost", "SVM")
        return C.OneVsRest(classifier=one) if only_two and classes > 2 else one
    boost = lambda: R.GBTRegressor(maxDepth=p["max_depth"], maxIter=p["n_estimators"], stepSize=max(p["eta"], 1e-6), seed=0)
    return {
        "Linear": lambda: R.LinearRegression(fitIntercept=p["fit_intercept"], solver="normal"),
        "ElasticNet": lambda: R.LinearRegression(regParam=p["alpha"], elasticNetParam=p["l1_ratio"]),
        "DecisionTree": lambda: R.DecisionTreeRegressor(maxDepth=p["max_depth"], seed=0),
        "RandomForest": lambda: R.RandomForestRegressor(numTrees=p["n_estimators"], maxDepth=p["max_depth"], seed=0),
        "ExtraTrees": lambda: R.RandomForestRegressor(numTrees=p["n_estimators"], maxDepth=p["max_depth"], featureSubsetStrategy="sqrt", bootstrap=False, seed=0),
        "SVM": lambda: R.LinearRegression(regParam=reg, loss="huber"),
    }.get(kind, boost)()


class Estimator:
    """An estimator on the numeric columns of a table; predictions come as ``prediction`` and ``probability`` (by class)."""

    def __init__(self, name: str, **parameters):
        if name not in ESTIMATORS:
            raise ValueError(f"no estimator {name!r}")
        self.name, self.spec = name, ESTIMATORS[name]
        self.parameters = self.spec.defaults | parameters
        self.model = None

    def fit(self, df: DataFrame, y: str, features: list[str]) -> Estimator:
        self.y, self.features = y, features
        data = df.where(F.col(f"`{y}`").isNotNull())
        if self.name in KERNELS:
            keys = [self.parameters[k] for k in ("time_index", "series_id") if self.parameters.get(k)]
            if not self.parameters.get("time_index"):
                raise ValueError(f"{self.name} needs a time index")
            self.model = data.select(*keys, F.col(f"`{y}`").cast("double").alias(y))
        elif self.spec.family == "baseline":
            self.model = self._baseline(data)
        elif self.spec.family == "k_neighbors":
            columns = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in features]
            rows = data.select(*columns, F.col(f"`{y}`").cast("double").alias("_y")).orderBy(F.xxhash64(*features), *features).limit(self.parameters["max_reference"]).collect()
            self.model = np.array([list(r) for r in rows], dtype=float)
        else:
            table = vectors(data, features).select("features", F.col(f"`{y}`").cast("double").alias("label"))
            classes = int((table.agg(F.max("label")).first()[0] or 0) + 1) if self.name.endswith("Classifier") else 0
            n = table.count() if "C" in self.parameters else 1
            self.model = _ml(self.name, self.parameters, classes, n).fit(table)
        return self

    def _baseline(self, df: DataFrame):
        strategy = self.parameters.get("strategy")
        col = F.col(f"`{self.y}`").cast("double")
        if strategy in ("mean", "median"):
            return df.agg(F.avg(col) if strategy == "mean" else F.median(col)).first()[0]
        counts = sorted(((r[1], -r[0]) for r in df.groupBy(col.alias("v")).count().collect()), reverse=True)
        total = sum(n for n, _ in counts) or 1
        return {-v: n / total for n, v in counts}

    def predict(self, df: DataFrame) -> DataFrame:
        if self.name in KERNELS:
            return self._forecast(df)
        if self.spec.family == "baseline":
            if not isinstance(self.model, dict):
                return df.withColumn("prediction", F.lit(self.model))
            size = int(max(self.model)) + 1
            chosen = next(iter(self.model))
            shares = [float(i == chosen) if self.parameters["strategy"] == "mode" else self.model.get(float(i), 0.0) for i in range(size)]
            return df.withColumn("prediction", F.lit(chosen)).withColumn("probability", F.array(*map(F.lit, shares)))
        if self.spec.family == "k_neighbors":
            return self._vote(df)
        out = self.model.transform(vectors(df, self.features))
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop("features", "rawPrediction")

    def _forecast(self, df: DataFrame) -> DataFrame:
        """The rows in order of time are the steps after the training series' end."""
        time, series = self.parameters["time_index"], self.parameters.get("series_id")
        steps = df.withColumn("_step", F.row_number().over(series_window(time, series))) if series else numbered(df, "_step", time)
        most = steps.agg(F.max("_step")).first()[0] or 1
        p = {k: v for k, v in self.parameters.items() if k not in ("time_index", "series_id")}
        got = forecast(self.model, self.y, time, int(most), self.name, series, **p).select(*([F.col(series).alias("_series")] if series else []), F.col("step").alias("_at"), "prediction")
        same = F.col("_step") == F.col("_at")
        return steps.join(got, same & F.col(series).eqNullSafe(F.col("_series")) if series else same, "left").drop("_step", "_at", "_series")

    def stored(self, path: str) -> dict:
        """What of the model is small, as JSON; the rest is written below the path."""
        if hasattr(self.model, "write") and not isinstance(self.model, DataFrame):
            self.model.write().overwrite().save(path)
            return {"kind": "ml"}
        if isinstance(self.model, DataFrame):
            self.model.write.mode("overwrite").parquet(path)
            return {"kind": "rows"}
        if isinstance(self.model, np.ndarray):
            return {"kind": "array", "values": self.model.tolist()}
        return {"kind": "shares", "values": list(self.model.items())} if isinstance(self.model, dict) else {"kind": "value", "values": self.model}

    def restore(self, spark, path: str, facts: dict) -> None:
        from pyspark.ml.util import DefaultParamsReader

        kind, values = facts["kind"], facts.get("values")
        self.model = DefaultParamsReader.loadParamsInstance(path, spark.sparkContext) if kind == "ml" else spark.read.parquet(path) if kind == "rows" else np.array(values, dtype=float) if kind == "array" else dict(map(tuple, values)) if kind == "shares" else values

    def _vote(self, df: DataFrame) -> DataFrame:
        x, y, k = self.model[:, :-1], self.model[:, -1].astype(int), self.parameters["n_neighbors"]
        size = int(y.max()) + 1 if len(y) else 1

        @F.pandas_udf("array<double>")
        def shares(rows: pd.Series) -> pd.Series:
            q, out = np.array(rows.tolist(), dtype=float), []
            for at in range(0, len(q), 500):  # 500 rows by the reference rows at a time
                part = q[at : at + 500]
                d = sum((part[:, j, None] - x[None, :, j]) ** 2 for j in range(x.shape[1]))
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                out += [np.bincount(y[n], minlength=size).astype(float) / max(len(n), 1) for n in near]
            return pd.Series(out)

        out = df.withColumn("probability", shares(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.features])))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def importance(self) -> dict[str, float]:
        """Importance of each feature, largest size first."""
        m = self.model
        values = m.featureImportances.toArray() if hasattr(m, "featureImportances") else m.coefficients.toArray() if hasattr(m, "coefficients") else np.zeros(len(self.features))
        return dict(sorted(zip(self.features, map(float, values), strict=False), key=lambda x: -abs(x[1])))


def tree_intervals(est: Estimator, df: DataFrame, coverage: list[float] = (0.95,)) -> DataFrame:
    """Bounds from the spread of a forest's trees: prediction plus or minus the normal quantile times their deviation.

    Each tree's prediction is one more column of the same pass.
    """
    from statistics import NormalDist

    if not hasattr(est.model, "trees"):
        raise ValueError(f"{est.name} has no trees to compare")
    out, names = vectors(df, est.features), []
    for i, tree in enumerate(est.model.trees):
        names.append(f"_tree_{i}")
        out = tree.copy().setPredictionCol(names[-1]).transform(out)
        out = out.drop(*[c for c in ("rawPrediction", "probability") if c in out.columns])
    values = F.array(*names)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(names)
    out = out.withColumn("prediction", mean).withColumn("_sd", F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("prediction")) ** 2) / len(names)))
    for c in coverage:
        z = NormalDist().inv_cdf(0.5 + c / 2)
        out = out.withColumns({f"{c}_lower": F.col("prediction") - z * F.col("_sd"), f"{c}_upper": F.col("prediction") + z * F.col("_sd")})
    return out.drop("features", "_sd", *names)


def unable_to_handle_nans(name: str) -> bool:
    """Whether an estimator needs the imputer: Spark's learners refuse nulls, the series kernels and baselines do not."""
    return ESTIMATORS[name].family not in ("baseline", "exponential_smoothing", "arima", "varmax", "prophet")


def prediction_intervals(predicted: DataFrame, time_index: str, coverage: float = 0.95, series_id: str | None = None) -> DataFrame:
    """Prediction and rolling standard deviation of five rows times the normal quantile; the head takes the first known one."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(0.5 + coverage / 2)
    w = series_window(time_index, series_id)
    spread = F.when(F.count("prediction").over(w.rowsBetween(-4, 0)) == 5, F.stddev_samp("prediction").over(w.rowsBetween(-4, 0)))
    known = predicted.withColumn("_s", spread)
    full = F.coalesce("_s", F.first("_s", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    return known.withColumns({"lower": F.col("prediction") - z * full, "upper": F.col("prediction") + z * full}).drop("_s")


# Forecasts of whole series: kernels over the values in order of time; a task holds one series.


def holt_winters(y: np.ndarray, horizon: int, period: int, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2) -> np.ndarray:
    n = len(y)
    if n < 2 * period:
        return np.full(horizon, y.mean() if n else np.nan)
    level, trend = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
    season = list(y[:period] - level)
    for t in range(period, n):
        last = level
        level = alpha * (y[t] - season[t % period]) + (1 - alpha) * (level + trend)
        trend = beta * (level - last) + (1 - beta) * trend
        season[t % period] = gamma * (y[t] - level) + (1 - gamma) * season[t % period]
    return np.array([level + (h + 1) * trend + season[(n + h) % period] for h in range(horizon)])


def autoregression(y: np.ndarray, horizon: int, max_p: int = 5, d: int = 0) -> np.ndarray:
    """The order with the least AIC, fitted by least squares on the differenced series."""
    z, tails = y.astype(float), []
    for _ in range(d):
        tails.append(z[-1])
        z = np.diff(z)
    best = (np.inf, np.array([z.mean() if len(z) else 0.0]))
    for p in range(1, min(max_p, (len(z) - 2) // 2) + 1):
        x = np.column_stack([np.ones(len(z) - p), *[z[p - k - 1 : len(z) - k - 1] for k in range(p)]])
        w, *_ = np.linalg.lstsq(x, z[p:], rcond=None)
        aic = len(x) * np.log(((z[p:] - x @ w) ** 2).mean() + 1e-12) + 2 * (p + 1)
        if aic < best[0]:
            best = (aic, w)
    out, past = [], list(z)
    for _ in range(horizon):
        w = best[1]
        out.append(w[0] + sum(w[k + 1] * past[-k - 1] for k in range(len(w) - 1)))
        past.append(out[-1])
    forecast = np.array(out)
    for tail in reversed(tails):
        forecast = tail + np.cumsum(forecast)
    return forecast


def piecewise_fourier(y: np.ndarray, horizon: int, changepoints: int = 5, period: int = 7, terms: int = 3) -> np.ndarray:
    """A line with changes of slope and Fourier terms, by ridge regression."""
    n = len(y)
    t = np.arange(n + horizon) / max(n, 1)
    knots = np.linspace(0, 0.8, changepoints + 1)[1:]
    angle = 2 * np.pi * np.arange(n + horizon) / period
    x = np.column_stack([np.ones(n + horizon), t, *[np.clip(t - k, 0, None) for k in knots], *[f(angle * j) for j in range(1, terms + 1) for f in (np.sin, np.cos)]])
    a = x[:n].T @ x[:n] + 1e-3 * np.eye(x.shape[1])
    return x[n:] @ np.linalg.solve(a, x[:n].T @ y)


def repeated(y: np.ndarray, horizon: int, lag: int) -> np.ndarray:
    """The value ``lag`` steps earlier, over and over where that lies ahead."""
    return np.resize(y[-lag:], horizon) if len(y) else np.full(horizon, np.nan)


KERNELS = {"TimeSeriesBaselineEstimator": lambda y, h, p: repeated(y, h, p.get("gap", 0) + p.get("forecast_horizon", 1)), "MultiseriesTimeSeriesBaselineRegressor": lambda y, h, p: repeated(y, h, p.get("gap", 0) + p.get("forecast_horizon", 1)), "VARMAXRegressor": lambda y, h, p: autoregression(y, h, p.get("p", 1)), "ExponentialSmoothingRegressor": lambda y, h, p: holt_winters(y, h, p.get("sp", 2)), "ARIMARegressor": lambda y, h, p: autoregression(y, h, p.get("max_p", 5), p.get("d", 0)), "ProphetRegressor": lambda y, h, p: piecewise_fourier(y, h, p.get("changepoints", 5), p.get("period", 7))}


def forecast(df: DataFrame, y: str, time_index: str, horizon: int, name: str, series_id: str | None = None, **parameters) -> DataFrame:
    """(series, step, prediction) of the next ``horizon`` steps of each series."""
    p = ESTIMATORS[name].defaults | parameters
    keys = [series_id] if series_id else []
    types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    kernel = KERNELS[name]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(time_index)[y].astype(float).to_numpy()
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * horizon for k in keys}, "step": range(1, horizon + 1), "prediction": kernel(values, horizon, p)})

    grouped = df.groupBy(*keys) if keys else df.groupBy(F.lit(0).alias("_g"))
    return grouped.applyInPandas(one, f"{types}step int, prediction double")


def var_forecast(wide: DataFrame, columns: list[str], time_index: str, horizon: int, p: int = 1) -> DataFrame:
    """(step, one column for each series) by a vector autoregression on a panel of few series in wide form."""
    types = ", ".join(f"`{c}` double" for c in columns)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        z = rows.sort_values(time_index)[columns].astype(float).ffill().fillna(0.0).to_numpy()
        x = np.column_stack([np.ones(len(z) - p), *[z[p - k - 1 : len(z) - k - 1] for k in range(p)]])
        w, *_ = np.linalg.lstsq(x, z[p:], rcond=None)
        past, out = list(z), []
        for _ in range(horizon):
            out.append(np.concatenate([[1.0], *[past[-k - 1] for k in range(p)]]) @ w)
            past.append(out[-1])
        return pd.DataFrame(out, columns=columns).assign(step=range(1, horizon + 1))[["step", *columns]]

    return wide.groupBy(F.lit(0).alias("_g")).applyInPandas(one, f"step int, {types}")


def baseline_forecast(df: DataFrame, y: str, time_index: str, gap: int = 1, forecast_horizon: int = 1, series_id: str | None = None) -> DataFrame:
    return naive_forecast(df, y, time_index, gap, forecast_horizon, series_id)


def stacked(df: DataFrame, y: str, features: list[str], names: list[str], key: str, final: str | None = None, folds: int = 3) -> tuple[list[Estimator], Estimator, DataFrame]:
    """Base estimators, a final one on their out-of-fold predictions, and these predictions by key."""
    from quarry.operators.split import hashed_folds

    dealt = hashed_folds(df, key, folds).persist()
    out = None
    for i, name in enumerate(names):
        parts = None
        for k in range(folds):
            got = Estimator(name).fit(dealt.where(F.col("fold") != k), y, features).predict(dealt.where(F.col("fold") == k))
            value = F.get("probability", F.lit(1)) if "probability" in got.columns else F.col("prediction")
            got = got.select(key, value.cast("double").alias(f"base_{i}"))
            parts = got if parts is None else parts.unionByName(got)
        out = parts if out is None else out.join(parts, key)
    table = out.join(df.select(key, y), key)
    last = Estimator(final or ("ElasticNetClassifier" if names[0].endswith("Classifier") else "ElasticNetRegressor"))
    last.fit(table, y, [f"base_{i}" for i in range(len(names))])
    bases = [Estimator(n).fit(df, y, features) for n in names]
    dealt.unpersist()
    return bases, last, last.predict(table)
