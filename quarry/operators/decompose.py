"""Decomposers as components: the target without trend and season, and back; trend and season go on beyond the series."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.base import Component
from quarry.operators.series import autocorrelations, modal_step, period_of, stl

#: Units of time whose step has a season, with the seconds of a step.
VALID_STEPS = {"hour": 3600, "day": 86400, "week": 604800}


def frequency_valid(step_seconds: int) -> bool:
    """Whether a step is whole hours, days, weeks, or a month, quarter or year of them."""
    return step_seconds > 0 and (step_seconds % 3600 == 0)


def determine_periodicity(df: DataFrame, y: str, time_index: str, max_period: int = 400, threshold: float = 0.01) -> int | None:
    """The lag at the highest peak of the autocorrelation of the target without its line."""
    from quarry.functions.ordered import numbered

    rows = numbered(df.select(time_index, F.col(f"`{y}`").cast("double").alias("_y")), "_i", time_index)
    n, slope, icept = rows.agg(F.count("_y"), F.regr_slope("_y", "_i"), F.regr_intercept("_y", "_i")).first()
    flat = rows.withColumn("_y", F.col("_y") - F.lit(slope or 0.0) * F.col("_i") - F.lit(icept or 0.0))
    return period_of(autocorrelations(flat, "_y", "_i", min(max_period, max(n // 2, 1))), threshold)


def project_seasonal(season: list[float], period: int, ordinals: np.ndarray) -> np.ndarray:
    """The season at any ordinals: the last whole period repeats."""
    last = np.asarray(season[-period:], dtype=float)
    return last[(np.asarray(ordinals) - len(season)) % period]


class _Decomposer(Component):
    """Shared by both: one series, whose trend and season are learnt on the driver from its values in order of time.

    A series is one value for each step, small next to the tables that series come from; many series are decomposed by
    :func:`quarry.operators.series.decompose`. Rows are placed by their distance in steps from the first fitted one.
    """

    modifies_target = True

    def _series(self, df: DataFrame, y: str, time_index: str, max_length: int) -> tuple[np.ndarray, float, int]:
        step, _ = modal_step(df, time_index)
        rows = df.select(F.unix_timestamp(F.col(time_index).cast("timestamp")).alias("t"), F.col(f"`{y}`").cast("double").alias("v")).orderBy("t").limit(max_length + 1).collect()
        if len(rows) > max_length:
            raise ValueError(f"the series has more than {max_length} steps; decompose it by aggregates")
        return np.array([np.nan if r.v is None else r.v for r in rows]), float(rows[0].t) if rows else 0.0, step or 1

    def _curves(self, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _moved(self, df: DataFrame, column: str, sign: int) -> DataFrame:
        s, time_index = self.learnt(), self.parameters["time_index"]
        curves, start, step = self._curves, s["start"], s["step"]

        @F.pandas_udf("double")
        def both(t: pd.Series) -> pd.Series:
            at = np.round((t.to_numpy(dtype=float) - start) / step).astype(int)
            trend, season = curves(at)
            return pd.Series(trend + season)

        shift = both(F.unix_timestamp(F.col(time_index).cast("timestamp")).cast("double"))
        return df.withColumn(column, F.col(f"`{column}`").cast("double") + sign * shift)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._moved(df, self.learnt()["y"], -1)

    def inverse_transform(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return self._moved(df, column, 1)

    def set_period(self, period: int) -> None:
        if period < 2:
            raise ValueError("a period has two steps or more")
        self.parameters["period"] = period

    def trend_table(self, df: DataFrame) -> DataFrame:
        """(time, signal, trend, seasonality, residual) of a table's rows."""
        s, time_index, y = self.learnt(), self.parameters["time_index"], self.learnt()["y"]
        curves, start, step = self._curves, s["start"], s["step"]

        @F.pandas_udf("struct<trend:double,seasonality:double>")
        def parts(t: pd.Series) -> pd.DataFrame:
            trend, season = curves(np.round((t.to_numpy(dtype=float) - start) / step).astype(int))
            return pd.DataFrame({"trend": trend, "seasonality": season})

        out = df.select(time_index, F.col(f"`{y}`").cast("double").alias("signal"), parts(F.unix_timestamp(F.col(time_index).cast("timestamp")).cast("double")).alias("_p"))
        return out.select(time_index, "signal", "_p.trend", "_p.seasonality", (F.col("signal") - F.col("_p.trend") - F.col("_p.seasonality")).alias("residual"))

    def trend_intervals(self, df: DataFrame, coverage: float = 0.95) -> DataFrame:
        """(time, lower, upper): the trend and season at later rows, with bounds from the residuals that grow with distance."""
        s, time_index = self.learnt(), self.parameters["time_index"]
        z = NormalDist().inv_cdf(0.5 + coverage / 2)
        ahead = F.greatest((F.unix_timestamp(F.col(time_index).cast("timestamp")) - F.lit(s["start"])) / F.lit(s["step"]) - (s["n"] - 1), F.lit(1.0))
        base = self._moved(df.withColumn("_v", F.lit(0.0)), "_v", 1)
        width = z * s["residual_sd"] * F.sqrt(ahead)
        return base.select(time_index, (F.col("_v") - width).alias("lower"), (F.col("_v") + width).alias("upper"))


class PolynomialDecomposer(_Decomposer):
    """A polynomial trend, and as season the mean of the rest at each place of the period."""

    hyperparameters = {"degree": (1, 3)}

    def fit_state(self, df, y=None, time_index=None, degree=1, period=None, max_length=1_000_000):
        values, start, step = self._series(df, y, time_index, max_length)
        known = ~np.isnan(values)
        at = np.arange(len(values))
        trend = np.polyfit(at[known], values[known], min(degree, max(int(known.sum()) - 1, 0))) if known.any() else np.zeros(1)
        rest = values - np.polyval(trend, at)
        period = period or determine_periodicity(df, y, time_index) or 0
        season = [float(np.nanmean(rest[k::period])) for k in range(period)] if 1 < period <= len(values) // 2 else []
        fitted = rest - (np.resize(season, len(rest)) if season else 0.0)
        return {"start": start, "step": step, "n": len(values), "trend": trend.tolist(), "season": season, "residual_sd": float(np.nanstd(fitted)) if known.any() else 0.0}

    def _curves(self, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.learnt()
        season = np.asarray(s["season"])[ordinals % len(s["season"])] if s["season"] else np.zeros(len(ordinals))
        return np.polyval(s["trend"], ordinals), season


class STLDecomposer(_Decomposer):
    """Trend and season by local regression; beyond the series the last slope and the last period go on."""

    hyperparameters = {"degree": (1, 3)}

    def fit_state(self, df, y=None, time_index=None, degree=1, period=None, seasonal_smoother=7, max_length=100_000):
        values, start, step = self._series(df, y, time_index, max_length)
        period = period or determine_periodicity(df, y, time_index) or 7
        filled = pd.Series(values).interpolate(limit_direction="both").fillna(0.0).to_numpy()
        trend, season, rest = stl(filled, period, degree, smoother=seasonal_smoother)
        return {"start": start, "step": step, "n": len(values), "period": period, "trend": trend.tolist(), "season": season.tolist(), "residual_sd": float(np.std(rest))}

    def _curves(self, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.learnt()
        trend, season, n, period = np.asarray(s["trend"]), np.asarray(s["season"]), s["n"], s["period"]
        slope = (trend[-1] - trend[-min(period + 1, n)]) / max(min(period, n - 1), 1)
        inside = (ordinals >= 0) & (ordinals < n)
        at = np.clip(ordinals, 0, n - 1)
        first = np.where(ordinals < 0, ordinals * slope, 0.0)
        return np.where(inside, trend[at], np.where(ordinals < 0, trend[0] + first, trend[-1] + (ordinals - n + 1) * slope)), np.where(inside, season[at], project_seasonal(s["season"], period, ordinals))
