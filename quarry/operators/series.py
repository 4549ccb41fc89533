"""Time-series operators over long tables: a series is a window partition, time its order.

A single series is one window partition; a panel of many series is spread by their ids. Operators that only need
neighbours at a fixed distance (autocorrelation, lags of regular series) can use joins on ordinals instead.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators.base import Component
from quarry.operators.impute import forward_fill


def series_window(time_index: str, series_id: str | None = None):
    return (W.partitionBy(series_id) if series_id else W.partitionBy(F.lit(0))).orderBy(time_index)


def lags(df: DataFrame, columns: list[str], delays: list[int], time_index: str, series_id: str | None = None, names: dict | None = None) -> DataFrame:
    """``{column}_delay_{t}``: the value t rows earlier in its series."""
    w = series_window(time_index, series_id)
    return df.withColumns({f"{(names or {}).get(c, c)}_delay_{t}": F.lag(F.col(f"`{c}`"), t).over(w) for c in columns for t in delays})


def gapped_mean(c: Column, size: int, shift: int, w) -> Column:
    """Mean of ``size`` rows that end ``shift`` rows earlier; null unless all of them have values."""
    frame = w.rowsBetween(-(shift + size - 1), -shift)
    return F.when(F.count(c).over(frame) == size, F.avg(c).over(frame))


def autocorrelations(df: DataFrame, y: str, ordinal: str, max_lag: int) -> list[float]:
    """r_0 to r_max of a regular series, from one self join on ordinals and one aggregation."""
    mean = df.agg(F.avg(y)).first()[0]
    d = df.select(F.col(ordinal).alias("i"), (F.col(f"`{y}`") - F.lit(mean)).alias("d"))
    ahead = d.select((F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_lag)), lambda k: F.struct(k.alias("k"), (F.col("i") - k).alias("j"))))).alias("x"), F.col("d").alias("e")).select("x.k", "x.j", "e")
    sums = {r.k: r.s for r in d.join(ahead, F.col("i") == F.col("j")).groupBy("k").agg(F.sum(F.col("d") * F.col("e")).alias("s")).collect()}
    base = sums.get(0) or 1.0
    return [(sums.get(k) or 0.0) / base for k in range(max_lag + 1)]


def peaks(values: list[float]) -> list[int]:
    return [i for i in range(1, len(values) - 1) if values[i - 1] < values[i] > values[i + 1]]


def significant_lags(acf: list[float], n: int, start: int, max_delay: int, conf_level: float = 0.05) -> list[int]:
    """Lags whose correlation leaves its confidence band and that are peaks or below 10; the first candidate if there are none."""
    from statistics import NormalDist

    candidates = list(range(start, start + max_delay + 1))
    z = NormalDist().inv_cdf(1 - conf_level / 2)
    outside, total = [], 0.0
    for k in range(1, len(acf)):
        band = z * ((1 + 2 * total) / n) ** 0.5
        if abs(acf[k]) > band:
            outside.append(k)
        total += acf[k] ** 2
    top = set(peaks(acf))
    kept = sorted({k for k in outside if k in top or k < 10} & set(candidates))
    return kept or candidates[:1]


class TimeSeriesFeaturizer(Component):
    """Lags from horizon + gap on and gapped rolling means; the columns that they come from go."""

    def fit_state(self, df, y=None, time_index=None, series_id=None, max_delay=2, gap=0, forecast_horizon=1, conf_level=0.05, rolling_window_size=0.25, delay_features=True, delay_target=True):
        start = forecast_horizon + gap
        delays = list(range(start, start + max_delay + 1))
        if y and not series_id and schema.logical_types(df)[y] in schema.NUMERIC:
            table = df.select(F.row_number().over(W.orderBy(time_index)).alias("_i"), F.col(f"`{y}`").cast("double").alias("_y")).where("_y is not null")
            n = table.count()
            most = min(max(start + max_delay + 1, 10), max(n - 1, 1))
            delays = significant_lags(autocorrelations(table, "_y", "_i", most), n, start, max_delay, conf_level)
        keys = {time_index, series_id, y}
        return {"delays": delays, "columns": [c for c in df.columns if c not in keys and schema.logical_types(df)[c] not in ("text", "datetime")]}

    def transform(self, df: DataFrame) -> DataFrame:
        s, p = self.learnt(), self.parameters
        y, t, series = s["y"], p["time_index"], p["series_id"]
        columns = [c for c in s["columns"] if c in df.columns] if p["delay_features"] else []
        target = [y] if y in df.columns and p["delay_target"] else []
        w = series_window(t, series)
        out = lags(df, columns + target, s["delays"], t, series, {y: "target"})
        size, shift = int(p["rolling_window_size"] * p["max_delay"]) + 1, p["forecast_horizon"] + p["gap"]
        numeric = [c for c in columns + target if schema.logical_types(df)[c] in schema.NUMERIC]
        out = out.withColumns({f"{'target' if c == y else c}_rolling_mean": gapped_mean(F.col(f"`{c}`"), size, shift, w) for c in numeric})
        return out.drop(*columns)


def modal_step(df: DataFrame, time_index: str, series_id: str | None = None) -> tuple[int, float]:
    """The most frequent distance of neighbouring timestamps in seconds, and its share."""
    w = series_window(time_index, series_id)
    seconds = F.unix_timestamp(F.col(time_index).cast("timestamp"))
    gaps = df.select((seconds - F.lag(seconds).over(w)).alias("g")).where("g > 0").groupBy("g").count()
    first = gaps.orderBy(F.desc("count"), "g").first()
    total = gaps.agg(F.sum("count")).first()[0] or 1
    return (int(first["g"]), first["count"] / total) if first else (0, 0.0)


def calendar(df: DataFrame, time_index: str, step: int, series_id: str | None = None) -> DataFrame:
    """All timestamps from each series' first to its last, ``step`` seconds apart."""
    keys = [series_id] if series_id else []
    ends = df.where(F.col(time_index).isNotNull()).groupBy(*keys).agg(F.min(time_index).alias("_lo"), F.max(time_index).alias("_hi"))
    return ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {step} seconds"))).alias(time_index))


def classified_timestamps(df: DataFrame, time_index: str, step: int, series_id: str | None = None) -> DataFrame:
    """(timestamp, issue): duplicates, missing, extra, and extra or duplicate ones within a step of a missing one."""
    keys = [series_id] if series_id else []
    have = df.where(F.col(time_index).isNotNull()).groupBy(*keys, time_index).agg(F.count(F.lit(1)).alias("n"))
    cal = calendar(df, time_index, step, series_id)
    duplicate = have.where("n > 1").select(*keys, F.col(time_index).alias("ts"), F.lit("duplicate").alias("issue"))
    missing = cal.join(have, [*keys, time_index], "left_anti").select(*keys, F.col(time_index).alias("ts"), F.lit("missing").alias("issue"))
    extra = have.join(cal, [*keys, time_index], "left_anti").select(*keys, F.col(time_index).alias("ts"), F.lit("extra").alias("issue"))
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    # a band join by buckets of one step: a pair within a step of each other shares a bucket or has neighbouring ones
    odd = extra.unionByName(duplicate).select(*keys, "ts", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(seconds / step) + k)).alias("b"))
    gaps = missing.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("ts").alias("m_ts"), F.floor(seconds / step).alias("m_b"))
    near = (F.col("b") == F.col("m_b")) & (F.abs(F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("m_ts").cast("timestamp"))) <= step)
    for k in keys:
        near = near & (F.col(k) == F.col(f"m_{k}"))
    misaligned = odd.join(gaps, near, "left_semi").select(*keys, "ts", F.lit("misaligned").alias("issue")).distinct()
    return duplicate.unionByName(missing).unionByName(extra).unionByName(misaligned)


class TimeSeriesRegularizer(Component):
    """An even calendar: of rows with one timestamp the first value of each column, misaligned rows moved to the gap."""

    def fit_state(self, df, y=None, time_index=None, series_id=None, threshold=0.4):
        step, share = modal_step(df, time_index, series_id)
        if not step or share < 1 - threshold:
            raise ValueError("no frequency can be inferred")
        return {"step": step}

    def transform(self, df: DataFrame) -> DataFrame:
        t, series, step = self.parameters["time_index"], self.parameters["series_id"], self.learnt()["step"]
        keys = [series] if series else []
        rows = df.where(F.col(t).isNotNull())
        lo = F.min(t).over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
        seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
        slot = F.round((seconds(F.col(t)) - seconds(lo)) / step).cast("bigint")
        snapped = rows.withColumn("_ts", (lo + F.make_dt_interval(secs=(slot * step).cast("decimal(18,6)"))).cast(df.schema[t].dataType))
        exact = F.col("_ts") == F.col(t)
        others = [c for c in df.columns if c not in (*keys, t)]
        best = lambda c: F.coalesce(F.min_by(F.when(exact, F.col(f"`{c}`")), F.when(exact & F.col(f"`{c}`").isNotNull(), F.col(t))), F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(t))))
        one = snapped.groupBy(*keys, F.col("_ts").alias(t)).agg(*[best(c).alias(c) for c in others]) if others else snapped.select(*keys, F.col("_ts").alias(t)).distinct()
        return calendar(df, t, step, series).join(one, [*keys, t], "left").select(*df.columns)


def unstack(df: DataFrame, values: list[str], series_id: str, time_index: str, ids: list) -> DataFrame:
    """A column ``{value}|{id}`` for each series; the ids are given, so no extra pass finds them."""
    first = [F.first(c, ignorenulls=True).alias(c) for c in values]
    wide = df.groupBy(time_index).pivot(series_id, ids).agg(*first)
    return wide.select(time_index, *[F.col(f"`{i}`" if len(values) == 1 else f"`{i}_{c}`").alias(f"{c}|{i}") for c in values for i in ids])


def stack(df: DataFrame, time_index: str, series_id: str) -> DataFrame:
    """The inverse: a row for each time and series, columns by what stands before the separator."""
    names = [c for c in df.columns if "|" in c]
    ids = list(dict.fromkeys(c.rpartition("|")[2] for c in names))
    values = list(dict.fromkeys(c.rpartition("|")[0] for c in names))
    row = lambda i: F.struct(F.lit(i).alias(series_id), *[(F.col(f"`{v}|{i}`") if f"{v}|{i}" in names else F.lit(None)).alias(v) for v in values])
    return df.select(time_index, F.explode(F.array(*[row(i) for i in ids])).alias("_x")).select(time_index, "_x.*")


def forecast_period(df: DataFrame, time_index: str, horizon: int, gap: int, step: int, series_id: str | None = None) -> DataFrame:
    """The horizon's timestamps after the last row and the gap, for every series."""
    last = df.agg(F.max(time_index).alias("_l"))
    at = last.select(F.explode(F.sequence(F.lit(gap + 1), F.lit(gap + horizon))).alias("_k"), "_l")
    times = at.select((F.col("_l") + F.make_dt_interval(secs=(F.col("_k") * step).cast("decimal(18,6)"))).alias(time_index))
    if not series_id:
        return times
    return df.select(series_id).distinct().crossJoin(F.broadcast(times))  # a horizon of rows


def naive_forecast(df: DataFrame, y: str, time_index: str, gap: int, horizon: int, series_id: str | None = None) -> DataFrame:
    return df.withColumn("prediction", F.lag(F.col(f"`{y}`"), gap + horizon).over(series_window(time_index, series_id)))


def with_training_tail(train: DataFrame, test: DataFrame, time_index: str, n: int, gap: int, step: int) -> DataFrame:
    """The last n training rows, the gap's rows filled with the last of them, and the test rows."""
    tail = train.orderBy(F.desc(time_index)).limit(n)
    last = train.orderBy(F.desc(time_index)).limit(1)
    hole = last.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(gap)))).withColumn(time_index, F.col(time_index) + F.make_dt_interval(secs=(F.col("_k") * step).cast("decimal(18,6)"))).drop("_k") if gap else None
    out = tail.unionByName(hole) if hole is not None else tail
    out = out.unionByName(test, allowMissingColumns=True)
    w = W.partitionBy(F.lit(0)).orderBy(time_index)
    return out.select(*[c if c == time_index else forward_fill(F.col(f"`{c}`"), w).alias(c) for c in out.columns])


def dates_needed(date: datetime.datetime, end: datetime.datetime | None = None, *, horizon: int, max_delay: int, gap: int, step: datetime.timedelta) -> tuple:
    """First and last day of history that predictions for a date or range need."""
    end = end or date
    return date - (horizon + max_delay + gap) * step, end - (1 + gap) * step


def separated_by_gap(train_end, test_start, gap: int, step) -> bool:
    return train_end + (gap + 1) * step == test_start


def valid_for_split(gap: int, max_delay: int, horizon: int, n_obs: int, n_splits: int) -> bool:
    return n_obs - horizon * n_splits > gap + max_delay + horizon


# Decomposition: grouped kernels over whole series, which are small next to the table of all series.


def stl(values, period: int, degree: int = 1, rounds: int = 2, smoother: int = 7):
    """Trend and season of a series by local regression: seasonal sub-series are smoothed, then the rest."""
    import numpy as np

    y = np.asarray(values, dtype=float)
    n = len(y)

    def loess(x, v, span):
        span = max(3, min(span, len(x)))
        out = np.empty(len(x))
        for i in range(len(x)):
            at = np.argsort(np.abs(x - x[i]), kind="stable")[:span]
            d = np.abs(x[at] - x[i]) / max(np.abs(x[at] - x[i]).max(), 1e-12)
            w = np.clip(1 - d**3, 0, None) ** 3 + 1e-9
            out[i] = np.polyval(np.polyfit(x[at] - x[i], v[at], min(degree, len(at) - 1), w=np.sqrt(w)), 0)
        return out

    t = np.arange(n, dtype=float)
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        rest = y - trend
        for k in range(period):
            at = np.arange(k, n, period)
            season[at] = loess(at.astype(float), rest[at], smoother)
        kernel = np.ones(period) / period
        padded = np.concatenate([np.full(period, season[:period].mean()), season, np.full(period, season[-period:].mean())])
        season -= np.convolve(padded, kernel, "same")[period : period + n]
        trend = loess(t, y - season, int(1.5 * period / max(1 - 1.5 / smoother, 0.2)) | 1)
    return trend, season, y - trend - season


def decompose(df: DataFrame, y: str, time_index: str, period: int, series_id: str | None = None) -> DataFrame:
    """(series, time, signal, trend, seasonality, residual); a task holds one series."""
    import pandas as pd

    keys = [series_id] if series_id else []
    key_types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time_index)
        trend, season, rest = stl(rows[y], period)
        return rows[[*keys, time_index]].assign(signal=rows[y].astype(float), trend=trend, seasonality=season, residual=rest)

    grouped = df.groupBy(*keys) if keys else df.groupBy(F.lit(0).alias("_g"))
    return grouped.applyInPandas(one, f"{key_types}`{time_index}` {df.schema[time_index].dataType.simpleString()}, signal double, trend double, seasonality double, residual double")


def polynomial_trend(df: DataFrame, y: str, ordinal: str, degree: int = 1) -> list[float]:
    """Least-squares coefficients, constant first, from sums of powers in one aggregation."""
    import numpy as np

    x, v = F.col(ordinal).cast("double"), F.col(f"`{y}`").cast("double")
    got = df.agg(*[F.sum(F.pow(x, F.lit(k))).alias(f"x{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(x, F.lit(k)) * v).alias(f"y{k}") for k in range(degree + 1)]).first()
    a = np.array([[got[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(a, np.array([got[f"y{k}"] for k in range(degree + 1)])).tolist()


def period_of(acf: list[float], threshold: float = 0.01) -> int | None:
    """The lag of the highest local maximum above the threshold."""
    best = [k for k in peaks(acf) if acf[k] > threshold]
    return max(best, key=lambda k: acf[k]) if best else None
