"""Small helpers on the driver."""

from __future__ import annotations

import importlib

import numpy as np
from pyspark.sql import DataFrame

from quarry import schema

SECONDS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600}


def convert_to_seconds(text: str) -> float:
    """'3 hours' as 10800.0."""
    value, _, unit = text.strip().partition(" ")
    unit = unit.strip().lower()
    name = unit if unit in SECONDS else unit.removesuffix("s")
    if name not in SECONDS:
        raise ValueError(f"no unit of time: {unit!r}")
    return float(value) * SECONDS[name]


def time_index_of(df: DataFrame, name: str | None = None) -> str:
    """The named datetime column, or the only one there is."""
    dates = schema.of_type(df, "datetime")
    if name:
        if name not in dates:
            raise ValueError(f"{name!r} is no datetime column")
        return name
    if len(dates) != 1:
        raise ValueError(f"the table has {len(dates)} datetime columns")
    return dates[0]


def random_state(seed) -> np.random.Generator:
    return seed if isinstance(seed, np.random.Generator) else np.random.default_rng(seed)


def import_or_raise(library: str, message: str | None = None):
    try:
        return importlib.import_module(library)
    except ImportError as e:
        raise ImportError(message or f"{library} is not installed") from e


def contains_ts_parameters(config: dict | None) -> tuple[bool, str]:
    """Whether a configuration has what time-series problems need, and a message if not."""
    missing = {"time_index", "gap", "max_delay", "forecast_horizon"} - {k for k, v in (config or {}).items() if v is not None}
    return not missing, f"missing parameters: {sorted(missing)}" if missing else ""


def validate_holdout(n_rows: int, horizon: int, starts_after_gap: bool) -> list[str]:
    """What is wrong with rows to predict: too many for the horizon, or not where the gap ends."""
    out = []
    if n_rows > horizon:
        out.append(f"{n_rows} rows are more than the horizon of {horizon}")
    if not starts_after_gap:
        out.append("the first row does not follow the training data and the gap")
    return out


def random_seed(state, low: int = 0, high: int = 2**31 - 1) -> int:
    """A whole number from a generator, or a given number brought into the range."""
    if isinstance(state, np.random.Generator):
        return int(state.integers(low, high))
    return int(state) if low <= int(state) < high else low + abs(int(state)) % (high - low)


def safe_repr(value) -> str:
    """Like ``repr``, with infinities and what is no number in a form that Python reads back."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return f"float({str(value)!r})"
    if isinstance(value, list):
        return f"[{', '.join(map(safe_repr, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k!r}: {safe_repr(v)}" for k, v in value.items()) + "}"
    return repr(value)


def matched(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """Features and target of the same rows, side by side by key."""
    return x.join(y, key)


def fractional_type(kind: str) -> str:
    """The type that a nullable column takes when fractions are imputed: integers become doubles, booleans categories."""
    return {"integer": "double", "boolean": "category"}.get(kind, kind)


def imputed_types(types: dict[str, str], strategies: dict[str, str]) -> dict[str, str]:
    """Logical types after imputation: means, medians and interpolation make integers fractional, other strategies keep types."""
    return {c: fractional_type(k) if strategies.get(c) in ("mean", "median", "interpolate", "knn") and k == "integer" else k for c, k in types.items()}
