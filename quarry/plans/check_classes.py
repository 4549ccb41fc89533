"""Data checks as objects: one class for each check, collections of them, and actions that still have choices."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

from quarry.plans import profile
from quarry.plans.profile import Action, Message

#: Codes of actions and of messages.
ActionCode = Enum("ActionCode", {c.upper(): c for c in profile.ACTIONS})
MessageCode = Enum(
    "MessageCode",
    {c: c.lower() for c in (
        "HIGHLY_NULL_COLS", "HIGHLY_NULL_ROWS", "COLS_WITH_NULL", "HAS_ID_COLUMN", "HAS_ID_FIRST_COLUMN", "TARGET_INCOMPATIBLE_OBJECTIVE_TYPE", "TARGET_IS_NONE", "TARGET_IS_EMPTY_OR_FULLY_NULL", "TARGET_HAS_NULL",
        "TARGET_UNSUPPORTED_TYPE", "TARGET_UNSUPPORTED_PROBLEM_TYPE", "TARGET_BINARY_NOT_TWO_UNIQUE_VALUES", "TARGET_MULTICLASS_NOT_ENOUGH_CLASSES", "TARGET_MULTICLASS_NOT_TWO_EXAMPLES_PER_CLASS", "TARGET_MULTICLASS_HIGH_UNIQUE_CLASS_WARNING",
        "TARGET_LOGNORMAL_DISTRIBUTION", "MISMATCHED_LENGTHS", "MISMATCHED_INDICES", "MISMATCHED_INDICES_ORDER", "MISMATCHED_SERIES_LENGTH", "INVALID_SERIES_ID_COL", "TARGET_LEAKAGE", "HAS_OUTLIERS", "NO_VARIANCE", "NO_VARIANCE_WITH_NULL", "NO_VARIANCE_ZERO_UNIQUE",
        "TOO_UNIQUE", "NOT_UNIQUE_ENOUGH", "TOO_SPARSE", "CLASS_IMBALANCE_BELOW_FOLDS", "CLASS_IMBALANCE_BELOW_THRESHOLD", "CLASS_IMBALANCE_SEVERE", "IS_MULTICOLLINEAR", "DATETIME_HAS_UNEVEN_INTERVALS", "DATETIME_HAS_MISALIGNED_VALUES", "DATETIME_HAS_REDUNDANT_ROW",
        "DATETIME_IS_MISSING_VALUES", "DATETIME_HAS_NAN", "DATETIME_IS_NOT_MONOTONIC", "DATETIME_NO_FREQUENCY_INFERRED", "DATETIME_INFORMATION_NOT_FOUND", "TIMESERIES_PARAMETERS_NOT_COMPATIBLE_WITH_SPLIT", "TIMESERIES_TARGET_NOT_COMPATIBLE_WITH_SPLIT",
    )},
)


@dataclass
class ActionOption:
    """An action with parameters that a user may choose: name to {type, default_value, categories}; column choices nest
    under ``columns``."""

    code: str
    check: str
    metadata: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, p in self.parameters.items():
            if "columns" in p:
                for column, inner in p["columns"].items():
                    for k, q in inner.items():
                        if "default_value" not in q:
                            raise ValueError(f"{name} of {column} has no default for {k}")
            elif "default_value" not in p:
                raise ValueError(f"{name} has no default")

    def action(self, chosen: dict | None = None) -> Action:
        """The action with the chosen parameters, and defaults for the others."""
        chosen, out = dict(chosen or {}), {}
        for name, p in self.parameters.items():
            if "columns" in p:
                out[name] = {c: {k: chosen.get(name, {}).get(c, {}).get(k, q["default_value"]) for k, q in inner.items()} for c, inner in p["columns"].items()}
            else:
                out[name] = chosen.get(name, p["default_value"])
                if "categories" in p and out[name] not in p["categories"]:
                    raise ValueError(f"{name} must be one of {p['categories']}")
        return Action(self.code, self.check, self.metadata | out, out)

    def get_action_from_defaults(self) -> Action:
        return self.action()


def options_of(messages: list[Message]) -> list[ActionOption]:
    """The actions of messages with what is left to choose: how columns and targets are imputed, how outlier rows go."""
    out = []
    for m in messages:
        for a in m.actions:
            parameters: dict = {}
            if a.code == "impute_col" and a.metadata.get("is_target"):
                parameters = {"strategy": {"type": "global", "categories": ["mean", "most_frequent"], "default_value": a.metadata.get("strategy", "most_frequent")}}
            elif a.code == "impute_col":
                parameters = {"impute_strategies": {"columns": {c: {"impute_strategy": {"categories": ["mean", "median", "most_frequent"], "default_value": "most_frequent"}} for c in a.metadata.get("columns", [])}}}
            out.append(ActionOption(a.code, a.check, a.metadata, parameters))
    return out


def actions_from_defaults(options: list[ActionOption]) -> list[Action]:
    return [o.get_action_from_defaults() for o in options]


class DataCheck:
    """A check to subclass: ``validate`` looks at a table and the name of its target and returns messages."""

    def __init__(self, **options):
        self.options = options

    @property
    def name(self) -> str:
        return type(self).__name__

    def validate(self, df: DataFrame, y: str | None = None) -> list[Message]:
        raise NotImplementedError


def _wrapped(name: str, work, doc: str) -> type[DataCheck]:
    def validate(self, df: DataFrame, y: str | None = None) -> list[Message]:
        return work(df, y, **self.options)

    return type(name, (DataCheck,), {"validate": validate, "__doc__": doc})


NullDataCheck = _wrapped("NullDataCheck", lambda df, y, **o: profile.null_check(df, y, **o), "Columns and rows of nulls.")
IDColumnsDataCheck = _wrapped("IDColumnsDataCheck", lambda df, y, **o: profile.id_check(df, y, **o), "Columns that number the rows.")
NoVarianceDataCheck = _wrapped("NoVarianceDataCheck", lambda df, y, **o: profile.no_variance_check(df, y, **o), "Columns and targets of one value.")
ClassImbalanceDataCheck = _wrapped("ClassImbalanceDataCheck", lambda df, y, **o: profile.class_imbalance_check(df, y, **o), "Classes that are rare.")
TargetLeakageDataCheck = _wrapped("TargetLeakageDataCheck", lambda df, y, **o: profile.leakage_check(df, y, **o), "Columns that give the target away.")
UniquenessDataCheck = _wrapped("UniquenessDataCheck", lambda df, y, problem, **o: profile.uniqueness_check(df, y, problem, **o), "Columns too unique or too little.")
SparsityDataCheck = _wrapped("SparsityDataCheck", lambda df, y, problem, **o: profile.sparsity_check(df, y, problem, **o), "Columns whose values are rare.")
InvalidTargetDataCheck = _wrapped("InvalidTargetDataCheck", lambda df, y, problem, **o: profile.invalid_target_check(df, y, problem, **o), "Targets that a problem cannot have.")
TargetDistributionDataCheck = _wrapped("TargetDistributionDataCheck", lambda df, y, **o: profile.target_distribution_check(df, y, **o), "Targets that a logarithm would straighten.")
DateTimeFormatDataCheck = _wrapped("DateTimeFormatDataCheck", lambda df, y, time_index, series_id=None, **o: profile.datetime_check(df, time_index, series_id, **o), "Timestamps without an even step.")
MismatchedSeriesLengthDataCheck = _wrapped("MismatchedSeriesLengthDataCheck", lambda df, y, series_id, **o: profile.series_length_check(df, series_id, **o), "Series of other lengths than most.")
TimeSeriesSplittingDataCheck = _wrapped("TimeSeriesSplittingDataCheck", lambda df, y, time_index, **o: profile.ts_splitting_check(df, y, time_index, **o), "Splits that miss classes.")


class DataChecks(DataCheck):
    """Several checks in turn; one that needs a problem, time index or series id gets it from the collection's options."""

    def __init__(self, checks: list[type[DataCheck] | DataCheck], options: dict[str, dict] | None = None):
        super().__init__()
        known = {c if isinstance(c, type) else type(c) for c in checks}
        unknown = set(options or {}) - {c.__name__ for c in known}
        if unknown:
            raise ValueError(f"options for checks that are not there: {sorted(unknown)}")
        self.checks = [c if isinstance(c, DataCheck) else c(**(options or {}).get(c.__name__, {})) for c in checks]

    def validate(self, df: DataFrame, y: str | None = None) -> list[Message]:
        out: list[Message] = []
        for check in self.checks:
            out += [m for m in check.validate(df, y) if m not in out]
        return out


class DefaultDataChecks(DataCheck):
    """The checks that suit a problem."""

    def __init__(self, problem: str, config: dict | None = None):
        super().__init__(problem=problem, config=config)

    def validate(self, df: DataFrame, y: str | None = None) -> list[Message]:
        if y is None or y not in df.columns:
            return [Message("InvalidTargetDataCheck", "error", "TARGET_IS_NONE", "there is no target")]
        return profile.default_checks(df, y, self.options["problem"], self.options["config"])


def time_order_check(df: DataFrame, time_index: str, key: str) -> list[Message]:
    """Whether timestamps grow in the order of the row key: one comparison with the row before in each, without all rows in one task."""
    from pyspark.sql import functions as F

    from quarry.functions.ordered import with_previous

    back = with_previous(df.select(key, time_index), key, time_index, "_was").where(F.col("_was") > F.col(time_index)).limit(1).count()
    return [Message("DateTimeFormatDataCheck", "error", "DATETIME_IS_NOT_MONOTONIC", f"{time_index} does not grow in the order of {key}")] if back else []


def keys_check(x: DataFrame, y: DataFrame, key: str) -> list[Message]:
    """Whether a table of features and one of targets hold the same rows, by key."""
    from pyspark.sql import functions as F

    n, m = x.count(), y.count()
    if n != m:
        return [Message("InvalidTargetDataCheck", "warning", "MISMATCHED_LENGTHS", f"{n} rows of features, {m} of targets", {"features": n, "targets": m})]
    both = x.select(key).withColumn("_x", F.lit(1)).join(y.select(key).withColumn("_y", F.lit(1)), key, "full").where("_x is null or _y is null").limit(1).count()
    return [Message("InvalidTargetDataCheck", "warning", "MISMATCHED_INDICES", "features and targets have different keys")] if both else []
