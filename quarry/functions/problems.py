"""Problem types and what can be asked of them."""

from __future__ import annotations

from enum import Enum


class ProblemType(str, Enum):
    """The kinds of target that pipelines and objectives are made for; values compare equal to their names."""

    BINARY = "binary"
    MULTICLASS = "multiclass"
    REGRESSION = "regression"
    TIME_SERIES_REGRESSION = "time_series_regression"
    TIME_SERIES_BINARY = "time_series_binary"
    TIME_SERIES_MULTICLASS = "time_series_multiclass"
    MULTISERIES_TIME_SERIES_REGRESSION = "multiseries_time_series_regression"

    def __str__(self) -> str:
        return self.value


def handle_problem_types(problem: str | ProblemType) -> ProblemType:
    """The type of a name in any case, with blanks or underscores."""
    if isinstance(problem, ProblemType):
        return problem
    name = str(problem).strip().lower().replace(" ", "_")
    try:
        return ProblemType(name)
    except ValueError:
        raise KeyError(f"no problem type {problem!r}; there are {', '.join(p.value for p in ProblemType)}") from None


def is_regression(problem) -> bool:
    return handle_problem_types(problem).value.endswith("regression")


def is_binary(problem) -> bool:
    return handle_problem_types(problem).value.endswith("binary")


def is_multiclass(problem) -> bool:
    return handle_problem_types(problem).value.endswith("multiclass")


def is_classification(problem) -> bool:
    return not is_regression(problem)


def is_time_series(problem) -> bool:
    return "time_series" in handle_problem_types(problem).value


def is_multiseries(problem) -> bool:
    return handle_problem_types(problem) is ProblemType.MULTISERIES_TIME_SERIES_REGRESSION
